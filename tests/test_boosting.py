"""Boosted histograms against plain boosting on rows, and leaks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import boosting
from fluvia.operators.boosting import Shape

SHAPE = Shape(bins=6, pair_bins=3, rounds=40, rate=0.2)


def table(n=600, blocks=5, seed=2):
    rng = np.random.default_rng(seed)
    a, b = rng.normal(0, 1, n), rng.normal(0, 1, n)
    a[rng.random(n) < 0.1] = np.nan
    y = np.where(np.isnan(a), 3, np.nan_to_num(a) ** 2) + 2 * b * (np.nan_to_num(a) > 0) + rng.normal(0, 0.1, n)
    return [(i, f"b{int(k)}" if k < 99 else None, None if np.isnan(x) else float(x), float(z), float(t), float(w)) for i, (k, x, z, t, w) in enumerate(zip(rng.integers(0, blocks, n), a, b, y, rng.integers(0, 3, n)))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, block string, a double, b double, y double, w double").repartition(3)


def plainly(bins, shape, train, test):
    """Boosting on rows: every round each histogram is tried on what is left of the labels."""
    x, y, w = train
    codes, asked = bins.codes(x), bins.codes(test)
    base = (w * y).sum() / w.sum()
    left, out = y - base, np.full(len(asked), base)
    for _ in range(shape.rounds):
        best = None
        for h in range(codes.shape[1]):
            weight = np.bincount(codes[:, h], w, bins.size)
            total = np.bincount(codes[:, h], w * left, bins.size)
            scale = np.where(weight >= shape.least, 1 / (weight + shape.l2), 0)
            gain = (total**2 * scale).sum()
            if best is None or gain > best[0] + 1e-9:
                best = gain, h, shape.rate * total * scale
        left = left - best[2][codes[:, best[1]]]
        out = out + best[2][asked[:, best[1]]]
    return out


@pytest.mark.parametrize("weight", [None, "w"])
def test_equal_to_plain_boosting(spark, weight, monkeypatch):
    monkeypatch.setattr(boosting, "CHUNK_ROWS", 50)
    rows = table()
    df = frame(spark, rows)
    got = {r.id: r for r in boosting.leave_one_block_out(df, "id", "block", ["a", "b"], "y", weight, 30, SHAPE).collect()}
    assert len(got) == len(rows) and all(r.eligible for r in got.values())
    bins = boosting.bins_of(df, ["a", "b"], SHAPE)[None]
    x = [np.array([np.nan if r[i] is None else r[i] for r in rows]) for i in (2, 3)]
    y, w, block = np.array([r[4] for r in rows]), np.array([r[5] for r in rows]) if weight else np.ones(len(rows)), np.array([r[1] for r in rows])
    for b in set(block):
        own = block == b
        want = plainly(bins, SHAPE, ([c[~own] for c in x], y[~own], w[~own]), [c[own] for c in x])
        assert np.allclose([got[i].prediction for i in np.flatnonzero(own)], want, atol=1e-4)
    error = np.mean([abs(r.prediction - r.y) for r in got.values()])
    assert error < 0.75 * np.mean(np.abs(y - y.mean()))


def test_own_labels_never_move_own_scores(spark):
    rows = table(200, 3)
    scores = []
    for shift in (0.0, 1e7, -3.33e5):
        moved = [(i, k, a, b, y + shift * (k == "b1"), w) for i, k, a, b, y, w in rows]
        out = boosting.leave_one_block_out(frame(spark, moved), "id", "block", ["a", "b"], "y", None, 10, SHAPE)
        scores.append({r.id: r.prediction for r in out.where("block = 'b1'").collect()})
    assert scores[0] == scores[1] == scores[2] and len(scores[0]) > 10


def test_small_blocks_gaps_and_empty_tables(spark):
    rows = table(120, 2) + [(1000, "tiny", 1.0, 1.0, 99.0, 1.0), (1001, None, 1.0, 1.0, 99.0, 1.0), (1002, "b0", None, None, None, 1.0)]
    got = {r.id: r for r in boosting.leave_one_block_out(frame(spark, rows), "id", "block", ["a", "b"], "y", None, 30, SHAPE).collect()}
    assert len(got) == len(rows) and not got[1000].eligible and got[1000].prediction is None and not got[1001].eligible
    assert got[1002].prediction is not None
    without = [r for r in rows if r[0] not in (1000, 1001)]
    again = {r.id: r.prediction for r in boosting.leave_one_block_out(frame(spark, without), "id", "block", ["a", "b"], "y", None, 30, SHAPE).collect()}
    assert all(again[i] == got[i].prediction for i in again)
    assert boosting.leave_one_block_out(frame(spark, []), "id", "block", ["a", "b"], "y", None, 30, SHAPE).count() == 0
    only = boosting.leave_one_block_out(frame(spark, [r for r in rows if r[1] == "b0"]), "id", "block", ["a", "b"], "y", None, 30, SHAPE)
    assert only.where("prediction is not null").count() == 0


def test_random_folds_hold_all_rows(spark):
    folds = boosting.random_folds(frame(spark, table(500)), "id", 5)
    assert folds.groupBy("fold").count().agg(F.min("count")).first()[0] > 60 and folds.count() == 500
