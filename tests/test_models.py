"""Folds and models against plain versions of themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.operators import models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = []
    for i in range(240):
        p, q = float(rng.normal(20, 6)), float(rng.normal(3, 1))
        out.append((i, i % 4, p if i % 11 else None, q, 2 * p + 5 * q + float(rng.normal(0, 2))))
    return spark.createDataFrame(out, "well_id long, fold int, p double, q double, y double")


def test_balanced_folds_by_hand(spark):
    sizes = {"a": 7, "b": 5, "c": 5, "d": 4, "e": 2, "f": 2, "g": 1}
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "block string")
    load, want = [0, 0, 0], {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        k = load.index(min(load))
        want[g], load[k] = k, load[k] + sizes[g]
    assert {r.block: r.fold for r in models.balanced_folds(df, "block", 3).collect()} == want
    turns = models.round_robin_folds(df, "block", 3).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in turns) == [2, 2, 3]


def test_ridge_against_the_normal_equations(rows):
    table = rows.orderBy("well_id").toPandas()
    gap = table.p.isna().astype(float)
    x = np.c_[table.p.fillna(table.p.median()), table.q, gap, np.zeros(len(table))]
    got = {r.well_id: r.prediction for r in models.out_of_fold(rows, ["p", "q"], "y", "ridge", [0, 1, 2, 3]).collect()}
    for fold in range(4):
        train, test = (table.fold != fold).to_numpy(), (table.fold == fold).to_numpy()
        mx, my = x[train].mean(0), table.y[train].mean()
        w = np.linalg.solve((x[train] - mx).T @ (x[train] - mx) + np.eye(4), (x[train] - mx).T @ (table.y[train] - my))
        assert np.allclose([got[i] for i in table.well_id[test]], my + (x[test] - mx) @ w, atol=1e-6)


def pooled(x, y):
    """Values and means of the pooled adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks = []
    for i in order:
        blocks.append([y[i], 1, [x[i]]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            n = a[1] + b[1]
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / n, n, a[2] + b[2]])
    return [(min(b[2]), max(b[2]), b[0]) for b in blocks]


def test_isotonic_against_pooled_violators(rows):
    full = rows.where("p is not null")
    table = full.toPandas()
    for r in models.out_of_fold(full, ["p"], "y", "isotonic", [0, 1]).collect():
        train = table[table.fold != r.fold]
        p = float(table.p[table.well_id == r.well_id].iloc[0])
        knots = [(v, m) for low, high, m in pooled(train.p.to_numpy(), train.y.to_numpy()) for v in (low, high)]
        assert r.prediction == pytest.approx(float(np.interp(p, [k for k, _ in knots], [m for _, m in knots])), abs=1e-6)


def test_permuting_tells_what_matters(rows):
    full = rows.where("p is not null").withColumn("noise", F.rand(3))
    out = {r.feature: r.increase for r in models.permutation_importance(full, ["p", "q", "noise"], "y").collect()}
    assert out["p"] > out["q"] > 1 and abs(out["noise"]) < 0.2


def test_boosted_beats_a_guess(rows):
    full = rows.where("p is not null")
    out = models.out_of_fold(full, ["p", "q"], "y", "boosted", [0, 1, 2, 3])
    assert out.count() == full.count()
    errors = out.agg(F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("e")).first().e
    assert errors < 0.6 * full.agg(F.avg(F.abs(F.col("y") - 55)).alias("e")).first().e


def groups_of_three(spark):
    return spark.createDataFrame([(i, float(i % 3 * 50 + i % 7), float(i % 3 * 50 + i % 5)) for i in range(120)], "point_id long, a double, b double")


def test_clusters_find_three_groups(spark):
    three = groups_of_three(spark)
    sweep = {r.k: r for r in models.clusters(three, ["a", "b"], 4).collect()}
    assert sweep[3].silhouette > max(sweep[2].silhouette, sweep[4].silhouette) and sweep[3].davies_bouldin < sweep[2].davies_bouldin


def test_mixture_finds_three_groups(spark):
    three = groups_of_three(spark)
    parts = models.mixture(three, ["a", "b"], "point_id", 3).collect()
    assert len({(r.point_id % 3, r.component) for r in parts}) == 3
