"""Surfaces against dense solves of their equations."""

import numpy as np
import pytest

from fluvia.operators import solvers


def domain(seed, h, w, share=0.8):
    rng = np.random.default_rng(seed)
    return rng, rng.random((h, w)) < share


def components(inside):
    label, out = 0, np.zeros(inside.shape, int)
    for start in zip(*np.nonzero(inside)):
        if out[start]:
            continue
        label += 1
        todo = [start]
        out[start] = label
        while todo:
            r, c = todo.pop()
            for a, b in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                if 0 <= a < inside.shape[0] and 0 <= b < inside.shape[1] and inside[a, b] and not out[a, b]:
                    out[a, b] = label
                    todo.append((a, b))
    return out


def laplacian(inside):
    at = -np.ones(inside.shape, int)
    at[inside] = np.arange(inside.sum())
    k = np.zeros((inside.sum(), inside.sum()))
    for (r, c), i in np.ndenumerate(at):
        if i < 0:
            continue
        for a, b in ((r + 1, c), (r, c + 1)):
            if a < inside.shape[0] and b < inside.shape[1] and at[a, b] >= 0:
                j = at[a, b]
                k[i, i] += 1
                k[j, j] += 1
                k[i, j] -= 1
                k[j, i] -= 1
    return k, at


@pytest.mark.parametrize("block", [None, 5])
def test_dirichlet_with_a_source_equals_a_dense_solve(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(solvers, "BLOCK_CELLS", block)
        monkeypatch.setattr(solvers, "OVERLAP", 2)
    rng, inside = domain(3, *((14, 11) if block is None else (10, 8)))
    label = components(inside)
    anchor = np.where(inside & (rng.random(inside.shape) < 0.08), rng.uniform(0, 50, inside.shape), np.nan)
    rows = [(int(label[r, c]), int(r), int(c), None if np.isnan(anchor[r, c]) else float(anchor[r, c])) for r, c in zip(*np.nonzero(inside))]
    got = {(r.r, r.c): r.value for r in solvers.dirichlet_surface(spark.createDataFrame(rows, "component long, r long, c long, anchor double"), mound=0.7).collect()}
    k, at = laplacian(inside)
    fixed = ~np.isnan(anchor[inside])
    alive = np.isin(label[inside], np.unique(label[inside][fixed]))
    free = alive & ~fixed
    x = np.nan_to_num(anchor[inside])
    x[free] = np.linalg.solve(k[np.ix_(free, free)], 0.7 - k[np.ix_(free, fixed)] @ x[fixed])
    assert 0 < free.sum() < alive.sum() and len(got) == inside.sum()
    for (r, c), i in np.ndenumerate(at):
        if i >= 0:
            assert got[r, c] == (pytest.approx(x[i], abs=1e-4) if alive[i] else None)


def dense_robust(inside, observed, n, cap, alive, scale=10.0, cap_weight=1e3, iterations=8):
    k, _ = laplacian(inside)
    k = k[np.ix_(alive, alive)]
    y, count, top = observed[inside][alive], np.minimum(n, 10)[inside][alive], cap[inside][alive]
    seen = ~np.isnan(y) & (count > 0)
    y, count = np.where(seen, y, 0), np.where(seen, count, 0.0)

    def solve(w, active):
        caps = np.where(active, cap_weight, 0.0)
        return np.linalg.solve(k + np.diag(w + caps + 1e-9), w * y + caps * np.nan_to_num(top))

    s = solve(count, np.zeros(len(y), bool))
    for _ in range(iterations):
        s = solve(count / (1 + ((s - y) / scale) ** 2), ~np.isnan(top) & (s > np.nan_to_num(top)))
    return s


@pytest.mark.parametrize("block", [None, 5])
def test_robust_surface_equals_a_dense_solve(spark, monkeypatch, block):
    if block:
        monkeypatch.setattr(solvers, "BLOCK_CELLS", block)
        monkeypatch.setattr(solvers, "OVERLAP", 2)
    rng, inside = domain(8, 9, 10, 0.85)
    label = components(inside)
    observed = np.where(inside & (rng.random(inside.shape) < 0.3), rng.normal(20, 8, inside.shape), np.nan)
    observed[np.unravel_index(np.nanargmax(observed), observed.shape)] = 400
    n = rng.integers(0, 14, inside.shape)
    cap = np.where(inside & (rng.random(inside.shape) < 0.15), rng.normal(15, 3, inside.shape), np.nan)
    data = (~np.isnan(observed) & (n > 0)) | ~np.isnan(cap)
    alive = np.isin(label[inside], np.unique(label[inside & data]))
    value = lambda a, r, c: None if np.isnan(a[r, c]) else float(a[r, c])
    rows = [(int(label[r, c]), int(r), int(c), value(observed, r, c), int(n[r, c]), value(cap, r, c)) for r, c in zip(*np.nonzero(inside))]
    iterations = 8 if block is None else 1
    got = {(r.r, r.c): r.value for r in solvers.robust_surface(spark.createDataFrame(rows, "component long, r long, c long, observed double, n int, cap double"), iterations=iterations).collect()}
    want = iter(dense_robust(inside, observed, n, cap, alive, iterations=iterations))
    for r, c in zip(*np.nonzero(inside)):
        i = len([0 for a, b in zip(*np.nonzero(inside)) if (a, b) < (r, c)])
        assert got[r, c] == (pytest.approx(next(want), abs=2e-3) if alive[i] else None)


def test_rounds_do_not_follow_the_width(spark, monkeypatch):
    monkeypatch.setattr(solvers, "BLOCK_CELLS", 50)
    monkeypatch.setattr(solvers, "OVERLAP", 12)
    used = {}
    for width in (200, 800):
        df = spark.range(width).selectExpr("1L AS component", "id % 1 AS r", "id AS c", f"id = 0 OR id = {width - 1} AS fixed").selectExpr("component", "r", "c", "0D AS w", "0D AS load", "fixed")
        start = df.selectExpr("component", "r", "c", "if(c = 0, 0D, if(fixed, 100D, 50D)) AS value")
        state, used[width] = solvers._settled(df, start, 2e-3)
        assert max(abs(r.value - 100 * r.c / (width - 1)) for r in state.collect()) < 5
    # without the coarse cells news of the ends moves by one block a round, and its effect with the square of them
    assert used[800] <= 3 * used[200] + 5, used
