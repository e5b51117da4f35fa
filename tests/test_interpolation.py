"""Weighted neighbours, thin plates, and nested folds against plain versions."""

import numpy as np
import pytest

from fluvia.operators import interpolation as I
from fluvia.operators.boosting import Shape


def wells(n=160, seed=4):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, y = (float(v) for v in rng.uniform(0, 9000, 2))
        block = int(x // 1500) * 10 + int(y // 3000)
        dem = 900 + x / 100 + float(rng.normal(0, 5))
        wte = dem - 20 + 8 * float(np.sin(y / 900)) + float(rng.normal(0, 1))
        out.append((i, x, y, wte, float(rng.integers(0, 3)), block, block % 4, dem, wte + float(rng.normal(0, 6)), float(rng.uniform(0, 40)), float(np.sin(y / 900))))
    return out


SCHEMA = "id long, x double, y double, obs_wte_m double, w double, block int, fold int, dem_m double, fac_wte_m double, fac_dtw_m double, s double"


def nearest(rows, r, k, usable):
    return sorted((np.hypot(r[1] - q[1], r[2] - q[2]), q[0], q[3], q[4]) for q in rows if usable(q))[:k]


def plain_idw(near, power=2.0, eps=1e-6):
    if not near:
        return None
    d, _, v, w = (np.array(c, float) for c in zip(*near))
    same = d <= eps
    if same.any():
        return float((w * v)[same].sum() / w[same].sum()) if w[same].sum() > 0 else float(v[same].mean())
    share = w / (d + eps) ** power
    return float((share * v).sum() / share.sum()) if share.sum() > 0 else float(v.mean())


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_weights_coincidence_and_fallbacks(spark):
    base = spark.createDataFrame([(1, 0.0, 5.0, 0.0), (1, 0.0, 9.0, 0.0), (2, 0.0, 5.0, 1.0), (2, 1e-6, 8.0, 3.0), (2, 3.0, 100.0, 9.0), (3, 2.0, 4.0, 0.0), (3, 9.0, 6.0, None), (4, 1.0, 10.0, 1.0), (4, 1.0, 20.0, 3.0), (5, 2.0, 7.0, -1.0)], "q long, distance_m double, v double, w double")
    got = {r.q: (r.predicted, r.n_neighbours) for r in I.weighted_idw(base, ["q"], "v", "w").collect()}
    assert got[1] == (7.0, 2) and got[2] == (pytest.approx((5 + 24) / 4), 3) and got[3] == (5.0, 2) and got[5] == (7.0, 1)
    assert got[4] == (pytest.approx(17.5), 2)
    alone = {r.q: r.predicted for r in I.weighted_idw(base, ["q"], "v").collect()}
    assert alone[2] == 6.5 and alone[4] == pytest.approx(15)


def test_crossfit_equals_plain(spark):
    rows = wells()
    got = {r.id: r.predicted for r in I.crossfit(frame(spark, rows), "id", "obs_wte_m", "fold", 6, "w").collect()}
    for r in rows:
        assert got[r[0]] == pytest.approx(plain_idw(nearest(rows, r, 6, lambda q: q[6] != r[6])), abs=1e-9)


def plain_plate(x, y, points, smoothing):
    p = np.array([(a, b) for a, b, _ in points])
    r = np.hypot(*(p[:, None] - p[None]).transpose(2, 0, 1))
    bent = np.where(r > 0, r**2 * np.log(np.where(r > 0, r, 1)), 0) + smoothing * np.eye(len(p))
    plane = np.c_[np.ones(len(p)), p]
    left = np.block([[bent, plane], [plane.T, np.zeros((3, 3))]])
    w = np.linalg.solve(left, np.r_[[v for *_, v in points], 0, 0, 0])
    d = np.hypot(p[:, 0] - x, p[:, 1] - y)
    return float(w @ np.r_[np.where(d > 0, d**2 * np.log(np.where(d > 0, d, 1)), 0), 1, x, y])


@pytest.mark.parametrize("k", [16, 32])
def test_thin_plates_equal_plain(spark, k):
    rows = wells(120)
    got = {r.id: r.predicted for r in I.crossfit(frame(spark, rows), "id", "obs_wte_m", "fold", k, method="thin_plate").collect()}
    at = {r[0]: r for r in rows}
    for r in rows:
        points = [(at[i][1] / 1000, at[i][2] / 1000, v) for _, i, v, _ in nearest(rows, r, k, lambda q: q[6] != r[6])]
        assert got[r[0]] == pytest.approx(plain_plate(r[1] / 1000, r[2] / 1000, points, 100.0), rel=1e-7)


def test_thin_plates_without_a_solution(spark):
    pairs = spark.createDataFrame([(1, 0.0, 0.0, float(i * 500), float(i * 500), 3.0) for i in range(5)] + [(2, 1.0, 1.0, 0.0, 0.0, 1.0)] + [(3, 100.0, 50.0, float(i % 2 * 1000), float(i // 2 * 1000), 7.0) for i in range(4)], "q long, x double, y double, rx double, ry double, v double")
    got = {r.q: r.predicted for r in I.thin_plate(pairs, ["q"], "v").collect()}
    assert got[1] is None and got[2] is None and got[3] == pytest.approx(7.0)
    assert I.thin_plate(pairs.limit(0), ["q"], "v").count() == 0


def plain_inner(rows, outer, folds):
    sizes = {}
    for r in rows:
        if r[6] != outer:
            sizes[r[5]] = sizes.get(r[5], 0) + 1
    load, out = [0] * folds, {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], g)):
        out[g] = load.index(min(load))
        load[out[g]] += sizes[g]
    return out


def test_nested_priors_equal_plain(spark):
    rows = wells()
    got = {(r.outer, r.id): r.predicted for r in I.nested(frame(spark, rows), "id", "obs_wte_m", "fold", "block", 5, 3, "w").collect()}
    assert len(got) == 3 * len(rows)
    for outer in range(4):
        inner = plain_inner(rows, outer, 3)
        for r in rows:
            if r[6] != outer:
                near = nearest(rows, r, 5, lambda q: q[6] != outer and inner[q[5]] != inner[r[5]])
                assert got[outer, r[0]] == pytest.approx(plain_idw(near), abs=1e-9)


def test_nested_residuals_learn_and_do_not_leak(spark):
    rows = wells(240)
    shape = Shape(bins=8, pair_bins=0, rounds=60, rate=0.2)
    scores = []
    for shift in (0.0, 5e4):
        moved = [(*r[:3], r[3] + shift * (r[6] == 1), *r[4:]) for r in rows]
        out = I.nested_residuals(frame(spark, moved), "id", "fold", "block", ["s"], 6, shape=shape).collect()
        assert len(out) == len(rows)
        scores.append({r.id: (r.prior, r.residual_hat, r.hybrid_wte) for r in out if r.fold == 1})
        if not shift:
            prior = np.mean([abs(r.residual) for r in out])
            hybrid = np.mean([abs(r.residual - r.residual_hat) for r in out])
            assert hybrid < 0.9 * prior and all(r.hybrid_dtw >= 0 for r in out)
    assert scores[0].keys() == scores[1].keys() and all(scores[1][i] == pytest.approx(v, abs=1e-4) for i, v in scores[0].items())


def test_one_group_outside_teaches_itself(spark):
    rows = [(*r[:5], r[6] % 2, r[6] % 2, *r[7:]) for r in wells(40)]
    got = I.nested(frame(spark, rows), "id", "obs_wte_m", "fold", "block", 4, 3).collect()
    at = {r[0]: r[3] for r in rows}
    assert len(got) == len(rows) and all(r.predicted == pytest.approx(at[r.id]) for r in got)


def test_method_names_and_grids():
    for k, p, name in ((16, 2.0, "idw_k16_p2"), (32, 1.5, "idw_k32_p15"), (64, 3.0, "idw_k64_p3")):
        assert I.idw_method(k, p).name == name and I.parsed_method(name) == I.idw_method(k, p)
    assert I.parsed_method("rbf_tps_smooth100") == I.plate_method(100.0) and I.parsed_method("rbf_tps_s25").smoothing == 25
    assert all(I.parsed_method(x) is None for x in ("idw_kx_p2", "idw_k3", "rbf_tps", "kriging", ""))
    assert [m.name for m in I.method_grid()] == ["idw_k16_p2", "idw_k32_p2", "idw_k64_p2", "rbf_tps_s25", "rbf_tps_s100", "rbf_tps_s400"]
    assert [m.name for m in I.method_grid(["nothing"], families=("idw",), ks=(4,), powers=(1.5, 2.0))] == ["idw_k4_p15", "idw_k4_p2"]


def test_methods_share_their_neighbours(spark):
    rows = wells(60)
    df = frame(spark, rows)
    methods = [I.idw_method(3, 1.5), I.idw_method(7, 2.0), I.plate_method(100.0, 8)]
    got = {(r.method, r.id): r.predicted for r in I.crossfit_methods(df, "id", "obs_wte_m", "fold", methods, "w").collect()}
    assert len(got) == 3 * len(rows)
    for m in methods:
        for r in rows:
            near = nearest(rows, r, m.k, lambda q: q[6] != r[6])
            at = {q[0]: q for q in rows}
            want = plain_idw(near, m.power) if m.family == "idw" else plain_plate(r[1] / 1000, r[2] / 1000, [(at[i][1] / 1000, at[i][2] / 1000, v) for _, i, v, _ in near], 100.0)
            assert got[m.name, r[0]] == pytest.approx(want, rel=1e-7)
