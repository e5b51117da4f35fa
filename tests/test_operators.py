"""Exact values and invariants, on inputs small enough to work out by hand."""

import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.functions import binning, hydro, text
from fluvia.operators import et, fields, heads, network, points, raster, solvers, spatial, stats, wells
from fluvia.sources.tables import bind, missing_to_null


def test_inverse_distance_values(spark):
    known = spark.createDataFrame([(1, 0.0, 0.0, 100.0), (2, 10.0, 0.0, 200.0)], "r_id long, rx double, ry double, v double")
    asked = spark.createDataFrame([(1, 0.0, 0.0), (2, 5.0, 0.0), (3, 7.5, 0.0)], "id long, x double, y double")
    near = spatial.nearest_k(asked, known, "id", "r_id", 2, 1.0)
    got = {r.id: r.predicted for r in spatial.inverse_distance(near, "id", "v", 2, 1e-6).collect()}
    assert got[1] == pytest.approx(100, abs=1e-6) and got[2] == pytest.approx(150) and got[3] == pytest.approx(190)


def test_nearest_is_exact_beyond_the_first_ring(spark):
    rng = np.random.default_rng(0)
    a, b = rng.uniform(0, 1000, (80, 2)), np.r_[rng.uniform(0, 50, (40, 2)), rng.uniform(900, 1000, (10, 2))]
    left = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(a)], "id long, x double, y double")
    right = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(b)], "rid long, rx double, ry double")
    got = {}
    for r in spatial.nearest_k(left, right, "id", "rid", 3, 20.0).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.rid
    for i, p in enumerate(a):
        want = np.lexsort((np.arange(len(b)), np.hypot(*(b - p).T)))[:3]
        assert [got[i][k] for k in (1, 2, 3)] == want.tolist()


def test_nearest_with_fewer_or_no_neighbours(spark):
    left = spark.createDataFrame([(1, 0.0, 0.0, "a"), (2, 5.0, 5.0, "b")], "id long, x double, y double, k string")
    right = spark.createDataFrame([(9, 400.0, 0.0, "a")], "rid long, rx double, ry double, k string")
    out = spatial.nearest_k(left, right, "id", "rid", 2, 1.0, on=["k"]).collect()
    assert [(r.id, r.rid, r.distance_m) for r in out] == [(1, 9, 400.0)]
    assert spatial.nearest_k(left, right.where("false"), "id", "rid", 2, 1.0, on=["k"]).count() == 0


def test_out_of_fold_never_uses_its_own_block(spark):
    rows = [(i, 0.0, float(i), 10.0, 0) for i in range(3)] + [(10 + i, 100.0, float(i), 90.0, 1) for i in range(3)]
    q = spark.createDataFrame(rows, "id long, x double, y double, v double, fold int")
    r = q.toDF("rid", "rx", "ry", "rv", "rfold")
    near = spatial.nearest_k(q, r, "id", "rid", 2, 1.0, apart=("fold", "rfold"))
    assert {x.id: round(x.predicted, 6) for x in spatial.inverse_distance(near, "id", "rv").collect()} == {0: 90, 1: 90, 2: 90, 10: 10, 11: 10, 12: 10}


def test_weighted_median_and_trimmed_mean(spark):
    rows = [(1, i, float(v), w) for i, (v, w) in enumerate([(1, 0.2), (2, 0.2), (3, 0.2), (4, 0.4)])] + [(2, 0, 5.0, 1.0)]
    out = {r.g: r for r in stats.weighted_quantiles(spark.createDataFrame(rows, "g long, i long, v double, w double"), ["g"], "v", "w", "i", 0.3).collect()}
    assert out[1].wmedian == 3.0 and out[1].wtrimmed == pytest.approx(2.5)
    assert out[2].wmedian == 5.0 and out[2].wtrimmed == 5.0  # nothing lies within the trimmed range


def test_decay_along_a_chain(spark):
    # 1 -> 2 -> 3, seed on 3, unit lengths, relief 1, scales 2: influence pulled upstream
    rows = spark.createDataFrame([(1, 1.0, 1.0, 0.0, 1), (2, 1.0, 1.0, 0.0, 1), (3, 1.0, 1.0, 1.0, 1)], "stream_id long, length_m double, relief_m double, seed_strength double, strahler int")
    pulls = spark.createDataFrame([(1, 2), (2, 3)], "stream_id long, source_id long")
    out = {r.stream_id: r for r in network.decay_influence(rows, pulls, 2.0, 2.0, 0.0).collect()}
    assert out[3].weight == 1.0 and out[2].weight == pytest.approx(math.exp(-1)) and out[1].weight == pytest.approx(math.exp(-2))
    assert (out[2].dist, out[1].dist, out[1].seed) == (1.0, 2.0, 3)
    cyclic = spark.createDataFrame([(1, 2), (2, 1)], "stream_id long, source_id long")
    assert {r.stream_id: round(r.weight, 4) for r in network.decay_influence(rows, cyclic, 2.0, 2.0, 0.0).collect()}[3] == 1.0


def test_stream_order_of_a_y_network(spark):
    rows = spark.createDataFrame([(1, 3), (2, 3), (3, 5), (4, 5), (5, None), (7, 8), (8, 7)], "stream_id long, down_id long")
    assert {r.stream_id: r.strahler for r in network.stream_order(rows).collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 1, 7: 0, 8: 0}


def test_hops_and_distance(spark):
    edges = spark.createDataFrame([(1, 2, 5.0), (2, 3, 1.0), (1, 3, 10.0), (4, 5, 1.0)], "src long, dst long, w double")
    seeds = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.hops for r in network.hops(edges, seeds).collect()} == {1: 0, 2: 1, 3: 1}
    assert {r.node: r.dist for r in network.network_distance(edges, seeds).collect()} == {1: 0.0, 2: 5.0, 3: 6.0}


def test_dirichlet_is_linear_between_two_anchors(spark):
    rows = [(1, 0, c, 10.0 if c == 0 else 20.0 if c == 10 else None) for c in range(11)] + [(2, 5, c, None) for c in range(3)]
    out = {(r.component, r.c): r.value for r in solvers.dirichlet_surface(spark.createDataFrame(rows, "component long, r long, c long, anchor double")).collect()}
    assert all(out[1, c] == pytest.approx(10 + c, abs=1e-4) for c in range(11)) and out[2, 0] is None


def test_robust_surface_obeys_its_cap_and_shrugs_off_an_outlier(spark):
    rows = [(1, r, c, 500.0 if (r, c) == (2, 2) else 10.0 if (r + c) % 2 == 0 else None, 8.0 if c == 0 else None) for r in range(5) for c in range(5)]
    out = {(r.r, r.c): r.value for r in solvers.robust_surface(spark.createDataFrame(rows, "component long, r long, c long, observed double, cap double")).collect()}
    assert all(out[r, 0] <= 8.05 for r in range(5)) and abs(out[0, 4] - 10) < 3 and out[1, 1] < 60


def test_head_solve_stays_in_its_bounds(spark):
    rows = [(i, i - 1 if i > 1 else None, 100.5 + i, 99.5 + i, 100.0, 0.0, 1.0 if i == 1 else 0.0, 3.0, 5.0) for i in range(1, 30)]
    out = {r.stream_id: r for r in heads.solve_channel_heads(spark.createDataFrame(rows, "stream_id long, down_id long, up_elev_m double, down_elev_m double, length_m double, wetness double, support_fraction double, r_target_m double, r_max_m double")).collect()}
    assert out[1].head_depth_m == 0 and all(0 <= r.h_upper_m - r.channel_head_m <= 5 + 1e-9 for r in out.values())
    assert all(out[i].head_depth_m > 2.5 for i in range(2, 30)) and out[2].n_rounds < 50


def test_donor_year_that_is_missing_gives_nulls_that_are_not_clamped(spark):
    daily = spark.createDataFrame([(1, date(2000, 11, 1), 5.0, 10.0, 1.0), (1, date(2001, 11, 1), 5.0, 10.0, 1.0), (2, date(2000, 11, 1), 4.0, 8.0, 2.0)], "fid long, d date, aet double, eto double, prcp double")
    pairs = spark.createDataFrame([(1, 2), (2, 2)], "fid long, donor_fid long")
    out = {(r.fid, r.water_year): r for r in et.partition_water_years(daily, pairs).collect()}
    assert out[1, 2001].et_gwsm == pytest.approx(2.5) and out[1, 2001].et_irr == pytest.approx(1.5)
    assert out[1, 2002].et_gwsm is None and out[1, 2002].et_irr is None


def test_stratum_without_donor_is_an_error_until_promotion(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, "a", False, 0.5), (2, 1.0, 0.0, "a", False, 0.3), (3, 2.0, 0.0, "non_partitioned", False, 0.1)], "fid long, cx double, cy double, strata string, pattern boolean, irr_freq double")
    with pytest.raises(ValueError):
        et.donors(rows)
    assert {r.fid: r.pattern for r in fields.promote(rows, 1).collect()} == {1: False, 2: True, 3: False}
    assert {r.fid: r.donor_fid for r in et.donors(fields.promote(rows, 1)).collect()} == {1: 2, 2: 2}


def test_monthly_fractions_fill_gaps_with_zero(spark):
    daily = spark.createDataFrame([(1, date(2000, 10, 5), 4.0, 1.0), (1, date(2000, 12, 5), 2.0, 1.0), (1, date(2001, 1, 5), 0.0, 9.0)], "fid long, d date, aet double, prcp double")
    out = {r.month.month: r.fdisag for r in et.monthly_fractions(daily).collect()}
    assert out == {10: 0, 11: 0, 12: 0, 1: 0}  # the year's net demand is negative
    assert {r.month.month: r.fdisag for r in et.monthly_fractions(daily.where("d < '2001-01-01'")).collect()} == {10: 0.75, 11: 0.0, 12: 0.25}


def test_upsert_is_idempotent(spark):
    base = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "r long, c long, value double")
    source = spark.createDataFrame([(0, 0, None), (0, 1, 9.0), (5, 5, 7.0)], "r long, c long, value double")
    foot = spark.createDataFrame([(0, 0), (0, 1)], "r long, c long")
    once = raster.upsert(base, source, foot)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, raster.upsert(once, source, foot).collect())) == [(0, 1, 9.0)]


def test_accumulation_on_a_chain(spark):
    cells = spark.createDataFrame([(0, c) for c in range(9)], "r long, c long")
    down = spark.createDataFrame([(0, c, 0, c + 1) for c in range(8)], "r long, c long, tr long, tc long")
    assert {r.c: r.acc for r in raster.accumulate(cells, down).collect()} == {c: c + 1 for c in range(9)}


def test_expressions(spark):
    one = spark.range(1)
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    row = one.select(
        hydro.water_year(F.to_date(F.lit("2000-10-01"))).alias("wy"),
        binning.left_closed(F.lit(2.0), [0, 2, 5], ["a", "b"]).alias("left"),
        binning.right_closed(F.lit(2.0), [0, 2, 5], ["a", "b"]).alias("right"),
        binning.cell_index(F.lit(25.0), 0.0, 10.0).alias("even"),
        text.iso_date(F.lit("20010229")).alias("bad"),
        text.sanitized(F.lit(" a b//c_ ")).alias("name"),
        spatial.in_polygon(F.lit(2.0), F.lit(3.0), ring).alias("notch"),
        spatial.in_polygon(F.lit(1.0), F.lit(1.0), ring).alias("inside"),
        spatial.segment_crossing(*[F.lit(float(v)) for v in (0, 0, 2, 0, 1, -1, 1, 1)]).alias("t"),
        wells.cleaned(F.lit("nan")).alias("nan"),
    ).first()
    assert (row.wy, row.left, row.right, row.even, row.bad, row.name, row.notch, row.inside, row.t, row.nan) == (2001, "b", "a", 2, None, "a_b_c", False, True, 0.5, None)
    with pytest.raises(Exception, match="not a month"):
        one.select(hydro.season_of(F.lit(13))).collect()


def test_binding_and_missing_values(spark):
    df = missing_to_null(spark.createDataFrame([(1.0,), (float("nan"),)], "v double"))
    assert df.where("v is null").count() == 1
    assert bind(df, ["v"], {"extra": "long"}).columns == ["v", "extra"]
    with pytest.raises(ValueError):
        bind(df, ["absent"], {})


def test_single_donor_is_a_candidate_and_gives_no_estimate(spark):
    rules = points.DonorRules()
    one = spark.createDataFrame([(1, 2000, 7, 0.5, 10.0, 0.1, 0.8)], "point_id long, year int, donor_point_id long, pair_score double, distance_m double, rem_delta double, target_value double")
    out = points.background(points.top_donors(one, 7), rules).first()
    assert out.status == "no_donor" and out.n_donors_used == 1 and out.background_etf_wmedian is None
