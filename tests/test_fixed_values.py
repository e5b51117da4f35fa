"""Values and rules that domain tables are judged by, case by case."""

import math

import pytest
from pyspark.sql import functions as F

from fluvia.functions import text
from fluvia.operators import fields, points, wells


def of(spark, rows, schema, **columns):
    return spark.createDataFrame(rows, schema).select("*", *[v.alias(k) for k, v in columns.items()]).collect()


def test_stream_types_of_codes(spark):
    wanted = {46006: "perennial", 55800: "perennial", 46000: "intermittent", 46003: "intermittent", 46007: "intermittent", 33400: "managed", 33600: "managed", 33601: "managed", 33602: "managed", 33603: "managed", 46800: "managed"}
    wanted |= dict.fromkeys([42000, 42001, 42003, 42800, 42801, 42802, 42803, 42805, 42807, 42809, 42810, 42811, 42813, 42816, 1, None])
    for r in of(spark, [(c,) for c in wanted], "code int", t=fields.map_codes(F.col("code"), fields.STREAM_TYPE_OF_CODE)):
        assert r.t == wanted[r.code], r.code


def test_flowline_rules(spark):
    rows = spark.createDataFrame([(1, 46006, "StreamRiver"), (2, 46003, "STREAMRIVER"), (3, 46006, "ArtificialPath"), (4, None, "CanalDitch"), (5, 33600, None), (6, 46003, "Upstreamriver")], "id int, code int, kind string")

    def kept(*names, **rules):
        return sorted(r.id for r in fields.filter_flowlines(rows, *names, **rules).collect())

    assert kept("code", "kind", natural_perennial=True) == [1, 3]
    assert kept(None, "kind", natural_perennial=True) == [1, 2]
    assert kept("code", "kind", exclude_artificial=True) == [1, 2, 5, 6]
    assert kept("code", None, exclude_artificial=True) == kept("code", "kind") == [1, 2, 3, 4, 5, 6]


def test_wetland_codes(spark):
    wanted = {"PEM1C": True, "PFO1A": False, "PSS1Ah": True, "PAB4F": True, "PUBHh/EM1A": False, "PUBHx": False, "PUBFd": False, "L1UBH": True, "L2USK": False, "R2UBH": True, "R3UBH": True, "R4SBC": False, "R5UBH": False, "E2EM1P": False, "PUSC": False, "PEM1J ": False, "": False, None: False}
    for r in of(spark, [(c,) for c in wanted], "code string", kept=text.persistent_wetland(F.col("code"))):
        assert r.kept == wanted[r.code], r.code


def test_head_uncertainty(spark):
    rows = [("spring", None, 0.5), ("open_water", "Lake", 1.5), ("wetland", "PEM1C", 2.5), ("spring", "NHDArea_460", 2.0), ("open_water", "Reservoir", 3.0), ("wetland", "managed playa", 4.0), ("open_water", "NHDArea_Reservoir", 3.5)]
    for r in of(spark, rows, "cls string, label string, want double", got=text.head_uncertainty(F.col("cls"), F.col("label"))):
        assert r.got == r.want, r


def test_granule_names(spark):
    one = spark.range(1)
    row = one.select(text.granule_part(F.lit("MOD13Q1.A2015209.h10v04.061"), "platform"), text.granule_part(F.lit("MYD13Q1.A2015209.h10v04.061"), "platform"), text.granule_part(F.lit("MOD13Q1.A2015209.h10v04.061"), "tile")).first()
    assert tuple(row) == ("terra", "aqua", "h10v04")
    for name, part in (("MCD43A4.A2015209.h10v04.061", "platform"), ("MOD13Q1.A2015209.061", "tile")):
        with pytest.raises(Exception, match="no (product token|tile)"):
            one.select(text.granule_part(F.lit(name), part)).collect()


WELL = {"value": 5.0, "suspect": False, "confinement_class": None, "well_depth": None, "screen_top": None, "override_class": None, "h_accuracy_class": "map", "has_time_series": False}
TIERS = [
    ({}, "secondary", 0.25, ""),
    ({"value": None}, "diagnostic", 0.0, "no_usable_dtw"),
    ({"suspect": True}, "diagnostic", 0.0, "no_usable_dtw"),
    ({"confinement_class": "artesian"}, "diagnostic", 0.0, "confined_aquifer"),
    ({"confinement_class": "likely_confined"}, "diagnostic", 0.0, "confined_aquifer"),
    ({"value": -1.5}, "diagnostic", 0.0, "artesian_above_surface"),
    ({"value": -1.0}, "secondary", 0.25, ""),
    ({"value": 50.0, "well_depth": 40.0}, "diagnostic", 0.0, "dtw_below_well_bottom"),
    ({"value": 50.0, "well_depth": 6000.0}, "secondary", 0.25, ""),
    ({"value": 4000.0, "well_depth": 4500.0, "confinement_class": "unconfined"}, "primary", 0.6, ""),
    ({"value": 61.0}, "diagnostic", 0.0, "deep_water_nonphreatic"),
    ({"value": 61.0, "confinement_class": "unconfined_marginal"}, "primary", 0.6, ""),
    ({"value": 61.0, "confinement_class": "likely_unconfined"}, "diagnostic", 0.0, "deep_water_nonphreatic"),
    ({"screen_top": 60.5}, "diagnostic", 0.0, "deep_screen_nonphreatic"),
    ({"override_class": "pumping"}, "diagnostic", 0.0, "pumping_well"),
    ({"h_accuracy_class": "plss"}, "diagnostic", 0.0, "poor_location"),
    ({"h_accuracy_class": "unknown"}, "diagnostic", 0.0, "poor_location"),
    ({"h_accuracy_class": None}, "diagnostic", 0.0, "poor_location"),
    ({"h_accuracy_class": "survey_gps", "override_class": "monitoring", "has_time_series": True}, "primary", 1.0, ""),
    ({"h_accuracy_class": "gps", "override_class": "monitoring"}, "primary", 0.6, ""),
    ({"well_depth": 30.0}, "primary", 0.6, ""),
    ({"well_depth": 30.5, "confinement_class": "unknown"}, "secondary", 0.25, ""),
    ({"has_time_series": True, "confinement_class": "likely_unconfined"}, "primary", 0.6, ""),
]


def test_well_tiers(spark):
    schema = "i int, value double, suspect boolean, confinement_class string, well_depth double, screen_top double, override_class string, h_accuracy_class string, has_time_series boolean"
    rows = [(i, *(WELL | change).values()) for i, (change, *_) in enumerate(TIERS)]
    for r in of(spark, rows, schema, t=wells.tier()):
        assert (r.t.tier, r.t.weight, r.t.exclusion_reason) == TIERS[r.i][1:], TIERS[r.i]


def test_sane_depths_and_seasons(spark):
    label = F.struct(F.col("v").alias("value"), F.lit("static_manual").alias("kind"), F.lit("2020").alias("period"))
    assert {r.v: r.s for r in of(spark, [(-10.0,), (-10.5,), (500.0,), (501.0,), (None,)], "v double", s=wells.suspect(label))} == {-10.0: False, -10.5: True, 500.0: False, 501.0: True, None: True}
    rows = [(1, m, f"2020-{m:02d}-15", float(m)) for m in range(1, 13)]
    readings = spark.createDataFrame(rows, "station int, event_id int, ts string, dtw double").withColumn("ts", F.to_timestamp("ts")).withColumn("method", F.lit("manual"))
    out = wells.series_labels(readings).first()
    assert out.dtw_spring_median == 5.0 and out.dtw_fall_median == 9.5


def test_the_best_located_record_stands_for_a_well(spark):
    rows = [(1, i, "s", a, "unconfined", None, None, None, None, False, True) for i, a in enumerate([None, "unknown", "plss", "map", "gps", "survey_gps"])]
    schema = "canonical_id int, source_well_id int, source string, h_accuracy_class string, confinement_class string, well_class string, well_use string, well_depth double, screen_top double, has_time_series boolean, is_static_only boolean"
    for n, best in ((6, "survey_gps"), (5, "gps"), (4, "map"), (3, "plss")):
        assert wells.collapse(spark.createDataFrame(rows[:n], schema)).first().h_accuracy_class == best


def test_stream_settings_and_bins(spark):
    rows = [(500.0, 500.0, 1000.0, "managed_corridor"), (500.5, 500.0, 1000.0, "perennial_corridor"), (501.0, 501.0, 1000.0, "intermittent_corridor"), (501.0, 501.0, 1000.5, "off_corridor")]
    for r in of(spark, rows, "dist_managed_m double, dist_perennial_m double, dist_intermittent_m double, want string", got=points.hydro_class()):
        assert r.got == r.want
    bins = {0.0: "0-1 m", 1.0: "1-2 m", 2.0: "2-5 m", 5.0: "5-10 m", 10.0: ">10 m", 9.99: "5-10 m", -0.1: "nan", None: "nan"}
    for r in of(spark, [(v,) for v in bins], "v double", b=points.rem_bin(F.col("v"))):
        assert r.b == bins[r.v]


DONOR = {"feature_valid": True, "etf": 0.5, "valid_years": 10, "eto_gs": 500.0, "irr_class": 0.1, "irr_freq": 0.15, "irr_frac_std": 0.3, "dist_field_edge_m": 100.0}
EXCLUDED = [({}, None), ({"feature_valid": False}, "data_sufficiency"), ({"etf": None}, "data_sufficiency"), ({"valid_years": 9}, "data_sufficiency"), ({"eto_gs": 0.0}, "data_sufficiency"), ({"irr_class": 0.11}, "year_irrigated"), ({"irr_class": None}, "year_irrigated"), ({"irr_freq": 0.16}, "purity"), ({"irr_frac_std": 0.31}, "purity"), ({"irr_frac_std": None}, "purity"), ({"dist_field_edge_m": 99.0}, "field_edge"), ({"dist_field_edge_m": None}, "field_edge")]


def test_donor_filters(spark):
    rows = [(i, *(DONOR | change).values()) for i, (change, _) in enumerate(EXCLUDED)]
    schema = "i int, feature_valid boolean, etf double, valid_years int, eto_gs double, irr_class double, irr_freq double, irr_frac_std double, dist_field_edge_m double"
    for r in of(spark, rows, schema, reason=points.exclusion_reason(points.DonorRules())):
        assert r.reason == EXCLUDED[r.i][1], EXCLUDED[r.i]


def test_donor_scores_and_confidence(spark):
    rules = points.DonorRules()
    assert (rules.top_k, rules.least_donors, rules.radius_m, rules.rem_tolerance_m) == (7, 3, 10_000.0, 2.0)
    schema = "point_id long, year int, x double, y double, rem_at_sample double, rem_bin string, hydro_analog string, ndvi_peak_gs double, ndvi_amp_gs double, irr_freq double, etf_std double, ndvi_amp_std double, etf double"
    one = spark.createDataFrame([(1, 2000, 0.0, 0.0, 1.5, "1-2 m", "off_corridor", 0.6, 0.3, 0.9, 0.1, 0.1, 0.7)], schema)
    other = spark.createDataFrame([(2, 2000, 300.0, 400.0, 1.0, "1-2 m", "off_corridor", 0.5, 0.25, 0.1, 0.03, 0.04, 0.4), (3, 2000, 0.0, 10_001.0, 1.0, "1-2 m", "off_corridor", 0.5, 0.25, 0.1, 0.03, 0.04, 0.4)], schema)
    (pair,) = points.donor_pairs(one, other, rules).collect()
    want = math.exp(-0.5) * math.exp(-500 / 3000) * math.exp(-(0.1 / 0.15 + 0.05 / 0.10)) * 0.9**2 * math.exp(-(0.03 / 0.15 + 0.04 / 0.08))
    assert pair.donor_point_id == 2 and pair.pair_score == pytest.approx(want)
    top = [(1, 2000, i, s, 10.0, 0.1, v) for i, (s, v) in enumerate([(2.2, 0.5), (1.0, 0.5), (1.0, 0.9)])]
    out = points.background(points.top_donors(spark.createDataFrame(top, "point_id long, year int, donor_point_id long, pair_score double, distance_m double, rem_delta double, target_value double"), 7), rules).first()
    assert out.status == "low_confidence"
    assert out.confidence_flag == "dominant_donor"  # 2.2 of 4.2; 2.58 donors; both estimates are 0.5, for 0.9 is trimmed


def test_sample_masks(spark):
    rows = [(1, 2.0, 250.0, "perennial", 60.0), (2, 1.99, 251.0, "managed", 61.0), (3, 5.0, 1.0, "ditch", 0.0), (4, 5.01, 1.0, None, None), (5, None, 1.0, "perennial", 1.0), (6, float("inf"), 1.0, "perennial", 1.0)]
    out = {r.point_id: (r.is_low_rem_target, r.is_riparian_target, r.is_field_edge_target, r.is_high_rem_control) for r in points.sample_masks(spark.createDataFrame(rows, "point_id int, rem_at_sample double, stream_distance double, nearest_stream_type string, dist_field_edge_m double")).collect()}
    assert out == {1: (False, True, True, False), 2: (True, False, False, False), 3: (False, False, True, False), 4: (False, False, False, True), 5: (False,) * 4, 6: (False,) * 4}


def test_nearest_stream_skips_unknown_distances(spark):
    rows = [(1, None, 5.0, 3.0), (2, 4.0, 4.0, 9.0), (3, None, None, None)]
    out = {r.i: (r.nearest_stream_type, r.stream_distance) for r in points.nearest_stream(spark.createDataFrame(rows, "i int, dist_perennial_m double, dist_intermittent_m double, dist_managed_m double")).collect()}
    assert out == {1: ("managed", 3.0), 2: ("perennial", 4.0), 3: (None, None)}
