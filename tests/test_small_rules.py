"""Priorities, admission and fan-out by hand."""

import ast
from datetime import date
from pathlib import Path

from fluvia.operators import et, points, wells


def test_groups_claim_by_priority(spark):
    rows = spark.createDataFrame([(1, "base"), (1, "riparian"), (2, "zz"), (2, "aa"), (2, "base"), (3, "zz"), (3, "aa"), (4, None)], "k int, sample_group string")
    assert {(r.k, r.sample_group) for r in points.first_by_priority(rows, "k", "sample_group").collect()} == {(1, "riparian"), (2, "base"), (3, "aa"), (4, None)}


def test_wells_are_admitted(spark):
    nan = float("nan")
    rows = [(1, "unconfined", 0.0, -125.0, 24.0), (2, "unconfined_marginal", 999.99, -66.0, 50.0), (3, "confined", 5.0, -100.0, 40.0), (4, "unconfined", 1000.0, -100.0, 40.0), (5, "unconfined", -0.1, -100.0, 40.0), (6, "unconfined", nan, -100.0, 40.0), (7, "unconfined", 5.0, nan, 40.0), (8, "unconfined", 5.0, -150.0, 60.0), (9, "unconfined", None, -100.0, 40.0), (10, None, 5.0, -100.0, 40.0)]
    df = spark.createDataFrame(rows, "id int, confinement_class string, mean_dtw double, longitude double, latitude double")
    assert sorted(r.id for r in wells.admitted(df).collect()) == [1, 2]


def test_wells_in_a_window(spark):
    rows = [(1, 0.0, 0.0, "unconfined", "a", 1.0), (2, 10.0, 5.0, "unknown", "b", 2.0), (3, 10.1, 5.0, "unknown", "b", 2.0), (4, 1.0, 1.0, "confined", "a", 1.0), (5, 1.0, 1.0, "unconfined", "a", None), (6, 1.0, 1.0, "unknown", "c", 3.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double, confinement_class string, source string, dtw double")

    def ids(**sources):
        return sorted(r.id for r in wells.in_window(df, (0, 0, 10, 5), ["unconfined", "unknown"], **sources).collect())

    assert ids() == [1, 2, 6]
    assert ids(exclude=["b"]) == [1, 6]
    assert ids(include=["b"], exclude=["b"]) == [2]


def test_no_function_hides_another_of_its_name():
    for path in Path(wells.__file__).parents[1].rglob("*.py"):
        names = [x.name for x in ast.parse(path.read_text()).body if isinstance(x, ast.FunctionDef | ast.ClassDef)]
        assert len(names) == len(set(names)), path


def test_fields_share_a_grid_points_days(spark):
    fields = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 1.0), (3, 90.0, 90.0), (4, 50.0, 50.0)], "fid int, cx double, cy double")
    grid = spark.createDataFrame([(7, 0.0, 0.0), (8, 100.0, 100.0)], "gfid int, gx double, gy double")
    daily = spark.createDataFrame([(7, date(2000, 1, d), float(d)) for d in range(1, 10)], "gfid int, d date, eto double")
    out = et.daily_by_centroid(fields, grid, daily, "2000-01-03", "2000-01-05").collect()
    assert sorted((r.fid, r.gfid, r.eto) for r in out if r.eto) == [(f, 7, float(d)) for f in (1, 2, 4) for d in (3, 4, 5)]
    assert [(r.fid, r.gfid, r.d) for r in out if r.eto is None] == [(3, 8, None)]
