"""Every query of the library proper against its SQL, over whole tables of the smallest scale."""

import math

import duckdb
import pytest

from fluvia.plans import registry
from fluvia.sources.tables import TABLES, view

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    rel = duck.sql(registry.oracle_sql()[name])
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_flagship_has_rows(spark):
    assert registry.flagship(spark, SF).count() > 0


def test_every_reach_has_stations(spark):
    sf_dir = "/root/testdata/sf0.01"
    reaches = view(spark, sf_dir, "fx_reaches")
    got = registry.queries()["stations"](spark, sf_dir)
    assert got.select("stream_id").distinct().count() == reaches.count() > 300
    assert got.count() == reaches.selectExpr("sum(floor(length_m / 60) + 1 + cast(length_m > floor(length_m / 60) * 60 as int)) AS n").first().n


def test_all_observations_of_a_field_are_averaged(spark):
    seen = view(spark, SF, "fx_point_year").selectExpr("point_id % 100 AS fid", "irr_class").toPandas().groupby("fid").irr_class.mean()
    for r in registry.queries()["field_irrigation_join"](spark, SF).collect():
        assert (r.irr_obs is None) == (r.fid not in seen.index) and (r.irr_obs is None or abs(r.irr_obs - seen[r.fid]) < 1e-5)
