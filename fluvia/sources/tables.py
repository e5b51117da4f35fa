"""Table scans, and the domain views that project the test tables onto the engine's schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Valid, unchanged, in Spark SQL and DuckDB. Whole numbers are summed before any division.
VIEWS = {
    "fx_points": """SELECT c_custkey AS point_id, CAST((c_custkey*7919)%20011 AS DOUBLE) AS x, CAST((c_custkey*6271)%20011 AS DOUBLE) AS y,
 CAST((c_custkey*37)%150 AS DOUBLE)/10 AS rem_at_sample, CAST((c_custkey*53)%1500 AS DOUBLE) AS dist_perennial_m,
 CAST((c_custkey*71)%2500 AS DOUBLE) AS dist_intermittent_m, CAST((c_custkey*97)%3000 AS DOUBLE) AS dist_managed_m,
 CAST((c_custkey*29)%700 AS DOUBLE) AS dist_field_edge_m, c_mktsegment AS sample_group FROM {customer}""",
    "fx_point_year": """SELECT o_custkey AS point_id, CAST(year(o_orderdate) AS INT) AS year,
 MAX(CASE WHEN o_orderpriority='1-URGENT' THEN 1 ELSE 0 END) AS irr_class,
 CAST(MAX(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE)/500000 AS ndvi_peak_gs,
 CAST(MIN(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE)/500000 AS ndvi_p25_gs,
 CAST(SUM(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE)/1000 AS aet_annual,
 CAST(SUM(CASE WHEN month(o_orderdate) BETWEEN 4 AND 10 THEN CAST(floor(o_totalprice) AS BIGINT) END) AS DOUBLE)/1000 AS aet_gs,
 CAST(400+(o_custkey*11+year(o_orderdate)*7)%400 AS DOUBLE) AS eto_gs, CAST((o_custkey*5+year(o_orderdate)*3)%300 AS DOUBLE) AS pr_annual
 FROM {orders} GROUP BY o_custkey, year(o_orderdate)""",
    "fx_fields": """SELECT s_suppkey AS fid, CAST((s_suppkey*7919)%20011 AS DOUBLE) AS cx, CAST((s_suppkey*6271)%20011 AS DOUBLE) AS cy,
 CAST((s_suppkey*37)%60 AS DOUBLE)/10 AS rem_mean, CAST((s_suppkey*41)%100 AS DOUBLE)/100 AS irr_freq, CAST((s_suppkey*43)%100 AS DOUBLE)/200 AS irr_mean,
 s_nationkey AS nation, CASE (s_suppkey*7)%3 WHEN 0 THEN 'perennial' WHEN 1 THEN 'intermittent' ELSE 'managed' END AS nearest_stream_type FROM {supplier}""",
    "fx_field_daily": """SELECT l_suppkey AS fid, CAST(l_shipdate AS DATE) AS d, CAST(SUM(CAST(floor(l_extendedprice) AS BIGINT)) AS DOUBLE)/10000 AS aet,
 CAST(SUM(CAST(l_quantity AS BIGINT)) AS DOUBLE)/4 AS eto, CAST(SUM(CAST(floor(l_tax*100) AS BIGINT)) AS DOUBLE)/2 AS prcp FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)""",
    "fx_reaches": """SELECT p_partkey+1 AS stream_id, CAST(floor((p_partkey+1)/2) AS BIGINT) AS down_id, CAST(100+p_size*10 AS DOUBLE) AS length_m, CAST((p_partkey*13)%50 AS DOUBLE)/10 AS relief_m,
 CASE WHEN p_partkey%17=0 THEN CAST(p_partkey%10 AS DOUBLE)/10 ELSE CAST(0 AS DOUBLE) END AS seed_strength FROM {part}""",
    "fx_cells": """SELECT CAST(floor(p_partkey/50) AS BIGINT) AS r, p_partkey%50 AS c, p_retailprice AS elev, CASE WHEN p_size>45 THEN 1 ELSE 0 END AS stream FROM {part}""",
    "fx_wells": """SELECT c_custkey AS well_id, CAST((c_custkey*7919)%20011 AS DOUBLE) AS x, CAST((c_custkey*6271)%20011 AS DOUBLE) AS y,
 1+abs(c_acctbal)/100 AS obs_dtw, CAST((floor(((c_custkey*7919)%20011)/5000.0)+floor(((c_custkey*6271)%20011)/5000.0))%4 AS INT) AS fold,
 CASE WHEN c_custkey%5=0 THEN 'confined' WHEN c_custkey%5=1 THEN 'unknown' ELSE 'unconfined' END AS confinement_class FROM {customer}""",
    "fx_stations": """SELECT event_id, user_id AS station, CAST(ts AS TIMESTAMP) AS ts, value AS dtw, event_type AS method FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's scan; columns and filters are pushed into it by the plan that uses it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain view over the test tables."""
    text = VIEWS[name]
    used = [t for t in TABLES if "{" + t + "}" in text]
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in used})


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN of every floating column as NULL, so that no aggregate meets a NaN."""
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def bind(df: DataFrame, required: list[str], optional: dict[str, str]) -> DataFrame:
    """Checks the required columns and adds absent optional ones as typed NULLs, so that plans never branch on a schema."""
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {absent}")
    return df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in optional.items() if c not in df.columns])


def sql_over(views: str, body: str) -> str:
    """DuckDB SQL with the named views in front. `body` is a SELECT, or further CTEs and a SELECT."""
    named = [f"{v} AS ({VIEWS[v].format(**{t: t for t in TABLES})})" for v in views.split()]
    body = body.strip()
    if not named:
        return body if body.upper().startswith("SELECT") else "WITH RECURSIVE " + body
    return "WITH RECURSIVE " + ", ".join(named) + (" " if body.upper().startswith("SELECT") else ", ") + body
