"""Queries on fields and flowlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.operators import fields
from fluvia.plans.evapotranspiration import _FIELDS, prepared_fields
from fluvia.plans.registry import query
from fluvia.sources.tables import table, view

#: Synthetic codes for parts, so that each class and an unmapped code occur.
_CODE = "CASE p_size % 9 WHEN 0 THEN 46006 WHEN 1 THEN 46003 WHEN 2 THEN 33600 WHEN 3 THEN 55800 WHEN 4 THEN 42801 WHEN 5 THEN 46800 WHEN 6 THEN 33400 WHEN 7 THEN 33601 ELSE 99999 END"
_KIND = "CASE p_partkey % 4 WHEN 0 THEN 'StreamRiver' WHEN 1 THEN 'ArtificialPath' WHEN 2 THEN 'CanalDitch' END"


@query("fx_fields fx_field_daily", _FIELDS + " SELECT fid, rem_mean < 2 AS partitioned, strata, pattern FROM fl")
def field_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared_fields(spark, sf_dir).select("fid", "partitioned", "strata", "pattern")


@query("fx_fields", "SELECT fid, irr_freq <= 0.3 AND irr_mean * 0.99 <= 0.4 AS pattern, CASE WHEN irr_freq <= 0.3 AND irr_mean * 0.99 <= 0.4 THEN printf('freq=%.2f; mean=%.2f', irr_freq, irr_mean * 0.99) ELSE '' END AS pattern_evidence FROM fx_fields")
def pattern_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.pattern_candidates(view(spark, sf_dir, "fx_fields").withColumn("irr_mean", F.col("irr_mean") * 0.99), 0.3, 0.4).select("fid", "pattern", "pattern_evidence")


@query(
    "",
    f"""cd AS (SELECT p_partkey, p_size, {_CODE} AS code FROM part),
    ty AS (SELECT *, CASE WHEN code IN (46006, 55800) THEN 'perennial' WHEN code IN (46000, 46003, 46007) THEN 'intermittent' WHEN code IN (33400, 33600, 33601, 33602, 33603, 46800) THEN 'managed' END AS stream_type FROM cd)
    SELECT stream_type, count(*) AS n, CAST(sum(p_size) AS BIGINT) AS total_size FROM ty WHERE stream_type IS NOT NULL AND code NOT IN (33601, 46007) GROUP BY 1""",
)
def flowline_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes mapped to stream types, unmapped and excluded codes dropped, and the classes counted."""
    coded = table(spark, sf_dir, "part").select("p_size", F.expr(_CODE).alias("code"))
    typed = coded.where(~F.col("code").isin(fields.CODES_WITHOUT_SURFACE)).withColumn("stream_type", fields.map_codes(F.col("code"), fields.STREAM_TYPE_OF_CODE)).where("stream_type is not null")
    return typed.groupBy("stream_type").agg(F.count("*").alias("n"), F.sum("p_size").alias("total_size"))


@query(
    "",
    f"""cd AS (SELECT p_partkey, {_CODE} AS code, {_KIND} AS kind FROM part)
    SELECT p_partkey, 'code' AS rule FROM cd WHERE code = 46006 UNION ALL SELECT p_partkey, 'type' FROM cd WHERE kind = 'StreamRiver'
    UNION ALL SELECT p_partkey, 'no_artificial' FROM cd WHERE kind IS NULL OR kind = 'StreamRiver' UNION ALL SELECT p_partkey, 'both' FROM cd WHERE code = 46006 AND (kind IS NULL OR kind = 'StreamRiver')""",
)
def flowline_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flowlines kept under each rule: by code, by type where there is no code, without artificial ones, and both."""
    lines = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CODE).alias("code"), F.expr(_KIND).alias("kind"))
    kept = {
        "code": fields.filter_flowlines(lines, "code", "kind", natural_perennial=True),
        "type": fields.filter_flowlines(lines, None, "kind", natural_perennial=True),
        "no_artificial": fields.filter_flowlines(lines, "code", "kind", exclude_artificial=True),
        "both": fields.filter_flowlines(lines, "code", "kind", natural_perennial=True, exclude_artificial=True),
    }
    parts = [rows.select("p_partkey", F.lit(rule).alias("rule")) for rule, rows in kept.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_WIDE = "SELECT point_id, " + ", ".join(f"max(CASE WHEN year = {y} THEN CAST(irr_class AS DOUBLE) END) AS irr_{y}" for y in range(1995, 2002)) + " FROM fx_point_year GROUP BY point_id"


def wide_irrigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column per year, as the exports come."""
    rows = view(spark, sf_dir, "fx_point_year")
    return rows.groupBy("point_id").agg(*[F.max(F.when(F.col("year") == y, F.col("irr_class").cast("double"))).alias(f"irr_{y}") for y in range(1995, 2002)])


@query(
    "fx_point_year",
    f"""wd AS ({_WIDE}), lg AS (SELECT point_id, unnest([irr_1995, irr_1996, irr_1997, irr_1998, irr_1999, irr_2000, irr_2001]) AS v FROM wd)
    SELECT point_id, round(avg(v), 6) AS irr_mean, count(*) FILTER (WHERE v > 0.1) AS n_irr_years, count(*) AS n_years, round(count(*) FILTER (WHERE v > 0.1) / count(*), 6) AS irr_freq FROM lg GROUP BY point_id""",
)
def irrigation_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fields.irrigation_stats(wide_irrigation(spark, sf_dir), "point_id")
    return out.withColumns({"irr_mean": F.round("irr_mean", 6), "irr_freq": F.round("irr_freq", 6)})


@query(
    "fx_fields fx_point_year",
    """s AS (SELECT point_id % 100 AS fid, avg(irr_class) AS m FROM fx_point_year GROUP BY 1)
    SELECT f.fid, round(s.m, 6) AS irr_obs, coalesce(s.m <= 0.2, false) AS pattern FROM fx_fields f LEFT JOIN s USING (fid)""",
)
def field_irrigation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields with all their observed irrigation."""
    return _irrigated(view(spark, sf_dir, "fx_fields"), view(spark, sf_dir, "fx_point_year"))


def _irrigated(all_fields: DataFrame, observed: DataFrame) -> DataFrame:
    """Fields with observed irrigation; a field without any is not a pattern field."""
    stats = observed.groupBy((F.col("point_id") % 100).alias("fid")).agg(F.avg("irr_class").alias("m"))
    joined = all_fields.join(stats, "fid", "left")
    return joined.select("fid", F.round("m", 6).alias("irr_obs"), F.coalesce(F.col("m") <= 0.2, F.lit(False)).alias("pattern"))


@query("fx_fields", "SELECT CASE WHEN rem_mean < 2 THEN nearest_stream_type ELSE 'non_partitioned' END AS strata, count(*) AS n FROM fx_fields GROUP BY 1")
def strata_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.stratify(view(spark, sf_dir, "fx_fields")).groupBy("strata").agg(F.count("*").alias("n"))
