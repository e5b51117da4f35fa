"""Queries on evapotranspiration and climate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.functions import hydro
from fluvia.operators import et, fields
from fluvia.plans.registry import query
from fluvia.sources.tables import table, view


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def prepared_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fields.promote(fields.pattern_candidates(fields.stratify(view(spark, sf_dir, "fx_fields"))), 1)


_FIELDS = """
st AS (SELECT *, CASE WHEN rem_mean >= 2 OR rem_mean IS NULL THEN 'non_partitioned' ELSE nearest_stream_type END AS strata,
  coalesce(irr_freq <= 0.1 AND irr_mean <= 0.05, false) AS cand FROM fx_fields),
need AS (SELECT strata, greatest(1 - count(*) FILTER (WHERE cand), 0) AS k FROM st GROUP BY strata),
rk AS (SELECT fid, row_number() OVER (PARTITION BY strata ORDER BY irr_freq, fid) AS i FROM st WHERE NOT cand),
fl AS (SELECT st.*, cand OR (st.strata <> 'non_partitioned' AND coalesce(rk.i <= need.k, false)) AS pattern FROM st JOIN need USING (strata) LEFT JOIN rk USING (fid)),
dn AS (SELECT fid, donor_fid FROM (SELECT a.fid, b.fid AS donor_fid, row_number() OVER (PARTITION BY a.fid ORDER BY sqrt((a.cx-b.cx)*(a.cx-b.cx)+(a.cy-b.cy)*(a.cy-b.cy)), b.fid) AS i
  FROM fl a JOIN fl b ON a.strata = b.strata AND b.pattern WHERE a.strata <> 'non_partitioned') WHERE i = 1),
an AS (SELECT fid, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INT) AS water_year, sum(aet) AS aet, sum(eto) AS eto, sum(prcp) AS prcp, least(sum(prcp), sum(aet)) AS pe FROM fx_field_daily GROUP BY 1, 2),
pt AS (SELECT a.fid, a.water_year, dn.donor_fid, a.aet, a.eto, a.pe, (o.aet - o.pe) / nullif(o.eto, 0) * a.eto AS g, a.aet - (o.aet - o.pe) / nullif(o.eto, 0) * a.eto - a.pe AS i
  FROM an a JOIN dn USING (fid) LEFT JOIN an o ON o.fid = dn.donor_fid AND o.water_year = a.water_year),
fin AS (SELECT fid, water_year, donor_fid, aet, eto, pe, CASE WHEN i < 0 THEN aet - pe ELSE g END AS et_gwsm, CASE WHEN i < 0 THEN 0 ELSE i END AS et_irr FROM pt)"""

_FRACTIONS = """
dl AS (SELECT fid, d, aet - prcp AS net FROM fx_field_daily),
sp AS (SELECT fid, CAST(unnest(generate_series(min(date_trunc('month', d)), max(date_trunc('month', d)), INTERVAL 1 MONTH)) AS DATE) AS month FROM dl GROUP BY fid),
mm AS (SELECT fid, CAST(date_trunc('month', d) AS DATE) AS month, sum(net) AS m FROM dl GROUP BY 1, 2),
yy AS (SELECT fid, CAST(year(d) + CASE WHEN month(d) >= 10 THEN 1 ELSE 0 END AS INT) AS water_year, sum(net) AS y FROM dl GROUP BY 1, 2),
fr AS (SELECT sp.fid, sp.month, CAST(year(sp.month) + CASE WHEN month(sp.month) >= 10 THEN 1 ELSE 0 END AS INT) AS water_year, greatest(coalesce(m, 0), 0) AS m FROM sp LEFT JOIN mm USING (fid, month)),
fd AS (SELECT fr.fid, fr.month, fr.water_year, CASE WHEN coalesce(y, 0) > 0 THEN m / y ELSE 0 END AS fdisag FROM fr LEFT JOIN yy USING (fid, water_year))"""


@query("fx_fields fx_field_daily", _FIELDS + " SELECT fid, water_year, donor_fid, round(aet, 6) AS aet, round(eto, 6) AS eto, round(pe, 6) AS pe, round(et_gwsm, 6) AS et_gwsm, round(et_irr, 6) AS et_irr, round(et_gwsm / nullif(eto, 0), 6) AS etf_used FROM fin")
def et_partition_water_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = et.donors(prepared_fields(spark, sf_dir))
    out = et.partition_water_years(view(spark, sf_dir, "fx_field_daily"), pairs)
    return _rounded(out, "aet", "eto", "pe", "et_gwsm", "et_irr", "etf_used")


@query("fx_field_daily", _FRACTIONS + " SELECT fid, month, water_year, round(fdisag, 6) AS fdisag FROM fd")
def et_monthly_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(et.monthly_fractions(view(spark, sf_dir, "fx_field_daily")), "fdisag")


@query("fx_fields fx_field_daily", _FIELDS + "," + _FRACTIONS + " SELECT month, water_year, fid, donor_fid, round(fdisag, 6) AS fdisag, round(fdisag * et_gwsm, 6) AS et_gwsm_m, round(fdisag * et_irr, 6) AS et_irr_m FROM fd JOIN fin USING (fid, water_year)")
def et_partition_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = et.donors(prepared_fields(spark, sf_dir))
    return _rounded(et.partition_months(view(spark, sf_dir, "fx_field_daily"), pairs), "fdisag", "et_gwsm_m", "et_irr_m")


@query(
    "fx_field_daily",
    """mo AS (SELECT fid, year(d) AS y, month(d) AS m, sum(aet) AS total FROM fx_field_daily GROUP BY 1, 2, 3)
    SELECT f.fid, f.d, CAST(year(f.d) AS INT) AS year, CAST(month(f.d) AS INT) AS month, f.eto, f.prcp, round(total / day(last_day(f.d)), 6) AS aet
    FROM fx_field_daily f LEFT JOIN mo ON mo.fid = f.fid AND mo.y = year(f.d) AND mo.m = month(f.d)""",
)
def et_monthly_to_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = view(spark, sf_dir, "fx_field_daily")
    monthly = daily.groupBy("fid", F.year("d").alias("year"), F.month("d").alias("month")).agg(F.sum("aet").alias("total"))
    return _rounded(et.spread_months(daily, monthly), "aet").select("fid", "d", "year", "month", "eto", "prcp", "aet")


@query(
    "fx_field_daily",
    """yr AS (SELECT fid, year(d) AS y, sum(prcp) AS p, sum(eto) AS e, count(prcp) AS n, count(*) AS a FROM fx_field_daily GROUP BY 1, 2)
    SELECT fid, count(*) AS n_years, round(avg(p), 6) AS p_mean, round(avg(e), 6) AS pet_mean, round(CASE WHEN avg(e) > 0 THEN avg(p) / avg(e) END, 6) AS aridity FROM yr GROUP BY fid""",
)
def aridity_climatology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual totals, their mean over years, and P / PET; a field whose gaps vary between days is an error."""
    guard = F.count("prcp")
    yearly = view(spark, sf_dir, "fx_field_daily").groupBy("fid", F.year("d").alias("y")).agg(F.sum("prcp").alias("p"), F.sum("eto").alias("e"), F.when(guard.isin(0) | (guard == F.count("*")), True).otherwise(F.raise_error(F.lit("gaps vary by day"))).alias("ok")).where("ok")
    means = yearly.groupBy("fid").agg(F.count("*").alias("n_years"), F.avg("p").alias("p_mean"), F.avg("e").alias("pet_mean"))
    return _rounded(means.withColumn("aridity", hydro.ratio_or_null(F.col("p_mean"), F.col("pet_mean"))), "p_mean", "pet_mean", "aridity")


@query(
    "fx_field_daily",
    "SELECT fid, round(avg(eto) * 365.25, 10) AS flux_annual, round(avg(aet), 10) AS state_mean, round(avg(CASE WHEN month(d) IN (12, 1, 2) THEN aet END), 10) AS djf, round(avg(CASE WHEN month(d) IN (3, 4, 5) THEN aet END), 10) AS mam, round(avg(CASE WHEN month(d) IN (6, 7, 8) THEN aet END), 10) AS jja, round(avg(CASE WHEN month(d) IN (9, 10, 11) THEN aet END), 10) AS son FROM fx_field_daily GROUP BY fid",
)
def seasonal_normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean flux per year, mean state, and seasonal means, null where a season was never seen."""
    daily = view(spark, sf_dir, "fx_field_daily").withColumn("season", hydro.season_of(F.month("d")))
    seasons = [F.round(F.avg(F.when(F.col("season") == s, F.col("aet"))), 10).alias(s.lower()) for s in ("DJF", "MAM", "JJA", "SON")]
    return daily.groupBy("fid").agg(F.round(F.avg("eto") * 365.25, 10).alias("flux_annual"), F.round(F.avg("aet"), 10).alias("state_mean"), *seasons)


@query(
    "fx_points",
    """SELECT point_id, round(101.3 * pow((293.0 - 0.0065 * (rem_at_sample * 100)) / 293.0, 5.26), 6) AS pressure, round(101.3 * pow((293.0 - 0.0065 * (rem_at_sample * 100)) / 293.0, 9.8 / (0.0065 * 286.9)), 6) AS pressure_gas,
    round(101.3 * pow((293.0 - 0.0065 * (rem_at_sample * 100)) / 293.0, 5.26) * 0.008 / (0.622 + 0.378 * 0.008), 6) AS vapour, round(270 + rem_at_sample - 273.15, 6) AS celsius FROM fx_points""",
)
def climate_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = view(spark, sf_dir, "fx_points")
    elevation = F.col("rem_at_sample") * 100
    p = hydro.air_pressure(elevation)
    return points.select("point_id", F.round(p, 6).alias("pressure"), F.round(hydro.air_pressure(elevation, "gas"), 6).alias("pressure_gas"), F.round(hydro.vapour_pressure(p, F.lit(0.008)), 6).alias("vapour"), F.round(hydro.kelvin_to_celsius(270 + F.col("rem_at_sample")), 6).alias("celsius"))


@query(
    "fx_fields fx_field_daily",
    """g AS (SELECT n_nationkey AS gfid, (n_nationkey % 5) * 4200.0 AS gx, CAST(floor(n_nationkey / 5) AS BIGINT) * 4200.0 AS gy FROM nation),
    n AS (SELECT fid, gfid, sqrt((cx - gx) * (cx - gx) + (cy - gy) * (cy - gy)) AS d FROM fx_fields, g QUALIFY row_number() OVER (PARTITION BY fid ORDER BY sqrt((cx - gx) * (cx - gx) + (cy - gy) * (cy - gy)), gfid) = 1),
    c AS (SELECT fid % 25 AS gfid, d, sum(eto) AS eto, sum(prcp) AS prcp FROM fx_field_daily WHERE d BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' GROUP BY 1, 2)
    SELECT n.fid, n.gfid, round(n.d, 6) AS distance_m, c.d, c.eto, c.prcp FROM n LEFT JOIN c ON c.gfid = n.gfid""",
)
def climate_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field's daily climate from the nearest point of a shared grid."""
    k = F.col("n_nationkey")
    grid = table(spark, sf_dir, "nation").select(k.alias("gfid"), ((k % 5) * 4200.0).alias("gx"), (F.floor(k / 5) * 4200.0).alias("gy"))
    daily = view(spark, sf_dir, "fx_field_daily").groupBy((F.col("fid") % 25).alias("gfid"), "d").agg(F.sum("eto").alias("eto"), F.sum("prcp").alias("prcp"))
    return et.daily_by_centroid(view(spark, sf_dir, "fx_fields"), grid, daily, "1994-01-01", "1995-12-31").withColumn("distance_m", F.round("distance_m", 6))
