"""Queries on points, point years and donors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.operators import points
from fluvia.operators.stats import standard_scores
from fluvia.plans.registry import query
from fluvia.sources.tables import table, view

RULES = points.DonorRules(min_valid_years=3, radius_m=4000.0)

_YEARS = """
py AS (SELECT *, greatest(ndvi_peak_gs - ndvi_p25_gs, 0) AS ndvi_amp_gs, CASE WHEN eto_gs > 0 THEN aet_gs / eto_gs END AS etf, aet_annual - pr_annual AS net_et, aet_gs IS NOT NULL AS et_valid FROM fx_point_year),
su AS (SELECT point_id, count(*) AS n_years, count(*) FILTER (WHERE et_valid) AS valid_years, avg(irr_class) AS irr_freq, stddev_samp(irr_class) AS irr_frac_std, count(*) FILTER (WHERE irr_class >= 0.5) AS n_irr_years,
  avg(aet_gs) AS aet_mean, stddev_samp(aet_gs) AS aet_std, avg(CASE WHEN et_valid THEN eto_gs END) AS eto_gs_mean, avg(CASE WHEN et_valid THEN pr_annual END) AS prcp_mean, avg(CASE WHEN et_valid THEN etf END) AS etf_mean,
  stddev_samp(CASE WHEN et_valid THEN etf END) AS etf_std, avg(CASE WHEN et_valid THEN net_et END) AS net_et_mean, avg(ndvi_amp_gs) AS ndvi_amp_mean, avg(ndvi_peak_gs) AS ndvi_peak_mean, stddev_samp(ndvi_amp_gs) AS ndvi_amp_std FROM py GROUP BY point_id),
bn AS (SELECT *, CASE WHEN rem_at_sample < 0 THEN 'nan' WHEN rem_at_sample < 1 THEN '0-1 m' WHEN rem_at_sample < 2 THEN '1-2 m' WHEN rem_at_sample < 5 THEN '2-5 m' WHEN rem_at_sample < 10 THEN '5-10 m' ELSE '>10 m' END AS rem_bin,
  CASE WHEN dist_managed_m <= 500 THEN 'managed_corridor' WHEN dist_perennial_m <= 500 THEN 'perennial_corridor' WHEN dist_intermittent_m <= 1000 THEN 'intermittent_corridor' ELSE 'off_corridor' END AS hydro_analog FROM fx_points),
tb AS (SELECT py.*, su.valid_years, su.irr_freq, su.irr_frac_std, su.etf_std, su.ndvi_amp_std, bn.x, bn.y, bn.rem_at_sample, bn.rem_bin, bn.hydro_analog, bn.dist_field_edge_m FROM py JOIN su USING (point_id) JOIN bn USING (point_id)),
ex AS (SELECT *, CASE WHEN NOT coalesce(irr_class IS NOT NULL AND ndvi_peak_gs IS NOT NULL AND et_valid AND etf IS NOT NULL AND valid_years >= 3 AND eto_gs > 0, false) THEN 'data_sufficiency' WHEN NOT coalesce(irr_class <= 0.1, false) THEN 'year_irrigated' WHEN NOT coalesce(irr_freq <= 0.15 AND irr_frac_std <= 0.3, false) THEN 'purity' WHEN NOT coalesce(dist_field_edge_m >= 100, false) THEN 'field_edge' END AS reason FROM tb),
rc AS (SELECT * FROM tb WHERE et_valid AND irr_class >= 0.5 AND etf > -999 AND eto_gs > 0),
nb AS (SELECT * FROM (SELECT r.point_id, r.year, d.point_id AS donor_point_id, sqrt((r.x-d.x)*(r.x-d.x)+(r.y-d.y)*(r.y-d.y)) AS distance_m, abs(r.rem_at_sample - d.rem_at_sample) AS rem_delta, r.rem_bin = d.rem_bin AND r.hydro_analog = d.hydro_analog AS same,
  abs(r.ndvi_peak_gs - d.ndvi_peak_gs) AS dp, abs(r.ndvi_amp_gs - d.ndvi_amp_gs) AS da, d.irr_freq, coalesce(d.etf_std, 0) AS es, coalesce(d.ndvi_amp_std, 0) AS ns, d.etf AS target_value,
  row_number() OVER (PARTITION BY r.point_id, r.year ORDER BY sqrt((r.x-d.x)*(r.x-d.x)+(r.y-d.y)*(r.y-d.y)), d.point_id) AS i FROM rc r JOIN ex d ON r.year = d.year AND d.reason IS NULL WHERE sqrt((r.x-d.x)*(r.x-d.x)+(r.y-d.y)*(r.y-d.y)) <= 4000) WHERE i <= 50),
pr AS (SELECT point_id, year, donor_point_id, distance_m, rem_delta, target_value, exp(-rem_delta / 1.0) * exp(-distance_m / 3000.0) * exp(-(dp / 0.15 + da / 0.10)) * pow(1 - irr_freq, 2.0) * exp(-(es / 0.15 + ns / 0.08)) AS pair_score FROM nb WHERE rem_delta <= 2 AND same),
tk AS (SELECT *, pair_score / greatest(sum(pair_score) OVER (PARTITION BY point_id, year), 1e-12) AS pair_weight FROM (SELECT *, row_number() OVER (PARTITION BY point_id, year ORDER BY pair_score DESC, donor_point_id) AS rank FROM pr) WHERE rank <= 7)"""


def years(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_ = view(spark, sf_dir, "fx_point_year").withColumn("ndvi_amp_gs", F.greatest(F.col("ndvi_peak_gs") - F.col("ndvi_p25_gs"), F.lit(0.0)))
    return points.valid_flags(table_)


def donor_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = years(spark, sf_dir)
    summary = points.summarize(rows).select("point_id", "valid_years", "irr_freq", "irr_frac_std", "etf_std", "ndvi_amp_std")
    static = view(spark, sf_dir, "fx_points").withColumns({"rem_bin": points.rem_bin(F.col("rem_at_sample")), "hydro_analog": points.hydro_class(RULES)})
    return rows.join(summary, "point_id").join(static, "point_id").withColumn("reason", points.exclusion_reason(RULES))


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = donor_table(spark, sf_dir)
    return points.donor_pairs(points.recipients(rows), rows.where("reason is null"), RULES)


_SUMMARY = ["irr_freq", "irr_frac_std", "aet_mean", "aet_std", "eto_gs_mean", "prcp_mean", "etf_mean", "etf_std", "net_et_mean", "ndvi_amp_mean", "ndvi_peak_mean", "ndvi_amp_std"]


@query("fx_points fx_point_year", _YEARS + " SELECT point_id, n_years, valid_years, n_irr_years, " + ", ".join(f"round({c}, 9) AS {c}" for c in _SUMMARY) + " FROM su")
def point_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.summarize(years(spark, sf_dir)).select("point_id", "n_years", "valid_years", "n_irr_years", *[F.round(c, 9).alias(c) for c in _SUMMARY])


@query(
    "fx_points fx_point_year",
    """ys AS (SELECT DISTINCT year FROM fx_point_year WHERE year < 2001),
    cl AS (SELECT point_id, year, eto_gs, pr_annual FROM fx_point_year)
    SELECT p.point_id, ys.year, a.irr_class, a.ndvi_peak_gs, a.aet_gs, cl.eto_gs, cl.pr_annual FROM fx_points p CROSS JOIN ys LEFT JOIN fx_point_year a USING (point_id, year) LEFT JOIN cl USING (point_id, year)""",
)
def point_year_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points in all years; the climate table's further year adds no rows."""
    rows = view(spark, sf_dir, "fx_point_year")
    before = rows.where("year < 2001")
    return points.assemble_point_years(view(spark, sf_dir, "fx_points"), before.select("point_id", "year", "irr_class"), before.select("point_id", "year", "ndvi_peak_gs"), before.select("point_id", "year", "aet_gs"), rows.select("point_id", "year", "eto_gs", "pr_annual"))


@query(
    "",
    """m AS (SELECT o_custkey AS point_id, CAST(year(o_orderdate) AS INT) AS year, month(o_orderdate) AS mo, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS DOUBLE) AS v FROM orders GROUP BY 1, 2, 3),
    k AS (SELECT point_id, year FROM (SELECT DISTINCT point_id FROM m) CROSS JOIN (SELECT unnest(generate_series((SELECT min(year) FROM m), (SELECT max(year) FROM m))) AS year))
    SELECT k.point_id, CAST(k.year AS INT) AS year, count(v) AS aet_n_months, sum(v) AS aet_annual, count(v) FILTER (WHERE mo BETWEEN 4 AND 10) AS aet_gs_n_months, sum(v) FILTER (WHERE mo BETWEEN 4 AND 10) AS aet_gs
    FROM k LEFT JOIN m ON m.point_id = k.point_id AND m.year = k.year GROUP BY 1, 2""",
)
def month_reshape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide monthly columns to point years; no month at all gives a null sum and a count of 0."""
    rows = table(spark, sf_dir, "orders")
    value = F.floor("o_totalprice").cast("long")
    first, last = rows.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    months = [(y, m) for y in range(first, last + 1) for m in range(1, 13)]
    wide = rows.groupBy(F.col("o_custkey").alias("point_id")).agg(*[F.sum(F.when((F.year("o_orderdate") == y) & (F.month("o_orderdate") == m), value)).cast("double").alias(f"eta_{y}_{m:02d}") for y, m in months])
    return points.month_sums(wide, "point_id")


_MASKS = """
mk AS (SELECT *, rem_at_sample < 2 AS is_low_rem_target, least(dist_perennial_m, dist_intermittent_m, dist_managed_m) <= 250 AS is_riparian_target, dist_field_edge_m <= 60 AS is_field_edge_target, rem_at_sample > 5 AS is_high_rem_control, (point_id * 7919 + 7) % 100003 AS h FROM fx_points)"""


@query("fx_points", _MASKS + " SELECT point_id, true AS valid, is_low_rem_target, is_riparian_target, is_field_edge_target, is_high_rem_control FROM mk")
def sample_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = points.sample_masks(points.nearest_stream(view(spark, sf_dir, "fx_points")))
    return out.select("point_id", "valid", "is_low_rem_target", "is_riparian_target", "is_field_edge_target", "is_high_rem_control")


@query(
    "fx_points",
    _MASKS
    + """, a AS (SELECT point_id, 'is_low_rem_target' AS g, n / least(n, 40) AS w FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY h, point_id) AS i FROM mk WHERE is_low_rem_target) WHERE i <= 40),
    b AS (SELECT point_id, 'is_riparian_target' AS g, n / least(n, 30) AS w FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY h, point_id) AS i FROM mk WHERE is_riparian_target AND point_id NOT IN (SELECT point_id FROM a)) WHERE i <= 30),
    c AS (SELECT point_id, 'is_high_rem_control' AS g, n / least(n, 20) AS w FROM (SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY h, point_id) AS i FROM mk WHERE is_high_rem_control AND point_id NOT IN (SELECT point_id FROM a) AND point_id NOT IN (SELECT point_id FROM b)) WHERE i <= 20),
    u AS (SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c)
    SELECT printf('aoi_%06d', row_number() OVER (ORDER BY point_id) - 1) AS aoi_id, point_id, g AS sample_group, round(w, 6) AS sampling_weight FROM u""",
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    masked = points.sample_masks(points.nearest_stream(view(spark, sf_dir, "fx_points").drop("sample_group")))
    drawn = points.stratified_sample(masked, [("is_low_rem_target", 40), ("is_riparian_target", 30), ("is_high_rem_control", 20)])
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("point_id")) - 1  # of the few rows drawn
    return drawn.select(F.concat(F.lit("aoi_"), F.lpad(number.cast("string"), 6, "0")).alias("aoi_id"), "point_id", "sample_group", F.round("sampling_weight", 6).alias("sampling_weight"))


@query("fx_points fx_point_year", _YEARS + " SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM ex GROUP BY 1")
def donor_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return donor_table(spark, sf_dir).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("fx_points fx_point_year", _YEARS + " SELECT point_id, year, donor_point_id, round(pair_score, 9) AS pair_score, round(distance_m, 6) AS distance_m, round(rem_delta, 6) AS rem_delta, round(target_value, 6) AS target_value FROM pr")
def donor_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pairs(spark, sf_dir).select("point_id", "year", "donor_point_id", F.round("pair_score", 9).alias("pair_score"), *[F.round(c, 6).alias(c) for c in ("distance_m", "rem_delta", "target_value")])


@query("fx_points fx_point_year", _YEARS + " SELECT point_id, year, donor_point_id, rank, round(pair_weight, 6) AS pair_weight FROM tk")
def donor_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points.top_donors(scored_pairs(spark, sf_dir), 7).select("point_id", "year", "donor_point_id", F.col("rank").cast("long").alias("rank"), F.round("pair_weight", 6).alias("pair_weight"))


@query(
    "fx_points fx_point_year",
    _YEARS
    + """, cw AS (SELECT *, sum(pair_weight) OVER (PARTITION BY point_id, year ORDER BY target_value, donor_point_id ROWS UNBOUNDED PRECEDING) AS cum FROM tk),
    ct AS (SELECT *, max(cum) OVER (PARTITION BY point_id, year) AS tot FROM cw),
    ag AS (SELECT point_id, year, count(*) AS n, 1 / sum(pair_weight * pair_weight) AS en, max(pair_weight) AS mw, median(distance_m) AS md, median(rem_delta) AS mr, min_by(target_value, CASE WHEN cum >= 0.5 * tot THEN cum END) AS wm,
      coalesce(sum(target_value * pair_weight) FILTER (WHERE cum >= tot * 0.1 AND cum <= tot * (1 - 0.1)) / sum(pair_weight) FILTER (WHERE cum >= tot * 0.1 AND cum <= tot * (1 - 0.1)), sum(target_value * pair_weight) / sum(pair_weight)) AS wt FROM ct GROUP BY 1, 2),
    fg AS (SELECT *, concat_ws(';', CASE WHEN en < 2.5 THEN 'low_effective_n' END, CASE WHEN mw > 0.5 THEN 'dominant_donor' END, CASE WHEN abs(wm - wt) > 0.05 THEN 'estimator_disagreement' END) AS f FROM ag)
    SELECT point_id, year, CASE WHEN n < 3 THEN 'no_donor' WHEN f <> '' THEN 'low_confidence' ELSE 'ok' END AS status, CASE WHEN n < 3 THEN 'insufficient_neighbors' END AS no_donor_reason, CASE WHEN n >= 3 THEN round(wm, 6) END AS background_etf_wmedian,
      CASE WHEN n >= 3 THEN round(wt, 6) END AS background_etf_trimmed, n AS n_donors_used, CASE WHEN n >= 3 THEN round(en, 6) ELSE 0 END AS effective_n, CASE WHEN n >= 3 THEN round(mw, 6) ELSE 0 END AS max_weight,
      CASE WHEN n >= 3 THEN round(md, 6) ELSE 0 END AS median_distance_m, CASE WHEN n >= 3 THEN round(mr, 6) ELSE 0 END AS median_rem_delta, CASE WHEN n >= 3 AND f <> '' THEN f END AS confidence_flag FROM fg""",
)
def donor_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = points.background(points.top_donors(scored_pairs(spark, sf_dir), RULES.top_k), RULES)
    return out.withColumns({c: F.round(c, 6) for c in ("background_etf_wmedian", "background_etf_trimmed", "effective_n", "max_weight", "median_distance_m", "median_rem_delta")})


@query(
    "fx_points fx_point_year",
    _YEARS
    + """, ft AS (SELECT point_id, irr_freq, aet_mean, etf_std, ndvi_amp_std FROM su WHERE irr_freq IS NOT NULL AND aet_mean IS NOT NULL AND etf_std IS NOT NULL AND ndvi_amp_std IS NOT NULL),
    ms AS (SELECT avg(irr_freq) a, stddev_pop(irr_freq) b, avg(aet_mean) c, stddev_pop(aet_mean) d, avg(etf_std) e, stddev_pop(etf_std) f, avg(ndvi_amp_std) g, stddev_pop(ndvi_amp_std) h FROM ft)
    SELECT point_id, round((irr_freq - a) / b, 6) AS irr_freq, round((aet_mean - c) / d, 6) AS aet_mean, round((etf_std - e) / f, 6) AS etf_std, round((ndvi_amp_std - g) / h, 6) AS ndvi_amp_std FROM ft, ms""",
)
def cluster_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = points.usable_features(points.summarize(years(spark, sf_dir)), ["irr_freq", "aet_mean", "etf_std", "ndvi_amp_std", "absent"])
    columns = [c for c in used.columns if c != "point_id"]
    return standard_scores(used, columns).select("point_id", *[F.round(c, 6).alias(c) for c in columns])


@query("fx_points", "SELECT CAST(point_id % 5 AS BIGINT) AS cluster, count(*) AS n, round(avg(rem_at_sample), 6) AS rem_mean, round(stddev_samp(rem_at_sample), 6) AS rem_std, round(avg(dist_perennial_m), 6) AS dist_mean, round(stddev_samp(dist_perennial_m), 6) AS dist_std FROM fx_points GROUP BY 1")
def cluster_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_points").withColumn("cluster", F.col("point_id") % 5)
    return rows.groupBy("cluster").agg(F.count("*").alias("n"), F.round(F.avg("rem_at_sample"), 6).alias("rem_mean"), F.round(F.stddev_samp("rem_at_sample"), 6).alias("rem_std"), F.round(F.avg("dist_perennial_m"), 6).alias("dist_mean"), F.round(F.stddev_samp("dist_perennial_m"), 6).alias("dist_std"))


_CLAIMS = "cl AS (SELECT point_id, unnest(['base', CASE WHEN point_id % 2 = 0 THEN 'low_rem' END, CASE WHEN point_id % 3 = 0 THEN 'field_edge' END, CASE WHEN point_id % 7 = 0 THEN 'riparian' END, CASE WHEN point_id % 5 = 0 THEN 'another' END]) AS sample_group FROM fx_points)"


@query(
    "fx_points",
    _CLAIMS
    + """ SELECT point_id, sample_group FROM cl WHERE sample_group IS NOT NULL QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY CASE sample_group WHEN 'riparian' THEN 1 WHEN 'field_interior' THEN 2 WHEN 'low_rem' THEN 3 WHEN 'field_edge' THEN 4 WHEN 'high_rem_control' THEN 5 WHEN 'base' THEN 6 ELSE 7 END, sample_group) = 1""",
)
def claimed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every point once, for the group that comes first of those that drew it."""
    k = F.col("point_id")
    drawn = F.array(F.lit("base"), *[F.when(k % n == 0, name) for n, name in ((2, "low_rem"), (3, "field_edge"), (7, "riparian"), (5, "another"))])
    claims = view(spark, sf_dir, "fx_points").select("point_id", F.explode(drawn).alias("sample_group")).where("sample_group is not null")
    return points.first_by_priority(claims, "point_id", "sample_group")
