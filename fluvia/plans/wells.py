"""Queries on wells: labels, tiers, metric panels, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fluvia.functions import hydro
from fluvia.functions.binning import right_closed
from fluvia.operators import stats, wells
from fluvia.plans.registry import query
from fluvia.sources.tables import table, view

_OVER = "round({0}, 6) AS {0}"
#: Two synthetic predictions of each well: one noisy, one with gaps.
_PREDICTED = """
w AS (SELECT *, obs_dtw + ((well_id * 37) % 41 - 20) / 4.0 AS p1, CASE WHEN well_id % 7 <> 0 THEN obs_dtw * 0.9 + ((well_id * 53) % 23) / 2.0 END AS p2, CAST(well_id % 4 AS DOUBLE) / 2 AS wt, CAST(floor(x / 5000) AS BIGINT) AS huc FROM fx_wells)"""
_PANEL = "count(*) AS n, round(median(abs(r)), 6) AS mad, round(avg(r), 6) AS mean_bias, round(median(r), 6) AS median_bias, round(sqrt(avg(r * r)), 6) AS rmse"


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return view(spark, sf_dir, "fx_wells").withColumns(
        {
            "p1": c("obs_dtw") + ((c("well_id") * 37) % 41 - 20) / 4.0,
            "p2": F.when(c("well_id") % 7 != 0, c("obs_dtw") * 0.9 + ((c("well_id") * 53) % 23) / 2.0),
            "wt": (c("well_id") % 4).cast("double") / 2,
            "huc": F.floor(c("x") / 5000),
        }
    )


@query("fx_wells", _PREDICTED + f" SELECT confinement_class, {_PANEL} FROM (SELECT confinement_class, p2 - obs_dtw AS r FROM w WHERE p2 IS NOT NULL) GROUP BY 1")
def error_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.error_panel(predicted(spark, sf_dir), ["confinement_class"], F.col("p2") - F.col("obs_dtw"))


@query(
    "fx_wells",
    _PREDICTED
    + """, q AS (SELECT fold, wt, p1, obs_dtw, p1 - obs_dtw AS r FROM w)
    SELECT fold, count(*) AS n, round(sum(wt * abs(r)) / sum(wt), 6) AS wmad, round(sqrt(sum(wt * r * r) / sum(wt)), 6) AS wrmse, round(sum(wt * r) / sum(wt), 6) AS wbias,
      round(count(*) FILTER (WHERE p1 <= 20 AND obs_dtw <= 20) / greatest(count(*) FILTER (WHERE obs_dtw <= 20), 1), 6) AS recall, round(count(*) FILTER (WHERE p1 <= 20 AND obs_dtw <= 20) / greatest(count(*) FILTER (WHERE p1 <= 20), 1), 6) AS precision FROM q GROUP BY fold""",
)
def weighted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted errors, and recall and precision of shallow water."""
    rows = predicted(spark, sf_dir).withColumn("r", F.col("p1") - F.col("obs_dtw"))
    total = F.sum("wt")
    said, true = F.col("p1") <= 20, F.col("obs_dtw") <= 20
    hits = F.count_if(said & true)
    return rows.groupBy("fold").agg(
        F.count("*").alias("n"),
        F.round(F.sum(F.col("wt") * F.abs("r")) / total, 6).alias("wmad"),
        F.round(F.sqrt(F.sum(F.col("wt") * F.col("r") * F.col("r")) / total), 6).alias("wrmse"),
        F.round(F.sum(F.col("wt") * F.col("r")) / total, 6).alias("wbias"),
        F.round(hits / F.greatest(F.count_if(true), F.lit(1)), 6).alias("recall"),
        F.round(hits / F.greatest(F.count_if(said), F.lit(1)), 6).alias("precision"),
    )


@query(
    "fx_wells",
    _PREDICTED
    + f""", b AS (SELECT 'depth' AS kind, CASE WHEN obs_dtw < 10 THEN '[0,10)' WHEN obs_dtw < 40 THEN '[10,40)' ELSE '[40,inf)' END AS band, p1 - obs_dtw AS r FROM w UNION ALL SELECT 'region', CAST(huc AS VARCHAR), p1 - obs_dtw FROM w)
    SELECT kind, band, {_PANEL} FROM b GROUP BY 1, 2 HAVING count(*) >= 25""",
)
def banded_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by depth band and by region, of groups with at least 25 rows."""
    rows = predicted(spark, sf_dir)
    depth = F.when(F.col("obs_dtw") < 10, "[0,10)").when(F.col("obs_dtw") < 40, "[10,40)").otherwise("[40,inf)")
    both = F.array(F.struct(F.lit("depth").alias("kind"), depth.alias("band")), F.struct(F.lit("region").alias("kind"), F.col("huc").cast("string").alias("band")))
    long = rows.select((F.col("p1") - F.col("obs_dtw")).alias("r"), F.explode(both).alias("g")).select("r", "g.kind", "g.band")
    return stats.error_panel(long, ["kind", "band"], F.col("r")).where("n >= 25")


_GROUPS = {"all": "true", "deep": "obs_dtw > 40", "footprint": "p2 IS NOT NULL", "shallow": "obs_dtw <= 10", "unconfined": "confinement_class = 'unconfined'", "weighted": "wt > 0"}


@query(
    "fx_wells",
    _PREDICTED
    + ", g AS ("
    + " UNION ALL ".join(f"SELECT '{k}' AS grp, * FROM w WHERE {v}" for k, v in _GROUPS.items())
    + f"), l AS (SELECT grp, 'p1' AS product, p1 - obs_dtw AS r FROM g UNION ALL SELECT grp, 'p2', p2 - obs_dtw FROM g WHERE p2 IS NOT NULL) SELECT grp, product, {_PANEL} FROM l GROUP BY 1, 2",
)
def overlapping_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each product in groups that overlap."""
    rows = stats.overlapping_groups(predicted(spark, sf_dir), {k: F.expr(v) for k, v in _GROUPS.items()})
    long = rows.unpivot(["grp", "obs_dtw"], ["p1", "p2"], "product", "p")
    return stats.error_panel(long, ["grp", "product"], F.col("p") - F.col("obs_dtw"))


@query(
    "fx_wells",
    _PREDICTED
    + f""", f AS (SELECT * FROM w WHERE p1 IS NOT NULL AND p2 IS NOT NULL), l AS (SELECT 'POOLED' AS huc, 'p1' AS product, p1 - obs_dtw AS r FROM f UNION ALL SELECT 'POOLED', 'p2', p2 - obs_dtw FROM f UNION ALL SELECT CAST(huc AS VARCHAR), 'p1', p1 - obs_dtw FROM f UNION ALL SELECT CAST(huc AS VARCHAR), 'p2', p2 - obs_dtw FROM f)
    SELECT huc, product, {_PANEL} FROM l GROUP BY 1, 2""",
)
def common_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of all predictors on the rows where each has a value, by region and pooled."""
    rows = predicted(spark, sf_dir).where("p1 is not null and p2 is not null")
    rows = rows.withColumn("huc", F.explode(F.array(F.lit("POOLED"), F.col("huc").cast("string"))))
    return stats.error_panel(rows.unpivot(["huc", "obs_dtw"], ["p1", "p2"], "product", "p"), ["huc", "product"], F.col("p") - F.col("obs_dtw"))


@query("fx_wells", _PREDICTED + " SELECT huc, count(*) AS n, round(corr(p2, obs_dtw), 6) AS r, round(sqrt(avg((p2 - obs_dtw) * (p2 - obs_dtw))), 6) AS rmse FROM w WHERE p2 IS NOT NULL GROUP BY 1")
def correlation_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir).where("p2 is not null")
    e = F.col("p2") - F.col("obs_dtw")
    return rows.groupBy("huc").agg(F.count("*").alias("n"), F.round(F.corr("p2", "obs_dtw"), 6).alias("r"), F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"))


@query("fx_wells", _PREDICTED + ", c AS (SELECT floor(x / 1500) AS cx, floor(y / 1500) AS cy, median(p1) AS p, median(obs_dtw) AS o FROM w GROUP BY 1, 2) SELECT count(*) AS n_cells, round(corr(p, o), 6) AS r, round(median(abs(p - o)), 6) AS mad FROM c")
def native_cell_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians per native cell before scoring."""
    cells = predicted(spark, sf_dir).groupBy(F.floor(F.col("x") / 1500).alias("cx"), F.floor(F.col("y") / 1500).alias("cy")).agg(F.median("p1").alias("p"), F.median("obs_dtw").alias("o"))
    return cells.agg(F.count("*").alias("n_cells"), F.round(F.corr("p", "o"), 6).alias("r"), F.round(F.median(F.abs(F.col("p") - F.col("o"))), 6).alias("mad"))


@query(
    "fx_wells",
    _PREDICTED
    + """, k AS (SELECT fold, rank() OVER (PARTITION BY fold ORDER BY wt) + (count(*) OVER (PARTITION BY fold, wt) - 1) / 2.0 AS a, rank() OVER (PARTITION BY fold ORDER BY obs_dtw) + (count(*) OVER (PARTITION BY fold, obs_dtw) - 1) / 2.0 AS b FROM w)
    SELECT fold, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN corr(a, b) END, 6) AS rho FROM k GROUP BY fold""",
)
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predicted(spark, sf_dir).select("fold", stats.average_rank("wt", ["fold"]).alias("a"), stats.average_rank("obs_dtw", ["fold"]).alias("b"))
    return rows.groupBy("fold").agg(F.count("*").alias("n"), F.round(F.when(F.count("*") >= 10, F.corr("a", "b")), 6).alias("rho"))


#: Readings spread over eight years, so that trends exist; one event kind plays the driller's report.
_READINGS = """
rd AS (SELECT event_id, station, CAST(ts AS TIMESTAMP) - CAST((event_id % 8) * 365 AS INT) * INTERVAL 1 DAY AS ts, dtw, CASE WHEN method = 'click' THEN 'driller_report' ELSE method END AS method FROM fx_stations)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_stations")
    return rows.select("event_id", "station", F.expr("ts - make_interval(0, 0, 0, cast((event_id % 8) * 365 as int))").alias("ts"), "dtw", F.when(F.col("method") == "click", "driller_report").otherwise(F.col("method")).alias("method"))


_LABELS = """
lb AS (SELECT station, count(*) AS n_obs_used, count(DISTINCT year(ts)) AS n_years, min(CAST(ts AS DATE)) AS date_min, max(CAST(ts AS DATE)) AS date_max, median(dtw) AS dtw_all_median, median(CASE WHEN year(ts) BETWEEN 2019 AND 2024 THEN dtw END) AS dtw_2019_2024_median,
  median(CASE WHEN month(ts) IN (4, 5, 6) THEN dtw END) AS dtw_spring_median, median(CASE WHEN month(ts) IN (9, 10) THEN dtw END) AS dtw_fall_median, median(CASE WHEN year(ts) >= ly - 4 THEN dtw END) AS dtw_latest5_median,
  arg_max(dtw, {'t': ts, 'e': event_id}) AS latest_dtw, arg_max(method, {'t': ts, 'e': event_id}) AS latest_method, arg_min(dtw, CASE WHEN method = 'driller_report' THEN event_id END) AS driller_dtw
  FROM (SELECT *, max(year(ts)) OVER (PARTITION BY station) AS ly FROM rd WHERE dtw IS NOT NULL) GROUP BY station)"""
_NUMBERS = ["dtw_all_median", "dtw_2019_2024_median", "dtw_spring_median", "dtw_fall_median", "dtw_latest5_median", "latest_dtw", "driller_dtw"]


@query("fx_stations", _READINGS + "," + _LABELS + " SELECT station, n_obs_used, n_years, date_min, date_max, latest_method, n_years >= 2 AS is_timeseries, " + ", ".join(_OVER.format(c) for c in _NUMBERS) + " FROM lb")
def well_series_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wells.series_labels(readings(spark, sf_dir))
    return out.select("station", "n_obs_used", "n_years", "date_min", "date_max", "latest_method", "is_timeseries", *[F.round(c, 6).alias(c) for c in _NUMBERS])


@query(
    "fx_stations",
    _READINGS
    + """, t AS (SELECT station, year(ts) + (dayofyear(ts) - 1) / 365.25 AS t, dtw FROM rd WHERE dtw IS NOT NULL AND station IN (SELECT station FROM rd GROUP BY station HAVING count(DISTINCT year(ts)) >= 5)),
    p AS (SELECT a.station, (b.dtw - a.dtw) / (b.t - a.t) AS s FROM t a JOIN t b ON a.station = b.station AND b.t > a.t), s AS (SELECT station, median(s) AS slope, list(s ORDER BY s) AS v, count(*) AS nt FROM p GROUP BY 1),
    m AS (SELECT station, median(t) AS mt, median(dtw) AS md, count(*) AS n FROM t GROUP BY 1), tx AS (SELECT station, sum(k * (k - 1) * (2 * k + 5)) AS tx FROM (SELECT station, count(*) AS k FROM t GROUP BY station, t) GROUP BY 1), ty AS (SELECT station, sum(k * (k - 1) * (2 * k + 5)) AS ty FROM (SELECT station, count(*) AS k FROM t GROUP BY station, dtw) GROUP BY 1),
    e AS (SELECT *, 1.959963984540054 * sqrt((n * (n - 1) * (2 * n + 5) - tx - ty) / 18.0) AS w FROM s JOIN m USING (station) JOIN tx USING (station) JOIN ty USING (station)),
    i AS (SELECT *, v[1 + CAST(greatest(round_even((nt - w) / 2, 0) - 1, 0) AS BIGINT)] AS low, v[1 + CAST(least(round_even((nt + w) / 2, 0), nt - 1) AS BIGINT)] AS high FROM e)
    SELECT station, round(slope, 6) AS slope, round(md - slope * mt, 4) AS intercept, round(low, 6) AS low, round(high, 6) AS high, CASE WHEN low > 0 OR high < 0 THEN round(md - slope * mt + slope * 2022, 4) END AS adjusted_2022 FROM i""",
)
def well_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = wells.series_trends(readings(spark, sf_dir))
    certain = (F.col("low") > 0) | (F.col("high") < 0)  # the interval leaves out no trend
    adjusted = F.when(certain, F.round(F.col("intercept") + F.col("slope") * 2022, 4))
    return out.select("station", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), adjusted.alias("adjusted_2022"))


_RECORDS = """
rc AS (SELECT c_custkey AS source_well_id, c_custkey % 400 AS canonical_id, 'src' || CAST(c_custkey % 3 AS VARCHAR) AS source, CASE c_custkey % 5 WHEN 0 THEN 'survey_gps' WHEN 1 THEN 'gps' WHEN 2 THEN 'map' WHEN 3 THEN 'plss' END AS h_accuracy_class,
  CASE c_custkey % 7 WHEN 0 THEN 'unconfined' WHEN 1 THEN 'confined' WHEN 2 THEN 'unknown' WHEN 3 THEN 'artesian' WHEN 4 THEN 'unconfined_marginal' WHEN 5 THEN 'likely_unconfined' END AS confinement_class, CASE (c_custkey * 7) % 6 WHEN 0 THEN 'domestic' WHEN 1 THEN 'pumping' WHEN 2 THEN 'monitoring' WHEN 3 THEN 'domestic' END AS well_class,
  CASE WHEN c_custkey % 50 = 0 THEN 'monitoring' END AS well_use, CASE WHEN c_custkey % 3 <> 0 THEN CAST((c_custkey * 11) % 120 AS DOUBLE) END AS well_depth, CASE WHEN c_custkey % 4 = 0 THEN CAST((c_custkey * 13) % 90 AS DOUBLE) END AS screen_top,
  c_custkey % 7 = 0 AS has_time_series, c_custkey % 2 = 0 AS is_static_only FROM customer)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several records of a well, from customers."""
    c = F.col("c_custkey")

    def pick(by, values):
        out = F.lit(None).cast("string")
        for k, v in values.items():
            out = F.when(by == k, v).otherwise(out)
        return out

    return table(spark, sf_dir, "customer").select(
        c.alias("source_well_id"),
        (c % 400).alias("canonical_id"),
        F.concat(F.lit("src"), (c % 3).cast("string")).alias("source"),
        pick(c % 5, {0: "survey_gps", 1: "gps", 2: "map", 3: "plss"}).alias("h_accuracy_class"),
        pick(c % 7, {0: "unconfined", 1: "confined", 2: "unknown", 3: "artesian", 4: "unconfined_marginal", 5: "likely_unconfined"}).alias("confinement_class"),
        pick((c * 7) % 6, {0: "domestic", 1: "pumping", 2: "monitoring", 3: "domestic"}).alias("well_class"),
        F.when(c % 50 == 0, "monitoring").alias("well_use"),
        F.when(c % 3 != 0, ((c * 11) % 120).cast("double")).alias("well_depth"),
        F.when(c % 4 == 0, ((c * 13) % 90).cast("double")).alias("screen_top"),
        (c % 7 == 0).alias("has_time_series"),
        (c % 2 == 0).alias("is_static_only"),
    )


_COLLAPSED = """
od AS (SELECT *, row_number() OVER (PARTITION BY canonical_id ORDER BY CASE h_accuracy_class WHEN 'survey_gps' THEN 4 WHEN 'gps' THEN 3 WHEN 'map' THEN 2 WHEN 'plss' THEN 1 ELSE 0 END DESC, source_well_id) AS i FROM rc),
md AS (SELECT canonical_id, well_class AS m FROM (SELECT canonical_id, well_class, row_number() OVER (PARTITION BY canonical_id ORDER BY count(*) DESC, well_class) AS k FROM rc WHERE well_class IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
cl AS (SELECT canonical_id, string_agg(source || ':' || CAST(source_well_id AS VARCHAR), ';' ORDER BY source || ':' || CAST(source_well_id AS VARCHAR)) AS source_ids, count(*) AS n_members, string_agg(DISTINCT source, ';' ORDER BY source) AS sources,
  max(CASE WHEN i = 1 THEN h_accuracy_class END) AS h_accuracy_class, max(CASE WHEN i = 1 THEN confinement_class END) AS confinement_class, arg_min(well_class, CASE WHEN well_class IS NOT NULL THEN i END) AS well_class, arg_min(well_depth, CASE WHEN well_depth IS NOT NULL THEN i END) AS well_depth,
  arg_min(screen_top, CASE WHEN screen_top IS NOT NULL THEN i END) AS screen_top, bool_or(coalesce(well_use = 'monitoring', false) OR coalesce(well_class = 'monitoring', false)) OR (bool_or(source = 'src1') AND bool_or(has_time_series)) AS mon,
  bool_or(has_time_series) AS has_time_series, bool_and(is_static_only) AS is_static_only FROM od GROUP BY canonical_id),
cc AS (SELECT cl.*, CASE WHEN mon THEN 'monitoring' ELSE md.m END AS override_class FROM cl LEFT JOIN md USING (canonical_id))"""


@query("", _RECORDS + "," + _COLLAPSED + " SELECT canonical_id, source_ids, n_members, sources, h_accuracy_class, confinement_class, well_class, well_depth, screen_top, override_class, has_time_series, is_static_only FROM cc")
def well_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells.collapse(records(spark, sf_dir))


@query(
    "fx_stations",
    _RECORDS
    + ","
    + _COLLAPSED
    + ","
    + _READINGS
    + ","
    + _LABELS
    + """, pk AS (SELECT cc.*, lb.station, CASE WHEN n_years >= 2 THEN coalesce(dtw_2019_2024_median, dtw_latest5_median, dtw_all_median) WHEN driller_dtw IS NOT NULL AND (is_static_only OR n_years <= 1) THEN driller_dtw ELSE coalesce(latest_dtw, dtw_all_median) END AS value,
      CASE WHEN n_years >= 2 THEN CASE WHEN dtw_2019_2024_median IS NOT NULL THEN 'ts_2019_2024_median' WHEN dtw_latest5_median IS NOT NULL THEN 'ts_latest5_median' ELSE 'ts_all_median' END WHEN driller_dtw IS NOT NULL AND (is_static_only OR n_years <= 1) THEN 'static_driller_report' WHEN latest_dtw IS NOT NULL THEN 'static_manual' ELSE 'static_single' END AS kind FROM cc JOIN lb ON lb.station = cc.canonical_id),
    tr AS (SELECT *, CASE WHEN value IS NULL OR NOT (value BETWEEN -10 AND 500) THEN 'no_usable_dtw' WHEN confinement_class IN ('confined', 'likely_confined', 'artesian') THEN 'confined_aquifer' WHEN value < -1 THEN 'artesian_above_surface' WHEN well_depth > 0 AND well_depth <= 5000 AND value > well_depth THEN 'dtw_below_well_bottom'
      WHEN value > 60 AND coalesce(confinement_class NOT IN ('unconfined', 'unconfined_marginal'), true) THEN 'deep_water_nonphreatic' WHEN screen_top > 60 THEN 'deep_screen_nonphreatic' WHEN override_class = 'pumping' THEN 'pumping_well' WHEN coalesce(h_accuracy_class NOT IN ('survey_gps', 'gps', 'map'), true) THEN 'poor_location' ELSE '' END AS exclusion_reason FROM pk)
    SELECT canonical_id, kind, round(value, 6) AS value, exclusion_reason, CASE WHEN exclusion_reason <> '' THEN 'diagnostic' WHEN override_class = 'monitoring' OR confinement_class IN ('unconfined', 'unconfined_marginal') OR (coalesce(confinement_class, '') IN ('', 'unknown') AND well_depth > 0 AND well_depth <= 30) OR has_time_series THEN 'primary' ELSE 'secondary' END AS tier,
      CASE WHEN exclusion_reason <> '' THEN 0.0::DOUBLE WHEN override_class = 'monitoring' THEN CASE WHEN has_time_series THEN 1.0 ELSE 0.6 END WHEN confinement_class IN ('unconfined', 'unconfined_marginal') OR (coalesce(confinement_class, '') IN ('', 'unknown') AND well_depth > 0 AND well_depth <= 30) OR has_time_series THEN 0.6 ELSE 0.25 END AS weight FROM tr""",
)
def well_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels picked from readings, and the decision which wells may train."""
    labelled = wells.collapse(records(spark, sf_dir)).join(wells.series_labels(readings(spark, sf_dir)), F.col("station") == F.col("canonical_id"))
    picked = labelled.withColumn("label", wells.picked_label(F.col("is_static_only")))
    picked = picked.withColumns({"value": F.col("label.value"), "suspect": wells.suspect(F.col("label"))})
    return picked.withColumn("t", wells.tier()).select("canonical_id", F.col("label.kind").alias("kind"), F.round("value", 6).alias("value"), "t.exclusion_reason", "t.tier", "t.weight")


@query(
    "fx_wells",
    """s AS (SELECT well_id, CAST(floor(x / 4000) AS DOUBLE) + 0.1234564 AS x, CAST(floor(y / 4000) AS DOUBLE) AS y, obs_dtw AS dtw, well_id % 5 + 1 AS n_obs, DATE '2020-01-01' + CAST(well_id % 700 AS INT) AS last_date, confinement_class AS label, CASE confinement_class WHEN 'unconfined' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END AS priority FROM fx_wells)
    SELECT round(x, 6) AS x, round(y, 6) AS y, round(median(dtw), 6) AS dtw, CAST(sum(n_obs) AS BIGINT) AS n_obs, max(last_date) AS last_date, arg_min(label, {'p': priority, 'w': well_id}) AS label, count(DISTINCT label) > 1 AS conflict, count(*) AS n_wells FROM s GROUP BY 1, 2""",
)
def site_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.when(F.col("confinement_class") == "unconfined", 0).when(F.col("confinement_class") == "unknown", 1).otherwise(2)
    sites = view(spark, sf_dir, "fx_wells").select("well_id", (F.floor(F.col("x") / 4000).cast("double") + 0.1234564).alias("x"), F.floor(F.col("y") / 4000).cast("double").alias("y"), F.col("obs_dtw").alias("dtw"), (F.col("well_id") % 5 + 1).alias("n_obs"), F.expr("date_add(DATE '2020-01-01', cast(well_id % 700 as int))").alias("last_date"), F.col("confinement_class").alias("label"), priority.alias("priority"))
    return wells.dedup_sites(sites).withColumn("dtw", F.round("dtw", 6))


@query("fx_wells", "SELECT CAST(floor(x / 2500) AS BIGINT) AS col, CAST(floor(y / 2500) AS BIGINT) AS row, round(median(obs_dtw), 6) AS dtw, count(*) AS n, least(count(*), 10) AS weight, string_agg(CAST(well_id AS VARCHAR), ',' ORDER BY well_id) AS well_ids FROM fx_wells GROUP BY 1, 2")
def wells_to_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells.to_grid(view(spark, sf_dir, "fx_wells"), 2500.0).withColumn("dtw", F.round("dtw", 6))


@query("fx_wells", "SELECT well_id, obs_dtw FROM fx_wells WHERE x BETWEEN 2000 AND 15000 AND y BETWEEN 1000 AND 18000 AND confinement_class IN ('unconfined', 'unknown') AND well_id % 3 <> 1")
def well_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "fx_wells").withColumnRenamed("obs_dtw", "dtw").withColumn("source", F.concat(F.lit("s"), (F.col("well_id") % 3).cast("string")))
    return wells.in_window(rows, (2000, 1000, 15000, 18000), ["unconfined", "unknown"], exclude=["s1"]).select("well_id", F.col("dtw").alias("obs_dtw"))


@query(
    "fx_wells",
    """b AS (SELECT CAST(floor(x / 4000) AS BIGINT) AS basin, count(*) AS n_wells, count(*) FILTER (WHERE obs_dtw <= 10) AS n_shallow, count(*) FILTER (WHERE confinement_class = 'confined') AS n_confined FROM fx_wells GROUP BY 1),
    f AS (SELECT CAST(floor(cx / 4000) AS BIGINT) AS basin, count(*) AS n_fields FROM fx_fields WHERE cy < 9000 GROUP BY 1)
    SELECT b.basin, n_wells, n_shallow, n_confined, coalesce(n_fields, 0) AS n_fields, round(100.0 * n_shallow / n_wells, 6) AS pct FROM b LEFT JOIN f USING (basin) ORDER BY pct DESC, n_wells DESC, b.basin LIMIT 5""".replace("fx_fields", "(SELECT CAST((s_suppkey*7919)%20011 AS DOUBLE) AS cx, CAST((s_suppkey*6271)%20011 AS DOUBLE) AS cy FROM supplier)"),
)
def basin_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts per basin with the fields in it, the five with most shallow wells first."""
    basins = view(spark, sf_dir, "fx_wells").groupBy(F.floor(F.col("x") / 4000).alias("basin")).agg(F.count("*").alias("n_wells"), F.count_if(F.col("obs_dtw") <= 10).alias("n_shallow"), F.count_if(F.col("confinement_class") == "confined").alias("n_confined"))
    inside = view(spark, sf_dir, "fx_fields").where("cy < 9000").groupBy(F.floor(F.col("cx") / 4000).alias("basin")).agg(F.count("*").alias("n_fields"))
    out = basins.join(inside, "basin", "left").withColumns({"n_fields": F.coalesce("n_fields", F.lit(0)), "pct": F.round(100.0 * F.col("n_shallow") / F.col("n_wells"), 6)})
    return out.orderBy(F.desc("pct"), F.desc("n_wells"), "basin").limit(5)


@query(
    "fx_stations",
    "SELECT station, round(median(dtw), 6) AS dtw, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, bool_or(method = 'purchase') AS flagged FROM fx_stations WHERE dtw BETWEEN 5 AND 90 AND method <> 'error' GROUP BY station",
)
def site_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Range and qualifier filters on measurements given as text, then site medians with first and last time."""
    rows = view(spark, sf_dir, "fx_stations").withColumn("dtw", wells.cleaned(F.col("dtw").cast("string"))).where(F.col("dtw").between(5, 90) & (F.col("method") != "error"))
    return rows.groupBy("station").agg(F.round(F.median("dtw"), 6).alias("dtw"), F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.bool_or(F.col("method") == "purchase").alias("flagged"))


@query("fx_wells", _PREDICTED + " SELECT CAST(least(floor((obs_dtw - 1) / 10.0) + 1, 12) AS BIGINT) AS bin, count(*) AS n, round(median(p1), 6) AS med FROM w GROUP BY 1 HAVING count(*) >= 5")
def binned_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians in twelve equal bins that hold at least five wells; the last bin is open."""
    bins = F.least(F.width_bucket("obs_dtw", F.lit(1.0), F.lit(121.0), F.lit(12)), F.lit(12))
    return predicted(spark, sf_dir).groupBy(bins.alias("bin")).agg(F.count("*").alias("n"), F.round(F.median("p1"), 6).alias("med")).where("n >= 5")


@query(
    "fx_wells",
    _PREDICTED
    + """, g AS (SELECT 'all' AS grp, * FROM w WHERE p2 IS NOT NULL UNION ALL SELECT 'shallow', * FROM w WHERE p2 IS NOT NULL AND obs_dtw <= 30 UNION ALL SELECT 'shallow_unconfined', * FROM w WHERE p2 IS NOT NULL AND obs_dtw <= 30 AND confinement_class = 'unconfined')
    SELECT grp, count(*) AS n, round(median(abs(p1 - obs_dtw)), 6) AS mad_p1, round(median(abs(p2 - obs_dtw)), 6) AS mad_p2, CASE WHEN median(abs(p1 - obs_dtw)) <= median(abs(p2 - obs_dtw)) THEN 'p1' ELSE 'p2' END AS winner FROM g GROUP BY 1""",
)
def scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested subsets with the better product of each."""
    rows = predicted(spark, sf_dir).where("p2 is not null")
    shallow = F.col("obs_dtw") <= 30
    groups = stats.overlapping_groups(rows, {"all": F.lit(True), "shallow": shallow, "shallow_unconfined": shallow & (F.col("confinement_class") == "unconfined")})
    m1, m2 = F.median(F.abs(F.col("p1") - F.col("obs_dtw"))), F.median(F.abs(F.col("p2") - F.col("obs_dtw")))
    return groups.groupBy("grp").agg(F.count("*").alias("n"), F.round(m1, 6).alias("mad_p1"), F.round(m2, 6).alias("mad_p2"), F.when(m1 <= m2, "p1").otherwise("p2").alias("winner"))


@query(
    "fx_wells",
    _PREDICTED
    + """, m AS (SELECT fold AS method, 'all' AS grp, p1 - obs_dtw AS r, wt FROM w UNION ALL SELECT fold, 'shallow', p1 - obs_dtw, wt FROM w WHERE obs_dtw <= 30),
    s AS (SELECT method, grp, sum(wt * abs(r)) / sum(wt) AS wmad FROM m GROUP BY 1, 2), p AS (SELECT method, max(CASE WHEN grp = 'all' THEN wmad END) AS wmad_all, max(CASE WHEN grp = 'shallow' THEN wmad END) AS wmad_shallow FROM s GROUP BY 1)
    SELECT method, round(wmad_all, 6) AS wmad_all, round(wmad_shallow, 6) AS wmad_shallow, method = (SELECT arg_min(method, wmad_all) FROM p) AS recommended FROM p""",
)
def method_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups' weighted errors side by side, and the method to recommend."""
    rows = predicted(spark, sf_dir).withColumn("method", F.col("fold"))
    groups = stats.overlapping_groups(rows, {"all": F.lit(True), "shallow": F.col("obs_dtw") <= 30})
    scores = groups.groupBy("method", "grp").agg((F.sum(F.col("wt") * F.abs(F.col("p1") - F.col("obs_dtw"))) / F.sum("wt")).alias("wmad"))
    wide = scores.groupBy("method").agg(*[F.max(F.when(F.col("grp") == g, F.col("wmad"))).alias(f"wmad_{g}") for g in ("all", "shallow")])
    best = wide.agg(F.min_by("method", "wmad_all").alias("best"))
    return wide.crossJoin(F.broadcast(best)).select("method", F.round("wmad_all", 6).alias("wmad_all"), F.round("wmad_shallow", 6).alias("wmad_shallow"), (F.col("method") == F.col("best")).alias("recommended"))


@query("fx_wells", _PREDICTED + " SELECT huc, count(*) AS n, round(count(*) FILTER (WHERE abs(p2) <= 10) / count(*), 6) AS captured, round(count(*) FILTER (WHERE p2 IS NULL) / count(*), 6) AS missing, count(*) FILTER (WHERE obs_dtw <= 2) AS le_2, count(*) FILTER (WHERE obs_dtw <= 5) AS le_5, count(*) FILTER (WHERE obs_dtw <= 10) AS le_10 FROM w GROUP BY 1")
def capture_and_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rows captured and missed (of all rows), and counts below a ladder of thresholds."""
    ladder = [F.count_if(F.col("obs_dtw") <= t).alias(f"le_{t}") for t in (2, 5, 10)]
    return predicted(spark, sf_dir).groupBy("huc").agg(F.count("*").alias("n"), F.round(F.count_if(F.abs("p2") <= 10) / F.count("*"), 6).alias("captured"), F.round(F.count_if(F.col("p2").isNull()) / F.count("*"), 6).alias("missing"), *ladder)


@query(
    "fx_wells",
    _PREDICTED
    + ", f AS (SELECT median(p2) AS m FROM w), z AS (SELECT well_id, coalesce(p2, m) AS v, p2 IS NULL AS absent FROM w, f), s AS (SELECT avg(v) AS a, stddev_pop(v) AS d FROM z) SELECT well_id, absent, round((v - a) / CASE WHEN d > 0 THEN d ELSE 1 END, 6) AS z FROM z, s",
)
def standardise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps take the median, then z scores; a flag tells which were gaps."""
    rows = predicted(spark, sf_dir)
    middle = rows.agg(F.median("p2").alias("m"))
    filled = rows.crossJoin(F.broadcast(middle)).select("well_id", F.coalesce("p2", "m").alias("z"), F.col("p2").isNull().alias("absent"))
    return stats.standard_scores(filled, ["z"]).select("well_id", "absent", F.round("z", 6).alias("z"))


@query("fx_wells", "SELECT a.well_id, a.obs_dtw, b.v, a.well_id % 2 = 0 AND b.v IS NULL AS lacking FROM fx_wells a LEFT JOIN (SELECT c_custkey AS well_id, max(c_acctbal) AS v FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1) b USING (well_id) WHERE a.well_id NOT IN (SELECT s_suppkey FROM supplier)")
def shard_join_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values from shards, deduplicated by id, joined to wells; wells in the retirement manifest are kept out."""
    shard = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").groupBy(F.col("c_custkey").alias("well_id")).agg(F.max("c_acctbal").alias("v"))
    retired = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("well_id"))
    rows = view(spark, sf_dir, "fx_wells").join(retired, "well_id", "left_anti").join(shard, "well_id", "left")
    return rows.select("well_id", "obs_dtw", "v", ((F.col("well_id") % 2 == 0) & F.col("v").isNull()).alias("lacking"))


@query(
    "fx_wells",
    """g AS (SELECT *, CAST(floor(x / 2500) AS BIGINT) AS hu, CAST(floor(x / 5000) AS BIGINT) AS parent FROM fx_wells),
    c AS (SELECT hu, count(*) AS n, quantile_cont(obs_dtw, 0.75) AS q FROM g GROUP BY 1), p AS (SELECT parent, quantile_cont(obs_dtw, 0.75) AS q FROM g GROUP BY 1)
    SELECT well_id, round(CASE WHEN c.n >= 190 THEN c.q ELSE p.q END, 6) AS threshold, obs_dtw >= CASE WHEN c.n >= 190 THEN c.q ELSE p.q END AS deep FROM g JOIN c USING (hu) JOIN p USING (parent)""",
)
def deep_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A well is deep above its unit's upper quartile, or above its parent unit's where the unit has few wells."""
    rows = view(spark, sf_dir, "fx_wells").withColumns({"hu": F.floor(F.col("x") / 2500), "parent": F.floor(F.col("x") / 5000)})
    own = rows.groupBy("hu").agg(F.count("*").alias("n"), F.percentile("obs_dtw", F.lit(0.75)).alias("q"))
    above = rows.groupBy("parent").agg(F.percentile("obs_dtw", F.lit(0.75)).alias("pq"))
    limit = F.when(F.col("n") >= 190, F.col("q")).otherwise(F.col("pq"))
    return rows.join(own, "hu").join(above, "parent").select("well_id", F.round(limit, 6).alias("threshold"), (F.col("obs_dtw") >= limit).alias("deep"))


@query("fx_wells", "k AS (SELECT *, row_number() OVER (PARTITION BY floor(x / 3000) ORDER BY CASE WHEN confinement_class <> 'unknown' THEN obs_dtw END NULLS LAST, well_id) AS i FROM fx_wells) SELECT well_id, obs_dtw FROM k WHERE i = 1")
def keep_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row with the smallest value of each group, missing values last."""
    value = F.when(F.col("confinement_class") != "unknown", F.col("obs_dtw"))
    order = Window.partitionBy(F.floor(F.col("x") / 3000)).orderBy(value.asc_nulls_last(), "well_id")
    return view(spark, sf_dir, "fx_wells").withColumn("i", F.row_number().over(order)).where("i = 1").select("well_id", "obs_dtw")


@query(
    "fx_wells",
    "e AS (SELECT quantile_cont(y, [0, 0.25, 0.5, 0.75, 1]) AS q FROM fx_wells), b AS (SELECT unnest([1, 2, 3, 4]) AS k) SELECT b.k AS quartile, count(*) AS n, round(avg(obs_dtw), 6) AS dtw FROM fx_wells, e, b WHERE y >= q[b.k] AND y <= q[b.k + 1] GROUP BY 1",
)
def northing_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quartiles closed at both ends: a row on an edge counts in both."""
    rows = view(spark, sf_dir, "fx_wells")
    edges = rows.agg(F.percentile("y", F.array(*[F.lit(v) for v in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("q"))
    held = F.filter(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.col("y") >= F.get("q", k - 1)) & (F.col("y") <= F.get("q", k)))
    return rows.crossJoin(F.broadcast(edges)).select("obs_dtw", F.explode(held).alias("quartile")).groupBy("quartile").agg(F.count("*").alias("n"), F.round(F.avg("obs_dtw"), 6).alias("dtw"))


@query(
    "fx_wells",
    _PREDICTED
    + """ SELECT well_id, round(greatest(p1, 0), 6) AS clipped, round(1000 - greatest(p1, 0), 6) AS wte, round(exp(-greatest(obs_dtw, 0) / 15.0) * p1 + (1 - exp(-greatest(obs_dtw, 0) / 15.0)) * coalesce(p2, p1), 6) AS blended,
      round(greatest(0.9 * (obs_dtw - p1), (0.9 - 1) * (obs_dtw - p1)), 6) AS pinball, round(1 / (1 + pow((p1 - obs_dtw) / 3.0, 2)), 6) AS cauchy, round(1 / (1 + exp(-(obs_dtw - 20) / 5.0)), 6) AS logistic, CASE WHEN p1 <= 2 THEN '<=2' WHEN p1 <= 5 THEN '2-5' WHEN p1 <= 20 THEN '5-20' ELSE '>20' END AS band FROM w""",
)
def residual_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping, consistent elevations, gate blending, losses and right-closed bands."""
    c = F.col
    rows = predicted(spark, sf_dir)
    inf = float("inf")
    return rows.select(
        "well_id",
        F.round(F.greatest(c("p1"), F.lit(0.0)), 6).alias("clipped"),
        F.round(1000 - F.greatest(c("p1"), F.lit(0.0)), 6).alias("wte"),
        F.round(hydro.gate_blend(c("obs_dtw"), 15.0, c("p1"), F.coalesce("p2", "p1")), 6).alias("blended"),
        F.round(hydro.pinball(c("obs_dtw"), c("p1"), 0.9), 6).alias("pinball"),
        F.round(hydro.cauchy_weight(c("p1") - c("obs_dtw"), 3.0), 6).alias("cauchy"),
        F.round(hydro.logistic(c("obs_dtw"), 20.0, 5.0), 6).alias("logistic"),
        right_closed(c("p1"), [-inf, 2, 5, 20, inf], ["<=2", "2-5", "5-20", ">20"]).alias("band"),
    )


@query("fx_wells", "SELECT a.well_id, greatest(coalesce(m.v, 0), 0) AS covered, m.v AS lowest FROM fx_wells a LEFT JOIN (SELECT well_id, min(v) AS v FROM (SELECT well_id, obs_dtw AS v FROM fx_wells WHERE x < 9000 UNION ALL SELECT well_id, obs_dtw * 0.8 FROM fx_wells WHERE y < 9000) GROUP BY 1) m USING (well_id)")
def lowest_of_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum over all rasters that cover a point, null where none does."""
    value = F.least(F.when(F.col("x") < 9000, F.col("obs_dtw")), F.when(F.col("y") < 9000, F.col("obs_dtw") * 0.8))
    return view(spark, sf_dir, "fx_wells").select("well_id", F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)).alias("covered"), value.alias("lowest"))


@query(
    "fx_wells",
    _PREDICTED
    + """, q AS (SELECT fold, wt, p2 AS p, obs_dtw AS o, p2 - obs_dtw AS e FROM w WHERE p2 IS NOT NULL),
    s AS (SELECT fold, count(*) AS n, median(abs(e)) AS mad, sum(wt * abs(e)) / sum(wt) AS wmad, median(e) AS bias, sum(wt * e) / sum(wt) AS mean_bias, sqrt(sum(wt * e * e) / sum(wt)) AS rmse, count(*) FILTER (WHERE p < 20 AND o < 20) AS tp, count(*) FILTER (WHERE o < 20) AS n_obs_shallow, count(*) FILTER (WHERE p < 20) AS n_pred_shallow FROM q GROUP BY 1),
    r AS (SELECT *, tp / greatest(n_obs_shallow, 1) AS rc, tp / greatest(n_pred_shallow, 1) AS pr FROM s)
    SELECT fold, n, round(mad, 6) AS mad, round(wmad, 6) AS wmad, round(bias, 6) AS bias, round(mean_bias, 6) AS mean_bias, round(rmse, 6) AS rmse, n_obs_shallow, n_pred_shallow, round(rc, 6) AS shallow_recall, round(pr, 6) AS shallow_precision, round(coalesce(2 * rc * pr / nullif(rc + pr, 0), 0), 6) AS shallow_f1 FROM r""",
)
def shallow_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scores of a product per fold, with the harmonic mean of recall and precision."""
    out = stats.shallow_scores(predicted(spark, sf_dir), ["fold"], "p2", "obs_dtw", "wt", 20.0)
    return out.withColumns({c: F.round(c, 6) for c, kind in out.dtypes if kind == "double"})


@query(
    "fx_wells",
    _PREDICTED
    + """, t AS (SELECT unnest([2.0::DOUBLE, 5.0::DOUBLE, 10.0::DOUBLE]) AS threshold), s AS (SELECT threshold, count(*) FILTER (WHERE p2 < threshold AND obs_dtw < threshold) AS tp, count(*) FILTER (WHERE p2 < threshold) AS np, count(*) FILTER (WHERE obs_dtw < threshold) AS n_obs_shallow FROM w, t WHERE p2 IS NOT NULL GROUP BY 1)
    SELECT threshold, round(tp / nullif(np, 0), 6) AS precision, round(tp / nullif(n_obs_shallow, 0), 6) AS recall, n_obs_shallow FROM s""",
)
def shallow_skill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall of shallow water at three depths."""
    return stats.shallow_skill(predicted(spark, sf_dir), "p2", "obs_dtw").withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query("fx_wells", _PREDICTED + " SELECT well_id, round(CASE WHEN p2 * 2 + 1 >= 30 THEN p1 ELSE p2 * 2 + 1 END, 6) AS dtw, coalesce(p2 * 2 + 1 >= 30, false) AS gated FROM w")
def regime_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised predictions brought back to depths; deep ones take the other head's."""
    depth = F.col("p2") * 2 + 1
    deep = F.coalesce(depth >= 30, F.lit(False))
    return predicted(spark, sf_dir).select("well_id", F.round(F.when(deep, F.col("p1")).otherwise(depth), 6).alias("dtw"), deep.alias("gated"))


@query("fx_wells", _PREDICTED + " SELECT w.well_id, fold, round(p2, 6) AS p2, 's' || CAST(w.well_id % 3 AS VARCHAR) AS source FROM w WHERE p2 IS NOT NULL")
def asserted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates with their predictions and labels: a well without a label would be an error."""
    rows = predicted(spark, sf_dir)
    covariates, folds = rows.select("well_id", "fold"), rows.where("p2 is not null").select("well_id", "p2")
    labels = rows.select("well_id", F.concat(F.lit("s"), (F.col("well_id") % 3).cast("string")).alias("source"))
    return stats.asserted_join(covariates.join(folds, "well_id"), labels, "well_id", "source").withColumn("p2", F.round("p2", 6))


@query("fx_wells", _PREDICTED + """ SELECT '{"n_rows":' || CAST(count(*) AS VARCHAR) || ',"known":{"p1":' || CAST(count(p1) AS VARCHAR) || ',"p2":' || CAST(count(p2) AS VARCHAR) || '}}' AS manifest FROM w""")
def coverage_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of a feature table know each feature."""
    return stats.manifest(predicted(spark, sf_dir), ["p1", "p2"])


@query("fx_wells", "e AS (SELECT quantile_cont(obs_dtw, 0.02) AS a, quantile_cont(obs_dtw, 0.98) AS b FROM fx_wells) SELECT well_id, round(least(greatest((obs_dtw - a) / (b - a), 0), 1), 6) AS obs_dtw FROM fx_wells, e")
def unit_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values between two percentiles stretched to 0 and 1."""
    return stats.unit_range(view(spark, sf_dir, "fx_wells").select("well_id", "obs_dtw"), "obs_dtw", 0.02, 0.98).withColumn("obs_dtw", F.round("obs_dtw", 6))


@query(
    "",
    """w AS (SELECT c_custkey AS well_id, CASE c_custkey % 3 WHEN 0 THEN 'unconfined' WHEN 1 THEN 'unconfined_marginal' ELSE 'confined' END AS confinement_class, CASE WHEN c_custkey % 11 <> 0 THEN c_acctbal / 8 END AS mean_dtw, CAST(c_custkey % 80 AS DOUBLE) - 140 AS longitude, CAST(c_custkey % 40 AS DOUBLE) + 15 AS latitude FROM customer)
    SELECT well_id, round(mean_dtw, 6) AS mean_dtw FROM w WHERE confinement_class IN ('unconfined', 'unconfined_marginal') AND mean_dtw >= 0 AND mean_dtw < 1000 AND longitude BETWEEN -125 AND -66 AND latitude BETWEEN 24 AND 50""",
)
def admitted_wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wells whose class, depth and place make them usable."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("well_id"),
        F.when(k % 3 == 0, "unconfined").when(k % 3 == 1, "unconfined_marginal").otherwise("confined").alias("confinement_class"),
        F.when(k % 11 != 0, F.col("c_acctbal").cast("double") / 8).alias("mean_dtw"),
        ((k % 80).cast("double") - 140).alias("longitude"),
        ((k % 40).cast("double") + 15).alias("latitude"),
    )
    return wells.admitted(rows).select("well_id", F.round("mean_dtw", 6).alias("mean_dtw"))
