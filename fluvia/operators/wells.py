"""Well tables: admission, labels from readings, tiers, collapse of duplicates, site and grid aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvia.functions.hydro import decimal_year
from fluvia.operators.stats import theil_sen

#: Location classes by rank, and those that place a well well enough; classes of confinement; depths in
#: metres that guard a label; weights of the tiers; months of the spring and fall medians.
ACCURACY_RANK = {"survey_gps": 4, "gps": 3, "map": 2, "plss": 1, "unknown": 0}
GOOD_LOCATION = ["survey_gps", "gps", "map"]
CONFINED = ["confined", "likely_confined", "artesian"]
UNCONFINED = ["unconfined", "unconfined_marginal"]
SANE_DTW = (-10.0, 500.0)
SHALLOW_M, DEEP_SCREEN_M, DEEP_WATER_M, ARTESIAN_M, SANE_DEPTH_M = 30.0, 60.0, 60.0, -1.0, 5000.0
WEIGHTS = {"monitoring": 1.0, "primary": 0.6, "secondary": 0.25, "diagnostic": 0.0}
SPRING_MONTHS = [4, 5, 6]
FALL_MONTHS = [9, 10]


def in_window(wells: DataFrame, box: tuple[float, float, float, float], classes: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """Wells in a box (inclusive) of certain confinement classes with a known depth; a list of sources to include
    overrides one to exclude."""
    x0, y0, x1, y1 = box
    out = wells.where(F.col("x").between(x0, x1) & F.col("y").between(y0, y1) & F.col("confinement_class").isin(classes) & F.col("dtw").isNotNull())
    if include:
        return out.where(F.col("source").isin(include))
    return out.where(~F.col("source").isin(exclude)) if exclude else out


def series_labels(readings: DataFrame, key: str = "station") -> DataFrame:
    """Medians of a well's readings over all, over 2019-2024, over spring, fall and its latest five years; the latest
    reading; the driller's; and a robust trend where the record has at least five different years."""
    year, month = F.year("ts"), F.month("ts")
    rows = readings.where("dtw is not null").withColumns({"year": year, "month": month})
    rows = rows.withColumn("last", F.max("year").over(Window.partitionBy(key)))

    def median(condition: Column) -> Column:
        return F.median(F.when(condition, F.col("dtw")))

    out = rows.groupBy(key).agg(
        F.count("*").alias("n_obs_used"),
        F.count_distinct("year").alias("n_years"),
        F.min(F.to_date("ts")).alias("date_min"),
        F.max(F.to_date("ts")).alias("date_max"),
        F.median("dtw").alias("dtw_all_median"),
        median(F.col("year").between(2019, 2024)).alias("dtw_2019_2024_median"),
        median(F.col("month").isin(SPRING_MONTHS)).alias("dtw_spring_median"),
        median(F.col("month").isin(FALL_MONTHS)).alias("dtw_fall_median"),
        median(F.col("year") >= F.col("last") - 4).alias("dtw_latest5_median"),
        F.max_by("dtw", F.struct("ts", "event_id")).alias("latest_dtw"),
        F.max_by("method", F.struct("ts", "event_id")).alias("latest_method"),
        F.min_by("dtw", F.when(F.col("method") == "driller_report", F.col("event_id"))).alias("driller_dtw"),
    )
    return out.withColumn("is_timeseries", F.col("n_years") >= 2)


def series_trends(readings: DataFrame, key: str = "station", least_years: int = 5) -> DataFrame:
    rows = readings.where("dtw is not null").withColumn("t", decimal_year(F.to_date("ts")))
    enough = rows.groupBy(key).agg(F.count_distinct(F.year("ts")).alias("n")).where(F.col("n") >= least_years).select(key)
    return theil_sen(rows.join(enough, key, "left_semi"), [key], "t", "dtw")


def picked_label(static_only: Column) -> Column:
    """The one label of a well with its kind, period and whether it is suspect, from the columns of series_labels."""
    c = F.col
    series = (
        F.when(c("dtw_2019_2024_median").isNotNull(), F.struct(c("dtw_2019_2024_median").alias("value"), F.lit("ts_2019_2024_median").alias("kind"), F.lit("2019-2024").alias("period")))
        .when(c("dtw_latest5_median").isNotNull(), F.struct(c("dtw_latest5_median").alias("value"), F.lit("ts_latest5_median").alias("kind"), F.lit("latest5").alias("period")))
        .otherwise(F.struct(c("dtw_all_median").alias("value"), F.lit("ts_all_median").alias("kind"), F.lit("all").alias("period")))
    )
    first, last = c("date_min").cast("string"), c("date_max").cast("string")
    single = (
        F.when(c("driller_dtw").isNotNull() & (static_only | (c("n_years") <= 1)), F.struct(c("driller_dtw").alias("value"), F.lit("static_driller_report").alias("kind"), first.alias("period")))
        .when(c("latest_dtw").isNotNull(), F.struct(c("latest_dtw").alias("value"), F.lit("static_manual").alias("kind"), last.alias("period")))
        .otherwise(F.struct(c("dtw_all_median").alias("value"), F.lit("static_single").alias("kind"), first.alias("period")))
    )
    return F.when(c("is_timeseries"), series).otherwise(single)


def suspect(label: Column) -> Column:
    value = label["value"]
    return (label["kind"] == "static_single") & label["period"].isNull() | value.isNull() | ~F.coalesce(value.between(*SANE_DTW), F.lit(False))


def override_class(monitoring_source: str | None) -> Column:
    """Of a group of records: monitoring if so tagged (or from that source with a series), else the commonest class."""
    tagged = F.bool_or(F.coalesce((F.col("well_use") == "monitoring") | (F.col("well_class") == "monitoring"), F.lit(False)))
    named = F.bool_or(F.col("source") == F.lit(monitoring_source)) & F.bool_or("has_time_series") if monitoring_source else F.lit(False)
    return F.when(tagged | named, "monitoring").otherwise(F.mode("well_class", True))


def tier() -> Column:
    """Tier, weight and reason of a labelled well: the first guard that it fails makes it diagnostic."""
    c = F.col
    known = F.coalesce((c("well_depth") > 0) & (c("well_depth") <= SANE_DEPTH_M), F.lit(False))
    unconfined = F.coalesce(c("confinement_class").isin(UNCONFINED), F.lit(False))
    confined = F.coalesce(c("confinement_class").isin(CONFINED), F.lit(False))
    unknown = F.coalesce(c("confinement_class"), F.lit("")).isin("", "unknown")

    def diagnostic(reason: str) -> Column:
        return F.struct(F.lit("diagnostic").alias("tier"), F.lit(WEIGHTS["diagnostic"]).alias("weight"), F.lit(reason).alias("exclusion_reason"))

    def accepted(name: str, weight: Column) -> Column:
        return F.struct(F.lit(name).alias("tier"), weight.alias("weight"), F.lit("").alias("exclusion_reason"))

    series = F.coalesce(c("has_time_series"), F.lit(False))
    return (
        F.when(c("value").isNull() | c("suspect"), diagnostic("no_usable_dtw"))
        .when(confined, diagnostic("confined_aquifer"))
        .when(c("value") < ARTESIAN_M, diagnostic("artesian_above_surface"))
        .when(known & (c("value") > c("well_depth")), diagnostic("dtw_below_well_bottom"))
        .when((c("value") > DEEP_WATER_M) & ~unconfined, diagnostic("deep_water_nonphreatic"))
        .when(F.coalesce(c("screen_top") > DEEP_SCREEN_M, F.lit(False)), diagnostic("deep_screen_nonphreatic"))
        .when(F.coalesce(c("override_class") == "pumping", F.lit(False)), diagnostic("pumping_well"))
        .when(~F.coalesce(c("h_accuracy_class").isin(GOOD_LOCATION), F.lit(False)), diagnostic("poor_location"))
        .when(F.coalesce(c("override_class") == "monitoring", F.lit(False)), accepted("primary", F.when(series, WEIGHTS["monitoring"]).otherwise(WEIGHTS["primary"])))
        .when(unconfined | (unknown & known & (c("well_depth") <= SHALLOW_M)) | series, accepted("primary", F.lit(WEIGHTS["primary"])))
        .otherwise(accepted("secondary", F.lit(WEIGHTS["secondary"])))
    )


def collapse(records: DataFrame, key: str = "canonical_id") -> DataFrame:
    """One row per well from all its records: the best located one represents it, other columns take the first known
    value in that order, ids are joined, flags combined. One shuffle."""
    rank = F.lit(0)
    for name, value in ACCURACY_RANK.items():
        rank = F.when(F.col("h_accuracy_class") == name, value).otherwise(rank)
    order = F.struct(-rank, F.col("source_well_id"))

    def first_known(column: str) -> Column:
        return F.min_by(column, F.when(F.col(column).isNotNull(), order)).alias(column)

    return records.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "source", F.col("source_well_id").cast("string")))), ";").alias("source_ids"),
        F.count("*").alias("n_members"),
        F.array_join(F.array_sort(F.collect_set("source")), ";").alias("sources"),
        F.min_by("h_accuracy_class", order).alias("h_accuracy_class"),
        F.min_by("confinement_class", order).alias("confinement_class"),
        first_known("well_class"),
        first_known("well_depth"),
        first_known("screen_top"),
        override_class("src1").alias("override_class"),
        F.bool_or("has_time_series").alias("has_time_series"),
        F.bool_and("is_static_only").alias("is_static_only"),
    )


def dedup_sites(wells: DataFrame, digits: int = 6) -> DataFrame:
    """Wells at one rounded place become a site: median depth, summed observations, the label of the first priority, and
    whether labels conflict."""
    return wells.groupBy(F.round("x", digits).alias("x"), F.round("y", digits).alias("y")).agg(
        F.median("dtw").alias("dtw"), F.sum("n_obs").alias("n_obs"), F.max("last_date").alias("last_date"), F.min_by("label", F.struct("priority", "well_id")).alias("label"), (F.count_distinct("label") > 1).alias("conflict"), F.count("*").alias("n_wells")
    )


def to_grid(wells: DataFrame, size: float, cap: int = 10) -> DataFrame:
    """Per grid cell: median depth, wells, their capped weight, and the ids used."""
    return wells.groupBy(F.floor(F.col("x") / size).alias("col"), F.floor(F.col("y") / size).alias("row")).agg(
        F.median("obs_dtw").alias("dtw"), F.count("*").alias("n"), F.least(F.count("*"), F.lit(cap)).alias("weight"), F.array_join(F.transform(F.array_sort(F.collect_list("well_id")), lambda i: i.cast("string")), ",").alias("well_ids")
    )


def cleaned(text: Column) -> Column:
    """A number from text; what is none, or not finite, is null."""
    number = text.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


# What makes a depth to water usable, and where.
ADMITTED_CLASSES = ("unconfined", "unconfined_marginal")
DEEPEST_DTW = 1000.0
LAND_BOX = (-125.0, 24.0, -66.0, 50.0)


def admitted(rows: DataFrame, depth: str = "mean_dtw", box: tuple[float, float, float, float] = LAND_BOX) -> DataFrame:
    """Wells of unconfined classes with a known depth of at least 0 and below DEEPEST_DTW, and with known coordinates within
    the box (west, south, east, north; borders included)."""
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    west, south, east, north = box
    usable = F.col("confinement_class").isin(*ADMITTED_CLASSES) & known(depth) & (F.col(depth) >= 0) & (F.col(depth) < DEEPEST_DTW)
    return rows.where(usable & known("longitude") & known("latitude") & F.col("longitude").between(west, east) & F.col("latitude").between(south, north))
