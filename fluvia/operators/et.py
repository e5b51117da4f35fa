"""Evapotranspiration: water-year sums, donor-based partition, monthly fractions, monthly values spread over days."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fluvia.functions.hydro import days_in_month, water_year
from fluvia.operators.spatial import nearest_k


def annual_sums(daily: DataFrame) -> DataFrame:
    """Per field and water year: aet, eto, prcp (missing counts as 0), pe = min(prcp, aet), et_gwsm and etf_gwsm."""
    sums = daily.groupBy("fid", water_year(F.col("d")).alias("water_year")).agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in ("aet", "eto", "prcp")])
    sums = sums.withColumn("pe", F.least("prcp", "aet")).withColumn("et_gwsm", F.col("aet") - F.col("pe"))
    return sums.withColumn("etf_gwsm", F.try_divide("et_gwsm", "eto"))


def donors(fields: DataFrame) -> DataFrame:
    """(fid, donor_fid): the nearest pattern field of the same stratum. A stratum without any is an error."""
    used = fields.where("strata <> 'non_partitioned'")
    lacking = used.groupBy("strata").agg(F.count_if("pattern").alias("n")).where("n = 0")
    if not lacking.isEmpty():
        raise ValueError("a stratum has no pattern field")
    left = used.select("fid", "strata", F.col("cx").alias("x"), F.col("cy").alias("y"))
    right = used.where("pattern").select(F.col("fid").alias("donor_fid"), "strata", F.col("cx").alias("rx"), F.col("cy").alias("ry"))
    return nearest_k(left, right, "fid", "donor_fid", 1, on=["strata"]).select("fid", "donor_fid")


def partition_water_years(daily: DataFrame, pairs: DataFrame) -> DataFrame:
    """Splits each field's evapotranspiration by its donor's groundwater and soil-moisture fraction of the same year.
    A year that the donor lacks gives nulls, which are not clamped."""
    annual = annual_sums(daily)
    of_donor = annual.select(F.col("fid").alias("donor_fid"), "water_year", F.col("etf_gwsm").alias("donor_etf"))
    joined = annual.select("fid", "water_year", "aet", "eto", "prcp", "pe").join(pairs, "fid").join(of_donor, ["donor_fid", "water_year"], "left")
    split = joined.withColumn("gwsm", F.col("donor_etf") * F.col("eto")).withColumn("irr", F.col("aet") - F.col("gwsm") - F.col("pe"))
    negative = F.coalesce(F.col("irr") < 0, F.lit(False))
    split = split.withColumn("et_gwsm", F.when(negative, F.col("aet") - F.col("pe")).otherwise(F.col("gwsm"))).withColumn("et_irr", F.when(negative, 0.0).otherwise(F.col("irr")))
    return split.withColumn("etf_used", F.try_divide("et_gwsm", "eto")).select("fid", "water_year", "donor_fid", "aet", "eto", "pe", "et_gwsm", "et_irr", "etf_used")


def monthly_fractions(daily: DataFrame) -> DataFrame:
    """(fid, month, water_year, fdisag): each month's share of the water year's net demand, both clipped at 0; months
    without data between a field's first and last have share 0, and so has every month of a year without demand."""
    net = F.coalesce(F.col("aet"), F.lit(0.0)) - F.coalesce(F.col("prcp"), F.lit(0.0))
    known = F.col("aet").isNotNull() & F.col("prcp").isNotNull()
    rows = daily.select("fid", "d", F.when(known, net).otherwise(0.0).alias("net"))
    month = F.trunc("d", "month")
    spine = rows.groupBy("fid").agg(F.min(month).alias("a"), F.max(month).alias("b")).select("fid", F.explode(F.sequence("a", "b", F.expr("interval 1 month"))).alias("month"))
    monthly = rows.groupBy("fid", month.alias("month")).agg(F.sum("net").alias("m"))
    yearly = rows.groupBy("fid", water_year(F.col("d")).alias("water_year")).agg(F.sum("net").alias("y"))
    zero = F.lit(0.0)
    out = spine.join(monthly, ["fid", "month"], "left").withColumn("water_year", water_year(F.col("month"))).join(yearly, ["fid", "water_year"], "left")
    share = F.coalesce(F.try_divide(F.greatest(F.coalesce("m", zero), zero), F.greatest(F.coalesce("y", zero), zero)), zero)
    return out.select("fid", "month", "water_year", share.alias("fdisag"))


def partition_months(daily: DataFrame, pairs: DataFrame) -> DataFrame:
    """The water-year partition spread over months by their fractions."""
    annual = partition_water_years(daily, pairs).select("fid", "water_year", "donor_fid", "et_gwsm", "et_irr")
    months = monthly_fractions(daily).join(annual, ["fid", "water_year"])
    return months.select("month", "water_year", "fid", "donor_fid", "fdisag", (F.col("fdisag") * F.col("et_gwsm")).alias("et_gwsm_m"), (F.col("fdisag") * F.col("et_irr")).alias("et_irr_m"))


def spread_months(daily: DataFrame, monthly: DataFrame) -> DataFrame:
    """Replaces aet of a daily table by the month's total divided by the month's days. monthly: fid, year, month, total."""
    keyed = daily.drop("aet").withColumns({"year": F.year("d"), "month": F.month("d")})
    return keyed.join(monthly, ["fid", "year", "month"], "left").withColumn("aet", F.col("total") / days_in_month(F.col("d"))).drop("total")


def daily_by_centroid(fields: DataFrame, centroids: DataFrame, daily: DataFrame, start: str, end: str) -> DataFrame:
    """(fid, gfid, distance_m, and daily's columns): each field's days between the dates (both included) from the grid point
    nearest to its centre; ties go to the lower gfid. Fields share a grid point's days, which are read once.

    fields: fid, cx, cy; centroids: gfid, gx, gy; daily: gfid, d and values. A field of which no day is known has one row
    with null values."""
    near = nearest_k(fields.select("fid", "cx", "cy"), centroids, "fid", "gfid", 1, xy=("cx", "cy"), rxy=("gx", "gy")).select("fid", "gfid", "distance_m")
    days = daily.where(F.col("d").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    return near.join(days, "gfid", "left")
