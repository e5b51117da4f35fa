"""Field classification: relative elevation, stream type, irrigation record, pattern candidates and their promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Feature codes of the national hydrography by stream type (pipelines and all other codes have none), and
#: the codes that are left out before a surface is made.
STREAM_TYPE_OF_CODE = {"perennial": [46006, 55800], "intermittent": [46000, 46003, 46007], "managed": [33400, 33600, 33601, 33602, 33603, 46800]}
CODES_WITHOUT_SURFACE = [33601, 46007]
#: The code of perennial streams, the type of natural ones, and types that are no streams of their own.
PERENNIAL_CODE = 46006
NATURAL_TYPE = "streamriver"
ARTIFICIAL_TYPES = ["artificialpath", "canalditch"]


def map_codes(code: Column, classes: dict[str, list[int]], other: str | None = None) -> Column:
    """The class of a code; unmapped codes are `other`."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, codes in classes.items():
        out = out.when(code.isin(codes), name)
    return out.otherwise(F.lit(other).cast("string"))


def filter_flowlines(lines: DataFrame, code: str | None = None, kind: str | None = None, natural_perennial: bool = False, exclude_artificial: bool = False) -> DataFrame:
    """Flowlines kept by what columns there are: perennial ones by their code, or natural ones by their type only where no
    code column is named; and, apart from that, without the artificial types. A null code is not perennial; a null type
    is not artificial. Types are compared in any case."""
    out = lines
    if natural_perennial and code:
        out = out.where(F.col(code) == PERENNIAL_CODE)
    elif natural_perennial and kind:
        out = out.where(F.lower(kind) == NATURAL_TYPE)
    if exclude_artificial and kind:
        out = out.where(~F.coalesce(F.lower(kind).isin(ARTIFICIAL_TYPES), F.lit(False)))
    return out


def stratify(fields: DataFrame, threshold: float = 2.0) -> DataFrame:
    """Adds partitioned (relative elevation below the threshold; unknown is not) and strata."""
    low = F.coalesce(F.col("rem_mean") < threshold, F.lit(False))
    known = F.col("nearest_stream_type").isin("perennial", "intermittent", "managed")
    return fields.withColumn("partitioned", low).withColumn("strata", F.when(~low, "non_partitioned").when(known, F.col("nearest_stream_type")).otherwise("intermittent"))


def pattern_candidates(fields: DataFrame, max_freq: float = 0.1, max_mean: float = 0.05) -> DataFrame:
    """Adds pattern, and for candidates the evidence as text."""
    is_pattern = F.coalesce((F.col("irr_freq") <= max_freq) & (F.col("irr_mean") <= max_mean), F.lit(False))
    evidence = F.concat_ws("; ", F.format_string("freq=%.2f", "irr_freq"), F.format_string("mean=%.2f", "irr_mean"))
    return fields.withColumn("pattern", is_pattern).withColumn("pattern_evidence", F.when(is_pattern, evidence).otherwise(""))


def promote(fields: DataFrame, least: int = 1) -> DataFrame:
    """Fields of a stratum with the lowest irrigation frequency become pattern fields until it has `least` of them.
    Fields that are not partitioned are left alone; ties go by the lower fid."""
    by = Window.partitionBy("strata")
    rank = F.row_number().over(by.orderBy("pattern", F.col("irr_freq").asc_nulls_last(), "fid"))  # candidates to promote come first
    missing = F.lit(least) - F.count_if("pattern").over(by)
    promoted = (F.col("strata") != "non_partitioned") & ~F.col("pattern") & (F.col("__rank") <= F.col("__missing"))
    return fields.withColumns({"__rank": rank, "__missing": missing}).withColumn("pattern", F.col("pattern") | promoted).drop("__rank", "__missing")


def irrigation_stats(wide: DataFrame, key: str, prefix: str = "irr_", above: float = 0.1) -> DataFrame:
    """Per field: mean over the years that have a value, years above the limit, all years, and their ratio."""
    years = [c for c in wide.columns if c.startswith(prefix)]
    long = wide.unpivot(key, years, "name", "v")  # keeps nulls
    return long.groupBy(key).agg(F.avg("v").alias("irr_mean"), F.count_if(F.col("v") > above).alias("n_irr_years"), F.count("*").alias("n_years")).withColumn("irr_freq", F.col("n_irr_years") / F.col("n_years"))
