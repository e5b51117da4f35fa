"""Point-by-year tables, their summaries, sampling, and background estimation from donor neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvia.functions.binning import left_closed
from fluvia.lineage import cut
from fluvia.operators.spatial import nearest_k
from fluvia.operators.stats import weighted_quantiles

#: Edges in metres above the stream surface, left-closed, and their labels.
REM_EDGES = [0.0, 1.0, 2.0, 5.0, 10.0, float("inf")]
REM_LABELS = ["0-1 m", "1-2 m", "2-5 m", "5-10 m", ">10 m"]


@dataclass(frozen=True)
class DonorRules:
    """Thresholds of the donor search. The defaults."""

    min_valid_years: int = 10
    year_max_irrigation: float = 0.1
    max_irrigation: float = 0.15
    max_irrigation_std: float = 0.3
    least_edge_m: float = 100.0
    managed_m: float = 500.0
    perennial_m: float = 500.0
    intermittent_m: float = 1000.0
    radius_m: float = 10_000.0
    candidates: int = 50
    rem_tolerance_m: float = 2.0
    sigma_rem_m: float = 1.0
    sigma_distance_m: float = 3_000.0
    peak_tolerance: float = 0.15
    amplitude_tolerance: float = 0.10
    purity_power: float = 2.0
    sigma_etf_std: float = 0.15
    sigma_ndvi_std: float = 0.08
    top_k: int = 7
    least_donors: int = 3
    trim: float = 0.1
    least_effective: float = 2.5
    most_weight: float = 0.5
    most_gap: float = 0.05


def rem_bin(value: Column) -> Column:
    return left_closed(value, REM_EDGES, REM_LABELS, "nan")


def hydro_class(rules: DonorRules = DonorRules()) -> Column:
    """The stream setting of a point; of several that hold, managed wins over perennial over intermittent."""
    return F.when(F.col("dist_managed_m") <= rules.managed_m, "managed_corridor").when(F.col("dist_perennial_m") <= rules.perennial_m, "perennial_corridor").when(F.col("dist_intermittent_m") <= rules.intermittent_m, "intermittent_corridor").otherwise("off_corridor")


def nearest_stream(points: DataFrame) -> DataFrame:
    """Adds nearest_stream_type and stream_distance, from the distances by type; of equal ones the first named wins."""
    kinds = ["perennial", "intermittent", "managed"]
    nearest = F.array_min(F.filter(F.array(*[F.struct(F.col(f"dist_{k}_m").alias("d"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, k in enumerate(kinds)]), lambda x: x["d"].isNotNull()))
    return points.withColumns({"nearest_stream_type": nearest["k"], "stream_distance": nearest["d"]})


def assemble_point_years(points: DataFrame, irr: DataFrame, ndvi: DataFrame, et: DataFrame, climate: DataFrame) -> DataFrame:
    """Every point in every year that the first three tables name (the climate table adds none), with what each holds.
    Long tables keyed by point_id and year; the joins share the partitioning by that key."""
    years = irr.select("year").unionByName(ndvi.select("year")).unionByName(et.select("year")).distinct()
    out = points.select("point_id").crossJoin(F.broadcast(years))
    for part in (irr, ndvi, et, climate):
        out = out.join(part, ["point_id", "year"], "left")
    return out


def valid_flags(table: DataFrame) -> DataFrame:
    """Adds etf, net_et and the validity of each source; unknown counts as not valid."""
    out = table.withColumn("etf", F.when(F.col("eto_gs") > 0, F.col("aet_gs") / F.col("eto_gs"))).withColumn("net_et", F.col("aet_annual") - F.col("pr_annual"))
    out = out.withColumns({"irr_valid": F.col("irr_class").isNotNull(), "ndvi_valid": F.col("ndvi_peak_gs").isNotNull(), "et_valid": F.col("aet_gs").isNotNull()})
    return out.withColumn("feature_valid", F.col("irr_valid") & F.col("ndvi_valid") & F.col("et_valid"))


def month_sums(wide: DataFrame, key: str, prefix: str = "eta_") -> DataFrame:
    """From columns prefix_YYYY_MM: per point and year the months with a value, their sum (null if none), and the same
    for the growing season from April to October."""
    long = wide.unpivot(key, [c for c in wide.columns if c.startswith(prefix)], "name", "v")
    parts = F.split(F.substring("name", len(prefix) + 1, 7), "_")
    long = long.select(key, parts[0].cast("int").alias("year"), parts[1].cast("int").alias("month"), "v")
    season = F.col("month").between(4, 10)
    return long.groupBy(key, "year").agg(F.count("v").alias("aet_n_months"), F.sum("v").alias("aet_annual"), F.count(F.when(season, F.col("v"))).alias("aet_gs_n_months"), F.sum(F.when(season, F.col("v"))).alias("aet_gs"))


def summarize(years: DataFrame) -> DataFrame:
    """One row per point over its years; each mean is over the years in which its own source is valid."""

    def where(flag: str, column: str) -> Column:
        return F.when(F.col(flag), F.col(column))

    return years.groupBy("point_id").agg(
        F.count("*").alias("n_years"),
        F.count_if("feature_valid").alias("valid_years"),
        F.avg(where("irr_valid", "irr_class")).alias("irr_freq"),
        F.stddev_samp(where("irr_valid", "irr_class")).alias("irr_frac_std"),
        F.count_if(F.coalesce(where("irr_valid", "irr_class") >= 0.5, F.lit(False))).alias("n_irr_years"),
        F.avg(where("et_valid", "aet_gs")).alias("aet_mean"),
        F.stddev_samp(where("et_valid", "aet_gs")).alias("aet_std"),
        F.avg(where("et_valid", "eto_gs")).alias("eto_gs_mean"),
        F.avg(where("et_valid", "pr_annual")).alias("prcp_mean"),
        F.avg(where("et_valid", "etf")).alias("etf_mean"),
        F.stddev_samp(where("et_valid", "etf")).alias("etf_std"),
        F.avg(where("et_valid", "net_et")).alias("net_et_mean"),
        F.avg(where("ndvi_valid", "ndvi_amp_gs")).alias("ndvi_amp_mean"),
        F.avg(where("ndvi_valid", "ndvi_peak_gs")).alias("ndvi_peak_mean"),
        F.stddev_samp(where("ndvi_valid", "ndvi_amp_gs")).alias("ndvi_amp_std"),
    )


def sample_masks(points: DataFrame, low: float = 2.0, riparian: float = 250.0, edge: float = 60.0, high: float = 5.0) -> DataFrame:
    """Adds the target flags; a value that is missing or infinite satisfies none of them. Riparian is what lies near a stream
    of a known type: nearest_stream_type and stream_distance must be there."""
    rem = F.col("rem_at_sample")
    valid = F.coalesce(rem.isNotNull() & ~F.isnan(rem) & (F.abs(rem) < float("inf")), F.lit(False))
    near = F.col("nearest_stream_type").isin("perennial", "intermittent", "managed") & (F.col("stream_distance") <= riparian)
    flags = {"valid": valid, "is_low_rem_target": valid & (rem < low), "is_riparian_target": valid & near, "is_field_edge_target": valid & (F.col("dist_field_edge_m") <= edge), "is_high_rem_control": valid & (rem > high)}
    return points.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in flags.items()})


def stratified_sample(points: DataFrame, groups: list[tuple[str, int]], seed: int = 7) -> DataFrame:
    """Draws each group's number of points in turn, none twice: ordered by a hash, rank within the group. Adds
    sample_group, the draw weight (eligible over taken), and ids in the order of point_id. A point may belong to several
    groups; it goes to the first that takes it. One window per group, over the points left."""
    taken = None
    order = F.pmod(F.col("point_id") * 7919 + seed, F.lit(100_003))
    for flag, size in groups:
        rest = points.where(flag)
        if taken is not None:
            rest = rest.join(taken.select("point_id"), "point_id", "left_anti")
        eligible = rest.agg(F.count("*").alias("eligible"))
        drawn = rest.orderBy(order, "point_id").limit(size).crossJoin(F.broadcast(eligible))
        drawn = drawn.withColumn("sample_group", F.lit(flag)).withColumn("sampling_weight", F.col("eligible") / F.least("eligible", F.lit(size))).drop("eligible")
        drawn = cut(drawn)  # later groups look at what is taken already
        taken = drawn if taken is None else taken.unionByName(drawn)
    return taken


def exclusion_reason(rules: DonorRules, target: str = "etf") -> Column:
    """The first hard filter that a donor year fails, or null; an unknown value passes none."""

    def fails(passed: Column) -> Column:
        return ~F.coalesce(passed, F.lit(False))

    return (
        F.when(fails(F.col("feature_valid") & F.col(target).isNotNull() & (F.col("valid_years") >= rules.min_valid_years) & (F.col("eto_gs") > 0)), "data_sufficiency")
        .when(fails(F.col("irr_class") <= rules.year_max_irrigation), "year_irrigated")
        .when(fails((F.col("irr_freq") <= rules.max_irrigation) & (F.col("irr_frac_std") <= rules.max_irrigation_std)), "purity")
        .when(fails(F.col("dist_field_edge_m") >= rules.least_edge_m), "field_edge")
    )


def recipients(table: DataFrame, target: str = "etf") -> DataFrame:
    """Irrigated, valid point years with a usable target."""
    return table.where(F.col("et_valid") & (F.col("irr_class") >= 0.5) & F.col(target).isNotNull() & (F.col(target) > -999) & (F.col("eto_gs") > 0))


def donor_pairs(receiving: DataFrame, giving: DataFrame, rules: DonorRules, target: str = "etf") -> DataFrame:
    """Scored pairs of one year: the nearest candidates within the radius first, the gates on elevation, its bin and the
    stream setting only then. Ties in distance go by the donor's id."""
    kept = ["point_id", "year", "x", "y", "rem_at_sample", "rem_bin", "hydro_analog", "ndvi_peak_gs", "ndvi_amp_gs"]
    r = receiving.select(*kept)
    d = giving.select(F.col("year"), *[F.col(c).alias(f"d_{c}") for c in kept if c != "year"], *[F.col(c).alias(f"d_{c}") for c in ("irr_freq", "etf_std", "ndvi_amp_std", target)])
    # both come from long plans and are read more than once
    r, d = cut(r.withColumn("__recipient", F.struct("point_id", "year"))), cut(d)
    near = nearest_k(r, d, "__recipient", "d_point_id", rules.candidates, on=["year"], rxy=("d_x", "d_y"), within=rules.radius_m)
    delta = F.abs(F.col("rem_at_sample") - F.col("d_rem_at_sample"))
    gated = near.withColumn("rem_delta", delta).where((F.col("rem_delta") <= rules.rem_tolerance_m) & (F.col("rem_bin") == F.col("d_rem_bin")) & (F.col("hydro_analog") == F.col("d_hydro_analog")))
    zero = F.lit(0.0)
    peak, amplitude = F.abs(F.col("ndvi_peak_gs") - F.col("d_ndvi_peak_gs")), F.abs(F.col("ndvi_amp_gs") - F.col("d_ndvi_amp_gs"))
    scored = gated.withColumns(
        {
            "score_rem": F.exp(-F.col("rem_delta") / rules.sigma_rem_m),
            "score_distance": F.exp(-F.col("distance_m") / rules.sigma_distance_m),
            "score_phenology": F.exp(-(peak / max(rules.peak_tolerance, 0.01) + amplitude / max(rules.amplitude_tolerance, 0.01))),
            "score_purity": F.pow(1 - F.col("d_irr_freq"), F.lit(rules.purity_power)),
            "score_stability": F.exp(-(F.coalesce("d_etf_std", zero) / rules.sigma_etf_std + F.coalesce("d_ndvi_amp_std", zero) / rules.sigma_ndvi_std)),
        }
    )
    score = F.col("score_rem") * F.col("score_distance") * F.col("score_phenology") * F.col("score_purity") * F.col("score_stability")
    return scored.select("point_id", "year", F.col("d_point_id").alias("donor_point_id"), score.alias("pair_score"), "distance_m", "rem_delta", F.col(f"d_{target}").alias("target_value"))


def top_donors(pairs: DataFrame, k: int) -> DataFrame:
    """The k best pairs of each recipient year, weighted by their share of the score."""
    by = Window.partitionBy("point_id", "year")
    top = pairs.withColumn("rank", F.row_number().over(by.orderBy(F.desc("pair_score"), "donor_point_id"))).where(F.col("rank") <= k)
    return top.withColumn("pair_weight", F.col("pair_score") / F.greatest(F.sum("pair_score").over(by), F.lit(1e-12)))


def background(top: DataFrame, rules: DonorRules) -> DataFrame:
    """Per recipient year: weighted median and trimmed mean of its donors, their effective number, and the reasons for
    low confidence. Fewer than least_donors give a row without an estimate."""
    key = ["point_id", "year"]
    top = cut(top)  # read twice, and the search for donors should run once
    middle = weighted_quantiles(top, key, "target_value", "pair_weight", "donor_point_id", rules.trim)
    squares = F.sum(F.col("pair_weight") * F.col("pair_weight"))
    sums = top.groupBy(*key).agg(F.count("*").alias("n_donors_used"), F.coalesce(F.try_divide(F.lit(1.0), squares), F.lit(0.0)).alias("effective_n"), F.max("pair_weight").alias("max_weight"), F.median("distance_m").alias("median_distance_m"), F.median("rem_delta").alias("median_rem_delta"))
    out = sums.join(middle, key)
    few = F.col("n_donors_used") < rules.least_donors
    flags = F.concat_ws(";", F.when(F.col("effective_n") < rules.least_effective, "low_effective_n"), F.when(F.col("max_weight") > rules.most_weight, "dominant_donor"), F.when(F.abs(F.col("wmedian") - F.col("wtrimmed")) > rules.most_gap, "estimator_disagreement"))
    return out.select(
        *key,
        F.when(few, "no_donor").when(flags != "", "low_confidence").otherwise("ok").alias("status"),
        F.when(few, "insufficient_neighbors").alias("no_donor_reason"),
        F.when(~few, F.col("wmedian")).alias("background_etf_wmedian"),
        F.when(~few, F.col("wtrimmed")).alias("background_etf_trimmed"),
        "n_donors_used",
        *[F.when(few, 0.0).otherwise(F.col(c)).alias(c) for c in ("effective_n", "max_weight", "median_distance_m", "median_rem_delta")],
        F.when(~few & (flags != ""), flags).alias("confidence_flag"),
    )


def usable_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows without a gap in those of the columns that exist and are not all missing; infinities count as missing."""
    there = [c for c in columns if c in df.columns]
    clean = df.withColumns({c: F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in there})
    counts = clean.agg(*[F.count(c).alias(c) for c in there]).first()
    used = [c for c in there if counts[c]]
    return clean.select("point_id", *used).dropna("any", subset=used)


# The order in which sample groups claim a point.
GROUP_PRIORITY = ("riparian", "field_interior", "low_rem", "field_edge", "high_rem_control", "base")


def first_by_priority(rows: DataFrame, key: str, group: str, priority: tuple[str, ...] = GROUP_PRIORITY) -> DataFrame:
    """Each key's row of the group that comes first; groups that the list does not name come last, by their names."""
    place = F.coalesce(F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(group)), F.lit(0))
    order = Window.partitionBy(key).orderBy(F.when(place > 0, place).otherwise(len(priority) + 1), group)
    return rows.withColumn("__i", F.row_number().over(order)).where("__i = 1").drop("__i")
