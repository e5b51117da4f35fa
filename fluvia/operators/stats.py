"""Weighted order statistics, error panels and overlapping groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def error_columns(residual: Column) -> dict[str, Column]:
    """Count, median absolute, mean and median residual, and root mean square, over rows that have a residual."""
    return {
        "n": F.count(residual),
        "mad": F.round(F.median(F.abs(residual)), 6),
        "mean_bias": F.round(F.avg(residual), 6),
        "median_bias": F.round(F.median(residual), 6),
        "rmse": F.round(F.sqrt(F.avg(residual * residual)), 6),
    }


def error_panel(df: DataFrame, by: list[str], residual: Column) -> DataFrame:
    """One row of errors per group; groups without a residual give no row. One shuffle on the group."""
    return df.where(residual.isNotNull()).groupBy(*by).agg(*[c.alias(k) for k, c in error_columns(residual).items()])


def overlapping_groups(df: DataFrame, groups: dict[str, Column], name: str = "grp") -> DataFrame:
    """Each row once for every group whose condition holds: one pass, where grouping sets would not overlap."""
    marks = F.array_compact(F.array(*[F.when(condition, F.lit(k)) for k, condition in groups.items()]))
    return df.select("*", F.explode(marks).alias(name))


def weighted_quantiles(df: DataFrame, by: list[str], value: str, weight: str, tie: str, trim: float = 0.1) -> DataFrame:
    """Per group: wmedian (the first value at which the running weight reaches half) and wtrimmed (the weighted mean of
    values whose running weight lies within the trimmed range, or of all if none does). One shuffle: the window and the
    aggregate share the partitioning by the group."""
    order = Window.partitionBy(*by).orderBy(value, tie).rowsBetween(Window.unboundedPreceding, 0)
    ran = df.withColumn("__cum", F.sum(weight).over(order)).withColumn("__tot", F.max("__cum").over(Window.partitionBy(*by)))
    inside = (F.col("__cum") >= F.col("__tot") * trim) & (F.col("__cum") <= F.col("__tot") * (1 - trim))
    kept_weight = F.sum(F.when(inside, F.col(weight)))
    return ran.groupBy(*by).agg(
        F.min_by(value, F.when(F.col("__cum") >= 0.5 * F.col("__tot"), F.col("__cum"))).alias("wmedian"),
        F.coalesce(F.try_divide(F.sum(F.when(inside, F.col(value) * F.col(weight))), kept_weight), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight))).alias("wtrimmed"),
    )


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1, equal values sharing the mean of their ranks."""
    order = Window.partitionBy(*by).orderBy(value)
    return F.rank().over(order) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2


def standard_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """z scores by the population deviation, of which 0 counts as 1. The one row of moments is broadcast."""
    moments = df.agg(*[F.avg(c).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"__s_{c}") for c in columns])
    out = df.crossJoin(F.broadcast(moments))
    for c in columns:
        deviation = F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0)
        out = out.withColumn(c, (F.col(c) - F.col(f"__m_{c}")) / deviation)
    return out.drop(*[f"__{k}_{c}" for c in columns for k in "ms"])


#: Rows of one side of a chunk of pairs.
PAIRED_ROWS = 2_000


def theil_sen(df: DataFrame, by: list[str], x: str, y: str, z: float = 1.959963984540054) -> DataFrame:
    """Median slope over all pairs of a group's points, the intercept at the medians, and the slopes low and high between
    which the true one lies (z: the normal quantile; the default is that of 95 %).

    A long record is one group, but its pairs are made in chunks of PAIRED_ROWS rows against all, in as many tasks; slopes
    are then sorted, which spills, and picked by their rank. Groups without two different x give no row.
    """
    chunks = F.ceil(F.col("__n") / PAIRED_ROWS).cast("int")
    rows = df.select(*by, F.col(x).alias("__x"), F.col(y).alias("__y")).where("__x is not null and __y is not null")
    sized = rows.withColumn("__n", F.count("*").over(Window.partitionBy(*by)))
    a = sized.select(*by, F.pmod(F.xxhash64("__x", "__y"), chunks).cast("int").alias("__k"), F.col("__x").alias("x1"), F.col("__y").alias("y1"))
    b = sized.select(*by, F.explode(F.sequence(F.lit(0), chunks - 1)).alias("__k"), F.col("__x").alias("x2"), F.col("__y").alias("y2"))
    slopes = a.join(b, [*by, "__k"]).where("x2 > x1").select(*by, ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("s"))
    counts = slopes.groupBy(*by).agg(F.count("*").alias("nt"))

    def ties(column: str) -> DataFrame:
        k = F.col("count")
        return rows.groupBy(*by, column).count().groupBy(*by).agg(F.sum(k * (k - 1) * (2 * k + 5)).alias(f"t{column}"))

    middle = rows.groupBy(*by).agg(F.count("*").alias("n"), F.median("__x").alias("mx"), F.median("__y").alias("my"))
    spread = middle.join(ties("__x"), by).join(ties("__y"), by).join(counts, by)
    n = F.col("n")
    sigma = F.sqrt((n * (n - 1) * (2 * n + 5) - F.col("t__x") - F.col("t__y")) / 18.0)
    ends = spread.withColumns({"hi": F.least(F.rint((F.col("nt") + z * sigma) / 2), F.col("nt") - 1).cast("long"), "lo": F.greatest(F.rint((F.col("nt") - z * sigma) / 2) - 1, F.lit(0)).cast("long")})
    ranked = slopes.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy("s")).cast("long") - 1).join(ends.select(*by, "nt", "lo", "hi"), by)
    i, nt = F.col("i"), F.col("nt")
    half = F.avg(F.when((i == F.floor((nt - 1) / 2)) | (i == F.floor(nt / 2)), F.col("s")))
    found = ranked.groupBy(*by).agg(half.alias("slope"), F.min(F.when(i == F.col("lo"), F.col("s"))).alias("low"), F.min(F.when(i == F.col("hi"), F.col("s"))).alias("high"))
    return found.join(middle, by).select(*by, "slope", (F.col("my") - F.col("slope") * F.col("mx")).alias("intercept"), "low", "high")


def shallow_scores(df: DataFrame, by: list[str], predicted: str, observed: str, weight: str, shallow: float = 5.0) -> DataFrame:
    """Per group, over rows in which all is known: n, mad, wmad, bias, mean_bias, rmse (the last three and wmad weighted, bias
    the plain median), and recall, precision and their harmonic mean for the call of shallow water, with 1 for a count of
    0 and 0 where both are 0."""
    known = df.where(F.col(predicted).isNotNull() & F.col(observed).isNotNull() & F.col(weight).isNotNull())
    e, w = F.col(predicted) - F.col(observed), F.col(weight)
    p, o = F.col(predicted) < shallow, F.col(observed) < shallow
    weighted = lambda v: F.try_divide(F.sum(w * v), F.sum(w))
    sums = known.groupBy(*by).agg(F.count("*").alias("n"), F.median(F.abs(e)).alias("mad"), weighted(F.abs(e)).alias("wmad"), F.median(e).alias("bias"), weighted(e).alias("mean_bias"), F.sqrt(weighted(e * e)).alias("rmse"), F.count_if(p & o).alias("tp"), F.count_if(o).alias("n_obs_shallow"), F.count_if(p).alias("n_pred_shallow"))
    recall, precision = F.col("tp") / F.greatest("n_obs_shallow", F.lit(1)), F.col("tp") / F.greatest("n_pred_shallow", F.lit(1))
    out = sums.withColumns({"shallow_recall": recall, "shallow_precision": precision}).drop("tp")
    return out.withColumn("shallow_f1", F.coalesce(F.try_divide(2 * F.col("shallow_recall") * F.col("shallow_precision"), F.col("shallow_recall") + F.col("shallow_precision")), F.lit(0.0)))


def shallow_skill(df: DataFrame, predicted: str, observed: str, thresholds: tuple[float, ...] = (2.0, 5.0, 10.0)) -> DataFrame:
    """(threshold, precision, recall, n_obs_shallow): the call of water shallower than each threshold; null where undefined.
    Each row counts under every threshold, in one pass."""
    known = df.where(F.col(predicted).isNotNull() & F.col(observed).isNotNull())
    long = known.select(F.col(predicted).alias("p"), F.col(observed).alias("o"), F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("threshold"))
    p, o = F.col("p") < F.col("threshold"), F.col("o") < F.col("threshold")
    sums = long.groupBy("threshold").agg(F.count_if(p & o).alias("tp"), F.count_if(p).alias("np"), F.count_if(o).alias("n_obs_shallow"))
    return sums.select("threshold", F.try_divide("tp", "np").alias("precision"), F.try_divide("tp", "n_obs_shallow").alias("recall"), "n_obs_shallow")


def unit_range(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """The column stretched so that its percentiles low and high (shares of 1) become 0 and 1, and clipped to that. A range
    without width is an error. The one row of percentiles is broadcast."""
    ends = df.agg(F.percentile(column, F.lit(low)).alias("__a"), F.percentile(column, F.lit(high)).alias("__b"))
    width = F.when(F.col("__b") > F.col("__a"), F.col("__b") - F.col("__a")).otherwise(F.raise_error(F.lit(f"{column} has no range")).cast("double"))
    share = (F.col(column) - F.col("__a")) / width
    stretched = F.when(F.col(column).isNotNull(), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)))
    return df.crossJoin(F.broadcast(ends)).withColumn(column, stretched).drop("__a", "__b")


def asserted_join(left: DataFrame, right: DataFrame, key: str, column: str) -> DataFrame:
    """Each left row with `column` of its right row; a left row that finds none, or a null, is an error, not a gap."""
    joined = left.join(right.select(key, column), key, "left")
    missing = F.raise_error(F.concat(F.lit(f"no {column} for {key} "), F.col(key).cast("string"))).cast(dict(right.dtypes)[column])
    return joined.withColumn(column, F.when(F.col(column).isNotNull(), F.col(column)).otherwise(missing))


def manifest(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the table's rows and how many know each column, as JSON."""
    return df.agg(F.to_json(F.struct(F.count("*").alias("n_rows"), F.struct(*[F.count(c).alias(c) for c in columns]).alias("known"))).alias("manifest"))
