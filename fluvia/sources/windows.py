"""Windows with a halo over tables of places: which files to open, which rows fall in, which columns may be used."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

_BOX = ["x0", "y0", "x1", "y1"]


def file_bounds(spark: SparkSession, path: str, x: str = "x", y: str = "y") -> DataFrame:
    """(file, x0, y0, x1, y1, n): the extent of each file's rows. Made once and kept as a table, it spares later reads."""
    rows = spark.read.parquet(path).where(f"`{x}` is not null and `{y}` is not null and not isnan(`{x}`) and not isnan(`{y}`)")
    return rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"), F.count("*").alias("n"))


def files_met(bounds: DataFrame, windows: DataFrame, halo: float) -> list[str]:
    """The files whose extent meets any window (x0, y0, x1, y1) widened by the halo, in order of their names.

    Files and windows meet in squares as wide as the widest side of either, so neither list is compared with all of the
    other. The names come to the driver, as those of any scan's files do.
    """
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    widest = [df.agg(F.max(side)).first()[0] for df in (bounds, windows)]
    if None in widest:
        return []
    size = max(*widest, 2 * halo) + 2 * halo or 1.0

    def spread(df: DataFrame, by: float, prefix: str) -> DataFrame:
        df = df.select(*[c for c in df.columns if c not in _BOX], *[(F.col(c) - by).alias(prefix + c) if c.endswith("0") else (F.col(c) + by).alias(prefix + c) for c in _BOX])
        for a in "xy":
            df = df.withColumn("__" + a, F.explode(F.sequence(F.floor(F.col(f"{prefix}{a}0") / size), F.floor(F.col(f"{prefix}{a}1") / size))))
        return df

    near = spread(bounds.select("file", *_BOX), 0.0, "f").join(spread(windows.select(*_BOX), halo, "w"), ["__x", "__y"])
    met = near.where("fx0 <= wx1 and fx1 >= wx0 and fy0 <= wy1 and fy1 >= wy0").select("file").distinct()
    return sorted(r.file for r in met.collect())


def rows_in(rows: DataFrame, windows: DataFrame, window: str, halo: float, x: str = "x", y: str = "y") -> DataFrame:
    """Every row once for each window whose widened box (closed) holds it, with the window's id and `in_halo`: true where
    only the halo holds it. Column names of the two must differ but for x and y."""
    side = windows.agg(F.max(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0]
    size = float((side or 0.0) + 2 * halo) or 1.0
    over = windows.select(window, *[F.col(c).alias("__" + c) for c in _BOX])
    for a in "xy":
        over = over.withColumn("__" + a, F.explode(F.sequence(F.floor((F.col(f"__{a}0") - halo) / size), F.floor((F.col(f"__{a}1") + halo) / size))))
    placed = rows.withColumns({"__x": F.floor(F.col(x) / size), "__y": F.floor(F.col(y) / size)})
    out = placed.join(over, ["__x", "__y"])
    held = lambda by: F.col(x).between(F.col("__x0") - by, F.col("__x1") + by) & F.col(y).between(F.col("__y0") - by, F.col("__y1") + by)
    return out.where(held(halo)).withColumn("in_halo", ~held(0.0)).drop("__x", "__y", *["__" + c for c in _BOX])


def read_windows(spark: SparkSession, path: str, bounds: DataFrame, windows: DataFrame, window: str, halo: float, x: str = "x", y: str = "y") -> DataFrame:
    """`rows_in` of a table of files, of which only those are opened that meet a widened window."""
    files = files_met(bounds, windows, halo)
    if files:
        rows = spark.read.schema(spark.read.parquet(files[0]).schema).parquet(*files)
    else:
        rows = spark.read.parquet(path).limit(0)
    return rows_in(rows, windows, window, halo, x, y)


def if_complete(rows: DataFrame, window: str, column: str) -> DataFrame:
    """The rows, with `column` null throughout each window in which any of its rows lacks it: a column with gaps would bend
    what is computed from a window as a whole, so another source is to be used there."""
    whole = rows.groupBy(window).agg((F.count("*") == F.count(column)).alias("__whole"))
    return rows.join(whole, window).withColumn(column, F.when(F.col("__whole"), F.col(column))).drop("__whole")
