"""Map algebra on cell tables (r, c, value). Focal operators join a small table of offsets, never all pairs of cells."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fluvia.lineage import cut
from fluvia.operators.spatial import nearest_k


def offsets(spark: SparkSession, radius: float, weight=lambda d: 1.0) -> DataFrame:
    """(dr, dc, w) of all offsets within a radius in cells; w is a function of the distance. Its size is the radius's."""
    whole = int(radius)
    rows = [(dr, dc, float(weight(math.hypot(dr, dc)))) for dr in range(-whole, whole + 1) for dc in range(-whole, whole + 1) if math.hypot(dr, dc) <= radius]
    return spark.createDataFrame(rows, "dr bigint, dc bigint, w double")


def spread(cells: DataFrame, kernel: DataFrame) -> DataFrame:
    """Every cell's row once for each cell that it weighs on: r and c move by the offset. The kernel is broadcast: its size
    is fixed by the radius. One shuffle follows, on the target cell."""
    return cells.crossJoin(F.broadcast(kernel)).withColumns({"r": F.col("r") + F.col("dr"), "c": F.col("c") + F.col("dc")}).drop("dr", "dc")


def focal_mean(cells: DataFrame, kernel: DataFrame, value: str = "value") -> DataFrame:
    """Weighted mean of the known values around each cell of the table."""
    around = spread(cells.where(F.col(value).isNotNull()).select("r", "c", value), kernel)
    sums = around.groupBy("r", "c").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("focal"))
    return cells.join(sums, ["r", "c"], "left")


def focal_stats(cells: DataFrame, kernel: DataFrame, value: str = "value") -> DataFrame:
    """(r, c, lowest, relief, middle) of the known values around each cell of the table."""
    around = spread(cells.where(F.col(value).isNotNull()).select("r", "c", value), kernel)
    stats = around.groupBy("r", "c").agg(F.min(value).alias("lowest"), (F.max(value) - F.min(value)).alias("relief"), F.median(value).alias("middle"))
    return cells.select("r", "c").join(stats, ["r", "c"], "left")


def gaussian(radius: float, sigma: float):
    return lambda d: math.exp(-d * d / (2 * sigma * sigma))


def coarsen(cells: DataFrame, factor: int, value: str = "value") -> DataFrame:
    """Means of whole blocks of factor x factor cells; blocks cut off at the high edges are left out."""
    size = cells.agg((F.floor((F.max("r") + 1) / factor)).alias("nr"), (F.floor((F.max("c") + 1) / factor)).alias("nc"))
    blocks = cells.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.avg(value).alias("value"), F.count(value).alias("n"))
    return blocks.crossJoin(F.broadcast(size)).where("r < nr and c < nc").drop("nr", "nc")


def gradient(cells: DataFrame, value: str, size: float) -> DataFrame:
    """Central differences (one-sided at the edges) along rows and columns, slope, and the downslope unit vector."""
    out = cells.select("r", "c", value)
    for name, along, across in (("dy", "r", "c"), ("dx", "c", "r")):
        w = Window.partitionBy(across).orderBy(along)
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        out = out.withColumn(name, F.when(before.isNull(), (after - F.col(value)) / size).when(after.isNull(), (F.col(value) - before) / size).otherwise((after - before) / (2 * size)))
    slope = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return out.withColumn("slope", slope).withColumns({"ux": -F.try_divide("dx", "slope"), "uy": -F.try_divide("dy", "slope")})


def zonal(cells: DataFrame, zones: DataFrame, value: str = "value", prefix: str = "rem_") -> DataFrame:
    """Count, mean, least and largest known value of the cells of each zone; zones: r, c, zone."""
    held = cells.where(F.col(value).isNotNull()).join(zones, ["r", "c"])
    return held.groupBy("zone").agg(F.count("*").alias(f"{prefix}count"), F.avg(value).alias(f"{prefix}mean"), F.min(value).alias(f"{prefix}min"), F.max(value).alias(f"{prefix}max"))


def burn(strips: DataFrame, size: float) -> DataFrame:
    """(r, c, value, n): the least value and the count of samples, taken every half cell along strips from (ax, ay) to
    (bx, by) with values va to vb between them."""
    length = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    steps = F.greatest(F.ceil(length / (size / 2)), F.lit(1)).cast("long")
    at = strips.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("steps")))).withColumn("t", F.col("k") / F.col("steps"))

    def between(a: str, b: str):
        return F.col(a) + F.col("t") * (F.col(b) - F.col(a))

    samples = at.select(F.floor(between("ay", "by") / size).alias("r"), F.floor(between("ax", "bx") / size).alias("c"), between("va", "vb").alias("v"))
    return samples.groupBy("r", "c").agg(F.min("v").alias("value"), F.count("*").alias("n"))


def nearest_fill(cells: DataFrame, known: DataFrame) -> DataFrame:
    """(r, c, value, distance_m) of every cell from the nearest known cell (r, c, value), ties by its order in rows."""
    left = cells.select("r", "c", (F.col("r") * 1_000_003 + F.col("c")).alias("cell_id"), F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"))
    right = known.select((F.col("r") * 1_000_003 + F.col("c")).alias("known_id"), F.col("value"), F.col("c").cast("double").alias("rx"), F.col("r").cast("double").alias("ry"))
    return nearest_k(left, right, "cell_id", "known_id", 1).select("r", "c", "value", "distance_m")


def strip_fill(cells: DataFrame, burned: DataFrame, spark: SparkSession, radius: float, power: float) -> DataFrame:
    """Burned values spread by 1 / max(d, 0.5) ^ power and their counts, never above the ground (elev) of a cell."""
    kernel = offsets(spark, radius, lambda d: 1 / max(d, 0.5) ** power)
    sums = spread(burned, kernel).groupBy("r", "c").agg((F.sum(F.col("w") * F.col("n") * F.col("value")) / F.sum(F.col("w") * F.col("n"))).alias("fill"))
    return cells.join(sums, ["r", "c"], "left").withColumn("value", F.when(F.col("fill").isNotNull(), F.least("fill", "elev")))


def relative_elevation(cells: DataFrame, spark: SparkSession, sigma: float, reach: float) -> DataFrame:
    """Height above the water surface: nearest stream elevation, not above the ground, smoothed, not above the ground
    again; unknown farther than `reach` cells from a stream. cells: r, c, elev, stream."""
    streams = cells.where("stream = 1").select("r", "c", F.col("elev").alias("value"))
    near = nearest_fill(cells, streams).withColumnRenamed("value", "water")
    lowered = cells.join(near, ["r", "c"]).withColumn("water", F.least("water", "elev"))
    smooth = focal_mean(lowered, offsets(spark, math.ceil(3 * sigma), gaussian(0, sigma)), "water")
    return smooth.select("r", "c", F.when(F.col("distance_m") <= reach, F.greatest(F.col("elev") - F.least("focal", "elev"), F.lit(0.0))).alias("rem"))


def mosaic(tiles: DataFrame) -> DataFrame:
    """One value per cell from tiles (rank, r, c, value): the known one of lowest rank, and that rank."""
    known = tiles.where("value is not null")
    return known.groupBy("r", "c").agg(F.min_by("value", "rank").alias("value"), F.min("rank").alias("rank"))


def upsert(mosaic_: DataFrame, source: DataFrame, footprint: DataFrame) -> DataFrame:
    """Clears the footprint's cells and writes the source's known ones there: running it again changes nothing."""
    return mosaic_.join(footprint, ["r", "c"], "left_anti").unionByName(source.where("value is not null").join(footprint, ["r", "c"], "left_semi"))


def downhill(cells: DataFrame, spark: SparkSession) -> DataFrame:
    """(r, c, tr, tc): each cell's lowest neighbour if that is lower than the cell itself, ties in row-major order."""
    ring = spark.createDataFrame([(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b], "dr bigint, dc bigint")
    source = cells.select("r", "c", F.col("elev").alias("own"))
    around = source.crossJoin(F.broadcast(ring)).withColumns({"tr": F.col("r") + F.col("dr"), "tc": F.col("c") + F.col("dc")}).join(cells.select(F.col("r").alias("tr"), F.col("c").alias("tc"), "elev"), ["tr", "tc"]).where("elev < own")
    return around.groupBy("r", "c").agg(F.min(F.struct("elev", "tr", "tc")).alias("m")).select("r", "c", "m.tr", "m.tc")


def accumulate(cells: DataFrame, pointers: DataFrame) -> DataFrame:
    """(r, c, acc): how many cells' ways along acyclic pointers lead through each cell, itself included.

    Pointers are doubled: after k rounds a cell has counted all that lies fewer than 2^k steps above it, and points 2^k
    steps down. So the rounds follow the logarithm of the longest way, and every round has one row per cell.
    """
    key = lambda r, c: F.struct(F.col(r).alias("r"), F.col(c).alias("c"))
    state = cells.select("r", "c").join(pointers, ["r", "c"], "left").select(key("r", "c").alias("at"), F.when(F.col("tr").isNotNull(), key("tr", "tc")).alias("to"), F.lit(1).cast("long").alias("acc"))
    state = cut(state)
    for _ in range(64):
        if state.where("to is not null").isEmpty():
            break
        sent = state.where("to is not null").groupBy(F.col("to").alias("at")).agg(F.sum("acc").alias("more"))
        beyond = state.select(F.col("at").alias("to"), F.col("to").alias("next"))
        state = cut(state.join(sent, "at", "left").join(beyond, "to", "left").select("at", F.col("next").alias("to"), (F.col("acc") + F.coalesce("more", F.lit(0))).alias("acc")), replaces=state)
    else:
        raise RuntimeError("cells flow in a circle")
    return state.select("at.r", "at.c", "acc")
