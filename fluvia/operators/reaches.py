"""Reach lines on rasters: arc lengths, stations, samples along and beside a line, drainage, seeds, orientation, grades,
strips to either side, what they hit, and wedges between them.

Lines are arrays of vertices (structs x, y). A line becomes rows once, one for each segment with its place along the line,
and stations follow from a segment alone; rasters are met by equi-joins on cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvia.operators.lines import cell_size
from fluvia.operators.polygons import Raster, passed
from fluvia.operators.spatial import distance, segment_crossing

# Soft seeds by class of the hydrography, and of all other classes.
CLASS_SEED = {"perennial": 0.9, "canal_ditch": 0.6, "artificial_path": 0.6, "intermittent": 0.4, "ephemeral": 0.05, "other": 0.2}
OTHER_SEED = 0.2


def class_seed(name: Column) -> Column:
    """The soft seed of a class, in any case; a null or unknown class has that of all others."""
    out = F.when(F.lit(False), F.lit(0.0))
    for key, seed in CLASS_SEED.items():
        out = out.when(F.lower(name) == key, F.lit(seed))
    return out.otherwise(F.lit(OTHER_SEED))


def segments(lines: DataFrame, key: str, points: str = "points") -> DataFrame:
    """(key, i, ax, ay, bx, by, s0, s1) of each segment of a line: s0 and s1 are the arc lengths at its ends. Lines of one
    vertex have none."""
    order = Window.partitionBy(key).orderBy("i")
    at = lines.select(key, F.posexplode(points).alias("i", "p")).select(key, "i", F.col("p.x").alias("ax"), F.col("p.y").alias("ay"))
    ends = at.withColumns({"bx": F.lead("ax").over(order), "by": F.lead("ay").over(order)}).where("bx is not null")
    length = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return ends.withColumn("__l", length).withColumn("s1", F.sum("__l").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("s0", F.col("s1") - F.col("__l")).drop("__l")


def stations(parts: DataFrame, key: str, spacing: float) -> DataFrame:
    """(key, s, x, y, nx, ny, total): places at multiples of the spacing along a line, and its end, each with the unit
    normal of its segment. The end comes from the last segment; lines without length have only that."""
    whole = Window.partitionBy(key)
    kept = parts.withColumns({"total": F.max("s1").over(whole), "last": F.max("i").over(whole) == F.col("i")})
    first, beyond = F.ceil(F.col("s0") / spacing), F.ceil(F.col("s1") / spacing)
    steps = F.when(beyond > first, F.transform(F.sequence(first, beyond - 1), lambda k: k * F.lit(float(spacing)))).otherwise(F.array().cast("array<double>"))
    places = F.concat(steps, F.when(F.col("last"), F.array("s1")).otherwise(F.array().cast("array<double>")))
    at = kept.select("*", F.explode(places).alias("s"))
    share = F.coalesce(F.try_divide(F.col("s") - F.col("s0"), F.col("s1") - F.col("s0")), F.lit(0.0))
    length = distance(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    return at.select(
        key, "s", (F.col("ax") + share * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + share * (F.col("by") - F.col("ay"))).alias("y"),
        F.coalesce(F.try_divide(F.col("ay") - F.col("by"), length), F.lit(0.0)).alias("nx"), F.coalesce(F.try_divide(F.col("bx") - F.col("ax"), length), F.lit(0.0)).alias("ny"), "total",
    )


def beside(at: DataFrame, spacing: float, corridor: float) -> DataFrame:
    """Each station and places across the line, evenly spaced out to the corridor on either side."""
    side = max(int(round(corridor / spacing)), 1)
    offsets = F.array(*[F.lit(-corridor + corridor * k / side) for k in range(2 * side + 1)])
    return at.withColumn("__o", F.explode(offsets)).withColumns({"x": F.col("x") + F.col("nx") * F.col("__o"), "y": F.col("y") + F.col("ny") * F.col("__o")}).drop("__o")


def sampled(at: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """Adds the columns of the raster cell (r, c) that each place lies in, or nulls outside the raster."""
    return at.withColumns({"r": F.floor(F.col("y") / size).cast("long"), "c": F.floor(F.col("x") / size).cast("long")}).join(cells, ["r", "c"], "left").drop("r", "c")


def reach_drainage(parts: DataFrame, key: str, cells: DataFrame, size: float, spacing: float, trim_cells: float = 1.5) -> DataFrame:
    """(key, drainage_km2): the largest accumulation (cells: r, c, acc) along each line, its ends left out by trim_cells
    cells, where the receiving reach's cell may lie. Lines shorter than two trims are sampled at their middle."""
    trim = trim_cells * size
    at = stations(parts, key, spacing)
    inner = at.where((F.col("total") >= 2 * trim) & (F.col("s") >= trim) & (F.col("s") <= F.col("total") - trim)).select(key, "x", "y")
    short = parts.withColumn("m", F.max("s1").over(Window.partitionBy(key)) / 2).where((F.col("m") < trim) & (F.col("s0") <= F.col("m")) & (F.col("m") < F.col("s1")))
    share = (F.col("m") - F.col("s0")) / (F.col("s1") - F.col("s0"))
    middle = short.select(key, (F.col("ax") + share * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + share * (F.col("by") - F.col("ay"))).alias("y"))
    held = sampled(inner.unionByName(middle), cells, size).groupBy(key).agg((F.max("acc") * (size * size / 1e6)).alias("drainage_km2"))
    return parts.select(key).distinct().join(held, key, "left")


def reach_seed(parts: DataFrame, key: str, cells: DataFrame, size: float, spacing: float, corridor: float = 0.0, quantile: float = 0.9, middle: float = 0.35, scale: float = 0.06, override: float = 1.0) -> DataFrame:
    """(key, seed_ndvi_q, seed_support_hit, seed_support_fraction, seed_strength) of each line from cells (r, c, ndvi, support).

    The soft seed is the logistic of a quantile of ndvi along the line, or across its corridor; without any value it is
    0. Support counts between the first and the last station, which neighbours share; only lines without a known place
    between them use the ends. Supported lines have at least the override as seed, and seeds lie in 0 to 1.
    """
    at = stations(parts, key, spacing)
    around = beside(at, spacing, corridor) if corridor > 0 else at
    q = F.percentile(F.when(~F.isnan("ndvi"), F.col("ndvi")), quantile)
    soft = sampled(around, cells.select("r", "c", "ndvi"), size).groupBy(key).agg(q.alias("seed_ndvi_q"))
    # zero-length lines have one station, both first and last
    inner = F.col("support").isNotNull() & (F.col("s") > 0) & (F.col("s") < F.col("total"))
    wet = F.col("support") > 0.5
    hard = sampled(at, cells.select("r", "c", "support"), size).groupBy(key).agg(F.count_if(inner).alias("known"), F.count_if(inner & wet).alias("wet"), F.coalesce(F.bool_or(wet), F.lit(False)).alias("anywhere"))
    share = F.coalesce(F.try_divide("wet", "known"), F.lit(0.0))
    hit = F.when(F.col("known") > 0, F.col("wet") > 0).otherwise(F.col("anywhere"))
    strength = F.coalesce(1 / (1 + F.exp(-(F.col("seed_ndvi_q") - middle) / scale)), F.lit(0.0))
    out = soft.join(hard, key).withColumns({"seed_support_hit": hit, "seed_support_fraction": share})
    seed = F.least(F.greatest(F.when(F.col("seed_support_hit"), F.greatest(strength, F.lit(override))).otherwise(strength), F.lit(0.0)), F.lit(1.0))
    return out.select(key, "seed_ndvi_q", "seed_support_hit", "seed_support_fraction", seed.alias("seed_strength"))


def oriented(ends: DataFrame, digits: int = 3) -> DataFrame:
    """Adds reversed, up_x, up_y, down_x, down_y (rounded, so that lines share nodes) and relief_m to lines given by their
    ends (x0, y0, x1, y1) with elevations z0, z1 and accumulations f0, f1 or null. Accumulation, where both are known and
    differ, decides the direction; else the higher end is upstream."""
    c = F.col
    turn = F.coalesce(F.when(c("f0") != c("f1"), c("f0") > c("f1")), c("z1") > c("z0"), F.lit(False))
    up, down = ({k: F.when(c("reversed"), c(a)).otherwise(c(b)) for k, a, b in zip(names, first, second)} for names, first, second in ((("up_x", "up_y", "__zu"), ("x1", "y1", "z1"), ("x0", "y0", "z0")), (("down_x", "down_y", "__zd"), ("x0", "y0", "z0"), ("x1", "y1", "z1"))))
    out = ends.withColumn("reversed", turn).withColumns(up | down)
    fall = c("__zu") - c("__zd")
    return out.withColumns({k: F.round(k, digits) for k in ("up_x", "up_y", "down_x", "down_y")} | {"relief_m": F.when(fall.isNotNull(), F.greatest(fall, F.lit(0.0)))}).drop("__zu", "__zd")


def smoothed_grade(at: DataFrame, key: str, value: str = "e", window: int = 5) -> DataFrame:
    """Adds smooth: a line's robust grade (median of the slopes between known neighbours, intercept at the median) plus the
    centred rolling lower quartile of what is left. Lines with fewer than two known places have their median as grade."""
    order = Window.partitionBy(key).orderBy("s")
    known = at.where(F.col(value).isNotNull())
    step = F.col("s") - F.lag("s").over(order)
    steps = known.withColumns({"__ds": step, "__de": F.col(value) - F.lag(value).over(order)})
    slope = steps.groupBy(key).agg(F.coalesce(F.median(F.when(F.abs("__ds") > 1e-12, F.col("__de") / F.col("__ds"))), F.lit(0.0)).alias("__m"))
    base = known.join(slope, key).groupBy(key).agg(F.first("__m").alias("__m"), F.median(F.col(value) - F.col("__m") * F.col("s")).alias("__b"))
    trend = at.join(base, key, "left").withColumn("__t", F.coalesce(F.col("__m") * F.col("s") + F.col("__b"), F.lit(0.0)))
    half = window // 2
    held = trend.withColumn("__v", F.array_sort(F.collect_list(F.col(value) - F.col("__t")).over(order.rowsBetween(-half, window - 1 - half))))
    place = (F.size("__v") - 1) * 0.25
    low = F.floor(place).cast("int")
    a, b = F.get("__v", low), F.get("__v", F.least(low + 1, F.size("__v") - 1))
    return held.withColumn("smooth", F.when(F.size("__v") > 0, F.col("__t") + a + (place - low) * (b - a))).drop("__m", "__b", "__t", "__v")


def strips(at: DataFrame, parts: DataFrame, key: str, box: tuple[float, float, float, float], reach: float, longest: float | None = None, least: float = 1e-6) -> DataFrame:
    """(key, station, side, x, y, hit_type, target, hit_m, ex, ey) of a ray to either side (1 left, -1 right) of every
    station, which ends at (ex, ey).

    interreach: the ray meets another line first, at least `least` away; edge: it leaves the box first; naked: neither
    within `reach`. Rays and segments are brought together in the raster cells that both pass, so segments may have any
    length; `longest` is not needed any more.
    """
    c = F.col
    number = F.row_number().over(Window.partitionBy(key).orderBy("s")).cast("long") - 1
    rays = at.withColumn("station", number).withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumns({"dx": c("nx") * c("side") * reach, "dy": c("ny") * c("side") * reach})
    rays = rays.select(key, "station", "side", "x", "y", "dx", "dy")
    other = parts.select(c(key).alias("target"), "ax", "ay", "bx", "by")
    raster = cell_size(other, reach / 2) or Raster()
    # what rounding may do to a place must not decide in which cell it lies
    slack = raster.size * 1e-6
    ends = {"ax": c("x"), "ay": c("y"), "bx": c("x") + c("dx"), "by": c("y") + c("dy")}
    crossing = passed(rays.withColumns(ends), [key, "station", "side", "x", "y", "dx", "dy"], raster, slack)
    held = passed(other, ["target", "ax", "ay", "bx", "by"], raster, slack).select("r", "c", "target", *[c(n).alias(f"o{n}") for n in ("ax", "ay", "bx", "by")])
    # sizes are estimated without what cells multiply, so no side must be broadcast for seeming small
    pairs = crossing.hint("merge").join(held.hint("merge"), ["r", "c"]).where(c(key) != c("target"))
    # exploded, so that the share is worked out once for each pair, and not in every condition on it
    share = segment_crossing(c("x"), c("y"), c("x") + c("dx"), c("y") + c("dy"), c("oax"), c("oay"), c("obx"), c("oby"), 1e-9)
    met = pairs.select(key, "station", "side", "target", F.explode(F.array(share)).alias("t")).where("t is not null")
    # lines that meet the ray in one place are told apart by their ids and not by rounding
    met = met.withColumn("t", F.round("t", 9)).where(c("t") * reach >= least)
    first = met.groupBy(key, "station", "side").agg(F.min(F.struct("t", "target")).alias("h"))
    x0, y0, x1, y1 = box
    leaves = F.least(*[F.when(c(d) > 0, (F.lit(hi) - c(p)) / c(d)).when(c(d) < 0, (F.lit(lo) - c(p)) / c(d)) for p, d, lo, hi in (("x", "dx", x0, x1), ("y", "dy", y0, y1))])
    out = rays.hint("merge").join(first.hint("merge"), [key, "station", "side"], "left").withColumn("edge", F.greatest(leaves, F.lit(0.0)))
    crossed = c("h.t").isNotNull() & (c("edge").isNull() | (c("h.t") <= c("edge")))
    outside = ~crossed & F.coalesce(c("edge") <= 1, F.lit(False))
    share = F.when(crossed, c("h.t")).when(outside, c("edge")).otherwise(1.0)
    kind = F.when(crossed, "interreach").when(outside, "edge").otherwise("naked")
    return out.select(key, "station", "side", "x", "y", kind.alias("hit_type"), F.when(crossed, c("h.target")).alias("target"), (share * reach).alias("hit_m"), (c("x") + share * c("dx")).alias("ex"), (c("y") + share * c("dy")).alias("ey"))


def wedges(rays: DataFrame, key: str) -> DataFrame:
    """(key, side, station, next_station, hit_type, target): neighbouring strips of a side that hit alike."""
    order = Window.partitionBy(key, "side").orderBy("station")
    after = {f"__{n}": F.lead(n).over(order) for n in ("station", "hit_type", "target")}
    alike = (F.col("hit_type") == F.col("__hit_type")) & ((F.col("hit_type") != "interreach") | (F.col("target") == F.col("__target")))
    return rays.withColumns(after).where(alike).select(key, "side", "station", F.col("__station").alias("next_station"), "hit_type", "target")


def wedge_rings(rays: DataFrame, key: str) -> DataFrame:
    """(key, side, station, next_station, hit_type, target, area, rings): what lies between neighbouring strips that hit
    alike; rays run from their base (x, y) to their end (ex, ey).

    A ring is base, end, next end, next base. Where strips cross, or the line of ends crosses that of bases, the ring would
    cross itself; then the two triangles that meet in the crossing are the rings. Wedges without area give no row.
    """
    order = Window.partitionBy(key, "side").orderBy("station")
    c, place = F.col, lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    after = {f"__{n}": F.lead(n).over(order) for n in ("station", "hit_type", "target", "x", "y", "ex", "ey")}
    alike = (c("hit_type") == c("__hit_type")) & ((c("hit_type") != "interreach") | (c("target") == c("__target")))
    both = rays.withColumns(after).where(alike)
    base, end, next_end, next_base = place(c("x"), c("y")), place(c("ex"), c("ey")), place(c("__ex"), c("__ey")), place(c("__x"), c("__y"))
    strips = segment_crossing(c("x"), c("y"), c("ex"), c("ey"), c("__x"), c("__y"), c("__ex"), c("__ey"), -1e-9)
    ends = segment_crossing(c("ex"), c("ey"), c("__ex"), c("__ey"), c("x"), c("y"), c("__x"), c("__y"), -1e-9)
    both = both.withColumns({"__t": strips, "__u": ends})
    p = place(c("x") + c("__t") * (c("ex") - c("x")), c("y") + c("__t") * (c("ey") - c("y")))
    q = place(c("ex") + c("__u") * (c("__ex") - c("ex")), c("ey") + c("__u") * (c("__ey") - c("ey")))
    # sides that only touch at their ends, to within rounding, do not cross
    rings = F.when(c("__t").isNotNull(), F.array(F.array(base, p, next_base), F.array(end, p, next_end))).when(c("__u").isNotNull(), F.array(F.array(base, end, q), F.array(next_end, next_base, q))).otherwise(F.array(F.array(base, end, next_end, next_base)))

    def area(ring):
        n = F.size(ring)
        return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + ring[i]["x"] * ring[(i + 1) % n]["y"] - ring[(i + 1) % n]["x"] * ring[i]["y"])) / 2

    made = both.withColumn("rings", rings).withColumn("area", F.aggregate("rings", F.lit(0.0), lambda s, ring: s + area(ring)))
    return made.where("area > 1e-6").select(key, "side", "station", c("__station").alias("next_station"), "hit_type", "target", "area", "rings")


def lowered(rays: DataFrame, key: str, heads: DataFrame) -> DataFrame:
    """Strips (base_elev_m, endpoint_elev_m, hit_type, target) below their ground by the solved depths (key, head_depth_m):
    the base by that of its own line, the end by that of the line it hits; other ends lie level with the base. Lines
    without a solved depth are not lowered."""
    own = heads.select(key, F.col("head_depth_m").alias("__own"))
    hit = heads.select(F.col(key).alias("target"), F.col("head_depth_m").alias("__hit"))
    base = F.col("base_elev_m") - F.coalesce("__own", F.lit(0.0))
    end = F.when(F.col("hit_type") == "interreach", F.col("endpoint_elev_m") - F.coalesce("__hit", F.lit(0.0))).otherwise(F.col("base_elev_m"))
    return rays.join(own, key, "left").join(hit, "target", "left").withColumn("base_elev_m", base).withColumn("endpoint_elev_m", end).drop("__own", "__hit")
