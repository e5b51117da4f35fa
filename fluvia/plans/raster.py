"""Queries on cell tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.functions import hydro
from fluvia.operators import raster, solvers
from fluvia.operators.graph import connected_components
from fluvia.plans.registry import query
from fluvia.sources.tables import table, view

_GAUSS = "kn AS (SELECT dr, dc, exp(-(dr*dr+dc*dc) / (2 * 2.0 * 2.0)) AS w FROM (SELECT unnest(generate_series(-6, 6)) AS dr) a, (SELECT unnest(generate_series(-6, 6)) AS dc) b WHERE sqrt(dr*dr+dc*dc) <= 6)"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_cells")


@query("fx_cells", "m AS (SELECT floor((max(r)+1)/7) AS nr, floor((max(c)+1)/7) AS nc FROM fx_cells) SELECT CAST(floor(r/7) AS BIGINT) AS r, CAST(floor(c/7) AS BIGINT) AS c, round(avg(elev), 6) AS value, count(elev) AS n FROM fx_cells, m WHERE floor(r/7) < nr AND floor(c/7) < nc GROUP BY 1, 2")
def raster_coarsen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.coarsen(_cells(spark, sf_dir), 7, "elev").withColumn("value", F.round("value", 6))


@query(
    "fx_cells",
    """n AS (SELECT r, c, elev, lag(elev) OVER (PARTITION BY c ORDER BY r) AS u, lead(elev) OVER (PARTITION BY c ORDER BY r) AS d, lag(elev) OVER (PARTITION BY r ORDER BY c) AS l, lead(elev) OVER (PARTITION BY r ORDER BY c) AS g FROM fx_cells),
    v AS (SELECT r, c, CASE WHEN u IS NULL THEN (d-elev)/10 WHEN d IS NULL THEN (elev-u)/10 ELSE (d-u)/20 END AS dy, CASE WHEN l IS NULL THEN (g-elev)/10 WHEN g IS NULL THEN (elev-l)/10 ELSE (g-l)/20 END AS dx FROM n)
    SELECT r, c, round(dx, 6) AS dx, round(dy, 6) AS dy, round(sqrt(dx*dx+dy*dy), 6) AS slope, round(-dx/nullif(sqrt(dx*dx+dy*dy), 0), 6) AS ux FROM v""",
)
def raster_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.gradient(_cells(spark, sf_dir), "elev", 10.0)
    return out.select("r", "c", *[F.round(x, 6).alias(x) for x in ("dx", "dy", "slope", "ux")])


@query("fx_cells", _GAUSS + ", g AS (SELECT a.r, a.c, sum(k.w * b.elev) / sum(k.w) AS v FROM fx_cells a JOIN kn k ON true JOIN fx_cells b ON b.r = a.r + k.dr AND b.c = a.c + k.dc AND b.elev < 980 GROUP BY 1, 2) SELECT a.r, a.c, round(v, 6) AS value FROM fx_cells a LEFT JOIN g USING (r, c)")
def raster_gaussian(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing that skips missing cells."""
    cells = _cells(spark, sf_dir).select("r", "c", F.when(F.col("elev") < 980, F.col("elev")).alias("value"))
    out = raster.focal_mean(cells, raster.offsets(spark, 6, raster.gaussian(6, 2.0)))
    return out.select("r", "c", F.round("focal", 6).alias("value"))


_NEAR = "nr AS (SELECT a.r, a.c, b.elev AS water, sqrt((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c)) AS d, row_number() OVER (PARTITION BY a.r, a.c ORDER BY sqrt((a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c)), b.r, b.c) AS i FROM fx_cells a JOIN fx_cells b ON b.stream = 1)"


@query("fx_cells", _NEAR + " SELECT r, c, water AS value, round(d, 6) AS distance FROM nr WHERE i = 1")
def raster_nearest_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    out = raster.nearest_fill(cells, cells.where("stream = 1").select("r", "c", F.col("elev").alias("value")))
    return out.select("r", "c", "value", F.round("distance_m", 6).alias("distance"))


@query(
    "fx_cells",
    _GAUSS
    + ","
    + _NEAR
    + """, w AS (SELECT a.r, a.c, a.elev, least(water, elev) AS water, d FROM fx_cells a JOIN nr USING (r, c) WHERE i = 1), s AS (SELECT a.r, a.c, sum(k.w * b.water) / sum(k.w) AS v FROM w a JOIN kn k ON true JOIN w b ON b.r = a.r + k.dr AND b.c = a.c + k.dc GROUP BY 1, 2)
    SELECT w.r, w.c, round(CASE WHEN d <= 4 THEN greatest(elev - least(v, elev), 0) END, 6) AS rem FROM w JOIN s USING (r, c)""",
)
def relative_elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height above the water surface."""
    return raster.relative_elevation(_cells(spark, sf_dir), spark, 2.0, 4.0).withColumn("rem", F.round("rem", 6))


@query("fx_cells", "SELECT CAST(floor(r/8)*100 + floor(c/8) AS BIGINT) AS zone, count(*) AS rem_count, round(avg(elev), 6) AS rem_mean, min(elev) AS rem_min, max(elev) AS rem_max FROM fx_cells WHERE stream = 0 GROUP BY 1")
def zonal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _cells(spark, sf_dir)
    zones = cells.select("r", "c", (F.floor(F.col("r") / 8) * 100 + F.floor(F.col("c") / 8)).alias("zone"))
    known = cells.select("r", "c", F.when(F.col("stream") == 0, F.col("elev")).alias("value"))
    return raster.zonal(known, zones).withColumn("rem_mean", F.round("rem_mean", 6))


_STRIPS = "st AS (SELECT s_suppkey AS id, CAST((s_suppkey*37)%480 AS DOUBLE) + 0.25 AS ax, CAST((s_suppkey*53)%390 AS DOUBLE) + 0.25 AS ay, CAST((s_suppkey*37)%480 + 30 AS DOUBLE) + 0.25 AS bx, CAST((s_suppkey*53)%390 + 40 AS DOUBLE) + 0.25 AS by_, CAST(900 + s_suppkey%50 AS DOUBLE) AS va, CAST(910 + s_suppkey%70 AS DOUBLE) AS vb FROM supplier)"
_BURNT = """
sk AS (SELECT *, CAST(greatest(ceil(sqrt((bx-ax)*(bx-ax)+(by_-ay)*(by_-ay)) / 5.0), 1) AS BIGINT) AS steps FROM st), sq AS (SELECT *, unnest(generate_series(0, steps)) AS k FROM sk),
sp AS (SELECT CAST(floor((ay + (k / steps) * (by_-ay)) / 10) AS BIGINT) AS r, CAST(floor((ax + (k / steps) * (bx-ax)) / 10) AS BIGINT) AS c, va + (k / steps) * (vb-va) AS v FROM sq), bu AS (SELECT r, c, min(v) AS value, count(*) AS n FROM sp GROUP BY 1, 2)"""


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    x, y = ((k * 37) % 480).cast("double") + 0.25, ((k * 53) % 390).cast("double") + 0.25
    return table(spark, sf_dir, "supplier").select(k.alias("id"), x.alias("ax"), y.alias("ay"), (x + 30).alias("bx"), (y + 40).alias("by"), (900 + k % 50).cast("double").alias("va"), (910 + k % 70).cast("double").alias("vb"))


@query("", _STRIPS + "," + _BURNT + " SELECT r, c, round(value, 6) AS value, n FROM bu")
def strip_burn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least elevation and count of strip samples per cell."""
    return raster.burn(_strips(spark, sf_dir), 10.0).withColumn("value", F.round("value", 6))


@query(
    "fx_cells",
    _STRIPS
    + ","
    + _BURNT
    + """, kn AS (SELECT dr, dc, 1 / pow(greatest(sqrt(dr*dr+dc*dc), 0.5), 2) AS w FROM (SELECT unnest(generate_series(-3, 3)) AS dr) a, (SELECT unnest(generate_series(-3, 3)) AS dc) b WHERE sqrt(dr*dr+dc*dc) <= 3),
    f AS (SELECT b.r + k.dr AS r, b.c + k.dc AS c, sum(k.w * b.n * b.value) / sum(k.w * b.n) AS v FROM bu b, kn k GROUP BY 1, 2) SELECT a.r, a.c, round(CASE WHEN v IS NOT NULL THEN least(v, elev) END, 6) AS value FROM fx_cells a LEFT JOIN f USING (r, c)""",
)
def strip_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Burned strips spread over the cells around them, not above the ground."""
    out = raster.strip_fill(_cells(spark, sf_dir), raster.burn(_strips(spark, sf_dir), 10.0), spark, 3, 2)
    return out.select("r", "c", F.round("value", 6).alias("value"))


@query("fx_cells", "SELECT a.r, a.c, min(b.elev) AS lowest, round(max(b.elev) - min(b.elev), 6) AS relief, round(median(b.elev), 6) AS middle FROM fx_cells a JOIN fx_cells b ON abs(a.r-b.r) <= 2 AND abs(a.c-b.c) <= 2 AND (a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c) <= 4 GROUP BY 1, 2")
def focal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = raster.focal_stats(_cells(spark, sf_dir), raster.offsets(spark, 2), "elev")
    return out.select("r", "c", "lowest", F.round("relief", 6).alias("relief"), F.round("middle", 6).alias("middle"))


@query("fx_cells", "k AS (SELECT a.r, a.c, b.r AS sr, b.c AS sc, row_number() OVER (PARTITION BY a.r, a.c ORDER BY b.elev DESC, b.r, b.c) AS i FROM fx_cells a JOIN fx_cells b ON abs(a.r-b.r) <= 2 AND abs(a.c-b.c) <= 2 WHERE a.stream = 1) SELECT r, c, sr, sc FROM k WHERE i = 1")
def snap_to_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stream cell moves to the largest value of its 5 x 5 window, ties to the first in row-major order."""
    cells = _cells(spark, sf_dir)
    square = spark.createDataFrame([(a, b) for a in range(-2, 3) for b in range(-2, 3)], "dr bigint, dc bigint")
    wanted = cells.where("stream = 1").select("r", "c").crossJoin(F.broadcast(square)).withColumns({"sr": F.col("r") + F.col("dr"), "sc": F.col("c") + F.col("dc")})
    met = wanted.join(cells.select(F.col("r").alias("sr"), F.col("c").alias("sc"), "elev"), ["sr", "sc"])
    return met.groupBy("r", "c").agg(F.max_by(F.struct("sr", "sc"), F.struct("elev", -F.col("sr"), -F.col("sc"))).alias("s")).select("r", "c", "s.sr", "s.sc")


@query("", "SELECT l_partkey % 50 AS c, CAST(year(l_shipdate) AS INT) AS year, count(*) AS n, round(median(l_discount), 6) AS p50, round(quantile_cont(l_extendedprice, 0.25), 6) AS p25, round(quantile_cont(l_extendedprice, 0.75), 6) AS p75, max(l_quantity) AS peak FROM lineitem GROUP BY 1, 2")
def temporal_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, quartiles, peaks and counts per cell and year."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy((F.col("l_partkey") % 50).alias("c"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"), F.round(F.median("l_discount"), 6).alias("p50"), F.round(F.percentile("l_extendedprice", F.lit(0.25)), 6).alias("p25"), F.round(F.percentile("l_extendedprice", F.lit(0.75)), 6).alias("p75"), F.max("l_quantity").alias("peak"))


@query(
    "fx_points fx_cells",
    """p AS (SELECT point_id, x / 400 AS gx, y / 500 AS gy FROM fx_points), i AS (SELECT *, CAST(floor(gx) AS BIGINT) AS c0, CAST(floor(gy) AS BIGINT) AS r0, CAST(round_even(gx, 0) AS BIGINT) AS cn, CAST(round_even(gy, 0) AS BIGINT) AS rn FROM p)
    SELECT point_id, n.elev AS nearest, round((1-(gy-r0))*(1-(gx-c0))*a.elev + (1-(gy-r0))*(gx-c0)*b.elev + (gy-r0)*(1-(gx-c0))*d.elev + (gy-r0)*(gx-c0)*e.elev, 6) AS bilinear FROM i LEFT JOIN fx_cells n ON n.r = rn AND n.c = cn
    LEFT JOIN fx_cells a ON a.r = r0 AND a.c = c0 LEFT JOIN fx_cells b ON b.r = r0 AND b.c = c0 + 1 LEFT JOIN fx_cells d ON d.r = r0 + 1 AND d.c = c0 LEFT JOIN fx_cells e ON e.r = r0 + 1 AND e.c = c0 + 1""",
)
def point_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest and bilinear samples of the cells at points; null outside the grid."""
    p = view(spark, sf_dir, "fx_points").select("point_id", (F.col("x") / 400).alias("gx"), (F.col("y") / 500).alias("gy")).withColumns({"c0": F.floor("gx"), "r0": F.floor("gy"), "cn": F.rint("gx").cast("long"), "rn": F.rint("gy").cast("long")})
    cells = _cells(spark, sf_dir).select("r", "c", "elev")
    out = p.join(cells.toDF("rn", "cn", "nearest"), ["rn", "cn"], "left")
    fy, fx = F.col("gy") - F.col("r0"), F.col("gx") - F.col("c0")
    corner = [(dr, dc) for dr in (0, 1) for dc in (0, 1)]
    wanted = p.select("point_id", (((1 - fy) * (1 - fx))).alias("w00"), ((1 - fy) * fx).alias("w01"), (fy * (1 - fx)).alias("w10"), (fy * fx).alias("w11"), "r0", "c0")
    long = wanted.select("point_id", F.explode(F.array(*[F.struct((F.col("r0") + dr).alias("r"), (F.col("c0") + dc).alias("c"), F.col(f"w{dr}{dc}").alias("w")) for dr, dc in corner])).alias("k")).select("point_id", "k.*")
    four = long.join(cells, ["r", "c"], "left").groupBy("point_id").agg(F.when(F.count("elev") == 4, F.sum(F.col("w") * F.col("elev"))).alias("bilinear"))
    return out.join(four, "point_id").select("point_id", "nearest", F.round("bilinear", 6).alias("bilinear"))


@query(
    "fx_cells",
    """t AS (SELECT 2 AS rank, r, c, elev AS v FROM fx_cells UNION ALL SELECT 1, r, c, CASE WHEN stream = 1 THEN NULL ELSE elev + 100 END FROM fx_cells WHERE c < 20), m AS (SELECT r, c, arg_min(v, rank) AS v, min(rank) AS rank FROM t WHERE v IS NOT NULL GROUP BY 1, 2),
    u AS (SELECT r, c, v FROM m WHERE NOT (r < 10 AND c < 10) UNION ALL SELECT r, c, elev - 1 FROM fx_cells WHERE r < 10 AND c < 10 AND stream = 0) SELECT r, c, round(v, 6) AS value FROM u""",
)
def mosaic_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles merged, the first known value winning; then a footprint cleared and written anew, twice."""
    cells = _cells(spark, sf_dir)
    tiles = cells.select(F.lit(2).alias("rank"), "r", "c", F.col("elev").alias("value")).unionByName(cells.where("c < 20").select(F.lit(1).alias("rank"), "r", "c", F.when(F.col("stream") != 1, F.col("elev") + 100).alias("value")))
    merged = raster.mosaic(tiles).select("r", "c", "value")
    footprint = cells.where("r < 10 and c < 10").select("r", "c")
    source = cells.select("r", "c", F.when(F.col("stream") == 0, F.col("elev") - 1).alias("value"))
    once = raster.upsert(merged, source, footprint)
    return raster.upsert(once, source, footprint).withColumn("value", F.round("value", 6))


@query("fx_cells", "SELECT a.r, a.c, round(a.elev - b.elev, 6) AS diff, round(abs(a.elev - b.elev), 6) AS absdiff, CASE WHEN b.elev IS NULL THEN 255 ELSE CASE WHEN a.elev <= 930 THEN 1 ELSE 0 END + 2 * CASE WHEN b.elev <= 930 THEN 1 ELSE 0 END END AS agree FROM fx_cells a LEFT JOIN fx_cells b ON b.r = a.c AND b.c = a.r")
def raster_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two rasters and the class of their agreement on low ground."""
    a = _cells(spark, sf_dir)
    b = a.select(F.col("c").alias("r"), F.col("r").alias("c"), F.col("elev").alias("other"))
    low, other = (F.col("elev") <= 930).cast("int"), (F.col("other") <= 930).cast("int")
    return a.join(b, ["r", "c"], "left").select("r", "c", F.round(F.col("elev") - F.col("other"), 6).alias("diff"), F.round(F.abs(F.col("elev") - F.col("other")), 6).alias("absdiff"), F.coalesce(low + 2 * other, F.lit(255)).alias("agree"))


@query(
    "fx_cells",
    """b AS (SELECT r, c, CAST((r*7+c*3)%50 AS DOUBLE) AS green, CAST((r*5+c*11)%60 AS DOUBLE) AS nir, (r*13+c*17)%64 AS qa, stream FROM fx_cells)
    SELECT r, c, round(CASE WHEN green + nir <> 0 THEN (green-nir)/(green+nir) ELSE 0 END, 6) AS ndwi, qa & 62 = 0 AS clear, stream = 1 AND CASE WHEN green + nir <> 0 THEN (green-nir)/(green+nir) ELSE 0 END > 0.1 AS water FROM b""",
)
def index_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A normalised index, the cloud bits of a quality word, and the mask of stream cells with water."""
    r, c = F.col("r"), F.col("c")
    bands = _cells(spark, sf_dir).withColumns({"green": ((r * 7 + c * 3) % 50).cast("double"), "nir": ((r * 5 + c * 11) % 60).cast("double"), "qa": (r * 13 + c * 17) % 64})
    index = hydro.normalized_difference(F.col("green"), F.col("nir"))
    return bands.select("r", "c", F.round(index, 6).alias("ndwi"), (F.col("qa").bitwiseAND(62) == 0).alias("clear"), ((F.col("stream") == 1) & (index > 0.1)).alias("water"))


_DOWN = "dn AS (SELECT r, c, tr, tc FROM (SELECT a.r, a.c, b.r AS tr, b.c AS tc, row_number() OVER (PARTITION BY a.r, a.c ORDER BY b.elev, b.r, b.c) AS i FROM fx_cells a JOIN fx_cells b ON abs(a.r-b.r) <= 1 AND abs(a.c-b.c) <= 1 AND b.elev < a.elev) WHERE i = 1)"


@query("fx_cells", _DOWN + ", w AS (SELECT r, c, r AS ar, c AS ac FROM fx_cells UNION ALL SELECT w.r, w.c, dn.tr, dn.tc FROM w JOIN dn ON dn.r = w.ar AND dn.c = w.ac) SELECT ar AS r, ac AS c, count(*) AS acc FROM w GROUP BY 1, 2")
def flow_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose way downhill leads through each cell, itself included, along an acyclic pointer table."""
    cells = _cells(spark, sf_dir)
    return raster.accumulate(cells, raster.downhill(cells, spark))


@query("fx_cells", _DOWN + " SELECT dn.tr, dn.tc, arg_max(dn.r * 1000 + dn.c, {'e': a.elev, 'k': -(dn.r * 1000 + dn.c)}) AS inflow, count(*) AS n FROM dn JOIN fx_cells a USING (r, c) WHERE dn.tc BETWEEN 10 AND 19 AND NOT (dn.c BETWEEN 10 AND 19) GROUP BY 1, 2")
def boundary_inflows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells outside an area that drain into it, the strongest one for each target."""
    cells = _cells(spark, sf_dir)
    crossing = raster.downhill(cells, spark).where("tc between 10 and 19 and not (c between 10 and 19)").join(cells.select("r", "c", "elev"), ["r", "c"])
    code = F.col("r") * 1000 + F.col("c")
    return crossing.groupBy("tr", "tc").agg(F.max_by(code, F.struct("elev", -code)).alias("inflow"), F.count("*").alias("n"))


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of low cells by their four neighbours."""
    low = _cells(spark, sf_dir).where("elev < 950").withColumn("cell", F.col("r") * 1000 + F.col("c"))
    ids = low.select("cell")
    ends = [ids.select(F.col("cell").alias("src"), (F.col("cell") + step).alias("dst")).join(ids.select(F.col("cell").alias("dst")), "dst").select("src", "dst") for step in (1, 1000)]
    labels = connected_components(ends[0].unionByName(ends[1])).withColumnRenamed("node", "cell")
    return low.join(labels, "cell", "left").withColumn("component", F.coalesce("component", "cell"))


@query(
    "fx_cells",
    """lo AS (SELECT r * 1000 + c AS id FROM fx_cells WHERE elev < 950), ed AS (SELECT a.id AS s, b.id AS d FROM lo a JOIN lo b ON abs(a.id - b.id) IN (1, 1000)),
    re AS (SELECT id, id AS to_ FROM lo UNION SELECT re.id, ed.d FROM re JOIN ed ON ed.s = re.to_), m AS (SELECT id, min(to_) AS component FROM re GROUP BY 1) SELECT component, count(*) AS n FROM m GROUP BY 1""",
)
def cell_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _domains(spark, sf_dir).groupBy("component").agg(F.count("*").alias("n"))


@query()
def dirichlet_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smooth surface through anchors of each component; no SQL expresses the solve."""
    cells = _domains(spark, sf_dir).select("component", "r", "c", F.when((F.col("cell") % 17 == 0) | (F.col("cell") == F.col("component")), F.col("elev")).alias("anchor"))
    return solvers.dirichlet_surface(cells)


@query()
def robust_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A membrane through most observations, below its caps."""
    cells = _domains(spark, sf_dir).select("component", "r", "c", F.when(F.col("cell") % 5 == 0, F.col("elev")).alias("observed"), F.when(F.col("stream") == 1, F.col("elev")).alias("cap"))
    return solvers.robust_surface(cells)


@query("fx_cells", "h AS (SELECT r, c, elev, elev + ((r*3+c*5)%21 - 12) AS head FROM fx_cells) SELECT r, c, round(least(head, elev), 6) AS head, round(elev - least(head, elev), 6) AS dtw, CASE WHEN (r*c)%11 = 0 AND abs((r*3+c*5)%21 - 12) >= 5 THEN elev END AS anchor FROM h")
def final_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads held at or below ground, the depth to them, and anchors where a magnitude is reached."""
    shift = (F.col("r") * 3 + F.col("c") * 5) % 21 - 12
    head = F.least(F.col("elev") + shift, F.col("elev"))
    return _cells(spark, sf_dir).select("r", "c", F.round(head, 6).alias("head"), F.round(F.col("elev") - head, 6).alias("dtw"), F.when(((F.col("r") * F.col("c")) % 11 == 0) & (F.abs(shift) >= 5), F.col("elev")).alias("anchor"))


@query("fx_cells", "a AS (SELECT r, c, CASE WHEN (r+c)%3 = 0 THEN elev END AS v1, CASE WHEN (r+c)%5 = 0 THEN elev + 1 END AS v2 FROM fx_cells) SELECT r, c, coalesce(v1, v2) AS value, CASE WHEN v1 IS NOT NULL THEN 't1' WHEN v2 IS NOT NULL THEN 't2' END AS tile, v1 IS NULL AND v2 IS NULL AS missing FROM a")
def first_finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first known value of several rasters, and which raster it came from."""
    at = F.col("r") + F.col("c")
    v1, v2 = F.when(at % 3 == 0, F.col("elev")), F.when(at % 5 == 0, F.col("elev") + 1)
    best = F.coalesce(F.when(v1.isNotNull(), F.struct(v1.alias("value"), F.lit("t1").alias("tile"))), F.when(v2.isNotNull(), F.struct(v2.alias("value"), F.lit("t2").alias("tile"))))
    return _cells(spark, sf_dir).select("r", "c", best.alias("b")).select("r", "c", "b.value", "b.tile", F.col("b.value").isNull().alias("missing"))


@query(
    "fx_cells",
    """b AS (SELECT r, c, (r * 3701 + c * 977) % 14500 - 3500 AS dn, CASE WHEN (r + c) % 6 < 5 THEN (r + c) % 6 ELSE 255 END AS rel, (r * 131 + c * 17) % 128 AS qa, 7000 + (r * 53 + c * 29) % 9000 AS red, 7000 + (r * 31 + c * 71) % 20000 AS nir FROM fx_cells),
    v AS (SELECT *, rel IN (0, 1) AND dn <> -3000 AND dn BETWEEN -2000 AND 10000 AS ok, red * 0.0000275 - 0.2 AS rr, nir * 0.0000275 - 0.2 AS nn FROM b)
    SELECT r, c, ok AS valid, round(CASE WHEN ok THEN dn * 1e-4 END, 6) AS ndvi, round(CASE WHEN qa & 62 = 0 AND nn + rr <> 0 THEN (nn - rr) / (nn + rr) END, 6) AS clear_ndvi FROM v""",
)
def vegetation_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usable values of a stored index, scaled; and the index of clear reflectances."""
    r, c = F.col("r"), F.col("c")
    at = (r + c) % 6
    bands = _cells(spark, sf_dir).withColumns({"dn": (r * 3701 + c * 977) % 14500 - 3500, "rel": F.when(at < 5, at).otherwise(255), "qa": (r * 131 + c * 17) % 128, "red": (7000 + (r * 53 + c * 29) % 9000).cast("double"), "nir": (7000 + (r * 31 + c * 71) % 20000).cast("double")})
    return bands.select("r", "c", hydro.valid_index(F.col("dn"), F.col("rel")).alias("valid"), F.round(hydro.scaled_index(F.col("dn"), F.col("rel")), 6).alias("ndvi"), F.round(hydro.clear_index(F.col("red"), F.col("nir"), F.col("qa")), 6).alias("clear_ndvi"))


@query(
    "fx_cells fx_fields",
    """w AS (SELECT fid, CAST(floor((cx / 400 - 1.3) / 1.0) AS BIGINT) AS c0, CAST(ceil((cx / 400 + 1.3) / 1.0) AS BIGINT) AS c1, CAST(floor((cy / 4000 - 1.3) / 1.0) AS BIGINT) AS r0, CAST(ceil((cy / 4000 + 1.3) / 1.0) AS BIGINT) AS r1 FROM fx_fields)
    SELECT fid, c0, c1, r0, r1, count(f.elev) AS n, round(max(f.elev), 6) AS highest, max(CASE WHEN f.elev >= 1000 THEN 1 ELSE 0 END) AS support, count(f.elev) = (c1 - c0) * (r1 - r0) AS complete FROM w LEFT JOIN fx_cells f ON f.c >= c0 AND f.c < c1 AND f.r >= r0 AND f.r < r1 GROUP BY 1, 2, 3, 4, 5""",
)
def snapped_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around fields, snapped outwards to the grid; what the raster holds in them, whether any value reaches the
    support's threshold, and whether the window is complete."""
    c = F.col
    edge = {"c0": F.floor(c("cx") / 400 - 1.3), "c1": F.ceil(c("cx") / 400 + 1.3), "r0": F.floor(c("cy") / 4000 - 1.3), "r1": F.ceil(c("cy") / 4000 + 1.3)}
    windows = view(spark, sf_dir, "fx_fields").select("fid", *[v.cast("long").alias(k) for k, v in edge.items()])
    over = windows.withColumn("r", F.explode(F.sequence("r0", c("r1") - 1))).withColumn("c", F.explode(F.sequence("c0", c("c1") - 1)))
    held = over.join(_cells(spark, sf_dir), ["r", "c"], "left").groupBy("fid", "c0", "c1", "r0", "r1")
    out = held.agg(F.count("elev").alias("n"), F.round(F.max("elev"), 6).alias("highest"), F.max(F.coalesce((c("elev") >= 1000).cast("int"), F.lit(0))).alias("support"))
    return out.withColumn("complete", c("n") == (c("c1") - c("c0")) * (c("r1") - c("r0")))
