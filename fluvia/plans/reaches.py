"""Queries on reach lines over rasters: lines come from parts, their raster from the cells of the same parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.operators import reaches
from fluvia.plans.registry import query
from fluvia.sources.tables import table, view

SPACING = 0.4
#: Three vertices of each line, in cell units; a segment may have no length.
_LINES = """
v AS (SELECT p_partkey AS k, (p_partkey % 50) + 0.5::DOUBLE AS ax, floor(p_partkey / 50) + 0.5::DOUBLE AS ay, (p_partkey * 31) % 9 - 4 AS d1, (p_partkey * 47) % 5 - 2 AS e1, (p_partkey * 13) % 7 - 3 AS d2, (p_partkey * 17) % 3 - 1 AS e2 FROM part),
l AS (SELECT k, ax, ay, ax + d1 AS bx, ay + e1 AS b_y, ax + d1 + d2 AS cx, ay + e1 + e2 AS cy, sqrt(CAST(d1*d1 + e1*e1 AS DOUBLE)) AS l1, sqrt(CAST(d2*d2 + e2*e2 AS DOUBLE)) AS l2 FROM v),
sg AS (SELECT k, 0 AS i, ax AS x0, ay AS y0, bx AS x1, b_y AS y1, 0.0::DOUBLE AS s0, l1 AS s1, l1 + l2 AS total FROM l UNION ALL SELECT k, 1, bx, b_y, cx, cy, l1 + l2 - l2, l1 + l2, l1 + l2 FROM l)"""
_STATIONS = """
ss AS (SELECT *, CAST(n AS DOUBLE) * 0.4::DOUBLE AS s FROM (SELECT *, unnest(CASE WHEN ceil(s1 / 0.4::DOUBLE) > ceil(s0 / 0.4::DOUBLE) THEN generate_series(CAST(ceil(s0 / 0.4::DOUBLE) AS BIGINT), CAST(ceil(s1 / 0.4::DOUBLE) AS BIGINT) - 1) ELSE [] END) AS n FROM sg) UNION ALL SELECT *, 0 AS n, s1 AS s FROM sg WHERE i = 1),
sh AS (SELECT *, coalesce((s - s0) / nullif(s1 - s0, 0), 0) AS q, nullif(sqrt((x0-x1)*(x0-x1)+(y0-y1)*(y0-y1)), 0) AS seg FROM ss),
st AS (SELECT k, s, total, x0 + q * (x1 - x0) AS x, y0 + q * (y1 - y0) AS y, coalesce((y0 - y1) / seg, 0) AS nx, coalesce((x1 - x0) / seg, 0) AS ny FROM sh)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    ax, ay = (k % 50) + F.lit(0.5), F.floor(k / 50) + F.lit(0.5)
    bx, by = ax + ((k * 31) % 9 - 4), ay + ((k * 47) % 5 - 2)
    cx, cy = bx + ((k * 13) % 7 - 3), by + ((k * 17) % 3 - 1)
    vertices = F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((ax, ay), (bx, by), (cx, cy))])
    return table(spark, sf_dir, "part").select(k.alias("k"), vertices.alias("points"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reaches.segments(lines(spark, sf_dir), "k")


@query("", _LINES + " SELECT k, i, round(s0, 9) AS s0, round(s1, 9) AS s1 FROM sg")
def arc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arc lengths at the vertices of every line."""
    return parts(spark, sf_dir).select("k", "i", F.round("s0", 9).alias("s0"), F.round("s1", 9).alias("s1"))


@query(
    "fx_cells",
    _LINES
    + ","
    + _STATIONS
    + """, pt AS (SELECT k, x, y FROM st WHERE total >= 3 AND s >= 1.5 AND s <= total - 1.5 UNION ALL SELECT k, x0 + (total/2 - s0) / (s1 - s0) * (x1 - x0), y0 + (total/2 - s0) / (s1 - s0) * (y1 - y0) FROM sg WHERE total / 2 < 1.5 AND s0 <= total / 2 AND total / 2 < s1),
    m AS (SELECT pt.k, max(f.elev) AS acc FROM pt JOIN fx_cells f ON f.r = CAST(floor(pt.y) AS BIGINT) AND f.c = CAST(floor(pt.x) AS BIGINT) GROUP BY 1) SELECT l.k, round(m.acc / 1e6, 9) AS drainage_km2 FROM l LEFT JOIN m USING (k)""",
)
def reach_drainage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drainage of every line: the largest accumulation on it, away from its ends."""
    cells = view(spark, sf_dir, "fx_cells").select("r", "c", F.col("elev").alias("acc"))
    return reaches.reach_drainage(parts(spark, sf_dir), "k", cells, 1.0, SPACING).withColumn("drainage_km2", F.round("drainage_km2", 9))


_SEED_TAIL = """
nd AS (SELECT pt.k, quantile_cont((f.elev - 900) / 1500, 0.9) AS q FROM pt JOIN fx_cells f ON f.r = CAST(floor(pt.y) AS BIGINT) AND f.c = CAST(floor(pt.x) AS BIGINT) GROUP BY 1),
sp AS (SELECT st.k, count(*) FILTER (WHERE f.stream IS NOT NULL AND s > 0 AND s < total) AS known, count(*) FILTER (WHERE f.stream > 0 AND s > 0 AND s < total) AS wet, coalesce(bool_or(f.stream > 0), false) AS anywhere FROM st LEFT JOIN fx_cells f ON f.r = CAST(floor(st.y) AS BIGINT) AND f.c = CAST(floor(st.x) AS BIGINT) GROUP BY 1),
fn AS (SELECT sp.k, q, CASE WHEN known > 0 THEN wet > 0 ELSE anywhere END AS hit, coalesce(wet / nullif(known, 0), 0) AS fraction, coalesce(1 / (1 + exp(-(q - 0.35) / 0.06)), 0) AS soft FROM sp LEFT JOIN nd USING (k))
SELECT k, round(q, 6) AS seed_ndvi_q, hit AS seed_support_hit, round(fraction, 6) AS seed_support_fraction, round(least(greatest(CASE WHEN hit THEN greatest(soft, 1) ELSE soft END, 0), 1), 6) AS seed_strength FROM fn"""


def _seeds(spark: SparkSession, sf_dir: str, corridor: float) -> DataFrame:
    cells = view(spark, sf_dir, "fx_cells").select("r", "c", ((F.col("elev") - 900) / 1500).alias("ndvi"), F.col("stream").cast("double").alias("support"))
    out = reaches.reach_seed(parts(spark, sf_dir), "k", cells, 1.0, SPACING, corridor)
    return out.withColumns({n: F.round(n, 6) for n in ("seed_ndvi_q", "seed_support_fraction", "seed_strength")})


@query("fx_cells", _LINES + "," + _STATIONS + ", pt AS (SELECT k, x, y FROM st)," + _SEED_TAIL)
def reach_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wetness of every line from values and support along it."""
    return _seeds(spark, sf_dir, 0.0)


@query("fx_cells", _LINES + "," + _STATIONS + ", pt AS (SELECT k, x + nx * o AS x, y + ny * o AS y FROM st, (SELECT unnest([-0.8::DOUBLE, -0.4::DOUBLE, 0.0::DOUBLE, 0.4::DOUBLE, 0.8::DOUBLE]) AS o) f)," + _SEED_TAIL)
def corridor_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a corridor on either side of it."""
    return _seeds(spark, sf_dir, 0.8)


@query(
    "fx_cells",
    _LINES
    + """, e AS (SELECT l.k, ax, ay, cx, cy, a.elev AS z0, b.elev AS z1, CASE WHEN a.elev IS NOT NULL AND l.k % 4 <> 0 THEN CAST(floor(a.elev) AS BIGINT) % 7 END AS f0, CASE WHEN b.elev IS NOT NULL THEN CAST(floor(b.elev) AS BIGINT) % 7 END AS f1 FROM l LEFT JOIN fx_cells a ON a.r = CAST(floor(ay) AS BIGINT) AND a.c = CAST(floor(ax) AS BIGINT) LEFT JOIN fx_cells b ON b.r = CAST(floor(cy) AS BIGINT) AND b.c = CAST(floor(cx) AS BIGINT)),
    t AS (SELECT *, coalesce(CASE WHEN f0 <> f1 THEN f0 > f1 END, z1 > z0, false) AS reversed FROM e)
    SELECT k, reversed, round(CASE WHEN reversed THEN cx ELSE ax END, 3) AS up_x, round(CASE WHEN reversed THEN cy ELSE ay END, 3) AS up_y, round(CASE WHEN reversed THEN ax ELSE cx END, 3) AS down_x, round(CASE WHEN reversed THEN ay ELSE cy END, 3) AS down_y,
      CASE WHEN z0 IS NOT NULL AND z1 IS NOT NULL THEN round(greatest(CASE WHEN reversed THEN z1 - z0 ELSE z0 - z1 END, 0), 6) END AS relief_m FROM t""",
)
def oriented_reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines turned downstream, by accumulation where it tells, else by elevation."""
    c = F.col
    ends = lines(spark, sf_dir).select("k", c("points")[0]["x"].alias("x0"), c("points")[0]["y"].alias("y0"), c("points")[2]["x"].alias("x1"), c("points")[2]["y"].alias("y1"))
    cells = view(spark, sf_dir, "fx_cells").select("r", "c", "elev")
    for i in "01":
        ends = reaches.sampled(ends.withColumns({"x": c(f"x{i}"), "y": c(f"y{i}")}), cells, 1.0).drop("x", "y").withColumnRenamed("elev", f"z{i}")
    known = {f"f{i}": F.floor(c(f"z{i}")).cast("long") % 7 for i in "01"}
    known["f0"] = F.when(c("k") % 4 != 0, known["f0"])
    out = reaches.oriented(ends.withColumns(known))
    return out.select("k", "reversed", "up_x", "up_y", "down_x", "down_y", F.round("relief_m", 6).alias("relief_m"))


@query(
    "fx_cells",
    _LINES
    + ","
    + _STATIONS
    + """, e AS (SELECT st.k, s, f.elev AS e FROM st LEFT JOIN fx_cells f ON f.r = CAST(floor(st.y) AS BIGINT) AND f.c = CAST(floor(st.x) AS BIGINT)),
    d AS (SELECT k, s, e, s - lag(s) OVER w AS ds, e - lag(e) OVER w AS de FROM e WHERE e IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY s)),
    m AS (SELECT k, coalesce(median(CASE WHEN abs(ds) > 1e-12 THEN de / ds END), 0) AS m FROM d GROUP BY 1), b AS (SELECT d.k, any_value(m) AS m, median(e - m * s) AS b FROM d JOIN m USING (k) GROUP BY 1),
    t AS (SELECT e.k, s, e, coalesce(m * s + b, 0) AS t FROM e LEFT JOIN b USING (k))
    SELECT k, round(s, 6) AS s, round(t + quantile_cont(e - t, 0.25) OVER (PARTITION BY k ORDER BY s ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM t""",
)
def smoothed_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bed elevations along every line: its robust grade, and the rolling lower quartile of what is left."""
    at = reaches.sampled(reaches.stations(parts(spark, sf_dir), "k", SPACING), view(spark, sf_dir, "fx_cells").select("r", "c", F.col("elev").alias("e")), 1.0)
    return reaches.smoothed_grade(at, "k").select("k", F.round("s", 6).alias("s"), F.round("smooth", 6).alias("smooth"))


#: Rays of length 5 from stations 2 apart, in the box of all columns and the first million rows.
_STRIPS = (
    _LINES
    + ","
    + _STATIONS.replace("0.4::DOUBLE", "2.0::DOUBLE")
    + """, ry AS (SELECT k, CAST(row_number() OVER (PARTITION BY k ORDER BY s, sd) - 1 AS BIGINT) // 2 AS station, CAST(sd AS INT) AS side, x, y, nx * sd * 5.0::DOUBLE AS dx, ny * sd * 5.0::DOUBLE AS dy FROM st, (SELECT unnest([1, -1]) AS sd) q),
    cr AS (SELECT ry.k, station, side, sg.k AS target, ((sg.x0-x)*(sg.y1-sg.y0)-(sg.y0-y)*(sg.x1-sg.x0)) / nullif(dx*(sg.y1-sg.y0)-dy*(sg.x1-sg.x0), 0) AS t, ((sg.x0-x)*dy-(sg.y0-y)*dx) / nullif(dx*(sg.y1-sg.y0)-dy*(sg.x1-sg.x0), 0) AS u FROM ry JOIN sg ON sg.k <> ry.k AND abs(sg.x0 - x) <= 10 AND abs(sg.y0 - y) <= 10),
    ht AS (SELECT k, station, side, min(round(t, 9)) AS t, arg_min(target, {'t': round(t, 9), 'k': target}) AS target FROM cr WHERE t >= -1e-9 AND t <= 1 + 1e-9 AND u >= -1e-9 AND u <= 1 + 1e-9 AND round(t, 9) * 5 >= 1e-6 GROUP BY 1, 2, 3),
    ed AS (SELECT ry.*, ht.t, ht.target, greatest(least(CASE WHEN dx > 0 THEN (50 - x) / dx WHEN dx < 0 THEN (0 - x) / dx END, CASE WHEN dy > 0 THEN (1000000 - y) / dy WHEN dy < 0 THEN (0 - y) / dy END), 0) AS edge FROM ry LEFT JOIN ht USING (k, station, side)),
    hp AS (SELECT *, t IS NOT NULL AND (edge IS NULL OR t <= edge) AS crossed FROM ed),
    sr AS (SELECT k, station, side, x, y, CASE WHEN crossed THEN 'interreach' WHEN coalesce(edge <= 1, false) THEN 'edge' ELSE 'naked' END AS hit_type, CASE WHEN crossed THEN target END AS target, CASE WHEN crossed THEN t WHEN coalesce(edge <= 1, false) THEN edge ELSE 1 END * 5 AS hit_m FROM hp)"""
)


def _strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = parts(spark, sf_dir)
    return reaches.strips(reaches.stations(held, "k", 2.0), held, "k", (0.0, 0.0, 50.0, 1_000_000.0), 5.0, 20.0**0.5)


@query("", _STRIPS + " SELECT k, station, side, hit_type, target, round(hit_m, 6) AS hit_m FROM sr")
def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a strip to either side of every station meets first."""
    return _strips(spark, sf_dir).select("k", "station", "side", "hit_type", "target", F.round("hit_m", 6).alias("hit_m"))


@query(
    "",
    _STRIPS
    + """, w AS (SELECT k, side, station, hit_type, target, lead(station) OVER w AS next_station, lead(hit_type) OVER w AS h, lead(target) OVER w AS g FROM sr WINDOW w AS (PARTITION BY k, side ORDER BY station))
    SELECT k, side, station, next_station, hit_type, target FROM w WHERE hit_type = h AND (hit_type <> 'interreach' OR target = g)""",
)
def wedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring strips that hit alike."""
    return reaches.wedges(_strips(spark, sf_dir), "k")


def _triangle(*places: str) -> str:
    """SQL of a triangle's area; each place is `x|y`."""
    (ax, ay), (bx, by), (cx, cy) = (p.split("|") for p in places)
    return f"abs(({bx} - {ax}) * ({cy} - {ay}) - ({by} - {ay}) * ({cx} - {ax})) / 2"


@query(
    "",
    _STRIPS
    + f""", en AS (SELECT sr.*, sr.x + hp.dx * hit_m / 5 AS ex, sr.y + hp.dy * hit_m / 5 AS ey FROM sr JOIN hp USING (k, station, side)),
    w AS (SELECT *, lead(station) OVER w AS next_station, lead(hit_type) OVER w AS h, lead(target) OVER w AS g, lead(x) OVER w AS fx, lead(y) OVER w AS fy, lead(ex) OVER w AS gx, lead(ey) OVER w AS gy FROM en WINDOW w AS (PARTITION BY k, side ORDER BY station)),
    d AS (SELECT *, (ex - x) * (gy - fy) - (ey - y) * (gx - fx) AS d1, (gx - ex) * (fy - y) - (gy - ey) * (fx - x) AS d2 FROM w WHERE hit_type = h AND (hit_type <> 'interreach' OR target = g)),
    t AS (SELECT *, ((fx - x) * (gy - fy) - (fy - y) * (gx - fx)) / nullif(d1, 0) AS t1, ((fx - x) * (ey - y) - (fy - y) * (ex - x)) / nullif(d1, 0) AS u1, ((x - ex) * (fy - y) - (y - ey) * (fx - x)) / nullif(d2, 0) AS t2, ((x - ex) * (gy - ey) - (y - ey) * (gx - ex)) / nullif(d2, 0) AS u2 FROM d),
    q AS (SELECT *, coalesce(t1 BETWEEN 1e-9 AND 1 - 1e-9 AND u1 BETWEEN 1e-9 AND 1 - 1e-9, false) AS c1, coalesce(t2 BETWEEN 1e-9 AND 1 - 1e-9 AND u2 BETWEEN 1e-9 AND 1 - 1e-9, false) AS c2, x + t1 * (ex - x) AS px, y + t1 * (ey - y) AS py, ex + t2 * (gx - ex) AS qx, ey + t2 * (gy - ey) AS qy FROM t),
    a AS (SELECT *, CASE WHEN c1 THEN {_triangle("x|y", "px|py", "fx|fy")} + {_triangle("ex|ey", "px|py", "gx|gy")} WHEN c2 THEN {_triangle("x|y", "ex|ey", "qx|qy")} + {_triangle("gx|gy", "fx|fy", "qx|qy")}
      ELSE abs(x * ey - ex * y + ex * gy - gx * ey + gx * fy - fx * gy + fx * y - x * fy) / 2 END AS area FROM q)
    SELECT k, side, station, next_station, hit_type, target, round(area, 5) AS area, CASE WHEN c1 OR c2 THEN 2 ELSE 1 END AS n_rings FROM a WHERE area > 1e-6""",
)
def wedge_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The areas between neighbouring strips that hit alike, and of how many rings they are made."""
    made = reaches.wedge_rings(_strips(spark, sf_dir), "k")
    return made.select("k", "side", "station", "next_station", "hit_type", "target", F.round("area", 5).alias("area"), F.size("rings").alias("n_rings"))


@query(
    "",
    _STRIPS
    + """, h AS (SELECT p_partkey AS k, CAST(p_size AS DOUBLE) / 10 AS d FROM part WHERE p_size % 3 <> 0)
    SELECT sr.k, station, side, round(100 - coalesce(a.d, 0), 6) AS base_elev_m, round(CASE WHEN hit_type = 'interreach' THEN 90 - coalesce(b.d, 0) ELSE 100 - coalesce(a.d, 0) END, 6) AS endpoint_elev_m FROM sr LEFT JOIN h a USING (k) LEFT JOIN h b ON b.k = sr.target""",
)
def lowered_strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strips lowered by the solved depths of their own line and of the line they hit."""
    heads = table(spark, sf_dir, "part").where("p_size % 3 <> 0").select(F.col("p_partkey").alias("k"), (F.col("p_size").cast("double") / 10).alias("head_depth_m"))
    rays = _strips(spark, sf_dir).withColumns({"base_elev_m": F.lit(100.0), "endpoint_elev_m": F.lit(90.0)})
    return reaches.lowered(rays, "k", heads).select("k", "station", "side", F.round("base_elev_m", 6).alias("base_elev_m"), F.round("endpoint_elev_m", 6).alias("endpoint_elev_m"))


@query("", "SELECT p_partkey, CASE p_size % 8 WHEN 0 THEN 0.9 WHEN 1 THEN 0.6 WHEN 2 THEN 0.6 WHEN 3 THEN 0.4 WHEN 4 THEN 0.05 ELSE 0.2 END::DOUBLE AS seed FROM part")
def class_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft seeds by class of stream."""
    names = F.array(*[F.lit(n) for n in ("Perennial", "canal_ditch", "ARTIFICIAL_PATH", "intermittent", "ephemeral", "other", "coastline")])
    return table(spark, sf_dir, "part").select("p_partkey", reaches.class_seed(F.get(names, F.col("p_size").cast("int") % 8)).alias("seed"))
