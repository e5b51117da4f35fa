"""Queries on reach networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from fluvia.operators import heads, network
from fluvia.operators.graph import connected_components
from fluvia.plans.registry import query
from fluvia.sources.tables import view


def _reaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "fx_reaches")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reaches(spark, sf_dir).select(F.col("stream_id").alias("src"), F.col("down_id").alias("dst"), F.col("length_m").alias("w"))
    return rows.where("dst > 0")


#: The forest that is left when every edge from a reach divisible by 29 is cut: its roots name the components.
_FOREST = "ro AS (SELECT stream_id AS node, stream_id AS root FROM fx_reaches WHERE down_id = 0 OR stream_id % 29 = 0 UNION ALL SELECT f.stream_id, ro.root FROM fx_reaches f JOIN ro ON f.down_id = ro.node WHERE f.stream_id % 29 <> 0 AND f.down_id > 0)"


@query("fx_reaches", _FOREST + ", m AS (SELECT root, min(node) AS component, sum(length_m) AS total, count(*) AS n FROM ro JOIN fx_reaches ON stream_id = node GROUP BY 1) SELECT component, n, total AS length_m FROM m WHERE total >= 5000 AND n > 1")
def components_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected components of at least five kilometres."""
    edges = _edges(spark, sf_dir).where("src % 29 <> 0")
    held = connected_components(edges).join(_reaches(spark, sf_dir).select(F.col("stream_id").alias("node"), "length_m"), "node")
    return held.groupBy("component").agg(F.count("*").alias("n"), F.sum("length_m").alias("length_m")).where("length_m >= 5000")


@query(
    "fx_reaches",
    "up AS (SELECT stream_id AS node, 0 AS hops FROM fx_reaches WHERE seed_strength > 0 UNION ALL SELECT f.down_id, hops + 1 FROM up JOIN fx_reaches f ON f.stream_id = up.node WHERE f.down_id > 0), m AS (SELECT node, min(hops) AS hops FROM up GROUP BY 1) SELECT f.stream_id, coalesce(m.hops, -1) AS seed_hops, m.hops IS NOT NULL AS reachable FROM fx_reaches f LEFT JOIN m ON m.node = f.stream_id",
)
def seed_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fewest steps downstream from a seeded reach; -1 where none leads there."""
    seeds = _reaches(spark, sf_dir).where("seed_strength > 0").select(F.col("stream_id").alias("node"))
    reached = network.hops(_edges(spark, sf_dir), seeds)
    return _reaches(spark, sf_dir).select("stream_id").join(reached.withColumnRenamed("node", "stream_id"), "stream_id", "left").select("stream_id", F.coalesce("hops", F.lit(-1)).alias("seed_hops"), F.col("hops").isNotNull().alias("reachable"))


def _order_sql(levels: int = 20) -> str:
    """Levels of the tree from the deepest up: a reach's children are one level below it."""
    parts = ["dp AS (SELECT stream_id, down_id, CAST(floor(log2(stream_id)) AS INT) AS lv FROM fx_reaches)", f"o{levels} AS (SELECT stream_id, down_id, 0 AS s FROM dp WHERE lv = {levels})"]
    for k in range(levels - 1, -1, -1):
        parts.append(f"m{k} AS (SELECT down_id AS stream_id, max(s) AS b FROM o{k + 1} GROUP BY 1), o{k} AS (SELECT d.stream_id, d.down_id, coalesce(m.b + CASE WHEN (SELECT count(*) FROM o{k + 1} c WHERE c.down_id = d.stream_id AND c.s = m.b) >= 2 THEN 1 ELSE 0 END, 0) AS s FROM dp d LEFT JOIN m{k} m USING (stream_id) WHERE lv = {k})")
    return ", ".join(parts) + ", st AS (" + " UNION ALL ".join(f"SELECT stream_id, CAST(s AS INT) AS strahler FROM o{k}" for k in range(levels + 1)) + ")"


@query("fx_reaches", _order_sql() + " SELECT stream_id, strahler FROM st")
def stream_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.stream_order(_reaches(spark, sf_dir))


_DECAYED = """
a AS (SELECT stream_id AS node, stream_id AS seed, seed_strength AS w, CAST(0 AS DOUBLE) AS dist, CAST(0 AS DOUBLE) AS gain FROM fx_reaches WHERE seed_strength > 0
  UNION ALL SELECT f.stream_id, a.seed, a.w * exp(-f.length_m / (1500.0 * (1 + 0.5 * greatest(f.stream_id % 4 - 1, 0))) - f.relief_m / 25.0), a.dist + f.length_m, a.gain + f.relief_m FROM a JOIN fx_reaches f ON f.down_id = a.node),
b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, dist, seed) AS i FROM a)"""


@query("fx_reaches", _DECAYED + " SELECT f.stream_id, round(coalesce(w, 0), 6) AS weight, coalesce(seed, -1) AS seed, round(dist, 6) AS dist, round(gain, 6) AS gain FROM fx_reaches f LEFT JOIN b ON b.node = f.stream_id AND i = 1")
def upstream_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wetness pulled from downstream, with relief as a barrier."""
    rows = _reaches(spark, sf_dir).withColumn("strahler", F.col("stream_id") % 4)
    pulls = rows.where("down_id > 0").select("stream_id", F.col("down_id").alias("source_id"))
    return _rounded(network.decay_influence(rows, pulls, 1500.0, 25.0, 0.5))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select("stream_id", F.round("weight", 6).alias("weight"), "seed", F.round("dist", 6).alias("dist"), F.round("gain", 6).alias("gain"))


_DOWNWARD = """
a AS (SELECT stream_id AS node, stream_id AS seed, seed_strength AS w, CAST(0 AS DOUBLE) AS dist, CAST(0 AS DOUBLE) AS gain FROM fx_reaches WHERE seed_strength > 0
  UNION ALL SELECT f.stream_id, a.seed, a.w * exp(-f.length_m / 20000.0), a.dist + f.length_m, a.gain + f.relief_m FROM a JOIN fx_reaches g ON g.stream_id = a.node JOIN fx_reaches f ON f.stream_id = g.down_id),
b AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY w DESC, dist, seed) AS i FROM a)"""


@query("fx_reaches", _DOWNWARD + " SELECT f.stream_id, round(coalesce(w, 0), 6) AS weight, coalesce(seed, -1) AS seed, round(dist, 6) AS dist, round(gain, 6) AS gain FROM fx_reaches f LEFT JOIN b ON b.node = f.stream_id AND i = 1")
def downstream_influence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wetness handed downstream, without a barrier."""
    rows = _reaches(spark, sf_dir).withColumn("strahler", F.lit(1))
    pulls = rows.where("down_id > 0").select(F.col("down_id").alias("stream_id"), F.col("stream_id").alias("source_id"))
    return _rounded(network.decay_influence(rows, pulls, 20_000.0, None, 0.0))


_SAG_IN = "sg AS (SELECT stream_id, seed_strength AS weight, CASE WHEN stream_id % 3 <> 0 THEN length_m * 10 END AS dist, CASE WHEN stream_id % 3 <> 0 THEN relief_m * 5 END AS gain, CAST((stream_id % 10) AS DOUBLE) / 10 AS down_weight, CASE WHEN stream_id % 5 <> 0 THEN length_m * 20 END AS down_dist, CASE WHEN stream_id % 7 <> 0 THEN CAST(stream_id % 900 AS DOUBLE) + 1 END AS area_km2 FROM fx_reaches)"


@query(
    "fx_reaches",
    _SAG_IN
    + """, g AS (SELECT stream_id, least(least(greatest(greatest(1 - weight, 0.75 * (1 - exp(-dist / 4000.0)), 1.0 * (1 - exp(-gain / 25.0))), 0), 1), least(greatest(greatest(1 - down_weight, 0.75 * (1 - exp(-down_dist / 20000.0))), 0), 1),
    CASE WHEN area_km2 IS NOT NULL THEN least(greatest((ln(500) - ln(area_km2)) / (ln(500) - ln(50)), 0), 1) END) AS g FROM sg) SELECT stream_id, round(g, 6) AS sag_driver, round(2 + 58 * g, 6) AS r_max_m, round((2 + 58 * g) * pow(g, 2), 6) AS r_target_m FROM g""",
)
def sag_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql("SELECT * FROM (" + _SAG_IN[len("sg AS (") : -1].replace("fx_reaches", "{r}") + ")", r=_reaches(spark, sf_dir))
    return rows.select("stream_id", *[F.round(v, 6).alias(k) for k, v in network.sag_targets().items()])


@query(
    "fx_reaches",
    """u AS (SELECT stream_id AS node, stream_id AS at, CAST(0 AS DOUBLE) AS d FROM fx_reaches UNION ALL SELECT u.node, f.down_id, u.d + f.length_m FROM u JOIN fx_reaches f ON f.stream_id = u.at WHERE f.down_id > 0),
    p AS (SELECT a.node, min(a.d + b.d) AS dist FROM u a JOIN u b ON a.at = b.at AND b.node % 97 = 0 GROUP BY 1) SELECT node AS stream_id, round(dist, 6) AS dist_m FROM p""",
)
def distance_to_mainstem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest way along the network, in either direction, to any of the chosen reaches."""
    sources = _reaches(spark, sf_dir).where("stream_id % 97 = 0").select(F.col("stream_id").alias("node"))
    return network.network_distance(_edges(spark, sf_dir), sources).select(F.col("node").alias("stream_id"), F.round("dist", 6).alias("dist_m"))


@query(
    "fx_reaches",
    """e AS (SELECT stream_id AS s, down_id AS d FROM fx_reaches WHERE down_id > 0), b AS (SELECT s, d FROM e UNION ALL SELECT d, s FROM e),
    k0 AS (SELECT stream_id AS n FROM fx_reaches WHERE stream_id % 211 = 5), k1 AS (SELECT n FROM k0 UNION SELECT d FROM b JOIN k0 ON s = n), k2 AS (SELECT n FROM k1 UNION SELECT d FROM b JOIN k1 ON s = n),
    nm AS (SELECT n, CAST(row_number() OVER (ORDER BY n) - 1 AS INT) AS i FROM k2) SELECT e.s AS src, e.d AS dst, x.i AS src_idx, y.i AS dst_idx FROM e JOIN nm x ON x.n = e.s JOIN nm y ON y.n = e.d""",
)
def pruned_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges within two steps of the chosen reaches, with ids from 0."""
    kept = _reaches(spark, sf_dir).where("stream_id % 211 = 5").select(F.col("stream_id").alias("node"))
    return network.keep_within(_edges(spark, sf_dir).select("src", "dst"), kept, 2)[1].select("src", "dst", "src_idx", "dst_idx")


@query(
    "fx_reaches",
    """n AS (SELECT stream_id, down_id, round(CAST(stream_id AS DOUBLE) / 7, 3) AS ux, round(CAST(down_id AS DOUBLE) / 7, 3) AS dx FROM fx_reaches)
    SELECT DISTINCT u.stream_id AS upstream, d.stream_id AS downstream FROM n u JOIN n d ON u.dx = d.ux AND u.stream_id <> d.stream_id""",
)
def node_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency from rounded end nodes: a reach's lower node is the next one's upper node."""
    rows = _reaches(spark, sf_dir).select("stream_id", F.bround(F.col("stream_id").cast("double") / 7, 3).alias("ux"), F.bround(F.col("down_id").cast("double") / 7, 3).alias("dx"))
    up, down = rows.select(F.col("stream_id").alias("upstream"), F.col("dx").alias("node")), rows.select(F.col("stream_id").alias("downstream"), F.col("ux").alias("node"))
    return up.join(down, "node").where("upstream <> downstream").select("upstream", "downstream").distinct()


@query(
    "fx_reaches",
    """e AS (SELECT a.stream_id AS src, b.stream_id AS dst, a.length_m AS la, b.length_m AS lb, a.relief_m - b.relief_m AS dz, a.stream_id % 4 AS oa, b.stream_id % 4 AS ob FROM fx_reaches a JOIN fx_reaches b ON a.down_id = b.stream_id)
    SELECT src, dst, 'down' AS direction, round(ln(lb / la), 6) AS log_ratio, ob - oa AS order_change, round(dz, 6) AS rel_elev, round(2 / (la + lb), 9) AS conductance FROM e
    UNION ALL SELECT dst, src, 'up', round(ln(la / lb), 6), oa - ob, round(-dz, 6), round(2 / (la + lb), 9) FROM e""",
)
def edge_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges both ways, each with features seen from its source."""
    rows = _reaches(spark, sf_dir)
    a = rows.select(F.col("stream_id").alias("src"), F.col("down_id").alias("dst"), F.col("length_m").alias("la"), F.col("relief_m").alias("za"))
    b = rows.select(F.col("stream_id").alias("dst"), F.col("length_m").alias("lb"), F.col("relief_m").alias("zb"))
    down = a.join(b, "dst").select("src", "dst", "la", "lb", "za", "zb", F.lit("down").alias("direction"))
    up = down.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("lb").alias("la"), F.col("la").alias("lb"), F.col("zb").alias("za"), F.col("za").alias("zb"), F.lit("up").alias("direction"))
    both = down.unionByName(up)
    return both.select("src", "dst", "direction", F.round(F.log(F.col("lb") / F.col("la")), 6).alias("log_ratio"), (F.col("dst") % 4 - F.col("src") % 4).alias("order_change"), F.round(F.col("za") - F.col("zb"), 6).alias("rel_elev"), F.round(2 / (F.col("la") + F.col("lb")), 9).alias("conductance"))


@query("fx_reaches", "t AS (SELECT stream_id AS start, stream_id AS at, 0 AS n FROM fx_reaches UNION ALL SELECT t.start, f.down_id, n + 1 FROM t JOIN fx_reaches f ON f.stream_id = t.at WHERE f.down_id > 0) SELECT t.at AS stream_id, count(*) AS n_traces, CAST(sum(start * 2) AS BIGINT) AS added FROM t GROUP BY 1")
def trace_downstream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An inflow on every reach followed to the outlet, adding what it brings to every reach on the way."""
    rows = _reaches(spark, sf_dir)
    return network.brought_down(rows, rows.select("stream_id", (F.col("stream_id") * 2).alias("amount")))


@query(
    "fx_reaches",
    """s AS (SELECT stream_id, length_m, CAST(unnest(generate_series(0, CAST(floor(length_m / 60) AS BIGINT))) AS BIGINT) AS k FROM fx_reaches),
    p AS (SELECT stream_id, k, k * 60.0::DOUBLE AS s_m FROM s UNION ALL SELECT stream_id, CAST(floor(length_m / 60) AS BIGINT) + 1, length_m FROM fx_reaches WHERE length_m > floor(length_m / 60) * 60)
    SELECT stream_id, k AS station, s_m, lead(k) OVER (PARTITION BY stream_id ORDER BY k) AS next_station, round(s_m - coalesce(lag(s_m) OVER (PARTITION BY stream_id ORDER BY k), 0), 6) AS step_m FROM p""",
)
def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stations of every reach."""
    return _stations(_reaches(spark, sf_dir))


def _stations(reaches: DataFrame) -> DataFrame:
    """Stations along a reach at fixed steps, and one at its end; each with its neighbour, as wedges are formed."""
    whole = F.floor(F.col("length_m") / 60)
    ends = F.when(F.col("length_m") > whole * 60, F.array(F.struct((whole + 1).alias("station"), F.col("length_m").alias("s_m")))).otherwise(F.array().cast("array<struct<station:bigint,s_m:double>>"))
    steps = F.transform(F.sequence(F.lit(0).cast("long"), whole), lambda k: F.struct(k.alias("station"), (k * 60).cast("double").alias("s_m")))
    rows = reaches.select("stream_id", F.explode(F.concat(steps, ends)).alias("p")).select("stream_id", "p.*")
    order = Window.partitionBy("stream_id").orderBy("station")
    return rows.select("stream_id", "station", "s_m", F.lead("station").over(order).alias("next_station"), F.round(F.col("s_m") - F.coalesce(F.lag("s_m").over(order), F.lit(0.0)), 6).alias("step_m"))


@query(
    "fx_reaches",
    "SELECT stream_id, round(quantile_cont(relief_m, 0.25) OVER (PARTITION BY stream_id % 20 ORDER BY stream_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 6) AS q25 FROM fx_reaches",
)
def rolling_quartile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A centred rolling lower quartile, with fewer values at the ends."""
    frame = Window.partitionBy(F.col("stream_id") % 20).orderBy("stream_id").rowsBetween(-3, 3)
    held = _reaches(spark, sf_dir).select("stream_id", F.array_sort(F.collect_list("relief_m").over(frame)).alias("v"))
    at = (F.size("v") - 1) * 0.25
    low = F.floor(at).cast("int")
    a, b = F.get("v", low), F.get("v", F.least(low + 1, F.size("v") - 1))
    return held.select("stream_id", F.round(a + (at - low) * (b - a), 6).alias("q25"))


@query(
    "fx_reaches",
    _FOREST + ", k AS (SELECT ro.root, f.stream_id, row_number() OVER (PARTITION BY ro.root ORDER BY f.stream_id % 3, f.length_m DESC, f.stream_id) AS i FROM ro JOIN fx_reaches f ON f.stream_id = ro.node) SELECT stream_id AS primary_id, (SELECT min(node) FROM ro r2 WHERE r2.root = k.root) AS grp FROM k WHERE i = 1 AND (SELECT count(*) FROM ro r3 WHERE r3.root = k.root) > 1",
)
def primary_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one row that stands for each connected group: best source first, then the largest."""
    groups = connected_components(_edges(spark, sf_dir).where("src % 29 <> 0"))
    rows = groups.join(_reaches(spark, sf_dir).withColumnRenamed("stream_id", "node"), "node")
    order = Window.partitionBy("component").orderBy(F.col("node") % 3, F.desc("length_m"), "node")
    return rows.withColumn("i", F.row_number().over(order)).where("i = 1").select(F.col("node").alias("primary_id"), F.col("component").alias("grp"))


@query()
def head_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel heads of the whole network by relaxation; no SQL expresses the sweeps."""
    c = F.col
    bed = 100 + 10 * F.log2(c("stream_id").cast("double"))
    ready = _reaches(spark, sf_dir).select("stream_id", "down_id", (bed + c("relief_m") / 2).alias("up_elev_m"), (bed - c("relief_m") / 2).alias("down_elev_m"), "length_m", c("seed_strength").alias("wetness"), F.when(c("seed_strength") >= 0.7, 1.0).otherwise(0.0).alias("support_fraction"), (2 + c("relief_m")).alias("r_target_m"), (5 + 2 * c("relief_m")).alias("r_max_m"))
    return heads.solve_channel_heads(ready)
