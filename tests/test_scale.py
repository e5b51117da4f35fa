"""What must hold when tables grow: candidates follow k, blocks give what the whole gives, long ways need few rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.lineage import cut
from fluvia.operators import graph, heads, network, solvers, spatial, stats


def scattered(spark, n, clustered, seed):
    rng = np.random.default_rng(seed)
    xy = rng.uniform(0, 1000, (n, 2))
    if clustered:
        xy[: n // 2] = 500 + rng.normal(0, 2, (n // 2, 2))
    return xy, spark.createDataFrame([(i, float(x), float(y), i % 3) for i, (x, y) in enumerate(xy)], "id long, x double, y double, g int")


@pytest.mark.parametrize("clustered", [False, True])
def test_nearest_is_exact_and_its_pairs_follow_k(spark, clustered):
    a, left = scattered(spark, 300, clustered, 1)
    seen = []
    for n in (1_000, 10_000):
        b, right = scattered(spark, n, clustered, 2)
        right = right.toDF("rid", "rx", "ry", "rg")
        found = spatial.nearest_k(left, right, "id", "rid", 4, apart=("g", "rg"))
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "CartesianProduct" not in plan
        got = {}
        for r in found.collect():
            got.setdefault(r.id, {})[r["rank"]] = r.rid
        for i in range(0, 300, 7):
            d = np.where(np.arange(n) % 3 == i % 3, np.inf, np.hypot(*(b - a[i]).T))
            assert [got[i][k] for k in (1, 2, 3, 4)] == np.lexsort((np.arange(n), d))[:4].tolist()
        seen.append(pairs_of(left, right))
    # ten times as dense a table gives each row about as many pairs
    assert seen[1] < 3.5 * seen[0] and max(seen) < 300 * 600


def pairs_of(left, right):
    """Pairs that the last join of the search makes, read from its plan's own numbers."""
    found = spatial.nearest_k(left, right, "id", "rid", 4, apart=("g", "rg"))
    joined = [p for p in (found._jdf.queryExecution().analyzed(),)]
    node = joined[0]
    while node.nodeName() != "Window":
        node = node.children().apply(0)
    rows = node.children().apply(0)
    spark = left.sparkSession
    from pyspark.sql import DataFrame

    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, rows), spark).count()


def test_nearest_within_a_distance(spark):
    a, left = scattered(spark, 200, True, 3)
    b, right = scattered(spark, 500, False, 4)
    found = spatial.nearest_k(left, right.toDF("rid", "rx", "ry", "rg"), "id", "rid", 3, within=25.0).collect()
    want = {(i, int(j)) for i in range(200) for j in np.lexsort((np.arange(500), np.hypot(*(b - a[i]).T)))[:3] if np.hypot(*(b[j] - a[i])) <= 25}
    assert {(r.id, r.rid) for r in found} == want


def test_a_long_river_is_traced(spark):
    rows = spark.createDataFrame([(i, i - 1 if i > 1 else 0) for i in range(1, 301)], "stream_id long, down_id long")
    out = {r.stream_id: (r.n_traces, r.added) for r in network.brought_down(rows, rows.where("stream_id % 100 = 0").select("stream_id", F.lit(2).alias("amount"))).collect()}
    assert out == {i: ((300 - i) // 100 + 1 if i % 100 == 0 else 300 // 100 - i // 100, 2 * ((300 - i) // 100 + 1 if i % 100 == 0 else 300 // 100 - i // 100)) for i in range(1, 301)}
    circle = spark.createDataFrame([(1, 2), (2, 1)], "stream_id long, down_id long")
    with pytest.raises(RuntimeError):
        network.brought_down(circle, circle.select("stream_id", F.lit(1).alias("amount")), max_rounds=5)


def test_caps_are_errors(spark):
    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(30)], "src long, dst long, w double")
    with pytest.raises(RuntimeError):
        network.network_distance(chain, spark.createDataFrame([(0,)], "node long"), max_rounds=3)
    with pytest.raises(RuntimeError):
        graph.connected_components(chain, max_rounds=1)
    with pytest.raises(RuntimeError):
        network.stream_order(spark.createDataFrame([(i, i + 1) for i in range(1, 9)], "stream_id long, down_id long"), max_rounds=2)


def test_numbers_are_gapless(spark):
    df = spark.range(0, 5000, 3).repartition(7).withColumnRenamed("id", "node")
    out = network.numbered(df, "node").orderBy("node").collect()
    assert [r.idx for r in out] == list(range(len(out)))
    assert network.numbered(df.where("false"), "node").count() == 0


def test_trends_by_hand(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(g, float(t), float(round(0.3 * t + rng.normal(0, 3), 1))) for g, n in ((1, 60), (2, 9), (3, 1)) for t in rng.integers(0, 40, n)]
    df = spark.createDataFrame(rows, "g int, t double, v double")
    out = {}
    for size in (2_000, 7):
        monkeypatch.setattr(stats, "PAIRED_ROWS", size)
        out[size] = {r.g: r for r in stats.theil_sen(df, ["g"], "t", "v").collect()}
    assert out[2_000] == out[7] and set(out[7]) == {1, 2}
    for g, r in out[7].items():
        t, v = np.array([x[1:] for x in rows if x[0] == g]).T
        slopes = np.sort([(v[j] - v[i]) / (t[j] - t[i]) for i in range(len(t)) for j in range(len(t)) if t[j] > t[i]])
        n = len(t)
        tied = sum(k * (k - 1) * (2 * k + 5) for x in (t, v) for k in np.unique(x, return_counts=True)[1])
        w = 1.959963984540054 * np.sqrt((n * (n - 1) * (2 * n + 5) - tied) / 18)
        low, high = max(int(np.round((len(slopes) - w) / 2)) - 1, 0), min(int(np.round((len(slopes) + w) / 2)), len(slopes) - 1)
        assert (r.slope, r.low, r.high) == pytest.approx((np.median(slopes), slopes[low], slopes[high]))
        assert r.intercept == pytest.approx(np.median(v) - np.median(slopes) * np.median(t))


def test_heads_in_blocks_are_those_of_the_whole(spark, monkeypatch):
    rng = np.random.default_rng(6)
    n = 40
    down = [None, *[int(rng.integers(max(1, i - 4), i)) for i in range(2, n + 1)]]
    rows = [(i + 1, down[i], 100.0 + i * 4 + float(rng.uniform(0, 9)), float(rng.uniform(1, 4)), float(rng.uniform(4, 90)), float(rng.uniform(50, 500)), float(rng.uniform() < 0.05 or i == 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "stream_id long, down_id long, up_elev_m double, r_target_m double, r_max_m double, length_m double, support_fraction double").withColumns({"down_elev_m": F.col("up_elev_m"), "wetness": F.lit(0.1)})
    monkeypatch.setattr(solvers, "BLOCK_LEVELS", 6)
    assert solvers.network_blocks(df).select("block").distinct().count() > 2
    blocks = {r.stream_id: r.channel_head_m for r in heads.solve_channel_heads(df).collect()}
    monkeypatch.setattr(heads, "network_blocks", lambda reaches: cut(reaches.select("stream_id", F.lit(0).cast("long").alias("block"))))
    whole = {r.stream_id: r.channel_head_m for r in heads.solve_channel_heads(df).collect()}
    assert len(blocks) == n and all(blocks[i] == pytest.approx(whole[i], abs=1e-3) for i in whole)
