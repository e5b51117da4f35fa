"""Long and random networks by doubled pointers and contraction, against plain walks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from fluvia.operators import network


def walks(down, n):
    """Children of each reach and an order in which those above come first."""
    above = {i: [] for i in range(1, n + 1)}
    for i, d in down.items():
        if d in above:
            above[d].append(i)
    order, stack = [], [i for i, d in down.items() if d not in above]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += above[i]
    return above, order[::-1]


def forest(n, reach, seed):
    rng = random.Random(seed)
    down = {i: rng.randint(max(1, i - reach), i - 1) if i > 1 and rng.random() > 0.01 else 0 for i in range(1, n + 1)}
    return rng, down


@pytest.mark.parametrize("n, reach", [(400, 3), (400, 400), (400, 1)])
def test_orders_hops_and_distances(spark, n, reach):
    rng, down = forest(n, reach, n + reach)
    above, order = walks(down, n)
    strahler = {}
    for i in order:
        o = sorted((strahler[c] for c in above[i]), reverse=True)
        strahler[i] = 0 if not o else o[0] + (o.count(o[0]) >= 2)
    rows = spark.createDataFrame(list(down.items()), "stream_id long, down_id long")
    got = network.stream_order(rows).collect()
    assert len(got) == n and {r.stream_id: r.strahler for r in got} == strahler

    seeds = [i for i in down if rng.random() < 0.03]
    start = spark.createDataFrame([(i,) for i in seeds + seeds], "node long")
    length = {i: float(rng.randint(1, 50)) for i in down}
    edges = spark.createDataFrame([(i, d, length[i]) for i, d in down.items() if d], "src long, dst long, w double")
    hops = {i: 0 for i in seeds}
    for i in order:
        for c in above[i]:
            if c in hops:
                hops[i] = min(hops.get(i, math.inf), hops[c] + 1)
    assert {r.node: r.hops for r in network.hops(edges, start).collect()} == hops
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    fewest = {}
    for i in order[::-1]:
        fewest[i] = 0 if i in seeds else fewest.get(down[i], math.inf) + 1
    assert {r.node: r.hops for r in network.hops(turned, start).collect()} == {i: h for i, h in fewest.items() if h < math.inf}

    dist = {i: 0.0 for i in seeds}
    for i in order:
        for c in above[i]:
            dist[i] = min(dist.get(i, math.inf), dist.get(c, math.inf) + length[c])
    for i in order[::-1]:
        if down[i]:
            dist[i] = min(dist.get(i, math.inf), dist[down[i]] + length[i])
    want = {i: d for i, d in dist.items() if d < math.inf}
    for e in (edges, turned, edges.unionByName(edges.withColumn("w", F.col("w") + 3))):
        assert {r.node: r.dist for r in network.network_distance(e, start).collect()} == want


@pytest.mark.parametrize("down_to_up", [True, False])
def test_influence_equals_that_of_rounds(spark, down_to_up):
    rng, down = forest(300, 5, 9)
    rows = [(i, float(rng.randint(10, 900)), None if i % 11 == 0 else float(rng.randint(0, 9)), rng.randint(0, 3), rng.choice([0.2, 0.7, 1.0]) if rng.random() < 0.05 else 0.0) for i in down]
    reaches = spark.createDataFrame(rows, "stream_id long, length_m double, relief_m double, strahler int, seed_strength double")
    pairs = [(i, d) if down_to_up else (d, i) for i, d in down.items() if d]
    edges = spark.createDataFrame(pairs, "stream_id long, source_id long")
    own = {r[0]: r for r in rows}
    decay = {i: math.exp(-r[1] / (1500 * (1 + 0.5 * max(r[3] - 1, 0))) - (r[2] or 0) / 25) for i, r in own.items()}
    best = {i: (r[4], 0.0, -i, 0.0) for i, r in own.items() if r[4] > 0}
    for _ in range(len(down)):
        for a, b in pairs:
            if b in best:
                w, near, low, lost = best[b]
                o = (w * decay[a], near - own[a][1], low, lost - (own[a][2] or 0))
                best[a] = max(best.get(a, o), o)
    out = network.decay_influence(reaches, edges.unionByName(edges), 1500.0, 25.0, 0.5).collect()
    assert len(out) == 300
    for r in out:
        if r.stream_id not in best:
            assert (r.weight, r.seed, r.dist, r.gain) == (0.0, -1, None, None)
        else:
            w, near, low, lost = best[r.stream_id]
            assert r.weight == pytest.approx(w, rel=1e-9) and (r.seed, r.dist, r.gain) == (-low, -near, -lost)


def test_braided_networks_and_circles(spark):
    braided = spark.createDataFrame([(1, 2, 1.0), (1, 3, 5.0), (2, 4, 1.0), (3, 4, 1.0)], "src long, dst long, w double")
    start = spark.createDataFrame([(1,)], "node long")
    assert {r.node: r.dist for r in network.network_distance(braided, start).collect()} == {1: 0.0, 2: 1.0, 4: 2.0, 3: 3.0}
    assert {r.node: r.hops for r in network.hops(braided, start).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    circle = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (3, 4, 1.0), (4, 1, 1.0), (9, 2, 7.0)], "src long, dst long, w double")
    assert {r.node: r.hops for r in network.hops(circle, start).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    assert {r.node: r.dist for r in network.network_distance(circle, start).collect()} == {1: 0.0, 2: 1.0, 3: 2.0, 4: 1.0, 9: 8.0}
    rows = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1), (5, 6), (6, 0), (7, 6)], "stream_id long, down_id long")
    assert {r.stream_id: r.strahler for r in network.stream_order(rows).collect()} == {1: 0, 2: 0, 3: 0, 4: 0, 5: 0, 6: 1, 7: 0}


def test_empty_networks(spark):
    assert network.stream_order(spark.createDataFrame([], "stream_id long, down_id long")).count() == 0
    none = spark.createDataFrame([], "src long, dst long, w double")
    assert network.hops(none, spark.createDataFrame([(3,)], "node long")).collect() == [(3, 0)]
    assert network.network_distance(none, spark.createDataFrame([(3,)], "node long")).collect() == [(3, 0.0)]


def test_a_river_of_a_hundred_thousand_reaches_takes_few_rounds(spark, monkeypatch):
    n, written = 100_000, []
    monkeypatch.setattr(network, "cut", lambda df, replaces=None, keep=network.cut: written.append(1) or keep(df, replaces))
    chain = spark.range(1, n + 1).select(F.col("id").alias("stream_id"), (F.col("id") - 1).alias("down_id"))
    assert network.stream_order(chain).where("strahler <> 0").count() == 0
    assert len(written) <= 40
    written.clear()
    start = spark.createDataFrame([(n,)], "node long")
    edges = chain.where("down_id > 0").select(F.col("stream_id").alias("src"), F.col("down_id").alias("dst"), F.lit(1.0).alias("w"))
    assert network.network_distance(edges, start).where(F.col("dist") == n - F.col("node")).count() == n
    assert len(written) <= 40
