"""Reach networks: hops, stream order, decaying influence, shortest paths, pruning, head targets and the head solve.

Graph rounds are joins on edge tables. Each round cuts its lineage, so plans stay short. Where reaches drain to one other
at most, rounds follow the logarithm of the network's depth; braided networks are relaxed until nothing changes.
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvia.lineage import cut, drop


def _single(edges: DataFrame, end: str) -> bool:
    """Whether no value stands twice at this end of the edges."""
    return edges.groupBy(end).count().where("count > 1").isEmpty()


def _doubled(state: DataFrame, carried: Callable[[Column, Column], Column], joined: Callable[[Column, Column], Column], pull: bool, max_rounds: int) -> DataFrame:
    """(node, best) of a table (node, to, step, best) in which every node points at one other, or none: the greatest label
    among a node's own and those that come along pointers, from the nodes that lead to it (or, with `pull`, from those
    that it leads to).

    Labels and steps are structs; a greater label is a better one, null is none. `carried` takes a label over a step,
    `joined` makes one step of two. Each round a pointer skips as far again as it did, so rounds follow the logarithm of
    the longest way, with one row for each node. On a circle they end once every way without a repeat is done; to go
    round must not better a label.
    """
    state = cut(state)
    best, step = F.col("best"), F.col("step")
    for done in range(state.count().bit_length()):
        going = state.where("to is not null")
        if going.isEmpty():
            break
        if done == max_rounds:
            raise RuntimeError(f"pointers not followed to their ends after {max_rounds} rounds")
        if pull:
            beyond = state.select(F.col("node").alias("to"), F.col("to").alias("__next"), F.col("step").alias("__more"), F.col("best").alias("__theirs"))
            moved = state.join(beyond, "to", "left").withColumn("__got", F.when(F.col("__theirs").isNotNull(), carried(F.col("__theirs"), step)))
        else:
            sent = going.where("best is not null").groupBy(F.col("to").alias("node")).agg(F.max(carried(best, step)).alias("__got"))
            beyond = going.select(F.col("node").alias("to"), F.col("to").alias("__next"), F.col("step").alias("__more"))
            moved = state.join(sent, "node", "left").join(beyond, "to", "left")
        further = F.when(F.col("__next").isNotNull(), joined(step, F.col("__more")))
        state = cut(moved.select("node", F.col("__next").alias("to"), further.alias("step"), F.greatest(best, "__got").alias("best")), replaces=state)
    return state.select("node", "best")


def _pointing(edges: DataFrame, at: str, to: str, starts: DataFrame, label: Column, length: Column) -> DataFrame:
    """Nodes of edges with one edge at each `at`, and the starts (node), as `_doubled` wants them."""
    nodes = edges.select(F.col(at).alias("node")).unionByName(edges.select(F.col(to).alias("node"))).unionByName(starts.select("node")).distinct()
    ahead = edges.select(F.col(at).alias("node"), F.col(to).alias("to"), F.struct(length.alias("w")).alias("step"))
    return nodes.join(ahead, "node", "left").join(starts.select("node").distinct().withColumn("best", F.struct(label.alias("near"))), "node", "left")


def _farther(label: Column, step: Column) -> Column:
    return F.struct((label["near"] - step["w"]).alias("near"))


def _longer(a: Column, b: Column) -> Column:
    return F.struct((a["w"] + b["w"]).alias("w"))


def hops(edges: DataFrame, seeds: DataFrame, most: int | None = None) -> DataFrame:
    """(node, hops): fewest directed steps (src to dst) from any seed; nodes out of reach have no row.

    Where every node has one edge out, as reaches have that drain to one other, or one edge in, pointers are doubled.
    Other networks, and bounded searches, go level by level.
    """
    if most is None:
        edges = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
        for at, to, pull in (("src", "dst", False), ("dst", "src", True)):
            if _single(edges, at):
                found = _doubled(_pointing(edges, at, to, seeds, F.lit(0), F.lit(1)), _farther, _longer, pull, 64)
                return found.where("best is not null").select("node", (-F.col("best.near")).alias("hops"))
    reached = cut(seeds.select("node").distinct().withColumn("hops", F.lit(0)))
    frontier, step = reached, 0
    while most is None or step < most:
        step += 1
        new = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).distinct().join(reached, "node", "left_anti").withColumn("hops", F.lit(step))
        frontier = cut(new)
        if frontier.isEmpty():
            break
        reached = reached.unionByName(frontier)
        if step % 8 == 0:
            reached = cut(reached)
    return reached


def stream_order(reaches: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(stream_id, strahler) of reaches with a down_id: 0 without upstream reaches; one more than the largest order above
    only where at least two reaches share it. Reaches on a cycle, and below one, stay 0.

    The network is contracted, and the order of a reach is the step that removes it: each step takes all reaches that
    nothing is left above, and all below them that only a single line of reaches is left above. At most half as many
    branches are left after a step, so steps are as many as orders. The lines are found by doubled pointers, so the
    rounds of a step follow the logarithm of its longest line.
    """
    left = reaches.select("stream_id", "down_id")
    orders, kept, rounds, order = [], [], 0, 0
    while True:
        above = left.groupBy(F.col("down_id").alias("stream_id")).agg(F.count("*").alias("n"), F.min("stream_id").alias("only"))
        counted = cut(left.join(above, "stream_id", "left").select("stream_id", "down_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("only")).alias("up")))
        kept.append(counted)
        seen = counted.agg(F.count_if(F.col("n") == 0).alias("tops"), F.count_if(F.col("n") == 1).alias("lined")).first()
        rounds += 1
        if not seen["tops"]:
            break  # nothing is left, or only what lies on and below circles
        if rounds > max_rounds:
            raise RuntimeError(f"stream order not settled after {max_rounds} rounds")
        gone, stay = counted.where("n = 0").select("stream_id"), counted.where("n > 1").select("stream_id", "down_id")
        if seen["lined"]:
            # ends: true under a top, false under a branching, null where the line has not been followed to its end
            beyond = counted.select(F.col("stream_id").alias("up"), F.when(F.col("n") != 1, F.col("n") == 0).alias("ends"))
            lines = cut(counted.where("n = 1").select("stream_id", "down_id", "up").join(beyond, "up"))
            for _ in range((seen["lined"] - 1).bit_length()):
                if lines.where("ends is null").isEmpty():
                    break
                rounds += 1
                if rounds > max_rounds:
                    raise RuntimeError(f"stream order not settled after {max_rounds} rounds")
                beyond = lines.select(F.col("stream_id").alias("up"), F.col("up").alias("__next"), "ends")
                further = lines.where("ends is null").drop("ends").join(beyond, "up").select("stream_id", "down_id", F.col("__next").alias("up"), "ends")
                lines = cut(lines.where("ends is not null").unionByName(further), replaces=lines)
            kept.append(lines)
            gone = gone.unionByName(lines.where("ends").select("stream_id"))
            stay = stay.unionByName(lines.where("not coalesce(ends, false)").select("stream_id", "down_id"))
        orders.append(gone.withColumn("strahler", F.lit(order)))
        left = stay
        order += 1
    solved = reaches.select("stream_id")
    if orders:
        solved = solved.join(reduce(DataFrame.unionByName, orders), "stream_id", "left")
    else:
        solved = solved.withColumn("strahler", F.lit(0))
    out = cut(solved.select("stream_id", F.coalesce("strahler", F.lit(0)).alias("strahler")))
    drop(*kept)
    return out


def decay_influence(reaches: DataFrame, edges: DataFrame, distance_scale: float, elevation_scale: float | None, strahler_scale: float, max_rounds: int = 10_000) -> DataFrame:
    """Per reach the strongest decayed seed along edges (stream_id pulls from source_id): weight, seed, distance, gain.

    A pulled weight is multiplied by exp(-length / scale - relief / elevation_scale) of the pulling reach; the scale grows
    by strahler_scale for each order above 1. Reaches without any influence have weight 0, seed -1, and nulls. Equal
    weights keep the nearer seed, then the lower id. Where every reach pulls from one other, or is pulled from by one,
    pointers are doubled; in other networks rounds run until nothing improves.
    """
    scale = distance_scale * (1 + strahler_scale * F.greatest(F.coalesce("strahler", F.lit(0)) - 1, F.lit(0)))
    drop_ = -F.col("length_m") / scale
    if elevation_scale is not None:
        drop_ = drop_ - F.coalesce("relief_m", F.lit(0.0)) / elevation_scale
    own = cut(reaches.select("stream_id", "length_m", F.coalesce("relief_m", F.lit(0.0)).alias("relief_m"), F.exp(drop_).alias("decay"), "seed_strength"))
    pulls = cut(edges.select("stream_id", "source_id").distinct().join(own.select("stream_id", "length_m", "relief_m", "decay"), "stream_id"))
    zero = F.lit(0.0)
    for at, to, pull in (("stream_id", "source_id", True), ("source_id", "stream_id", False)):
        if _single(pulls, at):
            state = _strongest(own, pulls.select(F.col(at).alias("node"), F.col(to).alias("to"), F.struct("decay", "length_m", "relief_m").alias("step")), pull, max_rounds)
            break
    else:
        state = _strongest_by_rounds(own, pulls, max_rounds)
    return own.select("stream_id").join(state, "stream_id", "left").select("stream_id", F.coalesce("weight", zero).alias("weight"), F.coalesce("seed", F.lit(-1)).alias("seed"), "dist", "gain")


def _strongest(own: DataFrame, ahead: DataFrame, pull: bool, max_rounds: int) -> DataFrame:
    def label(weight: Column, near: Column, low: Column, lost: Column) -> Column:
        return F.when(weight > 0, F.struct(weight.alias("weight"), near.alias("near"), low.alias("low"), lost.alias("lost")))

    def carried(b: Column, s: Column) -> Column:
        return label(b["weight"] * s["decay"], b["near"] - s["length_m"], b["low"], b["lost"] - s["relief_m"])

    def joined(a: Column, b: Column) -> Column:
        return F.struct((a["decay"] * b["decay"]).alias("decay"), (a["length_m"] + b["length_m"]).alias("length_m"), (a["relief_m"] + b["relief_m"]).alias("relief_m"))

    zero = F.lit(0.0)
    seeded = own.select(F.col("stream_id").alias("node"), label(F.col("seed_strength"), zero, -F.col("stream_id"), zero).alias("best"))
    best = _doubled(seeded.join(ahead, "node", "left").select("node", "to", "step", "best"), carried, joined, pull, max_rounds)
    # 0.0 - x keeps a distance of nothing from becoming -0.0
    return best.where("best is not null").select(F.col("node").alias("stream_id"), F.col("best.weight").alias("weight"), (-F.col("best.low")).alias("seed"), (zero - F.col("best.near")).alias("dist"), (zero - F.col("best.lost")).alias("gain"))


def _strongest_by_rounds(own: DataFrame, pulls: DataFrame, max_rounds: int) -> DataFrame:
    zero = F.lit(0.0)
    state = own.where("seed_strength > 0").select("stream_id", F.col("seed_strength").alias("weight"), F.col("stream_id").alias("seed"), zero.alias("dist"), zero.alias("gain"))
    first = state = moved = cut(state)
    order = F.struct("weight", (-F.col("dist")).alias("near"), (-F.col("seed")).alias("low"))
    for _ in range(max_rounds):
        sent = moved.withColumnRenamed("stream_id", "source_id").join(pulls, "source_id").select("stream_id", (F.col("weight") * F.col("decay")).alias("weight"), "seed", (F.col("dist") + F.col("length_m")).alias("dist"), (F.col("gain") + F.col("relief_m")).alias("gain"))
        offered = sent.groupBy("stream_id").agg(F.max_by(F.struct("weight", "seed", "dist", "gain"), order).alias("o"))
        better = offered.join(state.select("stream_id", F.col("weight").alias("now")), "stream_id", "left").where("o.weight > coalesce(now, 0)").select("stream_id", "o.*")
        moved = cut(better)
        if moved.isEmpty():
            break
        state = cut(state.join(moved.select("stream_id"), "stream_id", "left_anti").unionByName(moved), replaces=state if state is not first else None)
    else:
        raise RuntimeError(f"influence not settled after {max_rounds} rounds")
    return state


def network_distance(edges: DataFrame, sources: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """(node, dist): the shortest undirected way over edges (src, dst, w >= 0) to any source.

    Where every node has one edge out (or one in), a shortest way first follows such edges and then goes against them, so
    distances are handed on along doubled pointers, then pulled back. Other networks are relaxed from frontiers.
    """
    once = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("w").alias("w"))
    for at, to in (("src", "dst"), ("dst", "src")):
        if _single(once, at):
            state = cut(_pointing(once, at, to, sources, F.lit(0.0), F.col("w").cast("double")))
            near = _doubled(state, _farther, _longer, False, max_rounds)
            found = _doubled(state.drop("best").join(near, "node"), _farther, _longer, True, max_rounds)
            return found.where("best is not null").select("node", (F.lit(0.0) - F.col("best.near")).alias("dist"))
    both = cut(once.unionByName(once.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))
    first = state = moved = cut(sources.select("node").distinct().withColumn("dist", F.lit(0.0)))
    for _ in range(max_rounds):
        offered = moved.withColumnRenamed("node", "src").join(both, "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
        moved = cut(offered.join(state.withColumnRenamed("dist", "now"), "node", "left").where("now is null or dist < now").select("node", "dist"))
        if moved.isEmpty():
            break
        state = cut(state.join(moved.select("node"), "node", "left_anti").unionByName(moved), replaces=state if state is not first else None)
    else:
        raise RuntimeError(f"distances not settled after {max_rounds} rounds")
    return state


def brought_down(reaches: DataFrame, inflows: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(stream_id, n_traces, added): how many inflows (stream_id, amount) pass each reach on their way down, and what they
    bring together; reaches that none passes have no row. An inflow passes its own reach too.

    Pointers to the reach below (down_id) are doubled each round, and what has been gathered is sent along: rounds follow
    the logarithm of the longest way, with one row for each reach. Reaches that flow in a circle are an error.
    """
    own = inflows.groupBy("stream_id").agg(F.count("*").alias("n_traces"), F.sum("amount").alias("added"))
    zero = {k: F.coalesce(k, F.lit(0)) for k in ("n_traces", "added")}
    known = reaches.select(F.col("stream_id").alias("down_id"))
    inside = reaches.select("stream_id", "down_id").join(known, "down_id", "left_semi")
    state = reaches.select("stream_id").join(inside, "stream_id", "left").join(own, "stream_id", "left").select("stream_id", F.col("down_id").alias("to"), *[v.alias(k) for k, v in zero.items()])
    state = cut(state)
    for _ in range(max_rounds):
        going = state.where("to is not null")
        if going.isEmpty():
            break
        sent = going.groupBy(F.col("to").alias("stream_id")).agg(F.sum("n_traces").alias("__n"), F.sum("added").alias("__a"))
        beyond = state.select(F.col("stream_id").alias("to"), F.col("to").alias("__next"))
        joined = state.join(sent, "stream_id", "left").join(beyond, "to", "left")
        state = cut(joined.select("stream_id", F.col("__next").alias("to"), (F.col("n_traces") + F.coalesce("__n", F.lit(0))).alias("n_traces"), (F.col("added") + F.coalesce("__a", F.lit(0))).alias("added")), replaces=state)
    else:
        raise RuntimeError("reaches flow in a circle")
    return state.where("n_traces > 0").select("stream_id", "n_traces", "added")


def numbered(df: DataFrame, column: str, name: str = "idx") -> DataFrame:
    """Adds gapless numbers from 0 in the order of a column of different values: rows are dealt out by ranges, counted by
    range, and numbered within each; only the counts are brought together."""
    ranged = cut(df.repartitionByRange(column).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["count"]) for r in ranged.groupBy("__part").count().collect())
    before, rows = 0, []
    for part, count in counts:
        rows.append((part, before))
        before += count
    if not rows:
        return df.withColumn(name, F.lit(0).cast("int"))
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __before long")
    place = F.row_number().over(Window.partitionBy("__part").orderBy(column)) - 1 + F.col("__before")
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, place.cast("int" if before < 1 << 31 else "long")).drop("__part", "__before")


def sag_targets(down: bool = True, area: bool = True, distance_scale: float = 4000.0, elevation_scale: float = 25.0, down_scale: float = 20_000.0, area_low: float = 50.0, area_high: float = 500.0, alpha_d: float = 0.75, alpha_z: float = 1.0, gamma: float = 2.0, least: float = 2.0, most: float = 60.0) -> dict[str, Column]:
    """Sag driver (0 to 1) and the target and largest depth of a reach, from its wetness, distance, gain and area.
    A missing distance, gain or area says nothing, because greatest and least skip nulls."""
    c = F.col

    def unit(x: Column) -> Column:
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))

    dry = 1 - c("weight")
    g = unit(F.greatest(dry, alpha_d * (1 - F.exp(-c("dist") / max(distance_scale, 1.0))), alpha_z * (1 - F.exp(-c("gain") / max(elevation_scale, 1.0)))))
    if down:
        g = F.least(g, unit(F.greatest(1 - c("down_weight"), alpha_d * (1 - F.exp(-c("down_dist") / max(down_scale, 1.0))))))
    if area:
        span = float(np.log(area_high) - np.log(area_low))
        g = F.least(g, unit((float(np.log(area_high)) - F.when(c("area_km2") > 0, F.log("area_km2"))) / span))
    largest = least + (most - least) * g
    return {"sag_driver": g, "r_max_m": largest, "r_target_m": largest * F.pow(g, F.lit(gamma))}


def keep_within(edges: DataFrame, kept: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Nodes at most k undirected steps from the kept ones, numbered from 0 in order, and the edges inside, renumbered."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    nodes = hops(both, kept, k).select("node")
    nodes = numbered(nodes, "node")
    inside = edges.join(nodes.select(F.col("node").alias("src"), F.col("idx").alias("src_idx")), "src").join(nodes.select(F.col("node").alias("dst"), F.col("idx").alias("dst_idx")), "dst")
    return nodes, inside
