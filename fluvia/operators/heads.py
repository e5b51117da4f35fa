"""Channel heads: how far the water table sags below each reach, relaxed along the network.

The unknown is the residual r >= 0 below a local ceiling, not the head itself, so that smoothing along the network does not
drag steep headwaters down to the valley. In each Spark round every block of the network is solved against what its
neighbours held before; blocks exchange their borders through a join, and rounds go on until nothing moves.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from fluvia.lineage import cut, drop
from fluvia.operators.solvers import MOST_ROUNDS, network_blocks


# Defaults that results depend on.
class HeadRules(NamedTuple):
    d_min_off_support_m: float = 0.5
    support_fraction_threshold: float = 0.25
    strahler_pin_min: int | None = None
    area_pin_km2: float | None = None
    below_bed_offset_m: float = 0.0
    target_weight_base: float = 2.0
    zero_weight_base: float = 2.0
    smoothness_weight: float = 1.0
    neighbor_length_floor_m: float = 200.0
    max_hydraulic_slope: float = 0.05
    tolerance: float = 0.01


def prepared(reaches: DataFrame, rules: HeadRules = HeadRules()) -> DataFrame:
    """Adds bed, ceiling, pins and weights. reaches: stream_id, down_id, up_elev_m, down_elev_m, length_m, wetness (0 to 1),
    and where known support_fraction, strahler, drainage_km2, r_target_m and r_max_m; absent columns pin nothing and give
    the targets of dry reaches. Where any of the two elevations is missing there is no bed, and no head."""
    c, has = F.col, set(reaches.columns)
    bed = (c("up_elev_m") + c("down_elev_m")) / 2
    bed = F.when(~F.isnan(bed) & (F.abs(bed) < float("inf")), bed)
    no, d_min = F.lit(False), rules.d_min_off_support_m
    support = F.coalesce(c("support_fraction") >= rules.support_fraction_threshold, no) if "support_fraction" in has else no
    order = no
    if rules.strahler_pin_min is not None and "strahler" in has:
        order = F.coalesce(c("strahler") >= rules.strahler_pin_min, no)
        if rules.area_pin_km2 is not None and "drainage_km2" in has:
            order = order & F.coalesce(c("drainage_km2") >= rules.area_pin_km2, no)
    below = max(rules.below_bed_offset_m, 0.0)
    offset = F.when(support, 0.0).when(order, below).otherwise(d_min)
    wet = F.coalesce(c("wetness").cast("double"), F.lit(0.0))
    target, most = (F.coalesce(c(n).cast("double"), F.lit(v)) if n in has else F.lit(v) for n, v in (("r_target_m", d_min), ("r_max_m", 2 * d_min)))
    return reaches.select(
        "stream_id", "down_id", bed.alias("bed_elev_m"), (bed - offset).alias("h_upper_m"), target.alias("r_target_m"), most.alias("r_max_m"), c("length_m").cast("double").alias("length_m"), wet.alias("wetness"),
        (rules.target_weight_base * (1 - wet)).alias("target_weight"), (rules.zero_weight_base * wet).alias("zero_weight"), (support | order).alias("hard_pin"),
    )


def relaxed(rows: pd.DataFrame, rules: HeadRules, tolerance: float) -> np.ndarray:
    """Residuals of one block, all at once, until they rest. Rows that are not its own, and pins, keep what they hold."""
    place = pd.Series(np.arange(len(rows)), index=rows.stream_id.to_numpy())
    at = place.reindex(rows.down_id).to_numpy(float)
    up = np.flatnonzero(~np.isnan(at))
    down = at[up].astype(np.int64)
    length, ceiling = rows.length_m.to_numpy(float), rows.h_upper_m.to_numpy(float)
    between = (length[up] + length[down]) / 2
    tie = rules.smoothness_weight / np.maximum(between, rules.neighbor_length_floor_m)
    target, zero, most = (rows[c].to_numpy(float) for c in ("target_weight", "zero_weight", "r_max_m"))
    n = len(rows)
    base = target * rows.r_target_m.to_numpy(float)
    weight = target + zero + np.bincount(up, tie, n) + np.bincount(down, tie, n)
    allowed = rules.max_hydraulic_slope * between / np.maximum(1 - rows.wetness.to_numpy(float)[up], 1e-6)
    drop_ = ceiling[up] - ceiling[down] - allowed
    free = rows.own.to_numpy(bool) & ~rows.hard_pin.to_numpy(bool)
    r = rows.r.to_numpy(float).copy()
    for _ in range(100 * n + 1000):
        new = np.where(weight > 1e-12, (base + np.bincount(up, tie * r[down], n) + np.bincount(down, tie * r[up], n)) / np.where(weight > 1e-12, weight, 1.0), r)
        np.maximum.at(new, up, r[down] + drop_)
        new = np.where(free, np.maximum(0.0, np.minimum(new, most)), r)
        moved = np.abs(new - r).max(initial=0.0)
        r = new
        if moved <= tolerance / 100:
            break
    return r


def solve_channel_heads(reaches: DataFrame, rules: HeadRules = HeadRules()) -> DataFrame:
    """(stream_id, bed_elev_m, h_upper_m, r_target_m, r_max_m, channel_head_m, head_depth_m, target_weight, zero_weight,
    hard_pin, n_rounds) of every reach; see `prepared` for what goes in.

    r = (w_target r_target + sum of w_ij r_j) / (w_target + w_zero + sum of w_ij) over the reaches above and below, with
    w_ij falling with the length between; never less than what the greatest slope to the reach below asks for (wet reaches
    may be steeper), never below 0 or above r_max. Pinned reaches have r = 0. Ends when no residual moves by more than the
    tolerance in a round; not to have ended after MOST_ROUNDS is an error. stream_id must be unique.
    """
    every = cut(prepared(reaches, rules))
    known = every.where("bed_elev_m is not null")
    blocks = network_blocks(known)
    own = cut(known.join(blocks, "stream_id"))
    facts = [x for x in own.columns if x != "block"]
    ends = own.select(F.col("stream_id").alias("a"), F.col("down_id").alias("b"), F.col("block").alias("ba")).join(own.select(F.col("stream_id").alias("b"), F.col("block").alias("bb")), "b").where("ba <> bb")
    # a block sees both ends of every edge that leaves it; what it sees has no say about what lies behind
    seen = ends.select(F.col("ba").alias("block"), F.col("b").alias("stream_id")).unionByName(ends.select(F.col("bb").alias("block"), F.col("a").alias("stream_id"))).distinct()
    members = cut(own.select(*facts, "block", F.lit(True).alias("own")).unionByName(seen.join(own.select(*facts), "stream_id").select(*facts, "block", F.lit(False).alias("own"))))
    start = F.when(F.col("hard_pin"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least("r_target_m", "r_max_m")))
    state = cut(own.select("stream_id", start.alias("r"), F.lit(0.0).alias("moved")))
    alone = members.where("not own").isEmpty()

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.own.to_numpy(bool)
        r = relaxed(rows, rules, rules.tolerance)
        return pd.DataFrame({"stream_id": rows.stream_id[own], "r": r[own], "moved": np.abs(r - rows.r.to_numpy(float))[own]})

    used = 0
    for used in range(1, MOST_ROUNDS + 1):
        solved = members.join(state.select("stream_id", "r"), "stream_id").groupBy("block").applyInPandas(solve, "stream_id long, r double, moved double")
        state = cut(solved, replaces=state)
        moved = state.agg(F.max("moved")).first()[0]
        if alone or moved is None or moved <= rules.tolerance / 10:
            break
    else:
        raise RuntimeError(f"heads not settled after {MOST_ROUNDS} rounds")
    head = F.col("h_upper_m") - F.col("r")
    out = every.join(state.select("stream_id", "r"), "stream_id", "left").select("stream_id", "bed_elev_m", "h_upper_m", "r_target_m", "r_max_m", head.alias("channel_head_m"), (F.col("bed_elev_m") - head).alias("head_depth_m"), "target_weight", "zero_weight", "hard_pin", F.lit(used).cast("long").alias("n_rounds"))
    out = cut(out)
    drop(every, own, members, state, blocks)
    return out
