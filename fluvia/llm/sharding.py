"""Uniform shuffling into shards of exact size, by a hypergeometric communication matrix.

Rows fall into source blocks by a hash of the whole row, so a task that is run again deals them alike. The driver draws
how many rows each block sends to each shard (a matrix of block and shard counts, never rows), such that every
assignment of rows to shards of the required sizes is equally likely. Each block then permutes its rows, cuts the
permutation at the drawn counts, and each shard permutes what it received.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from fluvia.lineage import cut
from fluvia.llm._frames import local_table

#: Most rows that one block, or one part of a shard, is meant to hold.
BLOCK_ROWS = 500_000
MAX_BLOCKS = 65_536


def communication_matrix(block_counts: list[int], shards: int, seed: int) -> np.ndarray:
    """counts[i, j]: rows of block i for shard j. Row sums are the block counts, column sums differ by one at most."""
    rng = np.random.default_rng(seed)
    total = sum(block_counts)
    room = np.full(shards, total // shards, np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    out = np.zeros((len(block_counts), shards), np.int64)
    for i, rows in enumerate(block_counts):
        left, beyond = int(rows), int(room.sum())
        for j in range(shards):
            beyond -= int(room[j])
            out[i, j] = drawn = _hypergeometric(rng, int(room[j]), beyond, left)
            left -= drawn
        room -= out[i]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, sample: int) -> int:
    """Successes in `sample` draws without replacement. Beyond the generator's range, the ratio-of-uniforms rejection."""
    if good == 0 or sample == 0:
        return 0
    if bad == 0:
        return sample
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, sample))
    low, high = max(0, sample - bad), min(good, sample)
    total = good + bad
    mean = sample * good / total
    spread = math.sqrt(mean * (bad / total) * (total - sample) / (total - 1)) + 0.5
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    weight = lambda k: choose(good, k) + choose(bad, sample - k)
    mode = min(high, max(low, int((sample + 1) * (good + 1) / (total + 2))))
    top = weight(mode)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + (2 * spread + 1) * (v - 0.5) * 1.75 / max(u, 1e-12)) if u else low - 1
        if low <= k <= high and 2 * math.log(max(u, 1e-300)) <= weight(k) - top:
            return k


def shuffle_to_shards(df: DataFrame, shards: int, key: list[str], seed: int = 1) -> DataFrame:
    """Adds `shard` (int, 0 to shards - 1) and `slot` (long, gapless from 0 within its shard) to every row.

    Law `rows`: shard sizes differ by one at most. `key` names the columns that tell rows apart; their hashes order the
    permutations. Nulls hash like any value. Rows equal in all key columns are interchangeable: they get different
    slots, which of them gets which is undefined. Columns already named `shard` or `slot` are replaced. An empty table
    gives an empty table.
    """
    assert shards >= 1
    df = df.drop("shard", "slot")
    total = df.count()
    blocks = min(MAX_BLOCKS, max(64, -(-total // BLOCK_ROWS)))
    parts = max(4, -(-total // (shards * BLOCK_ROWS)))
    columns = [F.col(f"`{c}`") for c in key]

    def rolled(step: int) -> Column:
        return F.xxhash64(F.lit(seed * 8 + step), *columns)

    rows = df.withColumn("__block", F.pmod(rolled(0), F.lit(blocks)).cast("int"))
    counts = {r["__block"]: r["count"] for r in rows.groupBy("__block").count().collect()}
    matrix = communication_matrix([counts.get(b, 0) for b in range(blocks)], shards, seed)
    spark = df.sparkSession
    ends = local_table(spark, __block=pa.array(range(blocks), pa.int32()), __ends=pa.array(np.cumsum(matrix, axis=1).tolist(), pa.list_(pa.int64())))
    local = Window.partitionBy("__block").orderBy(rolled(1), *columns)
    dealt = (
        rows.withColumn("__at", F.row_number().over(local))
        .join(F.broadcast(ends), "__block")
        .withColumn("shard", F.size(F.filter("__ends", lambda end: end < F.col("__at"))).cast("int"))
        .withColumn("__part", F.pmod(rolled(2), F.lit(parts)).cast("int"))
        .drop("__block", "__ends", "__at")
    )
    dealt = cut(dealt)
    sizes = {(r["shard"], r["__part"]): r["count"] for r in dealt.groupBy("shard", "__part").count().collect()}
    before = []
    for s in range(shards):
        at = 0
        for p in range(parts):
            before.append((s, p, at))
            at += sizes.get((s, p), 0)
    shard, part, at_ = zip(*before)
    offsets = local_table(spark, shard=pa.array(shard, pa.int32()), __part=pa.array(part, pa.int32()), __before=pa.array(at_, pa.int64()))
    within = Window.partitionBy("shard", "__part").orderBy(rolled(3), *columns)
    return (
        dealt.withColumn("slot", F.row_number().over(within).cast("long"))
        .join(F.broadcast(offsets), ["shard", "__part"])
        .withColumn("slot", F.col("slot") - 1 + F.col("__before"))
        .select(*[F.col(f"`{c}`") for c in df.columns], "shard", "slot")
    )
