"""Relaxation on rasters in blocks, smooth and robust surfaces; blocks of networks.

A domain is cut into blocks of bounded size. In each Spark round every block is solved by itself against what its
neighbours held before, in one pandas group; blocks exchange their borders through a join, and rounds go on until nothing
moves by more than the tolerance. So a group's size follows the block and never the domain, whatever its shape.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from fluvia.lineage import cut, drop

#: Levels of a network, from a reach upwards, that one block holds.
BLOCK_LEVELS = 8
#: Cells along the side of a raster block, and by how many cells it is solved beyond its own.
BLOCK_CELLS = 128
OVERLAP = 32
#: Coarse cells whose corrections are solved together.
COARSE_MOST = 50_000
MOST_ROUNDS = 10_000


def network_blocks(reaches: DataFrame) -> DataFrame:
    """(stream_id, block): reaches that share the same reach below them on the next level that BLOCK_LEVELS divides. Levels
    are counted from the outlets by doubling pointers; a circle of reaches is an error."""
    known = reaches.select(F.col("stream_id").alias("down_id"))
    inside = reaches.select("stream_id", "down_id").join(known, "down_id", "left_semi")
    state = cut(reaches.select("stream_id").join(inside, "stream_id", "left").select("stream_id", F.col("down_id").alias("to"), F.col("down_id").isNotNull().cast("long").alias("level")))
    for _ in range(64):
        if state.where("to is not null").isEmpty():
            break
        beyond = state.select(F.col("stream_id").alias("to"), F.col("to").alias("__next"), F.col("level").alias("__more"))
        state = cut(state.join(beyond, "to", "left").select("stream_id", F.col("__next").alias("to"), (F.col("level") + F.coalesce("__more", F.lit(0))).alias("level")), replaces=state)
    else:
        raise RuntimeError("reaches flow in a circle")
    levels = state.select("stream_id", "level")
    # each reach walks down to the next level that BLOCK_LEVELS divides, all of them in step
    at = levels.join(inside, "stream_id", "left").select("stream_id", F.col("stream_id").alias("block"), F.col("down_id").alias("__down"), (F.col("level") % BLOCK_LEVELS).alias("__left"))
    down = cut(inside.select(F.col("stream_id").alias("__down"), F.col("down_id").alias("__next")))
    for _ in range(BLOCK_LEVELS - 1):
        going = F.col("__left") > 0
        at = at.join(down, "__down", "left").select("stream_id", F.when(going, F.col("__down")).otherwise(F.col("block")).alias("block"), F.when(going, F.col("__next")).otherwise(F.col("__down")).alias("__down"), F.when(going, F.col("__left") - 1).otherwise(0).alias("__left"))
    return cut(at.select("stream_id", "block"))


def _grid(cells: DataFrame) -> DataFrame:
    """Cells with how many neighbours they have in their component, and the blocks in whose reach they lie: their own, and
    those that they lie no more than OVERLAP cells away from."""
    near = cells.select("component", "r", "c").withColumn("__s", F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 1), (0, -1), (1, 0), (-1, 0))])))
    known = near.select("component", (F.col("r") + F.col("__s.a")).alias("r"), (F.col("c") + F.col("__s.b")).alias("c")).groupBy("component", "r", "c").agg(F.count("*").alias("degree"))

    def reach(column: str) -> Column:
        return F.sequence(F.floor((F.col(column) - OVERLAP) / BLOCK_CELLS), F.floor((F.col(column) + OVERLAP) / BLOCK_CELLS))

    out = cells.join(known, ["component", "r", "c"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return cut(out.withColumn("br", F.explode(reach("r"))).withColumn("bc", F.explode(reach("c"))).withColumn("own", (F.floor(F.col("r") / BLOCK_CELLS) == F.col("br")) & (F.floor(F.col("c") / BLOCK_CELLS) == F.col("bc"))))


def _neighbours(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of neighbouring cells of one block."""
    r, c = rows.r.to_numpy(np.int64), rows.c.to_numpy(np.int64)
    r, c = r - r.min(initial=0), c - c.min(initial=0)
    place = np.full((r.max(initial=0) + 2, c.max(initial=0) + 2), -1, np.int64)
    place[r, c] = np.arange(len(r))
    pairs = [(np.flatnonzero(other >= 0), other[other >= 0]) for other in (place[r + 1, c], place[r, c + 1])]
    return tuple(np.concatenate(x) for x in zip(*pairs))


def _solved(rows: pd.DataFrame, tolerance: float) -> pd.DataFrame:
    """One block by conjugate gradients: (degree + w) x - sum of neighbours = load for every free cell. Fixed cells, and cells
    on the block's rim, keep their values. `off` is the largest residual that the block's own cells came with."""
    rows = rows.reset_index(drop=True)
    a, b = _neighbours(rows)
    x = rows["value"].to_numpy(float).copy()
    n = len(x)
    degree, w, load = (rows[c].to_numpy(float) for c in ("degree", "w", "load"))
    free = ~rows["fixed"].to_numpy(bool) & (np.bincount(np.r_[a, b], minlength=n) == degree)
    diagonal = degree + w

    def apply(v: np.ndarray) -> np.ndarray:
        return np.where(free, diagonal * v - np.bincount(a, v[b], n) - np.bincount(b, v[a], n), 0.0)

    residual = np.where(free, load, 0.0) - apply(x)
    own = rows.own.to_numpy(bool)
    off = float(np.abs(residual[own]).max(initial=0.0))
    scaled = residual / np.maximum(diagonal, 1e-30)
    direction, norm = scaled, float(residual @ scaled)
    for _ in range(20 * n):
        if np.abs(residual).max(initial=0.0) <= tolerance or norm == 0:
            break
        along = apply(direction)
        step = norm / float(direction @ along)
        x, residual = x + step * direction, residual - step * along
        scaled = residual / np.maximum(diagonal, 1e-30)
        norm, before = float(residual @ scaled), norm
        direction = scaled + norm / before * direction
    return rows[["component", "r", "c"]].assign(value=x, off=off)[own]


def _coarse(facts: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """(cells with their coarse cell, pairs of free neighbours in different coarse cells) of components that several blocks
    share. Coarse cells are blocks, or squares of blocks where there would be more than COARSE_MOST of them."""
    block = [F.floor(F.col(c) / BLOCK_CELLS) for c in ("r", "c")]
    free = facts.where("not fixed").withColumns({"p": block[0], "q": block[1]})
    held = cut(free.groupBy("component", "p", "q").agg(F.count("*").alias("n")))
    shared = held.groupBy("component").agg(F.count("*").alias("k")).where("k > 1").select("component")
    held = held.join(shared, "component")
    side = 1
    while held.select("component", F.floor(F.col("p") / side), F.floor(F.col("q") / side)).distinct().count() > COARSE_MOST:
        side *= 2
    if held.isEmpty():
        return None
    at = free.join(shared, "component", "left_semi").withColumns({"p": F.floor(F.col("p") / side), "q": F.floor(F.col("q") / side)}).select("component", "r", "c", "p", "q")
    at = cut(at)
    size = BLOCK_CELLS * side
    rim = lambda c: (F.col(c) % size == 0) | (F.col(c) % size == size - 1)
    edge = at.where(rim("r") | rim("c"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i, j in ((0, 1), (1, 0))]))
    near = edge.withColumn("s", steps).select("component", "r", "c", "p", "q", (F.col("r") + F.col("s.a")).alias("r2"), (F.col("c") + F.col("s.b")).alias("c2"))
    other = edge.select("component", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("p").alias("p2"), F.col("q").alias("q2"))
    pairs = near.join(other, ["component", "r2", "c2"]).where("p <> p2 or q <> q2")
    return at, cut(pairs)


def _corrected(state: DataFrame, facts: DataFrame, coarse: tuple[DataFrame, DataFrame], to_fixed: DataFrame) -> DataFrame:
    """The state after one number per coarse cell has been added to its free cells, so that what is missing from each adds
    up to nothing. As many numbers as there are coarse cells reach the driver."""
    at, pairs = coarse
    key = ["component", "r", "c"]
    x = state.select(*key, "value")
    mine = at.join(facts.select(*key, "w", "load"), key).join(x, key)
    inner = mine.groupBy("component", "p", "q").agg(F.sum(F.col("load") - F.col("w") * F.col("value")).alias("miss"), F.sum("w").alias("weight"))
    y = x.select("component", F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("value").alias("value2"))
    flux = pairs.join(x, key).join(y, ["component", "r2", "c2"])
    across = flux.groupBy("component", "p", "q", "p2", "q2").agg(F.sum(F.col("value2") - F.col("value")).alias("flow"), F.count("*").alias("ties")).collect()
    walls = {tuple(r[:3]): r for r in to_fixed.join(at, key).join(x, key).join(y, ["component", "r2", "c2"]).groupBy("component", "p", "q").agg(F.sum(F.col("value2") - F.col("value")).alias("flow"), F.count("*").alias("ties")).collect()}
    rows = inner.collect()
    place = {tuple(r[:3]): i for i, r in enumerate(rows)}
    miss, diagonal = np.array([r.miss for r in rows]), np.array([r.weight for r in rows])
    for k, i in place.items():
        if k in walls:
            miss[i] += walls[k].flow
            diagonal[i] += walls[k].ties
    a = np.array([place[r.component, r.p, r.q] for r in across], np.int64)
    b = np.array([place[r.component, r.p2, r.q2] for r in across], np.int64)
    ties, flow = np.array([float(r.ties) for r in across]), np.array([r.flow for r in across])
    n = len(rows)
    miss = miss + np.bincount(a, flow, n) - np.bincount(b, flow, n)
    diagonal = diagonal + np.bincount(a, ties, n) + np.bincount(b, ties, n)
    add, residual = np.zeros(n), miss.copy()
    scaled = residual / np.maximum(diagonal, 1e-30)
    direction, norm = scaled, float(residual @ scaled)
    for _ in range(4 * n + 100):
        if norm <= 1e-30 or np.abs(residual).max() <= 1e-12 * max(1.0, np.abs(miss).max()):
            break
        along = diagonal * direction - np.bincount(a, ties * direction[b], n) - np.bincount(b, ties * direction[a], n)
        bent = float(direction @ along)
        if bent <= 0:
            break
        add, residual = add + norm / bent * direction, residual - norm / bent * along
        scaled = residual / np.maximum(diagonal, 1e-30)
        norm, before = float(residual @ scaled), norm
        direction = scaled + norm / before * direction
    table = state.sparkSession.createDataFrame([(*k, float(add[i])) for k, i in place.items()], "component long, p long, q long, add double")
    moved = at.join(table, ["component", "p", "q"]).select(*key, "add")
    return state.join(moved, key, "left").select(*key, (F.col("value") + F.coalesce("add", F.lit(0.0))).alias("value"))


def _settled(facts: DataFrame, state: DataFrame, tolerance: float) -> tuple[DataFrame, int]:
    """The state once no residual of the system exceeds the tolerance, and the rounds that took. facts: component, r, c, w,
    load, fixed. A round corrects coarse cells, then solves every block against what its neighbours hold."""
    key = ["component", "r", "c"]
    members = _grid(facts)
    coarse = _coarse(facts)
    to_fixed = None
    if coarse:
        near = coarse[0].withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b")) for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0))])))
        near = near.select(*key, (F.col("r") + F.col("s.a")).alias("r2"), (F.col("c") + F.col("s.b")).alias("c2"))
        walls = facts.where("fixed").select("component", F.col("r").alias("r2"), F.col("c").alias("c2"))
        to_fixed = cut(near.join(walls, ["component", "r2", "c2"]))
    state = cut(state)
    for used in range(1, MOST_ROUNDS + 1):
        now = _corrected(state, facts, coarse, to_fixed) if coarse else state
        solved = members.join(now, key).groupBy("component", "br", "bc").applyInPandas(lambda rows: _solved(rows, tolerance / 10), "component long, r long, c long, value double, off double")
        state = cut(solved, replaces=state)
        off = state.agg(F.max("off")).first()[0]
        if coarse is None or off is None or off <= tolerance:
            drop(members, *(coarse or ()), *([to_fixed] if coarse else []))
            return state.drop("off"), used
    raise RuntimeError(f"surface not settled after {MOST_ROUNDS} rounds")


def dirichlet_surface(cells: DataFrame, tolerance: float = 1e-6, mound: float = 0.0) -> DataFrame:
    """(component, r, c, value): the surface through anchors of each component of cells (component, r, c, anchor or null).

    Every other cell exceeds the mean of its neighbours in the domain by `mound` shared out over them: neighbours' sum less
    degree times value is -mound. Nothing flows where the domain ends. Components without an anchor are null.
    """
    mean = cells.groupBy("component").agg(F.avg("anchor").alias("__m")).where("__m is not null")
    anchored = cut(cells.join(mean, "component"))
    fixed = F.col("anchor").isNotNull()
    facts = cut(anchored.select("component", "r", "c", F.lit(0.0).alias("w"), F.lit(float(mound)).alias("load"), fixed.alias("fixed")))
    state, _ = _settled(facts, anchored.select("component", "r", "c", F.coalesce("anchor", "__m").alias("value")), tolerance)
    return cells.select("component", "r", "c").join(state, ["component", "r", "c"], "left")


# The smallest ridge, which keeps a component of caps alone solvable, and the wells of a cell that count.
RIDGE = 1e-9
MOST_WELLS = 10


def robust_surface(cells: DataFrame, smoothness: float = 1.0, scale: float = 10.0, cap_weight: float = 1e3, iterations: int = 8, tolerance: float = 1e-6) -> DataFrame:
    """(component, r, c, value): a membrane drawn to observations, which far outliers and caps from below do not move.

    cells: component, r, c, observed or null, cap or null, and n, the wells of a cell (at most MOST_WELLS count; 1 where the
    column is absent). It is solved once by the wells' counts alone; then `iterations` times, with each observation's weight
    times 1 / (1 + (miss / scale)^2), and with a weight of `cap_weight` towards the cap wherever the surface last lay above
    it. Components with neither an observation nor a cap are null.
    """
    key = ["component", "r", "c"]
    if "n" not in cells.columns:
        cells = cells.withColumn("n", F.when(F.col("observed").isNotNull(), 1))
    has = (F.col("observed").isNotNull() & (F.coalesce("n", F.lit(0)) > 0)).alias("has")
    kept = cells.groupBy("component").agg(F.max(has | F.col("cap").isNotNull()).alias("k"), F.avg("observed").alias("start")).where("k").drop("k")
    count = F.when(has, F.least(F.col("n"), F.lit(MOST_WELLS)).cast("double")).otherwise(0.0)
    known = cut(cells.join(kept, "component").select(*key, count.alias("count"), F.when(has, F.col("observed")).alias("observed"), F.col("cap").cast("double").alias("cap"), F.coalesce("start", F.lit(0.0)).alias("start")))

    def solve(well: Column, cap: Column, rows: DataFrame, state: DataFrame) -> DataFrame:
        w, load = (well + cap + RIDGE) / smoothness, (well * F.coalesce("observed", F.lit(0.0)) + cap * F.coalesce("cap", F.lit(0.0))) / smoothness
        facts = cut(rows.select(*key, w.alias("w"), load.alias("load"), F.lit(False).alias("fixed")))
        out, _ = _settled(facts, state, tolerance)
        drop(facts)
        return out

    none = F.lit(0.0)
    state = solve(F.col("count"), none, known, known.select(*key, F.col("start").alias("value")))
    for _ in range(iterations):
        rows = known.join(state, key)
        off = (F.col("value") - F.col("observed")) / scale
        weight = F.coalesce(F.col("count") / (1 + off * off), none)
        state = solve(weight, F.when(F.col("value") > F.col("cap"), F.lit(cap_weight)).otherwise(none), rows, state)
    return cells.select(*key).join(state, key, "left")
