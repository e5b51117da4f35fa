"""Boosted histograms under blocked cross-validation: models without a block by subtraction.

A row falls into one bin of each feature (gaps have a bin of their own) and one cell of each pair of features. A model adds,
round by round, the histogram that lowers its squared error most, shrunk. All that a fit needs are weighted counts of bins
that occur together and label sums by bin. One pass gathers them for all blocks; the model that has not seen a block comes
from all sums less the block's own. Sums are whole numbers of UNIT, so that the difference holds nothing of the block's
labels, not even in its last digit.

Sizes follow the parameters: with f features, K = f (bins + 1) + f (f - 1) / 2 (pair_bins + 1)^2 bins, and K^2 sums a block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from fluvia.lineage import cut, drop

#: The unit in which weights and weighted labels are summed.
UNIT = 1e-6
#: Rows that meet in one task. A block of more rows is dealt out over several.
CHUNK_ROWS = 50_000
_STRIP = 2048
_HALF = 1 << 24


class Shape(NamedTuple):
    """What a model is made of: bins per feature and per feature of a pair, rounds, shrinkage, penalty, least weight of a bin."""

    bins: int = 16
    pair_bins: int = 4
    rounds: int = 300
    rate: float = 0.05
    l2: float = 2.0
    least: float = 1.0


class Bins(NamedTuple):
    """Edges of each feature's bins, fine and coarse, and where each histogram's bins begin among all."""

    fine: list[np.ndarray]
    coarse: list[np.ndarray] | None
    starts: np.ndarray
    size: int

    def codes(self, columns: list[np.ndarray]) -> np.ndarray:
        """For each row the number of its bin in each histogram."""
        fine, coarse = ([np.where(np.isnan(x), len(e) + 1, np.searchsorted(e, x, "right")) for e, x in zip(edges or [], columns)] for edges in (self.fine, self.coarse))
        pairs = [coarse[i] * (max(map(len, self.coarse)) + 2) + coarse[j] for i in range(len(coarse)) for j in range(i)]
        return np.stack([*fine, *pairs], 1) + self.starts


def bins_of(rows: DataFrame, features: list[str], shape: Shape, by: str | None = None) -> dict[str | None, Bins]:
    """Bins at quantiles of the features, over all rows (under None) or for each value of `by`. Labels have no say."""
    probs = [k / shape.bins for k in range(1, shape.bins)]
    wanted = [F.percentile_approx(_value(c), probs, 10_000).alias(f"__f{i}") for i, c in enumerate(features)]
    found = rows.groupBy(F.col(by) if by else F.lit(None).cast("string").alias("__model")).agg(*wanted).collect()
    sizes = [shape.bins + 1] * len(features) + [(shape.pair_bins + 1) ** 2] * (len(features) * (len(features) - 1) // 2 if shape.pair_bins else 0)
    out = {}
    for row in found:
        fine = [np.unique(np.array(e or [], float)) for e in row[1:]]
        coarse = [e[np.unique(np.linspace(0, len(e) - 1, shape.pair_bins - 1).round().astype(int))] if len(e) and shape.pair_bins > 1 else e[:0] for e in fine]
        out[row[0]] = Bins(fine, coarse if shape.pair_bins else None, np.cumsum([0, *sizes[:-1]]), int(sum(sizes)))
    return out


def _value(column: str) -> Column:
    """A feature as a double; NaN is a gap."""
    number = F.col(column).cast("double")
    return F.when(~F.isnan(number), number)


def sums_of(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """Whole numbers: weights of bins that occur together (size^2), then label sums by bin in two parts (2 size)."""
    w = np.rint(weight / UNIT)
    y = np.rint(weight * label / UNIT)
    high = np.floor(y / _HALF)
    together, sums = np.zeros((size, size), np.int64), np.zeros((2, size), np.int64)
    for k in range(0, len(w), _STRIP):
        part = codes[k : k + _STRIP]
        hot = np.zeros((len(part), size))
        hot[np.arange(len(part))[:, None], part] = 1
        together += ((hot * w[k : k + _STRIP, None]).T @ hot).astype(np.int64)
        sums[0] += (high[k : k + _STRIP] @ hot).astype(np.int64)
        sums[1] += ((y - high * _HALF)[k : k + _STRIP] @ hot).astype(np.int64)
    return np.concatenate([together.ravel(), sums.ravel()])


def fit(sums: np.ndarray, bins: Bins, shape: Shape) -> tuple[float, np.ndarray] | None:
    """Base and addend of every bin; None without weight."""
    n = bins.size
    together = sums[: n * n].reshape(n, n) * UNIT
    label = np.array([(int(a) * _HALF + int(b)) * UNIT for a, b in sums[n * n :].reshape(2, n).T])
    weight = together.diagonal()
    first = slice(0, bins.starts[1] if len(bins.starts) > 1 else n)
    if weight[first].sum() <= 0:
        return None
    base = label[first].sum() / weight[first].sum()
    left = label - base * weight
    scale = np.where(weight >= max(shape.least, UNIT), 1 / (weight + shape.l2), 0.0)
    ends = [*bins.starts[1:], n]
    added = np.zeros(n)
    for _ in range(shape.rounds):
        best = int(np.argmax(np.add.reduceat(left * left * scale, bins.starts)))
        own = slice(bins.starts[best], ends[best])
        step = shape.rate * left[own] * scale[own]
        added[own] += step
        left -= together[:, own] @ step
    return float(base), added


def _dealt(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows with __part, so that (__model, __part) holds about CHUNK_ROWS at most, and the number of parts per model."""
    parts = cut(rows.groupBy("__model").agg(F.ceil(F.count("*") / CHUNK_ROWS).alias("__parts")))
    return rows.join(parts, "__model").withColumn("__part", F.pmod(F.xxhash64(key), F.col("__parts"))).drop("__parts"), parts


def _columns(pdf: pd.DataFrame, n: int) -> list[np.ndarray]:
    return [pdf[f"__f{i}"].to_numpy(float) for i in range(n)]


def _total(sums: DataFrame, size: int) -> np.ndarray:
    """All rows of sums added up: within partitions, then in eight, whose results reach the driver."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                total += np.frombuffer(zlib.decompress(packed), np.int64)
        yield pa.RecordBatch.from_pydict({"sums": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    few = sums.select("sums").mapInArrow(added, "sums binary").repartition(8).mapInArrow(added, "sums binary")
    return sum((np.frombuffer(zlib.decompress(r.sums), np.int64) for r in few.collect()), np.zeros(size, np.int64))


def predictions(train: DataFrame, test: DataFrame, key: str, features: list[str], shape: Shape, without_own: bool) -> DataFrame:
    """(key, __model, prediction) for `test`. Both sides have __model (a string), `key` and the features; `train` has
    __label and __weight. A model is fitted on its own training rows, or on all others' if `without_own`; then bins are
    the same for all, else each model has those of its training rows, for their features may come from labels."""
    n = len(features)
    bins = bins_of(test, features, shape) if without_own else bins_of(train, features, shape, "__model")
    wide = next((b.size for b in bins.values()), 0)
    size = wide * wide + 2 * wide

    def bins_for(model: str) -> Bins:
        return bins[None if without_own else model]
    as_features = [_value(c).alias(f"__f{i}") for i, c in enumerate(features)]

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        own = sums_of(bins_for(pdf["__model"].iloc[0]).codes(_columns(pdf, n)), pdf["__label"].to_numpy(float), pdf["__weight"].to_numpy(float), wide)
        return pd.DataFrame({"__model": [pdf["__model"].iloc[0]], "sums": [zlib.compress(own.tobytes(), 1)]})

    usable = train.where("__label is not null and not isnan(__label) and __weight > 0").select("__model", key, "__label", "__weight", *as_features)
    dealt, parts_of_train = _dealt(usable, key)
    gathered = cut(dealt.groupBy("__model", "__part").applyInPandas(sums, "__model string, sums binary"))
    whole = train.sparkSession.sparkContext.broadcast(_total(gathered, size)) if without_own else None

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = None, None

        def row() -> pa.RecordBatch:
            found = fit(whole.value - total if without_own else total, bins_for(model), shape)
            base, added = found or (None, None)
            return pa.RecordBatch.from_pydict({"__model": pa.array([model], pa.string()), "base": pa.array([base], pa.float64()), "added": pa.array([added], pa.list_(pa.float64()))})

        for batch in batches:
            for name, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name != model:
                    if model is not None:
                        yield row()
                    model, total = name, np.zeros(size, np.int64)
                total += np.frombuffer(zlib.decompress(packed), np.int64)
        if model is not None:
            yield row()

    # blocks that give no training rows still are predicted by all others' sums
    silent = test.select("__model").distinct().join(gathered.select("__model").distinct(), "__model", "left_anti")
    zero = F.lit(zlib.compress(np.zeros(size, np.int64).tobytes(), 1))
    asked = gathered.unionByName(silent.withColumn("sums", zero)) if without_own else gathered
    models = cut(asked.repartition("__model").sortWithinPartitions("__model").mapInArrow(fitted, "__model string, base double, added array<double>"))
    rows, parts = _dealt(test.select("__model", key, *as_features), key)
    each = models.join(parts, "__model").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__parts") - 1)))

    def predicted(pdf: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        out = pdf[[key, "__model"]].copy()
        out["prediction"] = np.nan
        if len(model) and len(pdf) and model["added"].iloc[0] is not None:
            out["prediction"] = float(model["base"].iloc[0]) + np.asarray(model["added"].iloc[0])[bins_for(pdf["__model"].iloc[0]).codes(_columns(pdf, n))].sum(1)
        return out

    kind = dict(test.dtypes)[key]
    out = cut(rows.groupBy("__model", "__part").cogroup(each.groupBy("__model", "__part")).applyInPandas(predicted, f"`{key}` {kind}, __model string, prediction double"))
    drop(gathered, models, parts, parts_of_train)
    return out.withColumn("prediction", F.when(~F.isnan("prediction"), F.col("prediction")))


def leave_one_block_out(rows: DataFrame, key: str, block: str, features: list[str], target: str, weight: str | None = None, least_rows: int = 30, shape: Shape = Shape()) -> DataFrame:
    """(key, block, target, eligible, prediction): each row by a model of the other blocks' rows.

    Blocks of fewer than `least_rows` rows (and rows without a block) are not eligible: they teach nothing and get no
    prediction. Rows without a target are predicted and teach nothing. `key` must be unique.
    """
    counts = rows.groupBy(block).agg(F.count("*").alias("__n"))
    kept = rows.join(counts.where(F.col("__n") >= least_rows).select(block), block, "left_semi").withColumn("__model", F.col(block).cast("string"))
    train = kept.withColumns({"__label": F.col(target).cast("double"), "__weight": F.lit(1.0) if weight is None else F.col(weight).cast("double")})
    told = predictions(train, kept, key, features, shape, True).select(key, "prediction", F.lit(True).alias("eligible"))
    return rows.select(key, block, target).join(told, key, "left").select(key, block, target, F.coalesce("eligible", F.lit(False)).alias("eligible"), "prediction")


def random_folds(rows: DataFrame, key: str, folds: int, seed: int = 0) -> DataFrame:
    """Adds `fold` by a hash of the key: the split that neighbours leak through, for comparison with blocks."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), key), F.lit(folds)).cast("int"))
