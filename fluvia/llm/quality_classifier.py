"""Quality classifier: naive Bayes features for a linear support vector machine.

Texts become indicators of hashed n-grams. Each indicator is scaled by the log ratio of its smoothed class counts, taken
over all labelled rows; a linear model with squared hinge loss is then fitted by dual coordinate descent on a bounded
sample of them, in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from fluvia.llm import _text
from fluvia.llm._frames import released, summed_vector

BUCKETS = 1 << 17
_HASHES = 1 << 30
#: Byte n-grams; besides them come runs of equal words, as n-grams of the relation "equal to the word before".
GRAM_BYTES = 4
LONGEST_RUN = 4
#: Labelled rows that the linear model is fitted on at most: the first by a hash of their id. Class counts use all.
FIT_ROWS = 6_000
EPOCHS = 12
PENALTY = 1.0
#: Scores are the logistic function of this many times the margin.
STEEPNESS = 2.0


def indicators(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each slice of a column: its rows, and the distinct (row, bucket) pairs of its texts, in order."""
    for piece in _text.slices(column):
        rows = piece.last - piece.first
        data = piece.data.astype(np.uint64)
        n = max(0, len(data) - GRAM_BYTES + 1)
        code = np.zeros(n, np.uint64)
        for k in range(GRAM_BYTES):
            code = (code << np.uint64(8)) | data[k : k + n]
        bucket = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
        row = np.repeat(np.arange(rows), np.diff(piece.offsets))
        whole = row[:n] == row[GRAM_BYTES - 1 :] if n else np.zeros(0, bool)
        words = _text.words(piece)
        same = np.zeros(len(words.hash), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
        pairs = [(row[:n][whole].astype(np.uint64) << np.uint64(20)) | bucket[whole]]
        run = same.copy()
        for k in range(1, LONGEST_RUN + 1):
            pairs.append((words.row[run].astype(np.uint64) << np.uint64(20)) | np.uint64(BUCKETS + k - 1))
            run[1:] = run[:-1] & same[1:]
            run[:1] = False
        pairs = _text.distinct(np.concatenate(pairs))
        yield piece.first, rows, (pairs >> np.uint64(20)).astype(np.int64), (pairs & np.uint64((1 << 20) - 1)).astype(np.int64)


WIDTH = BUCKETS + LONGEST_RUN


def class_ratios(labelled: DataFrame) -> np.ndarray:
    """log of the share of class 1 over the share of class 0, for each indicator, over all rows (text, label)."""

    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        label = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for first, _, row, bucket in indicators(batch.column(0)):
            total += np.bincount(bucket + WIDTH * label[first + row], minlength=2 * WIDTH)

    total = summed_vector(labelled, ["text", "label"], count, 2 * WIDTH).astype(float) + 1
    return np.log(total[WIDTH:] / total[WIDTH:].sum()) - np.log(total[:WIDTH] / total[:WIDTH].sum())


def dual_descent(rows: list[np.ndarray], labels: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """Weights of the scaled indicators and, last, of the constant: squared hinge loss, one dual variable per row."""
    weights = np.zeros(len(ratios) + 1)
    duals = np.zeros(len(rows))
    sign = np.where(labels == 1, 1.0, -1.0)
    # rows of unequal length count alike, and so do the classes
    scale = [1 / max(1e-9, np.sqrt((ratios[x] ** 2).sum() + 1)) for x in rows]
    cost = np.where(labels == 1, len(rows) / 2 / max(1, (labels == 1).sum()), len(rows) / 2 / max(1, (labels == 0).sum())) * PENALTY
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            x = rows[i]
            value = ratios[x] * scale[i]
            gradient = sign[i] * (value @ weights[x] + scale[i] * weights[-1]) - 1 + duals[i] / (2 * cost[i])
            new = max(0.0, duals[i] - gradient / (1 + 1 / (2 * cost[i])))
            if new != duals[i]:
                step = (new - duals[i]) * sign[i]
                weights[x] += step * value
                weights[-1] += step * scale[i]
                duals[i] = new
    return weights


def fit(labelled: DataFrame, row_id: str = "id") -> np.ndarray:
    """Weights for every indicator, to be read with the norms of the rows. labelled: id, text, label (0 or 1)."""
    ratios = class_ratios(labelled)
    shared = labelled.sparkSession.sparkContext.broadcast(ratios)
    # the rows with the smallest hashes: a share of all hashes that holds them first, of which only the numbers are compared
    every = labelled.withColumn("h", F.xxhash64(row_id, "text", "label")).withColumn("o", F.pmod(F.xxhash64("h"), F.lit(1 << 62)))
    count = labelled.count()
    hashed = every if count <= 2 * FIT_ROWS else every.where(F.pmod("h", F.lit(_HASHES)) < max(1, 2 * FIT_ROWS * _HASHES // count))

    def least(some: DataFrame):
        """How many different rows have the smallest hashes, FIT_ROWS at most, and the largest of these."""
        return some.select("o").distinct().orderBy("o").limit(FIT_ROWS).agg(F.count("*").alias("n"), F.max("o").alias("last")).first()

    found = least(hashed)
    if count > 2 * FIT_ROWS and found["n"] < FIT_ROWS:  # rows repeat: the share holds too few different ones
        hashed, found = every, least(every)
    last = found["last"]
    # a row that is repeated is learned once
    chosen = hashed.where(F.col("o") <= F.lit(last)).groupBy("o").agg(F.first("text").alias("text"), F.first("label").alias("label")).select("text", "label", "o")

    def found_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [pa.array([], pa.list_(pa.int32()))]
            for _, n, row, bucket in indicators(batch.column(0)):
                lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(bucket, pa.int32())))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(lists), batch.column(1), batch.column(2)], ["buckets", "label", "o"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            rows, labels, places = [], [], []
            for batch in batches:
                column = batch.column(0)
                at, flat = column.offsets.to_numpy(), column.values.to_numpy()
                rows += [flat[a:b].copy() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                labels += batch.column(1).to_pylist()
                places += batch.column(2).to_pylist()
            # the same order however rows arrive
            sorted_ = sorted(range(len(rows)), key=lambda i: (places[i], labels[i]))
            weights = dual_descent([rows[i] for i in sorted_], np.array(labels, np.int64)[sorted_], shared.value)
            yield pa.RecordBatch.from_pydict({"weights": pa.array([weights.tobytes()], pa.binary())})

    # what meets in one task are the indicators of the sample, whose size BUCKETS and FIT_ROWS bound, and no texts
    sample = chosen.mapInArrow(found_in, "buckets array<int>, label int, o bigint")
    found = sample.repartition(1).mapInArrow(fitted, "weights binary").collect() if last is not None else []
    weights = sum((np.frombuffer(r.weights) for r in found), np.zeros(len(ratios) + 1))
    return np.stack([np.append(ratios, 1.0), weights])


def score_quality(docs: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """Adds score (0 to 1, higher: label 1 likelier) and predicted (int) to every whole text.

    A null text counts as empty: only the constant speaks. Without labelled rows every score is 0.5. Existing columns of
    the two names are replaced; repeated rows get equal scores; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def scored(column: pa.Array) -> pa.Array:
        ratios, weights = shared.value
        out = []
        for _, n, row, bucket in indicators(column):
            norm = np.sqrt(_text.per_row(row, n, ratios[bucket] ** 2) + 1)
            margin = (_text.per_row(row, n, ratios[bucket] * weights[bucket]) + weights[-1]) / norm
            out.append(1 / (1 + np.exp(-STEEPNESS * np.clip(margin, -15, 15))))
        return pa.array(np.round(np.concatenate(out), 9) if out else np.zeros(0), pa.float64())

    return docs.withColumn("score", scored(F.coalesce(F.col(text), F.lit("")))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
