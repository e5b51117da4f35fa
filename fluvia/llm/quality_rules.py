"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio of target against raw text.

Two multinomials over hashed byte n-grams are counted over whole texts: the target one over trusted documents, the raw
one over every document. A text's score is the mean over its n-grams of log(target / raw); every document whose mean is
below a fixed threshold is rejected, without any draw.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from fluvia.llm import _text
from fluvia.llm._frames import join_checked, summed_vector

#: Fixed parameters of the rule.
GRAM_BYTES = 4
BUCKETS = 1 << 17
SMOOTHING = 0.5
#: Mean log ratio per n-gram below which a document is rejected. Text of the trusted kind scores near or above 0, because
#: the raw corpus holds much of it; -0.25 means that the n-grams are on average a fifth less frequent in trusted text.
THRESHOLD = -0.25

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = _text.byte_class((0x0A, 0x0A))
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80


def _buckets(piece: _text.Slice) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every run of GRAM_BYTES bytes, and where each row's runs begin."""
    data = piece.data.astype(np.uint64)
    n = max(0, len(data) - GRAM_BYTES + 1)
    code = np.zeros(n, np.uint64)
    for k in range(GRAM_BYTES):
        code = (code << np.uint64(8)) | data[k : k + n]
    code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 17)
    lengths = np.maximum(0, np.diff(piece.offsets) - GRAM_BYTES + 1)
    keep = np.ones(n, bool)
    for k in range(1, GRAM_BYTES):  # runs that would reach into the next row
        at = piece.offsets[1:-1] - k
        keep[at[(at >= 0) & (at < n)]] = False
    return code[keep].astype(np.int64), _text.starts(lengths)


def _counts(batch: pa.RecordBatch, total: np.ndarray) -> None:
    for piece in _text.slices(batch.column(0)):
        total += np.bincount(_buckets(piece)[0], minlength=BUCKETS)


def log_ratios(docs: DataFrame, trusted: DataFrame, text: str) -> np.ndarray:
    """log(target / raw) of each bucket, additively smoothed; all zero where nothing is trusted."""
    raw = summed_vector(docs, [text], _counts, BUCKETS).astype(float)
    target = summed_vector(trusted, [text], _counts, BUCKETS).astype(float)
    if not target.sum() or not raw.sum():
        return np.zeros(BUCKETS)
    share = (raw + SMOOTHING) / (raw.sum() + SMOOTHING * BUCKETS)
    # the target is smoothed towards the raw shares, so a bucket rare in both says nothing
    prior = SMOOTHING * BUCKETS * target.sum() / raw.sum()
    return np.log((target + prior * share) / (target.sum() + prior)) - np.log(share)


def _measured(column: pa.Array, ratios: np.ndarray) -> pa.Array:
    fields: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")}
    for piece in _text.slices(column):
        rows = piece.last - piece.first
        words = _text.words(piece)

        def within(flags: np.ndarray) -> np.ndarray:
            sums = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[piece.offsets[1:]] - sums[piece.offsets[:-1]]

        fields["n_words"].append(_text.per_row(words.row, rows))
        fields["word_chars"].append(within(_FIRST_BYTE[piece.data] & _text.SPACED[piece.data]))
        fields["n_symbols"].append(within(_SYMBOL[piece.data]))
        lines = _text.words(piece, _NEWLINE)
        worded = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
        fields["n_dup_lines"].append(_text.per_row(_later(lines.hash[worded], lines.row[worded]), rows))
        grams, at = _text.ngrams(words.hash, words.row, 3)
        twice = at[_repeated(grams, words.row[at])]
        covered = np.zeros(len(words.hash), bool)
        for k in range(3):
            covered[twice + k] = True
        fields["n_repeat_words"].append(_text.per_row(words.row[covered], rows))
        buckets, at = _buckets(piece)
        sums = np.zeros(len(buckets) + 1)
        np.cumsum(ratios[buckets], out=sums[1:])
        fields["llr"].append(np.round((sums[at[1:]] - sums[at[:-1]]) / np.maximum(1, np.diff(at)), 6))
    return pa.StructArray.from_arrays([pa.array(np.concatenate(v) if v else np.zeros(0), pa.float64() if k == "llr" else pa.int64()) for k, v in fields.items()], list(fields))


def _later(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The rows of those entries that equal an earlier entry of their row."""
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    return row[1:][(hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])]


def _repeated(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which entries have an equal in their row."""
    key = _text.mix(hashes + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[:-1] | same[1:]
    return out


def apply_rules(docs: DataFrame, trusted_ids: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), llr, base_failed and kept.

    `trusted_ids` holds the ids of the target documents in a column named like `doc_id` (repeats and nulls do no harm;
    with none that matches, every ratio is 0 and only the base rules reject). A null text counts as empty: it has no
    words and fails the base rule. Texts shorter than an n-gram have a ratio of 0. Repeated rows are judged alike.
    Existing columns of the added names are replaced; an empty table gives an empty table.
    """
    marks = trusted_ids.select(F.col(doc_id)).where(F.col(doc_id).isNotNull()).distinct()
    value = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id), value.alias("__text"))
    ratios = docs.sparkSession.sparkContext.broadcast(log_ratios(read, join_checked(read, marks, [doc_id], "left_semi"), "__text"))

    @arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,llr:double>")
    def measured(column: pa.Array) -> pa.Array:
        return _measured(column, ratios.value)

    out = docs.withColumn("__rules", measured(value))
    out = out.withColumns({k: F.col(f"__rules.{k}") for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "llr")}).drop("__rules")
    out = out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= THRESHOLD))
