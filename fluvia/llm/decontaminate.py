"""Benchmark decontamination by multi-pattern search in the manner of Wu and Manber, over words.

The patterns are windows of consecutive words of the test items. For patterns of one length, a table maps every block
of two words (by hash) to the distance by which a search may move on; blocks that no pattern holds allow the longest
move. Where the distance is 0, a bucket named by the hashes of the suffix block and of the prefix block holds the patterns
that may end there, and a comparison word by word confirms an occurrence. Many places of many texts move on in step, so each step is one numpy operation.
"""

from __future__ import annotations

from functools import reduce
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from fluvia.lineage import cut
from fluvia.llm import _text

WINDOW = 13
#: Bytes of test items that one pass over the documents searches for: compiled, they take about eight times that, on the
#: driver, in the broadcast and in a worker. More items are searched for in further passes.
ITEM_BYTES = 6_000_000
#: Words of an item that are searched for as one; longer items are cut into parts that share WINDOW - 1 words.
PART_WORDS = 20_000
#: Bytes from which an item may have to be cut.
_LONG = 100_000
#: The words of _text.ALNUM, before A-Z are lower-cased, as a regular expression.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Entries of a shift table: at least four times its blocks, within these bounds.
_TABLE = (1 << 18, 1 << 22)
#: Pairs of a place and a pattern that are compared at a time.
_COMPARED = 1 << 20
#: Places that one cursor runs over; long texts get many cursors.
_STRETCH = 512


class Patterns(NamedTuple):
    """The windows of one length: window i is the codes from codes[start[i]] on, of items owner[first[i]:first[i + 1]]."""

    length: int
    shift: np.ndarray
    bucket: np.ndarray
    codes: np.ndarray
    start: np.ndarray
    first: np.ndarray
    owner: np.ndarray


def _blocks(codes: np.ndarray, width: int) -> np.ndarray:
    """The code of the block of `width` words that ends at each word; the first width - 1 entries are of no use."""
    if width == 1:
        return codes
    out = codes.copy()
    out[1:] = _text.mix(codes[:-1] * np.uint64(3) + codes[1:])
    return out


def _bucket(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return _text.mix(suffix * np.uint64(3) + prefix)


def compile_items(texts: list[str | None], window: int = WINDOW) -> list[Patterns]:
    """Patterns of all items, by length: each window of an item, or all of an item that has fewer words than a window.

    The words of all items are held once; windows are places in them, so what is held is a few numbers for each word.
    """
    hashes, items = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for piece in _text.slices(pa.array(texts, pa.string())):
        words = _text.words(piece, _text.ALNUM, lower=True)
        hashes.append(words.hash)
        items.append(words.row + piece.first)
    codes, item = np.concatenate(hashes), np.concatenate(items)
    counts = np.bincount(item, minlength=len(texts))
    lengths = np.minimum(window, counts)
    begin = _text.starts(counts)
    out = []
    for length in sorted(set(lengths[lengths > 0].tolist())):
        chosen = np.flatnonzero(lengths == length)
        sizes = counts[chosen] - length + 1
        start = np.repeat(begin[:-1][chosen] - _text.starts(sizes)[:-1], sizes) + np.arange(sizes.sum())
        of = np.repeat(chosen, sizes)
        name = np.zeros(len(start), np.uint64)
        for k in range(length):
            name = _text.mix(name ^ codes[start + k]) + np.uint64(k)
        order = np.lexsort((of, name))
        name, start, of = name[order], start[order], of[order]
        new = np.ones(len(name), bool)
        new[1:] = name[1:] != name[:-1]
        for k in range(length):  # windows of equal names are told apart all the same
            new[1:] |= codes[start[1:] + k] != codes[start[:-1] + k]
        again = np.zeros(len(name), bool)
        again[1:] = ~new[1:] & (of[1:] == of[:-1])
        window_of = np.cumsum(new) - 1
        start, owner, window_of = start[new], of[~again], window_of[~again]
        width = min(2, length)
        shift = np.full(min(max(_TABLE[0], 1 << (4 * len(codes)).bit_length()), _TABLE[1]), length - width + 1, np.uint8)
        prefix = block = np.zeros(0, np.uint64)
        for end in range(width - 1, length):
            block = codes[start + end] if width == 1 else _text.mix(codes[start + end - 1] * np.uint64(3) + codes[start + end])
            prefix = block if end == width - 1 else prefix
            np.minimum.at(shift, block & np.uint64(len(shift) - 1), length - 1 - end)
        block = _bucket(block, prefix)
        order = np.argsort(block, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        moved = np.argsort(place[window_of], kind="stable")
        held = np.bincount(window_of, minlength=len(start))[order]
        out.append(Patterns(length, shift, block[order], codes, start[order], _text.starts(held), owner[moved]))
    return out


def _occurrences(codes: np.ndarray, bounds: np.ndarray, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    """Where (index of the last word) which window occurs. bounds: where the words of each text begin."""
    length, width = patterns.length, min(2, patterns.length)
    blocks = _blocks(codes, width)
    low, high = bounds[:-1] + length - 1, bounds[1:]
    stretches = np.maximum(0, -(-(high - low) // _STRETCH))
    text = np.repeat(np.arange(len(low)), stretches)
    nth = np.arange(len(text)) - np.repeat(_text.starts(stretches)[:-1], stretches)
    at = low[text] + nth * _STRETCH
    stop = np.minimum(at + _STRETCH, high[text])
    ends = []
    while len(at):
        move = patterns.shift[blocks[at] & np.uint64(len(patterns.shift) - 1)]
        ends.append(at[move == 0])
        at = at + np.maximum(move, 1)
        going = at < stop
        at, stop = at[going], stop[going]
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    bucket = _bucket(blocks[end], blocks[end - length + width])
    left = np.searchsorted(patterns.bucket, bucket, side="left")
    sizes = np.searchsorted(patterns.bucket, bucket, side="right") - left
    met = sizes > 0
    places, left, sizes = end[met], left[met], sizes[met]
    ends, whiches = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    # as many places at a time as have about _COMPARED patterns together
    part = np.cumsum(sizes) // _COMPARED
    for a, b in zip(*(lambda new: (new, np.append(new[1:], len(part))))(np.flatnonzero(np.diff(part, prepend=-1)))):
        n = sizes[a:b]
        end = np.repeat(places[a:b], n)
        which = np.repeat(left[a:b], n) + np.arange(len(end)) - np.repeat(_text.starts(n)[:-1], n)
        for back in range(length):
            same = codes[end - back] == patterns.codes[patterns.start[which] + length - 1 - back]
            end, which = end[same], which[same]
        ends.append(end)
        whiches.append(which)
    return np.concatenate(ends), np.concatenate(whiches)


def _searched(column: pa.Array, compiled: list[Patterns], ids: list[str]) -> pa.Array:
    """For each text: its words, the merged spans of words inside an occurrence, and the ids of the items found."""
    counts, spans, items = [], [], []
    for piece in _text.slices(column):
        rows = piece.last - piece.first
        words = _text.words(piece, _text.ALNUM, lower=True)
        bounds = np.searchsorted(words.row, np.arange(rows + 1))
        counts += np.diff(bounds).tolist()
        spans += (here := [[] for _ in range(rows)])
        items += (owned := [set() for _ in range(rows)])
        depth = np.zeros(len(words.hash) + 1, np.int64)
        for patterns in compiled:
            end, which = _occurrences(words.hash, bounds, patterns)
            np.add.at(depth, end - patterns.length + 1, 1)
            np.add.at(depth, end + 1, -1)
            for row, w in set(zip(words.row[end].tolist(), which.tolist())):
                owned[row].update(patterns.owner[patterns.first[w] : patterns.first[w + 1]].tolist())
        hit = np.flatnonzero(np.cumsum(depth)[:-1] > 0)
        if len(hit):
            row = words.row[hit]
            new = np.ones(len(hit), bool)
            new[1:] = (np.diff(hit) != 1) | (np.diff(row) != 0)
            begin = np.flatnonzero(new)
            finish = np.append(begin[1:], len(hit)) - 1
            for r, a, b in zip(row[begin].tolist(), hit[begin].tolist(), hit[finish].tolist()):
                here[r].append({"a": a - int(bounds[r]), "b": b - int(bounds[r]) + 1})
    return pa.array([{"n": n, "spans": s, "items": [ids[x] for x in sorted(i)]} for n, s, i in zip(counts, spans, items)], pa.struct([("n", pa.int64()), ("spans", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))]))


def _search(shared):
    @arrow_udf("struct<n:bigint,spans:array<struct<a:bigint,b:bigint>>,items:array<string>>")
    def searched(column: pa.Array) -> pa.Array:
        return _searched(column, *shared.value)

    return searched


def _parts(items: DataFrame, window: int) -> DataFrame:
    """(id, t) of different items, long ones in parts: every window of an item lies whole in one of them."""
    size, step = F.octet_length("t"), PART_WORDS
    found = F.regexp_extract_all("t", F.lit(_WORD), F.lit(0))
    cut_up = F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - window, F.lit(0)), F.lit(step)), lambda i: F.array_join(F.slice(found, i + 1, step + window - 1), " "))
    long = items.where(size > _LONG).withColumn("t", F.explode(cut_up))
    return items.where(size <= _LONG).unionByName(long).distinct()


def _blocks_of_items(parts: DataFrame) -> Iterator[list]:
    """The parts in blocks of at most ITEM_BYTES: they are dealt to small buckets by hash, and runs of buckets that fit
    make a block. A part that is larger alone (words of megabytes) is a block."""
    size = (F.octet_length("t") + F.octet_length("id") + 16).cast("long")
    whole = parts.agg(F.coalesce(F.sum(size), F.lit(0)).alias("n")).first()["n"]
    if whole <= ITEM_BYTES:
        yield parts.orderBy("id", "t").collect()
        return
    parts = parts.withColumn("__bucket", F.pmod(F.xxhash64("id", "t"), F.lit(64 * -(-int(whole) // ITEM_BYTES))))
    sums = sorted(parts.groupBy("__bucket").agg(F.sum(size).alias("n")).collect())
    runs, held = [], 0
    for bucket, n in sums:
        if not runs or held + n > ITEM_BYTES:
            runs.append([bucket, bucket])
            held = 0
        runs[-1][1] = bucket
        held += n
    for low, high in runs:
        yield parts.where(F.col("__bucket").between(low, high)).select("id", "t").orderBy("id", "t").collect()


def _with_last(blocks: Iterator[list]) -> Iterator[tuple[list, bool]]:
    """Each block, and whether it is the last."""
    held = next(blocks)
    for block in blocks:
        yield held, False
        held = block
    yield held, True


def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Adds n_words, n_hit, n_items, item_ids (array of strings, sorted) and contaminated to every document.

    Words are maximal runs of letters, digits and non-ASCII characters, A-Z lower-cased. A document word is hit if it
    lies inside any occurrence of a window; contaminated means n_hit > 0 and 20 * n_hit >= n_words. Null or empty
    documents have no words and are clean; null or empty items have no windows; a null item id counts as ''. Items that
    repeat an id count once, however often they are repeated. Existing columns of these names are replaced.

    Items are searched for in blocks of at most ITEM_BYTES (one block unless the benchmark is larger), each of them over
    all documents; items of more than PART_WORDS words are cut into overlapping parts before. With several blocks the
    documents are written once, and of each pass only what it found.
    """
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    docs = docs.drop("n_words", "n_hit", "n_items", "item_ids", "contaminated")
    searched = F.coalesce(F.col(text), F.lit(""))
    out, found = None, []
    for rows, last in _with_last(_blocks_of_items(_parts(items, window))):
        shared = docs.sparkSession.sparkContext.broadcast((compile_items([r.t for r in rows], window), [r.id for r in rows]))
        if last and not found:
            out = docs.withColumn("__found", _search(shared)(searched))
            break
        if not found:
            docs = cut(docs.withColumn("__key", F.monotonically_increasing_id()))
        here = docs.select("__key", _search(shared)(searched).alias("__found"))
        found.append(cut(here.where(F.size("__found.items") > 0) if found else here))
        shared.destroy()
    if out is None:
        of = reduce(DataFrame.unionByName, found).groupBy("__key").agg(F.max("__found.n").alias("n"), F.flatten(F.collect_list("__found.spans")).alias("spans"), F.flatten(F.collect_list("__found.items")).alias("items"))
        out = docs.join(of.select("__key", F.struct("n", "spans", "items").alias("__found")), "__key").drop("__key")
    out = out.withColumns({"n_words": F.col("__found.n"), "__spans": F.col("__found.spans"), "__ids": F.array_distinct("__found.items")}).drop("__found")
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n"))
    covered = F.aggregate(
        F.array_sort("__spans"),
        zero,
        lambda s, x: F.struct(F.greatest(s["end"], x["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["end"], x["a"]))).alias("n")),
    )["n"]
    return (
        out.withColumns({"n_hit": covered, "item_ids": F.array_sort("__ids")})
        .withColumns({"n_items": F.size("item_ids").cast("long"), "contaminated": (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))})
        .drop("__spans", "__ids")
    )
