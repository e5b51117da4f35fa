"""How far the sources of a language differ in their words: exact sums over count-level bitmaps.

Each language keeps the terms of at least LEAST_DOCUMENTS of its documents. A group (lang, source) is described by its
counts of them: for each count, the set of terms that occur that often, as bits. Terms are numbered in the order of their
frequency, 64 to a word, so that rare counts, which few terms share, meet in few words. The joint cell of two groups (terms
that occur a times here and b times there) is the number of bits that two sets share; it is multiplied by what the two
smoothed shares differ. Terms that a group lacks are the complement of all its sets.

Work is dealt out by language, pairs of tiles of sources, and chunks of terms, none of which is larger where a language,
a source or a term is common. What pairs of sources differ in a chunk is summed in numpy, then over chunks by Spark.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from fluvia.lineage import cut
from fluvia.llm._frames import join_checked, released

LEAST_DOCUMENTS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP_TERMS = 50
#: Sources that meet in one task, and words of 64 terms in it.
TILE_SOURCES, CHUNK_WORDS = 32, 16
#: Counted terms that a task holds before it gives them out, and bytes of a text that are split at once.
HELD_TERMS, SLICE_BYTES = 300_000, 1_000_000
#: Kinds of rows that meet in a task.
SOURCE, MASK, MAP = 0, 1, 2
#: Rows of an AND table computed at once.
STRIP_ROWS = 256

_LETTERS = bytes(b | 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b > 0x7F else 0x20 for b in range(256))


def _words(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, lower-cased in A-Z, in lists that bounded slices of it give."""
    at = 0
    while len(raw) - at > SLICE_BYTES:
        end = at + SLICE_BYTES
        while end < len(raw) and _LETTERS[raw[end]] != 0x20:
            end += 1
        yield raw[at:end].translate(_LETTERS).split()
        at = end
    yield raw[at:].translate(_LETTERS).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that have the term, added up within tasks only."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            counts, found, held = defaultdict(Counter), defaultdict(Counter), 0

            def given() -> Iterator[pa.RecordBatch]:
                for (lang, source), terms in counts.items():
                    own, seen = list(terms.items()), found[lang, source]
                    for k in range(0, len(own), 20_000):
                        names, n = zip(*own[k : k + 20_000])
                        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(n)), "source": pa.array([source] * len(n)), "term": pa.array(names, pa.binary()), "n": pa.array(n, pa.int64()), "docs": pa.array([seen[x] for x in names], pa.int64())})
                counts.clear(), found.clear()

            for batch in batches:
                for lang, source, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    here, docs_here, seen = counts[lang, source], found[lang, source], set()
                    before = len(here)
                    for words in _words(raw):
                        here.update(words)
                        seen.update(words)
                    docs_here.update(seen)
                    held += len(here) - before
                    if held > HELD_TERMS:
                        yield from given()
                        held = 0
            yield from given()

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(counted, "lang string, source string, term binary, n bigint, docs bigint").withColumn("term", F.col("term").cast("string"))


def _share(n: str, total: str, terms: str) -> str:
    """The smoothed share of a count in whole billionths, by exact division."""
    return f"1 + cast({SCALE} as decimal(10,0)) * cast({n} + {SMOOTHING} as decimal(20,0)) div cast({total} + {SMOOTHING} * {terms} as decimal(20,0))"


def _differences(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of |p - q| over the terms of a chunk, for pairs of sources of two tiles. Rows of kind SOURCE are the sources, of
    kind MASK the words of kept terms, of kind MAP the bitmaps; no column has nulls, for pandas would round its integers."""
    left, right = int(rows.left.iloc[0]), int(rows.right.iloc[0])
    sources = rows[rows.kind == SOURCE].sort_values(["tile", "source"], kind="stable")
    number = {s: k for k, s in enumerate(sources.source)}
    zero, tiles = sources.p.to_numpy(np.int64), sources.tile.to_numpy(np.int64)
    total = np.zeros((len(zero), len(zero)), np.int64)
    masks = rows[rows.kind == MASK]
    maps = rows[rows.kind == MAP].sort_values("block")
    at, block = maps.source.map(number).to_numpy(np.int64), maps.block.to_numpy(np.int64)
    word, share = maps.word.to_numpy(np.int64).view(np.uint64), maps.p.to_numpy(np.int64)
    everyone = np.arange(len(zero))
    for key, mask in zip(masks.block.to_numpy(np.int64), masks.word.to_numpy(np.int64).view(np.uint64)):
        a, b = np.searchsorted(block, [key, key + 1])
        used = np.zeros(len(zero), np.uint64)
        np.bitwise_or.at(used, at[a:b], word[a:b])
        who, bits, p = np.append(at[a:b], everyone), np.append(word[a:b], mask & ~used), np.append(share[a:b], zero)
        order = np.argsort(who, kind="stable")
        who, bits, p = who[order], bits[order], p[order]
        side = tiles[who]
        rows_of, columns_of = np.flatnonzero(side == left), np.flatnonzero(side == right)
        if not len(rows_of) or not len(columns_of):
            continue
        starts = np.flatnonzero(np.diff(who[columns_of], prepend=-1))
        for k in range(0, len(rows_of), STRIP_ROWS):
            strip = rows_of[k : k + STRIP_ROWS]
            cells = np.bitwise_count(bits[strip, None] & bits[None, columns_of]) * np.abs(p[strip, None] - p[None, columns_of])
            sums = np.add.reduceat(cells, starts, axis=1)
            np.add.at(total, (who[strip][:, None], who[columns_of][starts][None, :]), sums)
    i, j = np.nonzero((tiles[:, None] == left) & (tiles[None, :] == right) & ((left != right) | (everyone[:, None] < everyone[None, :])))
    names = sources.source.to_numpy()
    return pd.DataFrame({"lang": rows.lang.iloc[0], "source": names[i], "item": names[j], "value": total[i, j]})


def audit(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) over `docs` with text, lang and source, whose nulls count as ''.

    Part `pair`: each other source of the language and the sum over all kept terms of |p - q|; part `term`: the kept terms
    that a group has and uses more than its language does, by p - q, up to rank `top`. Ranks go by value descending, then
    item in byte order. A share p is 1 + floor(10^9 (count + 5) / (N + 5 V)). A language that keeps no term has pairs of
    value 0 and no terms; an only source has no pairs. Repeated rows count each, extra columns are ignored, an empty table
    gives an empty table. All sums are whole numbers.
    """
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    of_term = W.partitionBy("lang", "term")
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    common = counts.select("lang", "source", "term", "n", F.sum("docs").over(of_term).alias("docs"), F.sum("n").over(of_term).alias("total")).where(F.col("docs") >= least_documents)
    kept = cut(common.drop("docs"))
    ranged = kept.groupBy("lang", "term").agg(F.max("total").alias("total")).repartitionByRange("lang", F.desc("total"), "term").sortWithinPartitions("lang", F.desc("total"), "term")
    number = F.monotonically_increasing_id()
    terms = cut(ranged.select("lang", "term", "total", number.alias("id")).selectExpr("lang", "term", "total", "shiftright(id, 6) AS block", "shiftleft(1L, cast(id & 63 as int)) AS word"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("n_terms"), F.sum("total").alias("lang_n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    everyone = docs.select("lang", "source").distinct()
    of_lang = W.partitionBy("lang")
    groups = everyone.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["group_n", "n_terms", "lang_n"])
    tiles = F.ceil(F.count("*").over(of_lang) / TILE_SOURCES)
    groups = cut(groups.withColumn("tiles", tiles).withColumn("tile", F.expr("pmod(xxhash64(source), tiles)")))

    described = join_checked(kept, groups, ["lang", "source"], "inner").withColumn("p", F.expr(_share("n", "group_n", "n_terms")))
    more = described.withColumn("value", F.col("p") - F.expr(_share("total", "lang_n", "n_terms"))).where("value > 0")
    by_value = W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_terms = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value").withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    # each bitmap goes to every pair of tiles that its source's tile is in
    both = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("other")
    placed = ["least(tile, other) AS left", "greatest(tile, other) AS right"]
    chunk = F.expr(f"block div {CHUNK_WORDS}").alias("chunk")
    maps = described.select("lang", "source", "term", "n", "p", "tile", "tiles").join(terms.select("lang", "term", "block", "word"), ["lang", "term"]).groupBy("lang", "source", "block", "n", "p", "tile", "tiles").agg(F.bit_or("word").alias("word"))
    masks = terms.groupBy("lang", "block").agg(F.bit_or("word").alias("word"))
    chunks = masks.select("lang", chunk).distinct()
    active = groups.where("n_terms > 0").select("lang", "source", F.expr(_share("0", "group_n", "n_terms")).alias("p"), "tile", "tiles")
    pairs_of_tiles = active.select("lang", "tile", "tiles").distinct().select("lang", "tile", both).selectExpr("lang", *placed).distinct()
    fields = ["lang", "left", "right", "chunk", "kind", "source", "block", "p", "word", "tile"]
    none = F.lit(0).cast("long")
    parts = [
        maps.select("lang", "source", "block", "p", "word", "tile", chunk, both).selectExpr("*", f"{MAP} AS kind", *placed).select(*fields),
        join_checked(masks.select("lang", "block", "word", chunk), pairs_of_tiles, "lang", "inner").withColumns({"kind": F.lit(MASK), "source": F.lit(""), "p": none, "tile": none}).select(*fields),
        join_checked(chunks, active.select("lang", "source", "p", "tile", both), "lang", "inner").selectExpr("*", *placed).withColumns({"kind": F.lit(SOURCE), "block": none, "word": none}).select(*fields),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    found = rows.groupBy("lang", "left", "right", "chunk").applyInPandas(_differences, "lang string, source string, item string, value bigint")
    half = found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    silent = groups.where("n_terms = 0").select("lang", "source")
    same = silent.join(silent.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    whole = half.select("lang", "source", "item", "value", F.explode(F.array(F.lit(False), F.lit(True))).alias("turned")).selectExpr("lang", "if(turned, item, source) AS source", "if(turned, source, item) AS item", "value")
    ranked_pairs = whole.unionByName(same).select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(by_value))
    return ranked_pairs.unionByName(ranked_terms)
