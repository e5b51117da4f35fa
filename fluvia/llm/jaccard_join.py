"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Shingles are ordered by their estimated frequency in the whole corpus (a counting sketch of fixed size), rarest first.
Two sets that are similar enough share at least l of the shingles in their l-prefixes, for every l; l = 1 is the usual
prefix filter. Every document posts the shingles of its longest prefix. Documents whose postings promise many candidates
use a longer prefix, and their candidates must share correspondingly more shingles before they are verified.

A shared shingle counts for a pair only if it stands early enough in both sets for the overlap that their two sizes
require, so the longer set of a pair looks only among those sizes of partners that its shingle's place allows.

A shingle that few sets hold gives its pairs where its postings meet, which is one shuffle. A pair must share enough in
every prefix; only if both its sets also have shingles that many hold does one shared shingle make it a candidate. The
postings of those other shingles go on, as follows.

Copies and large groups never become all their pairs. Equal sets are one node from the start. A first round verifies
each set against one neighbour only, the one that it shares most with, or whose prefix shingles are the most shared ones,
which joins large groups of near copies around their least edited member; the full join then looks only at candidates
that are not in one component yet, which are all the links that can still change a component.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from fluvia.lineage import cut, drop
from fluvia.llm import _text
from fluvia.llm._frames import join_checked, summed_vector
from fluvia.operators.graph import connected_components

SHINGLE_WORDS = 5
#: Similarity of 3 / 4 or more.
NUMERATOR, DENOMINATOR = 3, 4
#: Counters of the frequency sketch: a fixed 8 MB, whatever the corpus. It only decides the order, never the result.
SKETCH_BITS = 22
LONGEST = 4
#: Candidates that a document's postings promise, beyond which its prefix is one, two, three shingles longer, unless the
#: longer prefix would add more than half as many.
COSTS = (32, 128, 512)
#: Sets that a task remembers to have posted.
KNOWN_SETS = 500_000
#: Sets that hold a shingle, up to which it gives its pairs at once.
FEW = 8
#: Postings of one shingle and component that are paired as one list.
CHUNK = 128


_UNION = NUMERATOR + DENOMINATOR
_PLACES = 1 << 31


def shingles(piece: _text.Slice, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every text's distinct shingles, ordered by row, then hash. Texts of fewer words have one."""
    words = _text.words(piece, _text.SPACED, lower=True)
    grams, at = _text.ngrams(words.hash, words.row, size)
    hashes, rows = [grams], [words.row[at]]
    counts = _text.per_row(words.row, piece.last - piece.first)
    for k in range(1, size):
        few = counts[words.row] == k
        if few.any():
            grams, at = _text.ngrams(words.hash[few], words.row[few], k)
            hashes.append(grams)
            rows.append(words.row[few][at])
    value, row = np.concatenate(hashes), np.concatenate(rows).astype(np.uint16)
    order = np.argsort(value)
    order = order[np.argsort(row[order], kind="stable")]
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return row[new].astype(np.int64), value[new]


def _set_ids(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64-bit name of each row's set; equal sets have equal names."""
    counts = _text.per_row(row, rows)
    at = _text.starts(counts)
    sums = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(_text.mix(value ^ np.uint64(0xA0761D6478BD642F)), out=sums[1:])
    return counts, _text.mix(sums[at[1:]] - sums[at[:-1]] + counts.astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB)).view(np.int64)


def _described(docs: DataFrame) -> DataFrame:
    """(doc_id, n, set_id) of each row."""

    @arrow_udf("struct<n:bigint,set_id:bigint>")
    def described(column: pa.Array) -> pa.Array:
        sizes, names = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for piece in _text.slices(column):
            n, name = _set_ids(*shingles(piece), piece.last - piece.first)
            sizes.append(n)
            names.append(name)
        return pa.StructArray.from_arrays([pa.array(np.concatenate(sizes)), pa.array(np.concatenate(names))], ["n", "set_id"])

    return docs.withColumn("__d", described("text")).select("doc_id", F.col("__d.n").alias("n"), F.col("__d.set_id").alias("set_id"))


def _frequencies(docs: DataFrame) -> np.ndarray:
    def count(batch: pa.RecordBatch, total: np.ndarray) -> None:
        for piece in _text.slices(batch.column(0)):
            np.add.at(total, (shingles(piece)[1] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)

    return np.minimum(summed_vector(docs, ["text"], count, 1 << SKETCH_BITS), 65535).astype(np.uint16)


def _needed(n: np.ndarray) -> np.ndarray:
    """The least overlap of a set of n shingles with any set that is similar enough."""
    return -(-NUMERATOR * n // DENOMINATOR)


def _postings(docs: DataFrame, frequencies: np.ndarray) -> DataFrame:
    """(token, set_id, nr): the shingles in each document's longest prefix; nr packs the set's size and the place, from 0,
    of the shingle in the common order."""
    shared = docs.sparkSession.sparkContext.broadcast(frequencies)

    def posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)
        for batch in batches:
            for piece in _text.slices(batch.column(0)):
                rows = piece.last - piece.first
                row, value = shingles(piece)
                n, name = _set_ids(row, value, rows)
                # of the copies that a task meets, one posts; which ones others post is settled after the shuffle
                _, first = np.unique(name, return_index=True)
                fresh = np.zeros(rows, bool)
                fresh[first] = ~np.isin(name[first], known)
                known = np.union1d(known if len(known) < KNOWN_SETS else known[:0], name)
                often = shared.value[(value >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                order = np.argsort(often, kind="stable")
                order = order[np.argsort(row[order].astype(np.uint16), kind="stable")]
                rank = np.arange(len(order)) - _text.starts(n)[row]  # rows are in order, before and after
                # a shingle that the sketch has seen once stands in no other document
                kept = (rank < (n - _needed(n))[row] + LONGEST) & (often[order] > 1) & fresh[row]
                yield pa.RecordBatch.from_pydict({"token": pa.array(value[order][kept].view(np.int64)), "set_id": pa.array(name[row[kept]]), "nr": pa.array((n[row] * _PLACES + rank)[kept])})

    return docs.select("text").mapInArrow(posted, "token bigint, set_id bigint, nr bigint")


def _paired_or_posted(few: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of postings in order of token, size and set, each taken once: the pairs of a token that at most `few` sets hold, and
    the postings themselves of any other. A pair (a, b, level, need) is made only where the two sizes could match; level is
    the shortest of the prefixes 1 to LONGEST that holds the shingle in both sets, need how many they must share in the
    longest one. A posting is (token, a, b) for (token, set, nr), with level 0."""

    def pairs(rows: np.ndarray) -> np.ndarray:
        size, rank = rows[:, 2] // _PLACES, rows[:, 2] % _PLACES
        out = []
        for step in range(1, few):
            x = np.flatnonzero(rows[step:, 0] == rows[:-step, 0])
            if not len(x):
                break
            y = x + step
            overlap = -(-NUMERATOR * (size[x] + size[y]) // _UNION)
            level = np.maximum(np.maximum(rank[x] - size[x], rank[y] - size[y]) + overlap, 0) + 1
            kept = (DENOMINATOR * size[x] >= NUMERATOR * size[y]) & (level <= LONGEST)
            first, second = rows[x[kept], 1], rows[y[kept], 1]
            out.append(np.stack([np.minimum(first, second), np.maximum(first, second), level[kept], np.minimum(overlap[kept], LONGEST)], axis=1))
        return np.concatenate(out) if out else np.zeros((0, 4), np.int64)

    def emitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = held = np.zeros((0, 3), np.int64)  # the row before, and the last token's rows while they are few
        many = None  # the last token that turned out to have more
        for batch in itertools.chain(batches, [None]):
            rows = held if batch is None else np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            if batch is not None and len(rows):
                before = np.concatenate([last if len(last) else ~rows[:1], rows[:-1]])
                rows, last = np.concatenate([held, rows[(rows[:, :2] != before[:, :2]).any(axis=1)]]), rows[-1:]
            if not len(rows):
                continue
            start = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
            count = np.diff(np.append(start, len(rows)))
            more = (count > few) | ((rows[start, 0] == many) if many is not None else False)
            held = rows[:0]
            if batch is not None and not more[-1]:
                held = rows[start[-1] :]
            elif more[-1]:
                many = rows[-1, 0]
            rows, more = rows[: len(rows) - len(held)], np.repeat(more, count)[: len(rows) - len(held)]
            two, one = pairs(rows[~more]), rows[more]
            columns = [np.concatenate(c) for c in ((one[:, 1], two[:, 0]), (one[:, 2], two[:, 1]), (np.zeros(len(one), np.int8), two[:, 2].astype(np.int8)), (np.zeros(len(one), np.int8), two[:, 3].astype(np.int8)))]
            token = pa.concat_arrays([pa.array(one[:, 0]), pa.nulls(len(two), pa.int64())])
            yield pa.RecordBatch.from_arrays([token, *map(pa.array, columns)], ["token", "a", "b", "level", "need"])

    return emitted


def _verified(pairs: DataFrame, docs: DataFrame, described: DataFrame) -> DataFrame:
    """Those pairs (src, dst of set ids) whose sets are similar enough. Sets are computed again, for the pairs' rows only."""
    ids = pairs.select(F.col("src").alias("set_id")).unionByName(pairs.select(F.col("dst").alias("set_id"))).distinct()
    chosen = described.groupBy("set_id").agg(F.min("doc_id").alias("doc_id")).join(ids, "set_id", "left_semi").select("doc_id").distinct()

    def collected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _text.slices(batch.column(0)):
                rows = piece.last - piece.first
                row, value = shingles(piece)
                n, name = _set_ids(row, value, rows)
                lists = pa.ListArray.from_arrays(pa.array(_text.starts(n), pa.int32()), pa.array(value.view(np.int64)))
                yield pa.RecordBatch.from_pydict({"set_id": pa.array(name), "members": lists})

    sets = join_checked(docs, chosen, "doc_id", "left_semi").select("text").mapInArrow(collected, "set_id bigint, members array<bigint>")
    left = sets.select(F.col("set_id").alias("src"), F.col("members").alias("a"))
    right = sets.select(F.col("set_id").alias("dst"), F.col("members").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    united = F.size("a") + F.size("b") - both
    return pairs.join(right, "dst").join(left, "src").where(DENOMINATOR * both >= NUMERATOR * united).select("src", "dst").distinct()


def _alike(a, b):
    """Whether sets of a and b shingles can be similar enough."""
    return (DENOMINATOR * a >= NUMERATOR * b) & (DENOMINATOR * b >= NUMERATOR * a)


def _early(n, rank, other, l):
    """Whether a shingle stands in the l-prefix that a set of n needs for an overlap with a set of `other` shingles."""
    overlap = F.ceil(NUMERATOR * (n + other) / _UNION)
    return rank <= n - overlap + l - 1


def _bucket(n):
    """Sizes within about a seventh of each other; larger sizes never have smaller buckets."""
    return F.floor(F.log(n.cast("double")) * 7)


def near_duplicates(documents: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: the smallest doc_id that a row is linked to over any way.

    Two rows are linked if 4 * |intersection| >= 3 * |union| of their sets of distinct 5-word shingles (A-Z lower-cased;
    fewer words make one shingle). Rows without words have no shingle and no link; a null text counts as empty. Rows
    that repeat a doc_id and text are linked like copies. A row with a null doc_id links nothing and has a null
    component. Extra columns are ignored; an empty table gives an empty table. Sets are named by 64 bits and shingles
    compared by 64 bits.
    """
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    described = cut(_described(docs))
    linking = described.where("doc_id is not null and n > 0")
    usable = docs.where("doc_id is not null")
    ordered = _postings(usable, _frequencies(usable)).repartition("token").sortWithinPartitions("token", "nr", "set_id")
    postings = cut(ordered.mapInArrow(_paired_or_posted(FEW), "token bigint, a bigint, b bigint, level tinyint, need tinyint"))
    met = postings.where("level = 0").select("token", F.col("a").alias("set_id"), F.expr(f"b div {_PLACES}").alias("n"), F.expr(f"b % {_PLACES}").alias("rank"))

    # pairs of rarely held shingles. What a pair shares of the others is known only later, so a pair of which both sets have
    # others stays with one shared shingle; any other pair must share enough in every prefix
    within = [F.count_if(F.col("level") <= l).alias(f"within{l}") for l in range(1, LONGEST + 1)]
    rare = cut(postings.where("level > 0").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.max("need").alias("need"), *within))
    enough = F.expr(" and ".join(f"within{l} >= least({l}, need)" for l in range(1, LONGEST + 1)))
    others = met.select("set_id").distinct()
    mixed = rare.where(~enough & (F.col("within1") > 0))
    for end in ("src", "dst"):
        mixed = mixed.join(others.withColumnRenamed("set_id", end), end, "left_semi")
    plausible = cut(rare.where(enough).unionByName(mixed.select(*rare.columns)).select("src", "dst", F.col(f"within{LONGEST}").alias("count")))

    # round 1: each set with the one neighbour that most of its shingles name
    held = met.groupBy("token").agg(F.count("*").alias("held"))
    shared = met.join(held, "token").groupBy("set_id").agg(F.sum("held").alias("shared"))
    hub = met.join(shared, "set_id").groupBy("token").agg(F.max(F.struct("shared", "set_id", "n", "rank")).alias("hub"))
    one = F.lit(1)
    named = met.join(hub, "token").where(F.col("set_id") != F.col("hub.set_id")).where(_alike(F.col("n"), F.col("hub.n")) & _early(F.col("n"), F.col("rank"), F.col("hub.n"), one) & _early(F.col("hub.n"), F.col("hub.rank"), F.col("n"), one))
    votes = named.groupBy("set_id", F.col("hub.set_id").alias("to")).count()
    for one_end, other in (("src", "dst"), ("dst", "src")):
        votes = votes.unionByName(plausible.select(F.col(one_end).alias("set_id"), F.col(other).alias("to"), "count"))
    best = votes.groupBy("set_id").agg(F.max(F.struct("count", "to")).alias("best"))
    tried = cut(best.select(F.least("set_id", "best.to").alias("src"), F.greatest("set_id", "best.to").alias("dst")).distinct())
    links = cut(_verified(tried, usable, linking))

    # round 2: all candidates between components
    near = connected_components(links)
    placed = met.join(near.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    between = placed.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held")).where("low < high").select("token", "held")
    placed = between_components = cut(placed.join(between, "token"))
    least = F.expr(f"({NUMERATOR} * n + {DENOMINATOR - 1}) div {DENOMINATOR}")
    # what the places that a partner of equal size allows promise in candidates, and what longer prefixes would add
    place = F.col("rank") - (F.col("n") - F.expr(f"(2 * {NUMERATOR} * n + {_UNION - 1}) div {_UNION}"))
    more = F.col("held") - 1
    cost = placed.groupBy("set_id").agg(F.sum(F.when(place <= 0, more).otherwise(0)).alias("cost"), F.sum(F.when((place > 0) & (place < LONGEST), more).otherwise(0)).alias("added"))
    length = F.lit(1)
    for bound in COSTS:
        length = length + ((F.col("cost") > bound) & (2 * F.col("added") <= F.col("cost"))).cast("int")
    placed = placed.join(cost, "set_id").withColumn("l", F.least(length, least).cast("int"))
    sizes = placed.groupBy("token", "component").agg(F.count("*").alias("size"))
    # lists of at most about CHUNK postings of one component, so that no pair within a component is ever made
    chunked = placed.join(sizes, ["token", "component"]).withColumn("chunk", F.pmod(F.xxhash64("set_id"), F.expr(f"(size + {CHUNK - 1}) div {CHUNK}")))
    # the longer set of a pair looks among the sizes that leave its shingle early enough
    chunked = chunked.withColumn("reach", F.floor((_UNION * (F.col("n") - F.col("rank") + F.col("l") - 1)) / NUMERATOR).cast("long") - F.col("n"))
    most = F.least("n", "reach")
    seeking = chunked.withColumn("most", most).where(F.col("most") >= least).withColumn("bucket", F.explode(F.sequence(_bucket(least), _bucket(F.col("most")))))
    member = F.struct("set_id", "n", "rank", "l")
    a = seeking.groupBy("token", "bucket", "component", "chunk").agg(F.collect_list(member).alias("ma"), F.max("most").alias("ra"), F.min("n").alias("na")).select("token", "bucket", F.col("component").alias("ca"), "ma", "ra", "na")
    b = chunked.withColumn("bucket", _bucket(F.col("n"))).groupBy("token", "bucket", "component", "chunk").agg(F.collect_list(member).alias("mb"), F.max("reach").alias("rb"), F.min("n").alias("nb")).select("token", "bucket", F.col("component").alias("cb"), "mb", "rb", "nb")

    def paired(x):
        def fits(y):
            l = F.least(x["l"], y["l"])
            longer = (x["n"] > y["n"]) | ((x["n"] == y["n"]) & (x["set_id"] < y["set_id"]))
            return longer & _alike(x["n"], y["n"]) & _early(x["n"], x["rank"], y["n"], l) & _early(y["n"], y["rank"], x["n"], l)

        return F.transform(F.filter("mb", fits), lambda y: F.struct(F.least(x["set_id"], y["set_id"]).alias("src"), F.greatest(x["set_id"], y["set_id"]).alias("dst"), F.least(x["l"], y["l"]).alias("l")))

    # lists meet only if the sizes that their members' places allow do
    met_pairs = a.join(b, ["token", "bucket"]).where("ca <> cb and ra >= nb and rb >= na").select(F.explode(F.flatten(F.transform("ma", paired))).alias("p")).select("p.*")
    common = met_pairs.groupBy("src", "dst", "l").count()
    rarely = F.coalesce(F.element_at(F.array(*(f"within{l}" for l in range(1, LONGEST + 1))), F.col("l")), F.lit(0))
    often = common.join(rare, ["src", "dst"], "left").where(F.col("count") + rarely >= F.col("l")).select("src", "dst")
    apart = plausible.select("src", "dst")
    for end in ("src", "dst"):
        apart = apart.join(near.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component")), end, "left")
    apart = apart.where("coalesce(src_component, src) <> coalesce(dst_component, dst)").select("src", "dst")
    candidates = often.unionByName(apart).distinct().join(tried, ["src", "dst"], "left_anti")
    candidates = cut(candidates)
    drop(postings, between_components, rare, plausible)
    more = cut(_verified(candidates, usable, linking), replaces=candidates)
    drop(tried)

    whole = connected_components(links.unionByName(more)).withColumnRenamed("node", "set_id")
    sets = linking.groupBy("set_id").agg(F.min("doc_id").alias("least")).join(whole, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = sets.groupBy("component").agg(F.min("least").alias("component_id"))
    placed_sets = sets.join(smallest, "component").select("set_id", "component_id")
    alone = described.where("doc_id is null or n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linking.join(placed_sets, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone)
