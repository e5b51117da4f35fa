"""A prefix trie of conversations by collapse of whole sequences.

Identical conversations become one weighted sequence with the list of those that end there. A sequence that is a proper
prefix of another is no leaf (an anti-join drops it); what each prefix holds is summed over the weighted sequences.

A prefix is named by its length and two 64-bit exclusive ors of hashes of (place, role, text). Exclusive ors, counts and
sums over a conversation are made in two steps: along chunks, which a range partitioning of all turns gives, and over the
chunks of the few conversations that span several; so no conversation must fit into one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fluvia.lineage import cut
from fluvia.llm._frames import join_checked, released

#: Characters of role and text by which turns of one number are spread over partitions.
RANGE_CHARS = 64
#: Ids that one piece of an end list holds.
PIECE_IDS = 50_000
#: Children from which a node meets them by a broadcast of such nodes; there are few of them.
MANY_CHILDREN = 1_000

_NODE = ["depth", "x", "y"]


def _along(rows: DataFrame, order: str, fold: Callable[[str], Column], **of: str) -> DataFrame:
    """Adds running sums (or exclusive ors, as `fold` says) over each conversation: new names from columns. Chunks rise
    along a conversation; within one, rows go by `order`."""
    inside = W.partitionBy("conv_id", "chunk").orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    earlier = W.partitionBy("conv_id").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = rows.groupBy("conv_id", "chunk").agg(*[fold(c).alias(f"__{n}") for n, c in of.items()])
    before = chunks.select("conv_id", "chunk", *[fold(f"__{n}").over(earlier).alias(f"__{n}") for n in of])
    # a boundary of the range partitioning splits one conversation at most: these are no more than its partitions
    carried = before.where(" and ".join(f"__{n} is not null" for n in of))
    ran = rows.withColumns({n: fold(c).over(inside) for n, c in of.items()})
    out = join_checked(ran, carried, ["conv_id", "chunk"], "left")
    both = {n: F.coalesce(F.col(f"__{n}"), F.lit(0)) for n in of}
    return out.withColumns({n: F.col(n).bitwiseXOR(b) if fold is F.bit_xor else F.col(n) + b for n, b in both.items()}).drop(*[f"__{n}" for n in of])


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, chunk, pos, a, b, words) of every turn: its place from 1, two hashes of (role, text), words of the text.

    Turns go by `turn`, null first, then role and text; null role and text are empty. A turn without conv_id belongs to no
    conversation and is left out. Texts are shuffled once and not kept.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    own = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    ranged = own.repartitionByRange("conv_id", F.asc_nulls_first("turn"), F.substring("role", 1, RANGE_CHARS), F.substring("text", 1, RANGE_CHARS))
    ordered = ranged.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text").withColumn("seq", F.monotonically_increasing_id())
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    kept = cut(ordered.select("conv_id", F.shiftright("seq", 33).alias("chunk"), "seq", F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(1), "role", "text").alias("b"), words.alias("words")))
    return _along(kept.withColumn("one", F.lit(1).cast("long")), "seq", F.sum, pos="one").drop("one", "seq")


def with_donor_openings(rows: DataFrame, family: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt with the opening of another: (rows, conv_ids), rows as `numbered` gives them.

    Conversation c begins with the first h turns of conversation c - c % family (all if it has fewer, none if it is absent)
    and goes on with its own turns after its first h, where h is the crc32 of c in decimal, modulo `most`. One without a
    turn left stays a conversation.
    """
    rows = cut(rows)
    convs = rows.groupBy("conv_id").agg(F.min("chunk").alias("chunk"))
    turn = F.struct("pos", "a", "b", "words")
    openings = rows.where((F.col("conv_id") % family == 0) & (F.col("pos") < most)).groupBy(F.col("conv_id").alias("donor")).agg(F.sort_array(F.collect_list(turn)).alias("opening"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int").alias("h")
    each = convs.select("conv_id", "chunk", h, (F.col("conv_id") - F.col("conv_id") % family).alias("donor")).join(openings, "donor", "left")
    each = cut(each.select("conv_id", "chunk", "h", F.expr("if(opening is null, array(), slice(opening, 1, h))").alias("lead")))
    borrowed = each.select("conv_id", "chunk", F.explode("lead").alias("t")).select("conv_id", "chunk", "t.pos", "t.a", "t.b", "t.words")
    # own turns keep their places unless the donor is shorter than h
    short = each.where("size(lead) < h").select("conv_id", (F.col("h") - F.size("lead")).cast("long").alias("missing"))
    own = join_checked(rows.withColumn("h", h).where("pos > h"), short, "conv_id", "left")
    own = own.select("conv_id", "chunk", (F.col("pos") - F.coalesce("missing", F.lit(0))).alias("pos"), "a", "b", "words")
    return own.unionByName(borrowed), each.select("conv_id")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (depth, x, y, conv_id) as rows of joined ids, in the same order."""
    key, ids, out = None, [], []
    names = [*_NODE, "first", "ids"]

    def given() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], names)

    def ended() -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
            ids.clear()

    for batch in batches:
        for *here, conv in zip(*(c.to_pylist() for c in batch.columns)):
            if here != key or len(ids) >= PIECE_IDS:
                ended()
                key = here
            ids.append(conv)
        if out:
            yield given()
    ended()
    yield given()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as the SHA-256 of their end list; only the state of the hash is held."""
    key, state, out = None, None, []
    with released():
        for batch in batches:
            for *here, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if here == key:
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = here, hashlib.sha256()
                state.update(ids.encode())
        if key:
            out.append((*key, state.hexdigest()))
    for k in range(0, len(out), 10_000):
        columns = list(zip(*out[k : k + 10_000]))
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*_NODE, "ends_sha256"])


def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per distinct prefix of the conversations `convs`, whose turns are `rows` (see `numbered`), the empty one
    included: conv_id (smallest member), depth, parent_conv_id, n_convs (members), n_children, n_leaves (childless nodes at
    or below), saved_tokens (at or below: members but one, times words of the last text), ends_sha256 (of the decimal ids of
    conversations that end there, ascending, joined by commas). No conversations, no rows: there is no root then.
    """
    salted = cut(rows.select("conv_id", "chunk", "pos", F.xxhash64(F.lit(1), "pos", "a", "b").alias("tx"), F.xxhash64(F.lit(2), "pos", "a", "b").alias("ty"), "words"))
    told = salted.groupBy("conv_id").agg(F.count("*").alias("depth"), F.bit_xor("tx").alias("x"), F.bit_xor("ty").alias("y"))
    whole = cut(convs.join(told, "conv_id", "left").na.fill(0, _NODE).select(*_NODE, "conv_id"))
    sequences = cut(whole.groupBy(*_NODE).agg(F.count("*").alias("weight"), F.min("conv_id").alias("conv_id")))
    by = [*_NODE, "conv_id"]
    pieces = whole.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_pieces, "depth bigint, x bigint, y bigint, first bigint, ids string")
    ends = pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "first").mapInArrow(_digests, "depth bigint, x bigint, y bigint, ends_sha256 string")

    # the prefixes of each sequence, along the conversation that stands for it
    path = _along(salted.join(sequences.select("conv_id", "weight", F.col("depth").alias("full")), "conv_id"), "pos", F.bit_xor, x="tx", y="ty")
    path = path.select("conv_id", "chunk", F.col("pos").alias("depth"), "x", "y", F.col("x").bitwiseXOR(F.col("tx")).alias("px"), F.col("y").bitwiseXOR(F.col("ty")).alias("py"), "words", "weight", "full")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = sequences.select("conv_id", F.lit(-1).cast("long").alias("chunk"), zero.alias("depth"), zero.alias("x"), zero.alias("y"), none.alias("px"), none.alias("py"), zero.alias("words"), "weight", F.col("depth").alias("full"))
    path = cut(path.unionByName(top))
    leaves = sequences.join(path.where("depth < full").select(*_NODE).distinct(), _NODE, "left_anti").select("conv_id", F.lit(1).cast("long").alias("leaf"))
    nodes = cut(path.groupBy(*_NODE).agg(F.sum("weight").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.max("px").alias("px"), F.max("py").alias("py")))

    # a node's value belongs to the path of its smallest member; of each path a node gets what lies at or below its depth
    saved = nodes.where("n_convs > 1 and words > 0").select("conv_id", "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("v"))
    summed = saved.groupBy("conv_id").agg(F.sum("v").alias("all"))
    valued = path.join(summed, "conv_id").join(saved, ["conv_id", "depth"], "left").na.fill(0, ["v"])
    gained = _along(valued, "depth", F.sum, upto="v").select(*_NODE, (F.col("all") - F.col("upto") + F.col("v")).alias("saved_tokens"))
    below = path.join(leaves, "conv_id").select(*_NODE, "leaf", zero.alias("saved_tokens")).unionByName(gained.select(*_NODE, zero.alias("leaf"), "saved_tokens"))
    below = below.groupBy(*_NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))

    above = [F.col("depth") - 1, F.col("px"), F.col("py")]
    children = nodes.where("depth > 0").groupBy(*[c.alias(n) for c, n in zip(above, _NODE)]).agg(F.count("*").alias("n_children"))
    parents = cut(nodes.join(children, _NODE))
    named = lambda df, name: df.select((F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias(name))
    up = ["depth", "px", "py"]
    found = join_checked(nodes, named(parents.where(F.col("n_children") >= MANY_CHILDREN), "many"), up, "left")
    # those that have found their parent spread over the second join by their own hashes
    open_ = F.col("many").isNull() & F.col("px").isNotNull()
    found = found.withColumns({"px": F.when(open_, F.col("px")).otherwise(F.col("x")), "py": F.when(open_, F.col("py")).otherwise(F.col("y"))})
    found = found.join(named(parents.where(F.col("n_children") < MANY_CHILDREN), "few"), up, "left")
    out = found.join(below, _NODE).join(children, _NODE, "left").join(ends, _NODE, "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("many", "few")).alias("parent_conv_id"), "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations as they stand in (conv_id, turn, role, text)."""
    rows = cut(numbered(turns))
    return prefix_trie(rows, rows.select("conv_id").distinct())
