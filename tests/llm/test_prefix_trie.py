"""The prefix trie against plain tries of whole lists."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

from fluvia.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string, pos int"


def plain_rebuilt(rows, family=20, most=4):
    talks = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        if conv is not None:
            talks[conv].append((turn is not None, turn or 0, role or "", text or ""))
    talks = {c: [t[2:] for t in sorted(x)] for c, x in talks.items()}
    if not most:
        return talks
    out = {}
    for c, own in talks.items():
        h = zlib.crc32(str(c).encode()) % most
        out[c] = talks.get(c - int(c - family * int(c / family)), [])[:h] + own[h:]
    return out


def plain_trie(talks):
    members = defaultdict(list)
    for c, turns in talks.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = set()
    for node, convs in members.items():
        d = len(node)
        below = [k for k in members if k[:d] == node]
        grown = {k[:-1] for k in members if k}
        saved = sum((len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) for k in below if k)
        ends = ",".join(str(c) for c in sorted(convs) if len(talks[c]) == d)
        out.add((min(convs), d, min(members[node[:-1]]) if d else None, len(convs), sum(k[:-1] == node for k in members if k), sum(k not in grown for k in below), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


def got(df):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def some_rows(seed, convs, most_turns=5):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for k in range(rng.randrange(1, most_turns)):
            rows.append((c, rng.choice([k, k, k, None, 1]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "a b  c", "", None, "tab\tx\x0by", "é ü"]), 9))
    return rows


def test_rebuilt_trie_equals_plain(spark):
    for seed, convs in ((1, range(-45, 60)), (2, [3, 7, 24, 41, 1000000])):
        rows = some_rows(seed, convs) + [(None, 0, "user", "nobody", 1)]
        rebuilt = plain_rebuilt(rows)
        assert got(trie.prefix_trie(*trie.with_donor_openings(trie.numbered(frame(spark, rows)), 20, 4))) == plain_trie(rebuilt)


def test_turnless_conversations_are_roots(spark):
    conv = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(conv, 0, "user", "a", 1), (conv, 1, "user", "b", 1)]
    made = got(trie.prefix_trie(*trie.with_donor_openings(trie.numbered(frame(spark, rows)), 20, 4)))
    assert made == {(conv, 0, None, 1, 0, 1, 0, hashlib.sha256(str(conv).encode()).hexdigest())}


def test_long_conversations_span_chunks(spark):
    rows = [(5, k // 3, "user", f"t {k % 7}", 1) for k in range(400)] + [(6, k // 3, "user", f"t {k % 7}", 1) for k in range(300)] + [(5, 1000, "user", "same", 1)] * 3
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        assert trie.numbered(frame(spark, rows, 8)).where("conv_id = 5").select("chunk").distinct().count() > 1
        assert got(trie.conversation_trie(frame(spark, rows, 8))) == plain_trie(plain_rebuilt(rows, most=0))
    finally:
        spark.conf.unset(key)


def test_many_copies_and_pieces_of_end_lists(spark, monkeypatch):
    monkeypatch.setattr(trie, "MANY_CHILDREN", 3)
    rows = [(c, 0, "user", "hello", 1) for c in range(150)] + [(c, 1, "assistant", f"n{c % 12}", 1) for c in range(0, 150, 2)]
    assert got(trie.conversation_trie(frame(spark, rows))) == plain_trie(plain_rebuilt(rows, most=0))


def test_pieces_of_end_lists(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(trie, "PIECE_IDS", 3)
    keys = [(1, 2, 3, c) for c in range(8)] + [(2, 0, 0, 4)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*part)], ["depth", "x", "y", "conv_id"]) for part in (keys[:2], keys[2:])]
    pieces = list(trie._pieces(iter(batches)))
    assert sum(p.num_rows for p in pieces) == 4
    found = {(r["depth"], r["ends_sha256"]) for b in trie._digests(iter(pieces)) for r in b.to_pylist()}
    assert found == {(1, hashlib.sha256(b"0,1,2,3,4,5,6,7").hexdigest()), (2, hashlib.sha256(b"4").hexdigest())}


def test_empty_table(spark):
    assert got(trie.conversation_trie(frame(spark, []))) == set()


def test_query_against_sql(spark, sf):
    import duckdb

    from fluvia.llm import registry

    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{sf}/conversations.parquet'")
    made = registry.op11_conversation_prefix_trie(spark, sf)
    want = {tuple(r) for r in con.sql(registry.oracle_sql()["op11_conversation_prefix_trie"]).select(*made.columns).fetchall()}
    assert got(made) == want and want
