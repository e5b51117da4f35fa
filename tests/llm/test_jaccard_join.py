"""Near duplicates against all pairs, by brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fluvia.llm import jaccard_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    part = {i: i for i, _ in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 4 * (n := len(a & b)) >= 3 * (len(a) + len(b) - n):
                x, y = sorted((root(i), root(j)))
                part[y] = x
    return sorted((i, len(s), root(i)) for i, s in sets)


def joined(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    return sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect())


def test_against_all_pairs(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    rng = random.Random(5)
    base = "the quick brown fox jumps over a lazy dog while seven wizards box with very glum people on quiet hills near town".split()
    for k in range(80):  # chains: each near the one before, the ends far apart
        i = rng.randrange(len(base))
        base = base[:i] + [f"w{k}"] + base[i + rng.randrange(2) :]
        rows.append((5000 + k, " ".join(base)))
    passage = " ".join(f"p{i}" for i in range(60))
    rows += [(6000 + k, passage + " " + " ".join(f"u{k}_{i}" for i in range(rng.randrange(5, 60)))) for k in range(60)]
    rows += [(7000, None), (7001, ""), (7002, " \n"), (7003, "One two"), (7004, "one  TWO"), (7005, "one two three"), (7006, "x " * 5000), (7007, "x " * 9)]
    assert joined(spark, rows) == brute(rows)


def test_edges(spark):
    assert joined(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.near_duplicates(df).collect()), key=str)
    assert out == [(1, 2, 1), (1, 2, 1), (None, 2, None)]


def edited(rng, n, pool):
    """Texts from a pool of shared words: groups of copies with few or many edits, some with a passage in common."""
    passage = [f"p{i}" for i in range(12)]
    out = []
    while len(out) < n:
        base = [rng.choice(pool) for _ in range(rng.randrange(6, 60))] + passage * rng.randrange(2)
        for _ in range(rng.choice([1, 2, 3, 12])):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = rng.choice(pool)
            out.append(" ".join(words))
    return list(enumerate(out))


@pytest.mark.parametrize("few, costs", [(1, (32, 128, 512)), (2, (0, 1, 2)), (4, (0, 0, 0)), (1000, (32, 128, 512))])
def test_rarely_and_often_held_shingles(spark, monkeypatch, few, costs):
    monkeypatch.setattr(jaccard_join, "FEW", few)
    monkeypatch.setattr(jaccard_join, "COSTS", costs)
    rows = edited(random.Random(few), 400, [f"w{i}" for i in range(60)])
    assert joined(spark, rows) == brute(rows)


@pytest.mark.parametrize("at_once", [1, 2, 3, 7, 1000])
def test_pairs_do_not_depend_on_batches(at_once):
    rng, few = random.Random(3), 3
    sizes = {s: rng.choice([8, 9, 10, 14, 20]) for s in range(40)}
    once = sorted((t, sizes[s] * jaccard_join._PLACES + rng.randrange(6), s) for t in range(60) for s in rng.sample(range(40), rng.choice([1, 2, 3, 4, 9])))
    rows = [r for r in once for _ in range(rng.choice([1, 1, 3]))]
    batches = [pa.RecordBatch.from_pydict({"token": pa.array([r[0] for r in part], pa.int64()), "set_id": pa.array([r[2] for r in part], pa.int64()), "nr": pa.array([r[1] for r in part], pa.int64())}) for i in range(0, len(rows), at_once) if (part := rows[i : i + at_once])]
    got = [tuple(r.values()) for b in jaccard_join._paired_or_posted(few)(iter(batches)) for r in b.to_pylist()]

    holders, want = defaultdict(list), []
    for t, nr, s in once:
        holders[t].append((s, nr, *divmod(nr, jaccard_join._PLACES)))
    for t, sets in holders.items():
        if len(sets) > few:
            want += [(t, s, nr, 0, 0) for s, nr, _, _ in sets]
            continue
        for i, (y, _, m, k) in enumerate(sets):
            for x, _, n, r in sets[:i]:
                overlap = -(-3 * (n + m) // 7)
                level = next((l for l in range(1, jaccard_join.LONGEST + 1) if r < n - overlap + l and k < m - overlap + l), None)
                if level and 4 * min(n, m) >= 3 * max(n, m):
                    want.append((None, min(x, y), max(x, y), level, min(overlap, jaccard_join.LONGEST)))
    assert sorted(got, key=str) == sorted(want, key=str) and any(r[0] is None for r in got) and any(r[0] is not None for r in got)


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(spark._jvm.double, 0), spark._jvm.java.util.ArrayList())
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_shingles_met_by_chance_are_shuffled_once(spark):
    """Texts of common sentences share shingles here and there: their postings go through one shuffle, not through a dozen (14.4 MB then, 3.8 MB now)."""
    rng = random.Random(8)
    sentences = [" ".join(f"s{i}_{j}" for j in range(30)) for i in range(6_000)]
    df = spark.createDataFrame([(i, " ".join(rng.choice(sentences) for _ in range(8))) for i in range(2000)], "doc_id long, text string")
    before, key = set(shuffled(spark)), "spark.sql.autoBroadcastJoinThreshold"
    kept = spark.conf.get(key)
    spark.conf.set(key, "-1")  # as with tables too large to broadcast
    try:
        assert jaccard_join.near_duplicates(df).where("component_id <> doc_id").count() == 0
    finally:
        spark.conf.set(key, kept)
    written = [n for stage, n in shuffled(spark).items() if stage not in before]
    assert sum(written) < 6_000_000
