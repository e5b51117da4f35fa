"""Decontamination against brute force, and its defined edge cases."""

import re

import numpy as np
from pyspark.sql import functions as F

from fluvia.llm import decontaminate
from fluvia.llm.decontaminate import find_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window=13):
    windows = []
    for item, text in items:
        w = WORD.findall(lowered(text))
        n = min(window, len(w))
        windows += [(str(item), tuple(w[i : i + n])) for i in range(len(w) - n + 1)] if n else []
    out = {}
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if tuple(w[i : i + len(x)]) == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item)
        out[doc] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def found(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id string, text string")
    return {r.doc_id: (r.n_words, r.n_hit, list(r.item_ids), r.contaminated) for r in find_contamination(d, b).collect()}


def test_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [("short", "The"), ("two", "of the"), ("none", "!!"), ("null", None)]
    long = " ".join([f"w{i}" for i in range(3000)] + [items[0][1].upper()] * 2 + ["ende"] * 700)
    docs += [(1001, items[1][1] + " " + items[1][1]), (1002, None), (1003, ""), (1004, "été " * 20), (1005, long), (1006, items[2][1].replace(" ", "--"))]
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [("a", "x y")]) == {}
    assert found(spark, [(1, "x y"), (1, "x y")], []) == {1: (2, 0, [], False)}


def test_several_passes_find_the_same(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(40).collect()]
    items = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs += [(1001, items[1][1] + " and then " + items[0][1]), (1002, items[2][1])]
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 1 + sum(len(t) + 20 for _, t in items) // 3)
    assert found(spark, docs, items) == brute(docs, items)


def test_compiled_items_are_a_few_times_their_text():
    texts = [" ".join(f"w{(i * 7919 + k) % 5000}" for k in range(400)) for i in range(500)]
    size = sum(map(len, texts))
    compiled = decontaminate.compile_items(texts)
    assert sum(x.nbytes for p in compiled for x in p[1:]) < 10 * size
    assert all((np.diff(p.first) > 0).all() and p.first[-1] == len(p.owner) for p in compiled)


def test_clashing_columns_are_replaced(spark):
    d = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string").withColumns({"n_hit": F.lit("old"), "contaminated": F.lit("old")})
    b = spark.createDataFrame([("x", "b c", 1), (None, "b c", 2), ("x", "b c", 3)], "item_id string, text string, n_words int")
    row = find_contamination(d, b).first()
    assert (row.n_hit, row.n_items, list(row.item_ids), row.contaminated) == (2, 2, ["", "x"], True)


def test_repeated_and_long_items(spark, sf, monkeypatch):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(12).collect()]
    long = " ".join(f"w{i * 7919 % 997}{'x' * (i % 3)}" for i in range(2_500))
    words = long.split()
    docs += [(2000 + k, "at " + " ".join(words[k * 120 : k * 120 + 11 + k]) + " end") for k in range(20)] + [(3000, " ".join(words[990:1010])), (3001, docs[0][1])]
    items = [("copy", docs[3][1])] * 20_000 + [("long", long), ("few", "w1 " * 12), ("huge", "y" * 15_000)] + [(f"i{k}", docs[k][1]) for k in range(3)]
    want = brute(docs, sorted(set(items)))
    monkeypatch.setattr(decontaminate, "_LONG", 5_000)
    monkeypatch.setattr(decontaminate, "PART_WORDS", 500)
    assert found(spark, docs, items) == want and len(want[3000][2]) == 1
    seen, size = [], 9_000
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", size)
    monkeypatch.setattr(decontaminate, "compile_items", lambda texts, window, keep=decontaminate.compile_items: seen.append(sum(map(len, texts))) or keep(texts, window))
    assert found(spark, docs, items) == want
    assert len(seen) > 2 and sorted(seen)[-2] <= size  # one block is a word of 15,000 letters


def test_frequent_pairs_of_words(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["a", "b"], 60)) for _ in range(40)]
    docs, items = list(enumerate(texts)), [(f"i{k}", " ".join(rng.choice(["a", "b"], 200))) for k in range(40)]
    assert found(spark, docs, items) == brute(docs, items)
