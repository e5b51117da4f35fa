"""The divergence audit against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from fluvia.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n int"


def plain(rows, least, top=50):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        key = lang or "", source or ""
        groups.add(key)
        counts[key].update(words)
        docs[key[0]].update(set(words))
    kept = {lang: [t for t, k in seen.items() if k >= least] for lang, seen in docs.items()}

    def shares(count, terms):
        total = sum(count[t] for t in terms)
        return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(terms)) for t in terms}

    p = {g: shares(counts[g], kept.get(g[0], [])) for g in groups}
    out = set()
    for lang, source in groups:
        terms = kept.get(lang, [])
        whole = shares(sum((counts[g] for g in groups if g[0] == lang), Counter()), terms)
        own = p[lang, source]
        pairs = [(-sum(abs(own[t] - p[lang, s][t]) for t in terms), s.encode()) for x, s in groups if x == lang and s != source]
        more = [(whole[t] - own[t], t.encode()) for t in terms if counts[lang, source][t] and own[t] > whole[t]]
        for part, found in (("pair", sorted(pairs)), ("term", sorted(more)[:top])):
            out |= {(lang, source, part, item.decode(), -value, k + 1) for k, (value, item) in enumerate(found)}
    return out


def audited(spark, rows, **more):
    df = spark.createDataFrame([(k, *r, 1) for k, r in enumerate(rows)], SCHEMA).repartition(3)
    got = divergence.audit(df, **more).collect()
    assert len(got) == len(set(map(tuple, got)))
    return {tuple(r) for r in got}


def some_rows(n, sources, seed=3):
    rng = np.random.default_rng(seed)
    words = np.array([f"{a}{b}" for a in ["tal", "Öl", "ver", "so", "NA", "été"] for b in ["x", "y", "é", "ing", "z", "q", ""]])
    rows = []
    for _ in range(n):
        k = int(rng.zipf(1.6)) % sources
        rows.append((" ".join(rng.choice(words, int(rng.integers(0, 60)))) + (", Only-here" * k), ["en", "de", None][int(rng.integers(0, 3))], f"s{k}" if k else None))
    return rows


def test_equal_to_plain_counting(spark):
    rows = some_rows(300, 9) + [("", "xx", "a"), (None, "xx", "b"), ("solo words", "yy", "a"), (None, None, None)]
    assert audited(spark, rows, least_documents=5) == plain(rows, 5)


def test_tiles_chunks_slices_and_flushes(spark, monkeypatch):
    for name, value in {"TILE_SOURCES": 3, "CHUNK_WORDS": 1}.items():
        monkeypatch.setattr(divergence, name, value)
    rng = np.random.default_rng(1)
    words = [f"w{'abcdefghij'[a]}{'abcdefghij'[b]}{'xyz'[c]}" for a in range(10) for b in range(10) for c in range(3)]
    rows = [(" ".join(rng.choice(words, 200)), "en", f"s{k % 11}") for k in range(120)]
    assert audited(spark, rows, least_documents=3, top=7) == plain(rows, 3, 7)


def test_slices_join_to_the_words(monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 7)
    raw = "One two-three éèà, averyveryverylongword x".encode()
    assert [w for part in divergence._words(raw) for w in part] == raw.translate(divergence._LETTERS).split()


def test_empty_table_and_single_source(spark):
    assert audited(spark, []) == set()
    assert audited(spark, [("a b", "en", "s")] * 40) == plain([("a b", "en", "s")] * 40, 30)


def test_large_counts_are_exact(spark):
    df = spark.createDataFrame([(9_000_000_000_000, 10_000_000_000_001, 70)], "n long, group_n long, n_terms long")
    n, total, terms = 9_000_000_000_000, 10_000_000_000_001, 70
    assert df.selectExpr(divergence._share("n", "group_n", "n_terms") + " AS p").first().p == 1 + 10**9 * (n + 5) // (total + 5 * terms)


@pytest.mark.parametrize("name", ["op13_source_divergence_audit"])
def test_query_against_sql(spark, sf, name):
    import duckdb

    from fluvia.llm import registry

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    rel = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, sf)
    want = {tuple(r) for r in rel.select(*got.columns).fetchall()}
    assert {tuple(r) for r in got.collect()} == want and want
