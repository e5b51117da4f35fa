"""Suffix automata and cross-parsing by brute force; held-out accuracy; edge cases."""

import random

import numpy as np
from pyspark.sql import functions as F

from fluvia.llm import language_id as lid
from fluvia.llm._frames import learning_row


def test_phrases_are_longest_matches():
    rng = random.Random(1)
    code = np.full(256, 3, np.int64)
    code[[97, 98, 99]] = [0, 1, 2]
    for _ in range(60):
        known = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(6)]
        parts = {w[i:j] for w in known for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
        machine = lid.suffix_automaton([w.encode() for w in known], code)
        words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(0, 14))) for _ in range(20)]
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        end = np.cumsum([len(w) for w in words])
        got = lid.phrases(code[raw], end - [len(w) for w in words], end, machine)
        for w, n in zip(words, got):
            at = want = 0
            while at < len(w):
                step = next((k for k in range(len(w) - at, 0, -1) if w[at : at + k] in parts), 1)
                at, want = at + step, want + 1
            assert n == want, (known, w)


def test_held_out_accuracy_and_edges(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").withColumn("held", learning_row("doc_id", 5) == 0)
    model = lid.fit(docs.where("not held"), "text", "lang", "doc_id")
    out = lid.identify(docs, model).where("held")
    assert out.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("double")).alias("a")).first().a > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 456 --"), (4, "Und der die das"), (5, "ñ" * 50_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    assert got[4][0] == "de" and got[5][0] in model.languages and 0 <= got[5][1] <= 1


def test_nothing_learned(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    model = lid.fit(empty, "text", "lang", "doc_id")
    assert lid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), model).first().lang_pred == "und"


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(5)
    rows = [(i, f"gemeinsam wort und noch {chr(97 + i % 26)}x{i % 7}", "aa") for i in range(350)]
    rows += [(1000 + i, f"gemeinsam wort lille ord nummer{i}", "bb") for i in range(60)]  # shares its commonest words
    rows += [(2000, "unico documento etiquetado", "cc")]
    signs = [chr(0x4E00 + i) for i in range(40)]
    rows += [(3000 + i, "".join(rng.choice(signs) for _ in range(200)), "zh") for i in range(30)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    assert set(model.languages) == {"aa", "bb", "cc", "zh"}
    asked = [(1, "unico documento", "cc"), (2, "".join(rng.choice(signs) for _ in range(50)), "zh"), (3, "gemeinsam wort lille", "bb"), (4, "gemeinsam und noch", "aa")]
    got = {r.doc_id: r.lang_pred for r in lid.identify(spark.createDataFrame(asked, "doc_id long, text string, lang string"), model).collect()}
    assert got == {1: "cc", 2: "zh", 3: "bb", 4: "aa"}


def read_by_hand(text):
    out, blank = bytearray(), True
    for b in (text or "").encode():
        b = b + 32 if 65 <= b <= 90 else b
        if 97 <= b <= 122 or b >= 128:
            out.append(b)
            blank = False
        elif not blank:
            out.append(32)
            blank = True
    return bytes(out)


def judged_by_hand(text, samples):
    """The language, by the definition: longest parts of learned texts, stretch by stretch."""
    said = read_by_hand(text)
    sums = dict.fromkeys(samples, 0.0)
    for a in range(0, len(said), lid.STRETCH):
        part = said[a : a + lid.STRETCH]
        needed = {}
        for lang, texts in samples.items():
            at = n = 0
            while at < len(part):
                step = next((k for k in range(len(part) - at, 0, -1) if any(part[at : at + k] in t for t in texts)), 1)
                at, n = at + step, n + 1
            needed[lang] = n * np.log2(2 + sum(map(len, texts)))
        for lang, n in needed.items():
            sums[lang] += min(n / min(needed.values()), lid.CAP) * len(part) / len(said)
    return sums


def test_whole_documents_by_hand(spark):
    rng = random.Random(3)
    signs = [chr(0x4E00 + i) for i in range(30)]
    learned = {"en": ["the quick brown fox and the lazy dog", "over the hills and far away"], "de": ["der schnelle braune fuchs", "über die hügel und weit weg"], "zh": ["".join(rng.choice(signs) for _ in range(300))]}
    rows = [(i * 10 + k, t, lang) for i, (lang, texts) in enumerate(learned.items()) for k, t in enumerate(texts)]
    model = lid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang", "doc_id")
    samples = {k: [read_by_hand(t) for t in v] for k, v in learned.items()}
    words = "the quick fox der fuchs über hills away weg und and DOG 12 -- é".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 120))) for _ in range(25)] + ["".join(rng.choice(signs) for _ in range(n)) for n in (1, 5, 90, 200)] + ["  The!", "ñ" * 300]
    got = lid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()
    for r in got:
        if r.lang_pred == "und":
            assert not any(c.isalpha() for c in texts[r.doc_id])
            continue
        sums = judged_by_hand(texts[r.doc_id], samples)
        best, second = sorted(sums.values())[:2]
        assert sums[r.lang_pred] < best + 1e-8, texts[r.doc_id]
        assert abs(r.score - (1 - best / second)) < 1e-5


def test_clashing_columns_repeats_and_long_texts(spark):
    rows = [(i, f"wort nummer {chr(97 + i % 26)} und mehr " * 200, "aa", 1) for i in range(5)] + [(9, "other words here", "bb", 1)] * 3 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int").withColumn("lang_pred", F.lit("old"))
    model = lid.fit(df, "text", "lang", "doc_id")  # every row of aa is a long one: a part of each is learned
    out = lid.identify(df, model)
    assert out.columns == ["doc_id", "text", "lang", "score", "lang_pred"]
    assert sorted((r.lang_pred for r in out.collect()), key=str) == ["aa"] * 5 + ["bb"] * 3 + ["und"]


def test_automata_of_many_languages_are_refused(monkeypatch):
    import pytest

    monkeypatch.setattr(lid, "MODEL_BYTES", 100)
    with pytest.raises(ValueError):
        lid._learned({"aa": [b"some text"], "bb": [b"other text"]}, {})


def test_many_copies_of_few_rows_are_learned(spark):
    said = {lang: [f"{a} {b} {c} {a}{b}" for a, b, c in (parts[:3], parts[3:])] for lang, parts in {f"l{k}": [f"{chr(97 + k * 4 + j)}{chr(98 + k * 4 + j)}" * 2 for j in range(6)] for k in range(4)}.items()}
    rows = spark.createDataFrame([(i, t, lang) for lang, texts in said.items() for i, t in enumerate(texts)], "doc_id long, text string, lang string").crossJoin(spark.range(5000).select())
    model = lid.fit(rows.select("doc_id", "text", "lang"), "text", "lang", "doc_id")
    assert sorted(model.languages) == sorted(said)
    asked = spark.createDataFrame([(i, t, lang) for lang, texts in said.items() for i, t in enumerate(texts)], "doc_id long, text string, want string")
    assert all(r.lang_pred == r.want for r in lid.identify(asked, model).collect())
