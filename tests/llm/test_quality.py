"""Quality classifier (held-out accuracy) and quality rules (brute force)."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fluvia.llm import quality_classifier, quality_rules
from fluvia.llm._frames import learning_row, summed_vector

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def test_base_rules_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(200).collect()]
    rows += [(-1, None), (-2, ""), (-3, "a\nb\na\n\n \n a"), (-4, "x y z " * 40), (-5, "é ü\tñ\x0b漢字 <|>"), (-6, "w" * 100_000), (-7, "same\x1fword here\n" * 3)]
    out = quality_rules.apply_rules(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([], "doc_id long"))
    for r in out.collect():
        want = base(dict(rows)[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.llr == 0.0 and r.kept == (not r.base_failed)


def test_log_ratios_by_hand(spark):
    rows = [("abcdabcd", True), ("zzzz", False), (None, True), ("", None), ("abcdabcd", False)]
    df = spark.createDataFrame(rows, "t string, m boolean").repartition(3)
    got = quality_rules.log_ratios(df, df.where("m"), "t")

    def bucket(gram):
        return ((int.from_bytes(gram.encode(), "big") * 0x9E3779B97F4A7C15) % (1 << 64)) >> (64 - 17)

    target, raw = Counter(), Counter()
    for t, m in rows:
        grams = [bucket((t or "")[i : i + 4]) for i in range(len(t or "") - 3)]
        raw.update(grams)
        target.update(grams if m else [])
    n, k = quality_rules.BUCKETS, quality_rules.SMOOTHING
    prior = k * n * sum(target.values()) / sum(raw.values())
    for g in (*raw, 0):
        share = (raw[g] + k) / (sum(raw.values()) + k * n)
        assert got[g] == pytest.approx(np.log((target[g] + prior * share) / (sum(target.values()) + prior)) - np.log(share), abs=1e-9)
    total = summed_vector(df, ["t"], quality_rules._counts, quality_rules.BUCKETS)
    assert total.sum() == 11 and quality_rules.log_ratios(df, df.where("false"), "t").sum() == 0


def test_verdicts_are_mean_ratios(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(150)
    docs = spark.createDataFrame(docs.collect(), docs.schema)
    good = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    ratios = quality_rules.log_ratios(docs, docs.join(good, "doc_id", "left_semi"), "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    clashing = docs.withColumns({"kept": F.lit("old"), "llr": F.lit("old")})
    for r in quality_rules.apply_rules(clashing, good).collect():
        raw = texts[r.doc_id].encode()
        grams = [((int.from_bytes(raw[i : i + 4], "big") * 0x9E3779B97F4A7C15) % (1 << 64)) >> 47 for i in range(len(raw) - 3)]
        want = float(np.mean(ratios[grams])) if grams else 0.0
        assert r.llr == pytest.approx(want, abs=1e-5)
        assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)


def test_rules_on_empty_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, n_words string")
    assert quality_rules.apply_rules(empty, spark.createDataFrame([(1,)], "doc_id long")).count() == 0
    twice = spark.createDataFrame([(1, "same words " * 40), (1, "same words " * 40), (None, "x")], "doc_id long, text string")
    out = quality_rules.apply_rules(twice, spark.createDataFrame([(1,), (1,), (None,)], "doc_id long")).collect()
    assert len(out) == 3 and len({(r.llr, r.kept) for r in out if r.doc_id == 1}) == 1


def test_joins_beyond_the_limit_are_shuffled(spark):
    from fluvia.llm._frames import join_checked

    left, right = spark.range(100).withColumnRenamed("id", "k"), spark.createDataFrame([("a" * 50, i) for i in range(40)], "s string, k long")
    few, many = join_checked(left, right, "k", "inner"), join_checked(left, right, "k", "inner", limit=4_000)
    for out, wanted in ((few, True), (many, False)):
        assert out.count() == 40
        assert ("ResolvedHint" in out._jdf.queryExecution().analyzed().toString()) == wanted


def test_rules_reject_junk_and_keep_good(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = labels.where("quality = 1").select("doc_id")
    judged = quality_rules.apply_rules(docs, good).join(labels, "doc_id")
    share = {r.quality: r.k for r in judged.groupBy("quality").agg(F.avg((F.col("kept") | F.col("base_failed") & (F.col("quality") == 1)).cast("double")).alias("k")).collect()}
    assert share[1] == 1.0 and share[0] < 0.05


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").withColumn("held", learning_row("doc_id", 3) == 1)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    train = docs.where("not held").join(labels, "doc_id").select(F.col("doc_id").alias("id"), "text", "label")
    model = quality_classifier.fit(train)
    scored = quality_classifier.score_quality(docs, model).join(labels, "doc_id").where("held")
    assert scored.agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("a")).first().a > 0.97
    odd = quality_classifier.score_quality(spark.createDataFrame([(1, None, 0.0), (2, "", 0.0), (3, "x" * 200_000, 0.0)], "doc_id long, text string, score double"), model).collect()
    assert len(odd) == 3 and all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score


def test_dual_descent_separates():
    rows = [np.array([0, 2]), np.array([0, 3]), np.array([1, 2]), np.array([1, 3])]
    weights = quality_classifier.dual_descent(rows, np.array([1, 1, 0, 0]), np.array([1.0, -1.0, 0.1, 0.1]))
    margins = [sum(np.array([1.0, -1.0, 0.1, 0.1])[x] * weights[x]) + weights[-1] for x in rows]
    assert margins[0] > 0 < margins[1] and margins[2] < 0 > margins[3]


def test_without_labels(spark):
    model = quality_classifier.fit(spark.createDataFrame([], "id long, text string, label int"))
    out = quality_classifier.score_quality(spark.createDataFrame([(1, "some text")], "doc_id long, text string"), model).first()
    assert out.score == pytest.approx(0.5)


def test_many_copies_of_two_rows_are_learned(spark):
    two = spark.createDataFrame([(1, "plain words of good prose in a row", 1), (2, "BUY NOW $$$ click click click", 0)], "id long, text string, label int")
    copies = two.crossJoin(spark.range(100_000).select())
    model = quality_classifier.fit(copies)
    got = {r.id: r.score for r in quality_classifier.score_quality(two, model).collect()}
    assert got[1] > 0.6 and got[2] < 0.4


def test_labels_that_contradict_each_other(spark):
    same = [(k, "one and the same text", k % 2) for k in range(40)]
    model = quality_classifier.fit(spark.createDataFrame(same, "id long, text string, label int"))
    got = quality_classifier.score_quality(spark.createDataFrame(same, "id long, text string, label int"), model).collect()
    assert len({r.score for r in got}) == 1 and 0.3 < got[0].score < 0.7
