"""Each stage of the pipeline against a plain version of its decision."""

import corpus_pipeline
from fluvia.llm.jaccard_join import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_their_decisions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SF)
        assert after.columns == docs.columns, name
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "n-gram Jaccard join":
            groups = {r.doc_id: r.component_id for r in near_duplicates(before).collect()}
            assert ids == {i for i, c in groups.items() if i == c}
        before = spark.createDataFrame(after.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, before, SF).collect()
    assert {r.doc_id for r in last} == {r.doc_id for r in before.collect()} and all(r.round_trip for r in last)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_odd_rows_and_clashing_columns(spark):
    good = next(r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect() if r.text and len(r.text) > 1500 and len(set(r.text.split())) > 100)
    rows = [(1, good, "en", "a"), (1, good, "en", "a"), (2, good + " and one more word", "en", "b"), (None, good, None, "c"), (5, None, "en", "d"), (6, "", "en", "e"), (7, "12 34", "en", "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept string")
    known = corpus_pipeline.STAGES[0][1](spark, docs, SF)
    assert known.columns == docs.columns and sorted((r.doc_id for r in known.collect()), key=str) == [1, 1, 2, None]
    single = corpus_pipeline.STAGES[2][1](spark, known, SF).collect()
    assert sorted((r.doc_id for r in single), key=str) == [1, None]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert len(last) == 7 and all(r.round_trip and r.parity for r in last) and [r.n_pieces for r in last if r.doc_id in (5, 6)] == [0, 0]


def test_run_keeps_only_what_is_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_folder", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and out.columns == ["doc_id", "n_pieces", "ids", "round_trip", "parity"]
    (folder,) = tmp_path.glob("pipeline-*")
    assert [p.name for p in folder.iterdir()] == ["3"]


def test_two_texts_under_one_id(spark):
    same = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"other{i}" for i in range(80))
    rows = [(1, same, "en", "a"), (2, same, "en", "a"), (2, other, "en", "b"), (2, other, "en", "b"), (3, None, "en", "c"), (3, None, "en", "c"), (None, same, "en", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.without_near_duplicates(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(1, same), (2, other), (3, None), (None, same)], key=str)
