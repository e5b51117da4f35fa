"""The corpus pipeline: each stage works on what the stage before it kept.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
`run` writes each stage's rows as Parquet in the folder that the cluster shares, and reads them back for the next.

A null text counts as empty: it has no language and goes in the first stage. A null doc_id is kept by every decision on
ids: such a row is never a duplicate and never learned as another row's twin. Rows that repeat a doc_id and text stay
once; of two texts under one doc_id each is decided on alone. Of equal or near equal documents the smallest doc_id stays. Columns beside doc_id, text and lang are carried
through, whatever their names; an empty table gives an empty table of the same columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.lineage import delete, shared_folder
from fluvia.llm import language_id, sentencepiece_codec
from fluvia.llm._frames import join_checked, learning_row, small_batches
from fluvia.llm.decontaminate import find_contamination
from fluvia.llm.jaccard_join import near_duplicates
from fluvia.llm.quality_rules import apply_rules
from fluvia.llm.registry import trusted


def _packed(docs: DataFrame) -> DataFrame:
    """The columns that stages read beside the whole row, so that no column of documents clashes with a stage's own."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), "doc_id", "text", "lang")


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter (or without text) have no language and go."""
    small_batches(spark)
    model = language_id.fit(docs.where(learning_row("doc_id", 5) != 0), "text", "lang", "doc_id")
    judged = language_id.identify(_packed(docs), model)
    return judged.where(F.col("lang_pred") != language_id.UNDETERMINED).select("__row.*")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or read unlike trusted text, go."""
    small_batches(spark)
    return apply_rules(_packed(docs), trusted(spark, sf_dir)).where("kept").select("__row.*")


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays, once; a null doc_id stays."""
    small_batches(spark)
    key = F.when(F.col("doc_id").isNotNull(), F.struct(F.col("doc_id").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text")))
    rows = docs.withColumn("__key", key)
    groups = near_duplicates(rows, doc_id="__key")
    gone = groups.where("doc_id is not null and doc_id <> component_id").select(F.col("doc_id").alias("__key")).distinct()
    left = join_checked(rows, gone, "__key", "left_anti")
    # rows that repeat a doc_id and text stay once
    twice = left.groupBy("__key").count().where("count > 1 and __key is not null").select("__key")
    rest = join_checked(left, twice, "__key", "left_anti")
    once = join_checked(left, twice, "__key", "left_semi").dropDuplicates(["__key"])
    return rest.unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark passages go."""
    small_batches(spark)
    found = find_contamination(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~F.col("contaminated")).select("__row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of what is left, and whether they decode to the text."""
    small_batches(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = sentencepiece_codec.encode_and_decode(docs.select("doc_id", "text"), path)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_codec.MARK, " ")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"), "parity")


STAGES = [
    ("language ID", known_language),
    ("quality rules", good_quality),
    ("n-gram Jaccard join", without_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL expresses neither the learned stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the documents of sf_dir. What a stage has read goes once the next one is written."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
