"""The thin queries over the tables: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from fluvia.llm import chat_format, language_id, quality_classifier, sentencepiece_codec
from fluvia.llm._frames import join_checked, learning_row, local_table, small_batches
from fluvia.llm.decontaminate import find_contamination
from fluvia.llm.divergence import audit
from fluvia.llm.html_extract import extract_main_text
from fluvia.llm.jaccard_join import near_duplicates
from fluvia.llm.packing import pack
from fluvia.llm.prefix_trie import numbered, prefix_trie, with_donor_openings
from fluvia.llm.quality_rules import apply_rules
from fluvia.llm.sharding import shuffle_to_shards
from fluvia.llm.token_count import token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = local_table(spark, conv_id=pa.array([-7, -7], pa.int64()), turn=pa.array([0, 1], pa.int64()), role=pa.array(["user", "assistant"]), text=pa.array([said, said]))
    events = turns.unionByName(more).withColumns({"seq": F.lit(0), "kind": F.lit("message")})
    return chat_format.read_back(chat_format.format_conversations(events))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", learning_row("doc_id", 3) == 1)
    labels = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("int").alias("label")).where("label in (0, 1)").distinct()
    labelled = join_checked(docs.where(~F.col("held_out")), labels, "doc_id", "inner").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), "label")
    model = quality_classifier.fit(labelled)
    return quality_classifier.score_quality(docs, model).select("doc_id", "held_out", "score", "predicted")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), limit=512).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op6_sentencepiece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("piece_bpe_32k.model")
    decoded = sentencepiece_codec.encode_and_decode(docs, path)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), sentencepiece_codec.MARK, " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", same.alias("round_trip"), "parity")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = _table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    dealt = shuffle_to_shards(docs, 16, ["doc_id", "size", "text_crc32"])
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def trusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target of the quality rules: documents that every label of theirs calls good."""
    return _table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = apply_rules(docs, trusted(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", learning_row("doc_id", 5) == 0)
    model = language_id.fit(docs.where(~F.col("held_out")), "text", "lang", "doc_id")
    return language_id.identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*with_donor_openings(numbered(_table(spark, sf_dir, "conversations")), 20, 4))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_source_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # it builds on this module

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_chat_formatting, op2_ngram_jaccard_join, op3_quality_classifier, op4_html_extraction, op5_token_counts, op6_sentencepiece_codec, op7_sharding, op8_quality_rules, op9_decontamination, op10_language_id, op11_conversation_prefix_trie, op12_packing, op13_source_divergence_audit, pipeline)}


#: The same digests from the texts alone: the template puts 6 + 1 marks around the role and 8 after the text.
_OP1 = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
), sized AS (
  SELECT *, length(replace(replace(replace(text, '\\', '\\\\'), '<turn>', '\\<turn>'), '</turn>', '\\</turn>')) + length(role) + 15 AS n FROM turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP2 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT rid, array_to_string(w[s : s + least(5, len(w)) - 1], ' ') AS g FROM (SELECT rid, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT rid, count(*) AS n FROM sh GROUP BY rid),
pr AS (SELECT a.rid AS x, b.rid AS y, count(*) AS i FROM sh a JOIN sh b ON a.g = b.g AND a.rid < b.rid GROUP BY 1, 2),
lk AS (SELECT x, y FROM pr JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE 100 * i >= 75 * (p.n + q.n - i)),
ed AS (SELECT x AS s, y AS d FROM lk UNION ALL SELECT y, x FROM lk),
re AS (SELECT rid, rid AS t FROM n UNION SELECT re.rid, ed.d FROM re JOIN ed ON ed.s = re.t),
cm AS (SELECT re.rid, min(d.doc_id) AS c FROM re JOIN d ON d.rid = re.t GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(cm.c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN cm USING (rid)
"""
_OP9 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s : s + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) AS s FROM b WHERE len(w) > 0)),
dg AS (SELECT rid, n, s, array_to_string(w[s : s + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) ls WHERE len(w) >= n)),
ht AS (SELECT DISTINCT dg.rid, dg.n, dg.s, bw.item_id FROM dg JOIN bw USING (n, g)),
hw AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM ht) GROUP BY rid),
hi AS (SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM ht GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (rid) LEFT JOIN hi USING (rid)
"""


#: crc32 byte by byte: eight halvings after each digit of the id.
_OP11 = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY i) AS s, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: [ord(ch), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda k, b: CASE WHEN b >= 0 THEN xor(k, b) ELSE xor(k >> 1, 3988292384 * (k & 1)) END), 4294967295) % 4 AS h FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, CASE WHEN d.s IS NULL THEN c.s[c.h + 1 : len(c.s)] ELSE list_concat(d.s[1 : c.h], c.s[c.h + 1 : len(c.s)]) END AS s FROM c LEFT JOIN c d ON d.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, s[1 : d] AS k, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(generate_series(0, len(s))) AS d FROM b)),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends) AS ends, CASE WHEN d > 0 THEN len(regexp_extract_all(k[d].x, '[^\x20\x09-\x0D]+')) ELSE 0 END AS w FROM p GROUP BY k, d),
ch AS (SELECT k[1 : d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
m AS (SELECT n.*, coalesce(ch.n_children, 0) AS n_children FROM n LEFT JOIN ch ON ch.d = n.d AND ch.k = n.k),
a AS (SELECT m.*, unnest(generate_series(0, d)) AS up FROM m),
u AS (SELECT k[1 : up] AS k, up AS d, sum((n_convs - 1) * w) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM a GROUP BY 1, 2)
SELECT m.conv_id, m.d AS depth, q.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, CAST(u.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(m.ends, '')) AS ends_sha256
FROM m JOIN u ON u.d = m.d AND u.k = m.k LEFT JOIN m q ON m.d > 0 AND q.d = m.d - 1 AND q.k = m.k[1 : m.d - 1]
"""
_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term),
gk AS (SELECT g.lang, g.source, k.term, k.total, coalesce(c.n, 0) AS n FROM g JOIN k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
gn AS (SELECT lang, source, sum(n) AS n FROM gk GROUP BY lang, source),
p AS (SELECT gk.lang, gk.source, gk.term, gk.n, 1 + CAST(1000000000 AS HUGEINT) * (gk.n + 5) // (gn.n + 5 * v.v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (gk.total + 5) // (v.n + 5 * v.v) AS q
  FROM gk JOIN gn USING (lang, source) JOIN v USING (lang)),
s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _OP1, "op2_ngram_jaccard_join": _OP2, "op9_decontamination": _OP9, "op11_conversation_prefix_trie": _OP11, "op13_source_divergence_audit": _OP13}
