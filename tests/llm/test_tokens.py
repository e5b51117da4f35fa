"""Token counts and the SentencePiece codec against the libraries themselves."""

import public_tokenizers
import pyarrow as pa
import sentencepiece
from tokenizers import Tokenizer

from fluvia.llm import sentencepiece_codec as codec
from fluvia.llm import token_count

HARD = ["", " ", "  ", " a", "a ", "a  b", "a\n b", "a \nb", "\n\n", "don't stop", "<|endoftext|>", "a <|endoftext|> b", "x<|endoftext|>", "é 漢字 \U0001f600", "a b c", "a\x1c b", "1 234,5 %", "\t x", "▁", "a▁ b", "<s> </s>", "<0x0A>", "w" * 3000, "tab\tx y"]


def texts(spark):
    return [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + HARD + [None]


def frame(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def test_counts_equal_the_library(spark):
    rows = texts(spark)
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"):
        path = public_tokenizers.path(name)
        if name.endswith("json"):
            whole = Tokenizer.from_file(path)
            want = [len(whole.encode(t or "", add_special_tokens=False).ids) for t in rows]
        else:
            whole = sentencepiece.SentencePieceProcessor(model_file=path)
            want = [len(whole.encode(t or "")) for t in rows]
        got = {r.doc_id: r for r in token_count.token_counts(frame(spark, rows), path, limit=100).collect()}
        assert [got[i].n_tokens for i in range(len(rows))] == want, name
        assert all(got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (want[i] > 100) for i, t in enumerate(rows))


def test_pieces_join_to_the_text():
    for t in HARD:
        assert "".join(token_count.pieces(t)) == t


def test_codec_parity_and_round_trip(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    original = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = texts(spark)
    out = codec.decode(codec.encode(frame(spark, rows), path), path).collect()
    for r in out:
        t = rows[r.doc_id] or ""
        assert r.ids == original.encode(t)
        assert r.decoded == original.decode(r.ids) == t.replace("▁", " ")
    both = {r.doc_id: (r.ids, r.decoded) for r in codec.encode_and_decode(frame(spark, rows), path).collect()}
    assert both == {r.doc_id: (r.ids, r.decoded) for r in out}
    assert all(r.parity for r in out)
    with open(path, "rb") as file:
        assert codec.Codec(file.read()).encode(pa.array(["plain text", "", None]))[0].to_pylist()[1:] == [[], []]


def test_empty_table(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    empty = spark.createDataFrame([], "doc_id long, text string, ids string, n_tokens int")
    assert codec.decode(codec.encode(empty, path), path).count() == 0
    assert token_count.token_counts(empty, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def model(kind, pieces, charsmap=b"", spaces=False):
    """A model file made by hand: pieces with scores, byte fallback, and the given normaliser."""
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    for piece, score, sort in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)], *[(p, s, 1) for p, s in pieces]]:
        spec.pieces.add(piece=piece, score=score, type=sort)
    spec.trainer_spec.model_type = kind
    spec.trainer_spec.byte_fallback = True
    rule = spec.normalizer_spec
    rule.name, rule.precompiled_charsmap, rule.add_dummy_prefix, rule.remove_extra_whitespaces, rule.escape_whitespaces = "own", charsmap, True, spaces, True
    return spec.SerializeToString()


UNIGRAM = [("▁", -3.0), ("▁the", -1.5), ("▁th", -2.25), ("e", -2.5), ("▁cat", -2.0), ("s", -2.75), ("▁c", -3.25), ("at", -3.125), ("a", -4.0), ("t", -4.5), ("h", -5.0), ("c", -5.5), ("ing", -2.125), ("i", -4.75), ("n", -4.875), ("g", -5.25)]
SAID = ["the cats", "  the   cat ", "thecat a", "", " ", "eating cats ▁the", "ｔｈｅ ｃａｔ", "the ﬁ cat at", "the漢", "cat\tthe\n", "a" * 500]


def coded(spark, tmp_path, raw, rows):
    path = str(tmp_path / "own.model")
    with open(path, "wb") as file:
        file.write(raw)
    return {r.doc_id: r for r in codec.encode_and_decode(frame(spark, rows), path).collect()}


def test_unigram_model_is_rebuilt(spark, tmp_path):
    raw = model(1, UNIGRAM)
    original = sentencepiece.SentencePieceProcessor(model_proto=raw)
    got = coded(spark, tmp_path, raw, SAID)
    assert codec.Codec(raw).splits
    for i, t in enumerate(SAID):
        assert got[i].ids == original.encode(t), t
        assert got[i].decoded == original.decode(got[i].ids), t
    assert sum(r.parity for r in got.values()) >= len(SAID) - 1


def test_normaliser_is_rebuilt(spark, tmp_path):
    from sentencepiece import SentencePieceNormalizer, sentencepiece_model_pb2

    rule = sentencepiece_model_pb2.ModelProto()
    rule.ParseFromString(SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    raw = model(1, UNIGRAM, rule.normalizer_spec.precompiled_charsmap, spaces=True)
    original = sentencepiece.SentencePieceProcessor(model_proto=raw)
    assert not codec.Codec(raw).splits
    got = coded(spark, tmp_path, raw, SAID)
    for i, t in enumerate(SAID):
        assert got[i].ids == original.encode(t), t
        assert got[i].decoded == original.decode(got[i].ids), t
    assert got[6].ids == got[0].ids[:1] + got[6].ids[1:] and got[6].parity  # full-width letters become plain ones


def test_differences_give_the_originals_ids_everywhere(spark, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    original = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = texts(spark)
    with open(path, "rb") as file:
        raw = file.read()
    plain = codec._rebuilt

    def other(spec, mark):  # one merge less
        if mark == codec.MARK:
            for p in spec.pieces:
                if p.piece == "▁the":
                    p.type = 5
        return plain(spec, mark)

    monkeypatch.setattr(codec, "_rebuilt", other)
    broken = codec.Codec(raw)
    for size in (10, 1_000_000):
        monkeypatch.setattr(codec, "SLICE_BYTES", size)
        ids, same = broken.encode(pa.array(rows, pa.string()))
        assert ids.to_pylist() == [original.encode(t or "") for t in rows]
        assert same.any() and not same.all()


def test_ids_do_not_follow_the_partitioning(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = texts(spark)
    df = frame(spark, rows)
    one = {r.doc_id: r.ids for r in codec.encode(df.coalesce(1), path).collect()}
    assert one == {r.doc_id: r.ids for r in codec.encode(df.repartition(7), path).collect()}


def test_batches_are_of_bytes():
    assert [len(x) for x in token_count.by_bytes(["漢字"] * 5, 12)] == [2, 2, 1]
    assert [len(x) for x in token_count.by_bytes(["abcdef"] * 5, 12)] == [2, 2, 1]
