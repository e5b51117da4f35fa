"""Packing against plain cutting, the tokenizers library, and the rules of a packing."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from fluvia.llm import packing
from tests.llm.test_tokens import HARD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain_least(pos, cost, length):
    best = [0]
    for j in range(1, len(pos)):
        best.append(min(best[i] + length - (pos[j] - pos[i]) for i in range(j) if pos[j] - pos[i] <= length) + cost[j])
    return best


def test_cuts_cost_the_least():
    rng = random.Random(5)
    for length in (8, 64):
        for _ in range(60):
            pos = [0]
            for _ in range(rng.randrange(1, 60)):
                pos.append(pos[-1] + rng.randint(1, length))
            cost = [rng.choice([0, 4, 64]) for _ in pos]
            best, back = packing.least_cuts(pos, cost, length)
            assert best == plain_least(pos, cost, length)
            for j in range(1, len(pos)):
                assert best[j] == best[back[j]] + length - (pos[j] - pos[back[j]]) + cost[j]


def test_ids_are_those_of_the_library(spark, library):
    rows = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()] + HARD + ["a\nb", "a.\n\nb c", "\nx", "x\n", "one two\nthree"]
    rng = random.Random(7)
    odd = [32, 10, 9, 13, 0x1C, 0x1F, 0x85, 0xA0, 0x2028, 0x3000, 39, 115, 46, 0x200B, 0xFEFF]
    for top in (0x250, 0x3000, 0xD800):
        rows += ["".join(chr(rng.choice([rng.randrange(top), rng.choice(odd)])) for _ in range(rng.randrange(60))) + rng.choice(["", "<|endoftext|>x"]) for _ in range(300)]
    with open(PATH, "rb") as file:
        encoder = packing.Encoder(file.read())
    want = [library.encode(t, add_special_tokens=False).ids for t in rows]
    assert encoder._pairs and [encoder.encode(x).tolist() for x in rows] == want
    assert len(encoder.encode(" " * 3_000_000)) == 3_000_000
    encoder._pairs = None
    assert [encoder.encode(x).tolist() for x in rows] == want


def test_other_files_go_by_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, "rb") as file:
        encoder = packing.Encoder(file.read())
    assert encoder._pairs is None
    assert encoder.encode("Some words. And more").tolist() == Tokenizer.from_file(path).encode("Some words. And more", add_special_tokens=False).ids


def test_slices_of_long_texts(monkeypatch, library):
    monkeypatch.setattr(packing, "SLICE_CHARS", 50)
    text = "Some words, and more.\nA  wide place here; " * 40
    with open(PATH, "rb") as file:
        assert packing.Encoder(file.read()).encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def checked(spark, library, rows, length, **more):
    """Asserts the rules of a packing over rows of different ids, and returns (padding, tokens)."""
    df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "doc_id long, text string").coalesce(2)
    out = packing.pack(df, PATH, length=length, **more).collect()
    assert out or not rows
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 1] for k, t in enumerate(rows)}
    seen, sequences = {}, {}
    for r in out:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes())
        seen.setdefault(r.doc_id, []).append((r.start, r.start + r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.offset + r.length))
    assert seen.keys() == ids.keys()
    for k, spans in [*seen.items(), *sequences.items()]:
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(seen[k][-1][1] == len(own) for k, own in ids.items())
    sizes = [x[-1][1] for x in sequences.values()]
    assert max(sizes, default=0) <= length
    order = [r.doc_id for r in sorted(out, key=lambda r: (r.sequence_id, r.offset))]
    assert [k for k, b in zip(order, [None, *order]) if k != b] == sorted(ids)
    return sum(length - n for n in sizes if n & (n - 1)), sum(map(len, ids.values()))


def test_packings_hold_the_rules_and_pad_little(spark, library):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    for length, block in ((2048, packing.BLOCK_TOKENS), (2048, 5000), (256, 3000)):
        padding, tokens = checked(spark, library, rows, length, block_tokens=block)
        assert padding < (0.005 if length == 2048 else 0.03) * tokens


def test_empty_long_and_repeated_texts(spark, library):
    rows = [None, "", "w " * 9000, "x" * 5000, "same text.", "same text.", "\n" * 300, None]
    checked(spark, library, rows, 128)
    checked(spark, library, rows, 16, block_tokens=64)
    checked(spark, library, [None], 2048)
    checked(spark, library, [], 2048)


def test_ids_and_columns(spark):
    df = spark.createDataFrame([(None, "a b", 1), ("x", "c.", 2), ("x", "c.", 2)], "doc_id string, text string, start int")
    out = packing.pack(df.coalesce(1), PATH).collect()
    assert {r.doc_id for r in out} == {None, "x"}
    assert sum(r.length for r in out) == 3 + 3 + 3
    with pytest.raises(ValueError):
        packing.pack(df, PATH, length=1000)


def test_query(spark, sf):
    from fluvia.llm import registry

    out = registry.op12_packing(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
