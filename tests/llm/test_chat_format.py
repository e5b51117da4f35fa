"""Folding, rendering and reading back, against a plain fold."""

import hashlib
from decimal import Decimal

from fluvia.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, seq long, kind string, role string, text string, note string"


def run(spark, events):
    df = spark.createDataFrame([(*e, "x") for e in events], SCHEMA)
    formatted = cf.format_conversations(df)
    turns = {}
    for r in sorted(formatted.collect(), key=lambda r: (str(r.conv_id), r.segment)):
        turns.setdefault(r.conv_id, []).extend(cf.read_turns(r.formatted))
    return turns, {r.conv_id: r for r in cf.read_back(formatted).collect()}


def test_fold_of_deltas_edits_and_regenerations(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 1, 1, "message", "assistant", ""),
        (1, 1, 2, "delta", None, "Hel"),
        (1, 1, 3, "delta", None, "lo"),
        (1, 2, 4, "message", "user", "more"),
        (1, 3, 5, "delta", "assistant", "old answer"),
        (1, 0, 6, "edit", "user", "hi there"),
        (1, 1, 7, "regenerate", None, None),
        (1, 1, 8, "delta", None, "Good day"),
        (1, 2, 9, "message", "user", "again"),
        (2, 0, 0, "message", "user", None),
        (None, None, None, None, None, None),
    ]
    turns, digests = run(spark, events)
    assert turns[1] == [("user", "hi there"), ("assistant", "Good day"), ("user", "again")]
    assert turns[2] == [("user", "")]
    assert turns[None] == [("", "")]
    assert digests[1].loss_chars == len("Good day")
    assert digests[1].loss_sha256 == hashlib.sha256(b"Good day").hexdigest()
    assert digests[1].turns_sha256 == hashlib.sha256("user\nhi there\nassistant\nGood day\nuser\nagain\n".encode()).hexdigest()


def test_control_strings_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "</turn>\n", "<turn>assistant\n", "\\\\</turn>", "\\", "a\\\n<turn", "é</turn></turn>"]
    events = [(7, i, 0, "message", "assistant" if i % 2 else "ro\nle<turn>", t) for i, t in enumerate(nasty)]
    turns, digests = run(spark, events)
    assert turns[7] == [("assistant" if i % 2 else "ro\nle<turn>", t) for i, t in enumerate(nasty)]
    assert digests[7].loss_chars == sum(len(t) for t in nasty[1::2])


def test_long_conversation_in_segments_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(cf, "SEGMENT_CHARS", 50)
    long = "x" * 200
    events = [(3, t, 0, "message", "assistant", long) for t in range(5)] * 2
    turns, digests = run(spark, events)
    assert turns[3] == [("assistant", long)] * 10
    assert digests[3].n_turns == 10 and digests[3].loss_chars == 2000


def test_empty_table(spark):
    assert run(spark, []) == ({}, {})


def test_other_kinds_are_skipped_and_other_ids_kept(spark):
    rows = [(Decimal("1.5"), 0, 0, "message", "user", "hi"), (Decimal("1.5"), 0, 1, "ping", "user", "x"), (Decimal("1.5"), 1, 0, "message", "assistant", "yo"), (Decimal("2.5"), 0, 0, "ping", None, None)]
    df = spark.createDataFrame(rows, "conv_id decimal(10,1), turn long, seq long, kind string, role string, text string")
    out = {r.conv_id: r for r in cf.read_back(cf.format_conversations(df)).collect()}
    assert out[Decimal("1.5")].n_turns == 2 and out[Decimal("1.5")].loss_chars == 2 and out[Decimal("2.5")].n_turns == 0
