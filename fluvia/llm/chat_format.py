"""Chat formatting from an event log: partition by conversation, sort, fold, render, read back.

An event has conv_id, turn, seq, kind, role and text. Kinds: `message` starts a further message at its turn; `delta`
appends text to the newest message of its turn (or starts one of the assistant's); `edit` replaces that message's text;
`regenerate` empties it, for deltas to come, and drops every later turn as it stood before that event. Events of any
other kind (pings, reactions) change no message and are skipped. Events of one
conversation are sorted by turn, then seq, so all that a fold must hold is one message and one number: the seq of the
last regeneration of an earlier turn.

The template of a turn is `<turn>` role newline text `</turn>` newline. Inside role and text a backslash stands before
each backslash and each turn mark, and in roles before a newline, so that the output can be read back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<turn>", "</turn>"
#: Characters after which the rendered text of one conversation goes on in another row.
SEGMENT_CHARS = 1_000_000
_ID_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
#: The role whose texts the loss mask covers.
LEARNED = "assistant"

_MARK = re.compile(r"\\|<(?=/?turn>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"<turn>((?:[^\\\n]++|\\.)*+)\n((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return _MARK.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its (escaped) text begins and ends."""
    head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a rendered text."""
    at = 0
    while at < len(formatted):
        found = _TURN.match(formatted, at)
        if not found:
            raise ValueError("not a rendered conversation")
        yield unescape(found[1]), unescape(found[2])
        at = found.end()


def _folded(events: Iterator[tuple]) -> Iterator[tuple]:
    """(conv_id, role, text) of final messages, from events in order; (conv_id, None, None) opens each conversation."""
    conv, turn, dropped, regenerated = object(), None, None, None
    role, parts, since = None, None, None

    def ended():
        if parts is not None and (dropped is None or since >= dropped):
            yield conv, role, "".join(parts)

    for c, t, seq, kind, r, text in events:
        if c != conv or t != turn:
            yield from ended()
            parts = None
            if c != conv:
                yield c, None, None
                dropped = None
            elif regenerated is not None:
                dropped = regenerated if dropped is None else max(dropped, regenerated)
            regenerated = None
            conv, turn = c, t
        text, r, kind = text or "", r or "", kind or "message"
        if kind == "message":
            yield from ended()
            role, parts, since = r, [text], seq
        elif kind == "delta":
            if parts is None:
                role, parts, since = r or LEARNED, [], seq
            parts.append(text)
        elif kind == "edit":
            role, parts, since = (role if parts is not None else r or LEARNED), [text], seq
        elif kind == "regenerate":
            role, parts, since = (role if parts is not None else r or LEARNED), [], seq
            regenerated = seq
    yield from ended()


def _rendered(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    spans_type = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    rows: list[tuple] = []
    size = 0

    def batch() -> pa.RecordBatch:
        ids, segments, texts, spans = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(segments, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"a": a, "b": b} for a, b in x] for x in spans], spans_type)], ["conv_id", "segment", "formatted", "loss"])

    events = (e for b in batches for e in zip(*(b.column(i).to_pylist() for i in range(6))))
    conv, segment, text, spans, length = None, None, [], [], 0
    for c, role, said in _folded(events):
        if role is None or length > SEGMENT_CHARS:
            if segment is not None:
                rows.append((conv, segment, "".join(text), spans))
                size += length
            conv, segment, text, spans, length = c, (0 if role is None else segment + 1), [], [], 0
            if size > SEGMENT_CHARS:
                yield batch()
                rows, size = [], 0
        if role is not None:
            turn, a, b = render_turn(role, said)
            text.append(turn)
            if role == LEARNED:
                spans.append((length + a, length + b))
            length += len(turn)
    if segment is not None:
        rows.append((conv, segment, "".join(text), spans))
    if rows:
        yield batch()


def format_conversations(events: DataFrame) -> DataFrame:
    """(conv_id, segment, formatted, loss): rendered conversations, in segments of whole turns, with the spans to learn.

    Segments of a conversation stand next to each other, in order, in one partition; most have one. `loss` holds the
    character spans of assistant texts. A null text or role counts as empty, a null kind as `message`, a null seq as 0;
    a null conv_id is a conversation of its own, a null turn comes first. Repeated rows are repeated messages; ties in
    turn and seq go by kind, role and text. Extra columns are ignored. An empty table gives an empty table.
    """
    id_type = dict(events.dtypes)["conv_id"]
    if id_type not in _ID_TYPES:  # other ids go by their text
        return format_conversations(events.withColumn("conv_id", F.col("conv_id").cast("string"))).withColumn("conv_id", F.col("conv_id").cast(id_type))
    keyed = events.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("seq").cast("long"), F.lit(0)).alias("seq"), F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = keyed.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "kind", "role", "text")

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _rendered(batches, _ID_TYPES[id_type])

    return ordered.mapInArrow(rendered, f"conv_id {id_type}, segment bigint, formatted string, loss array<struct<a:bigint,b:bigint>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, parsed from the rendered
    segments alone. Must follow format_conversations directly, whose order it relies on; holds hashes, not texts."""
    id_type = dict(formatted.dtypes)["conv_id"]
    if id_type not in _ID_TYPES:
        return read_back(formatted.withColumn("conv_id", F.col("conv_id").cast("string"))).withColumn("conv_id", F.col("conv_id").cast(id_type))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            out = []
            for conv, segment, text, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if segment == 0:
                    if state:
                        out.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[1] += 1
                    state[2].update(f"{role}\n{said}\n".encode())
                for span in loss:
                    said = unescape(text[span["a"] : span["b"]])
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] += len(text)
            yield digests(out)
        yield digests([state] if state else [])

    def digests(states: list) -> pa.RecordBatch:
        kind = _ID_TYPES[id_type]
        columns = list(zip(*[(s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5]) for s in states])) or [[]] * 6
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, f"conv_id {id_type}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
