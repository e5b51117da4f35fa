"""Language identification by cross-parsing with suffix automata.

For each language, a suffix automaton holds labelled texts, whole and with their blanks. A text is parsed greedily into
the longest phrases that the automaton knows; a phrase ends only where no labelled text goes on like that. Of texts,
learned and judged ones alike, letters and all bytes beyond ASCII are read, A-Z as a-z, and any run of other bytes as one
blank; so writing without blanks is read like any other.

A text is parsed in stretches of STRETCH bytes (the last one shorter), each on its own, so that the cursors of many
stretches move on in step and a step is a few numpy operations. In a stretch a language's phrases count log2 of the bytes
learned, as in the entropy that cross-parsing estimates; they are divided by the least of any language there, at most
CAP, and weighted by the stretch's bytes. The language with the least sum wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from fluvia.llm import _text
from fluvia.llm._frames import join_checked, local_table

#: Labelled rows of each language that are learned: at most so many, the first by a hash, and whole. Rows of up to LONG
#: bytes come first; of a longer one, learned only where those do not suffice, one part of LONG bytes is, by its hash.
FIT_ROWS = 32
LONG = 3_000
#: Bytes of a stretch, and by how much a language may fall behind the best one in a stretch.
STRETCH = 256
CAP = 1.25
#: Bytes of all automata together, about half a megabyte a language, beyond which they are not sent out.
MODEL_BYTES = 256_000_000
UNDETERMINED = "und"

#: Places that are tried for a row of transitions before it is put behind all others.
TRIES = 24

_LETTERS = _text.byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_HASHES = 1 << 20


class Machine(NamedTuple):
    """An automaton in displaced rows: the state after code c in state s is target[base[s] + c] if check there is s."""

    base: np.ndarray
    check: np.ndarray
    target: np.ndarray


class Automata(NamedTuple):
    """Languages in the order in which ties are decided, each with the codes of bytes, its automaton and its weight."""

    languages: list[str]
    codes: list[np.ndarray]
    machines: list[Machine]
    weights: list[float]


def suffix_automaton(texts: list[bytes], code: np.ndarray) -> Machine:
    """The smallest automaton that knows every part of every text. State 0 is the start."""
    link, longest, moves = [-1], [0], [{}]
    for text in texts:
        last = 0
        for c in code[np.frombuffer(text, np.uint8)].tolist():
            if (there := moves[last].get(c)) is not None:
                if longest[there] == longest[last] + 1:
                    last = there
                    continue
                moves.append(dict(moves[there]))
                longest.append(longest[last] + 1)
                link.append(link[there])
                link[there] = copy = len(link) - 1
                p = last
                while p >= 0 and moves[p].get(c) == there:
                    moves[p][c] = copy
                    p = link[p]
                last = copy
                continue
            moves.append({})
            longest.append(longest[last] + 1)
            link.append(0)
            new, p = len(link) - 1, last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = new
                p = link[p]
            if p >= 0:
                there = moves[p][c]
                if longest[there] == longest[p] + 1:
                    link[new] = there
                else:
                    moves.append(dict(moves[there]))
                    longest.append(longest[p] + 1)
                    link.append(link[there])
                    link[there] = link[new] = copy = len(link) - 1
                    while p >= 0 and moves[p].get(c) == there:
                        moves[p][c] = copy
                        p = link[p]
            last = new
    return _displaced(moves, int(code.max()) + 1)


def _displaced(moves: list[dict[int, int]], width: int) -> Machine:
    """Rows of transitions laid over each other, the fullest first, each at one of the first TRIES places or beyond all."""
    size = sum(map(len, moves)) + 2 * width
    used = bytearray(2 * size + 256 * width)
    base = np.zeros(len(moves), np.int32)
    check = np.full(len(used), -1, np.int32)
    target = np.zeros(len(used), np.int32)
    free = beyond = width
    for state in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        row = moves[state]
        if not row:
            break
        first, *rest = sorted(row)
        at = free = used.find(0, free)
        for _ in range(TRIES if rest else 0):
            if not any(used[at - first + c] for c in rest):
                break
            at = used.find(0, at + 1)
        else:
            at = max(at, beyond) if rest else at
        beyond = max(beyond, at - first + (rest[-1] if rest else first) + 1)
        base[state] = at - first
        for c, there in row.items():
            used[at - first + c] = 1
            check[at - first + c], target[at - first + c] = state, there
        if len(used) - at < 4 * width:
            used.extend(bytes(len(used)))
            check = np.concatenate([check, np.full(len(used) - len(check), -1, np.int32)])
            target = np.concatenate([target, np.zeros(len(used) - len(target), np.int32)])
    end = int(np.flatnonzero(check >= 0).max(initial=0)) + 2 * width
    return Machine(base, check[:end].copy(), target[:end].copy())


def letters(piece: _text.Slice) -> tuple[np.ndarray, np.ndarray]:
    """What is read of each row's bytes, back to back, and where each row begins (one offset more than rows)."""
    data = piece.data | (((piece.data >= 65) & (piece.data <= 90)).astype(np.uint8) << 5)
    inside = _LETTERS[data]
    data = np.where(inside, data, np.uint8(32))
    kept = inside.copy()
    kept[1:] |= inside[:-1]  # the first byte of a run of others
    begins = piece.offsets[:-1][np.diff(piece.offsets) > 0]
    kept[begins] = inside[begins]
    return data[kept], np.append(0, np.cumsum(kept))[piece.offsets]


def _learned(sample: dict[str, list[bytes]], labelled: dict[str, int]) -> Automata:
    languages = sorted(sample, key=lambda x: (-labelled.get(x, 0), x))
    codes, machines, weights, size = [], [], [], 0
    for lang in languages:
        used = np.zeros(256, bool)
        for text in sample[lang]:
            used[np.frombuffer(text, np.uint8)] = True
        code = np.full(256, int(used.sum()), np.int64)
        code[used] = np.arange(used.sum())
        codes.append(code)
        machines.append(suffix_automaton(sample[lang], code))
        weights.append(float(np.log2(2 + sum(map(len, sample[lang])))))
        size += sum(x.nbytes for x in machines[-1])
        if size > MODEL_BYTES:
            raise ValueError(f"the automata of {len(languages)} languages take more than {MODEL_BYTES} bytes")
    return Automata(languages, codes, machines, weights)


def fit(docs: DataFrame, text: str, lang: str, doc_id: str) -> Automata:
    """Learns from a bounded sample of the rows of each language; null languages, and texts without a letter, teach nothing.

    Which rows are learned is decided by hashes and lengths alone; only texts of the rows chosen travel.
    """
    value = F.col(text)
    rows = docs.select(F.col(lang).alias("lang"), value.alias("text"), F.col(doc_id).alias("id")).where("lang is not null").where(value.rlike(r"\p{L}"))
    rows = rows.withColumns({"h": F.xxhash64("id", "text"), "long": F.octet_length("text") > LONG})
    labelled = {(r["lang"], r["long"]): r["count"] for r in rows.groupBy("lang", "long").count().collect()}
    # a share of the hashes that holds several times the rows needed, of languages with many rows
    shares = [(k, w, max(1, min(_HASHES, 4 * FIT_ROWS * _HASHES // n)) if n > 16 * FIT_ROWS else _HASHES) for (k, w), n in labelled.items()]
    if not shares:
        return Automata([], [], [], [])
    langs, long, share = zip(*shares)
    limits = local_table(docs.sparkSession, lang=pa.array(langs, pa.string()), long=pa.array(long, pa.bool_()), share=pa.array(share, pa.int64()))
    few = rows.join(F.broadcast(limits), ["lang", "long"]).where(F.pmod("h", F.lit(_HASHES)) < F.col("share"))
    order = Window.partitionBy("lang").orderBy("long", "h")

    def least(some: DataFrame) -> DataFrame:
        """The rows with the smallest hashes of each language, each once however often it is repeated."""
        return some.select("lang", "long", "h").distinct().withColumn("n", F.row_number().over(order)).where(F.col("n") <= FIT_ROWS).select("lang", "h").distinct()

    chosen = least(few)
    # where rows repeat, a share of the hashes may hold fewer different rows than wanted, or none: all hashes are looked at
    found = {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    thin = sorted({k for k, _, s in shares if s < _HASHES and found.get(k, 0) < FIT_ROWS})
    if thin:
        few = few.where(~F.col("lang").isin(thin)).unionByName(rows.where(F.col("lang").isin(thin)).withColumn("share", F.lit(_HASHES).cast("long")))
        chosen = least(few)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = [], []
            hashes = batch.column(2).to_pylist()
            for piece in _text.slices(batch.column(1)):
                data, offsets = letters(piece)
                for k in range(piece.first, piece.last):
                    own = data[offsets[k - piece.first] : offsets[k - piece.first + 1]]
                    part = hashes[k] % max(1, len(own) // LONG)
                    texts.append((own[part * LONG : (part + 1) * LONG] if len(own) > LONG else own).tobytes())
                    langs.append(batch.column(0)[k].as_py())
            yield pa.RecordBatch.from_pydict({"lang": pa.array(langs, pa.string()), "text": pa.array(texts, pa.binary())})

    once = join_checked(few, chosen, ["lang", "h"], "left_semi").groupBy("lang", "h").agg(F.first("text").alias("text"))
    found = once.select("lang", "text", "h").mapInArrow(read, "lang string, text binary")
    sample: dict[str, list[bytes]] = {}
    # rows that repeat an id and text are learned once
    for row in sorted(found.distinct().collect(), key=lambda r: (r["lang"], bytes(r["text"]))):
        sample.setdefault(row["lang"], []).append(bytes(row["text"]))
    totals: dict[str, int] = {}
    for (k, _), n in labelled.items():
        totals[k] = totals.get(k, 0) + n
    return _learned(sample, totals)


def phrases(codes: np.ndarray, begin: np.ndarray, end: np.ndarray, machine: Machine) -> np.ndarray:
    """Phrases that each stretch of codes needs: at each turn the longest known one, or one unknown code."""
    base, check, target = machine
    out = np.zeros(len(begin), np.int64)
    who = np.flatnonzero(begin < end)
    at, stop = begin[who].copy(), end[who]
    state = np.zeros(len(who), np.int32)
    while len(who):
        slot = base[state] + codes[at]
        lost = check[slot] != state
        unknown = lost & (state == 0)
        out[who[lost]] += 1
        at += ~lost | unknown  # otherwise a phrase ends before this code, which is read again
        state = np.where(lost, np.int32(0), target[slot])
        over = at >= stop
        if over.any():
            out[who[over & ~unknown]] += 1
            going = ~over
            who, at, stop, state = who[going], at[going], stop[going], state[going]
    return out


def _judged(column: pa.Array, model: Automata) -> pa.Array:
    best, score = [], []
    for piece in _text.slices(column):
        rows = piece.last - piece.first
        data, offsets = letters(piece)
        parts = -(-np.diff(offsets) // STRETCH)
        row = np.repeat(np.arange(rows), parts)
        begin = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(_text.starts(parts)[:-1], parts)) * STRETCH
        end = np.minimum(begin + STRETCH, offsets[1:][row])
        needed = np.stack([w * phrases(code[data], begin, end, machine) for code, machine, w in zip(model.codes, model.machines, model.weights)])
        needed = np.minimum(needed / np.maximum(needed.min(axis=0, initial=np.inf), 1e-12), CAP) * (end - begin)
        sums = np.stack([_text.per_row(row, rows, x) for x in needed]) / np.maximum(1, np.diff(offsets))
        order = np.argsort(np.round(sums, 9), axis=0, kind="stable")
        ranked = np.take_along_axis(sums, order, axis=0)
        best += order[0].tolist()
        score.append(1 - ranked[0] / np.maximum(ranked[1], 1e-12) if len(model.languages) > 1 else np.ones(rows))
    score = np.round(np.clip(np.concatenate(score), 0, 1), 6) if score else np.zeros(0)
    return pa.StructArray.from_arrays([pa.array([model.languages[i] for i in best], pa.string()), pa.array(score)], ["lang", "score"])


def identify(docs: DataFrame, model: Automata, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (0 to 1: by how much the second language needs more phrases) to every document.

    Null texts, and texts without a letter, are `und` with score 0, as all texts are if nothing was learned. Texts with
    letters that all languages parse equally well get the one with most labelled rows, with score 0. Existing columns of
    the two names are replaced; repeated rows are judged alike; an empty table gives an empty table.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang:string,score:double>")
    def judged(column: pa.Array) -> pa.Array:
        return _judged(column, shared.value)

    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)) if model.languages else F.lit(False)
    out = docs.withColumn("__judged", judged(F.coalesce(F.col(text), F.lit("")))) if model.languages else docs.withColumn("__judged", F.lit(None).cast("struct<lang:string,score:double>"))
    return out.withColumns({"lang_pred": F.when(lettered, F.col("__judged.lang")).otherwise(UNDETERMINED), "score": F.when(lettered, F.col("__judged.score")).otherwise(0.0)}).drop("__judged")
