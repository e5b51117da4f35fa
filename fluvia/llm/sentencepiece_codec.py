"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed for its pieces, scores, normaliser and flags, from which a tokenizer of the other
library is rebuilt: a unigram model from the scores, or, for the file's other kind, merges ranked by the scores of what
they make; with byte fallback, the blank marker and the normaliser's character map. Its ids are the result, and ids are
decoded by it, whole texts at a time.

Where no piece goes on past a blank marker, the words of many texts are told apart by numpy, each different word of a
slice that is not known yet is encoded once, many as one text, and the ids of texts are gathered from those of their
words; a bounded number of words stays known from slice to slice. Texts with
runs of blanks, markers of their own or blanks at an end are encoded whole, as all texts are by models of other kinds.

Parity is verified for everything that is encoded: each word, and each text that is encoded whole, also goes through the
original library. A word (or such a text) on which the libraries differ gets the original's
ids, wherever it stands, and the rows that hold it are marked; so ids never depend on how rows fall into tasks.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

from fluvia.llm import _text
from fluvia.llm._frames import released
from fluvia.llm.token_count import by_bytes

MARK = "▁"
#: Bytes of text whose words are encoded together, unless a single text has more.
SLICE_BYTES = 1_000_000
#: Words of earlier slices whose ids a task remembers; with more, only those of the last slice.
KNOWN_WORDS = 150_000
#: UTF-8 bytes of one batch of whole texts, and ids of one decoding batch, unless a single text has more.
BATCH_BYTES = 200_000
DECODED_IDS = 50_000
#: Threads of one batch.
THREADS = 2

_UNIGRAM, _BPE = 1, 2
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6
_BLANK = _text.byte_class((0x20, 0x20))


class Codec:
    """Both libraries' views of one model file."""

    def __init__(self, model: bytes, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2
        from tokenizers import Regex, Tokenizer, decoders, normalizers

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(model)
        self.original = sentencepiece.SentencePieceProcessor(model_proto=model)
        rule = spec.normalizer_spec
        steps = [normalizers.Precompiled(rule.precompiled_charsmap)] if rule.precompiled_charsmap else []
        if rule.remove_extra_whitespaces:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if rule.add_dummy_prefix:
            steps.append(normalizers.Prepend(" "))
        if rule.escape_whitespaces:
            steps.append(normalizers.Replace(" ", MARK))
        built = _rebuilt(spec, MARK)  # the tokenizers share it
        self.whole = Tokenizer(built)
        self.whole.normalizer = normalizers.Sequence(steps)
        self._words, self._starts = None, None
        # words known: their hashes in order, where the ids of each begin, the ids, and whether the libraries agree
        self._known = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))
        pieces = [p.piece for p in spec.pieces]
        if rule.escape_whitespaces and rule.add_dummy_prefix and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and _marks_lead(pieces):
            from tokenizers import pre_tokenizers

            self._words = Tokenizer(built)
            self._words.normalizer = self.whole.normalizer
            self._words.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="never", split=True)
            self._starts = np.array([p.startswith(MARK) for p in pieces])
        # for decoding, pieces hold blanks for markers, which saves replacing them in every piece of every text
        self._pieces = Tokenizer(_rebuilt(spec, " "))
        self._pieces.decoder = decoders.Sequence([decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if rule.add_dummy_prefix else [])])

    @property
    def splits(self) -> bool:
        """Whether texts may be encoded word by word."""
        return self._words is not None

    def encode(self, column: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Ids of whole texts (null counts as empty), and whether both libraries agree on each."""
        parts, agreed = [], []
        for piece in _text.slices(column, SLICE_BYTES):
            rows = piece.last - piece.first
            raw = piece.data.tobytes()
            odd = _odd(piece) if self.splits else np.diff(piece.offsets) > 0
            ids, counts, same = self._by_words(piece, raw, ~odd) if self.splits else (np.zeros(0, np.int32), np.zeros(rows, np.int64), np.ones(rows, bool))
            if odd.any():
                at = np.flatnonzero(odd)
                found, same[at] = self._by_texts([raw[piece.offsets[i] : piece.offsets[i + 1]].decode() for i in at])
                whole = np.split(ids, np.cumsum(counts)[:-1])
                for i, x in zip(at, found):
                    whole[i] = x
                counts[at] = [len(x) for x in found]
                ids = np.concatenate(whole)
            parts.append(pa.ListArray.from_arrays(pa.array(_text.starts(counts), pa.int32()), pa.array(ids, pa.int32())))
            agreed.append(same)
        if not parts:
            return pa.array([], pa.list_(pa.int32())), np.zeros(0, bool)
        return pa.concat_arrays(parts), np.concatenate(agreed)

    def _by_words(self, piece: _text.Slice, raw: bytes, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, how many each row has, and agreement, of the plain rows; the others have none."""
        rows = piece.last - piece.first
        words = _text.words(piece, _BLANK)
        mine = plain[words.row]
        start, end, row, name = words.start[mine], words.end[mine], words.row[mine], words.hash[mine]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(rows, np.int64), np.ones(rows, bool)
        names, first, inverse = np.unique(name, return_index=True, return_inverse=True)
        at, ids, same = self._look_up(names, start[first], end[first], raw)
        sizes = np.diff(at)[inverse]
        begin = _text.starts(sizes)
        gathered = ids[np.repeat(at[:-1][inverse] - begin[:-1], sizes) + np.arange(begin[-1])]
        counts = _text.per_row(row, rows, sizes).astype(np.int64)
        agreed = np.ones(rows, bool)
        agreed[row[~same[inverse]]] = False
        return gathered, counts, agreed

    def _look_up(self, names: np.ndarray, start: np.ndarray, end: np.ndarray, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the ids of each word begin, the ids, and agreement; words (by their hashes, in order) that are not known yet
        are encoded and verified first."""
        known, at, ids, same = self._known
        place = np.searchsorted(known, names)
        new = np.flatnonzero(known[np.minimum(place, len(known) - 1)] != names) if len(known) else np.arange(len(names))
        if len(new):
            words = [raw[a:b].decode() for a, b in zip(start[new].tolist(), end[new].tolist())]
            new_ids, new_at, new_same = self._encode_words(words, end[new] - start[new])
            every = np.concatenate([known, names[new]])
            sizes = np.concatenate([np.diff(at), np.diff(new_at)])
            begin, flat = np.concatenate([at[:-1], new_at[:-1] + len(ids)]), np.concatenate([ids, new_ids])
            order = np.argsort(every)
            self._known = known, at, ids, same = every[order], *_laid_out(begin[order], sizes[order], flat), np.concatenate([same, new_same])[order]
            place = np.searchsorted(known, names)
        out = *_laid_out(at[place], np.diff(at)[place], ids), same[place]
        if len(known) > KNOWN_WORDS:
            self._known = names, *out
        return out

    def _encode_words(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of words without blanks or markers, where each word's begin, and whether the libraries agree on each.

        Many words are encoded as one text: the ids of a word begin with a piece that begins with a marker, and no other
        piece does.
        """
        ends = np.searchsorted(np.cumsum(sizes), np.arange(1, 1 + sizes.sum() // (BATCH_BYTES // 8)) * (BATCH_BYTES // 8))
        cuts = [0, *np.unique(ends[(ends > 0) & (ends < len(words))]).tolist(), len(words)]
        runs = [words[a:b] for a, b in zip(cuts, cuts[1:])]
        found = []
        for group in range(0, len(runs), 8):
            encoded = self._words.encode_batch_fast([" ".join(run) for run in runs[group : group + 8]], add_special_tokens=False)
            found += [np.array(x.ids, np.int32) for x in encoded]
        ids = np.concatenate(found)
        at = np.append(np.flatnonzero(self._starts[ids]), len(ids))
        assert len(at) == len(words) + 1, "a word does not begin with a marker"
        same = np.ones(len(words), bool)
        checked = 0
        for run in runs:
            wanted = self.original.encode(run, num_threads=1)
            flat = np.fromiter(chain.from_iterable(wanted), np.int32)
            sizes = np.fromiter(map(len, wanted), np.int64, len(run))
            part = at[checked : checked + len(run) + 1]
            if not (np.array_equal(np.diff(part), sizes) and np.array_equal(ids[part[0] : part[-1]], flat)):
                own = np.split(ids[part[0] : part[-1]], part[1:-1] - part[0])
                same[checked : checked + len(run)] = [x.tolist() == y for x, y in zip(own, wanted)]
                # the original's ids stand for these words
                ids = np.concatenate([ids[: part[0]], flat, ids[part[-1] :]])
                at[checked + 1 :] += len(flat) - (part[-1] - part[0])
                at[checked : checked + len(run) + 1] = at[checked] + _text.starts(sizes)
            checked += len(run)
        return ids, at, same

    def _by_texts(self, texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of texts that are encoded whole, and whether the libraries agree on each."""
        ids, same = [], []
        for run in by_bytes(texts, BATCH_BYTES):
            for own, wanted in zip(self.whole.encode_batch_fast(run, add_special_tokens=False), self.original.encode(run, num_threads=1)):
                same.append(own.ids == wanted)
                ids.append(np.array(wanted, np.int32))
        return ids, np.array(same, bool)

    def decode(self, column: pa.Array) -> pa.Array:
        """Texts of whole id sequences (null counts as none); ids must be those of the model."""
        ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
        flat = column.flatten().to_numpy(zero_copy_only=False)
        out, first = [], 0
        while first < len(column):
            begin = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, begin + DECODED_IDS, side="right")))
            ids = flat[begin : int(ends[last - 1])].tolist()
            places = [0, *(ends[first:last] - begin).tolist()]
            out.append(pa.array(self._pieces.decode_batch([ids[a:b] for a, b in zip(places, places[1:])], skip_special_tokens=False), pa.string()))
            first = last
        return pa.concat_arrays(out) if out else pa.array([], pa.string())


def _laid_out(begin: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of the given beginnings and sizes, laid one after the other: where each begins now, and all of them."""
    at = _text.starts(sizes)
    return at, flat[np.repeat(begin - at[:-1], sizes) + np.arange(at[-1])]


def _marks_lead(pieces: list[str]) -> bool:
    """Whether markers stand only at the beginning of pieces, so that no piece goes on past one after other characters."""
    return not any(MARK in p.lstrip(MARK) for p in pieces)


def _rebuilt(spec, mark: str):
    """The model of the tokenizers library, with `mark` for blank markers."""
    from tokenizers import models

    pieces = [p.piece.replace(MARK, mark) for p in spec.pieces]
    kinds = [p.type or _NORMAL for p in spec.pieces]
    unknown, fallback = kinds.index(_UNKNOWN), spec.trainer_spec.byte_fallback
    if spec.trainer_spec.model_type == _UNIGRAM:
        return models.Unigram([(x, p.score) for x, p in zip(pieces, spec.pieces)], unk_id=unknown, byte_fallback=fallback)
    if spec.trainer_spec.model_type != _BPE:
        raise ValueError("neither a unigram nor a BPE model")
    ids = {p: i for i, p in enumerate(pieces)}
    ranked = sorted(((x, p.score) for x, p, k in zip(pieces, spec.pieces, kinds) if k in (_NORMAL, _USER)), key=lambda p: -p[1])
    merges = [(p[:k], p[k:]) for p, _ in ranked for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids]
    return models.BPE(ids, merges, unk_token=pieces[unknown], byte_fallback=fallback, fuse_unk=True, cache_capacity=0)


def _odd(piece: _text.Slice) -> np.ndarray:
    """Rows with a run of blanks, a blank at an end, or a marker of their own."""
    data, offsets = piece.data, piece.offsets
    blank = data == 0x20
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    bad = blank & (edge[:-1] | edge[1:])
    bad[1:] |= blank[1:] & blank[:-1]
    mark = MARK.encode()
    bad[: max(0, len(data) - 2)] |= (data[:-2] == mark[0]) & (data[1:-1] == mark[1]) & (data[2:] == mark[2])
    out = np.zeros(len(offsets) - 1, bool)
    out[np.searchsorted(offsets, np.flatnonzero(bad), side="right") - 1] = True
    return out


def _model(df: DataFrame, path: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _combined(column: pa.Array) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def encode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds ids (array of int) of every whole text, and parity (boolean: whether both libraries gave these ids).

    A null or empty text has no ids. Repeated rows are encoded alike; existing columns of the two names are replaced; an
    empty table gives an empty table. The model file is read on the driver and travels as a broadcast (its size is that
    of a vocabulary).
    """
    model = _model(df, model_path)

    @arrow_udf("struct<ids:array<int>,parity:boolean>")
    def encoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with released():
            codec = Codec(model.value)
            for column in batches:
                ids, same = codec.encode(_combined(column))
                yield pa.StructArray.from_arrays([ids, pa.array(same)], ["ids", "parity"])

    out = df.withColumn("__encoded", encoded(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumns({"ids": F.col("__encoded.ids"), "parity": F.col("__encoded.parity")}).drop("__encoded")


def decode(df: DataFrame, model_path: str, ids: str = "ids") -> DataFrame:
    """Adds decoded, the text of every id sequence; null counts as no ids, which decode to the empty text."""
    model = _model(df, model_path)

    @arrow_udf("string")
    def decoded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with released():
            codec = Codec(model.value)
            for column in batches:
                yield codec.decode(_combined(column))

    return df.withColumn("decoded", decoded(F.col(ids)))


def encode_and_decode(df: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """Adds ids, parity and decoded as encode and decode do one after the other, with one codec in one Python worker: what
    is decoded are the ids of whole texts."""
    model = _model(df, model_path)

    @arrow_udf("struct<ids:array<int>,parity:boolean,decoded:string>")
    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with released():
            codec = Codec(model.value)
            for column in batches:
                ids, same = codec.encode(_combined(column))
                yield pa.StructArray.from_arrays([ids, pa.array(same), codec.decode(ids)], ["ids", "parity", "decoded"])

    out = df.withColumn("__both", both(F.coalesce(F.col(text), F.lit(""))))
    return out.withColumns({k: F.col(f"__both.{k}") for k in ("ids", "parity", "decoded")}).drop("__both")
