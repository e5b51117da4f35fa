"""Order-preserving packing of tokenized documents into sequences of bounded length.

Documents follow each other as one stream of token ids, each closed by an end id. A dynamic programme chooses where
windows of at most LENGTH tokens are cut: after a document at no cost, after a sentence or line for SENTENCE_CUT, and on a
grid inside long sentences for INSIDE_CUT; a window costs what it must be padded. With positions p and least costs c,

    c[j] = penalty[j] + length - p[j] + min(c[i] + p[i] : p[j] - length <= p[i] < p[j])

so the minimum slides over a window, and a queue of rising keys gives it in constant time per boundary.

Every task packs the rows of its own partition, in their order and in blocks of bounded size; what a block leaves behind
its last cut opens the next block. Only the last window of a partition is cut once more: since a window whose size is a
power of two needs no padding, it goes as its binary parts where that costs less than padding it. No rows are shuffled.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from fluvia.llm._frames import released
from fluvia.llm.token_count import _splits_safely

LENGTH = 2048
#: Costs, in tokens of padding: a document cut between two sentences, and a sentence cut.
SENTENCE_CUT, INSIDE_CUT = 1, 16
#: Sentences of more tokens than LONG may be cut at every GRID tokens.
LONG, GRID = 16, 8
#: Tokens that a block gathers before it is cut.
BLOCK_TOKENS = 1 << 19
#: Characters of a text that are encoded together.
SLICE_CHARS = 1_000_000
#: Bits of a sequence's number that count within a partition.
LOCAL_BITS = 32

_SAFE = re.compile(r"(?<=\S)(?= \S)")
_STOPS = tuple(".!?。！？…")
# Fixed: the pattern by which byte-level tokenizers of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ID_TYPES = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}


def least_cuts(pos: list[int], cost: list[int], length: int) -> tuple[list[int], list[int]]:
    """Least costs of cutting at each position, and the index of the cut before. `pos` rises from 0 by at most `length`."""
    best, back = [0] * len(pos), [0] * len(pos)
    keys, at = [0], [pos[0]]
    where, head = [0], 0
    for j in range(1, len(pos)):
        p = pos[j]
        while at[head] < p - length:
            head += 1
        key = keys[head] + cost[j] + length  # the cost of j, and p
        best[j] = key - p
        back[j] = where[head]
        while len(keys) > head and keys[-1] >= key:
            keys.pop(), at.pop(), where.pop()
        keys.append(key), at.append(p), where.append(j)
        if head > 4096:
            del keys[:head], at[:head], where[:head]
            head = 0
    return best, back


def _byte_pairs(model: bytes):
    """The file's merges as a byte-pair encoding of tiktoken's, or None for files that are not plainly byte-level.

    Its ids are those of the tokenizers library where merges are ranked in the order of their ids; it needs no memory of
    words, for it merges bytes without building an encoding object for each of them."""
    import tiktoken

    spec = json.loads(model)["model"]
    if spec["type"] != "BPE" or spec.get("dropout") or spec.get("continuing_subword_prefix") or spec.get("end_of_word_suffix") or spec.get("ignore_merges"):
        return None
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (0x20, 0xA0, 0xAD)]
    shown = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
    merges = [x.split(" ") if isinstance(x, str) else x for x in spec["merges"]]
    named = [*shown, *("".join(x) for x in merges)]
    ids = [spec["vocab"].get(x, -1) for x in named]
    if min(ids) < 0 or any(a >= b for a, b in zip(ids[256:], ids[257:])) or max(ids[:256]) >= min(ids[256:], default=1 << 40):
        return None
    added = {x["content"]: x["id"] for x in json.loads(model)["added_tokens"]}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={bytes(shown[c] for c in x): i for x, i in zip(named, ids)}, special_tokens=added)


class Encoder:
    """The ids that the tokenizers library gives, and which of them end sentences or lines."""

    def __init__(self, model: bytes):
        from tokenizers import Tokenizer

        self._tokenizer = tokenizer = Tokenizer.from_buffer(model)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        self._splits = _splits_safely(tokenizer)
        self._pairs = _byte_pairs(model) if self._splits else None
        texts = [tokenizer.decode([i], skip_special_tokens=False) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
        self._stop = np.array([x.endswith(_STOPS) for x in texts])
        self._line = np.array([x.endswith("\n") for x in texts])
        self._blank = np.array([x[:1].isspace() for x in texts])

    def sentence_ends(self, ids: np.ndarray) -> np.ndarray:
        """Places 1 to n - 1 before which a line ends, or a sentence that a blank follows."""
        before = ids[:-1]
        return np.flatnonzero(self._line[before] | (self._stop[before] & self._blank[ids[1:]])) + 1

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text. Long texts go in slices that begin at safe boundaries."""
        parts = [self._ids(x) for x in (_slices(text) if self._splits and len(text) > SLICE_CHARS else [text])]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _ids(self, text: str) -> np.ndarray:
        if self._pairs:
            try:
                return self._pairs.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # its pattern has a bound on runs of white space
                pass
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)


def _slices(text: str) -> Iterator[str]:
    at = 0
    while len(text) - at > SLICE_CHARS and (cut := _SAFE.search(text, at + SLICE_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


#: The encoder of a worker process, by the digest of its model file; later tasks use it again.
_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(model: bytes) -> Encoder:
    key = hashlib.sha256(model).digest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(model)
    return _ENCODERS[key]


class Packer:
    """Gathers runs of ids and gives out the pieces of windows that are settled."""

    def __init__(self, encoder: Encoder, length: int, block_tokens: int, first: int):
        self._encoder, self._length, self._block, self._sequence = encoder, length, block_tokens, first
        self._ids: list[np.ndarray] = []
        self._runs: list[tuple] = []  # document, ids of it before, ids here, its ids in all
        self._held = 0

    def add(self, doc, ids: np.ndarray) -> Iterator[tuple]:
        """Adds a document's ids, in parts that do not exceed a block."""
        for start in range(0, len(ids), self._block):
            part = ids[start : start + self._block]
            self._ids.append(part)
            self._runs.append((doc, start, len(part), len(ids)))
            self._held += len(part)
            if self._held >= self._block:
                yield self._pieces(False)

    def rest(self) -> Iterator[tuple]:
        if self._held:
            yield self._pieces(True)

    def _boundaries(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum([n for _, _, n, _ in self._runs])
        closed = ends[[start + n == total for _, start, n, total in self._runs]]
        cost = np.full(len(ids) + 1, -1, np.int64)
        cost[len(ids)] = INSIDE_CUT
        cost[self._encoder.sentence_ends(ids)] = SENTENCE_CUT
        cost[closed] = 0
        cost[0] = 0
        pos = np.flatnonzero(cost >= 0)
        gaps = np.diff(pos)
        long = min(LONG, self._length)
        for k in np.flatnonzero(gaps > long):
            cost[pos[k] + GRID : pos[k + 1] : GRID] = INSIDE_CUT
        if self._length < LONG:  # only for windows shorter than the grid
            cost[cost < 0] = INSIDE_CUT
        pos = np.flatnonzero(cost >= 0)
        return pos, cost[pos]

    def _pieces(self, final: bool) -> tuple:
        length, ids = self._length, np.concatenate(self._ids)
        pos, cost = self._boundaries(ids)
        best, back = least_cuts(pos.tolist(), cost.tolist(), length)
        near = int(np.searchsorted(pos, len(ids) - length))
        left = len(ids) - pos[near:]
        price = np.array(best[near:])
        if final:
            parts = np.array([max(int(x).bit_count() - 1, 0) for x in left]) * INSIDE_CUT
            pad = np.where(left > 0, length - left, 0)
            price = price + np.minimum(parts, pad)
        last = near + int(len(price) - 1 - np.argmin(price[::-1]))
        cuts = []
        while last:
            cuts.append(int(pos[last]))
            last = back[last]
        cuts = [0, *reversed(cuts)]
        if final and (tail := len(ids) - cuts[-1]):
            sizes = [1 << b for b in reversed(range(tail.bit_length())) if tail >> b & 1]
            if (len(sizes) - 1) * INSIDE_CUT >= length - tail:
                sizes = [tail]
            cuts += (cuts[-1] + np.cumsum(sizes)).tolist()
        return self._settled(ids, np.array(cuts, np.int64))

    def _settled(self, ids: np.ndarray, cuts: np.ndarray) -> tuple:
        """The pieces up to the last cut; the ids behind it stay."""
        end = int(cuts[-1])
        docs, starts, sizes, totals = zip(*self._runs)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        edges = np.unique(np.concatenate([cuts, begins[begins < end]]))
        a, b = edges[:-1], edges[1:]
        run = np.searchsorted(ends, a, "right")
        window = np.searchsorted(cuts, a, "right") - 1
        wide = memoryview(ids.astype("<u4", copy=False)).cast("B")
        crc = [zlib.crc32(wide[4 * x : 4 * y]) for x, y in zip(a.tolist(), b.tolist())]
        out = ([docs[k] for k in run.tolist()], np.array(starts)[run] + a - begins[run], b - a, np.array(crc, np.int64), np.array(totals, np.int64)[run], self._sequence + window, a - cuts[window])
        self._sequence += len(cuts) - 1
        keep = int(np.searchsorted(ends, end, "right"))
        self._runs = [(d, int(s + max(end - o, 0)), int(n - max(end - o, 0)), t) for d, s, n, t, o in zip(docs[keep:], starts[keep:], sizes[keep:], totals[keep:], begins[keep:].tolist())]
        self._ids = [ids[end:].copy()] if end < len(ids) else []
        self._held = len(ids) - end
        return out


def pack(df: DataFrame, tokenizer_path: str, length: int = LENGTH, end_id: int = 1, id_column: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row per piece of a document.

    Every row of `df` is a document of its own: its text's ids (no special tokens added), then `end_id`. A null text counts
    as empty and so is `end_id` alone; null and repeated ids are packed like others. Documents of a partition keep their
    order. Sequences are numbered by partition and place, so the numbers are unique but not gapless. Ties between cuts of
    the same cost go to the earlier start of a window. Extra columns are ignored; an empty table gives an empty table. The
    file is read on the driver and travels as a broadcast (its size is that of a vocabulary).
    """
    if length & (length - 1) or length < 1:
        raise ValueError("length must be a power of two")
    id_type = dict(df.dtypes)[id_column]
    if id_type not in _ID_TYPES:
        raise ValueError(f"ids of type {id_type} are not supported; cast them first")
    with open(tokenizer_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())
    kind = _ID_TYPES[id_type]
    names = [id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            encoder = _encoder(model.value)
            closing = np.array([end_id], np.uint32)
            packer = Packer(encoder, length, block_tokens, TaskContext.get().partitionId() << LOCAL_BITS)

            def settled() -> Iterator[tuple]:
                for batch in batches:
                    for doc, said in zip(batch.column(0).to_pylist(), batch.column(1)):
                        yield from packer.add(doc, np.append(encoder.encode(said.as_py() or ""), closing))
                yield from packer.rest()

            for docs, *numbers in settled():
                yield pa.RecordBatch.from_arrays([pa.array(docs, kind), *[pa.array(x, pa.int64()) for x in numbers]], names)

    return df.select(id_column, text).mapInArrow(packed, f"`{id_column}` {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")
