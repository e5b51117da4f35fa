"""Token counts: lengths only, by the tokenizer's own library, in Arrow functions.

A text is split at safe boundaries: before a single blank between two characters that are no white space. No match of
the byte-level pattern, and no special string, spans such a place, so the counts of the pieces add up to the count of
the text. Pieces that a worker has not met before are encoded in batches of bounded bytes; the counts of the others are
looked up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import arrow_udf

#: Bytes that one call of the library gets, unless one piece is longer.
BATCH_BYTES = 1_000_000
#: The same for batches of short pieces, whose encodings take far more room than their text.
PIECE_BYTES = 200_000
#: Pieces whose counts a worker keeps of either generation.
KEPT_PIECES = 250_000

_WIDE = re.compile(r" \s|\s ")
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def pieces(text: str) -> list[str]:
    """The text cut at its safe boundaries; the pieces joined are the text."""
    if _WIDE.search(text) or text[:1] == " " or text[-1:] == " ":
        return _SAFE.split(text)
    first, *rest = text.split(" ")
    return [first, *[" " + x for x in rest]]


def by_bytes(texts: list[str], limit: int = BATCH_BYTES) -> Iterator[list[str]]:
    """Runs of texts, each of at most `limit` UTF-8 bytes unless it is one text."""
    run, size = [], 0
    for text in texts:
        more = len(text) if text.isascii() else len(text.encode())
        if run and size + more > limit:
            yield run
            run, size = [], 0
        run.append(text)
        size += more
    if run:
        yield run


class Memory:
    """Two generations of a mapping of bounded size: what is asked for again stays, the rest goes with the older one."""

    def __init__(self, limit: int):
        self.young: dict = {}
        self._old: dict = {}
        self._limit = limit

    def missing(self, keys: Iterable) -> list:
        """Those keys that neither generation knows; the others are young after this."""
        young, old, out = self.young, self._old, []
        for key in keys:
            if key not in young:
                if key in old:
                    young[key] = old[key]
                else:
                    out.append(key)
        return out

    def turn(self) -> None:
        """Makes the young generation the old one once it has reached its size."""
        if len(self.young) > self._limit:
            self._old, self.young = self.young, {}


def counter(kind: str, model: bytes) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts by the library of the file's kind, without begin, end or added special tokens."""
    if kind == "model":
        import sentencepiece

        processor = sentencepiece.SentencePieceProcessor(model_proto=model)
        return lambda texts: [len(x) for run in by_bytes(texts) for x in processor.encode(run, num_threads=1)]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_buffer(model)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    memory = Memory(KEPT_PIECES)

    def count(texts: list[str]) -> list[int]:
        out = []
        for run in by_bytes(texts):
            cuts = [pieces(text) for text in run]
            for new in by_bytes(memory.missing(dict.fromkeys(chain.from_iterable(cuts))), PIECE_BYTES):
                memory.young.update(zip(new, map(len, tokenizer.encode_batch_fast(new, add_special_tokens=False))))
            out += [sum(map(memory.young.__getitem__, cut)) for cut in cuts]
            memory.turn()
        return out

    return count if _splits_safely(tokenizer) else lambda texts: [len(x) for run in by_bytes(texts) for x in tokenizer.encode_batch_fast(run, add_special_tokens=False)]


def _splits_safely(tokenizer) -> bool:
    """Whether the file is the plain byte-level kind, for which the boundaries above are safe."""
    first = tokenizer.pre_tokenizer
    specials = tokenizer.get_added_tokens_decoder().values()
    return tokenizer.normalizer is None and type(first).__name__ == "ByteLevel" and first.use_regex and not first.add_prefix_space and not any(" " in x.content or x.lstrip or x.rstrip or x.single_word for x in specials)


def token_counts(df: DataFrame, tokenizer_path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) for every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each. Existing columns of the three names
    are replaced; an empty table gives an empty table. The file is read on the driver and travels as a broadcast (its
    size is that of a vocabulary).
    """
    with open(tokenizer_path, "rb") as file:
        model = df.sparkSession.sparkContext.broadcast(file.read())
    kind = tokenizer_path.rpartition(".")[2]

    @arrow_udf("bigint")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = counter(kind, model.value)
        for column in batches:
            yield pa.array(count([x or "" for x in column.to_pylist()]), pa.int64())

    value = F.coalesce(F.col(text), F.lit(""))
    return df.withColumns({"n_bytes": F.octet_length(value).cast("long"), "n_tokens": lengths(value)}).withColumn("over_limit", F.col("n_tokens") > limit)
