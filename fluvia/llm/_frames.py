"""Small helpers on DataFrames that the operators share."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes up to which a table may be broadcast; beyond, the same join is left to a shuffle. A row counts ROW_BYTES, which
#: is what a hashed row of numbers takes, and the bytes of its texts.
BROADCAST_BYTES = 48_000_000
ROW_BYTES = 96
#: The C library's name for the largest number of its heaps.
_ARENA_MAX = -8
#: Rows of one Arrow batch of texts, on either side of a Python worker.
TEXT_BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow batches of texts hold fewer rows than Spark's default, if the session still has that: documents are far
    longer than the rows the default is meant for, and both the JVM and Python hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) == 10_000:
        spark.conf.set(key, str(TEXT_BATCH_ROWS))


@contextmanager
def released() -> Iterator[None]:
    """Gives memory that a task no longer needs back to the system when the task is done, and lets the threads of a library
    share their heaps: Python workers are used again, and what they merely keep counts against the executor all the same."""
    try:
        library = ctypes.CDLL(None)
        with suppress(AttributeError):  # not every C library can
            library.mallopt(_ARENA_MAX, 2)
        yield
    finally:
        pa.default_memory_pool().release_unused()
        with suppress(AttributeError):
            library.malloc_trim(0)


def join_checked(left: DataFrame, right: DataFrame, on: list[str] | str, how: str, limit: int | None = None) -> DataFrame:
    """A join whose right side is broadcast only if its measured bytes are few; otherwise Spark shuffles both sides."""
    limit = BROADCAST_BYTES if limit is None else limit
    size = F.lit(ROW_BYTES)
    for name, kind in right.dtypes:
        if kind not in ("bigint", "int", "double", "boolean"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`").cast("string")), F.lit(0))
    taken = right.limit(limit // ROW_BYTES + 1).agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]
    return left.join(F.broadcast(right) if taken <= limit else right, on, how)


def local_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A small table from the driver. As Arrow columns it needs no Python worker on the executors."""
    return spark.createDataFrame(pa.table(columns))


def learning_row(id_column: str, modulus: int):
    """crc32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


def summed_vector(df: DataFrame, columns: list[str], count: Callable[[pa.RecordBatch, np.ndarray], None], size: int) -> np.ndarray:
    """The sum over all rows of a vector of `size` whole numbers, to which `count` adds what each batch holds.

    Each task adds its batches up and emits the blocks that are not all zero, compressed; blocks are added up in a second
    round, as a stream. What reaches the driver is the one vector, whatever the number of rows.
    """
    block = 1 << 14
    blocks = -(-size // block)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with released():
            total = np.zeros(size, np.int64)
            for batch in batches:
                if batch.num_rows:
                    count(batch, total)
            packed = [(k, _packed(part)) for k in range(blocks) if (part := total[k * block : (k + 1) * block]).any()]
            del total
        yield pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in packed], pa.int32()), "counts": pa.array([x for _, x in packed], pa.binary())})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = _unpacked(counts)
                sums.setdefault(k, np.zeros(block, np.int64))[: len(part)] += part
        yield pa.RecordBatch.from_pydict({"block": pa.array(list(sums), pa.int32()), "total": pa.array([_packed(x) for x in sums.values()], pa.binary())})

    parts = df.select(*columns).mapInArrow(partial, "block int, counts binary")
    out = np.zeros(blocks * block, np.int64)
    for row in parts.repartition(8, "block").mapInArrow(added, "block int, total binary").collect():
        out[row.block * block : (row.block + 1) * block] += _unpacked(row.total)
    return out[:size]


def _packed(counts: np.ndarray) -> bytes:
    """Whole numbers as few bytes: the narrowest type, then the fastest compression."""
    width = next(w for w in (1, 2, 4, 8) if counts.max() < 1 << (8 * w - (w == 8)))
    return bytes([width]) + zlib.compress(counts.astype(f"<u{width}").tobytes(), 1)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[0]}").astype(np.int64)
