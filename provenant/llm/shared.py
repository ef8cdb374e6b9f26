"""Helpers that several corpus operators use."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, release

#: White space between words: space and the controls 9 to 13.
SPACES = b" \t\n\r\x0b\x0c"


def trim() -> None:
    """Give freed memory of this Python process back: a worker lives on, idle, after its task."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(fn: Callable) -> Callable:
    """``fn`` over batches; memory is given back at the end of the task."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            trim()

    return run


#: Arrays that a task of :func:`folded` combines.
FAN = 4


def folded(rows: DataFrame, column: str, fold: Callable[[np.ndarray | None, pa.Array], np.ndarray], add: Callable, kind: str) -> np.ndarray | None:
    """One array of a fixed size from all rows: each task folds its own into one, and these are combined in a tree.

    No task or driver holds more than a few of them.  ``fold`` takes the array
    so far (None first) and a batch's column; ``add`` combines two in place.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            total = fold(total, batch.column(0))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column(0):
                more = np.frombuffer(blob.as_py(), kind)
                total = more.copy() if total is None else add(total, more)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["part"])

    now = materialize(rows.select(column).mapInArrow(lean(own), "part binary"), "folded")
    while (n := now.count()) > 1:
        before, now = now, materialize(now.repartition(-(-n // FAN)).mapInArrow(both, "part binary"), "folded")
        release(before)
    got = now.collect()  # one row, of the array's size
    release(now)
    return np.frombuffer(got[0][0], kind) if got else None


#: Bits of a filter of 64-bit values (fixed, so its broadcast is): what passes is checked by a join.
FILTER_BITS = 26


def _bit(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    slot = mix64(values.view(np.uint64)) >> np.uint64(64 - FILTER_BITS)
    return (slot >> np.uint64(3)).astype(np.int64), (slot & np.uint64(7)).astype(np.uint8)


def value_filter(rows: DataFrame, column: str) -> np.ndarray:
    """A bit array that has every value of a column of longs."""

    def mark(total: np.ndarray | None, values: pa.Array) -> np.ndarray:
        total = np.zeros(1 << FILTER_BITS - 3, np.uint8) if total is None else total
        at, bit = _bit(values.to_numpy(zero_copy_only=False))
        np.bitwise_or.at(total, at, np.uint8(1) << bit)
        return total

    got = folded(rows, column, mark, lambda a, b: np.bitwise_or(a, b, out=a), "u1")
    return np.zeros(1 << FILTER_BITS - 3, np.uint8) if got is None else got


def may_hold(held: np.ndarray, values: np.ndarray) -> np.ndarray:
    """False where a value is surely not in the filter."""
    at, bit = _bit(values)
    return (held[at] >> bit & 1).astype(bool)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in views of few rows: what is made of one is handed on before the next."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; null has none.  ``bytes.split`` splits on exactly these."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").split()


def byte_slices(column: pa.Array, limit: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) over runs of rows of about ``limit`` bytes; null is empty.

    The arrays are views of the batch: no string object is made.  A longer text
    is a run of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        last = min(last, n)
        yield first, offsets[first : last + 1] - offsets[first], raw[offsets[first] : offsets[last]]
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def runs_of(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal neighbours."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(sorted_keys)]))


def dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, positions in it) of the buckets that occur, however many there are."""
    order = np.argsort(bucket, kind="stable")
    for a, b in zip(*runs_of(bucket[order]), strict=True):
        yield int(bucket[order[a]]), order[a:b]


def split_by(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): ``order[bounds[b]:bounds[b+1]]`` are the positions in bucket b."""
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(n + 1))


def renamed_free(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns: extra ones, whatever they are called, cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def aside(docs: DataFrame, *own: str) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """(the columns ``own``, as far as ``docs`` has them, with all others in one struct; a function that puts the columns back).

    Inside the struct no name can clash with what an operator adds, whatever it
    is.  The function takes a result that still has these columns, names not to
    put back, and names to add at the end.
    """
    have = [n for n in own if n in docs.columns]
    rest = [n for n in docs.columns if n not in have]
    packed = docs.select(*have, F.struct(*[F.col(f"`{n}`").alias(n) for n in rest]).alias("_rest")) if rest else docs

    def restore(df: DataFrame, without: tuple[str, ...] = (), add: tuple[str, ...] = ()) -> DataFrame:
        names = [n for n in docs.columns if n not in without]
        return df.select(*[F.col(n) if n in have else F.col("_rest").getField(n).alias(n) for n in names], *add)

    return packed, restore
