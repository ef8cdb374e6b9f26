"""Substring dedup by content-defined chunking.

A gear hash rolls over the bytes; a chunk ends where the hash's high bits are
zero, so boundaries depend on the 32 bytes before them and come back in step
after an insertion.  Chunks are named by a 128-bit digest, and every
occurrence but the first (in document order, then position) is removed.

Within a batch only the first occurrence of a chunk is sent on; the others are
known to be later copies.  A chunk that half of all documents hold therefore
reaches its part once per batch, not once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .keyed import buckets, doc_id, keyed, once, per_owner, unflag, with_flags
from .shared import byte_slices, dealt, lean, trim

#: Bytes the gear hash looks back; no chunk that ends at a boundary is shorter.
WINDOW = 32
#: Boundary: this many high bits are zero (one place in 2^BITS).
BITS = 5
LONGEST = 512
#: Bytes of text whose chunks a part decides on.
PART = 4 << 20
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint64).astype(np.uint32)
FLAG = np.dtype([("chunk", "<i8")])


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places after which a chunk may end (as end positions), whatever the documents.

    The sum of the last 32 gears, each shifted once more per byte, is built by
    doubling: five passes.  Places less than 32 bytes into a document would see
    the one before, but no chunk ends there.
    """
    h = GEAR[data]
    n = 1
    while n < WINDOW:
        longer = h.copy()
        longer[n:] += h[:-n] << np.uint32(n)
        h, n = longer, 2 * n
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def cuts(ends: list[int], n: int) -> list[int]:
    """Chunk ends of a document of ``n`` bytes from its possible ends (ascending)."""
    out, last = [], 0
    for e in ends:
        while e - last > LONGEST:
            last += LONGEST
            out.append(last)
        if e - last >= WINDOW:
            out.append(e)
            last = e
    while n - last > LONGEST:
        last += LONGEST
        out.append(last)
    if out and 0 < n - last < WINDOW:
        out[-1] = n  # a short end belongs to the chunk before it
    elif n > last:
        out.append(n)
    return out


def chunks(offsets: np.ndarray, data: np.ndarray) -> Iterator[list[int]]:
    """Per document of a slice: chunk ends relative to the document."""
    ends = boundaries(data) if len(data) else np.empty(0, np.int64)
    where = np.searchsorted(ends, offsets, "right")
    for i in range(len(offsets) - 1):
        own = ends[where[i] : where[i + 1]] - offsets[i]
        yield cuts(own.tolist(), int(offsets[i + 1] - offsets[i]))


def chunk_flags(rows: DataFrame) -> DataFrame:
    """(k, c, flags): packed numbers of the chunks to remove, in any number of rows per document.

    ``k`` and ``c`` are never null on the way: pandas would make floats of them, which do not hold every id.
    """
    parts, tasks = buckets(rows, PART)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, batch in enumerate(batches):
            ks, cs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            digests, docs, numbers = [], [], []
            for first, offsets, data in byte_slices(batch.column(2), 2 << 20):
                raw = data.tobytes()
                for i, ends in enumerate(chunks(offsets, data)):
                    at, last = int(offsets[i]), 0
                    for j, e in enumerate(ends):
                        if e - last >= WINDOW or len(ends) == 1:
                            digests.append(xxhash.xxh3_128_digest(raw[at + last : at + e]))
                            docs.append(first + i)
                            numbers.append(j)
                        last = e
            if not digests:
                continue
            d = np.frombuffer(b"".join(digests), [("hi", "<u8"), ("lo", "<u8")])
            doc, number = np.array(docs), np.array(numbers)
            order = np.lexsort((number, ks[doc], d["lo"], d["hi"]))
            d, doc, number = d[order], doc[order], number[order]
            new = np.ones(len(d), bool)
            new[1:] = d[1:] != d[:-1]
            # the same place again (a repeated row) is not a later copy
            lead = np.maximum.accumulate(np.where(new, np.arange(len(d)), 0))
            same = (ks[doc] == ks[doc[lead]]) & (number == number[lead])
            later = ~same
            out = {"bucket": [], "k": [], "c": [], "digests": [], "ks": [], "cs": [], "flags": []}
            for k, c, f in zip(*per_owner(ks[doc[later]], cs[doc[later]], number[later].astype(FLAG)), strict=True):
                row = ((k ^ c) % parts, k, c, None, None, None, f)
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
            d, doc, number = d[same], doc[same], number[same]
            for p, own in dealt((d["lo"] % np.uint64(parts)).astype(np.int64)):
                row = (p, 0, 0, d[own].tobytes(), ks[doc[own]].tobytes(), cs[doc[own]].tobytes(), number[own].astype(FLAG).tobytes())
                for name, v in zip(out, row, strict=True):
                    out[name].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        known = rows[rows["digests"].isna()]
        sent = rows[rows["digests"].notna()]
        d = np.frombuffer(b"".join(sent["digests"]), [("hi", "<u8"), ("lo", "<u8")])
        k, c = np.frombuffer(b"".join(sent["ks"]), "<i8"), np.frombuffer(b"".join(sent["cs"]), "<i8")
        number = np.frombuffer(b"".join(sent["flags"]), FLAG)
        order = np.lexsort((number["chunk"], k, d["lo"], d["hi"]))
        d, k, c, number = d[order], k[order], c[order], number[order]
        lead = np.arange(len(d))
        if len(d):
            new = np.ones(len(d), bool)
            new[1:] = d[1:] != d[:-1]
            lead = np.maximum.accumulate(np.where(new, lead, 0))
        later = (k != k[lead]) | (number["chunk"] != number["chunk"][lead])
        a, b, f = per_owner(k[later], c[later], number[later])
        trim()
        return pd.DataFrame(
            {"k": np.array([*known["k"], *a], np.int64), "c": np.array([*known["c"], *b], np.int64), "flags": [*known["flags"], *f]}
        )

    sent = rows.mapInArrow(lean(deal), "bucket long, k long, c long, digests binary, ks binary, cs binary, flags binary")
    return sent.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(decide, "k long, c long, flags binary")


def chunk_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, n_bytes, n_chunks, n_removed_chunks, n_removed, kept): what is left of every text.

    A chunk is removed if an equal one comes earlier, by (id, position).  It has
    32 bytes or more, as a shorter end belongs to the chunk before it, or is a
    whole text.  A chunk ends after ``LONGEST`` bytes at the latest (31 more at
    the end of a text).  Null texts are
    empty; a null id comes last; rows that share an id are ordered by position
    alone; repeated rows get equal results; no rows give an empty result.
    Ids must be of an integer type.
    ``kept`` is binary: removal may split a character.
    """
    rows = keyed(docs, id_col, text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, flags = batch.schema.names, batch.column("flags")
            out: list[list] = [[], [], [], [], []]
            for first, offsets, data in byte_slices(batch.column("text"), 2 << 20):
                raw = data.tobytes()
                for i, ends in enumerate(chunks(offsets, data)):
                    at, whole = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                    gone = np.unique(unflag(flags, first + i, FLAG)["chunk"])
                    text = raw[at : at + whole]
                    kept = text
                    if len(gone):
                        drop, last, parts = set(gone.tolist()), 0, []
                        for j, e in enumerate(ends):
                            if j not in drop:
                                parts.append(text[last:e])
                            last = e
                        kept = b"".join(parts)
                    for column, v in zip(out, (whole, len(ends), len(gone), whole - len(kept), kept), strict=True):
                        column.append(v)
            arrays = [batch.column(names.index("k")), *[pa.array(v, pa.int64()) for v in out[:4]], pa.array(out[4], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", "kept"])

    schema = "k long, n_bytes long, n_chunks long, n_removed_chunks long, n_removed long, kept binary"
    return with_flags(rows, chunk_flags(once(rows))).mapInArrow(lean(apply), schema)


def op10_chunk_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_chunks, n_removed_chunks, n_removed, kept_sha256)."""
    return chunk_dedup(docs).select(
        doc_id(), "n_bytes", "n_chunks", "n_removed_chunks", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


__all__ = ["chunk_dedup", "op10_chunk_dedup"]
