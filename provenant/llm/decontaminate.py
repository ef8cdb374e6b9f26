"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

A short item inside a long document has a tiny Jaccard similarity, so plain
MinHash would miss it.  Here items are partitioned by their number of
shingles, and for each partition documents are cut to blocks of a few times
that size.  A one-permutation MinHash splits the hash space into bins and
keeps the least hash of each bin; an item and a block agree in a bin if their
least hashes are equal.  A shingle that both hold disagrees only if another
shingle of the block falls in its bin with a smaller hash, which has a chance
under block / (2 bins).  An item at the threshold shares ``t * n`` shingles,
and one agreement anywhere in the document suffices, so it is missed with a
probability under (block / (2 bins)) ^ (t * n).  Bins are chosen per partition
to hold that under ``miss``, whatever the sizes.

Candidates are then verified by exact containment of the item's shingles in
the whole document.

A benchmark of up to ``BLOCK`` shingles is broadcast: one pass over the
documents, which do not move.  A larger one is joined: documents hand on the
minima that a filter of a fixed size lets through, signatures meet them in a
shuffle, and only documents and items of candidate pairs are looked at again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .shared import aside, lean, may_hold, mix64, value_filter
from .simhash import lowered_words, shingles

WIDTH, THRESHOLD, MISS = 5, 0.8, 1e-12
#: Shingles of benchmark items that may be broadcast; a larger benchmark is joined.
BLOCK = 1 << 20


def hashes(text: str | None, width: int) -> np.ndarray:
    """64-bit hashes of all shingles in order; fewer words than ``width``: the whole sequence."""
    parts = shingles(lowered_words(text), width)
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in parts), np.uint64, len(parts))


def size_class(n: int) -> int:
    """Items of 2^c to 2^(c+1) - 1 shingles share class c."""
    return max(n, 1).bit_length() - 1


def bins_of(c: int, threshold: float, miss: float) -> tuple[int, int]:
    """(block length, log2 of the number of bins) for items of class c."""
    shared = max(1, math.ceil(threshold * 2**c))
    block = 4 * 2 ** (c + 1)
    return block, math.ceil(math.log2(block / 2) - math.log2(miss) / shared)


class Signatures:
    """The items of a broadcast benchmark: bin minima by class, and exact shingle sets."""

    def __init__(self, sets: list[np.ndarray], threshold: float, miss: float):
        self.threshold, self.sets = threshold, sets
        classes: dict[int, list[int]] = {}
        for key, own in enumerate(sets):
            classes.setdefault(size_class(len(own)), []).append(key)
        self.by_class = []
        for c, members in classes.items():
            block, bits = bins_of(c, threshold, miss)
            mins = [bin_minima(sets[key], bits) for key in members]
            keys = np.repeat(members, [len(m) for m in mins])
            mins = np.concatenate(mins)
            order = np.argsort(mins, kind="stable")
            self.by_class.append((block, bits, mins[order], keys[order]))

    def matches(self, own: np.ndarray) -> list[tuple[int, int, int]]:
        """(place of item, shared shingles, item shingles) of every item contained in the document's shingles."""
        found: set[int] = set()
        for block, bits, mins, keys in self.by_class:
            at = np.searchsorted(mins, own)
            hit = np.flatnonzero(mins[np.minimum(at, len(mins) - 1)] == own)
            for b in np.unique(hit // block).tolist():  # only blocks that hold a signature value can agree
                least = bin_minima(own[b * block : (b + 1) * block], bits)
                lo, hi = np.searchsorted(mins, least, "left"), np.searchsorted(mins, least, "right")
                for x, y in zip(lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                    found.update(keys[x:y].tolist())
        whole = np.unique(own)
        out = [(key, shared_count(whole, self.sets[key]), len(self.sets[key])) for key in sorted(found)]
        return [x for x in out if x[1] >= self.threshold * x[2] - 1e-9]


def shared_count(whole: np.ndarray, mine: np.ndarray) -> int:
    at = np.minimum(np.searchsorted(whole, mine), len(whole) - 1)
    return int((whole[at] == mine).sum())


def bin_minima(own: np.ndarray, bits: int) -> np.ndarray:
    """The shingle of least hash in every non-empty bin; a bin is the high bits of a mix, the order its low ones."""
    mixed = mix64(own)
    if bits >= 63:
        return np.unique(own)
    order = np.argsort(mixed)
    top = mixed[order] >> np.uint64(64 - bits)
    head = np.ones(len(own), bool)
    head[1:] = top[1:] != top[:-1]
    return own[order][head]


def item_sets(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item, size, hashes): the distinct shingles of every row with an id and a word, hashed on the executors; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.unique(hashes(t.as_py(), width)) for t in batch.column(1)]
            arrays = [batch.column(0), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["item", "size", "hashes"])

    kind = dict(benchmark.dtypes)[id_col]
    rows = benchmark.select(F.col(f"`{id_col}`").alias("item"), F.col(f"`{text_col}`").alias("text")).filter("item IS NOT NULL")
    return materialize(rows.mapInArrow(run, f"item {kind}, size long, hashes binary").filter("size > 0").distinct(), "items")


def _small(items: DataFrame, block: int) -> bool:
    return (items.agg(F.sum("size")).first()[0] or 0) <= block


def _broadcast(items: DataFrame, threshold: float, miss: float):
    """(broadcast signatures, broadcast item ids) of items of a checked size."""
    got = items.select("item", "hashes").toArrow()
    sets = [np.frombuffer(x.as_py(), np.uint64) for x in got["hashes"]]
    context = items.sparkSession.sparkContext
    return context.broadcast(Signatures(sets, threshold, miss)), context.broadcast(got["item"].combine_chunks())


def _pairs_by_join(rows: DataFrame, items: DataFrame, width: int, threshold: float, miss: float) -> DataFrame:
    """(d, item, n_shared, n_item) over (d, text): a benchmark that is too large to broadcast; written."""
    kind = dict(items.dtypes)["item"]
    classes = sorted({size_class(r[0]) for r in items.select("size").distinct().collect()})  # a few dozen sizes' logarithms
    with scratch() as keep:

        def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                least = []
                for blob in batch.column(1):
                    own = np.frombuffer(blob.as_py(), np.uint64)
                    least.append(bin_minima(own, bins_of(size_class(len(own)), threshold, miss)[1]))
                at = np.repeat(np.arange(len(least)), [len(x) for x in least])
                values = np.concatenate([np.empty(0, np.uint64), *least]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), batch.column(0).take(pa.array(at))], names=["value", "s"])

        named = materialize(items.withColumn("s", F.xxhash64("item", "hashes")), "named")
        signed = materialize(named.select("s", "hashes").mapInArrow(lean(signatures), "value long, s long"), "signatures")
        held = rows.sparkSession.sparkContext.broadcast(value_filter(signed, "value"))

        def minima(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out, at = [np.empty(0, np.uint64)], []
                for i, text in enumerate(batch.column(1)):
                    own = hashes(text.as_py(), width)
                    hit = np.flatnonzero(may_hold(held.value, own))
                    found = [np.empty(0, np.uint64)]
                    for block, bits in {bins_of(c, threshold, miss) for c in classes}:
                        for b in np.unique(hit // block).tolist():
                            found.append(np.intersect1d(bin_minima(own[b * block : (b + 1) * block], bits), own[hit]))
                    out.append(np.unique(np.concatenate(found)))
                    at += [i] * len(out[-1])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(np.concatenate(out).view(np.int64))], names=["d", "value"])

        dealt = rows.select("d", "text").mapInArrow(lean(minima), "d long, value long").distinct()
        candidates = materialize(dealt.join(signed, "value").select("d", "s").distinct(), "candidates")
        wanted = materialize(candidates.select(F.col("d").alias("_d")).distinct(), "wanted")
        texts = rows.join(wanted.hint("shuffle_hash"), F.col("d") == F.col("_d"), "left_semi").select("d", "text").dropDuplicates(["d"])

        def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                blobs = [np.unique(hashes(t.as_py(), width)).tobytes() for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], names=["d", "whole"])

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                both = zip(batch.column(2), batch.column(3), strict=True)
                n = [shared_count(np.frombuffer(a.as_py(), np.uint64), np.frombuffer(b.as_py(), np.uint64)) for a, b in both]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["d", "s", "n_shared"])

        whole = materialize(texts.mapInArrow(lean(sets_of), "d long, whole binary"), "documents")
        checked = candidates.join(whole, "d").join(named.select("s", "hashes"), "s").select("d", "s", "whole", "hashes")
        checked = materialize(checked.mapInArrow(lean(verify), "d long, s long, n_shared long"), "checked")
        out = checked.join(named.select("s", "item", F.col("size").alias("n_item")), "s").filter(F.col("n_shared") >= threshold * F.col("n_item") - 1e-9)
        best = F.max_by(F.struct("n_shared", "n_item"), F.struct(F.col("n_shared") / F.col("n_item"), "n_shared")).alias("b")
        return keep(materialize(out.groupBy("d", "item").agg(best).select("d", F.col("item").cast(kind).alias("item"), "b.*"), "found"))


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", short_from: int | None = None,
) -> DataFrame:
    """(id_col, item_col, n_shared, n_item, containment): a row per document and item whose shingles,
    as sets, are in the document to at least ``threshold``.

    Words are compared with A-Z lowered.  An item or document of fewer than
    ``width`` words is its whole sequence; with ``short_from``, items of so many
    words and more (but under ``width``) are also looked for inside documents, by
    shingles of their own length, which common phrases can make too eager.  Null
    and empty texts match nothing, as does a null item id; rows that repeat an
    item id are separate texts of it and the best counts; repeated documents
    repeat; a null document id is kept.  Ids may be of any type.

    A benchmark of at most ``block`` shingles is broadcast; a larger one joined.
    """
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_col]
    out = None
    for w, part in _by_width(benchmark, width, item_col, item_text, short_from):
        found = _contamination(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), part, w, threshold, miss, block)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = docs.sparkSession.createDataFrame([], f"id {kinds[0]}, item {kinds[1]}, n_shared long, n_item long")
    out = out.withColumn("containment", F.col("n_shared") / F.col("n_item"))
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def _by_width(benchmark: DataFrame, width: int, item_col: str, item_text: str, short_from: int | None = None) -> list[tuple[int, DataFrame]]:
    """(words of a shingle, items that are searched by it): with ``short_from``, shorter items have shingles of their own length."""
    if short_from is None:
        return [(width, item_sets(benchmark, width, item_col, item_text))]
    clean = F.btrim(F.coalesce(F.col(f"`{item_text}`"), F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    n = F.when(clean == "", 0).otherwise(F.size(F.split(clean, "[ \\t\\n\\x0B\\f\\r]+", -1)))
    some = benchmark.withColumn("_width", F.when(n >= short_from, F.least(n, F.lit(width))).otherwise(width))
    widths = sorted(r[0] for r in some.select("_width").distinct().collect() if r[0])  # at most ``width`` of them
    return [(w, item_sets(some.filter(F.col("_width") == w), w, item_col, item_text)) for w in widths]


def _contamination(rows: DataFrame, items: DataFrame, width: int, threshold: float, miss: float, block: int) -> DataFrame:
    kind, item_kind = dict(rows.dtypes)["id"], dict(items.dtypes)["item"]
    if not _small(items, block):
        rows = rows.withColumn("d", F.xxhash64("id", "text"))
        found = _pairs_by_join(rows, items, width, threshold, miss)
        return rows.select("id", "d").join(found, "d").select("id", "item", "n_shared", "n_item")
    signatures, names = _broadcast(items, threshold, miss)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, item, shared, size = [], [], [], []
            for i, text in enumerate(batch.column(1)):
                own = hashes(text.as_py(), width)
                best: dict = {}
                for key, n, of in signatures.value.matches(own) if len(own) else []:
                    name = names.value[key]
                    if name not in best or n * best[name][2] > best[name][1] * of:
                        best[name] = (key, n, of)
                for key, n, of in best.values():
                    at.append(i)
                    item.append(key)
                    shared.append(n)
                    size.append(of)
            ids = batch.column(0).take(pa.array(at, pa.int32()))
            arrays = [ids, names.value.take(pa.array(item, pa.int64())), pa.array(shared, pa.int64()), pa.array(size, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "item", "n_shared", "n_item"])

    return rows.mapInArrow(lean(run), f"id {kind}, item {item_kind}, n_shared long, n_item long")


def op8_benchmark_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contaminated pairs (doc_id, item_id, n_shared, n_item, containment): five-word shingles, 0.8 and more."""
    return contamination(docs, benchmark)


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``docs`` without the contaminated ones; with a broadcast benchmark there is no join and texts do not move.

    All columns are kept, whatever their names; null and empty texts are clean.
    """
    out, restore = aside(docs, "doc_id", "text")
    schema = out.schema
    for w, items in _by_width(benchmark, width, "item_id", "text"):
        if not _small(items, block):
            named = out.withColumn("_d", F.xxhash64("doc_id", "text"))
            found = _pairs_by_join(named.select(F.col("_d").alias("d"), "text"), items, w, threshold, MISS)
            gone = found.select(F.col("d").alias("_gone")).distinct().hint("shuffle_hash")
            out = named.join(gone, F.col("_d") == F.col("_gone"), "left_anti").drop("_d")
            continue
        signatures, _ = _broadcast(items, threshold, MISS)

        def run(batches: Iterator[pa.RecordBatch], signatures=signatures, w=w) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                own = (hashes(t.as_py(), w) for t in texts)
                yield batch.filter(pa.array([not (len(h) and signatures.value.matches(h)) for h in own], pa.bool_()))

        out = out.mapInArrow(lean(run), schema)
    return restore(out)
