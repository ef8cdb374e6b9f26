"""Byte-exact substring dedup on Burrows-Wheeler transforms.

A byte goes if a string of ``length`` bytes that covers it also starts in an
earlier document.

1. *Anchors.*  The least hash among the ``SEED``-byte strings inside a window of
   ``length`` bytes depends on the window alone, so equal windows have equal
   anchors.  A run of windows with one anchor is a segment.  Strings that would be
   anchors of very many segments are found by counting all of them and come last
   in the order, so a common phrase is an anchor only where there is no other.
   Anchors seen in two documents are found first; other segments cannot repeat and stay at home.
2. *Parts.*  Segments travel to the part of their anchor, so all copies of a
   window meet in one part, whichever documents hold them.
3. *Intervals.*  A part's distinct segments are joined to one string; its
   suffixes are ordered, and intervals of the transform are expanded breadth
   first by backward extension.  Level l closes exactly the boundaries whose
   common prefix is l, and expansion stops at ``length``: what is still open
   then are the suffixes that share ``length`` bytes or more.  Each such interval
   has a least document; windows of later documents in it are removed.

Within a batch a segment is sent once, with its least document; other documents
of the batch that hold it are known to be later copies.  A passage that a third
of all documents hold reaches its part once per batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .keyed import LAST, buckets, distinct_rows, doc_id, keyed, per_owner, unflag, with_flags
from .shared import byte_slices, dealt, folded, lean, mix64, runs_of, split_by, trim

#: Bytes of the strings that anchors are hashes of.
SEED = 20
#: Bytes whose windows are looked at together; longer texts pass piece by piece.
PIECE = 1 << 20
BYTES = np.random.default_rng(50).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that a part stands for.
PART = 1 << 20
#: Counters of the sketch of anchors (fixed, so its broadcast is), and segments of one anchor that make it hot.
SKETCH_BITS, HOT = 20, 10_000
STEP = np.uint64(0x9E3779B97F4A7C15)
RUN = np.dtype([("start", "<i8"), ("end", "<i8")])
PLACE = np.dtype([("segment", "<u4"), ("c", "<u4"), ("start", "<i8")])


def rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every string of ``width`` bytes, put together from strings of powers of two."""
    with np.errstate(over="ignore"):
        h, power, n, parts = BYTES[data], STEP, 1, {}
        while n <= width:
            if width & n:
                parts[n] = (h, power)
            h, power, n = (h[:-n] * power + h[n:] if len(h) > n else h[:0]), power * power, 2 * n
        whole, used = None, 0
        for n, (h, power) in sorted(parts.items(), reverse=True):
            if whole is None:
                whole, used = h, n
            else:
                fit = max(0, len(data) - used - n + 1)
                whole, used = whole[:fit] * power + h[used : used + fit], used + n
    return whole


def minima(data: np.ndarray, length: int, salt: int = 0, hot: np.ndarray | None = None) -> np.ndarray:
    """The least hash among the ``SEED``-byte strings of each window; strings that ``hot`` marks come after all others."""
    span = length - SEED + 1
    low, n = mix64(rolling(data, SEED) ^ np.uint64(salt)), 1
    if hot is not None:
        low = low >> np.uint64(1) | hot[_slot(low)].astype(np.uint64) << np.uint64(63)
    while 2 * n <= span:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    if span > n:
        low = np.minimum(low[: len(low) - (span - n)], low[span - n :])
    return low


def window_anchors(data: np.ndarray, length: int, salt: int = 0, hot: np.ndarray | None = None) -> np.ndarray:
    """A 48-bit anchor for each window of ``length`` bytes, from its bytes (and the salt and ``hot``) alone."""
    return mix64(minima(data, length, salt, hot)) >> np.uint64(16)


def _slot(low: np.ndarray) -> np.ndarray:
    return (low & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)


def hot_strings(rows: DataFrame, length: int) -> np.ndarray:
    """Marks, by slot of their hash, the strings that would be the anchors of very many segments.

    All segments of all texts are counted, in 2^SKETCH_BITS counters that tasks
    add up on their own and that are combined in a tree.  Any marks give the same
    result: they keep a string that very many texts hold in different
    surroundings from gathering these in one part.
    """

    def count(total: np.ndarray | None, texts: pa.Array) -> np.ndarray:
        total = np.zeros(1 << SKETCH_BITS, np.uint32) if total is None else total
        for _, _, data in byte_slices(texts, 4 << 20):
            for p in range(0, len(data), PIECE):
                if len(piece := data[p : p + PIECE + length - 1]) >= length:
                    low = minima(piece, length)
                    first = np.concatenate(([True], low[1:] != low[:-1]))
                    total += np.bincount(_slot(low[first]), minlength=len(total)).astype(np.uint32)
        return total

    got = folded(rows, "text", count, _saturating, "<u4")
    if got is None:
        return np.zeros(1 << SKETCH_BITS, bool)
    return got >= max(HOT, 4 * got.mean())


def _saturating(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a[:] = np.minimum(a.astype(np.uint64) + b, np.uint64(2**32 - 1)).astype(np.uint32)
    return a


def segments(offsets: np.ndarray, data: np.ndarray, length: int, salt: int = 0, hot: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """(document, start, windows, anchor) of runs of windows with one anchor, piece by piece.

    ``start`` is absolute in ``data``; windows do not cross documents.
    """
    for p in range(0, len(data), PIECE):
        piece = data[p : p + PIECE + length - 1]
        if len(piece) < length:
            return
        anchors = window_anchors(piece, length, salt, hot)
        first = max(0, int(np.searchsorted(offsets, p, "right")) - 1)
        last = int(np.searchsorted(offsets, p + len(anchors), "left"))
        lo = np.maximum(offsets[first:last], p) - p
        hi = np.minimum(offsets[first + 1 : last + 1] - length + 1, p + len(anchors)) - p
        size = np.maximum(hi - lo, 0)
        total = int(size.sum())
        if not total:
            continue
        owner = np.repeat(np.arange(first, last), size)
        at = np.arange(total) + np.repeat(lo - (np.cumsum(size) - size), size)
        own = anchors[at]
        cut = np.flatnonzero((own[1:] != own[:-1]) | (owner[1:] != owner[:-1])) + 1
        start = np.concatenate(([0], cut))
        yield owner[start], at[start] + p, np.diff(np.concatenate((start, [total]))), own[start]


def six_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def from_six(blob: bytes) -> np.ndarray:
    wide = np.zeros((len(blob) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return wide.reshape(-1).view("<u8")


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as the least one and short offsets from it."""
    base = int(ids.min()) if len(ids) else 0
    far = ids - base
    kind = "<u2" if not len(far) or far.max() < 2**16 and far.min() >= 0 else "<u4" if 0 <= far.min() and far.max() < 2**32 else "<i8"
    return kind.encode() + int(base).to_bytes(8, "little", signed=True) + far.astype(kind).tobytes()


def _widen(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, blob[:3].decode(), offset=11).astype(np.int64) + int.from_bytes(blob[3:11], "little", signed=True)


def shared_anchors(rows: DataFrame, length: int, hot: Broadcast, clash: bool) -> DataFrame:
    """(k, c, anchors): packed anchors of the document that a document of another id has too.

    ``c`` is carried only where ids ``clash`` (one has several texts), else it
    is 0.  Neither is null on the way: pandas would make floats of them, which
    do not hold every id.
    """
    parts, tasks = buckets(rows, PART)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks = batch.column(0).to_numpy()
            cs = batch.column(1).to_numpy() if clash else np.zeros(len(ks), np.int64)
            docs, names = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
            for first, offsets, data in byte_slices(batch.column(2), 4 << 20):
                for owner, _, _, anchor in segments(offsets, data, length, hot=hot.value):
                    docs.append(owner + first)
                    names.append(anchor)
            name, doc = np.concatenate(names), np.concatenate(docs)
            k, c = ks[doc], cs[doc]
            order = np.lexsort((c, k, name))
            name, k, c = name[order], k[order], c[order]
            new = np.ones(len(name), bool)
            new[1:] = (name[1:] != name[:-1]) | (k[1:] != k[:-1]) | (c[1:] != c[:-1])
            name, k, c = name[new], k[new], c[new]  # once per document
            start, end = runs_of(name)
            alone = np.repeat(k[start] == k[end - 1], end - start)  # no other id of the batch has it
            out: dict[str, list] = {"bucket": [], "k": [], "c": [], "names": [], "ks": [], "cs": [], "known": []}
            for a, b, blob in zip(*per_owner(k[~alone], c[~alone], name[~alone].astype("<u8")), strict=True):
                for column, v in zip(out.values(), ((a ^ b) % parts, a, b, six_bytes(np.frombuffer(blob, "<u8")), None, None, None), strict=True):
                    column.append(v)
            single, owner, check, several = name[alone], k[alone], c[alone], np.unique(name[~alone])
            order = np.argsort(owner, kind="stable")
            single, owner, check = single[order], owner[order], check[order]
            nothing = np.empty(0, np.int64)
            first = dict(dealt((single % np.uint64(parts)).astype(np.int64)))
            second = dict(dealt((several % np.uint64(parts)).astype(np.int64)))
            for p in first.keys() | second.keys():
                a, b = first.get(p, nothing), second.get(p, nothing)
                own = check[a].astype("<u4").tobytes() if clash else None
                for column, v in zip(out.values(), (p, 0, 0, six_bytes(single[a]), _narrow(owner[a]), own, six_bytes(several[b])), strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 3 + [pa.binary()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        passed, sent = rows[rows["ks"].isna()], rows[rows["ks"].notna()]
        name = from_six(b"".join(sent["names"]))
        k = np.concatenate([_widen(x) for x in sent["ks"]]) if len(sent) else np.empty(0, np.int64)
        c = np.frombuffer(b"".join(sent["cs"]), "<u4").astype(np.int64) if clash else np.zeros(len(k), np.int64)
        known = np.unique(from_six(b"".join(sent["known"])))
        order = np.lexsort((k, name))
        name, k, c = name[order], k[order], c[order]
        shared = np.zeros(len(name), bool)
        if len(name):
            start, end = runs_of(name)
            shared = np.repeat(k[start] != k[end - 1], end - start)
            if len(known):
                shared |= known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name
        a, b, blobs = per_owner(k[shared], c[shared], name[shared].astype("<u8"))
        blobs = [six_bytes(np.frombuffer(x, "<u8")) for x in blobs]
        trim()
        return pd.DataFrame(
            {"k": np.array([*passed["k"], *a], np.int64), "c": np.array([*passed["c"], *b], np.int64), "anchors": [*passed["names"], *blobs]}
        )

    sent = rows.mapInArrow(lean(deal), "bucket long, k long, c long, names binary, ks binary, cs binary, known binary")
    return sent.repartition(tasks, "bucket").groupBy("bucket").applyInPandas(decide, "k long, c long, anchors binary")


# -- the transform ---------------------------------------------------------------


def suffix_order(symbols: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Circular suffixes in order of at least their first ``depth`` symbols, by prefix doubling.

    The first keys pack 64 // bits symbols; later rounds reorder only places in
    groups of equal keys.
    """
    n, per = len(symbols), 64 // bits
    ring = np.concatenate((symbols, np.resize(symbols, per)))
    key = np.zeros(n, np.uint64)
    for j in range(per):
        key <<= np.uint64(bits)
        key |= ring[j : j + n]
    order = np.argsort(key)
    key = key[order]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    slot = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, slot, 0))
    h = per
    while h < depth:
        tied = ~head
        tied[:-1] |= ~head[1:]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        who = order[at]
        pair = rank[who] << 32 | rank[(who + h) % n]
        again = np.argsort(pair)
        pair, who = pair[again], who[again]
        order[at] = who
        new = np.ones(len(at), bool)
        new[1:] = pair[1:] != pair[:-1]
        head[at] = new
        firsts = np.maximum.accumulate(np.where(new, at, 0))
        rank[who] = firsts
        h *= 2
    return order


def open_boundaries(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True at i > 0 where suffixes i-1 and i (in order) share ``length`` symbols or more.

    Breadth-first: level l holds intervals of strings of l symbols.  Backward
    extension of an interval by a symbol is the run that its places with this
    symbol before them map to.  An extension whose right boundary is still open
    closes it with the value l and goes on; the others need no visit.
    """
    n = len(symbols)
    before = symbols[order - 1]
    back = np.empty(n, np.int64)
    back[np.argsort(before, kind="stable")] = np.arange(n)
    front = symbols[order]
    closed = np.zeros(n + 1, bool)
    closed[0] = closed[n] = True
    lb, rb = np.array([0]), np.array([n - 1])
    for _ in range(length):
        size = rb - lb + 1
        total = int(size.sum())
        if not total:
            break
        where = back[np.arange(total) + np.repeat(lb - (np.cumsum(size) - size), size)]
        owner = np.repeat(np.arange(len(lb), dtype=np.int32), size)
        if total > n // 8:
            held = np.full(n, -1, np.int32)
            held[where] = owner
            where = np.flatnonzero(held >= 0)
            owner = held[where]
        else:
            again = np.argsort(where)
            where, owner = where[again], owner[again]
        cut = np.flatnonzero((np.diff(where) != 1) | (owner[1:] != owner[:-1]) | (front[where[1:]] != front[where[:-1]])) + 1
        lb = where[np.concatenate(([0], cut))]
        rb = where[np.concatenate((cut - 1, [total - 1]))]
        fresh = ~closed[rb + 1]
        lb, rb = lb[fresh], rb[fresh]
        closed[rb + 1] = True
    return ~closed[:n]


#: Places that one transform covers; a larger part is divided by a second anchor first.
LIMIT = 1 << 20


def repeating(texts: list[bytes], length: int) -> np.ndarray:
    """True for the texts that hold a window that these texts have twice (by hash: a few more may be true)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(size)
    joined = np.frombuffer(b"".join(texts), np.uint8)
    if len(joined) < length:
        return np.zeros(len(texts), bool)
    h = rolling(joined, length)
    windows = np.maximum(size - length + 1, 0)
    at = np.arange(int(windows.sum())) + np.repeat(ends - size - (np.cumsum(windows) - windows), windows)
    owner = np.repeat(np.arange(len(texts)), windows)
    order = np.argsort(h[at])
    own = h[at[order]]
    same = own[1:] == own[:-1]
    out = np.zeros(len(texts), bool)
    out[owner[order[1:][same]]] = True
    out[owner[order[:-1][same]]] = True
    return out


def least_holder(texts: list[bytes], owners: np.ndarray, length: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(least owner, offsets): for each place of the joined texts (each with an end mark), the least
    owner of the ``length`` bytes that start there; meaningless in a text's last length - 1 places.

    Texts none of whose windows is there twice have their own owner everywhere
    and are left out of the transform.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offsets = np.concatenate(([0], np.cumsum(size)))
    again = repeating(texts, length)
    out = np.repeat(owners, size)
    if again.any():
        some = np.flatnonzero(again)
        value, _ = _least_holder([texts[i] for i in some.tolist()], owners[some], length, salt)
        out[np.repeat(again, size)] = value
    return out, offsets


def _least_holder(texts: list[bytes], owners: np.ndarray, length: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by the transform alone.

    Over ``LIMIT`` places (an anchor that very many texts hold in different
    surroundings) windows are dealt by another anchor and the shares are done
    one after the other: equal windows share this anchor too.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    offsets = np.concatenate(([0], np.cumsum(size)))
    joined = b"\0".join(texts) + b"\0"
    if len(joined) <= LIMIT or salt >= 4:
        return _transform(np.frombuffer(joined, np.uint8), offsets, size, owners, length), offsets
    plain = b"".join(texts)
    ends = np.concatenate(([0], np.cumsum(size - 1)))
    found = [np.concatenate(x) for x in zip(*segments(ends, np.frombuffer(plain, np.uint8), length, salt + 1), strict=True)]
    owner, start, windows, anchor = found
    shares = int(-(-int((windows + length).sum()) // (LIMIT // 2)))
    by, bounds = split_by((anchor % np.uint64(shares)).astype(np.int64), shares)
    out = np.empty(len(joined), np.int64)
    for p in np.flatnonzero(np.diff(bounds)):
        own = by[bounds[p] : bounds[p + 1]]
        parts = [plain[s : s + w + length - 1] for s, w in zip(start[own].tolist(), windows[own].tolist(), strict=True)]
        value, at = _least_holder(parts, owners[owner[own]], length, salt + 1)
        w = windows[own]
        inside = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        out[np.repeat(start[own] + owner[own], w) + inside] = value[np.repeat(at[:-1], w) + inside]
    return out, offsets


def _transform(raw: np.ndarray, offsets: np.ndarray, size: np.ndarray, owners: np.ndarray, length: int) -> np.ndarray:
    seen = np.zeros(256, bool)
    seen[raw] = True
    code = np.zeros(256, np.uint16)
    code[seen] = np.arange(1, int(seen.sum()) + 1)
    symbols = code[raw]
    symbols[offsets[1:] - 1] = 0
    bits = 8 if symbols.max() < 256 else 9
    if bits == 8:
        symbols = symbols.astype(np.uint8)
    order = suffix_order(symbols, bits, length)
    open_ = open_boundaries(symbols, order, length)
    room = np.arange(len(raw)) + length < np.repeat(offsets[1:], size)
    value = np.where(room, np.repeat(owners, size), np.iinfo(np.int64).max)[order]
    start = np.flatnonzero(~open_)
    out = np.empty(len(raw), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(value, start), np.diff(np.concatenate((start, [len(raw)]))))
    return out


def removals(rows: DataFrame, length: int) -> DataFrame:
    """(k, c, flags): packed byte runs to remove, in any number of rows per document."""
    rows, clash = distinct_rows(rows)
    parts, tasks = buckets(rows, PART)
    hot = rows.sparkSession.sparkContext.broadcast(hot_strings(rows, length))  # 2^SKETCH_BITS marks
    found = materialize(shared_anchors(rows, length, hot, clash), "anchors")
    keys = ["k", "c"] if clash else ["k"]
    gathered = found.groupBy(*keys).agg(F.collect_list("anchors").alias("anchors"))
    candidates = rows.join(gathered.hint("shuffle_hash"), keys).select("k", "c", "text", "anchors")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, cs, names = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            index: dict[bytes, int] = {}
            empty = np.empty(0, np.int64)
            ids, docs, starts, marks = [empty], [empty], [empty], [empty.astype(np.uint64)]
            for first, offsets, data in byte_slices(batch.column(2), 4 << 20):
                raw = data.tobytes()
                wanted = [np.empty(0, np.uint64)]
                for i in range(len(offsets) - 1):
                    mine = from_six(b"".join(names[first + i].as_py()))
                    wanted.append(mine | np.uint64(i) << np.uint64(48))
                want = np.sort(np.concatenate(wanted))
                for owner, start, windows, anchor in segments(offsets, data, length, hot=hot.value):
                    pair = anchor | owner.astype(np.uint64) << np.uint64(48)
                    hit = want[np.minimum(np.searchsorted(want, pair), len(want) - 1)] == pair if len(want) else np.zeros(len(pair), bool)
                    owner, start, windows = owner[hit], start[hit], windows[hit]
                    ends = (start + windows + length - 1).tolist()
                    own = [index.setdefault(raw[a:b], len(index)) for a, b in zip(start.tolist(), ends, strict=True)]
                    ids.append(np.array(own, np.int64))
                    docs.append(owner + first)
                    starts.append(start - offsets[owner])
                    marks.append(anchor[hit])
            seg, doc, at = np.concatenate(ids), np.concatenate(docs), np.concatenate(starts)
            texts = list(index)
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            least = np.full(len(texts), LAST)
            np.minimum.at(least, seg, ks[doc])
            part = np.zeros(len(texts), np.int64)
            part[seg] = (np.concatenate(marks) % np.uint64(parts)).astype(np.int64)
            out: dict[str, list] = {"bucket": [], "k": [], "c": [], "flags": [], "texts": [], "sizes": [], "owners": [], "places": []}
            later = ks[doc] != least[seg]  # copies that the batch itself shows to be later ones
            runs = np.empty(int(later.sum()), RUN)
            runs["start"], runs["end"] = at[later], at[later] + size[seg[later]]
            for k, c, blob in zip(*per_owner(ks[doc[later]], cs[doc[later]], runs), strict=True):
                for column, v in zip(out.values(), ((k ^ c) % parts, k, c, blob, None, None, None, None), strict=True):
                    column.append(v)
            mine = dict(dealt(part))
            local = np.empty(len(texts), np.int64)
            for own in mine.values():
                local[own] = np.arange(len(own))
            seg, doc, at = seg[~later], doc[~later], at[~later]
            places = np.empty(len(seg), PLACE)
            places["segment"], places["c"], places["start"] = local[seg], cs[doc], at
            held = dict(dealt(part[seg]))
            for p, own in mine.items():
                row = (
                    p, 0, 0, None, b"".join([texts[i] for i in own.tolist()]), size[own].astype("<i4").tobytes(),
                    least[own].tobytes(), places[held.get(p, empty)].tobytes(),
                )
                for column, v in zip(out.values(), row, strict=True):
                    column.append(v)
            kinds = [pa.int64()] * 3 + [pa.binary()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], names=list(out))

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        passed, sent = rows[rows["texts"].isna()], rows[rows["texts"].notna()]
        index: dict[bytes, int] = {}
        ids, held, entries = [], [], []
        for blob, sizes, owners, places in zip(sent["texts"], sent["sizes"], sent["owners"], sent["places"], strict=True):
            ends = np.cumsum(np.frombuffer(sizes, "<i4"), dtype=np.int64).tolist()
            own = [index.setdefault(blob[a:b], len(index)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            ids.append(np.array(own, np.int64))
            held.append(np.frombuffer(owners, "<i8"))
            where = np.frombuffer(places, PLACE)
            entries.append(np.column_stack((ids[-1][where["segment"]], held[-1][where["segment"]], where["c"], where["start"])))
        a: list[int] = []
        b: list[int] = []
        f: list[bytes] = []
        if entries:
            least = np.full(len(index), LAST)
            np.minimum.at(least, np.concatenate(ids), np.concatenate(held))
            value, offsets = least_holder(list(index), least, length)
            seg, k, c, start = np.concatenate(entries).T
            windows = offsets[seg + 1] - offsets[seg] - length
            base = np.cumsum(windows) - windows
            total = int(windows.sum())
            entry = np.repeat(np.arange(len(seg)), windows)
            inside = np.arange(total) - base[entry]
            gone = value[offsets[seg][entry] + inside] < k[entry]
            edge = np.ones(total, bool)
            edge[1:] = (entry[1:] != entry[:-1]) | (gone[1:] != gone[:-1])
            head = np.flatnonzero(edge)
            size = np.diff(np.concatenate((head, [total])))
            head, size = head[gone[head]], size[gone[head]]
            runs = np.empty(len(head), RUN)
            runs["start"] = start[entry[head]] + inside[head]
            runs["end"] = runs["start"] + size + length - 1
            a, b, f = per_owner(k[entry[head]], c[entry[head]], runs)
        return pd.DataFrame(
            {"k": np.array([*passed["k"], *a], np.int64), "c": np.array([*passed["c"], *b], np.int64), "flags": [*passed["flags"], *f]}
        )

    schema = "bucket long, k long, c long, flags binary, texts binary, sizes binary, owners binary, places binary"
    return candidates.mapInArrow(lean(deal), schema).repartition(tasks, "bucket").groupBy("bucket").applyInPandas(decide, "k long, c long, flags binary")


def merged(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union; runs that touch are one."""
    runs = np.sort(runs, order="start")
    reach = np.maximum.accumulate(runs["end"])
    head = np.flatnonzero(np.concatenate(([True], runs["start"][1:] > reach[:-1])))
    return runs["start"][head], reach[np.concatenate((head[1:] - 1, [len(runs) - 1]))]


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, n_bytes, n_removed, n_spans, kept) of every document; ``kept`` is binary.

    A byte is removed if a ``length``-byte string that covers it also starts in
    a document with a smaller id; strings are judged on the input.  Null texts
    are empty; a null id counts as the largest; rows that share an id never
    remove each other's bytes; repeated rows get equal results; no rows give an
    empty result.  ``length`` is at least 21 and at most 56.
    Ids must be of an integer type.
    """
    if not SEED < length <= 56:
        raise ValueError("length must be from 21 to 56")
    rows = keyed(docs, id_col, text_col)
    with scratch() as keep:
        flags = keep(materialize(removals(rows, length), "removals"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gone, out = batch.column("flags"), ([], [], [], [])
            for first, offsets, data in byte_slices(batch.column("text"), 4 << 20):
                for i in range(len(offsets) - 1):
                    text = data[offsets[i] : offsets[i + 1]].tobytes()
                    runs = unflag(gone, first + i, RUN)
                    kept, spans = text, 0
                    if len(runs):
                        start, end = merged(runs)
                        pieces = zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True)
                        kept, spans = b"".join(text[a:b] for a, b in pieces), len(start)
                    for column, v in zip(out, (len(text), len(text) - len(kept), spans, kept), strict=True):
                        column.append(v)
            arrays = [batch.column("k"), *[pa.array(v, pa.int64()) for v in out[:3]], pa.array(out[3], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["k", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_flags(rows, flags).mapInArrow(lean(apply), "k long, n_bytes long, n_removed long, n_spans long, kept binary")


def op5_suffix_array_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) at 50 bytes."""
    return suffix_dedup(docs, 50).select(doc_id(), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
