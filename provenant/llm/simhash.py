"""SimHash near-dedup with covering locality-sensitive hashing.

Every bit of the fingerprint gets a vector of radius + 1 bits, and every
non-zero vector is a table that masks the bits whose vectors have an odd inner
product with it.  Any ``radius`` bit positions span less than the whole space,
so some table masks all of them out: each pair within the radius has equal
masked fingerprints in that table.  Nothing is missed by chance.

Equal fingerprints are one class from the start.  Inside a table's bucket a
search links classes to a spanning forest, not to all pairs; the forests of
all tables have the same components as all links together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release, scratch
from .components import components
from .shared import aside, folded, lean, may_hold, mix64, renamed_free, runs_of, trim, value_filter

BITS = 64


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """Space-joined shingles, repeats included; fewer words than ``width``: the whole sequence."""
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)]


def fingerprint(features: list[bytes], seed: int = 42) -> int:
    """Bit i is 1 if it is set in over half of the features' XXH64; no feature: 0."""
    if not features:
        return 0
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(s, seed) for s in features), np.uint64, len(features))
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 8192):
        part = h[i : i + 8192].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def lowered_words(text: str | None) -> list[bytes]:
    """A-Z lowered (nothing else), split to words."""
    return [] if text is None else text.encode("utf-8", "surrogatepass").lower().split()


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fingerprint of the ``width``-word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(shingles(lowered_words(text.as_py()), width)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return renamed_free(docs, id_col, text_col).mapInArrow(lean(run), f"id {kind}, fp long")


def covering_masks(radius: int, bits: int = BITS) -> np.ndarray:
    """2^(radius+1) - 1 masks; each pair of numbers that differs in at most ``radius`` bits agrees under one."""
    n = 2 ** (radius + 1)
    vectors = np.arange(bits) % (n - 1) + 1  # all non-zero vectors in turn, so masks are of even weight
    masks = []
    for v in range(1, n):
        odd = np.array([bin(int(x) & v).count("1") & 1 for x in vectors], np.uint64)
        masks.append(int((odd << np.arange(bits, dtype=np.uint64)).sum(dtype=np.uint64)))
    return np.array(masks, np.uint64)


#: Distinct fingerprints of a table's part: what one task holds, at every size of the corpus.
PART = 100_000
#: Buckets over this size are first split by blocks of their free bits.
DIRECT = 2048


def forest(f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most ``radius`` bits apart) among distinct fingerprints.

    Over ``DIRECT`` fingerprints are grouped by each of radius + 1 bit blocks:
    a linked pair agrees in one of them.
    """
    if len(f) <= DIRECT:
        return _search(f, radius)
    edges, width = [], -(-BITS // (radius + 1))
    for lo in range(0, BITS, width):
        part = (f >> np.uint64(lo)) & np.uint64((1 << min(width, BITS - lo)) - 1)
        order = np.argsort(part, kind="stable")
        for a, b in zip(*runs_of(part[order]), strict=True):
            if b - a > 1:
                edges += _search(f[order[a:b]], radius)
    return edges


def _middle(f: np.ndarray) -> int:
    """Place of the fingerprint nearest to the majority of every bit."""
    ones = np.unpackbits(f.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0)
    centre = np.packbits(ones * 2 > len(f), bitorder="little").view(np.uint64)[0]
    return int(np.bitwise_count(f ^ centre).argmin())


def _search(f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Breadth-first search in which every found fingerprint leaves the candidates.

    It starts in the middle: of edited copies that is mostly the original, to
    which all of them are nearer than to each other, in whatever table.
    """
    edges, left, ahead = [], f, []
    while len(left):
        if not ahead:
            at = _middle(left)
            ahead, left = [left[at]], np.delete(left, at)
            continue
        u = ahead.pop(0)
        near = np.bitwise_count(left ^ u) <= radius
        if near.any():
            found = left[near]
            edges += [(int(u), int(v)) for v in found]
            ahead += list(found)
            left = left[~near]
    return edges


def bucket_links(f: np.ndarray, mask: np.uint64, radius: int) -> np.ndarray:
    """Forest edges (n, 2) among the fingerprints of a part of one table."""
    f = np.unique(f)
    key = f & mask
    order = np.argsort(key, kind="stable")
    f, key = f[order], key[order]
    start, end = runs_of(key)
    size = end - start
    two = start[size == 2]
    near = np.bitwise_count(f[two] ^ f[two + 1]) <= radius
    edges = [np.column_stack((f[two][near], f[two + 1][near]))]
    for a, b in zip(start[size > 2], end[size > 2], strict=True):
        if found := forest(f[a:b], radius):
            edges.append(np.array(found, np.uint64))
    return np.concatenate(edges)


def links(distinct: DataFrame, radius: int, n: int) -> DataFrame:
    """(u, v) over the distinct fingerprints ``fp``; ``n``: how many there are, for sizing alone.

    Fingerprints travel as packed arrays, one per table part and batch.
    """
    masks = covering_masks(radius)
    parts = int(max(1, -(-n // PART)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            names, blobs = [], []
            for t, mask in enumerate(masks):
                part = (mix64(f & mask) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for a, b in zip(*runs_of(part[order]), strict=True):
                    names.append(t * parts + int(part[order[a]]))
                    blobs.append(f[order[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "fps"])

    def join(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        f = np.frombuffer(b"".join(rows["fps"]), np.uint64)
        found = bucket_links(f, masks[key[0] // parts], radius).view(np.int64)
        return pd.DataFrame({"u": found[:, 0], "v": found[:, 1]})

    dealt = distinct.select("fp").mapInArrow(lean(deal), "bucket long, fps binary")
    return dealt.groupBy("bucket").applyInPandas(join, "u long, v long")


def simhash_groups(
    docs: DataFrame, width: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id_col, fp, component_id) for every row of ``docs``.

    ``component_id`` is the least id reachable over links of at most ``radius``
    differing bits.  Null and empty texts have fingerprint 0 and link like any
    other; a row with a null id is kept and does not count as a least id;
    repeated rows stay repeated; an empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    with scratch() as keep:
        classes = materialize(fps.groupBy("fp").agg(F.min("id").alias("rep")), "classes")
        found = components(materialize(links(classes, radius, classes.count()), "links"))
        placed = classes.join(found.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        placed = materialize(placed, "placed")
        least = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
        of = keep(materialize(placed.select("fp", "root").join(least, "root").select("fp", "component_id"), "components"))
    return fps.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


# -- verified near-duplicates ------------------------------------------------------

#: Bits that the fingerprints of the distinct words may differ in for a pair to be looked at first.
RADIUS = 4
#: Counters of the sketch of shingle frequencies (fixed, so its broadcast is), and how many times the mean makes a late shingle.
SKETCH_BITS, LATE = 18, 4
#: Prefix places that are searched in one task.
PLACES = 200_000
#: 64-bit words of a set's parity map.
PARITY = 4
_PLACE = np.dtype([("token", "<u8"), ("key", "<i8"), ("root", "<i8"), ("size", "<i4"), ("at", "<i4")])
_LATE_PLACE = np.dtype([*_PLACE.descr, ("parity", "<u8", (PARITY,))])


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    parts = shingles(lowered_words(text), width)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(s) for s in parts), np.uint64, len(parts)))


def set_key(tokens: np.ndarray) -> np.int64:
    """64 bits that name a set of shingles."""
    return np.uint64(xxhash.xxh3_64_intdigest(tokens)).view(np.int64)


def _slot(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def shingle_counts(rows: DataFrame, width: int) -> np.ndarray:
    """Document counts of all shingles of all rows, added up in 2^SKETCH_BITS counters.

    Each task adds up its own; their sums are added in a tree, so no task or
    driver holds more than a few of these fixed-size arrays.  The counts only
    decide the order of shingles: any order gives the same pairs.
    """

    def count(total: np.ndarray | None, texts: pa.Array) -> np.ndarray:
        total = np.zeros(1 << SKETCH_BITS, np.uint64) if total is None else total
        held = []
        for text in texts:
            held.append(_slot(shingle_set(text.as_py(), width)).astype(np.int32))
            if len(held) == 1000:
                total += np.bincount(np.concatenate(held), minlength=len(total)).astype(np.uint64)
                held = []
        return total + np.bincount(np.concatenate([np.empty(0, np.int32), *held]), minlength=len(total)).astype(np.uint64)

    got = folded(rows, "text", count, lambda a, b: np.add(a, b, out=a), "<u8")
    return np.zeros(1 << SKETCH_BITS, np.uint64) if got is None else got


def prefix(tokens: np.ndarray, counts: np.ndarray, cut: int, least: float) -> tuple[np.ndarray, int]:
    """(the first of the set ``tokens``, rarest by ``counts`` first, ties by hash; how many of them are counted under ``cut``).

    Sets of a similarity of ``least`` share at least that part of either, so
    one of so many first tokens of both, in any order that all sets share.
    """
    n = len(tokens)
    if not n:
        return tokens, 0
    k = n - int(np.ceil(least * n - 1e-9)) + 1
    seen = counts[_slot(tokens)]
    order = np.argsort(seen, kind="stable")[:k]  # tokens come sorted by hash
    return tokens[order], int((seen[order] < cut).sum())


def parity(tokens: np.ndarray) -> bytes:
    """A bit per residue of the tokens: set if an odd number of them have it.

    Sets whose maps differ in d bits differ in at least d tokens.
    """
    odd = np.bincount((tokens % np.uint64(64 * PARITY)).astype(np.int64), minlength=64 * PARITY) & 1
    return np.packbits(odd.astype(bool), bitorder="little").tobytes()


def prefix_pairs(places: np.ndarray, least: float) -> np.ndarray:
    """Distinct (u, v), u < v, of other roots that share a token and may be similar.

    What rules a pair out is exact: sizes, the token's places in both sets,
    and for late tokens the parity maps.
    """
    places = places[np.lexsort((places["size"], places["token"]))]
    start, end = runs_of(places["token"])
    late = "parity" in places.dtype.names
    found, held = [np.empty((0, 2), np.int64)], 0
    for a, b in zip(start[end - start > 1].tolist(), end[end - start > 1].tolist(), strict=True):
        keys, root, size, at = (places[n][a:b] for n in ("key", "root", "size", "at"))
        if (root == root[0]).all():
            continue
        size, after = size.astype(np.int64), size.astype(np.int64) - at
        maps = places["parity"][a:b] if late else None
        # sizes rise: a place's partners are the later ones of at most size / least
        ends = np.searchsorted(size, size / least + 1e-6, "right").tolist()
        for i in range(b - a - 1):
            j = slice(i + 1, ends[i])
            both = size[i] + size[j]
            # if the token is the first that they share, no more than what follows it is common
            ok = (root[j] != root[i]) & (np.minimum(after[i], after[j]) * (1 + least) >= least * both - 1e-6)
            if late and ok.any():
                ok &= np.bitwise_count(maps[j] ^ maps[i]).sum(axis=1) * (1 + least) <= (1 - least) * both + 1e-6
            if ok.any():
                other = keys[j][ok]
                found.append(np.column_stack((np.minimum(other, keys[i]), np.maximum(other, keys[i]))))
                held += len(other)
        if held > 1 << 18:
            found = [np.unique(np.concatenate(found), axis=0)]
            held = 0
    return np.unique(np.concatenate(found), axis=0)


def described(rows: DataFrame, width: int, least: float) -> DataFrame:
    """(id, c, key, fp, size, rare, tokens, parity) of every row of (id, c, text).

    ``key`` names the set of shingles (64 bits: two of n sets share it by chance
    with a probability of n^2 / 2^65), ``fp`` is the fingerprint of the distinct
    words, ``tokens`` the set's prefix and ``parity`` its map if it is needed.
    """
    counts = shingle_counts(rows, width)
    cut = max(16, int(LATE * counts.sum() / len(counts)))
    held = rows.sparkSession.sparkContext.broadcast(counts)  # 2^SKETCH_BITS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for text in batch.column(2):
                text = text.as_py()
                tokens = shingle_set(text, width)
                first, rare = prefix(tokens, held.value, cut, least)
                fp = fingerprint(sorted(set(lowered_words(text))))
                row = (
                    set_key(tokens), np.uint64(fp).view(np.int64), len(tokens), rare,
                    first.tobytes(), parity(tokens) if rare < len(first) else None,
                )
                for column, v in zip(out, row, strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            arrays = [batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(out, kinds, strict=True)]]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "c", "key", "fp", "size", "rare", "tokens", "parity"])

    kind = dict(rows.dtypes)["id"]
    schema = f"id {kind}, c long, key long, fp long, size int, rare int, tokens binary, parity binary"
    return rows.select("id", "c", "text").mapInArrow(lean(run), schema)


def verified(pairs: DataFrame, rows: DataFrame, reps: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (u, v) of set keys whose Jaccard similarity is ``least`` or more; written.

    ``reps``: key and c of one row of every set.  Sets are made where the texts
    are, of those that a filter of a fixed size lets through, and met with the
    wanted keys: texts do not move.
    """

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column(0).to_numpy(zero_copy_only=False)
            hit = np.flatnonzero(may_hold(held.value, c))
            hit = hit[np.unique(c[hit], return_index=True)[1]]  # equal texts of a batch once
            own = [shingle_set(batch.column(1)[i].as_py(), width) for i in hit.tolist()]
            arrays = [pa.array([set_key(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "hashes"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(common >= least * (len(a) + len(b) - common) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    needed = materialize(pairs.select(F.explode(F.array("u", "v")).alias("key")).distinct(), "needed")
    wanted = materialize(reps.join(needed, "key", "left_semi").select("c"), "wanted")
    held = rows.sparkSession.sparkContext.broadcast(value_filter(wanted, "c"))
    made = rows.select("c", "text").mapInArrow(lean(sets_of), "key long, hashes binary")
    sets = materialize(made.join(needed, "key", "left_semi").dropDuplicates(["key"]), "sets")
    left = sets.select(F.col("key").alias("u"), F.col("hashes").alias("a"))
    right = sets.select(F.col("key").alias("v"), F.col("hashes").alias("b"))
    both = pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b")
    out = materialize(both.mapInArrow(lean(verify), "u long, v long"), "verified")
    held.destroy()
    release(needed, wanted, sets)
    return out


def prefix_join(prefixes: DataFrame, least: float) -> DataFrame:
    """(u, v): all pairs of sets of other roots that may have a similarity of ``least`` and more; written.

    ``prefixes``: key, root, size, rare, tokens, parity of every set.  Places
    (token, set) travel as packed arrays by the token's hash.  A late token's
    places are dealt by size as well: bands are so wide that partners are in
    the same one or the next.
    """
    n = prefixes.agg(F.sum(F.length("tokens") / 8)).first()[0] or 0
    parts = int(max(1, -(-n // PLACES)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, root, size, rare = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            tokens = [np.frombuffer(x.as_py(), np.uint64) for x in batch.column(4)]
            length = np.fromiter(map(len, tokens), np.int64, len(tokens))
            of = np.repeat(np.arange(len(tokens)), length)
            if not len(of):
                continue
            token, at = np.concatenate(tokens), np.arange(len(of)) - np.repeat(np.cumsum(length) - length, length)
            late = at >= rare[of]
            names, blobs = [], []
            for kind, own in ((_PLACE, np.flatnonzero(~late)), (_LATE_PLACE, np.flatnonzero(late))):
                if not len(own):
                    continue
                out, who = np.empty(len(own), kind), of[own]
                out["token"], out["key"], out["root"], out["size"], out["at"] = token[own], key[who], root[who], size[who], at[own]
                spread, first = out["token"], 0
                if kind is _LATE_PLACE:
                    maps = np.zeros((len(tokens), PARITY), np.uint64)
                    for i in np.unique(who).tolist():
                        maps[i] = np.frombuffer(batch.column(5)[i].as_py(), np.uint64)
                    out["parity"] = maps[who]
                    band = 1 + np.floor(np.log(out["size"]) / -np.log(least) + 1e-9) if least < 1 else np.ones(len(own))
                    band, out, first = np.concatenate((band, band + 1)).astype(np.uint64), np.concatenate((out, out)), parts
                    spread = out["token"] + band * np.uint64(0x9E3779B97F4A7C15)
                part = (mix64(spread) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                for a, b in zip(*runs_of(part[order]), strict=True):
                    names.append(first + int(part[order[a]]))
                    blobs.append(out[order[a:b]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "places"])

    def search(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        kind = _PLACE if key[0] < parts else _LATE_PLACE
        found = prefix_pairs(np.frombuffer(b"".join(group["places"]), kind), least)
        trim()
        return pd.DataFrame(found, columns=["u", "v"])

    rows = prefixes.select("key", "root", "size", "rare", "tokens", "parity")
    dealt = rows.mapInArrow(lean(deal), "bucket long, places binary")
    return materialize(dealt.groupBy("bucket").applyInPandas(search, "u long, v long").distinct(), "pairs")


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = RADIUS, id_col: str = "doc_id") -> DataFrame:
    """(id, c, key, root, kept): every row's set of shingles, its group, and whether it is the group's first row.

    ``c`` is the 64-bit hash of the text.  Two documents are linked if the sets
    of their ``width``-word shingles (64-bit hashes) have a Jaccard similarity
    of ``least`` or more.  Equal sets are one class from the start.  Then

    1. covering tables find fingerprints of the distinct words within
       ``radius`` bits; every bucket hands on a spanning forest of them, and each
       of its links is verified on the sets: linear in the number of classes,
       and large groups are mostly one from here on;
    2. an exact prefix-filtered join finds every pair that this left apart,
       whatever its fingerprints.

    A group's first row is the one of the least id, a null id last, ties by
    ``c``.  Ids may be of any type that has an order.  Texts without words, null
    ones too, are one class; rows that repeat both id and text get equal
    results; an empty table gives an empty result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("c"), "text")
    with scratch() as keep:
        every = materialize(described(rows, width, least), "described")
        order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("c").alias("c"))
        classes = every.groupBy("key").agg(F.min(order).alias("rep"), F.min("fp").alias("fp"))
        classes = materialize(classes.select("key", "fp", "rep.id", "rep.c"), "classes")
        reps = classes.select("key", "id", "c")
        # fingerprints stand for their least class; its other classes are linked to it
        fps = materialize(classes.groupBy("fp").agg(F.min("key").alias("least")), "distinct")
        near = materialize(links(fps, radius, fps.count()).distinct(), "near")
        name = lambda side: fps.select(F.col("fp").alias(side), F.col("least").alias(f"_{side}"))
        edges = near.join(name("u"), "u").join(name("v"), "v").select(F.col("_u").alias("u"), F.col("_v").alias("v"))
        alike = classes.join(fps, "fp").filter("key <> least").select(F.col("key").alias("u"), F.col("least").alias("v"))
        edges = materialize(edges.unionByName(alike), "edges")
        close = verified(edges, rows, reps, width, least)
        linked = materialize(components(close), "linked")
        roots = linked.select(F.col("node").alias("key"), "root")
        prefixes = every.select("key", "size", "rare", "tokens", "parity").dropDuplicates(["key"]).join(roots, "key", "left")
        prefixes = materialize(prefixes.withColumn("root", F.coalesce("root", "key")), "prefixes")
        rest = verified(prefix_join(prefixes, least), rows, reps, width, least)
        groups = components(rest.unionByName(linked.select(F.col("node").alias("u"), F.col("root").alias("v")).filter("u <> v")))
        placed = reps.join(groups.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
        placed = materialize(placed, "placed")
        first = placed.groupBy("root").agg(F.min(order).alias("first"))
        whole = placed.select("key", "root").join(first, "root")
        same = F.col("id").eqNullSafe(F.col("first.id")) & (F.col("c") == F.col("first.c"))
        out = every.select("id", "c", "key").join(whole, "key").select("id", "c", "key", "root", same.alias("kept"))
        return keep(materialize(out, "groups"))


def without_near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates; columns keep their names.  See :func:`near_duplicates`.

    Of rows that repeat both id and text one stays, whichever.
    """
    docs, restore = aside(docs, "doc_id", "text")
    groups = near_duplicates(docs, width, least, radius)
    hashed = docs.withColumn("_h", F.xxhash64(F.coalesce("text", F.lit(""))))
    name = lambda df, mark: df.select(F.col("id").alias(f"_id{mark}"), F.col("c").alias(f"_c{mark}"))
    same = lambda mark: F.col("doc_id").eqNullSafe(F.col(f"_id{mark}")) & (F.col("_h") == F.col(f"_c{mark}"))
    gone = name(groups.filter("NOT kept").select("id", "c").distinct(), "g")
    out = hashed.join(gone.hint("shuffle_hash"), same("g"), "left_anti")
    again = groups.filter("kept").groupBy("id", "c").agg(F.count("*").alias("n")).filter("n > 1")
    again = name(materialize(again.select("id", "c"), "again"), "r")
    if not again.isEmpty():
        several = out.join(again, same("r"), "left_semi").withColumn("_n", F.row_number().over(Window.partitionBy("doc_id", "_h").orderBy("_h")))
        out = out.join(again, same("r"), "left_anti").unionByName(several.filter("_n = 1").drop("_n"))
    return restore(out)


def op2_simhash_near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): 4-word shingles, at most 4 differing bits."""
    groups = simhash_groups(docs, 4, 4)
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


__all__ = ["near_duplicates", "op2_simhash_near_dedup", "simhash_groups", "without_near_duplicates"]
