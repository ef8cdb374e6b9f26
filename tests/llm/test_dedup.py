"""Byte, chunk, line and fingerprint dedup against brute force."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from provenant.llm import chunk_dedup, line_dedup, simhash, suffix_dedup
from provenant.llm import components as components_module
from provenant.llm.components import components


def texts(seed, n=40):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    out = []
    for _ in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 120)))
        if rng.random() < 0.5:
            at = rng.randint(0, len(t))
            t = t[:at] + passage[rng.randint(0, 80) :] + t[at:]
        if out and rng.random() < 0.2:
            t = rng.choice(out)
        out.append(t)
    return out


def brute_suffix(docs):
    first, got = {}, {}
    for i, t in sorted(docs.items()):
        b = t.encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], i)
    for i, t in docs.items():
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        got[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return got


@pytest.mark.parametrize("limit,hot", [(1 << 20, 10_000), (1 << 11, 10_000), (1 << 11, 3)])
def test_suffix_dedup_is_exact(make, monkeypatch, limit, hot):
    monkeypatch.setattr(suffix_dedup, "LIMIT", limit)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    docs = dict(enumerate(texts(1)))
    rows = suffix_dedup.op5_suffix_array_dedup(make(*docs.items())).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute_suffix(docs)


IDS = {
    "small": lambda i: i,
    "beyond doubles": lambda i: 2**53 + i,
    "large": lambda i: 2**62 + 2 * i + 1,
    "negative": lambda i: -(2**61) + i,
    "far apart": lambda i: (i - 20) * 2**57 + i,
}


@pytest.mark.parametrize("tasks", [1, 5])
@pytest.mark.parametrize("ids", IDS)
def test_ids_of_any_size(make, ids, tasks):
    """Ids are exact wherever they travel; null ids come last, whatever they repeat."""
    docs = {IDS[ids](i): t for i, t in enumerate(texts(4))}
    own = " ".join(f"own{i}" for i in range(60))
    least = min(docs)
    some = "x" + docs[least] + own  # copies of the first document inside two texts without an id
    rows = make(*docs.items(), (None, some), (None, some + "y"), (None, docs[least])).repartition(tasks)
    got = suffix_dedup.op5_suffix_array_dedup(rows).collect()
    assert {r[0]: tuple(r[1:]) for r in got if r[0] is not None} == brute_suffix(docs)
    last = max(docs) + 1
    want = sorted(brute_suffix(docs | {last: t})[last] for t in (some, some + "y", docs[least]))
    assert sorted(tuple(r[1:]) for r in got if r[0] is None) == want
    got = chunk_dedup.op10_chunk_dedup(rows).collect()
    assert {r[0]: tuple(r[1:]) for r in got if r[0] is not None} == brute_chunks(docs)
    assert [r.n_removed for r in got if r.doc_id is None and r.n_bytes == len(docs[least].encode())] == [len(docs[least].encode())]
    lines = {IDS[ids](i): t for i, t in line_docs(5).items()}
    copied = next(t for t in lines.values() if len(t.split("\n")) > 8)
    _, kept, gone = brute_runs(lines, 3, 50)
    got = line_dedup.op9_line_dedup(make(*lines.items(), (None, copied), (None, copied + "\nown"), (None, copied)).repartition(tasks)).collect()
    assert {r.doc_id: r.n_removed for r in got if r.doc_id is not None} == {i: len(g) for i, g in gone.items()}
    assert {r.n_removed for r in got if r.doc_id is None} == {sum(bool(x.strip()) for x in copied.split("\n"))}


def test_repeated_rows_are_looked_at_once(make, spark):
    """A row repeated very often costs what one does; the marks of its parts do not multiply."""
    text = " ".join(f"w{i}" for i in range(3000))
    rows = make((1, text), (2, "a " + text + " b"), (3, "own"))
    many = rows.filter("doc_id = 2").crossJoin(spark.range(20_000)).select(rows.columns).unionByName(rows.filter("doc_id <> 2"))
    for query in (suffix_dedup.op5_suffix_array_dedup, chunk_dedup.op10_chunk_dedup):
        took = time.monotonic()
        got = query(many).groupBy("doc_id", "n_bytes", "n_removed").count().collect()
        assert time.monotonic() - took < 240
        by = {r.doc_id: r for r in got}
        assert len(got) == 3 and by[2]["count"] == 20_000 and by[1].n_removed == by[3].n_removed == 0 and by[2].n_removed >= len(text) - 600


def test_one_line_repeated_very_often_is_linear(make):
    n = 200_000
    took = time.monotonic()
    rows = {r.doc_id: r for r in line_dedup.op9_line_dedup(make((1, "\n".join(["-" * 12] * n)), (2, "a\nb"))).collect()}
    assert time.monotonic() - took < 300
    assert rows[1].n_lines == n and rows[1].n_removed >= n - 3 and rows[2].n_removed == 0


def test_open_boundaries_on_random_bytes():
    rng = np.random.default_rng(3)
    for size, sigma, length in ((500, 2, 5), (3000, 3, 21), (2000, 250, 30)):
        s = rng.integers(1, sigma + 1, size).astype(np.uint8)
        s[size // 2 : size // 2 + 60] = s[:60]
        order = suffix_dedup.suffix_order(s, 8, length)
        ring = np.concatenate((s, s)).tobytes()
        assert [ring[i : i + length] for i in order] == sorted(ring[i : i + length] for i in range(size))
        open_ = suffix_dedup.open_boundaries(s, order, length)
        assert [bool(x) for x in open_[1:]] == [ring[a : a + length] == ring[b : b + length] for a, b in zip(order[:-1], order[1:], strict=True)]


def test_suffix_dedup_handles_odd_rows(messy, make):
    rows = suffix_dedup.op5_suffix_array_dedup(messy).collect()
    assert len(rows) == messy.count()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert by[3][0].n_removed == 0 and by[4][0].n_removed == by[4][0].n_bytes and by[4][0] == by[4][1]
    assert by[1][0].n_bytes == 0
    assert suffix_dedup.op5_suffix_array_dedup(make().limit(0)).count() == 0


def brute_chunks(docs):
    seen, got = set(), {}
    gear = [int(g) for g in chunk_dedup.GEAR]
    for i, t in sorted(docs.items()):
        b, h, last, parts = t.encode(), 0, 0, []
        for p, c in enumerate(b):
            h = ((h << 1) + gear[c]) & 0xFFFFFFFF
            if (p + 1 - last >= chunk_dedup.WINDOW and not h >> (32 - chunk_dedup.BITS)) or p + 1 - last == chunk_dedup.LONGEST:
                parts.append(b[last : p + 1])
                last = p + 1
        tail = b[last:]
        if parts and len(tail) < chunk_dedup.WINDOW:
            parts[-1] += tail
        else:
            parts += [tail] if tail else []
        kept = [x for x in parts if x not in seen and not seen.add(x)]
        whole = b"".join(kept)
        got[i] = (len(b), len(parts), len(parts) - len(kept), len(b) - len(whole), hashlib.sha256(whole).hexdigest())
    return got


def test_chunk_dedup_matches_a_rolling_hash(make, messy):
    docs = dict(enumerate(texts(2) + ["a" * 3000, "a" * 3000, "short", "short", "shor"]))
    rows = chunk_dedup.op10_chunk_dedup(make(*docs.items())).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == brute_chunks(docs)
    assert chunk_dedup.op10_chunk_dedup(messy).count() == messy.count()
    assert chunk_dedup.op10_chunk_dedup(make().limit(0)).count() == 0


def test_chunks_resist_an_insertion(make):
    base = " ".join(f"w{i * 7919 % 1009}" for i in range(600))
    rows = {r.doc_id: r for r in chunk_dedup.op10_chunk_dedup(make((0, base), (1, "inserted " + base))).collect()}
    assert rows[1].n_removed > 0.9 * len(base)


def line_docs(seed, n=40):
    rng = random.Random(seed)
    pool = [" ".join(f"v{i}.{j}" for j in range(n)) for i, n in enumerate([1, 1, 2, 3, 15, 24, 26, 30, 49, 50, 51, 80])] + ["", "  "]
    docs = {i: "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for i in range(n)}
    for i in range(n, n + 6):  # long common runs
        a, b = rng.sample(range(n), 2)
        docs[i] = docs[a] + "\n" + docs[b]
    return docs


def brute_runs(docs, run, words):
    """{(doc, line): (n, source, source line)} of the maximal runs, and the covered lines of each document."""
    seqs = {i: [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")] for i, t in sorted(docs.items())}
    first, starts = {}, set()
    for i, s in seqs.items():
        for p in range(len(s)):
            for d in range(1, run + 1):
                w = tuple(s[p : p + d])
                if len(w) == d and (d == run or words is not None and sum(len(x.split()) for x in w) >= words):
                    source = first.setdefault(w, (i, p))
                    if source != (i, p):
                        starts.add((i, p, *source))
    runs, gone = set(), {i: set() for i in docs}
    for i, p, j, q in starts:
        if (i, p - 1, j, q - 1) not in starts:
            n = 0
            while p + n < len(seqs[i]) and q + n < len(seqs[j]) and seqs[i][p + n] == seqs[j][q + n]:
                n += 1
            runs.add((i, p, n, j, q))
            gone[i] |= set(range(p, p + n))
    return runs, {i: [x for p, x in enumerate(s) if p not in gone[i]] for i, s in seqs.items()}, gone


@pytest.mark.parametrize("run,words", [(2, None), (3, 50), (4, 30)])
def test_maximal_runs_are_exact(make, run, words):
    docs = line_docs(run)
    want, kept, gone = brute_runs(docs, run, words)
    got = line_dedup.maximal_runs(line_dedup.keyed(make(*docs.items())), run, words)
    assert {(r.k, r.p, r.n, r.source_k, r.source_p) for r in got.collect()} == want
    assert max(n for _, _, n, _, _ in want) > 8
    rows = line_dedup.dedup_lines(make(*docs.items()), run, words).collect()
    assert {r.k: r.n_removed for r in rows} == {i: len(g) for i, g in gone.items()}
    left = line_dedup.without_later_copies(make(*docs.items()), run, words).collect()
    stay = {i for i, k in kept.items() if k or not docs[i].strip()}
    assert {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in left} == {i: kept[i] for i in stay}


def test_line_dedup_handles_odd_rows(messy, make):
    rows = {r.doc_id: r for r in line_dedup.op9_line_dedup(messy).collect()}
    assert rows[3].n_removed == 0 and rows[4].n_removed == 30_000
    assert line_dedup.op9_line_dedup(make().limit(0)).count() == 0
    left = line_dedup.without_later_copies(make((1, "a\nb\nc\nd"), (2, "x\na\nb\nc"), (3, "a\nb\nc"), (4, None)))
    assert {r.doc_id: (r.text, r.n_chars) for r in left.collect()} == {1: ("a\nb\nc\nd", 7), 2: ("x", 1), 4: (None, None)}


def test_ids_must_be_whole_numbers(make):
    docs = make("a b c").withColumn("doc_id", F.lit("x"))
    for run in (suffix_dedup.suffix_dedup, chunk_dedup.chunk_dedup, line_dedup.dedup_lines, line_dedup.without_later_copies):
        with pytest.raises(TypeError, match="number the documents"):
            run(docs)
    assert simhash.simhash_groups(docs).first().component_id == "x"
    assert [r.doc_id for r in simhash.without_near_duplicates(docs.unionByName(docs)).collect()] == ["x"]


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    parts = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if parts and 2 * sum(x >> b & 1 for x in h) > len(parts))


def groups(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash_components_are_exact(make):
    rng = random.Random(5)
    docs = {}
    for i in range(60):
        words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 120))]
        if docs and rng.random() < 0.6:
            words = docs[rng.choice(list(docs))].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = "NEW"
        docs[i] = " ".join(words)
    fp = {i: brute_fingerprint(t) for i, t in docs.items()}
    want = groups(list(docs), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= 4)
    rows = simhash.op2_simhash_near_dedup(make(*docs.items())).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{fp[i]:016x}", want[i]) for i in docs}
    assert len(set(want.values())) < len(docs) - 5


@pytest.mark.parametrize("radius", [1, 4, 7])
def test_covering_masks_cover(radius):
    masks, rng = simhash.covering_masks(radius), random.Random(radius)
    for _ in range(300):
        diff = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(not diff & int(m) for m in masks)


def test_large_buckets_keep_all_links():
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    f = np.unique(np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) for _ in range(400)]))
    assert len(f) > simhash.DIRECT
    found = {frozenset(e) for e in simhash.forest(f, 4)}
    direct = {frozenset(e) for e in simhash._search(f, 4)}

    def parts(edges):
        root = {int(x): int(x) for x in f}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for e in edges:
            a, b = tuple(e)
            root[find(a)] = find(b)
        return len({find(i) for i in root})

    assert parts(found) == parts(direct) == 40


def test_simhash_handles_odd_rows(messy, make):
    rows = simhash.op2_simhash_near_dedup(messy).collect()
    assert len(rows) == messy.count()
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert simhash.op2_simhash_near_dedup(make().limit(0)).count() == 0


def test_verified_near_duplicates(make):
    words = [f"word{i}" for i in range(200)]
    near = words.copy()
    near[50] = "changed"
    far = [f"other{i}" for i in range(200)]
    docs = make((5, " ".join(words)), (2, " ".join(near)), (9, " ".join(words)), (1, " ".join(far)), (7, None), (8, ""), (None, "q"))
    left = simhash.without_near_duplicates(docs)
    assert sorted((r.doc_id for r in left.collect()), key=str) == [1, 2, 7, None]


def near_groups(rows, docs, **how):
    """Wanted and found groups of the distinct (id, text) rows, as sets of row numbers, and the rows kept."""
    rows = sorted(set(rows), key=str)
    sets = [set(simhash.shingle_set(t, 5).tolist()) for _, t in rows]
    want = groups(range(len(rows)), lambda a, b: sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    got, kept = {}, {}
    names = {(i, c): n for n, (i, c) in enumerate((r.doc_id, r.c) for r in docs.sparkSession.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "xxhash64(coalesce(text, '')) AS c").collect())}
    for r in simhash.near_duplicates(docs, **how).collect():
        got.setdefault(r.root, set()).add(names[r.id, r.c])
        if r.kept:
            kept.setdefault(r.root, set()).add(r.id)
    by = {}
    for i, r in want.items():
        by.setdefault(r, set()).add(i)
    assert {frozenset(g) for g in got.values()} == {frozenset(g) for g in by.values()}
    least = lambda g: min((rows[i][0] for i in g), key=lambda i: (i is None, i))
    assert all(kept[r] == {least(g)} for r, g in got.items())
    return list(by.values())


def test_near_duplicates_against_brute_force(make):
    """Whole groups: edits of many sizes, repeated ids with other texts, null ids, repeated rows."""
    rng = random.Random(12)
    rows = []
    for base in range(12):
        words = [f"w{rng.randint(0, 4000)}" for _ in range(rng.choice([40, 150, 400]))]
        for _ in range(rng.choice([1, 3, 9])):
            rows.append((len(rows), " ".join(words)))
            words = words.copy()
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
    rows += [rows[3], (rows[5][0], rows[30][1]), (None, rows[7][1]), (None, "only this"), (None, "only this"), (900, None), (901, "")]
    assert any(len(g) > 5 for g in near_groups(rows, make(*rows)))


@pytest.mark.parametrize("places", [200_000, 500])
def test_production_default_finds_appended_and_short_copies(make, monkeypatch, places):
    """Short texts with a word more, and long ones with text appended, whatever their fingerprints; a shared passage in all of some."""
    monkeypatch.setattr(simhash, "PLACES", places)
    rng = random.Random(7)
    passage, rows = [f"p{i}" for i in range(30)], []
    for base in range(240):
        n = rng.choice([6, 9, 12, 15, 40, 100, 300])
        words = [f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(n)] + (passage if base % 4 == 0 else [])
        more = [f"w{int(rng.paretovariate(0.5)) % 5000}" for _ in range(max(1, int(n * rng.choice([0.05, 0.15, 0.2, 0.24]))))]
        rows += [(2 * base, " ".join(words)), (2 * base + 1, " ".join(words + more))]
    assert len(near_groups(rows, make(*rows))) < len(rows) - 100


def test_many_copies_with_edits_of_their_own(make):
    """Copies that are near to the original and not to each other, beside a crowd that is near to nothing."""
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words))]
    for i in range(1, 60):
        own = words.copy()
        own[i] = f"edit{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, " ".join([*words[:40], *(f"x{i}.{j}" for j in range(20))])) for i in range(60)]
    found = near_groups(rows, make(*rows))
    assert max(map(len, found)) >= 55


def test_prefix_filters_lose_nothing():
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate((base[: int(n)], rng.integers(0, 2**64, int(rng.integers(0, 30)), dtype=np.uint64)))) for n in rng.integers(20, 300, 120)]
    counts = np.zeros(1 << simhash.SKETCH_BITS, np.uint64)
    for x in sets:
        np.add.at(counts, simhash._slot(x), np.uint64(1))
    for kind in (simhash._PLACE, simhash._LATE_PLACE):
        rows = []
        for i, x in enumerate(sets):
            first, _ = simhash.prefix(x, counts, 20, 0.8)
            own = np.zeros(len(first), kind)
            own["token"], own["key"], own["root"], own["size"], own["at"] = first, i, i, len(x), np.arange(len(first))
            if kind is simhash._LATE_PLACE:
                own["parity"] = np.frombuffer(simhash.parity(x), np.uint64)
            rows.append(own)
        found = {tuple(p) for p in simhash.prefix_pairs(np.concatenate(rows), 0.8).tolist()}
        want = {
            (i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))
            if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j]))
        }
        assert want and want <= found


def test_task_stars_keep_components(monkeypatch):
    rng = np.random.default_rng(3)
    for n, nodes in ((1, 5), (400, 300), (3000, 5000)):
        u, v = rng.integers(-nodes, nodes, (2, n))
        node, root = components_module.stars(u, v)
        assert len(set(node.tolist())) == len(node) and (root < node).all()
        of = dict(zip(node.tolist(), root.tolist(), strict=True))
        assert all(of.get(a, a) == of.get(b, b) for a, b in zip(u.tolist(), v.tolist(), strict=True))
        monkeypatch.setattr(components_module, "HELD", 64)
        batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 50]), pa.array(v[i : i + 50])], names=["u", "v"]) for i in range(0, n, 50)]
        got = pa.Table.from_batches(components_module._task_stars(iter(batches)))
        again = dict(zip(*(x.tolist() for x in components_module.stars(got["u"].to_numpy(), got["v"].to_numpy())), strict=True))
        assert again == of


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    want = groups(sorted({x for e in edges for x in e}), lambda a, b: (a, b) in set(edges) or (b, a) in set(edges))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: r for i, r in want.items() if i in got}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
