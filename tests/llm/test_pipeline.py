"""The pipeline against brute force, and the registered SQL."""

import collections
import hashlib
import math
import re

import pytest
from compare import oracle, spark_rows
from pyspark.sql import functions as F
from test_dedup import brute_runs, groups

import corpus_pipeline
from provenant.llm import line_dedup, mixing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_matches_its_sql(spark, name):
    assert spark_rows(queries.queries()[name](spark, SF)) == oracle(SF, queries.oracle_sql()[name])


def grams(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_quality(rows, labels):
    """Base rules, and cutoffs by exact binomial tails, in plain Python."""
    good = {}
    for r in labels:
        good[r.doc_id] = good.get(r.doc_id, True) and r.quality == 1
    signals, base = {}, {}
    for r in rows.values():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        chars = sum(map(len, w))
        five = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        count = collections.Counter(five)
        again = len({j + o for j, g in enumerate(five) if count[g] > 1 for o in range(5)})
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        share = lambda a, b: a / b if b else 0.0
        base[r.doc_id] = len(w) < 10 or 100 * again > 20 * len(w)
        signals[r.doc_id] = {
            "symbol_share": share(len(re.findall(r"[#*$%&|<>]", t)), chars), "dup_line_share": share(len(lines) - len(set(lines)), len(lines)),
            "repeat_share": share(again, len(w)), "long_word": share(chars, len(w)),
        }
    hold = {}
    for r in rows.values():
        if good.get(r.doc_id) and not base[r.doc_id]:
            hold.setdefault(r.lang, []).append(signals[r.doc_id])
    first = lambda x: min((t for t, (name, c) in enumerate(quality.PATH) if x[name] > c), default=math.inf)
    step = {}
    for lang, own in hold.items():
        n, p = len(own), quality.ALPHA
        for t in range(len(quality.PATH)):
            k = sum(first(x) <= t for x in own)
            if sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) > quality.DELTA / len(hold):
                break
            step[lang] = t
    return {i for i, r in rows.items() if not base[i] and first(signals[i]) > step.get(r.lang, -1)}


def plain_mix(rows):
    """Iterative fitting, one factor by bisection, and the draw, in plain Python."""
    cells = {}
    key = {}
    for i, r in rows.items():
        n, t = len((r.text or "").split()), r.text or ""
        symbols = len(re.findall(r"[#*$%&|<>]", t))
        form = "short" if n < 50 else "marked" if symbols * 50 > len(t) else "listed" if t.count("\n") * 8 >= n else "long" if n >= 1000 else "prose"
        key[i] = (r.source, r.lang, form)
        cells[key[i]] = cells.get(key[i], 0) + n
    total = sum(cells.values())
    mass, target = {c: n / total for c, n in cells.items()}, []
    for m, power in enumerate(mixing.POWERS.values()):
        sums = collections.Counter()
        for c, x in mass.items():
            sums[c[m]] += x
        whole = sum(x**power for x in sums.values())
        target.append({v: x**power / whole for v, x in sums.items()})
    for _ in range(400):
        for m in range(3):
            sums = collections.Counter()
            for c, x in mass.items():
                sums[c[m]] += x
            mass = {c: x * target[m][c[m]] / sums[c[m]] for c, x in mass.items()}
    weight = {c: mass[c] * total / n for c, n in cells.items()}
    low, high = 0.0, 1e9
    for _ in range(200):
        f = (low + high) / 2
        low, high = (f, high) if sum(n * min(1, weight[c] * f) for c, n in cells.items()) < mixing.BUDGET * total else (low, f)
    return {i for i in rows if int(hashlib.md5(f"{i}:42".encode()).hexdigest()[:8], 16) / 2**32 < weight[key[i]] * low}


def test_stages_against_brute_force(spark):
    """Every stage of a run, on all that its predecessor kept, against a plain version of it."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    bench = {r.item_id: grams(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas())
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(after) and set(columns) <= set(docs.columns)
        texts = {i: r.text for i, r in before.items()}
        if name == "quality rules":
            want = plain_quality(before, labels)
        elif name == "line dedup":
            _, kept, _ = brute_runs(texts, line_dedup.RUN, line_dedup.WORDS)
            want = {i for i, k in kept.items() if k}
            assert {i: [x for x in r.text.split("\n") if x.strip()] for i, r in after.items()} == {i: kept[i] for i in want}
        elif name == "SimHash near-dedup":
            sets = {i: grams(t) for i, t in texts.items()}
            root = groups(sorted(sets), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))  # noqa: B023
            want = set(root.values())
        elif name == "benchmark decontamination":
            want = {i for i, t in texts.items() if not any(len(b & grams(t)) >= 0.8 * len(b) for b in bench.values())}
        else:
            want = plain_mix(before)
        assert set(after) == want, name
        if name != "line dedup":
            assert all(after[i].text == texts[i] for i in after)
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == set(after)


CLASHING = """k c p r fp root _gone _k _c _starts _rest kept stratum n_words base_failed symbol_share cut_long_word _words good topic
weight selected _symbols _source _lang _topic a.b own blocks""".split()


@pytest.fixture(scope="module")
def odd(messy, make):
    """Odd rows that pass the rules too, and columns by every name that the stages use inside."""
    text = " ".join(f"w{i} v{i * 7 % 83}" for i in range(60)) + "\nfirst line\nsecond line\nthird line"
    more = make((20, text), (20, text), (21, text + " more"), (None, text), (22, text.upper()))
    docs = messy.select(*more.columns).unionByName(more).withColumn("lang", F.when(F.col("doc_id") != 3, F.col("lang")))
    return docs.withColumn("source", F.lit(None).cast("string")).withColumns({n: F.lit(f"own {n}") for n in CLASHING})


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_handle_odd_rows(spark, odd, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    got = stage(spark, odd, SF)
    rows = got.collect()
    added = set(mixing.ADDED) if name == "source mixing" else set()
    assert set(odd.columns) <= set(got.columns) and set(got.columns) - set(odd.columns) <= added
    assert all(r[n] == f"own {n}" for r in rows for n in CLASHING if n not in added)
    ids = sorted((r.doc_id for r in rows), key=str)
    if name == "quality rules":
        assert ids == [20, 20, 21, 22, 3, 4, 4, None]
    if name == "line dedup":
        assert {r.doc_id for r in rows if not (r.text or "").strip()} == {1, 2, 6, None}
    if name == "SimHash near-dedup":  # 1, 2, 6 and a null id have no word; 4 copies 3; 21, 22 and a null id are near 20, twice there
        assert ids == [1, 20, 3, 5, None]
    if name == "benchmark decontamination":
        assert len(rows) == odd.count()
    assert stage(spark, odd.limit(0), SF).count() == 0
