"""URL filter and filter audit against plain versions and their SQL."""

import itertools
import math
import re
from collections import Counter

import pytest
from compare import oracle, spark_rows

from provenant.llm import filter_audit, url_filter

SF = "/root/testdata/sf0.001"

# -- filter audit ------------------------------------------------------------------

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_audit(docs, labels):
    """Every order, filter by filter, over (doc_id, text, source) and (doc_id, quality, toxic)."""
    good, toxic = ({d for d, *v in labels if v[i] == 1 and d is not None} for i in (0, 1))
    place = lambda d: math.inf if d is None else d
    first = {}
    for d, t, _ in docs:
        first[t or ""] = min(first.get(t or "", math.inf), place(d))
    parts, out = {}, {}
    for d, t, s in docs:
        t = t or ""
        w = WORDS.findall(t)
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": re.search("[#$%&*|]", t) is not None, "E": place(d) > first[t],
        }
        parts.setdefault(s or "", []).append((d, {k for k, v in fails.items() if v}))
    for part, rows in parts.items():
        removed_over_all = Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                removed_over_all[f] += len(here)
                out[part, "".join(order), step] = [
                    len(left), len(here), sum(f in r[1] for r in rows) - len(here), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in here), sum(r[0] in toxic for r in here)
                ]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(removed_over_all[order[step - 1]])
    return out


def audited(frame):
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in frame.collect()}


def test_audit_equals_every_order_played_through(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "a"), (None, long, "b"), (3, "x " * 80, "a"), (4, "AB " * 60, None), (5, long + " $5", ""), (6, None, "b"), (7, "", "b"),
        (8, "$ A", "a"), (None, "once", "c"), (9, " \t\n", "a"), (10, "Äß " * 70, "c"), (2**62, long + " 100%", "c"),
    ]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (4, None, 1), (None, 1, 1), (9, 1, None), (77, 1, 1)]
    frame = spark.createDataFrame([(*d, 0, "x") for d in docs], "doc_id long, text string, source string, mask int, part string")
    flags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert audited(filter_audit.audit(frame, flags)) == plain_audit(docs, labels)
    assert filter_audit.audit(frame.limit(0), flags).count() == 0
    assert all(r.good_lost == 0 for r in filter_audit.audit(frame, flags.limit(0)).collect())
    with pytest.raises(TypeError, match="number the documents"):
        filter_audit.audit(frame.withColumn("doc_id", frame.doc_id.cast("string")), flags)


def test_parities_invert_to_the_counts(spark):
    rows = [("p", m, m % 3 == 0, m % 5 == 0) for m in range(32) for _ in range(m * m % 7)]
    cells = filter_audit.mask_cells(filter_audit.parity_sums(spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean"))).collect()[0]
    for name, keep in (("all", lambda r: True), ("good", lambda r: r[2]), ("toxic", lambda r: r[3])):
        assert cells[f"n_{name}"] == [sum(r[1] == m and keep(r) for r in rows) for m in range(32)]


def test_audit_matches_its_sql(spark):
    got = spark_rows(filter_audit.op13_filter_audit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")))
    assert got == oracle(SF, filter_audit.ORACLE)


# -- URL filter --------------------------------------------------------------------

PAGES = "page_id long, url string, html string, host string, s string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, None, "clash", "clash") for i, u in enumerate(urls)], PAGES)


def test_rules(spark):
    urls = {
        "http://a.net/x": ("net/", "block"),
        "http://a.net": (None, None),
        "HTTP://WWW.EXAMPLE.NET/en/1?q#f": ("example.net/en/", "allow"),
        "http://example.net/EN/": ("net/", "block"),
        "http://badexample.net/en/": ("net/", "block"),
        "http://example.com/de/": ("example.com/de/", "block"),
        "http://example.com/den": (None, None),
        "http://x.org/fr/://net/": ("org/fr/", "allow"),
        "http://org?/fr/": (None, None),
        "net/": (None, None),
        None: (None, None),
        "": (None, None),
        "://net/": ("net/", "block"),
    }
    got = {r.url: r for r in url_filter.judge(pages(spark, urls).select("page_id", "url")).join(pages(spark, urls).select("page_id", "url"), "page_id").collect()}
    for url, (rule, verdict) in urls.items():
        assert got[url].rule == rule and got[url].verdict == (verdict or "allow")
    assert (got["HTTP://WWW.EXAMPLE.NET/en/1?q#f"].host, got["HTTP://WWW.EXAMPLE.NET/en/1?q#f"].path) == ("www.example.net", "/en/1")
    assert (got["net/"].host, got["net/"].path, got[None].host, got["http://a.net"].path) == ("", "", "", "")


def plain_score(train, url, order=url_filter.ORDER, beta=url_filter.BETA):
    """Log-likelihood difference over length by the recursion itself, without pruning."""
    counts = {c: Counter() for c in (True, False)}
    for s, ok in train:
        q = "\x01" + s + "\x02"
        for i in range(len(q)):
            for n in range(1, min(i, order) + 2):
                if i or n == 1:
                    counts[ok][q[i - n + 1 : i + 1]] += 1
    total = {c: sum(v for g, v in counts[c].items() if len(g) == 1 and g != "\x01") for c in counts}

    def p(c, ok, context):
        lower = 1 / url_filter.SYMBOLS if not context else p(c, ok, context[1:])
        n = counts[ok][context] if context else total[ok]
        return (counts[ok][context + c] + beta * lower) / (n + beta)

    q = "\x01" + url + "\x02"
    return sum(math.log(p(q[i], True, q[max(0, i - order) : i]) / p(q[i], False, q[max(0, i - order) : i])) for i in range(1, len(q))) / (len(q) - 1)


def test_weights_add_up_to_the_mixed_model(spark):
    train = [("example.net/en/1", True), ("x.org/fr/22", True), ("a.net/x", False), ("spam.net/en/", False), ("example.com/de/9", False)]
    rows = spark.createDataFrame([(str(i), s, ok) for i, (s, ok) in enumerate(train)], "h string, s string, ok boolean")
    weights, nothing, start = url_filter.string_weights(url_filter.string_counts(rows))
    urls = ["x.org/en/1", "spam.com/x", "", "zzz~", "example.net/en/1", "ü.net/" + "ab" * 300]
    frame = spark.createDataFrame([(str(i), u) for i, u in enumerate(urls)], "h string, s string")
    got = {int(r.h): r.bucket for r in url_filter.scores(frame, weights, nothing, start).collect()}
    for i, u in enumerate(urls):
        assert got[i] == math.floor(round(plain_score(train, u.replace("ü", "\x7f")), 9) / url_filter.GRID)


def test_a_pruned_tree_keeps_its_bound_and_the_parts_of_its_strings(spark):
    rows = spark.createDataFrame([(str(i), f"host{i % 7}.net/p{i}", i % 2 == 0) for i in range(200)], "h string, s string, ok boolean")
    counted = url_filter.string_counts(rows)
    kept = {r.key for r in url_filter.pruned(counted, 100).collect()}
    assert 0 < len(kept) <= 100 < counted.count()
    for key in kept:
        symbols = [key >> 7 * i & 127 for i in range(6) if key >> 7 * i]
        if len(symbols) > 1:
            assert key >> 7 in kept and key & (1 << 7 * (len(symbols) - 1)) - 1 in kept


def test_the_method_blocks_what_looks_blocked(spark):
    urls = [f"http://good{i}.example.net/en/story-{i}" for i in range(80)] + [f"http://bad{i}.net/buy?pills={i}" for i in range(80)]
    urls += ["http://good.example.com/en/story-5"] * 3 + ["http://bad.com/buy?pills=5", None, "http://bad.com/buy?pills=" + "1" * 20_000]
    got = [r.verdict for r in url_filter.judge(pages(spark, urls)).orderBy("page_id").collect()][160:]
    assert got[:4] == ["allow"] * 3 + ["block"] and len(got) == 6
    assert url_filter.judge(pages(spark, urls).limit(0)).count() == 0


def test_filter_runs_no_python(spark):
    plan = url_filter.op12_url_filter(spark.read.parquet(f"{SF}/pages.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"))


def test_url_filter_matches_its_sql(spark):
    assert spark_rows(url_filter.op12_url_filter(spark.read.parquet(f"{SF}/pages.parquet"))) == oracle(SF, url_filter.ORACLE)
