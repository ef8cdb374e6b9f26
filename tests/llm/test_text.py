"""Rules, secrets, chat, languages, decontamination and mixing."""

import hashlib
import math
import re
import time
import tracemalloc

import numpy as np
import pytest
from compare import oracle, spark_rows
from pyspark.sql import functions as F

from provenant.llm import chat, decontaminate, langid, mixing, quality, secrets


def test_counts_match_a_plain_version(make):
    texts = [
        "a b c d e f a b c d e g", "one two\none two\n\n \nthree # $ * <x>", "", None, " lead and trail ", "x\x0by\x0cz\r\nq",
        "w " * 40, "é ü 漢字 \U0001f600", "a b c d e a b c d e a b c d e",
    ]
    got = {r.doc_id: r for r in quality.with_counts(make(*texts)).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        again = {j + o for j, g in enumerate(grams) if grams.count(g) > 1 for o in range(5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, t


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 10, 400, 5000) for k in (0, 1, 3) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").select("k", "n", quality.log_binomial_tail(F.col("k"), F.col("n"), 0.01).alias("t"))
    for k, n, t in df.collect():
        want = sum(math.comb(n, j) * 0.01**j * 0.99 ** (n - j) for j in range(k + 1))
        assert math.isclose(math.exp(t), want, rel_tol=1e-9)


def test_cutoffs_need_evidence_and_hold_the_risk(spark, make):
    clean = "plain words that say many different things about the long and quiet river near our old town"
    docs = make(*[(i, f"{clean} {i}") for i in range(3000)], *[(5000 + i, clean + " ####****$$$$%%%%&&&&") for i in range(20)])
    few = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    many = spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    assert quality.judge(docs, few).filter("NOT kept").count() == 0
    judged = quality.judge(docs, many)
    assert judged.filter("NOT kept AND doc_id < 5000").count() == 0
    assert judged.filter("NOT kept AND doc_id >= 5000").count() == 20


def test_steps_are_certified_in_order_and_hold_the_risk(spark):
    """The chosen step equals a plain version's, and over many draws the true share of rejections rarely passes alpha."""
    rng = np.random.default_rng(7)
    n_steps, draws, n = len(quality.PATH), 60, 600
    share = np.cumsum(np.full(n_steps, 0.0016))  # the true share that steps up to t reject: beyond alpha from step 12 on
    rows = []
    for d in range(draws):
        at = np.searchsorted(share, rng.random(n), "right")
        rows += [(f"d{d}", int(t) if t < n_steps else None) for t in at]
    frame = spark.createDataFrame(rows, "stratum string, rejected_at int")
    got = {}
    for d in range(draws):  # one stratum at a time, so the level is delta itself
        own = [t for s, t in rows if s == f"d{d}"]
        step = -1
        for t in range(n_steps):
            k = sum(x is not None and x <= t for x in own)
            if sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) > 0.05 / draws:
                break
            step = t
        got[f"d{d}"] = step
    found = {r.stratum: r.step for r in quality.certified_steps(frame).collect()}
    assert found == {s: t for s, t in got.items() if t >= 0} and len(set(found.values())) > 1
    alone = [quality.certified_steps(frame.filter(f"stratum = 'd{d}'")).collect() for d in range(12)]
    assert sum(r[0].step >= 12 for r in alone if r) <= 2
    cuts = {(r.stratum, r.signal): r.cutoff for r in quality.cutoffs(spark.createDataFrame([("x", 5)], "stratum string, step int")).collect()}
    assert cuts == {("x", s): min(c for q, c in quality.PATH[:6] if q == s) for s in {q for q, _ in quality.PATH[:6]}}


def test_verdicts_match_the_sql_where_strata_certify(spark, tmp_path):
    """Whole query against its SQL on tables in which the method decides."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows, flags = [], []
    for i in range(2400):
        text = " ".join(rng.choice(words, 30))
        bad = i % 40 == 0
        rows.append((i, text + (" ####$$$$%%%%&&&&" * 4 if bad else "") + ("\n" + "same line of words\n" * 3 if i % 90 == 1 else ""), ["en", "fr", None][i % 3], "s", 1))
        flags.append((i, int(not bad), 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "d"))
    spark.createDataFrame(flags, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / "l"))
    for name in ("d", "l"):
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{ {'d': 'documents', 'l': 'labels'}[name] }.parquet")
    got = quality.op7_quality_rules(*(spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")))
    assert spark_rows(got) == oracle(tmp_path, quality.ORACLE)
    assert got.filter("NOT kept AND NOT base_failed").select(F.pmod("doc_id", F.lit(3))).distinct().count() == 3


def test_quality_handles_odd_rows(spark, messy, make):
    labels = spark.createDataFrame([(None, 1, None), (3, None, 0), (4, 1, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.op7_quality_rules(messy, labels).collect()
    assert len(rows) == messy.count() and all(not r.kept for r in rows if r.n_words < 10)
    assert quality.op7_quality_rules(make().limit(0), labels.limit(0)).count() == 0


SECRETS = [
    'token = "abcdef"; password:short1 passwd=ab secret:token:abcdefgh', "AKIA" + "A" * 15, "AKIA" + "B" * 16 + "AKIA", "g" + "0a" * 12 + "g",
    "0" * 23, "é\U0001f600 API_KEY='x-9=.+/_' Apikey: zzzzzz", None, "", "-----BEGIN RSA PRIVATE KEY-----", "token=" + "a" * 40,
]


def test_secret_spans(make):
    base = {
        "assign": r"((?:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        "access": r"AKIA[A-Z0-9]+",
        "hex": r"[0-9a-f]+",
    }
    got = {r.doc_id: r for r in secrets.op4_secret_scan(make(*SECRETS)).collect()}
    for i, t in enumerate(SECRETS):
        spans = []
        for place, (kind, p) in enumerate(base.items()):
            for m in re.finditer(p, t or "", re.I | re.A if kind == "assign" else 0):
                if len(m[2]) >= 6 if kind == "assign" else len(m[0]) >= (20 if kind == "access" else 24):
                    spans.append((m.start(), place, m.end(), kind))
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest(), t
        counts = [sum(s[3] == k for s in spans) for k in base]
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == counts
    assert got[8].spans.startswith("pem:0:")


def test_ledger_scans_each_blob_once(spark, make, tmp_path):
    where = f"file://{tmp_path}/ledger"
    first = secrets.with_blob(make("token=abcdefg", "token=abcdefg", "plain"))
    assert secrets.update_ledger(first, where).count() == 2
    second = secrets.with_blob(make("token=abcdefg", "fresh secret=qwertyu"))
    assert secrets.update_ledger(second, where).count() == 2 and spark.read.parquet(where).count() == 3
    spark.read.parquet(where).write.mode("append").parquet(f"{where}-twice")
    spark.read.parquet(where).write.mode("append").parquet(f"{where}-twice")  # as if two writers had met
    got = secrets.find_secrets(make("token=abcdefg", "token=abcdefg", "plain"), f"{where}-twice")
    assert sorted(r.spans for r in got.collect()) == ["", "assign:0:13", "assign:0:13"]
    assert secrets.update_ledger(second, where, rule_version=2).count() == 2
    assert spark.read.parquet(where).groupBy("blob_id", "rule_version").count().filter("count > 1").count() == 0


def test_secrets_handle_odd_rows(messy, make):
    held = messy.withColumn("text", F.when(F.col("doc_id") == 4, F.concat("text", F.lit("secret: abcdef"))).otherwise(F.col("text")))
    got = secrets.op4_secret_scan(held.withColumns({c: F.lit(c) for c in ("blob_id", "spans", "path", "at")})).collect()
    size = len(messy.filter("doc_id = 4").first().text)
    assert sorted((str(r.doc_id), r.spans) for r in got if r.spans) == [("4", f"assign:{size}:{size + 14}")] * 2
    assert len(got) == messy.count() and all(r.n_assign == (r.doc_id == 4) for r in got)
    assert secrets.op4_secret_scan(make().limit(0)).count() == 0


TURNS = "conv_id long, turn long, role string, text string"
ODD = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "", None, "<|", "\n\n  x\n", "\U0001f600 é <|endoftext|>", "\\", "<\\\\|x"]


def test_escape_is_reversible():
    for t in ODD:
        t = t or ""
        assert "<|" not in chat.escape(t) and chat.unescape(chat.escape(t)) == t
    turns = [("a\nb\\n<|", "x"), ("user", "<|im_end|>\n"), ("assistant", "")]
    assert chat.parse(chat.render(turns)[0]) == turns


def test_chat_digests(spark):
    rows = [(c, i, role, t) for c in (1, 2, None) for i, (role, t) in enumerate(zip(["user", "assistant", None] * 3, ODD, strict=True))]
    rows += [(3, 1, "assistant", "second"), (3, 0, "assistant", "first"), (3, None, "system", "zeroth")]
    # marks that only the seam of two texts would make; repeated rows; a very long text
    rows += [(4, 0, "assistant", "abc<"), (4, 1, "assistant", "\\|x"), (5, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "assistant", "a <| b " * 40_000)]
    got = {r.conv_id: r for r in chat.op3_chat_format(spark.createDataFrame(rows, TURNS)).collect()}
    told = "<|im_end|><|im_start|>assistant ok"
    want = {c: [(r or "", t or "") for k, _, r, t in rows if k == c] for c in (1, 2, 4, 5, None)}
    want |= {3: [("system", "zeroth"), ("assistant", "first"), ("assistant", "second")], -1: [("user", told), ("assistant", told)]}
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), digest)
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    clashing = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(c) for c in ("formatted", "spans", "loss_mask", "token_ids", "id")})
    assert {r.conv_id: r for r in chat.op3_chat_format(clashing).collect()} == got
    named = chat.format_conversations(spark.createDataFrame(rows, TURNS).withColumn("conv_id", F.concat(F.lit("c"), "conv_id")))
    assert {r.conv_id for r in named.collect()} == {"c1", "c2", "c3", "c4", "c5", None}
    assert {r.conv_id for r in chat.op3_chat_format(spark.createDataFrame([], TURNS)).collect()} == {-1}


def test_chat_masks_agree_with_tokens(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "é \U0001f600 <|im_end|> ok"), (1, 2, "assistant", ""), (1, 3, "assistant", "more")]
    got = chat.format_conversations(spark.createDataFrame(rows, TURNS)).first()
    tokens = chat.load_tokenizer(chat.vocabulary()).encode(got.formatted, add_special_tokens=False)
    assert got.token_ids == tokens.ids and len(got.loss_mask) == len(tokens.ids)
    inside = lambda a, b: any(a < e and b > s for s, e in got.spans)
    assert got.loss_mask == [inside(a, b) for a, b in tokens.offsets]


def test_loss_mask_covers_assistant_tokens_only():
    tokens = np.array([(0, 3), (3, 6), (6, 7), (6, 7), (7, 10), (10, 12)])
    mask, under = chat.loss_spans(tokens, [(4, 7), (10, 11)])
    assert mask.tolist() == [False, True, True, True, False, True] and under == [[(4, 7)], [(10, 11)]]
    assert chat.loss_spans(tokens, [(3, 3), (7, 9), (9, 12)])[1] == [[], [(7, 9)], [(9, 12)]]


def test_language_of_words_and_documents(spark):
    rng = np.random.default_rng(1)
    ends = {"xx": ["ation", "the", "ing", "of"], "yy": ["eux", "aient", "le", "ou"], "zz": ["keit", "ung", "der", "sch"]}
    stem = lambda: "".join(rng.choice(list("bdgklmnprst")) + rng.choice(list("aeiou")) for _ in range(2))
    text = lambda lang, n: " ".join(stem() + str(rng.choice(ends[lang])) for _ in range(n))
    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(list(ends) * 60)]
    rows += [(9000, None, "xx"), (9001, "123 456 !!", "xx"), (9002, text("xx", 40) + " " + text("yy", 20), None), (None, text("zz", 30), "zz")]
    rows += [(9003, "", "yy"), (9004, text("yy", 20_000), "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.op6_language_id(docs).collect()}
    lang = {i: x for i, _, x in rows if i is not None and i < 9000 or i == 9004}
    held = [i for i in lang if got[i].held_out]
    assert len(held) > 30 and sum(got[i].lang_pred == lang[i] for i in held) >= 0.98 * len(held)
    assert got[9004].lang_pred == "yy" and got[9002].lang_pred == "xx" and got[9002].n_langs == 2 and 0.5 < got[9002].score < 0.8
    assert [got[i].lang_pred for i in (9000, 9001, 9003)] == ["und"] * 3
    assert langid.op6_language_id(docs.limit(0)).count() == 0


def test_languages_are_bounded_and_ids_free(spark, messy):
    rows = [(2**63 - 1 - i, f"{'alpha beta gamma' if i % 2 else 'eins zwei drei'} {i} " * 8, "xx" if i % 2 else "yy") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = {str(r.doc_id): (r.lang_pred, r.held_out) for r in langid.op6_language_id(docs).collect()}
    assert {p for p, _ in want.values()} == {"xx", "yy"}
    named = docs.withColumn("doc_id", F.col("doc_id").cast("string")).withColumns({c: F.lit(c) for c in ("held_out", "score", "_n", "_d")})
    got = langid.op6_language_id(named.unionByName(named))  # repeated rows get equal results
    assert {r.doc_id: (r.lang_pred, r.held_out) for r in got.collect()} == want and got.count() == 120
    assert langid.op6_language_id(messy).count() == messy.count()
    with pytest.raises(ValueError):
        langid.op6_language_id(docs.withColumn("lang", F.col("doc_id").cast("string")).unionByName(spark.range(400).selectExpr("id AS doc_id", "'a b' AS text", "string(id) AS lang")))
    assert langid.table_bits(4) == 17 and langid.table_bits(100) * 1 <= 15


def test_expected_pairs_equal_an_enumeration():
    rng = np.random.default_rng(4)
    psi, step = np.exp(rng.normal(size=(3, 4, 3))), np.exp(rng.normal(size=(3, 3)))
    want = np.zeros((3, 3))
    for n in range(3):
        own, whole = np.zeros((3, 3)), 0.0
        for path in np.ndindex(3, 3, 3, 3):
            # the first label has been reached from any of the labels alike
            weight = step[:, path[0]].sum() * np.prod([psi[n, t, x] for t, x in enumerate(path)]) * np.prod([step[a, b] for a, b in zip(path, path[1:], strict=False)])
            whole += weight
            for a, b in zip(path, path[1:], strict=False):
                own[a, b] += weight
        want += own / whole
    assert np.allclose(langid._pair_counts(psi, step, 3), want)


def test_chunked_recursion_equals_the_plain_one():
    rng = np.random.default_rng(2)
    moves = rng.normal(size=(3, 3))
    sizes = [1, 63, 64, 65, 200, 0, 3]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    e = rng.normal(size=(len(doc), 3))
    got = langid.document_mass(e, doc, np.ones(len(doc), bool), len(sizes), moves)
    for d, n in enumerate(sizes):
        psi, step = np.exp(e[doc == d]), np.exp(moves)
        alpha, beta = np.zeros((n, 3)), np.ones((n, 3))
        a = np.full(3, 1 / 3)
        for t in range(n):
            a = (a @ step) * psi[t]
            alpha[t] = a = a / a.sum()
        for t in range(n - 2, -1, -1):
            b = step @ (psi[t + 1] * beta[t + 1])
            beta[t] = b / b.sum()
        p = alpha * beta
        assert np.allclose(got[d], (p / p.sum(axis=1, keepdims=True)).sum(axis=0) if n else 0)


def test_decontamination_is_exact(spark, make):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 3000)}"
    items = [(i, " ".join(word() for _ in range(int(n)))) for i, n in enumerate([1, 3, 5, 6, 9, 15, 30, 57, 200])]
    docs = []
    for d in range(60):
        body = [word() for _ in range(int(rng.integers(0, 900)))]
        if d % 3 == 0:
            item = items[int(rng.integers(len(items)))][1].split()
            if len(item) > 20 and d % 2:
                item[3] = "changed"
            at = int(rng.integers(len(body) + 1))
            body[at:at] = item
        docs.append((d, " ".join(body).upper() if d % 5 == 0 else " ".join(body)))
    docs += [(100, items[2][1]), (101, None), (102, ""), (None, items[6][1])]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - 4))} if (t or "").split() else set()
    want = {(d, i) for d, t in docs for i, x in items if grams(x) and len(grams(x) & grams(t)) >= 0.8 * len(grams(x))}
    bench = spark.createDataFrame([*items, (None, "w1 w2"), (50, None)], "item_id long, text string")
    table = make(*docs)
    for block in (1 << 20, 40):
        got = decontaminate.contamination(table, bench, block=block)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    for block in (1 << 20, 40):
        left = {r.doc_id for r in decontaminate.decontaminated(table, bench, block=block).collect()}
        assert left == {d for d, _ in docs} - {d for d, _ in want}
    inside = {(d, 1) for d, t in docs if f" {items[1][1]} " in f" {(t or '').lower()} "}
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(table, bench, short_from=3).collect()}
    assert got == want | inside and inside - want
    assert decontaminate.contamination(table, bench.limit(0)).count() == 0
    assert decontaminate.contamination(table.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_decontamination_handles_odd_rows(messy, spark, block):
    """Repeated documents repeat, ids and items may be text, clashing columns stay, very long texts are searched whole."""
    long = "".join(f"word{i} other{i % 97}\n" for i in range(30_000)).split()
    items = [("a", " ".join(long[-20:])), ("a", "something else that is nowhere at all"), ("b", " ".join(long[500:520])), (None, " ".join(long[:20])), ("c", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    docs = messy.withColumn("doc_id", F.col("doc_id").cast("string")).withColumns({c: F.lit(c) for c in ("id", "item", "d", "s", "n_item", "value")})
    got = decontaminate.contamination(docs, bench, block=block)
    assert sorted((r.doc_id, r.item_id, r.containment) for r in got.collect()) == sorted((d, i, 1.0) for d in "344" for i in "ab")
    left = decontaminate.decontaminated(docs, bench, block=block)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {"1", "2", "5", "6", None}


def test_bins_hold_the_miss_bound():
    for c in range(12):
        block, bits = decontaminate.bins_of(c, 0.8, 1e-12)
        assert (block / 2 ** (bits + 1)) ** max(1, math.ceil(0.8 * 2**c)) <= 1e-12 * 1.0001


def test_raking_meets_the_margins(spark):
    cells = [("a", "x", "p", 90), ("a", "y", "q", 5), ("b", "x", "q", 3), ("b", "y", "p", 2), (None, "x", "p", 0), ("a", "x", "q", 7), ("b", "y", "q", 9)]
    targets = mixing.default_targets(cells)
    mass = mixing.rake(cells, targets, 200)
    for i, m in enumerate(mixing.MARGINS):
        for v, t in targets[m].items():
            assert math.isclose(sum(x for c, x in zip(cells, mass, strict=True) if c[i] == v), t, abs_tol=1e-6)


@pytest.mark.parametrize("cells", [mixing.MAX_CELLS, 0])
def test_mixing_meets_given_targets(make, cells):
    texts = [f"{'star planet' if i % 3 else 'goal match'} {'w ' * (20 + i % 50)}" for i in range(600)]
    docs = make(*texts).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3)).withColumn("lang", F.when(F.col("doc_id") % 4 != 0, "en"))
    topic = mixing.topic_by_words({"space": ["star", "planet"], "sport": ["goal", "match"]})
    # the topic follows the source here, so targets of both must agree
    targets = {"source": {"s0": 0.5, "s1": 0.2, "absent": 0.1}, "lang": {None: 0.7}, "topic": {"sport": 0.5 / 0.9}}
    rows = mixing.mix(docs, targets, topic, max_cells=cells, budget=0.1).select("source", "lang", "topic", "n_tokens", "probability").collect()
    assert {r.topic for r in rows} == {"space", "sport"}
    whole = sum(r.n_tokens * r.probability for r in rows)
    share = lambda **k: sum(r.n_tokens * r.probability for r in rows if all(r[c] == v for c, v in k.items())) / whole
    assert math.isclose(whole, 0.1 * sum(r.n_tokens for r in rows), rel_tol=1e-6)
    assert math.isclose(share(source="s0"), 0.5 / 0.9, rel_tol=1e-6) and math.isclose(share(source="s1"), 0.2 / 0.9, rel_tol=1e-6)
    assert math.isclose(share(lang=None), 0.7, rel_tol=1e-6)
    with pytest.raises(ValueError):
        mixing.mix(docs, {"lang": {"en": -1}}, max_cells=cells)


def test_fitting_warns_of_targets_that_no_table_meets():
    cells = [("a", "x", "p", 5), ("b", "y", "p", 5)]
    with pytest.warns(UserWarning, match="margins differ"):
        mixing.rake(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"x": 0.5, "y": 0.5}, "topic": {"p": 1.0}}, 50)


@pytest.mark.parametrize("cells", [mixing.MAX_CELLS, 0])
def test_mixing_paths_agree_and_handle_odd_rows(make, messy, cells):
    docs = messy.unionByName(make(*[(i, f"w{i} " * (i % 70)) for i in range(100, 200)]), allowMissingColumns=True)
    got = mixing.mix(docs, rounds=3, max_cells=cells)
    rows = got.select("doc_id", "weight", "probability", "selected").collect()
    assert len(rows) == docs.count() and all(0 <= r.probability <= 1 for r in rows)
    assert mixing.mix(make().limit(0), rounds=1, max_cells=cells).count() == 0
    if cells == 0:
        other = mixing.mix(docs, rounds=3).select("doc_id", "weight").collect()
        a, b = (sorted((str(r.doc_id), round(r.weight, 6)) for r in x) for x in (rows, other))
        assert a == b


@pytest.mark.parametrize("cells", [mixing.MAX_CELLS, 0])
def test_mixing_keeps_its_budget_beside_a_rare_cell(make, cells):
    docs = make(*[f"w{i} " * 60 for i in range(2000)])
    stray = make((9999, "one two three four five six")).withColumn("source", F.lit("rare"))
    for table in (docs, docs.unionByName(stray)):
        rows = mixing.mix(table, rounds=3, max_cells=cells).select("source", "n_tokens", "probability").collect()
        whole = sum(r.n_tokens for r in rows)
        assert math.isclose(sum(r.n_tokens * r.probability for r in rows), mixing.BUDGET * whole, rel_tol=1e-6)
        assert all(r.probability == 1 for r in rows if r.source == "rare")


def test_mixing_factor_saturates():
    assert math.isclose(mixing.scale_to([(100.0, 10), (1.0, 500), (0.5, 490)], 382.5), 0.5)
    assert mixing.scale_to([(2.0, 5), (0.5, 5)], 10) == 2 and mixing.scale_to([], 1) == 0


def test_secret_scan_is_linear_in_matches(make):
    """Starts are exact, and a text of 200,000 matches takes no more for each than one of a few."""
    n = 200_000
    text = "\n".join(f"{i:032x}" for i in range(n))
    took = time.monotonic()
    rows = {r.doc_id: r for r in secrets.op4_secret_scan(make((1, text), (2, "eyJ" * 100_000), (3, "token=abcdef " + "f" * 24))).collect()}
    assert time.monotonic() - took < 240
    assert rows[1].n_hex == n and rows[2].spans == "" and rows[3].spans == "assign:0:12,hex:13:37"
    assert rows[1].spans == ",".join(f"hex:{33 * i}:{33 * i + 32}" for i in range(n))


def random_model(size, seed=1):
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.3, (2 ** langid.table_bits(size), size)).astype(np.float32)
    return langid.Model([f"l{i}" for i in range(size)], table, np.empty(0, np.uint64), rng.normal(0, 0.3, (1, size)).astype(np.float32), rng.normal(0, 1, (size, size)))


def test_pieces_of_a_long_text_give_what_the_whole_gives():
    rng = np.random.default_rng(4)
    model = random_model(5)
    text = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(3000)) + " " + "x" * 900 + " \n tail"
    data = np.frombuffer(text.encode(), np.uint8)
    w = langid.words_in(np.array([0, len(data)]), data, langid.table_bits(5))
    want = langid.document_mass(model.emissions(w), w.doc, w.letter, 1, model.moves)
    for limit in (100, 777, 5000, len(data)):
        pieces = langid.pieces_of(data, limit)
        assert b"".join(p.tobytes() for p in pieces) == text.encode() and (len(pieces) > 2 or limit > 5000)
        assert np.allclose(langid.long_mass(data, model, limit), want, rtol=1e-7, atol=1e-9)


@pytest.mark.parametrize("size,megabytes", [(4, 12), (40, 1)])
def test_memory_does_not_follow_the_text(size, megabytes):
    """A text of many pieces takes the memory of one (the text itself and its places aside)."""
    data = np.frombuffer(b"some words of several lengths, and more " * (megabytes * 26_000), np.uint8)
    model, limit = random_model(size), langid.piece_bytes(size)
    assert len(data) > 4 * limit
    tracemalloc.start()
    mass = langid.long_mass(data, model, limit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(mass.sum() - 7 * megabytes * 26_000) < 1 and peak < 400 << 20


def test_numerals_are_no_letters(spark, make):
    model = random_model(3)
    got = {r.doc_id: r.lang_pred for r in langid.identify(make("½ ② 12", "½ é", "漢"), model).collect()}
    assert got[0] == "und" and got[1] != "und" and got[2] != "und"
