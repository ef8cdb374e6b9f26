"""Repair of conversation structure against a plain version."""

import hashlib
import random
import re
import zlib

import pytest
from compare import oracle, spark_rows

from provenant.llm import turn_repair

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def broken(rows):
    """Rows (conv, turn, role, text) with the query's faults."""
    out = []
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        code = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain(conv_rows):
    """The report of one conversation's rows, by a table of (cost, edits) from the end."""
    rows = sorted(conv_rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3][:64].encode(), hashlib.md5(r[3].encode()).digest()))
    turns = [r[1] for r in rows if r[1] is not None]
    faults, seen = [], set()
    for _, _, role, text in rows:
        found = WORD.findall(text)
        faults.append("b" if not found else "d" if (role, text) in seen else "t" if found[-1] not in ".!?" else "")
        seen.add((role, text))
    initials = [r[2][:1] for r in rows]
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ()), "a": (0, "", ())}

    def inserts(best):
        for _ in range(3):
            for state, to in after.items():
                if to in best:
                    c, e, r = best[to]
                    cand = (c + 3, "I" + e, ((to, ""), *r))
                    best[state] = min(best.get(state, cand), cand, key=lambda x: x[:2])
        return best

    best = inserts(dict(best))
    full = {"u": "user", "a": "assistant"}
    for (_, _, role, text), fault in reversed(list(zip(rows, faults, strict=True))):
        now = {}
        for state, to in after.items():
            options = []
            if state in best:
                c, e, r = best[state]
                options.append((c + 4, "D" + e, r))
            extra = 3 * (fault == "t")
            if fault not in ("b", "d"):
                i = role[:1]
                if (i == to or i == "s" and state == "") and i in best:
                    c, e, r = best[i]
                    options.append((c + extra, "K" + e, ((role, text), *r)))
                if to in best:
                    c, e, r = best[to]
                    options.append((c + 3 + extra, "R" + e, ((full[to], text), *r)))
            if options:
                now[state] = min(options, key=lambda x: x[:2])
        best = inserts(now)
    cost, audit, kept = best[""]
    kept = [(full.get(r, r), t) for r, t in kept]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[faults.count(f) for f in "bdt"],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest(),
    )


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return {c: plain(v) for c, v in groups.items()}


def got(frame):
    out = {}
    for r in frame.collect():
        assert r[0] not in out
        out[r[0]] = tuple(r[1:])
    return out


def noisy(seed, n, convs):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "user", "assistant", "system", "tool", "", None], ["Yes.", "no", "", " \t", "why?", None, "ok\n", "go! ", "ü", "w " * 40 + "x", "w " * 40 + "y."]
    return [(rng.choice([*range(convs), None]), rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def whole(rows):
    return [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]


@pytest.mark.parametrize("block_rows", [None, 1, 3])
def test_repair_equals_the_plain_version(spark, block_rows):
    rows = noisy(7, 500, 30)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert got(turn_repair.report(turn_repair.repair(frame, block_rows))) == expected(whole(rows))


def test_query_equals_the_plain_version(spark):
    frame = spark.read.parquet(f"{SF}/conversations.parquet")
    rows = [tuple(r) for r in frame.select("conv_id", "turn", "role", "text").collect()]
    want = expected(broken(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(turn_repair.op11_conversation_repair(frame)) == {c: want.get(c, none) for c in {r[0] for r in rows}}


def test_odd_rows_extra_columns_and_empty_tables(spark):
    rows = noisy(3, 200, 12)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", conv int, block string")
    want = expected(broken(rows))
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got(turn_repair.op11_conversation_repair(frame)) == {c: want.get(c, none) for c in {r[0] for r in rows}}
    assert turn_repair.op11_conversation_repair(frame.limit(0)).count() == 0


def test_one_conversation_of_many_rows_and_copies(spark):
    """A long conversation is cut over partitions and blocks; copies shrink before they are shuffled."""
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant"]), rng.choice(["Hi.", f"t{t}.", f"t{t}"])) for t in range(9000)]
    rows += [(1, None, "user", "same")] * 9000 + [(2, 0, "user", "Hi."), (2, 1, "assistant", "Yes.")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(6)
    found = turn_repair.repair(frame)
    assert found.filter("conv = 1").count() >= 4
    assert got(turn_repair.report(found)) == expected(rows)
    assert turn_repair.repaired_rows(found).filter("conv_id = 2").count() == 2


def test_a_long_signature_is_solved_without_deep_calls():
    solver = turn_repair.Signature("uAaU" * 20_000 + "d", (0, 6, 3, 0))
    edits, state = solver.edits(turn_repair.NONE)
    assert len(edits.replace("I", "")) == 80_001 and state in (0, 1, 2, 3)


def test_query_matches_its_sql(spark):
    got = spark_rows(turn_repair.op11_conversation_repair(spark.read.parquet(f"{SF}/conversations.parquet")))
    assert got == oracle(SF, turn_repair.ORACLE)
