"""Repair of conversation structure: cheapest edits, found once for each distinct signature.

A conversation's rows in order become a string of roles and faults, its
signature: ``s``, ``u``, ``a`` or ``x`` (any other role), in capitals if the
text is cut short, and ``d`` for rows that must go.  Most conversations share
few signatures, so each distinct one is solved once, by a memoised recursion
over (place, role before), and the edits are joined back and replayed on the
rows.

No conversation is gathered whole.  Rows are sorted over range partitions and
cut into blocks of at most ``BLOCK_ROWS`` rows; a conversation of several
blocks is solved through them: distinct block signatures give the costs between
the four roles before and after a block, these are chained backwards over the
blocks (a few numbers each), and then each block is solved for its own costs at
the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, scratch
from .shared import lean

#: Costs of the edits (fixed values).
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
#: Role before a place: none, system, user, assistant.
NONE, SYSTEM, USER, ASSISTANT = range(4)
#: The role that may follow (system only at the start, and only kept).
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIAL = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Inserts that complete what ends with a role, and their cost.
TAIL = ("", "II", "I", "")
FINAL = "0,6,3,0"
NEVER = 1 << 40
#: Rows and bytes of text after which a block ends.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 20
LEGAL = ("su", "ua", "au")


class Signature:
    """Cheapest edits of a signature for given costs at its end, of equals the least in ASCII.

    Options at a place differ in their first letter, so of equal costs the
    least letter decides and the memo keeps a cost and a letter per place.
    Two inserts in a row reach every role, more return to one.
    """

    def __init__(self, signature: str, end: tuple[int, ...]) -> None:
        self.signature, self.end, self.memo = signature, end, {}
        for i in range(len(signature), -1, -64):  # from the end, so that no call goes deep
            for state in range(4):
                self.best(i, state, 0)

    def best(self, i: int, state: int, inserted: int) -> int:
        """Cost of all that follows place i."""
        if i == len(self.signature):
            return self.end[state]
        known = self.memo.get((i, state, inserted))
        if known is None:
            known = self.memo[i, state, inserted] = min(self.options(i, state, inserted))
        return known[0]

    def options(self, i: int, state: int, inserted: int) -> Iterator[tuple[int, str, int, int, int]]:
        """(cost, edit, place, role, inserts) of each edit."""
        yield DELETE + self.best(i + 1, state, 0), "D", i + 1, state, 0
        if inserted < 2:
            yield INSERT + self.best(i, NEXT[state], inserted + 1), "I", i, NEXT[state], inserted + 1
        if (symbol := self.signature[i]) == "d":
            return
        role, extra = INITIAL.get(symbol.lower()), TRUNCATED * symbol.isupper()
        if role == NEXT[state] or role == SYSTEM and state == NONE:
            yield extra + self.best(i + 1, role, 0), "K", i + 1, role, 0
        yield REROLE + extra + self.best(i + 1, NEXT[state], 0), "R", i + 1, NEXT[state], 0

    def edits(self, state: int) -> tuple[str, int]:
        """(edits from a role before, the role after)."""
        out, i, inserted = [], 0, 0
        while i < len(self.signature):
            self.best(i, state, inserted)
            _, edit, i, state, inserted = self.memo[i, state, inserted]
            out.append(edit)
        return "".join(out), state


def transfer(signature: str) -> list[int]:
    """Costs from each role before to each role after, 16 numbers."""
    ends = [Signature(signature, tuple(0 if o == out else NEVER for o in range(4))) for out in range(4)]
    return [min(NEVER, ends[out].best(0, state, 0)) for state in range(4) for out in range(4)]


def _map(rows: DataFrame, fn, schema: str, at_once: int = 500) -> DataFrame:
    """``fn`` from a dict of a row to an iterator of tuples, over Arrow batches, a few rows at once."""
    target = pa_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, at_once):
                out = [t for row in batch.slice(i, at_once).to_pylist() for t in fn(row)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), target, strict=True)], schema=target)

    return rows.mapInArrow(lean(run), schema)


def pa_schema(rows: DataFrame, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


# -- rows to blocks --------------------------------------------------------------


def ordered(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text, n, later) sorted over range partitions: n equal rows, later if an earlier turn has role and text too.

    Equal rows of a batch go on as one, so copies shrink before they are
    shuffled, and the range goes down to a digest of the text: neither a
    conversation nor one of its turns has to fit a partition.
    """
    digest = F.unhex(F.md5("text")).alias("digest")
    at = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    named = rows.select("conv", "turn", "role", "text", digest)
    several = named.groupBy("conv", "role", "digest").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first < last")
    several = several.select(F.col("conv").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), "first")

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.schema.names
            table = pa.Table.from_batches([batch]).append_column("n", pa.array([1] * batch.num_rows, pa.int64()))
            table = table.group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns([*keys, "n"])
            yield from table.to_batches()

    kind = dict(named.dtypes)
    once = named.mapInArrow(lean(collapse), f"conv {kind['conv']}, turn {kind['turn']}, role string, text string, digest binary, n long")
    same = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d"))
    marked = once.join(several, same, "left").withColumn("later", F.coalesce(at > F.col("first"), F.lit(False))).drop("_c", "_r", "_d", "first")
    keys = ["conv", "turn", "role", "start", "digest"]
    return marked.withColumn("start", F.substring("text", 1, 64)).repartitionByRange(*keys).sortWithinPartitions(*keys)


COUNTS = "blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low {turn}, high {turn}"


class _Block:
    """The rows of a conversation that one block holds."""

    def __init__(self) -> None:
        self.signature, self.roles, self.texts, self.size, self.rows = [], [], [], 0, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None

    def add(self, turn, role: str, text: str, again: bool, n: int) -> None:
        """``n`` equal rows, all of them copies of an earlier one if ``again``."""
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in LEGAL
        self.illegal += (n - 1) * (initial * 2 not in LEGAL)
        self.first, self.last = initial if self.first is None else self.first, initial
        if turn is not None and turn != self.high:
            self.turns, self.low, self.high = self.turns + 1, turn if self.low is None else self.low, turn
        self.rows += n
        words = text.encode("utf-8", "surrogatepass").strip()  # strips exactly space and the controls 9 to 13
        if not words:
            self.blank += n
            self.signature.append("d" * n)
            return
        self.duplicate += n - (not again)
        if not again:
            cut = words[-1:] not in (b".", b"!", b"?")
            symbol = initial if initial in INITIAL else "x"
            self.truncated += cut
            self.signature.append(symbol.upper() if cut else symbol)
            self.roles.append(role)
            self.texts.append(text)
            self.size += len(words)
        self.signature.append("d" * (n - (not again)))

    def row(self, block: int) -> tuple:
        return (
            block, "".join(self.signature), self.roles, self.texts, self.blank, self.duplicate, self.truncated,
            self.illegal, self.first, self.last, self.turns, self.low, self.high,
        )


def blocks(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(conv, block, signature, roles, texts, ...): blocks in order of their number, with the rows that may stay."""
    limit = block_rows or BLOCK_ROWS
    kind = dict(rows.dtypes)
    schema = f"conv {kind['conv']}, block long, signature string, roles array<string>, texts array<string>, " + COUNTS.format(turn=kind["turn"])
    target = pa_schema(rows, schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, before, now, done = TaskContext.get().partitionId() << 33, None, None, []

        def flush():
            nonlocal done
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), target, strict=True)], schema=target)
            done = []
            return out

        held = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("conv", "turn", "role", "text", "n", "later")]
            for i in range(0, batch.num_rows, 500):
                for conv, turn, role, text, n, later in zip(*(c.slice(i, 500).to_pylist() for c in columns), strict=True):
                    again = later
                    while n:
                        if now is not None and (conv != before[0] or now.rows >= limit or now.size >= BLOCK_BYTES):
                            done.append((before[0], *now.row(number)))
                            held, number, now = held + now.size, number + 1, None
                        now = now or _Block()
                        again = again or before == (conv, turn, role, text)
                        some = min(n, limit - now.rows)
                        now.add(turn, role, text, again, some)
                        before, n = (conv, turn, role, text), n - some
                    if len(done) >= 1000 or held >= 4 * BLOCK_BYTES:
                        yield flush()
                        held = 0
        if now is not None:
            done.append((before[0], *now.row(number)))
        if done:
            yield flush()

    return ordered(rows).mapInArrow(lean(cut), schema)


# -- signatures to edits -----------------------------------------------------------


def _backwards(row: dict) -> Iterator[tuple]:
    """The costs at the end of each block of a conversation, less the least of them."""
    after = [int(x) for x in FINAL.split(",")]
    for i, b in enumerate(sorted(row["blocks"], key=lambda b: -b["block"])):
        end = FINAL if i == 0 else ",".join(str(x - min(after)) for x in after)
        yield b["block"], end, i == 0
        after = [min(b["costs"][4 * s + o] + after[o] for o in range(4)) for s in range(4)]


def _forwards(row: dict) -> Iterator[tuple]:
    """The role before each block of a conversation."""
    state = NONE
    for b in sorted(row["blocks"], key=lambda b: b["block"]):
        yield b["block"], state
        state = b["after"][state]


def _solve(row: dict) -> Iterator[tuple]:
    solver = Signature(row["signature"], tuple(int(x) for x in row["end"].split(",")))
    found = [solver.edits(s) for s in range(4)]
    yield row["signature"], row["end"], row["final"], [e + TAIL[s] * row["final"] for e, s in found], [s for _, s in found]


def solved(parts: DataFrame) -> DataFrame:
    """(block, alone, edits): the edits of each block, of (conv, block, signature).

    Work that repeats is done once: recursions run on distinct signatures and
    costs at the end.
    """
    several = materialize(parts.groupBy("conv").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv").alias("_c")), "several")
    same = F.col("conv").eqNullSafe(F.col("_c"))
    single = parts.join(several, same, "left_anti").select("block", "signature", F.lit(FINAL).alias("end"), F.lit(True).alias("final"), F.lit(True).alias("alone"))
    whole = materialize(parts.join(several, same, "left_semi"), "long-conversations")
    costs = _map(whole.select("signature").distinct(), lambda r: [(r["signature"], transfer(r["signature"]))], "signature string, costs array<long>")
    chained = whole.join(materialize(costs, "costs"), "signature").groupBy("conv").agg(F.collect_list(F.struct("block", "costs")).alias("blocks"))
    ends = materialize(_map(chained, _backwards, "block long, end string, final boolean"), "ends")
    long = whole.join(ends, "block").select("block", "conv", "signature", "end", "final")
    each = single.unionByName(long.select("block", "signature", "end", "final", F.lit(False).alias("alone")))
    tasks = each.select("signature", "end", "final").distinct()
    found = materialize(_map(tasks, _solve, "signature string, end string, final boolean, edits array<string>, after array<int>"), "solved")
    keys = ["signature", "end", "final"]
    chained = long.join(found, keys).groupBy("conv").agg(F.collect_list(F.struct("block", "after")).alias("blocks"))
    states = materialize(_map(chained, _forwards, "block long, state int"), "states")
    edits = each.join(found, keys).select("block", "alone", "edits")
    return edits.join(states, "block", "left").select("block", "alone", F.get("edits", F.coalesce("state", F.lit(NONE))).alias("audit"), F.coalesce("state", F.lit(NONE)).alias("state"))


def replayed(signature: str, roles: list[str], texts: list[str], audit: str, state: int) -> tuple[int, list[str], list[str]]:
    """(cost, roles, texts) after the edits of a block."""
    cost, at, row, out_roles, out_texts = 0, 0, 0, [], []
    for edit in audit:
        symbol = "" if edit == "I" else signature[at]
        role, text = (roles[row], texts[row]) if symbol not in ("", "d") else ("", "")
        at, row = at + (symbol != ""), row + (symbol not in ("", "d"))
        if edit == "D":
            cost += DELETE
            continue
        state = INITIAL[symbol.lower()] if edit == "K" else NEXT[state]
        cost += {"I": INSERT, "R": REROLE, "K": 0}[edit] + TRUNCATED * symbol.isupper()
        out_roles.append(role if edit == "K" else ROLE[state])
        out_texts.append(text)
    return cost, out_roles, out_texts


# -- edits to conversations --------------------------------------------------------


def repair(rows: DataFrame, block_rows: int | None = None) -> DataFrame:
    """One row per block: (conv, block, alone, audit, cost, faults, roles, texts): the repaired rows are the zipped roles and texts.

    ``rows`` are (conv_id, turn, role, text), in order of conversation, turn
    (nulls first), role and text (its first 64 characters, then a digest).
    Null roles and texts are one space; rows without a conversation are one
    conversation; repeated rows are duplicates; other columns are not looked
    at; no rows give no rows.
    """
    own = rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("turn"), F.coalesce(F.col("role"), F.lit(" ")).alias("role"), F.coalesce(F.col("text"), F.lit(" ")).alias("text")
    )
    with scratch() as keep:
        cut = keep(materialize(blocks(own, block_rows), "blocks"))
        edits = keep(materialize(solved(cut.select("conv", "block", "signature")), "edits"))
    joined = cut.join(edits, "block")
    kind = dict(cut.dtypes)

    def apply(row: dict) -> Iterator[tuple]:
        cost, roles, texts = replayed(row["signature"], row["roles"], row["texts"], row["audit"], row["state"])
        carried = [row[c] for c in ("blank", "duplicate", "truncated", "illegal", "first", "last", "turns", "low", "high")]
        yield row["conv"], row["block"], row["alone"], row["audit"], cost, *carried, roles, texts

    schema = f"conv {kind['conv']}, block long, alone boolean, audit string, cost long, " + COUNTS.format(turn=kind["low"])
    return _map(joined, apply, schema + ", roles array<string>, texts array<string>", at_once=32)


def repaired_rows(repaired: DataFrame) -> DataFrame:
    """(conv_id, block, place, role, text): the repaired conversations, in order of block and place."""
    pairs = F.posexplode(F.arrays_zip("roles", "texts"))
    return repaired.select("conv", "block", pairs).select(F.col("conv").alias("conv_id"), "block", F.col("pos").alias("place"), F.col("col.roles").alias("role"), F.col("col.texts").alias("text"))


def report(repaired: DataFrame) -> DataFrame:
    """(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of :func:`repair`'s rows.

    The texts of a conversation in one block are hashed where they are; those
    of longer ones pass through one hash block by block and are never held
    together.
    """
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit(":"), x["texts"])), "\n")
    plain = repaired.withColumn("lines", F.when(F.size("roles") > 0, lines)).drop("roles", "texts")
    plain = plain.withColumn("sha", F.when(F.col("alone"), F.sha2(F.coalesce("lines", F.lit("")), 256)))
    plain = plain.withColumn("lines", F.when(~F.col("alone"), F.col("lines")))
    kind = dict(repaired.dtypes)
    schema = f"conv {kind['conv']}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    target = pa_schema(repaired, schema)
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []

        def close() -> tuple:
            gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
            totals = {k: now[k] for k in sums}
            return (now["conv"], gaps, *totals.values(), "".join(now["audits"]), now["sha"] or now["hash"].hexdigest())

        for batch in batches:
            for i in range(0, batch.num_rows, 32):
                for row in batch.slice(i, 32).to_pylist():
                    if now is None or now["conv"] != row["conv"]:
                        if now is not None:
                            done.append(close())
                        now = row | {"audits": [row["audit"]], "hash": hashlib.sha256(), "empty": True}
                    else:
                        now["audits"].append(row["audit"])
                        for k in sums:
                            now[k] += row[k]
                        now["illegal"] += now["last"] + row["first"] not in LEGAL
                        now["turns"] += row["turns"] - (row["low"] is not None and row["low"] == now["high"])
                        now["low"] = row["low"] if now["low"] is None else now["low"]
                        now["high"] = now["high"] if row["high"] is None else row["high"]
                        now["last"] = row["last"]
                    if row["lines"] is not None:
                        now["hash"].update(("" if now["empty"] else "\n").encode() + row["lines"].encode("utf-8", "surrogatepass"))
                        now["empty"], now["lines"] = False, None
                if done:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), target, strict=True)], schema=target)
                    done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(close(), target, strict=True)], schema=target)

    return plain.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(lean(fold), schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by a checksum of conversation and turn; nulls are one space there and in role and text."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), code.alias("code")).filter("code <> 0")
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("code") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.drop("col")


def op11_conversation_repair(conversations: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation, damaged first."""
    found = report(repair(damaged(conversations)))
    every = conversations.select("conv_id").distinct()
    joined = every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero: list[Column] = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


#: The same result in DuckDB's SQL: the checksum from its polynomial, costs from the end, edits from the start.
ORACLE = """
WITH RECURSIVE crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
named AS (SELECT conv_id, coalesce(conv_id::VARCHAR, ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
coded AS (SELECT n.*, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(s) + 1), lambda i: ascii(s[i])::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS code FROM named n, crc),
broken AS (SELECT conv, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM coded WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS i, left(role, 1) AS ini,
    regexp_extract(text, '([^ \\t\\n\\x0B\\f\\r])[ \\t\\n\\x0B\\f\\r]*$', 1) AS fin FROM broken),
judged AS (SELECT *, CASE WHEN fin = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 THEN 'd' WHEN fin NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY conv ORDER BY i) || ini AS pair FROM placed),
rows AS (SELECT conv, i, role, text, ini, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS x FROM judged),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
    count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM judged GROUP BY 1),
costs AS (SELECT conv, n + 1 AS i, [0, 6, 3, 0]::BIGINT[] AS b FROM counts
    UNION ALL
    SELECT conv, i, [least(o[1], 3 + o[3], 6 + o[4]), least(o[2], 3 + o[3], 6 + o[4]), least(o[3], 3 + o[4]), least(o[4], 3 + o[3])] FROM
    (SELECT conv, i, [least(4 + b[1], cu, cs), least(4 + b[2], cu), least(4 + b[3], ca), least(4 + b[4], cu)] AS o FROM
    (SELECT r.conv, r.i, b, CASE WHEN gone THEN 1099511627776 ELSE x + b[3] + CASE WHEN ini = 'u' THEN 0 ELSE 3 END END AS cu,
        CASE WHEN gone THEN 1099511627776 ELSE x + b[4] + CASE WHEN ini = 'a' THEN 0 ELSE 3 END END AS ca, CASE WHEN gone OR ini <> 's' THEN 1099511627776 ELSE x + b[2] END AS cs
    FROM costs c JOIN rows r ON r.conv = c.conv AND r.i = c.i - 1))),
walk AS (SELECT conv, 1::BIGINT AS i, 1 AS st, '' AS audit, []::VARCHAR[] AS lines FROM counts
    UNION ALL
    SELECT conv, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN st WHEN 'K' THEN own ELSE nx END, audit || e,
        CASE e WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text)
        ELSE list_append(lines, CASE WHEN nx = 3 THEN 'user:' ELSE 'assistant:' END || CASE WHEN e = 'R' THEN text ELSE '' END) END FROM
    (SELECT w.conv, w.i, st, audit, lines, role, text, nx, own, CASE WHEN r.i IS NULL THEN CASE WHEN st IN (2, 3) THEN 'I' END
        WHEN 4 + d.b[st] = c.b[st] THEN 'D' WHEN 3 + c.b[nx] = c.b[st] THEN 'I' WHEN NOT gone AND (own = nx OR own = 2 AND st = 1) AND x + d.b[own] = c.b[st] THEN 'K' ELSE 'R' END AS e
    FROM (SELECT *, CASE WHEN st = 3 THEN 4 ELSE 3 END AS nx FROM walk) w JOIN costs c ON c.conv = w.conv AND c.i = w.i
    LEFT JOIN (SELECT *, CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 WHEN 'a' THEN 4 ELSE 0 END AS own FROM rows) r ON r.conv = w.conv AND r.i = w.i
    LEFT JOIN costs d ON d.conv = w.conv AND d.i = w.i + 1) WHERE e IS NOT NULL),
done AS (SELECT w.conv, audit, sha256(array_to_string(lines, chr(10))) AS h FROM walk w JOIN counts c ON c.conv = w.conv AND w.i = c.n + 1 WHERE st IN (1, 4))
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    coalesce(b[1], 0) AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM named) LEFT JOIN counts USING (conv) LEFT JOIN done USING (conv) LEFT JOIN (SELECT conv, b FROM costs WHERE i = 1) USING (conv)
"""

__all__ = ["Signature", "blocks", "damaged", "op11_conversation_repair", "repair", "repaired_rows", "replayed", "report", "solved", "transfer"]
