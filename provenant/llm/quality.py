"""Quality rules with risk-controlled thresholds, in DataFrame functions alone.

Base rules are fixed.  The method adds cutoffs on four more signals.  They are
tightened along a fixed path: one signal after the other gets its loosest
cutoff, then its next one, and so on.  For each stratum (language), step t
stands for the hypothesis "the cutoffs of the steps up to t together reject
more than a share ``alpha`` of good documents", tested with the exact binomial
tail on the labelled good documents that pass the base rules.  Steps are
tested in the order of the path until one fails (fixed-sequence testing, which
needs no division by the number of steps), at the level ``delta`` over the
number of strata (Bonferroni): with probability 1 - delta no stratum loses more
than its share.  The last step that passes is used; a stratum with too few
labels for the first one rejects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .shared import aside

#: Signals of the method, each rejecting above its cutoff, and the cutoffs tested (fixed values).
GRID: dict[str, list[float]] = {
    "symbol_share": [0.01, 0.02, 0.05, 0.1, 0.15, 0.2, 0.3],
    "dup_line_share": [0.1, 0.2, 0.3, 0.4, 0.5, 0.7],
    "repeat_share": [0.02, 0.05, 0.08, 0.1, 0.12, 0.15],
    "long_word": [8.0, 9.0, 10.0, 12.0, 15.0, 20.0],
}
ALPHA, DELTA = 0.02, 0.05
#: The path: (signal, cutoff) of each step, from the loosest cutoffs to the strictest.
PATH = [(s, GRID[s][-i]) for i in range(1, max(map(len, GRID.values())) + 1) for s in GRID if i <= len(GRID[s])]
#: Strata whose steps (a number each) may be broadcast; their number is checked.
MAX_STRATA = 100_000
SYMBOLS = r"[#*$%&|<>]"
_SPACE = " \t\n\x0b\x0c\r"


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of the whole text."""
    clean = F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(_SPACE))
    words = F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, "[ \\t\\n\\x0B\\f\\r]+", -1))
    df = docs.withColumn("_words", words)
    lines = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    df = df.withColumn("_lines", lines)
    window = F.transform(
        F.slice("_words", 1, F.greatest(F.size("_words") - 4, F.lit(0))),
        lambda w, i: F.xxhash64(*[F.get("_words", i + j) for j in range(5)]),
    )
    df = df.withColumn("_hashes", window)
    df = df.withColumn("_some", F.size(F.array_distinct("_hashes")) < F.size("_hashes"))
    pairs = F.when(F.col("_some"), F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    df = df.withColumn("_pairs", pairs)
    again = F.filter(
        "_pairs",
        lambda p, i: (p["h"] == F.get("_pairs", i - 1)["h"]) | (p["h"] == F.get("_pairs", i + 1)["h"]),
    )
    df = df.withColumn("_at", F.array_sort(F.transform(again, lambda p: p["i"])))
    covered = F.aggregate(
        F.transform("_at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("_at", i + 1) - p, F.lit(5)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.coalesce(F.regexp_count(F.col(text), F.lit(SYMBOLS)), F.lit(0)).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
        }
    ).drop("_words", "_lines", "_hashes", "_some", "_pairs", "_at")


def with_signals(df: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a).cast("double") / F.col(b)).otherwise(F.lit(0.0))
    return df.withColumns(
        {
            "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
            "symbol_share": share("n_symbols", "word_chars"),
            "dup_line_share": share("n_dup_lines", "n_lines"),
            "repeat_share": share("n_repeat_words", "n_words"),
            "long_word": share("word_chars", "n_words"),
        }
    )


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(X <= k) for X ~ Binomial(n, p), summed term by term in logarithms."""
    first = n * F.log1p(F.lit(-p))
    start = F.struct(first.alias("term"), first.alias("sum"))
    step = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))

    def add(acc: Column, j: Column) -> Column:
        term = acc["term"] + F.log((n - j + 1) / j * F.lit(p / (1 - p)))
        high = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(F.least(acc["sum"], term) - high))).alias("sum"))

    return F.aggregate(step, start, add, lambda acc: acc["sum"])


def rejecting_step() -> Column:
    """The first step of the path that rejects a row, null for none: each signal's loosest cutoff below its value counts."""
    firsts = [F.when(F.col(s) > c, F.lit(t)) for t, (s, c) in enumerate(PATH)]
    return F.least(*firsts)


def certified_steps(labelled: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, step): the last certified step of each stratum that has any.

    ``labelled``: stratum and the rejecting step (null for none) of good
    documents that pass the base rules.  Counts are aggregated before they are
    shuffled: at most a number per step and stratum leaves each task.
    """
    counted = labelled.groupBy("stratum").agg(
        F.count("*").alias("n"), F.array(*[F.count_if(F.col("rejected_at") <= t) for t in range(len(PATH))]).alias("ks")
    )
    each = counted.select("stratum", "n", F.posexplode("ks").alias("t", "k")).withColumn("strata", counted.agg(F.count("*")).scalar())
    # more than n * alpha rejections have a tail near 1/2 or above: no need to sum it
    tail = F.when(F.col("k") <= F.col("n") * alpha, log_binomial_tail(F.col("k"), F.col("n"), alpha)).otherwise(F.lit(0.0))
    passes = tail <= F.log(F.lit(delta) / F.col("strata"))
    judged = each.groupBy("stratum").agg(F.min(F.when(~passes, F.col("t"))).alias("failed"))
    return judged.select("stratum", (F.coalesce("failed", F.lit(len(PATH))) - 1).alias("step")).filter("step >= 0")


def cutoffs(steps: DataFrame) -> DataFrame:
    """(stratum, signal, cutoff) in force at the steps of :func:`certified_steps`."""
    path = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("signal"), F.lit(c).alias("cutoff")) for t, (s, c) in enumerate(PATH)])
    return steps.select("stratum", "step", F.inline(path)).filter("t <= step").groupBy("stratum", "signal").agg(F.min("cutoff").alias("cutoff"))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with counts, base_failed and kept.

    ``labels``: doc_id, quality; a document is good if every label it has says
    1.  A null text has no words and fails the base rules; a null language is a
    stratum of its own; a null id has no label; repeated rows are judged alike
    and each counts in the holdout; no documents give no rows, no labels
    certify nothing.  ``keep``: columns of ``docs`` to return besides doc_id
    and lang (none by default).

    Counts are written once and read by both the holdout and the verdict.
    That also keeps filters on verdicts from being pushed below the counts,
    where each would be computed again.
    """
    kept = list(dict.fromkeys(["doc_id", "lang", "text", *(keep or [])]))
    counted = with_signals(with_counts(docs.select(*kept)))
    counted = materialize(counted if "text" in (keep or []) else counted.drop("text"), "counts")
    good = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("good"))
    good = good.filter("good = 1").select(F.col("doc_id").alias("_d"))
    stratum = F.when(F.col("lang").isNull(), "null").otherwise(F.concat(F.lit("="), "lang"))  # no language is "null" or empty by chance
    counted = counted.withColumns({"stratum": stratum, "rejected_at": rejecting_step()})
    passed = counted.filter("NOT base_failed").select("doc_id", "stratum", "rejected_at")
    holdout = passed.join(good, F.col("doc_id") == F.col("_d"), "left_semi")
    chosen = materialize(certified_steps(holdout, alpha, delta), "steps")
    if chosen.count() <= MAX_STRATA:  # else the join is shuffled, and adaptive execution splits large strata
        chosen = F.broadcast(chosen)
    judged = counted.join(chosen, "stratum", "left")
    rejected = F.coalesce(F.col("rejected_at") <= F.col("step"), F.lit(False))
    return judged.withColumn("kept", ~F.col("base_failed") & ~rejected)


def passing(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``docs``, with all its columns whatever their names, without the rows that :func:`judge` rejects."""
    packed, restore = aside(docs, "doc_id", "lang", "text")
    return restore(judge(packed, labels, alpha, delta, keep=packed.columns).filter("kept"))


def op7_quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    return judge(docs, labels).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


#: The same result in DuckDB's SQL.
ORACLE = f"""
WITH base AS (SELECT doc_id, CASE WHEN lang IS NULL THEN 'null' ELSE '=' || lang END AS stratum, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS l FROM documents),
counted AS (SELECT doc_id, stratum, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, w FROM base),
windows AS (SELECT doc_id, UNNEST(range(1, n_words - 3)) AS i,
    UNNEST(list_transform(range(1, n_words - 3), lambda i: w[i] || ' ' || w[i+1] || ' ' || w[i+2] || ' ' || w[i+3] || ' ' || w[i+4])) AS g FROM counted),
again AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM
    (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT doc_id, sum(least(5, coalesce(nxt - i, 5)))::BIGINT AS c FROM again GROUP BY 1),
signals AS (SELECT k.*, coalesce(c, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(c, 0) > 20 * n_words AS base_failed,
    CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0.0 END AS symbol_share,
    CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0.0 END AS dup_line_share,
    CASE WHEN n_words > 0 THEN coalesce(c, 0)::DOUBLE / n_words ELSE 0.0 END AS repeat_share,
    CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0.0 END AS long_word
    FROM counted k LEFT JOIN covered USING (doc_id)),
good AS (SELECT doc_id FROM labels GROUP BY 1 HAVING min(coalesce(quality, 0)) = 1),
holdout AS (SELECT * FROM signals WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
path AS (SELECT * FROM (VALUES {", ".join(f"({t}, '{s}', {c}::DOUBLE)" for t, (s, c) in enumerate(PATH))}) v(t, signal, cutoff)),
long AS (SELECT doc_id, stratum, base_failed, UNNEST(['symbol_share', 'dup_line_share', 'repeat_share', 'long_word']) AS signal,
    UNNEST([symbol_share, dup_line_share, repeat_share, long_word]) AS value FROM signals),
firsts AS (SELECT doc_id, min(t) AS t FROM long JOIN path USING (signal) WHERE value > cutoff GROUP BY 1),
counts AS (SELECT stratum, p.t, count(*) AS n, count(*) FILTER (f.t <= p.t) AS k FROM holdout LEFT JOIN firsts f USING (doc_id), path p GROUP BY 1, 2),
tails AS (SELECT stratum, t, n, k, CASE WHEN k > n * {ALPHA} THEN 1.0 ELSE (SELECT sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA}) + (n - j) * ln(1 - {ALPHA})))
    FROM unnest(range(0, k + 1)) AS r(j)) END AS p FROM counts),
chosen AS (SELECT stratum, coalesce(min(t) FILTER (p > {DELTA} / (SELECT count(DISTINCT stratum) FROM holdout)), {len(PATH)}) - 1 AS step FROM tails GROUP BY 1),
rejected AS (SELECT doc_id FROM signals JOIN firsts USING (doc_id) JOIN chosen USING (stratum) WHERE t <= step)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM rejected) AS kept FROM signals
"""  # noqa: S608

__all__ = ["ORACLE", "judge", "op7_quality_rules", "passing"]
