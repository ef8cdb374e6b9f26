"""Mixing sources to target weights by iterative proportional fitting.

Documents are counted into cells (source, language, topic); the cells' tokens
are scaled to each target marginal in turn until all agree to ``TOLERANCE``, and
a document is sampled with a probability in proportion to its cell's factor, at
most 1, by a hash of its id: the same on every run and machine.  The proportion
is set so that a stated share of all tokens is expected.

Up to ``MAX_CELLS`` cells are fitted on the driver; more of them stay
distributed, one aggregation per marginal and round.
"""

from __future__ import annotations

import math
import re
import warnings

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release
from .shared import aside

MARGINS = ["source", "lang", "topic"]
#: Columns that :func:`mix` adds.
ADDED = ("n_tokens", "topic", "weight", "probability", "selected")
#: Cells that the driver may hold: their number is checked before any is fetched.
MAX_CELLS = 200_000
#: Largest difference of a fitted share from its target, and rounds after which fitting ends even so (with a warning).
TOLERANCE, ROUNDS = 1e-12, 1000
#: Targets of margins that are not given: token shares to this power, normalised (fixed values).
POWERS = {"source": 0.5, "lang": 0.7, "topic": 0.8}
#: Share of all tokens that a sample is expected to hold.
BUDGET = 0.25
_SPACE = " \t\n\x0b\x0c\r"


def topic_by_words(words: dict[str, list[str]], text: str = "text", none: str = "other") -> Column:
    """The topic most of whose words (whole ones, in any case) are in the text; ties to the first, no word: ``none``."""
    count = {t: F.coalesce(F.regexp_count(text, F.lit(r"(?i)\b(?:" + "|".join(re.escape(x) for x in own) + r")\b")), F.lit(0)) for t, own in words.items()}
    best = F.greatest(*count.values(), F.lit(0))
    out = F.when(best == 0, none)
    for t, n in count.items():
        out = out.when(n == best, t)
    return out


def topic_by_form(n_tokens: Column) -> Column:
    """A class by the text's form, for documents that carry no topic.

    short: under 50 words; marked: over 2 symbols ``#*$%&|<>`` in 100 characters;
    listed: a line break at least every 8 words; long: 1000 words and more; else prose.
    """
    count = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0))
    chars = F.coalesce(F.length("text"), F.lit(0))
    return (
        F.when(n_tokens < 50, "short")
        .when(count("[#*$%&|<>]") * 50 > chars, "marked")
        .when(count("\n") * 8 >= n_tokens, "listed")
        .when(n_tokens >= 1000, "long")
        .otherwise("prose")
    )


def with_tokens(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """Adds n_tokens (words of the whole text) and topic: the given one, or else the text's form."""
    clean = F.btrim(F.coalesce("text", F.lit("")), F.lit(_SPACE))
    n = F.when(clean == "", 0).otherwise(F.size(F.split(clean, "[ \\t\\n\\x0B\\f\\r]+", -1))).cast("long")
    df = docs.withColumn("n_tokens", n)
    return df.withColumn("topic", topic_by_form(F.col("n_tokens")) if topic is None else topic)


def target_shares(shares: dict, power: float, given: dict | None = None) -> dict:
    """Target share of every value of a margin, from its token share.

    Without ``given``: the share to a power under 1, so large ones give way to
    small ones.  With it: the given weights; values that it does not name share
    what it leaves of 1 in their present proportion; given values that no token
    has are left out; the sum is 1.
    """
    if given is None:
        out = {v: x**power if x > 0 else 0.0 for v, x in shares.items()}
    else:
        if any(w < 0 for w in given.values()):
            raise ValueError("a target weight is negative")
        named = {v: float(given[v]) for v, x in shares.items() if v in given and x > 0}
        others = {v: x for v, x in shares.items() if v not in given}
        left, whole = max(0.0, 1.0 - sum(given.values())), math.fsum(others.values())
        out = {v: 0.0 for v in shares} | named | {v: x * left / whole if whole > 0 else 0.0 for v, x in others.items()}
    whole = math.fsum(out.values())
    if whole <= 0 and any(shares.values()):
        raise ValueError("the targets leave no token")
    return {v: x / (whole or 1.0) for v, x in out.items()}


def default_targets(cells: list[tuple], powers: dict[str, float] = POWERS, given: dict[str, dict] | None = None) -> dict[str, dict]:
    """Target shares of every value of every margin, see :func:`target_shares`."""
    out = {}
    for i, m in enumerate(MARGINS):
        mass: dict = {}
        for c in sorted(cells, key=repr):
            mass[c[i]] = mass.get(c[i], 0.0) + c[3]
        total = sum(mass.values()) or 1.0
        out[m] = target_shares({v: x / total for v, x in mass.items()}, powers[m], (given or {}).get(m))
    return out


def _unmet(rounds: int, residual: float) -> None:
    warnings.warn(f"margins differ from their targets by up to {residual:.3g} after {rounds} rounds: no table of these cells meets them", stacklevel=3)


def rake(cells: list[tuple], targets: dict[str, dict], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> list[float]:
    """Fitted masses (summing to 1) of cells (source, lang, topic, tokens); a cell without tokens stays 0.

    Rounds end when every margin's shares are within ``tolerance`` of their targets.
    """
    total = sum(c[3] for c in cells) or 1.0
    mass, residual = [c[3] / total for c in cells], 0.0
    for _ in range(rounds):
        residual = 0.0
        for i, m in enumerate(MARGINS):
            sums: dict = {}
            for c, x in zip(cells, mass, strict=True):
                sums[c[i]] = sums.get(c[i], 0.0) + x
            residual = max([residual, *(abs(x - targets[m].get(v, 0.0)) for v, x in sums.items())])
            mass = [x * targets[m].get(c[i], 0.0) / sums[c[i]] if sums[c[i]] > 0 else 0.0 for c, x in zip(cells, mass, strict=True)]
        if residual <= tolerance:
            return mass
    if residual > max(tolerance, 1e-6):
        _unmet(rounds, residual)
    return mass


def rake_distributed(
    cells: DataFrame, powers: dict[str, float] = POWERS, rounds: int = ROUNDS, given: dict[str, dict] | None = None, tolerance: float = TOLERANCE
) -> DataFrame:
    """The same fit as DataFrames: (source, lang, topic, tokens, mass), for more cells than the driver may hold."""
    spark = cells.sparkSession
    total = cells.agg(F.sum("tokens").cast("double")).scalar()
    now = cells.withColumn("mass", F.coalesce(F.try_divide(F.col("tokens").cast("double"), total), F.lit(0.0)))
    targets = {}
    for m in MARGINS:
        shares = now.groupBy(F.col(m).alias("_v")).agg(F.sum("mass").alias("_x"))
        if (own := (given or {}).get(m)) is None:
            weighed = shares.select("_v", F.pow("_x", F.lit(powers[m])).alias("_t"))
        else:
            if any(w < 0 for w in own.values()):
                raise ValueError("a target weight is negative")
            kind = dict(cells.dtypes)[m]
            named = spark.createDataFrame([(v, float(w)) for v, w in own.items()], f"_n {kind}, _w double")
            shares = shares.join(named, F.col("_v").eqNullSafe(F.col("_n")), "left")
            others = shares.agg(F.sum(F.when(F.col("_w").isNull(), F.col("_x")))).scalar()
            left = max(0.0, 1.0 - sum(own.values()))
            rest = F.coalesce(F.try_divide(F.col("_x") * F.lit(left), others), F.lit(0.0))
            weighed = shares.select("_v", F.when(F.col("_w").isNull(), rest).when(F.col("_x") > 0, F.col("_w")).otherwise(0.0).alias("_t"))
        whole = weighed.agg(F.sum("_t")).scalar()
        targets[m] = materialize(weighed.select("_v", F.try_divide("_t", whole).alias("_t")), "target")
    now, residual = materialize(now, "cells"), 0.0
    for _ in range(rounds):
        before, residual = now, 0.0
        for m in MARGINS:
            sums = now.groupBy(F.col(m).alias("_s")).agg(F.sum("mass").alias("_x"))
            both = materialize(sums.join(targets[m], F.col("_s").eqNullSafe(F.col("_v"))).select("_v", "_x", "_t", F.try_divide("_t", "_x").alias("_f")), "factors")
            residual = max(residual, both.agg(F.max(F.abs(F.col("_x") - F.coalesce("_t", F.lit(0.0))))).first()[0] or 0.0)
            factor = both.select("_v", "_f")
            now = now.join(factor, now[m].eqNullSafe(factor["_v"])).withColumn("mass", F.coalesce(F.col("mass") * F.col("_f"), F.lit(0.0))).drop("_v", "_f")
        now = materialize(now, "cells")
        release(before)
        if residual <= tolerance:
            return now
    if residual > max(tolerance, 1e-6):
        _unmet(rounds, residual)
    return now


def scale_to(cells: list[tuple[float, float]], wanted: float) -> float:
    """The factor f by which sum(tokens * min(1, weight * f)) over cells (weight, tokens) is ``wanted``.

    Cells at 1 are set aside and the rest is solved again, the largest weight
    first.  If all cells together hold no more than ``wanted``, all are at 1.
    """
    left = sorted(((w, n) for w, n in cells if w > 0 and n > 0), reverse=True)
    mass, full = math.fsum(w * n for w, n in left), 0.0
    for w, n in left:
        factor = max(0.0, wanted - full) / mass if mass > 0 else 0.0
        if w * factor <= 1:
            return factor
        mass, full = mass - w * n, full + n
    return 1 / left[-1][0] if left else 0.0


def scale_distributed(cells: DataFrame, wanted: float) -> float:
    """The same for a table (weight, tokens): bisection in the factor's logarithm, one aggregation a step."""
    some = cells.filter("weight > 0 AND tokens > 0")
    low, high, whole = some.agg(F.min("weight"), F.max("weight"), F.sum(F.col("tokens").cast("double"))).first()
    if low is None:
        return 0.0
    if whole <= wanted:
        return 1 / low
    a, b = math.log(max(wanted / whole, 1e-300) / high), math.log(1 / low)
    while b - a > 1e-9:
        m = (a + b) / 2
        got = some.agg(F.sum(F.col("tokens") * F.least(F.lit(1.0), F.col("weight") * F.lit(math.exp(m))))).first()[0]
        a, b = (m, b) if got < wanted else (a, m)
    return math.exp(b)


def uniform(id_col: str, seed: int) -> Column:
    """A number in [0, 1) from the id and the seed alone: the first 32 bits of an MD5."""
    name = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def cell_weights(
    counted: DataFrame, targets: dict[str, dict] | None = None, powers: dict[str, float] = POWERS, rounds: int = ROUNDS,
    max_cells: int = MAX_CELLS, budget: float | None = BUDGET,
) -> DataFrame:
    """(source, lang, topic, weight, probability) of the cells of ``counted``; a broadcast hint on a table of a checked size."""
    cells = materialize(counted.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")), "cells")
    if cells.count() <= max_cells:
        rows = [tuple(r) for r in cells.collect()]
        rows.sort(key=repr)
        fitted = rake(rows, default_targets(rows, powers, targets), rounds)
        total = sum(r[3] for r in rows) or 1
        weights = [x * total / r[3] if r[3] else 0.0 for r, x in zip(rows, fitted, strict=True)]
        if budget is None:
            factor = 1 / (max(weights, default=0.0) or 1.0)
        else:
            factor = scale_to([(w, r[3]) for r, w in zip(rows, weights, strict=True)], budget * total)
        columns = [pa.array([r[i] for r in rows]) for i in range(3)]
        columns += [pa.array(v, pa.float64()) for v in (weights, [min(1.0, w * factor) for w in weights])]
        table = counted.sparkSession.createDataFrame(pa.table(columns, names=[*MARGINS, "weight", "probability"]))
        return F.broadcast(table.withColumns({m: F.col(m).cast(k) for m, k in cells.dtypes[:3]}))
    fit = rake_distributed(cells, powers, rounds, targets)
    total = fit.agg(F.sum("tokens").cast("double")).scalar()
    weight = F.coalesce(F.try_divide(F.col("mass") * total, F.col("tokens").cast("double")), F.lit(0.0))
    table = materialize(fit.withColumn("weight", weight), "weights")
    if budget is None:
        factor = 1 / (table.agg(F.max("weight")).first()[0] or 1.0)
    else:
        whole = table.agg(F.sum(F.col("tokens").cast("double"))).first()[0] or 0.0
        factor = scale_distributed(table, budget * whole)
    return table.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") * F.lit(factor)).alias("probability"))


def sampled(counted: DataFrame, weights: DataFrame, seed: int = 42) -> DataFrame:
    """``counted`` with weight, probability and selected."""
    table = weights.withColumnsRenamed({m: f"_{m}" for m in MARGINS})
    same = [F.col(m).eqNullSafe(F.col(f"_{m}")) for m in MARGINS]
    out = counted.join(table, same, "left").drop(*[f"_{m}" for m in MARGINS])
    return out.withColumn("selected", uniform("doc_id", seed) < F.col("probability"))


def mix(
    docs: DataFrame, targets: dict[str, dict] | None = None, topic: Column | None = None, seed: int = 42, powers: dict[str, float] = POWERS,
    rounds: int = ROUNDS, max_cells: int = MAX_CELLS, budget: float | None = BUDGET,
) -> DataFrame:
    """``docs`` with n_tokens, topic, weight, probability, selected.

    ``targets``: for any of the margins source, lang and topic, the weight of
    values, as ``{"source": {"web": 0.6, "books": 0.4}}``; see
    :func:`target_shares` for values and margins that are not named.  ``topic``:
    a column that holds or computes the topic (:func:`topic_by_words` makes one);
    without it the text's form stands for it.

    ``weight`` is the fitted share of the cell's tokens over its present share;
    ``probability`` is the weight times one factor, at most 1, so that the share
    ``budget`` of all tokens is expected: a rare cell that the target favours is
    kept whole, and expected token shares of the others are in the fitted
    proportion.  Without a budget it is the weight over the largest weight, so
    that one rare cell sets the rate of all.  A null source or language is a
    value of its own; documents without tokens have weight and probability 0;
    a null id is sampled under one number; repeated rows are decided alike; an
    empty table gives an empty result.  Columns of ``docs`` by the added names
    are replaced; others are kept, whatever their names.
    """
    if topic is not None:
        docs = docs.withColumn("_given_topic", topic)
    packed, restore = aside(docs, "doc_id", "text", "source", "lang", "_given_topic")
    counted = with_tokens(packed, None if topic is None else F.col("_given_topic"))
    out = sampled(counted, cell_weights(counted, targets, powers, rounds, max_cells, budget), seed)
    return restore(out, (*ADDED, "_given_topic"), ADDED)


def op1_source_mixing(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, weight, probability, selected) of every document; texts are counted once."""
    counted = with_tokens(docs.select("doc_id", "text", "source", "lang")).drop("text")
    counted = materialize(counted, "counted")
    return sampled(counted, cell_weights(counted)).select(
        "doc_id", "source", "lang", "topic", "n_tokens", F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), "selected"
    )


def oracle(docs: str = "documents", rounds: int = 25) -> str:
    """DuckDB SQL of the query: one pair of common table expressions per margin and round (of these it takes a fixed number)."""
    parts = [
        f"""base AS (SELECT doc_id, source, lang, coalesce(text, '') AS t,
      len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS n_tokens FROM {docs})""",
        """counted AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN n_tokens < 50 THEN 'short'
      WHEN length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) * 50 > length(t) THEN 'marked'
      WHEN (length(t) - length(replace(t, chr(10), ''))) * 8 >= n_tokens THEN 'listed'
      WHEN n_tokens >= 1000 THEN 'long' ELSE 'prose' END AS topic FROM base)""",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(n_tokens)::DOUBLE AS tokens FROM counted GROUP BY ALL)",
        "c0 AS MATERIALIZED (SELECT *, tokens / (SELECT sum(tokens) FROM cells) AS mass FROM cells)",
    ]
    for m in MARGINS:
        parts.append(f"t_{m} AS MATERIALIZED (SELECT v, p / sum(p) OVER () AS t FROM (SELECT {m} AS v, pow(sum(mass), {POWERS[m]}) AS p FROM c0 GROUP BY 1))")
    k = 0
    for _ in range(rounds):
        for m in MARGINS:
            parts.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, CASE WHEN s > 0 THEN mass * t / s ELSE 0.0 END AS mass
      FROM (SELECT *, sum(mass) OVER (PARTITION BY {m}) AS s FROM c{k}) JOIN t_{m} ON {m} IS NOT DISTINCT FROM v)"""
            )
            k += 1
    return f"""WITH {", ".join(parts)},
    w AS (SELECT source, lang, topic, tokens, CASE WHEN tokens > 0 THEN mass * (SELECT sum(tokens) FROM cells) / tokens ELSE 0.0 END AS weight FROM c{k}),
    f AS (SELECT weight, greatest(0.0, {BUDGET} * sum(tokens) OVER () - coalesce(sum(tokens) OVER (ORDER BY weight DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight * tokens) OVER (ORDER BY weight DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor FROM w WHERE weight > 0 AND tokens > 0),
    p AS (SELECT *, least(1.0, weight * coalesce((SELECT factor FROM f WHERE weight * factor <= 1 ORDER BY weight DESC LIMIT 1), 1 / (SELECT min(weight) FROM f))) AS probability FROM w)
    SELECT doc_id, c.source, c.lang, c.topic, n_tokens, round(weight, 9) AS weight, round(probability, 9) AS probability,
      ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':42'), 1, 8))::BIGINT / 4294967296.0 < probability AS selected
    FROM counted c JOIN p ON c.source IS NOT DISTINCT FROM p.source AND c.lang IS NOT DISTINCT FROM p.lang AND c.topic = p.topic"""


ORACLE = oracle()

__all__ = ["ORACLE", "mix", "op1_source_mixing", "rake", "rake_distributed"]
