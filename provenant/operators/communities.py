"""Community detection by modularity (Louvain), with synchronous moves and contraction.

All nodes of a round decide at once from the labels of the round before: a
node's links are added up by the neighbours' communities, and it goes where
modularity gains most, the least label of equals.  As neighbours that decide at
once may swap for ever, a node moves in every other round (by a digest), two
single nodes only join under the lesser label, and the best labels of all
rounds are kept, so modularity never falls.  Communities then become the nodes
of a smaller graph, until nothing is gained.

Weights are whole numbers (counts, cents), so sums do not depend on the order
of rows.  Every round is a few joins and aggregations over written tables; a hub
is met by joins to unique keys and by partial sums alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, scratch

_WIDE = "decimal(38,0)"
#: Nodes of a level up to which Spark may broadcast its tables: rounds are many, but what they send does not depend on the input.
FEW = 10_000


def _dealt(df: DataFrame) -> DataFrame:
    """A side of a join that is shuffled and never collected: rounds are many, so tables that just pass for small would add up on the driver."""
    return df.hint("merge")


def _graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links (a, b, w) both ways, nodes (a, loop)) of (a, b, w); nulls and weights of zero and less are no edges."""
    some = edges.select("a", "b", F.col("w").cast("long").alias("w")).filter("a IS NOT NULL AND b IS NOT NULL AND w > 0")
    apart = some.filter("a <> b")
    links = apart.unionByName(apart.select(F.col("b").alias("a"), F.col("a").alias("b"), "w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    ends = some.select("a", F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(F.lit(0).cast("long")).alias("loop"))
    ends = ends.unionByName(some.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("loop")))
    return links, ends.groupBy("a").agg(F.sum("loop").alias("loop"))


def _contract(links: DataFrame, nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph whose nodes are the communities."""
    ca, cb = labels.toDF("a", "_ca"), labels.toDF("b", "_cb")
    between = links.join(_dealt(ca), "a").join(_dealt(cb), "b").groupBy(F.col("_ca").alias("a"), F.col("_cb").alias("b")).agg(F.sum("w").alias("w"))
    between = materialize(between, "contracted")
    inside = between.filter("a = b").select("a", F.expr("w DIV 2").alias("loop"))  # both ways were counted
    own = nodes.join(_dealt(ca), "a").select(F.col("_ca").alias("a"), "loop")
    return between.filter("a <> b"), own.unionByName(inside).groupBy("a").agg(F.sum("loop").alias("loop"))


def _moves(towards: DataFrame, placed: DataFrame, totals: DataFrame, twice: float, turn: int, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Labels (a, c) after a round; ``placed`` are (a, k, c), ``towards`` (a, c, w) and ``totals`` (c, t, n)."""
    own = placed.join(side(totals.toDF("c", "own_t", "own_n")), "c").select("a", "k", F.col("c").alias("own"), "own_t", "own_n")
    seen = towards.join(side(totals), "c").join(side(own), "a")
    k, twice_ = F.col("k").cast("double"), F.lit(twice)
    gain = F.col("w").cast("double") - k * F.col("t").cast("double") / twice_
    other = F.when(F.col("c") != F.col("own"), F.struct((-gain).alias("g"), F.col("c").alias("c"), F.col("n").alias("n")))
    stay = F.max(F.when(F.col("c") == F.col("own"), F.col("w")))
    best = seen.groupBy("a", "k", "own", "own_t", "own_n").agg(F.min(other).alias("o"), F.coalesce(stay, F.lit(0).cast("long")).alias("own_w"))
    stays = F.col("own_w").cast("double") - k * (F.col("own_t") - F.col("k")).cast("double") / twice_
    goes = -F.col("o.g") > stays + 1e-9
    single = (F.col("own_n") == 1) & (F.col("o.n") == 1) & (F.col("o.c") > F.col("own"))
    mine = F.pmod(F.crc32(F.col("a").cast("string").cast("binary")) + F.lit(turn), F.lit(2)) == 0
    moved = best.filter(goes & ~single & mine).select("a", F.col("o.c").alias("_to"))
    return placed.join(side(moved), "a", "left").select("a", F.coalesce("_to", "c").alias("c"))


def _level(links: DataFrame, nodes: DataFrame, rounds: int, least: float, few: int) -> tuple[float, float, DataFrame]:
    """(modularity of single nodes, best modularity, its labels (a, c)) on one graph; the labels are written."""
    strength = links.groupBy("a").agg(F.sum("w").alias("s"))
    weighted = nodes.join(_dealt(strength), "a", "left").select("a", "loop", (F.coalesce("s", F.lit(0).cast("long")) + 2 * F.col("loop")).alias("k"))
    weighted = materialize(weighted, "strengths")
    total, loops, n = weighted.agg(F.sum(F.col("k").cast(_WIDE)), F.sum(F.col("loop").cast(_WIDE)), F.count("*")).first()
    side = _dealt if n > few else lambda df: df
    if not total:
        return 0.0, 0.0, materialize(nodes.select("a", F.col("a").alias("c")), "labels")
    twice = float(total)
    labels = materialize(weighted.select("a", F.col("a").alias("c")), "labels")
    first, best, kept, idle = None, None, None, 0
    for turn in range(rounds + 1):
        towards = links.join(side(labels.toDF("b", "c")), "b").groupBy("a", "c").agg(F.sum("w").alias("w"))
        towards = materialize(towards, "towards")
        placed = materialize(weighted.select("a", "k").join(side(labels), "a"), "placed")
        totals = materialize(placed.groupBy("c").agg(F.sum("k").alias("t"), F.count("*").alias("n")), "totals")
        inside = towards.join(side(labels), ["a", "c"]).agg(F.sum(F.col("w").cast(_WIDE))).first()[0] or 0
        squares = totals.agg(F.sum((F.col("t").cast("double") / twice) ** 2)).first()[0]
        quality = (float(inside) + 2 * float(loops)) / twice - squares
        first = quality if first is None else first
        if best is None or quality > best + least:
            release(kept)
            best, kept, idle = quality, labels, 0
        else:
            idle += 1
        if idle == 2 or turn == rounds:
            break
        after = materialize(_moves(towards, placed, totals, twice, turn, side), "labels")
        if labels is not kept:
            release(labels)
        release(towards, placed, totals)
        labels = after
    return first, best, kept


def louvain(edges: DataFrame, levels: int = 20, rounds: int = 40, least: float = 1e-6, few: int = FEW) -> tuple[DataFrame, list[float]]:
    """((level, node, community), modularity of each level) of undirected edges (a, b, w), written.

    A community is named after one of its nodes.  Level 0 is the first merging;
    the last level is the result.  Repeated edges add up, own edges count once,
    nulls and weights of zero and less are no edges; no edges give no rows.
    ``rounds`` bounds the rounds of a level and ``least`` is the gain below
    which a round or level counts as none.
    """
    with scratch() as keep:
        links, nodes = (materialize(x, "graph") for x in _graph(edges))
        whole, quality, out = None, [], []
        for level in range(levels):
            first, best, labels = _level(links, nodes, rounds, least, few)
            if level and best <= first + least:
                break
            now = labels.toDF("node", "community") if whole is None else whole.join(_dealt(labels.toDF("community", "_c")), "community").select("node", F.col("_c").alias("community"))
            whole = materialize(now, "communities")
            out.append(keep(materialize(whole.select(F.lit(level).alias("level"), "node", "community"), "levels")))
            quality.append(best)
            links, nodes = (materialize(x, "graph") for x in _contract(links, nodes, labels))
    return edges.sparkSession.read.schema(out[0].schema).parquet(*[x._materialized_path for x in out]), quality


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, communities, modularity) of labels (level, node, community) on edges (a, b, w)."""
    links, nodes = _graph(edges)
    ends = links.groupBy("a").agg(F.sum("w").alias("s"))
    strengths = nodes.join(_dealt(ends), "a", "left").select(F.col("a").alias("node"), "loop", (F.coalesce("s", F.lit(0).cast("long")) + 2 * F.col("loop")).alias("k"))
    placed = materialize(strengths.join(_dealt(labels), "node"), "labelled")
    ca, cb = (labels.select(F.col("level").alias(f"l{x}"), F.col("node").alias(x), F.col("community").alias(f"c{x}")) for x in "ab")
    within = links.join(_dealt(ca), "a").join(_dealt(cb), ["b"]).filter("la = lb AND ca = cb").groupBy(F.col("la").alias("level"), F.col("ca").alias("community")).agg(F.sum("w").alias("w"))
    per = placed.groupBy("level", "community").agg(F.sum("k").alias("t"), F.sum("loop").alias("loop")).join(_dealt(within), ["level", "community"], "left")
    whole = per.groupBy("level").agg(F.sum("t").cast("double").alias("m2"))
    share = (F.coalesce("w", F.lit(0).cast("long")) + 2 * F.col("loop")).cast("double") / F.col("m2") - (F.col("t").cast("double") / F.col("m2")) ** 2
    return per.join(whole, "level").groupBy("level").agg(F.count("*").alias("communities"), F.sum(share).alias("modularity"))
