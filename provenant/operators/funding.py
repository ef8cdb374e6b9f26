"""First-funding edges, their closure, and star features of providers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import double_sum, safe_divide
from ..session import materialize, scratch


def earliest_blocks(transfers: DataFrame) -> DataFrame:
    """Per address: the earliest positive transfer and how many share its time and block.

    Aggregates alone, so a hot receiver's history is reduced before it is
    shuffled.  Partial results combine: see :func:`merge_first`.
    """
    per_block = (
        transfers.filter(F.col("value") > 0)
        .groupBy("to_address", "ts", "block")
        .agg(F.count("*").alias("n"), F.min(F.struct("tx", "from_address", "value")).alias("first"))
    )
    return _first_block(per_block)


def _first_block(per_block: DataFrame) -> DataFrame:
    first = F.min(F.struct("ts", "first.tx", "block", "n", "first")).alias("m")
    return per_block.groupBy("to_address").agg(first).select("to_address", "m.ts", "m.block", "m.n", "m.first")


def merge_first(partials: DataFrame) -> DataFrame:
    """Combines partial earliest blocks: equal (ts, block) add up, later ones go."""
    return _first_block(partials.groupBy("to_address", "ts", "block").agg(F.sum("n").alias("n"), F.min("first").alias("first")))


def as_edges(merged: DataFrame) -> DataFrame:
    return merged.filter("n = 1").select(
        F.col("to_address").alias("activated_address"),
        F.col("first.from_address").alias("gas_provider"),
        F.col("first.value").alias("amount"),
        "ts",
        "block",
        F.col("first.tx").alias("tx"),
    )


def first_funding(transfers: DataFrame) -> DataFrame:
    """The earliest positive inbound transfer of each address, if it is alone in its block.

    An address whose first block holds several positive transfers has no edge:
    there is no tie-break.  Input: to_address, from_address, value, ts, block, tx.
    """
    return as_edges(earliest_blocks(transfers))


def _by_jumps(parents: DataFrame, seeds: DataFrame, max_level: int, keep) -> DataFrame:
    """What ``seeds`` (a) reach in ``max_level`` steps at most over (node, ptr), one pointer per node; written.

    Table j has every node's 2^j-th ancestor, and what is reached in less than
    2^j steps doubles by one join with it; the steps that are left at the end
    are put together from the tables.  Rounds are twice the logarithm of the
    bound at most, and end as soon as nothing new is reached.
    """

    def ahead(places: DataFrame, jump: DataFrame) -> DataFrame:
        return places.join(jump, places["a"] == jump["node"]).select(F.col("ptr").alias("a")).distinct()

    jumps, reached, size = [materialize(parents, "jump")], seeds, 1  # all in less than ``size`` steps
    count = reached.count()
    while 2 * size - 1 <= max_level:
        more = keep(materialize(reached.unionByName(ahead(reached, jumps[-1])).distinct(), "reached"))
        grown = more.count()
        reached, size = more, 2 * size
        if grown == count:
            return reached
        count, jump = grown, jumps[-1]
        further = jump.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"))
        jumps.append(materialize(jump.join(further, "ptr").select("node", F.col("_p").alias("ptr")), "jump"))
    left, places = max_level - (size - 1), reached
    for j, jump in enumerate(jumps):
        if left >> j & 1:
            places = materialize(ahead(places, jump), "reached")
    return keep(materialize(reached.unionByName(places).distinct(), "reached")) if left else reached


def _by_levels(edges: DataFrame, seeds: DataFrame, max_level: int, keep) -> DataFrame:
    """The same where an address has several providers: a frontier loop.

    Each level joins only addresses not reached before, so cycles end.  What
    was reached is one growing set of files, a single scan however many levels
    there were.
    """
    levels, frontier, seen = [seeds], seeds, seeds
    for _ in range(max_level):
        reached = edges.join(frontier, edges["activated_address"] == frontier["a"], "left_semi")
        fresh = reached.select(F.col("gas_provider").alias("a")).filter("a IS NOT NULL").distinct()
        frontier = materialize(fresh.join(seen, "a", "left_anti"), "closure")
        if frontier.isEmpty():
            break
        levels.append(keep(frontier))
        seen = edges.sparkSession.read.schema(frontier.schema).parquet(*[x._materialized_path for x in levels])
    return seen


def provision_closure(edges: DataFrame, seeds: DataFrame, max_level: int = 500) -> DataFrame:
    """All distinct edges on the way up from ``seeds`` (one column), self-loops included, of addresses ``max_level`` steps away at most.

    One provider per address, as first funding has it, is followed by doubling;
    several by levels.
    """
    column = seeds.columns[0]
    with scratch() as keep:
        edges = keep(materialize(edges, "edges"))
        start = keep(materialize(seeds.select(F.col(column).alias("a")).filter("a IS NOT NULL").distinct(), "closure"))
        parents = edges.select(F.col("activated_address").alias("node"), F.col("gas_provider").alias("ptr")).filter("node <> ptr").distinct()
        several = parents.groupBy("node").agg(F.min("ptr").alias("x"), F.max("ptr").alias("y")).filter("x < y")
        seen = _by_jumps(parents, start, max_level, keep) if several.isEmpty() else _by_levels(edges, start, max_level, keep)
    return edges.join(seen, edges["activated_address"] == seen["a"], "left_semi").distinct()


def provider_star(rows: DataFrame) -> DataFrame:
    """Fan-out and amounts per provider over (gas_provider, activated_address, amount) rows.

    The average divides the total by the fan-out, not by the rows.
    """
    grouped = (
        rows.filter(F.col("gas_provider").isNotNull())
        .groupBy("gas_provider")
        .agg(
            F.count_distinct("activated_address").alias("provider_fan_out"),
            double_sum("amount").alias("provider_total_gas_provision_amount"),
            F.max("amount").cast("double").alias("provider_max_gas_provision_amount"),
            F.min("amount").cast("double").alias("provider_min_gas_provision_amount"),
        )
    )
    return grouped.withColumn(
        "provider_avg_gas_provision_amount",
        safe_divide(F.col("provider_total_gas_provision_amount"), F.col("provider_fan_out")),
    )


def star_features(rows: DataFrame, labeled: DataFrame) -> DataFrame:
    """Provider features on each (provider, activated) row and the running star flag.

    A provider is a star when it funds more than one address and is not
    labeled.  The flag of a row says whether its address was funded by any star
    up to and including the row's own provider, in provider order.
    """
    from .labels import flag_membership

    stars = flag_membership(provider_star(rows), "gas_provider", labeled, "_labeled").withColumn(
        "_star", ((F.col("provider_fan_out") > 1) & ~F.col("_labeled")).cast("int")
    )
    joined = rows.filter(F.col("gas_provider").isNotNull()).join(stars, "gas_provider")
    upto = (
        Window.partitionBy("activated_address").orderBy("gas_provider").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return joined.withColumn("provider_is_star_like_attack", F.max("_star").over(upto)).drop("_star", "_labeled")
