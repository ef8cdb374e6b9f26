"""Time-respecting provision: when funds of given sources can first have reached an address.

A transfer passes funds on only if it is later than their arrival at its
sender.  Arrivals are corrected round by round: transfers of the addresses
whose arrival got earlier are joined, the least time of each receiver is kept,
and only those that improve go on.  Rounds end by themselves, as times only
fall; each round's state is a written table.  Hops are then counted over the
transfers that made the final arrivals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, scratch

#: Rows up to which what a round has reached anew is broadcast; all other joins are shuffled, so the driver gets no tables.
FEW = 10_000


def _side(df: DataFrame, n: int | None = None) -> DataFrame:
    """A side of a join, of ``n`` rows if that is known."""
    return F.broadcast(df) if n is not None and n <= FEW else df.hint("merge")


def earliest_arrival(transfers: DataFrame, sources: DataFrame, time: str = "block") -> DataFrame:
    """(address, arrival, hops) of the sources (arrival null, no hops) and of all that their funds can have reached; written.

    ``transfers``: from_address, to_address, value and a whole-number ``time``;
    ``sources``: one column, from which funds may come at any time.  ``hops``
    is the least number of transfers of the paths that arrive first everywhere
    on their way.
    Transfers without an end, a time or a positive value are none; a transfer to
    its own sender passes nothing on; sources keep their null arrival.
    """
    kind = dict(transfers.dtypes)["to_address"]
    with scratch() as keep:
        rows = transfers.filter(F.col("value") > 0).filter("from_address IS NOT NULL AND to_address IS NOT NULL AND from_address <> to_address")
        edges = rows.select(F.col("from_address").alias("a"), F.col("to_address").alias("b"), F.col(time).cast("long").alias("t")).filter("t IS NOT NULL").distinct()
        edges = materialize(edges, "transfers")
        starts = sources.select(F.col(sources.columns[0]).cast(kind).alias("node")).filter("node IS NOT NULL").distinct()
        known = materialize(starts.select("node", F.lit(None).cast("long").alias("t")), "arrivals")
        fresh = known
        while n := fresh.count():
            out = edges.join(_side(fresh.select(F.col("node").alias("a"), F.col("t").alias("since")), n), "a").filter("since IS NULL OR t > since")
            reached = out.groupBy(F.col("b").alias("node")).agg(F.min("t").alias("_t"))
            met = reached.join(_side(known.withColumn("_met", F.lit(True))), "node", "left")
            new = materialize(met.filter("_met IS NULL OR _t < t").select("node", F.col("_t").alias("t")), "earlier")
            before, known = known, materialize(known.join(_side(new.select("node")), "node", "left_anti").unionByName(new), "arrivals")
            if fresh is not before:
                release(fresh)
            release(before)
            fresh = new
        # the transfers that arrive first, from where funds had arrived first
        ends = known.select(F.col("node").alias("b"), "t").filter("t IS NOT NULL")
        since = known.select(F.col("node").alias("a"), F.col("t").alias("since"))
        tight = materialize(edges.join(_side(ends), ["b", "t"]).join(_side(since), "a").filter("since IS NULL OR t > since").select("a", "b"), "tight")
        frontier = materialize(starts, "hops")
        out, hops = frontier.withColumn("hops", F.lit(0).cast("long")), 0
        seen = [frontier]
        while n := frontier.count():
            hops += 1
            ahead = tight.join(_side(frontier.select(F.col("node").alias("a")), n), "a", "left_semi").select(F.col("b").alias("node")).distinct()
            met = edges.sparkSession.read.schema(frontier.schema).parquet(*[x._materialized_path for x in seen])
            frontier = materialize(ahead.join(_side(met), "node", "left_anti"), "hops")
            seen.append(frontier)
            out = out.unionByName(frontier.withColumn("hops", F.lit(hops).cast("long")))
            if hops % 32 == 0:  # plans stay short, however many hops there are
                out = materialize(out, "hops-so-far")
        known = keep(materialize(known.join(_side(out), "node"), "arrivals"))
    return known.select(F.col("node").alias("address"), F.col("t").alias("arrival"), "hops")
