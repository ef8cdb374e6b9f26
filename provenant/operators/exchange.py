"""Exchange exposure: distinct labelled counterparties of each receiver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Kinds of label that the pivot has (fixed values).
KINDS = ("cex", "dex")


def labelled_counterparties(transfers: DataFrame, labels: DataFrame, until, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(to_address, label_type, n): distinct labelled senders up to and including ``until``; with ``kinds``, of these labels alone."""
    kept = transfers.filter(F.col("ts") <= until)
    if kinds is not None:  # before the join: the labels are all that is read of them
        labels = labels.filter(F.col("label_type").isin(*kinds))
    labels = labels.select("address", "label_type").distinct()
    return (
        kept.join(labels, kept["from_address"] == labels["address"])
        .groupBy("to_address", "label_type")
        .agg(F.count_distinct("from_address").alias("n"))
    )


def exchange_pivot(addresses: DataFrame, counted: DataFrame) -> DataFrame:
    """One row per address with its ``cex`` and ``dex`` counts, 0 where there is none."""
    both = addresses.join(counted, addresses["addr"] == counted["to_address"], "left")
    one = lambda kind: F.max(F.when(F.col("label_type") == kind, F.col("n")).otherwise(F.lit(0).cast("long")))
    return both.groupBy(F.col("addr").alias("to_address")).agg(
        one("cex").alias("cex_in_count"), one("dex").alias("dex_in_count")
    )
