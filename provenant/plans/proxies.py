"""The driver's tables seen as a transaction network.

Amounts are exact decimals so that sums do not depend on the order of rows.
Each view stands for one extract: transfers, messages, transactions, label
sets, interactors, truth list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.funding import first_funding
from ..session import materialize
from ..sources import read_table

#: Home chains among the proxy values and the time limits of the behaviour blocks (fixed values).
HOME_SOURCE, HOME_DESTINATION = "A", "1-URGENT"
CUTOFF = "1998-01-01 00:00:00"
#: Total quantity above which a customer counts as one of the truth list (a value of this proxy alone).
SYBIL_QUANTITY = 1150.0


class Proxies:
    """Lazily built views over one scale folder."""

    def __init__(self, spark: SparkSession, sf_dir: str, trades: DataFrame | None = None):
        self.spark, self.sf_dir, self.trades = spark, sf_dir, trades

    def written(self) -> Proxies:
        """The same views, for queries that read several of them: lines with their orders and brands are joined and written once.

        Parts come first, so lines leave the join with orders one order after
        another, and what they share packs well in the next shuffle.  A line
        keeps all brands of its part key, so it is one row whatever the number
        of parts.
        """
        p = self.table("part").groupBy("p_partkey").agg(F.collect_list(F.struct(F.col("p_brand").alias("brand"))).alias("brands"))
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority")
        lines = self._lines.join(p, F.col("l_partkey") == F.col("p_partkey"), "left").drop("p_partkey")
        trades = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey")).drop("o_orderkey")
        return Proxies(self.spark, self.sf_dir, materialize(trades, "trades"))

    def table(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @property
    def cutoff(self):
        return F.lit(CUTOFF).cast("timestamp_ntz")

    @property
    def xfer(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_custkey").alias("to_address"),
            (F.col("o_orderkey") % F.greatest("o_custkey", F.lit(1))).alias("from_address"),
            F.col("o_totalprice").cast("decimal(18,2)").alias("value"),
            F.col("o_orderdate").cast("timestamp_ntz").alias("ts"),
            F.datediff("o_orderdate", F.lit("1995-01-01")).cast("long").alias("block"),
            F.col("o_orderkey").alias("tx"),
        )

    @property
    def first_edge(self) -> DataFrame:
        return first_funding(self.xfer)

    @property
    def _lines(self) -> DataFrame:
        """Lines with exact amounts, which are also narrower in a shuffle than doubles."""
        amounts = {c: F.col(c).cast("decimal(18,2)") for c in ("l_extendedprice", "l_discount", "l_tax")}
        return self.table("lineitem").withColumns(amounts).drop("l_linenumber", "l_linestatus")

    @property
    def _ordered(self) -> DataFrame:
        """Lines with their orders."""
        return self._lines.join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey")) if self.trades is None else self.trades

    @property
    def messages(self) -> DataFrame:
        if self.trades is None:
            rows = self._ordered.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).withColumnRenamed("p_brand", "brand")
        else:
            rows = self.trades.select("*", F.inline("brands"))
        return rows.select(
            F.col("o_custkey").alias("sender_wallet"),
            F.col("l_returnflag").alias("source_chain"),
            F.col("o_orderpriority").alias("destination_chain"),
            F.col("brand").alias("project"),
            F.col("l_suppkey").alias("source_contract"),
            F.col("l_partkey").alias("destination_contract"),
            F.nullif(F.col("l_extendedprice"), F.lit(0)).alias("swap_usd"),
            F.nullif(F.col("l_discount"), F.lit(0)).alias("drop_usd"),
            F.col("l_orderkey").alias("tx_hash"),
            F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        )

    @property
    def transactions(self) -> DataFrame:
        return self._ordered.select(
            F.col("o_custkey").alias("from_address"),
            F.col("l_suppkey").alias("to_address"),
            F.col("l_extendedprice").alias("value"),
            F.col("l_tax").alias("fee"),
            F.datediff("l_shipdate", F.lit("1992-01-01")).cast("long").alias("block"),
            F.col("l_shipdate").cast("timestamp_ntz").alias("ts"),
        )

    def _customers(self, condition: str) -> DataFrame:
        return self.table("customer").filter(condition).select(F.col("c_custkey").alias("address"))

    @property
    def labeled(self) -> DataFrame:
        return self._customers("c_mktsegment = 'BUILDING'")

    @property
    def cex(self) -> DataFrame:
        return self._customers("c_mktsegment = 'MACHINERY'")

    @property
    def dex(self) -> DataFrame:
        return self._customers("c_mktsegment = 'FURNITURE'")

    @property
    def interactors(self) -> DataFrame:
        return self._customers("c_acctbal >= 0")

    @property
    def sybil(self) -> DataFrame:
        """Customers of large total quantities, one in sixteen classes turned over by a digest of the key.

        No feature reads quantities; features only follow the activity behind them, so the class can be learned but not read off.
        """
        c = self.table("customer")
        totals = self._ordered.groupBy("o_custkey").agg(F.sum("l_quantity").alias("quantity"))
        joined = c.join(totals, F.col("c_custkey") == F.col("o_custkey"), "left")
        large = F.coalesce(F.col("quantity"), F.lit(0.0)) > SYBIL_QUANTITY
        noise = F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 1) == "f"
        return joined.filter(large != noise).select(F.col("c_custkey").alias("address"))

    @property
    def label_dim(self) -> DataFrame:
        """Labels with repeated addresses (each exchange customer appears under two kinds of row)."""
        kind = lambda df, k: df.withColumn("label_type", F.lit(k))
        cex, dex = kind(self.cex, "cex"), kind(self.dex, "dex")
        return cex.unionByName(dex).unionByName(cex).unionByName(kind(self.labeled, "other"))

    @property
    def scored(self) -> DataFrame:
        """A fixed score column for the curve queries: quantity in fiftieths against the return flag."""
        l = self.table("lineitem")  # noqa: E741
        return l.select(
            (F.col("l_quantity").cast("long") / F.lit(50.0)).alias("score"),
            (F.col("l_returnflag") == "R").cast("int").alias("label"),
        )
