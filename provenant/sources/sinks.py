"""Sinks: CSV without index, sorted line files, replaced tables, chunked extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def write_csv(df: DataFrame, path: str, *, single_file: bool = False, append: bool = False) -> None:
    """Header, no index.  One file only on request: a single task writes it then."""
    (df.coalesce(1) if single_file else df).write.mode("append" if append else "overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str, column: str = "address") -> None:
    """Headerless sorted lines; range-partitioned, so part files are in global order."""
    df.select(F.col(column).cast("string").alias("value")).filter("value IS NOT NULL").orderBy("value").write.mode(
        "overwrite"
    ).text(path)


def replace_table(df: DataFrame, name: str, *, days_to_live: int | None = None, location: str | None = None) -> None:
    """Create or replace a table.  Spark keeps no expiry, so it is recorded as a property."""
    writer = df.write.mode("overwrite").format("parquet")
    (writer.option("path", location) if location else writer).saveAsTable(name)
    if days_to_live is not None:
        expiry = df.sparkSession.range(1).select(
            F.date_format(F.current_timestamp() + F.make_dt_interval(F.lit(days_to_live)), "yyyy-MM-dd HH:mm:ss")
        )
        df.sparkSession.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('expires_at' = '{expiry.first()[0]}')")


def rank_chunk(df: DataFrame, order: str, low: int, high: int, name: str = "rank") -> DataFrame:
    """Rows whose global rank (ties share it, nulls last) is within ``low..high`` inclusive.

    A global window would sort everything in one task.  Here ranks come from
    counts: rows per key are counted, keys are range-partitioned, each
    partition's total is turned into an offset, and only a window inside each
    partition remains.
    """
    keys = df.groupBy(F.col(order).alias("_k")).agg(F.count("*").alias("_n"))
    placed = materialize(keys.orderBy(F.asc_nulls_last("_k")).withColumn("_p", F.spark_partition_id()), "rank")
    totals = placed.groupBy("_p").agg(F.sum("_n").alias("_t"))
    offsets = totals.select("_p", _running("_t", "_p").alias("_before"))
    inside = F.expr(
        "coalesce(sum(_n) over (partition by _p order by _k asc nulls last rows between unbounded preceding and 1 preceding), 0)"
    )
    ranked = placed.join(offsets, "_p").select("_k", (inside + F.col("_before") + 1).cast("long").alias(name))
    ranked = ranked.filter(F.col(name).between(low, high))
    return df.join(ranked, df[order].eqNullSafe(ranked["_k"])).drop("_k")


def _running(value: str, order: str) -> Column:
    """Sum of all earlier rows; only over one row per partition of the data."""
    return F.expr(f"coalesce(sum({value}) over (order by {order} rows between unbounded preceding and 1 preceding), 0)")


def offset_chunk(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)
