"""Global row numbers without one task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize


def running_sums(df: DataFrame, order: list[Column | str], columns: list[str]) -> DataFrame:
    """Adds ``upto_<column>``: the sum of the column over all rows up to and including the own one, in the given order.

    Rows are range-partitioned and sorted; what comes before a partition is the
    sum of the totals of the earlier ones, so no task sees all rows.  Rows must
    not tie in ``order``, which is ascending.
    """
    rank = [c if isinstance(c, Column) else F.col(c) for c in order]
    keys = [f"_o{i}" for i in range(len(rank))]
    placed = df.withColumns(dict(zip(keys, rank, strict=True)))
    placed = materialize(placed.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "running")
    totals = placed.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{c}") for c in columns])
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_p", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in columns])
    inside = Window.partitionBy("_p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.join(offsets, "_p").withColumns({f"upto_{c}": F.sum(c).over(inside) + F.col(f"_b_{c}") for c in columns})
    return out.drop("_p", *keys, *[f"_b_{c}" for c in columns])


def number_rows(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds 0-based numbers in the given order.

    Rows are range-partitioned and sorted once; each partition's count becomes
    the offset of the next, and numbers are assigned inside partitions.
    """
    rank = [c if isinstance(c, Column) else F.col(c) for c in order]
    keys = [f"_o{i}" for i in range(len(rank))]
    placed = df.withColumns(dict(zip(keys, rank, strict=True)))
    placed = materialize(placed.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id()), "numbered")
    totals = placed.groupBy("_p").agg(F.count("*").alias("_t"))
    upto = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = totals.select("_p", F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_p").orderBy(*keys))
    return placed.join(offsets, "_p").withColumn(name, inside - 1 + F.col("_before")).drop("_p", "_before", *keys)
