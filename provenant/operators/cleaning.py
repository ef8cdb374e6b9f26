"""Row cleaning: filters that keep nulls, all-null rows, duplicates, last-wins maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import differs_keeping_null, to_native_units


def exclude_value(df: DataFrame, column: str, value) -> DataFrame:
    """Drops rows equal to ``value``; null rows stay."""
    return df.filter(differs_keeping_null(column, value))


def drop_all_null(df: DataFrame, key: str) -> DataFrame:
    """Drops rows in which every column but ``key`` is null; the key moves last."""
    rest = [c for c in df.columns if c != key]
    return df.dropna(how="all", subset=rest).select(*rest, key)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row of each key in the given order; the order must be total for a defined result."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def duplicated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows (none kept apart) whose key combination occurs more than once."""
    counted = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("_n")).filter("_n > 1")
    return df.join(counted, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], "left_semi")


def shape_report(df: DataFrame, keys: list[str]) -> DataFrame:
    """(column, rows, filled, distinct_keys, repeated_rows) per column: the frame's shape and its duplicates by ``keys``."""
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.count(c).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    one = per_key.agg(
        total("_n").alias("rows"), F.count("*").alias("distinct_keys"), total(F.when(F.col("_n") > 1, F.col("_n"))).alias("repeated_rows"),
        *[total(f"_c{i}").alias(f"_c{i}") for i in range(len(df.columns))],
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_c{i}").alias("filled")) for i, c in enumerate(df.columns)])
    return one.select(F.explode(cells).alias("x"), "rows", "distinct_keys", "repeated_rows").select("x.*", "rows", "distinct_keys", "repeated_rows")


def with_several(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """Keys that have more than one distinct value."""
    return df.groupBy(key).agg(F.count_distinct(value).alias(name)).filter(F.col(name) > 1)


def last_wins(df: DataFrame, key: str, value: str, order: Column | str) -> DataFrame:
    """Map from non-empty keys to the non-empty value loaded last."""
    filled = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    for c in (key, value):
        if dict(df.dtypes)[c] == "string":
            filled = filled.filter(F.col(c) != "")
    return filled.groupBy(key).agg(F.max_by(value, order).alias(value))


def clean_edges(df: DataFrame, address: str, amount: str, zero) -> DataFrame:
    """Zero addresses out, raw amounts to whole units."""
    return exclude_value(df, address, zero).withColumn(amount, to_native_units(amount))
