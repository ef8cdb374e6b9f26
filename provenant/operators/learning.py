"""Stratified splits and exact balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import number_rows


def hash_order(key: str, seed: int) -> Column:
    """A pseudo-random order that depends on key and seed only, so a re-run of a lost task agrees."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))


def stratified_split(
    df: DataFrame, key: str, label: str, test: float = 0.3, validation: float = 0.3, seed: int = 42
) -> DataFrame:
    """Adds ``split``: per class, the first ``test`` share in hash order is test, then
    ``validation`` of the rest is validation, what remains is train (49 / 21 / 30 %)."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))  # one row per class
    before = Window.orderBy(F.asc_nulls_first(label)).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.withColumnRenamed(label, "_class")
    numbered = number_rows(df, [F.col(label), hash_order(key, seed), F.col(key)], "_i")
    out = numbered.join(counts, numbered[label].eqNullSafe(counts["_class"]))
    n_test = F.round(F.col("_n") * test).cast("long")
    n_val = F.round((F.col("_n") - n_test) * validation).cast("long")
    rn = F.col("_i") - F.col("_first") + 1
    kind = F.when(rn <= n_test, "test").when(rn <= n_test + n_val, "validation").otherwise("train")
    return out.withColumn("split", kind).drop("_class", "_n", "_first", "_i")


def upsample_minority(df: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """Both classes with exactly as many rows as the larger one: the smaller is drawn with replacement.

    Draws come from a hash of the draw's number, joined to row numbers of the minority.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(3).collect()}
    if len(counts) > 2 or None in counts:
        raise ValueError(f"{label} must have two classes and no null")
    if len(counts) < 2:
        return df
    minor, major = sorted(counts, key=lambda c: (counts[c], c))
    rows = df.filter(F.col(label) == minor)
    numbered = number_rows(rows, [hash_order(key, seed), F.col(key)], "_i")
    spark = df.sparkSession
    draws = spark.range(counts[major]).select(
        F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(counts[minor])).alias("_i")
    )
    return df.filter(F.col(label) == major).unionByName(draws.join(numbered, "_i").drop("_i"))
