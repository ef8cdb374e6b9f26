"""Label sets and existence joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def member_set(df: DataFrame, column: str, name: str = "address") -> DataFrame:
    """Distinct non-null members of a column."""
    return df.select(F.col(column).alias(name)).filter(F.col(name).isNotNull()).distinct()


def union_sets(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def flag_membership(df: DataFrame, key: str, members: DataFrame, flag: str) -> DataFrame:
    """Adds a boolean, true where ``key`` is in the one-column ``members``; a null key is false.

    A left join to a distinct set: adaptive execution broadcasts a small set
    and shuffles a large one.
    """
    column = members.columns[0]
    marked = members.select(F.col(column).alias("_m")).distinct().withColumn(flag, F.lit(True))
    return (
        df.join(marked, df[key] == marked["_m"], "left").drop("_m").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))
    )


def without_members(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    column = members.columns[0]
    return df.join(members.select(F.col(column).alias("_m")), df[key] == F.col("_m"), "left_anti")


def only_members(df: DataFrame, key: str, members: DataFrame) -> DataFrame:
    column = members.columns[0]
    return df.join(members.select(F.col(column).alias("_m")), df[key] == F.col("_m"), "left_semi")
