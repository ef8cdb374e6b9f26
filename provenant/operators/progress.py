"""Progress and time left of a long job, as rows.

A step is a unit of work that has ended; its row says how much of all work is
done, how long that took and, at this rate, how long the rest will take.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "step string, done long, total long, elapsed_s double, left_s double"


def time_left(done: float, total: float, elapsed: float) -> float | None:
    return elapsed / done * (total - done) if done else None


class ProgressLog:
    """Appends a row per ended step to a Parquet folder; one writer."""

    def __init__(self, spark: SparkSession, path: str, total: int):
        self.spark, self.path, self.total = spark, path, total
        self.done, self.began = 0, time.monotonic()

    def step(self, name: str, amount: int = 1) -> tuple[str, int, int, float, float | None]:
        self.done += amount
        elapsed = time.monotonic() - self.began
        row = (name, self.done, self.total, elapsed, time_left(self.done, self.total, elapsed))
        self.spark.createDataFrame([row], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)
        return row

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path).orderBy("done")


def progress_rows(steps: DataFrame, step: str, amount: str, elapsed: str) -> DataFrame:
    """(step, done, total, elapsed_s, left_s) from a table of ended steps: amount of work, seconds since the start.

    Steps are few (stages, days), whatever the amount of work in each.
    """
    upto = Window.orderBy(elapsed, step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    done, total = F.sum(amount).over(upto), steps.agg(F.sum(amount)).scalar()
    left = F.try_divide(F.col("elapsed_s"), F.col("done").cast("double")) * (F.col("total") - F.col("done"))
    out = steps.select(F.col(step).alias("step"), done.alias("done"), total.alias("total"), F.col(elapsed).cast("double").alias("elapsed_s"))
    return out.withColumn("left_s", left)
