"""Evaluation of scores as relational aggregates.

Scores are first counted per distinct value, so curves run over thresholds,
not rows; running counts over these come from range partitions and offsets, as
model scores are nearly all distinct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import running_sums


def classify(df: DataFrame, score: str, threshold: float | Column, *, inclusive: bool) -> DataFrame:
    cut = F.lit(threshold) if isinstance(threshold, float) else threshold
    hit = F.col(score) >= cut if inclusive else F.col(score) > cut
    return df.withColumn("prediction", hit.cast("int"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """All four cells, empty ones with 0."""
    cells = df.sparkSession.sql(
        f"SELECT * FROM VALUES (0, 0), (0, 1), (1, 0), (1, 1) AS t({label}, {prediction})"
    )
    counted = df.groupBy(label, prediction).agg(F.count("*").alias("n"))
    return cells.join(counted, [label, prediction], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy, macro and weighted rows."""
    cells = confusion(df, label, prediction)
    pick = lambda l, p: F.sum(F.when((F.col(label) == l) & (F.col(prediction) == p), F.col("n")).otherwise(0)).cast("double")  # noqa: E731, E741
    one = cells.agg(pick(1, 1).alias("tp"), pick(0, 1).alias("fp"), pick(1, 0).alias("fn"), pick(0, 0).alias("tn"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    p1, r1, p0, r0 = rate(tp, tp + fp), rate(tp, tp + fn), rate(tn, tn + fn), rate(tn, tn + fp)
    f1 = lambda p, r: F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    n0, n1 = tn + fp, tp + fn
    both = lambda a, b: rate(a * n0 + b * n1, n0 + n1)
    accuracy = rate(tp + tn, n0 + n1)
    row = lambda name, *v: F.struct(F.lit(name).alias("class"), *[x.alias(c) for x, c in zip(v, ("precision", "recall", "f1", "support"), strict=True)])
    rows = F.array(
        row("0", p0, r0, f1(p0, r0), n0),
        row("1", p1, r1, f1(p1, r1), n1),
        row("accuracy", accuracy, accuracy, accuracy, n0 + n1),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1(p0, r0) + f1(p1, r1)) / 2, n0 + n1),
        row("weighted avg", both(p0, p1), both(r0, r1), both(f1(p0, r0), f1(p1, r1)), n0 + n1),
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def threshold_counts(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Per distinct score s: tp and fp at ``score >= s``, those at s itself, and the totals."""
    per = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(label).cast("long")).alias("own_tp"), F.sum(1 - F.col(label).cast("long")).alias("own_fp")
    )
    summed = running_sums(per, [-F.col("threshold")], ["own_tp", "own_fp"])
    return summed.select(
        "threshold",
        F.col("upto_own_tp").alias("tp"),
        F.col("upto_own_fp").alias("fp"),
        "own_tp",
        "own_fp",
        summed.agg(F.sum("own_tp")).scalar().alias("pos"),
        summed.agg(F.sum("own_fp")).scalar().alias("neg"),
    )


def pr_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """(threshold, precision, recall, f1), f1 null where undefined."""
    tp, fp, pos = (F.col(c).cast("double") for c in ("tp", "fp", "pos"))
    p, r = tp / (tp + fp), F.when(pos > 0, tp / pos)
    return threshold_counts(df, score, label).select(
        "threshold", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).alias("f1")
    )


def best_f1_threshold(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """The smallest threshold with the largest F1; undefined F1 values are left out."""
    return pr_curve(df, score, label).filter("f1 IS NOT NULL").orderBy(F.desc("f1"), "threshold").limit(1)


def roc_curve(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    tp, fp, pos, neg = (F.col(c).cast("double") for c in ("tp", "fp", "pos", "neg"))
    return threshold_counts(df, score, label).select(
        "threshold", F.when(neg > 0, fp / neg).alias("fpr"), F.when(pos > 0, tp / pos).alias("tpr")
    )


def roc_auc(df: DataFrame, score: str = "score", label: str = "label") -> DataFrame:
    """Trapezoid area, from (0, 0): the point before a threshold is its counts without its own."""
    tp, fp, pos, neg, own = (F.col(c).cast("double") for c in ("tp", "own_fp", "pos", "neg", "own_tp"))
    area = F.when((pos > 0) & (neg > 0), fp / neg * (2 * tp - own) / pos / 2)
    return threshold_counts(df, score, label).select(area.alias("a")).agg(F.sum("a").alias("auc"))
