"""Scalar column helpers; every one is a built-in expression, so plans stay in codegen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def differs_keeping_null(c: Column | str, value) -> Column:
    """``c != value`` where a null counts as different (a plain ``<>`` would drop it)."""
    return ~_col(c).eqNullSafe(F.lit(value))


def safe_divide(n: Column, d: Column) -> Column:
    """``n / d`` in double; 0 where the divisor is null or 0."""
    d = d.cast("double")
    return F.when(F.coalesce(d, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(n.cast("double") / d)


def strip_whitespace(c: Column | str) -> Column:
    """Both ends stripped of all white space, carriage returns included."""
    return F.regexp_replace(_col(c), r"^\s+|\s+$", "")


def epoch_seconds(c: Column | str) -> Column:
    """Whole seconds; a timestamp without time zone is taken as it stands, whatever the session's zone."""
    return F.unix_timestamp(_col(c)).cast("long")


def to_native_units(c: Column | str) -> Column:
    """Raw integer amount to whole units: bad text is null, two divisions keep the last digit."""
    return _col(c).try_cast("double") / F.lit(1e9) / F.lit(1e9)


def double_sum(c: Column | str) -> Column:
    """Sum in the column's own type (exact for decimals), then double; no rows: 0."""
    return F.coalesce(F.sum(_col(c)).cast("double"), F.lit(0.0))


def mean_of(c: Column | str) -> Column:
    """Mean as double sum over non-null count; null for no value."""
    c = _col(c)
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def after_fill(c: Column) -> Column:
    """NaN and null become 0."""
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])
