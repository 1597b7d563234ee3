"""Estimates: never a bare number. A value without observations is NULL, with a note, and not zero."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Fixed value: the 97.5 % point of the normal distribution.
Z = 1.959963984540054


def wilson(successes: Column, n: Column) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, in 0 to 1; NULL where n is 0."""
    p, n = F.try_divide(successes.cast("double"), n), F.nullif(n, F.lit(0)).cast("double")
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    return F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half)


def ratio(a: Column, b: Column) -> Column:
    """NULL where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def proportion(successes: Column, n: Column) -> Column:
    """An Estimate: value, n, low, high, method, note."""
    low, high = wilson(successes, n)
    note = F.when(n == 0, "no observations").otherwise("")
    return F.struct(ratio(successes, n).alias("value"), n.cast("long").alias("n"), low.alias("low"), high.alias("high"), F.lit("wilson").alias("method"), note.alias("note"))


def truthy(c: Column) -> Column:
    """NULL for NULL and ''."""
    return F.nullif(c, F.lit(""))


def falsy_to_null(c: Column) -> Column:
    """NULL for NULL and 0."""
    return F.nullif(c, F.lit(0))


def nearest_rank(value: str, p: float) -> Column:
    """The smallest value with at least a share p of all at or below it."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
