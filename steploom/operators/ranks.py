"""Exact order statistics of groups too large to be held: a sketch brackets each rank, one pass counts, and only values in a bracket are sorted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.stats import ratio

#: Of the sketch: its rank error is about n / ACCURACY, so that a bracket of SLACK times that on either side holds the rank.
ACCURACY, SLACK = 10_000, 4


def _ranked(df: DataFrame, keys: list[str], value: str, wanted: dict[str, tuple[float, Callable[[Column], Column]]]) -> DataFrame:
    """keys, n, and for each name the value at rank(n). Rows outside all brackets fold into a few counts for each key before the shuffle.

    NULL values do not count; a group of them alone gives no row. A rank outside its bracket, which the sketch's bound excludes, is an error.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("v"))
    room = SLACK / ACCURACY
    shares = [x for p, _ in wanted.values() for x in (max(0.0, p - room), min(1.0, p + room))]
    bounds = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("v", shares, ACCURACY).alias("e"))
    if keys:
        same = bounds.select(*[F.col(k).alias(f"b_{k}") for k in keys], "n", "e")
        on = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
        placed = rows.join(same, on)  # a row a key: Spark broadcasts it if it is small
    else:
        placed = rows.crossJoin(F.broadcast(bounds))  # one row
    inside = [F.col("v").between(F.col("e")[2 * i], F.col("e")[2 * i + 1]) for i in range(len(wanted))]
    hit = inside[0]
    for x in inside[1:]:
        hit = hit | x
    zone = sum(((F.col("v") > F.col("e")[i]).cast("int") for i in range(len(shares))), F.lit(0))
    counted = placed.select(*keys, "n", "v", F.when(hit, F.col("v")).alias("held"), F.when(~hit, zone).alias("zone")).groupBy(*keys, "n", "held", "zone").agg(F.count("*").alias("m"), F.min("v").alias("at"))
    upto = counted.withColumn("upto", F.sum("m").over(W.partitionBy(*(keys or [F.lit(1)])).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)))
    first = [F.min(F.when(F.col("upto") >= rank(F.col("n")), F.struct("at", "held"))).alias(name) for name, (_, rank) in wanted.items()]
    out = upto.groupBy(*keys, "n").agg(*first)
    exact = [F.when(F.assert_true(F.col(f"{name}.held").isNotNull(), F.lit("a rank is outside its bracket")).isNull(), F.col(f"{name}.at")).alias(name) for name in wanted]
    return out.select(*keys, "n", *exact)


def nearest(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n, and for each name the smallest value with at least that share of all at or below it."""
    rank = lambda p: lambda n: F.greatest(F.lit(1), F.least(n, F.ceil(n * p)))
    return _ranked(df, keys, value, {name: (p, rank(p)) for name, p in shares.items()})


def medians(df: DataFrame, keys: list[str], value: str, name: str = "median") -> DataFrame:
    """keys and the median: the mean of the two values in the middle."""
    two = _ranked(df, keys, value, {"below": (0.5, lambda n: F.floor((n + 1) / 2)), "above": (0.5, lambda n: F.ceil((n + 1) / 2))})
    return two.select(*keys, ratio(F.col("below") + F.col("above"), F.lit(2)).alias(name))
