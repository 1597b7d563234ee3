"""Join discipline: what matched, what did not, and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.stats import truthy


def paired(labels: DataFrame, predictions: DataFrame, key: str, label: str, predicted: str) -> DataFrame:
    """Rows of the inner join in which both sides have a usable value."""
    return labels.where(truthy(F.col(label).cast("string")).isNotNull()).join(predictions.where(truthy(F.col(predicted).cast("string")).isNotNull()), key)


def unmatched(labels: DataFrame, predictions: DataFrame, key: str, label: str, predicted: str) -> DataFrame:
    """Labelled rows without a usable prediction: no row, or a row without a value."""
    usable = predictions.where(truthy(F.col(predicted).cast("string")).isNotNull())
    return labels.where(truthy(F.col(label).cast("string")).isNotNull()).join(usable, key, "left_anti")


def reconciled(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: only_a, only_b, both; a caller aborts if either of the first is above 0."""
    sides = a.select(key, F.lit(1).alias("in_a")).distinct().join(b.select(key, F.lit(1).alias("in_b")).distinct(), key, "full_outer")
    return sides.agg(F.count_if(F.expr("in_b is null")).alias("only_a"), F.count_if(F.expr("in_a is null")).alias("only_b"), F.count_if(F.expr("in_a = in_b")).alias("both"))


def pivoted(df: DataFrame, key: str, arm: str, arms: list[str], value: str) -> DataFrame:
    """A row for each key, a column for each arm; the values are named, so no extra job lists them."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(arm) == a, F.col(value))).alias(a.lower().replace("-", "_").replace(" ", "_")) for a in arms])


def replaced(rows: DataFrame, further: DataFrame, key: str = "step_id") -> DataFrame:
    """Judgements with those judged again replaced: verdict, confidence, error type, and the rationale unless blank."""
    new = further.select(key, *[F.col(c).alias(f"new_{c}") for c in ("verdict", "validity_confidence", "error_type", "rationale")], F.lit(True).alias("again"))
    out = rows.join(new, key, "left")
    for c in ("verdict", "validity_confidence", "error_type"):
        out = out.withColumn(c, F.when(F.col("again"), F.col(f"new_{c}")).otherwise(F.col(c)))
    out = out.withColumn("rationale", F.coalesce(truthy(F.trim("new_rationale")), "rationale"))
    return out.drop(*[c for c in out.columns if c.startswith("new_")]).withColumn("escalated", F.coalesce("again", F.lit(False))).drop("again")


def cited(trace_ids: str, cited_ids: str):
    """Cited ids that the trace has, in the order cited."""
    return F.filter(cited_ids, lambda x: F.array_contains(trace_ids, x))


def id_check(wanted: str, returned: str):
    """struct of missing, extra and duplicate ids, and ok if there are none."""
    missing, extra = F.array_except(wanted, returned), F.array_except(returned, wanted)
    twice = F.size(returned) - F.size(F.array_distinct(returned))
    return F.struct(missing.alias("missing"), extra.alias("extra"), twice.alias("duplicates"), ((F.size(missing) == 0) & (F.size(extra) == 0) & (twice == 0)).alias("ok"))
