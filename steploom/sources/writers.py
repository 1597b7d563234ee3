"""Writers: JSON by item, appended lines, and results that carry an earlier block forward."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def canonical(*columns: str) -> Column:
    """JSON with the keys in alphabetical order."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def write_reports(df: DataFrame, path: str, key: str = "item_id") -> None:
    """One JSON line for each item, under a folder of its key."""
    df.select(key, canonical(*[c for c in df.columns if c != key]).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def write_lines(df: DataFrame, path: str, keys: list[str], shards: int = 256) -> None:
    """JSON lines with their keys inside, in `shards` files dealt by a hash of the keys and sorted by them: for more items or traces than a file system takes files."""
    df.repartition(shards, *keys).sortWithinPartitions(*keys).write.mode("overwrite").json(path)


def append_labels(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def carried(new: DataFrame, prior: DataFrame, key: str, block: str) -> DataFrame:
    """new, with the prior block where the new one is NULL, and carried_forward."""
    old = prior.select(key, F.col(block).alias("prior"))
    return new.join(old, key, "left").withColumn("carried_forward", F.col(block).isNull() & F.col("prior").isNotNull()).withColumn(block, F.coalesce(block, "prior")).drop("prior")


def frame() -> Column:
    """An event-stream frame of a run event's seq, stage, status and detail."""
    return F.concat(F.lit("event: progress\ndata: "), F.to_json(F.struct("seq", "stage", "status", "detail")), F.lit("\n\n"))


def server_events(df: DataFrame) -> DataFrame:
    """Event-stream frames of run events."""
    return df.select(frame().alias("value"))


def write_spans(df: DataFrame, path: str) -> None:
    """item_id, strategy, spans (an array): a folder for each trace with one enveloped tree."""
    df.select("item_id", "strategy", F.to_json(F.struct(F.col("spans").alias("resourceSpans"))).alias("value")).write.mode("overwrite").partitionBy("item_id", "strategy").text(path)


def record(responses: DataFrame, path: str) -> None:
    """Recorded responses (name, digest, payload), appended."""
    responses.select("name", "digest", "payload").write.mode("append").json(path)


def manifest(responses: DataFrame, analysis: list[str]) -> DataFrame:
    """How many recorded responses are analyses (by the first part of their name) and how many generations."""
    kind = F.when(F.split_part("name", F.lit("."), F.lit(1)).isin(analysis), "analysis").otherwise("generation")
    return responses.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def write_arrays(docs: DataFrame, path: str, files: int, value: str = "value") -> None:
    """JSON documents (one a row), as arrays in so many files at most: for readers of whole documents, where one file for each would be too many."""
    parts = docs.where(F.col(value).isNotNull()).groupBy(F.pmod(F.xxhash64(value), F.lit(files)).alias("part")).agg(F.sort_array(F.collect_list(value)).alias("all"))
    parts.select("part", F.concat(F.lit("["), F.array_join("all", ","), F.lit("]")).alias("value")).write.mode("overwrite").partitionBy("part").text(path)
