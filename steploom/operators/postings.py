"""Posting lists: the ids of each tag in blocks of bounded size, so that no group holds a tag, however many rows have it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .layout import in_order


def before(summary: list[tuple]) -> list[tuple]:
    """part, carry: how many ids of a part's first tag stand in the parts before it. summary: part, first tag, last tag, ids of the last tag, tags; in order."""
    out, tag, n = [], None, 0
    for part, first, last, size, tags in summary:
        goes_on = bool(out) and first == tag
        out.append((part, n if goes_on else 0))
        tag, n = last, size + (n if goes_on and tags == 1 else 0)
    return out


def posted(df: DataFrame, tag: str, id_: str, size: int = 4096, partitions: int | None = None) -> DataFrame:
    """tag, block, first, n, deltas: the different ids of each tag in ascending order, `size` to a block; block k begins at place k * size of its tag.

    deltas are the differences from id to id in a block, the first 0. All pairs are sorted once by ranges of (tag, id), which cut a frequent tag
    wherever they need to. A NULL tag is a tag; NULL ids are left out. Ids are whole numbers.
    """
    pairs = df.where(F.col(id_).isNotNull()).select(F.col(tag).alias("tag"), F.col(id_).cast("long").alias("id")).distinct()
    rows = in_order(pairs, [F.col("tag").asc_nulls_first(), F.col("id")], partitions)
    runs = rows.groupBy("part", "tag").agg(F.count("*").alias("n"), F.min("at").alias("from"))
    ends = runs.groupBy("part").agg(F.min_by(F.struct("tag"), "from").alias("first"), F.max_by(F.struct("tag", "n"), "from").alias("last"), F.count("*").alias("tags"))
    # A row for each part.
    summary = sorted((r["part"], r["first"]["tag"], r["last"]["tag"], r["last"]["n"], r["tags"]) for r in ends.collect())
    carried = df.sparkSession.createDataFrame([(p, first, n) for (p, n), (_, first, *_) in zip(before(summary), summary)], f"part long, first {pairs.schema['tag'].dataType.simpleString()}, carry long")
    within = F.row_number().over(W.partitionBy("part", "tag").orderBy("at")) - 1
    placed = rows.withColumn("within", within).join(F.broadcast(carried), "part")
    place = F.col("within") + F.when(F.col("tag").eqNullSafe(F.col("first")), F.col("carry")).otherwise(0)
    blocks = placed.select("tag", F.floor(place / size).alias("block"), "id").groupBy("tag", "block").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    deltas = F.transform("ids", lambda x, i: F.when(i == 0, 0).otherwise(x - F.element_at("ids", F.greatest(i, F.lit(1)))))
    return blocks.select("tag", "block", F.element_at("ids", 1).alias("first"), F.size("ids").alias("n"), deltas.alias("deltas"))


def listed(blocks: DataFrame) -> DataFrame:
    """tag, block, ids: the ids of each block."""
    sums = F.aggregate("deltas", F.array().cast("array<bigint>"), lambda s, d: F.array_append(s, F.coalesce(F.try_element_at(s, F.lit(-1)), F.col("first")) + d))
    return blocks.select("tag", "block", sums.alias("ids"))


def looked_up(blocks: DataFrame, tags: list, frm: int | None = None, to: int | None = None) -> DataFrame:
    """tag, id of some tags, between two ids: only blocks that can hold such ids are opened."""
    some = blocks.where(F.col("tag").isin(tags))
    if to is not None:
        some = some.where(F.col("first") <= to)
    out = listed(some).select("tag", F.explode("ids").alias("id"))
    return out.where(F.col("id").between(-(1 << 63) if frm is None else frm, (1 << 63) - 1 if to is None else to))
