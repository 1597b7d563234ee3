"""Ordered picks: deduplication, running values, caps, samples. Every order is explicit, ties included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def newest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial aggregation before the shuffle, no sort of a group."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")


def ordinals(df: DataFrame, keys: list[str], order: list[str], name: str = "ordinal") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1)


def offsets(df: DataFrame, keys: list[str], order: list[str], text: str, gap: int = 2) -> DataFrame:
    """start: where each text begins in its group's texts joined by `gap` characters; empty texts take no room."""
    size = F.when(F.coalesce(F.length(text), F.lit(0)) > 0, F.length(text) + gap).otherwise(0)
    before = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("start", F.coalesce(F.sum(size).over(before), F.lit(0)))


def chunks(df: DataFrame, size: int, ordinal: str = "ordinal") -> DataFrame:
    if size < 1:
        raise ValueError("a chunk holds one step at least")
    return df.withColumn("chunk", F.floor(F.col(ordinal) / size).cast("int"))


def running(df: DataFrame, keys: list[str], order: list[str], text: str, size: int, gap: str = "\n\n") -> tuple[DataFrame, DataFrame]:
    """What comes before each chunk of `size` texts, by reference: (wholes, parts).

    wholes: keys and whole, the group's texts joined by `gap`, once for each group. parts: a row for each chunk, with keys, chunk, n, start and stop
    (of its own texts in whole, in characters); what precedes it is whole up to start. So the bytes are those of the texts, however many chunks there are.
    NULL and empty texts take no room.
    """
    marked = chunks(ordinals(offsets(df, keys, order, text, len(gap)), keys, order), size)
    wholes = marked.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.length(text) > 0, F.struct("ordinal", F.col(text).alias("t"))))), lambda x: x["t"]), gap).alias("whole"))
    parts = marked.groupBy(*keys, "chunk").agg(F.count("*").alias("n"), F.min("start").alias("start"), F.max(F.when(F.length(text) > 0, F.col("start") + F.length(text))).alias("stop"))
    return wholes, parts.withColumn("stop", F.coalesce("stop", "start"))


def preceding(parts: DataFrame, wholes: DataFrame, keys: list[str], gap: str = "\n\n") -> DataFrame:
    """parts with preceding: the texts before each chunk, spelled out. For chunks that are rendered now; of all chunks of a group it is quadratic in its length."""
    text = F.when(F.col("start") > 0, F.substring("whole", 1, F.greatest(F.col("start") - len(gap), F.lit(0)).cast("int"))).otherwise("")
    return with_totals(parts, wholes, keys).withColumn("preceding", text).drop("whole")


def with_totals(df: DataFrame, totals: DataFrame, keys: list[str]) -> DataFrame:
    """df with the columns of totals (a row a key); NULL keys meet."""
    other = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in totals.columns if c not in keys])
    return df.join(other, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*[f"_{k}" for k in keys])


def capped(df: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    """The first `most` rows of each key, with n (all of them) and whether the cap took any.

    Ranks alone are a limit of each group, which Spark applies before the shuffle as well; counts are summed apart. A busy key is never in one task.
    """
    top = df.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)
    return with_totals(top, df.groupBy(*keys).agg(F.count("*").alias("n")), keys).withColumn("capped", F.col("n") > most)


def two_first(df: DataFrame, keys: list[str], who: str, value: str) -> DataFrame:
    """keys, first, second, and their values: the two alphabetically first voters of each key; keys with one voter go."""
    votes = df.groupBy(*keys, who).agg(F.min(value).alias("v"))
    pair = votes.groupBy(*keys).agg(F.slice(F.sort_array(F.collect_list(F.struct(who, "v"))), 1, 2).alias("p")).where(F.size("p") == 2)
    return pair.select(*keys, F.col("p")[0][who].alias("first"), F.col("p")[1][who].alias("second"), F.col("p")[0]["v"].alias("first_value"), F.col("p")[1]["v"].alias("second_value"))


def shuffled(seed: int, *keys: Column) -> Column:
    """A seeded order that any engine can reproduce: MD5 of seed and keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """n rows in seeded order (a sample is the feature here), with their place in the draw."""
    drawn = df.withColumn("draw", shuffled(seed, *map(F.col, keys))).orderBy("draw", *keys).limit(n)
    return drawn.withColumn("pos", F.row_number().over(W.orderBy("draw", *keys)) - 1)


def stratified(df: DataFrame, stratum: str, n: int, seed: int, *keys: str) -> DataFrame:
    """At most n rows of each stratum, in seeded order."""
    return df.withColumn("draw", shuffled(seed, *map(F.col, keys))).withColumn("rank", F.row_number().over(W.partitionBy(stratum).orderBy("draw", *keys))).where(F.col("rank") <= n)


def diverse(df: DataFrame, tag: str, order: list, n: int) -> DataFrame:
    """n rows: first the best of each tag, in order, then the rest by order. Both passes are top-n, so neither sorts all rows in one place."""
    best = df.withColumn("tag_rank", F.row_number().over(W.partitionBy(tag).orderBy(*order)))
    # A tag's rows after its n-th can never be taken.
    return best.where(F.col("tag_rank") <= n).orderBy(F.when(F.col("tag_rank") == 1, 0).otherwise(1), *order).limit(n)


def interleaved(calls: DataFrame, tools: DataFrame, keys: list[str]) -> DataFrame:
    """Calls and tools in order of (seq, kind), 'llm' before 'tool'."""
    both = calls.withColumn("kind", F.lit("llm")).unionByName(tools.withColumn("kind", F.lit("tool")), allowMissingColumns=True)
    return ordinals(both, keys, ["seq", "kind"], "place")
