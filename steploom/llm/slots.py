"""Operator 5: sharding by fixed virtual slots (DataFrame functions only).

A record's doc_id is hashed into one of SLOTS virtual slots; bytes and rows are aggregated per slot; a versioned table
maps slots to shards. Rebalancing edits the map, never the hash: a record moves only if its slot does. The first map of n shards
follows from n alone (law `key`): it grows from one shard by giving each new shard an even share of slots, one at a time
from whichever shard has most. Each version has its number of shards, and is in force or a plan (the map with one more shard);
`rebalance` edits the one in force by the bytes of its slots, and stores the next version. `sharded` takes the map in force as it stands.

A record's place in its shard (`slot`, gapless from 0) comes from a count for each (virtual slot, salt) pair, of which
there are SLOTS x SALTS whatever the data, and a number within the pair; no shard is sorted in one task.

Defined cases: a null text has no bytes (size 1, CRC 0); null doc_ids share a virtual slot; equal doc_ids share a shard and
take places by CRC and size; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window as W, functions as F

from .common import shared_dir

SLOTS, SALTS = 4096, 8


def grown(shard_of: list[int], shards: int) -> list[int]:
    """The map with one more shard: it gets an even share of the slots, and no other slot moves."""
    out, held = list(shard_of), [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        held[shard].append(slot)
    for _ in range(len(out) // (shards + 1)):
        most = max(range(shards), key=lambda s: (len(held[s]), -s))
        out[held[most].pop()] = shards
    return out


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The shard of each slot, for a number of shards; it depends on nothing else."""
    out = [0] * slots
    for n in range(1, shards):
        out = grown(out, n)
    return out


def rebalanced(shard_of: list[int], size_of: list[int], shards: int) -> list[int]:
    """Moves the slot that helps most from the heaviest shard to the lightest, until no move narrows their gap; then from the next heaviest."""
    out, load, held = list(shard_of), [0] * shards, [[] for _ in range(shards)]
    for slot, shard in enumerate(out):
        load[shard] += size_of[slot]
        if size_of[slot]:
            held[shard].append(slot)
    giving = set(range(shards))
    while giving:
        high, low = max(giving, key=load.__getitem__), min(range(shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fit = [s for s in held[high] if size_of[s] < gap]
        if not fit:
            giving.remove(high)  # the lightest only grows, so this one can give nothing later either
            continue
        s = min(fit, key=lambda s: abs(gap - 2 * size_of[s]))
        out[s] = low
        held[high].remove(s)
        held[low].append(s)
        load[high] -= size_of[s]
        load[low] += size_of[s]
    return out


MAPS = "vslot int, shard int, n_shards int, in_force boolean, version int"


def map_frame(spark, version: int, shard_of: list[int], n_shards: int | None = None, in_force: bool = True) -> DataFrame:
    """version, vslot, shard, n_shards, in_force: one version of a map."""
    n = n_shards or max(shard_of) + 1
    return spark.createDataFrame([(i, s, n, in_force, version) for i, s in enumerate(shard_of)], MAPS)


def store_map(frame: DataFrame, path: str) -> None:
    """Adds one version of a map to a table of maps. A version is written once: a second writer of the same one gets an error."""
    version = frame.select("version").distinct().collect()
    if len(version) != 1:
        raise ValueError("a map has one version")
    frame.drop("version").coalesce(1).write.parquet(f"{path}/version={version[0][0]}")


def stored_maps(spark, path: str) -> DataFrame:
    """All versions: version, vslot, shard, n_shards, in_force."""
    return spark.read.schema(MAPS).parquet(path)


def versions(spark, path: str) -> list[tuple[int, int, bool]]:
    """version, n_shards, in_force of what is stored, in order; none where there is no table yet."""
    try:
        return [tuple(r) for r in stored_maps(spark, path).select("version", "n_shards", "in_force").distinct().orderBy("version").collect()]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def shards_of(spark, path: str, version: int) -> list[int]:
    """The shard of each virtual slot under a stored version."""
    return [r["shard"] for r in stored_maps(spark, path).where(F.col("version") == version).orderBy("vslot").collect()]


def latest(spark, path: str) -> tuple[int, list[int]]:
    """The map in force: the last version that is more than a plan, and its shard of each virtual slot."""
    some = [v for v, _, in_force in versions(spark, path) if in_force]
    if not some:
        raise ValueError(f"no map in {path}")
    return some[-1], shards_of(spark, path, some[-1])


def rebalance(docs: DataFrame, path: str, shards: int | None = None) -> int:
    """Edits the map in force by the bytes that its slots hold now, and stores it as the next version, in force from then on, whose number it returns.

    With `shards` above the map's number of shards, the new ones start empty and are filled by the edit. If no move helps, nothing is stored.
    """
    spark = docs.sparkSession
    version, now = latest(spark, path)
    n = max(shards or 0, next(n for v, n, _ in versions(spark, path) if v == version))
    # A row for each virtual slot, whatever the input.
    held = {r["vslot"]: r["n_bytes"] for r in slot_bytes(docs, len(now)).collect()}
    new = rebalanced(now, [held.get(i, 0) for i in range(len(now))], n)
    if new == now:
        return version
    following = versions(spark, path)[-1][0] + 1
    store_map(map_frame(spark, following, new, n), path)
    return following


def assigned(docs: DataFrame, path: str, version: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot and shard of every row under a stored version (the last, if none is named)."""
    spark = docs.sparkSession
    last, now = latest(spark, path)
    of = stored_maps(spark, path).where(F.col("version") == F.lit(last if version is None else version)).select("vslot", "shard")
    return sized(docs, len(now)).join(F.broadcast(of), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard")


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int").alias("vslot"),
    )


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """vslot, n_rows, n_bytes: a row for each slot that has records."""
    return sized(docs, slots).groupBy("vslot").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))


def in_force(spark, path: str, shards: int, slots: int = SLOTS) -> tuple[int, int]:
    """The versions of the map in force and of the plan with one more shard; what is not stored yet is stored.

    The first map follows from the number of shards. Any later one is what `rebalance` made of it, and is taken as it stands.
    """
    known = versions(spark, path)
    if not any(force for _, _, force in known):
        store_map(map_frame(spark, len(known) + 1, slot_map(shards, slots), shards), path)
        known = versions(spark, path)
    version, now = latest(spark, path)
    n = next(n for v, n, _ in known if v == version)
    if n != shards:
        raise ValueError(f"the map in force has {n} shards, not {shards}: rebalance it first")
    plan = grown(now, n)
    for v, m, force in known:
        if not force and m == n + 1 and shards_of(spark, path, v) == plan:
            return version, v
    store_map(map_frame(spark, known[-1][0] + 1, plan, n + 1, False), path)
    return version, known[-1][0] + 1


def sharded(docs: DataFrame, shards: int = 16, slots: int = SLOTS, map_path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, and the bytes of the virtual slot.

    Without a stored map, or with its first, the law is `key`: doc_id and the number of shards decide. A rebalanced map holds law `bytes` as nearly as
    whole slots allow; its rows say `map`.
    """
    spark = docs.sparkSession
    if map_path:
        v, more = in_force(spark, map_path, shards, slots)
        every = stored_maps(spark, map_path)
        law = "key" if shards_of(spark, map_path, v) == slot_map(shards, slots) else "map"
    else:
        v, more, law = 1, 2, "key"
        now = slot_map(shards, slots)
        every = map_frame(spark, v, now, shards).unionByName(map_frame(spark, more, grown(now, shards), shards + 1, False))
    of = lambda n, name: every.where(F.col("version") == n).select("vslot", F.col("shard").alias(name))
    maps = of(v, "shard").join(of(more, "grown_shard"), "vslot")

    rows = sized(docs, slots).withColumn("salt", F.pmod(F.xxhash64("text_crc32", "doc_id", F.lit("salt")), F.lit(SALTS)).cast("int"))
    counts = rows.groupBy("vslot", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    by_shard = W.partitionBy("shard").orderBy("vslot", "salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counts.join(F.broadcast(maps), "vslot")
        .withColumn("before", F.coalesce(F.sum("n").over(by_shard), F.lit(0)))
        .withColumn("slot_bytes", F.sum("b").over(W.partitionBy("shard", "vslot")))
        .drop("n", "b")
    )
    number = F.row_number().over(W.partitionBy("vslot", "salt").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size"))
    # The broadcast table has SLOTS x SALTS rows at most, whatever the input.
    return (
        rows.withColumn("number", number)
        .join(F.broadcast(offsets), ["vslot", "salt"])
        .select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), "grown_shard", "vslot", "slot_bytes")
    )


def map_folder(spark) -> str:
    import uuid

    return f"{shared_dir(spark)}/slot-map-{uuid.uuid4().hex}"
