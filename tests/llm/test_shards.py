"""Shards, places and maps against a computation row by row."""

import random
import struct
import zlib

import pytest
import xxhash

from steploom.llm import slots


def h64(*values, seed=42):
    for v in values:
        if v is not None:
            seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed if seed < 1 << 63 else seed - (1 << 64)


def rows(n, seed=1):
    rng = random.Random(seed)
    out = [(rng.choice([i, i, i, 5, None]), rng.choice([None, "", "é" * rng.randint(0, 30), "same text"])) for i in range(n)]
    return out + [(77_000, "long " * 20_000)]


def brute(data, shards):
    m = slots.slot_map(shards)
    wider, out = slots.grown(m, shards), []
    for doc, text in data:
        raw = (text or "").encode()
        crc, v = zlib.crc32(raw), h64(doc) % slots.SLOTS
        out.append((m[v], v, h64(crc, doc, "salt") % slots.SALTS, doc is not None, doc or 0, crc, len(raw) + 1, wider[v], doc))
    at, want = {}, []
    for shard, v, salt, _, _, crc, size, more, doc in sorted(out, key=lambda r: r[:7]):
        want.append((str(doc), size, crc, shard, at.setdefault(shard, 0), more))
        at[shard] += 1
    return want


def test_shards_equal_brute_force(spark):
    data = rows(600)
    docs = spark.createDataFrame([(*r, 1, 2) for r in data], "doc_id long, text string, shard int, slot int").repartition(3)
    path = slots.map_folder(spark)
    got = slots.sharded(docs, 16, map_path=path).collect()
    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot, r.grown_shard) for r in got) == sorted(brute(data, 16))
    assert all(r.law == "key" and r.grown_shard in (r.shard, 16) for r in got)
    assert slots.versions(spark, path) == [(1, 16, True), (2, 17, False)] and slots.latest(spark, path) == (1, slots.slot_map(16))
    assert slots.shards_of(spark, path, 2) == slots.grown(slots.slot_map(16), 16)


def test_rebalancing_reads_edits_and_stores(spark):
    data = rows(500, 3) + [(9, "x" * 3000)] * 40
    docs = spark.createDataFrame(data, "doc_id long, text string")
    path = slots.map_folder(spark)
    slots.store_map(slots.map_frame(spark, 1, slots.slot_map(4)), path)
    load = lambda: [sum(r.size for r in slots.assigned(docs, path).collect() if r.shard == k) for k in range(6)]
    before = load()
    assert slots.rebalance(docs, path) == 2
    after = load()
    assert sum(after) == sum(before) and max(after[:4]) - min(after[:4]) < max(before[:4]) - min(before[:4])
    held = {r.vslot: r.n_bytes for r in slots.slot_bytes(docs).collect()}
    old, new = slots.slot_map(4), slots.latest(spark, path)[1]
    assert new == slots.rebalanced(old, [held.get(i, 0) for i in range(slots.SLOTS)], 4) != old
    assert slots.rebalance(docs, path) == 2  # no move helps any more
    assert slots.rebalance(docs, path, 6) == 3 and min(load()) > 0
    moved = {r.doc_id for r in slots.assigned(docs, path, 2).collect()}  # an older version can still be read
    assert moved == {d for d, _ in data}
    with pytest.raises(Exception):
        slots.store_map(slots.map_frame(spark, 3, old), path)
    empty = docs.where("false")
    assert slots.assigned(empty, path).count() == 0 and slots.rebalance(empty, path) == 3


def test_shards_by_a_map_that_was_rebalanced(spark):
    """Sharded, rebalanced, sharded again, grown by a shard and sharded again, on one folder; what is stored is read back and not made anew."""
    data = rows(400, 7) + [(9, "x" * 3000)] * 40
    docs, path = spark.createDataFrame(data, "doc_id long, text string"), slots.map_folder(spark)

    def placed(n):
        got = slots.sharded(docs, n, map_path=path).collect()
        of, at = {}, {}
        for r in got:
            of[r.vslot] = r.shard
            at.setdefault(r.shard, []).append(r.slot)
            assert r.grown_shard in (r.shard, n)
        assert all(sorted(x) == list(range(len(x))) for x in at.values())
        load = [sum(r.size for r in got if r.shard == k) for k in range(n)]
        return of, load, {r.law for r in got}

    first, load, law = placed(4)
    assert law == {"key"} and slots.versions(spark, path) == [(1, 4, True), (2, 5, False)]
    assert placed(4) == (first, load, law) and len(slots.versions(spark, path)) == 2
    assert slots.rebalance(docs, path) == 3
    second, even, law = placed(4)
    assert law == {"map"} and sum(even) == sum(load) and max(even) - min(even) < max(load) - min(load)
    held = {r.vslot: r.n_bytes for r in slots.slot_bytes(docs).collect()}
    want = slots.rebalanced(slots.slot_map(4), [held.get(i, 0) for i in range(slots.SLOTS)], 4)
    assert all(want[v] == s for v, s in second.items())
    assert slots.versions(spark, path) == [(1, 4, True), (2, 5, False), (3, 4, True), (4, 5, False)]
    with pytest.raises(ValueError, match="rebalance it first"):
        slots.sharded(docs, 5, map_path=path)
    assert slots.rebalance(docs, path, 5) == 5
    third, wider, _ = placed(5)
    assert min(wider) > 0 and all(third[v] in (s, 4) or max(even) > 0 for v, s in second.items())
    assert slots.versions(spark, path)[4:] == [(5, 5, True), (6, 6, False)]
