"""Operator 8: n-gram Jaccard join with Bayesian candidate pruning.

A document is the set of its SHINGLE-word shingles (words lie between ASCII white space, unchanged); two documents are linked if
the Jaccard index of their sets is THRESHOLD or more.

1. Each document gets a MinHash signature; documents with equal sets (by 96 bits of hash) become one node with a count.
2. Nodes that agree on a band of BAND values are candidates: at an index of 0.8 a pair misses all BANDS bands with a probability of 7e-6.
3. Candidate pairs are compared a few MinHash values at a time, and dropped as soon as the posterior probability (uniform
   prior) of reaching the threshold falls below TOLERANCE. A pair is taken up in its first common band only.
4. What is left is verified exactly on the sets of shingle hashes.
5. Links are summed per node, and classes are the connected components of links, by label propagation with pointer jumping.

Large buckets are cut into blocks of about TILE nodes, and each two blocks are a task's tile; a tile keeps its pairs as packed
numbers and returns a row for each node (links, and a root in the tile), so no list of pairs is shuffled or expanded. Pairs go to the
verification in rows, and rows in groups, whose sets have a bounded number of bytes, so long texts need no more memory than short ones.

Defined cases: a null or empty text is the empty sequence of words; a text of fewer than SHINGLE words has one shingle, all its words,
so equal short texts are linked and others are not; equal doc_ids are rows of their own; null doc_ids count as the largest.
"""

from __future__ import annotations

import math
import re
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, integers, mixed, record_batch, rolled, shuffle_partitions, shared_dir, slices, stored, word_hashes
from .rlz import BLOCK, LAST, repeated_keys

SHINGLE, THRESHOLD = 5, 0.8
BANDS, BAND, TOLERANCE, STEP = 30, 5, 1e-7, 30
VALUES = BANDS * BAND
TILE = 512
#: Keys, of 16 bytes each, that are sent to all tasks at most.
SENT = 100_000
#: Bytes of shingle sets that a row of candidate pairs needs at most (unless one pair needs more), and a group of such rows about.
ROOM, GROUP = 12_000_000, 6_000_000

_rng = np.random.default_rng(20)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The set of shingle hashes, in ascending order."""
    h = word_hashes((text or b"").split())
    if len(h) < SHINGLE:
        return mixed(rolled(h, len(h)) if len(h) else np.zeros(1, np.uint64))
    return np.unique(rolled(h, SHINGLE))


def signature(s: np.ndarray) -> np.ndarray:
    out = np.full(VALUES, (1 << 64) - 1, np.uint64)
    for i in range(0, len(s), 2048):
        np.minimum(out, (s[i : i + 2048, None] * _A + _B).min(axis=0), out)
    return (mixed(out) & np.uint64(0xFFFF)).astype(np.uint16)


def node_of(s: np.ndarray) -> int:
    """A 64-bit name for a set."""
    return int(mixed(np.array([mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0].view(np.int64))


def band_keys(sigs: np.ndarray) -> np.ndarray:
    """(rows, BANDS) keys of (rows, VALUES) signatures."""
    v = sigs.reshape(len(sigs), BANDS, BAND).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), v.shape[:2]).copy()
    for i in range(BAND):
        out = out * np.uint64(0x100000001B3) + v[:, :, i]
        out ^= out >> np.uint64(31)
    return mixed(out)


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> int:
    """The fewest matches among n values that leave a posterior probability of `tolerance` or more: under a uniform prior, P(index >= t) = P(Binomial(n + 1, t) <= matches)."""
    total = 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def pruned(sigs: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (a, b) are left after all values are compared."""
    left, same = np.arange(len(a)), np.zeros(len(a), np.int32)
    for i in range(0, VALUES, STEP):
        same += (sigs[a[left], i : i + STEP] == sigs[b[left], i : i + STEP]).sum(axis=1)
        keep = same >= least_matches(i + STEP, threshold)
        left, same = left[keep], same[keep]
    return left


def check_of(s: np.ndarray) -> int:
    """32 bits more, which tell apart sets of one name."""
    return int(np.bitwise_xor.reduce(mixed(s + np.uint64(0x5851F42D4C957F2D))) >> np.uint64(32))


SIGNED = pa.schema([("doc_id", pa.int64()), ("said", pa.int64()), ("node", pa.int64()), ("check", pa.int64()), ("size", pa.int64()), ("sig", pa.binary())])


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, said (the text's hash), node, check, size (of the set) and sig of every document."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = [shingles(t) for t in column(part, "text")]
                yield record_batch(SIGNED, column(part, "doc_id"), column(part, "said"), [node_of(s) for s in sets], [check_of(s) for s in sets], [len(s) for s in sets], [signature(s).tobytes() for s in sets])

    return texts_of(docs).mapInArrow(run, "doc_id long, said long, node long, check long, size long, sig binary")


def told_apart(df: DataFrame, clashes: DataFrame) -> DataFrame:
    """df (node, check, ...) with new names for the nodes that several sets share."""
    other = df.join(clashes.withColumn("clash", F.lit(True)), "node", "left")
    return other.withColumn("node", F.when(F.col("clash"), F.xxhash64("node", "check")).otherwise(F.col("node"))).select(*df.columns)


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, text (bytes), said (its hash)."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("said"))


def _unions(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index in each element's component."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _candidates(pdf: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of a group of buckets or tiles: vid, nodes and packed pairs that survive pruning."""
    pdf = pdf.sort_values(["key", "doc_id"], kind="stable")
    sigs = np.frombuffer(b"".join(pdf["sig"]), np.uint16).reshape(-1, VALUES)
    bands, keys, nodes = band_keys(sigs), pdf["key"].to_numpy().view(np.uint64), pdf["doc_id"].to_numpy()
    band = (bands == keys[:, None]).argmax(axis=1)
    block, i, j, size = (pdf[c].to_numpy() for c in ("block", "i", "j", "size"))
    at = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    out, held, n = [], [], 0

    def flush():
        nonlocal held, n
        if not held:
            return
        a, b = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        first = np.empty(len(a), np.int64)
        for k in range(0, len(a), 200_000):
            first[k : k + 200_000] = (bands[a[k : k + 200_000]] == bands[b[k : k + 200_000]]).argmax(axis=1)
        ok = first == band[a]
        a, b = a[ok], b[ok]
        left = np.concatenate([k + pruned(sigs, a[k : k + 200_000], b[k : k + 200_000], threshold) for k in range(0, len(a), 200_000)]) if len(a) else np.zeros(0, np.int64)
        a, b = a[left], b[left]
        cuts = np.flatnonzero(np.diff(keys[a], prepend=~keys[a[:1]]) != 0) if len(a) else []
        for x, y in zip(cuts, [*cuts[1:], len(a)]):
            for n_part, (c, d) in enumerate(fitting(a[x:y], b[x:y], size)):
                used, back = np.unique(np.concatenate([c, d]), return_inverse=True)
                pairs = back.astype(np.uint16).reshape(2, -1)
                out.append((int(mixed(keys[a[x : x + 1]] + np.uint64(i[a[x]] * 65599 + j[a[x]] + 7 + n_part * 7919))[0].view(np.int64)), nodes[used].tolist(), pairs.tobytes(), 8 * int(size[used].sum())))
        held, n = [], 0

    for x, y in zip(at, [*at[1:], len(keys)]):
        if i[x] != j[x]:
            left, right = x + np.flatnonzero(block[x:y] == i[x]), x + np.flatnonzero(block[x:y] == j[x])
            a, b = np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            a, b = (x + t for t in np.triu_indices(y - x, 1))
        held.append((a, b))
        n += len(a)
        if n > 500_000:
            flush()
    flush()
    return pd.DataFrame(out, columns=["vid", "nodes", "pairs", "bytes"])


def fitting(a: np.ndarray, b: np.ndarray, size: np.ndarray):
    """The pairs (a, b) in parts whose nodes' sets fit in ROOM together; size is of each node's set."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        if len(a) == 1 or 8 * size[np.unique(np.concatenate([a, b]))].sum() <= ROOM:
            yield a, b
            continue
        by = a if a.min() < a.max() else b
        low = by < (by.min() + by.max() + 1) // 2
        todo += [(a[low], b[low]), (a[~low], b[~low])]


def _verified(sets: pd.DataFrame, tiles: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Of each tile: node, root, links, by exact Jaccard index."""
    of = {n: np.frombuffer(s, np.uint64) for n, s in zip(sets["node"], sets["set"])}
    many = dict(zip(sets["node"], sets["m"]))
    out = []
    for nodes, packed in zip(tiles["nodes"], tiles["pairs"]):
        a, b = np.frombuffer(packed, np.uint16).reshape(2, -1).astype(np.int64)
        own = [of[n] for n in nodes]
        size = np.array([len(s) for s in own])
        if len(a) > 4 * len(own):
            flat = np.concatenate(own)
            _, word = np.unique(flat, return_inverse=True)
            row, both, width = np.repeat(np.arange(len(own)), size), np.zeros((len(own), len(own))), 8192
            order = np.argsort(word, kind="stable")
            word, row = word[order], row[order]
            for lo in range(0, int(word[-1]) + 1, width):
                x, y = np.searchsorted(word, [lo, lo + width])
                m = np.zeros((len(own), width), np.float32)
                m[row[x:y], word[x:y] - lo] = 1
                both += m @ m.T
            common = both[a, b]
        else:
            common = np.array([len(own[x]) + len(own[y]) - len(np.unique(np.concatenate([own[x], own[y]]))) for x, y in zip(a, b)])
        ok = common >= threshold * (size[a] + size[b] - common) - 1e-9
        a, b = a[ok], b[ok]
        if not len(a):
            continue
        m = np.array([many[n] for n in nodes])
        links = np.bincount(a, m[b], len(own)) + np.bincount(b, m[a], len(own))
        order = np.argsort(nodes, kind="stable")  # so that the root is the least node
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        root = _unions(len(own), rank[a], rank[b])
        out += [(nodes[k], nodes[order[root[rank[k]]]], int(links[k])) for k in np.flatnonzero(links)]
    return pd.DataFrame(out, columns=["node", "root", "links"]).astype("int64")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, label (the least node of its component) of (node, root) edges."""
    both = stored(edges.where("node <> root").select("node", "root").union(edges.where("node <> root").select("root", "node")).distinct(), "edges")
    labels = stored(both.groupBy("node").agg(F.least(F.min("root"), F.first("node")).alias("label")), "labels")
    # Two tables in turn: a round reads one and writes over the other.
    turns = [f"{shared_dir(both.sparkSession)}/labels-{uuid.uuid4().hex}" for _ in range(2)]
    for i in range(rounds):
        # The least label among neighbours, then that label's own label.
        near = both.join(labels.withColumnRenamed("node", "root"), "root").groupBy("node").agg(F.min("label").alias("near"))
        less = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        own = less.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(less.join(own, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels", turns[i % 2])
        labels = new.select("node", "label")
        if new.where("was <> label").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels


def linked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), n_links (other documents at the threshold or above, copies counted) of every row."""
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = stored(signed(docs), "signed")
    sets = rows.groupBy("node", "check").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("rep"), "said")).alias("of"), F.count("*").alias("m"), F.first("sig").alias("sig"), F.first("size").alias("size"))
    nodes = stored(sets.select("node", "check", "of.rep", "of.said", "m", "size", "sig"), "nodes")
    clashes = nodes.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node")
    if not clashes.isEmpty():  # next to never: names have 64 bits
        clashes = stored(clashes, "clashes")
        rows, nodes = stored(told_apart(rows, clashes), "signed"), stored(told_apart(nodes, clashes), "nodes")

    def keys_of(part):
        keys = band_keys(np.frombuffer(b"".join(column(part, "sig")), np.uint16).reshape(-1, VALUES)).ravel()
        zero = np.zeros(len(keys), np.uint64)
        return keys, zero, np.repeat(integers(part, "doc_id"), BANDS), zero.astype(np.int64)

    total = nodes.count()
    shared = stored(repeated_keys(nodes.select(F.col("node").alias("doc_id"), "sig"), keys_of, max(4 * parts, total * BANDS // 200_000), sized="sig", blocks=total * 2 * VALUES // BLOCK + 1).select("doc_id", "key"), "shared")
    # Only keys with more nodes than a tile need their count; they are few, and sent to all tasks where they are.
    large = stored(shared.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE), "large")
    few = large.count() <= SENT
    t = F.coalesce(F.ceil(F.col("n") / TILE).cast("int"), F.lit(1))
    spread = F.lit(max(4 * parts, total // 4000))
    tiles = (
        shared.join(F.broadcast(large) if few else large, "key", "left")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), t).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), t - 1)))
        .select("doc_id", "key", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "n")
        # Small buckets share a task's group; each tile of a large one is a group of its own.
        .withColumn("group", F.when(t == 1, F.pmod("key", spread)).otherwise(F.xxhash64("key", "i", "j")))
        .drop("n")
        .join(nodes.select(F.col("node").alias("doc_id"), "size", "sig"), "doc_id")
    )
    found = stored(tiles.groupBy("group").applyInPandas(lambda pdf: _candidates(pdf, threshold), "vid long, nodes array<long>, pairs binary, bytes long"), "candidates")

    # So many groups that each has about GROUP bytes of sets, however long the texts are.
    spread = F.lit((found.agg(F.sum("bytes")).first()[0] or 0) // GROUP + 4 * parts)
    found = found.drop("bytes").withColumn("group", F.pmod("vid", spread))
    needed = found.select("group", F.explode("nodes").alias("node")).distinct().join(nodes.select("node", "rep", "said", "m"), "node")
    by_text = needed.groupBy("rep", "said", "node", "m").agg(F.collect_set("group").alias("groups"))
    out = pa.schema([("node", pa.int64()), ("m", pa.int64()), ("set", pa.binary()), ("groups", pa.list_(pa.int64()))])

    def sets_of(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                yield record_batch(out, *(column(part, c) for c in ("node", "m")), [shingles(t).tobytes() for t in column(part, "text")], column(part, "groups"))

    # A node's text is found by document and hash, so rows that share an id, or have none, meet only nodes of their own text. Texts without an id
    # are made distinct first: any number of them may be equal.
    texts = texts_of(docs)
    texts = texts.where("doc_id is not null").unionByName(texts.where("doc_id is null").groupBy("said").agg(F.min("text").alias("text")).withColumn("doc_id", F.lit(LAST)))
    sets = texts.withColumnRenamed("doc_id", "rep").join(by_text, ["rep", "said"]).select("node", "m", "groups", "text").mapInArrow(sets_of, "node long, m long, set binary, groups array<long>")
    sets = sets.select("node", "m", "set", F.explode("groups").alias("group"))
    linked = stored(sets.groupBy("group").cogroup(found.groupBy("group")).applyInPandas(lambda s, t: _verified(s, t, threshold), "node long, root long, links long"), "links")

    labels = components(linked)
    links = linked.groupBy("node").agg(F.sum("links").alias("links"))
    named = nodes.select("node", "rep", "m").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    per_node = named.join(classes, "label").join(links, "node", "left").select("node", F.nullif("class_id", F.lit(LAST)).alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"))
    return rows.select("doc_id", "node").join(per_node, "node").select("doc_id", "class_id", "n_links")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns: that of the least doc_id, null last.

    Rows count one by one: repeated rows and null doc_ids are copies as any others. Between rows of one doc_id a hash of all columns decides, then
    the row's place.
    """
    # Written once, so that a row has one key in both reads. The key's name is no other column's.
    key = "row"
    while key in map(str.lower, docs.columns):
        key += "_"
    keyed = stored(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
    classes = linked(keyed.select(F.col(key).alias("doc_id"), "text"), threshold).select(F.col("doc_id").alias(key), "class_id")
    # Spark hashes no maps and no variants; as JSON they can be told apart as well.
    told = [F.to_json(F.struct(f"`{c}`")) if re.search("map<|variant", kind) else F.col(f"`{c}`") for c, kind in docs.dtypes]
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64(*told), key)
    kept = keyed.select(key, order.alias("order")).join(classes, key).groupBy("class_id").agg(F.min("order")[key].alias(key))
    return keyed.join(kept, key, "left_semi").drop(key)
