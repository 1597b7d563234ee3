"""Operator 7: fingerprints by a threshold-scaled sketch.

A text's shingles are its runs of SHINGLE code points; every shingle hash below a fixed FRACTION of the hash space is kept.
The threshold is the same for all texts, so sketches of any lengths can be compared, and the sketch of a union is the
union of sketches: it gives containment between very unequal documents as well as likeness. A text shorter than
a shingle is one shingle and is always kept. A fingerprint is the kept 48-bit hashes in ascending order, 12 hex digits each.

Likeness is the Jaccard index of two sketches; two empty sketches are alike (1) only if their texts are equal, else 0.

Defined cases: a null text counts as empty; rows are in order of doc_id, descending, nulls last, equal doc_ids by text;
one row alone is its own next document; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

from .common import column, record_batch, rolled, shuffle_partitions, slices

SHINGLE, FRACTION = 8, 1 / 32
FIRST = -(1 << 63)


def sketch(text: str, fraction: float = FRACTION) -> np.ndarray:
    """The kept hashes in ascending order."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(codes) < SHINGLE:
        return rolled(codes + np.uint64(1), len(codes)) >> np.uint64(16) if len(codes) else np.zeros(0, np.uint64)
    h = rolled(codes, SHINGLE) >> np.uint64(16)
    return np.unique(h[h < np.uint64(int(fraction * (1 << 48)))])


def fingerprint(s: np.ndarray) -> str:
    return s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex() if len(s) else ""


def parse(text: str) -> np.ndarray:
    return np.array([int(text[i : i + 12], 16) for i in range(0, len(text), 12)], np.uint64)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.union1d(a, b)


def common(a: np.ndarray, b: np.ndarray) -> int:
    if not len(a) or not len(b):
        return 0
    both = np.sort(np.concatenate([a, b]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def likeness(a: np.ndarray, b: np.ndarray, equal: bool = False) -> float:
    n = common(a, b)
    return n / (len(a) + len(b) - n) if len(a) or len(b) else float(equal)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """The share of a that is in b."""
    return common(a, b) / len(a) if len(a) else 0.0


def edited(text: str, following: str) -> str:
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("kept_by_edited", pa.float64()),
])
OUT_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, kept_by_edited double"


def in_ranges(docs: DataFrame) -> DataFrame:
    """Rows dealt in ranges of doc_id, each with its neighbour's first row behind it as a ghost; sorted by doc_id, descending."""
    spark = docs.sparkSession
    n = shuffle_partitions(spark)
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(FIRST)).alias("key"), "text")
    cuts = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"]
    if not cuts:
        return rows.select("doc_id", "key", "text", F.lit(0).alias("part"), F.lit(False).alias("ghost"))
    # A search by halves in the cuts. Ranges are of doc_ids as doubles, in which their order is kept (neighbours may be equal, and then share a range).
    ranges = Bucketizer(splits=[-math.inf, *sorted({float(c) for c in cuts}), math.inf], inputCol="at", outputCol="range")
    rows = ranges.transform(rows.withColumn("at", F.col("key").cast("double"))).withColumn("part", F.col("range").cast("int")).drop("at", "range")
    # One row for each range: its largest doc_id, whose document follows the last of the range above.
    heads = sorted((r["part"], r["k"]) for r in rows.groupBy("part").agg(F.max("key").alias("k")).collect())
    above = spark.createDataFrame([(k, heads[(i + 1) % len(heads)][0]) for i, (_, k) in enumerate(heads)], "key long, above int")
    ghosts = rows.join(F.broadcast(above), "key").select("doc_id", "key", "text", F.col("above").alias("part"), F.lit(True).alias("ghost"))
    # There are n ranges at most, so each is a partition of its own.
    return rows.withColumn("ghost", F.lit(False)).unionByName(ghosts).repartitionById(n, "part").sortWithinPartitions("part", "ghost", F.col("key").desc(), "text")


def fingerprinted(docs: DataFrame) -> DataFrame:
    def run(batches):
        held = None

        def row(part, doc, text, s, after, next_s):
            new = edited(text, after)
            e = sketch(new)
            return (doc, len(text), hashlib.sha256(new.encode()).hexdigest(), fingerprint(s), fingerprint(e), likeness(s, e, text == new), likeness(s, next_s, text == after), containment(s, e))

        for batch in batches:
            for some in slices(batch, "text", 4_000_000):
                out = []
                for part, ghost, doc, text in zip(column(some, "part"), column(some, "ghost"), column(some, "doc_id"), column(some, "text")):
                    text = text or ""
                    if held is None and ghost:
                        continue
                    s = sketch(text)
                    if held is not None:
                        out.append(row(*held, text, s))
                    held = None if ghost else (part, doc, text, s)
                if out:
                    yield record_batch(OUT, *zip(*out))

    return in_ranges(docs).select("part", "ghost", "doc_id", "text").mapInArrow(run, OUT_DDL)
