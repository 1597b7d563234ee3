"""Helpers shared by the training-data operators."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.layout import shared_dir, spread, stored  # noqa: F401  the operators take them from here


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, a partition for each core at least, for operators that work on each text where it lies."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written to its end: the mark that a job leaves last is there."""
    try:
        spark.read.text(f"{path}/_SUCCESS").schema
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out() -> F.Column:
    """True for rows whose crc32(doc_id as text) mod 3 is 1; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def slices(batch: pa.RecordBatch, name: str, most: int = 8_000_000):
    """Consecutive slices of a batch with about `most` bytes of column `name`; one long row may exceed it."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0)) if len(col) else np.zeros(0)
    at, total = 0, 0
    for i, n in enumerate(sizes):
        total += n
        if total >= most:
            yield batch.slice(at, i + 1 - at)
            at, total = i + 1, 0
    if at < len(sizes):
        yield batch.slice(at)


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash; the most frequent words come early, so a full table stays as it is."""

    most = 300_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < self.most:
            self[word] = h
        return h


_WORDS = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


class WordPairs(dict):
    """Word (bytes) -> 16 bytes, two hashes of 64 bits."""

    most = 200_000

    def __missing__(self, word: bytes) -> bytes:
        h = xxhash.xxh3_128_digest(word)
        if len(self) < self.most:
            self[word] = h
        return h


_PAIRS = WordPairs()


def word_pairs(texts: list[list[bytes]]) -> np.ndarray:
    """Two hashes of each word of all texts in turn."""
    return np.frombuffer(b"".join(map(_PAIRS.__getitem__, chain.from_iterable(texts))), np.uint64).reshape(-1, 2)


def integers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A column of 64-bit integers without nulls."""
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolled(h: np.ndarray, k: int, seed: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hash of every k consecutive elements of h (empty if fewer than k)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(seed | 1) + h[i : i + n]
        out ^= out >> np.uint64(29)
    return mixed(out)
