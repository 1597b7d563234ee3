"""Operator 11: documents drawn like a target, by importance resampling over hashed n-grams.

Each task hands its texts, some megabytes at a time, to a DuckDB connection of its own: SQL takes the words, unnests them, makes
the n-grams with a window and counts them by bucket, through a registered zlib CRC function. The counts of each document, and the
sums of each task, are written as Parquet, once; Spark adds up the sums of all documents and all target texts, and scores each
document by its stored counts. Documents are drawn without replacement by Gumbel noise that follows from seed and doc_id.

Words are runs of 0-9, a-z and code points beyond ASCII, after A-Z are lower-cased; features are all runs of one and two words.
A text longer than PIECE is cut between words and passes piece by piece, the last word of a piece with the next one; a task holds
its text, one piece's n-grams and BUCKETS counts. DuckDB writes nothing to disk.

Defined cases: a null text has no words and weight 0; without target texts every count t is 0, and weights still compare documents by
what is rare in them; equal scores go by doc_id (null last), then by n_features and weight, and what is left is equal rows;
rows with equal doc_ids count one by one and have the same noise; an empty table gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.layout import in_order
from .common import column, record_batch, slices, stored

BUCKETS, SEED, PERCENT, LEAST_WORDS = 10_000, 7, 25, 20
#: Code points of a piece, and bytes of the texts that go to one statement, about.
PIECE, AT_ONCE = 500_000, 500_000
#: Documents whose counts are weighed at once.
WEIGHED = 256

_BETWEEN = re.compile(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

COUNTS = r"""
WITH texts AS (
  SELECT row, before, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM pieces
), words AS (
  SELECT row, unnest(words) AS word, unnest(range(len(words))) AS place FROM texts
), pairs AS (
  SELECT row, word, lead(word) OVER (PARTITION BY row ORDER BY place) AS following FROM words
), grams AS (
  SELECT row, word AS gram, 1 AS words FROM pairs
  UNION ALL SELECT row, word || ' ' || following, 0 FROM pairs WHERE following IS NOT NULL
  UNION ALL SELECT row, before || ' ' || words[1], 0 FROM texts WHERE before IS NOT NULL AND len(words) > 0
)
SELECT row, crc32(gram) % {buckets} AS bucket, CAST(count(*) AS BIGINT) AS n, CAST(sum(words) AS BIGINT) AS n_words FROM grams GROUP BY row, bucket
"""


def crc32(grams: pa.Array) -> pa.Array:
    """zlib's CRC of the UTF-8 bytes of each string."""
    if isinstance(grams, pa.ChunkedArray):
        grams = grams.combine_chunks()
    grams = grams.cast(pa.binary())
    at = np.frombuffer(grams.buffers()[1], np.int32)[grams.offset : grams.offset + len(grams) + 1].tolist()
    data = memoryview(grams.buffers()[2] or b"")
    return pa.array([zlib.crc32(data[a:b]) for a, b in zip(at, at[1:])], pa.uint32())


def connection() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
    con.create_function("crc32", crc32, ["VARCHAR"], "UINTEGER", type="arrow")
    return con


def pieces(text: str, size: int | None = None) -> Iterator[tuple[str, str | None]]:
    """A text's pieces, cut between words, each with the word (lower-cased) before it in the text, if it begins behind a cut."""
    size = size or PIECE
    at, before = 0, None
    while len(text) - at > size:
        cut = _BETWEEN.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()], before
        # The last word that was seen; a piece may have none.
        end = cut.start()
        while end > at and _BETWEEN.match(text[end - 1]):
            end -= 1
        begin = end
        while begin > at and not _BETWEEN.match(text[begin - 1]):
            begin -= 1
        before = _lowered(text[begin:end]) if begin < end else before
        at = cut.start()
    yield text[at:], before


def _lowered(word: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in word)


#: Of a document: its buckets as differences from one to the next, and their counts, both in 16 bits. A count beyond MOST is several, of one bucket.
SPILLED = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary()), ("counts", pa.binary()), ("sums", pa.list_(pa.int64()))])
SPILLED_DDL = "doc_id long, n_words long, buckets binary, counts binary, sums array<long>"
MOST = (1 << 16) - 1


def packed(rows: int, row: np.ndarray, bucket: np.ndarray, n: np.ndarray) -> list[pa.Array]:
    """The two columns of so many rows, from entries in order of row and bucket."""
    times = -(-n // MOST)
    of = np.repeat(np.arange(len(n)), times)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
    row, bucket, count = row[of], bucket[of], np.minimum(n[of] - nth * MOST, MOST)
    delta = bucket.copy()
    delta[1:] -= np.where(row[1:] == row[:-1], bucket[:-1], 0)
    ends = (2 * np.searchsorted(row, np.arange(rows + 1))).astype(np.int32)
    return [pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(ends), pa.py_buffer(x.astype("<u2"))]) for x in (delta, count)]


def unpacked(buckets: pa.Array, counts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's entries end (and the first begin), their buckets and their counts."""
    parts = []
    for col in (buckets, counts):
        at = np.frombuffer(col.buffers()[1], np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset : col.offset + len(col) + 1] // 2
        parts.append(np.frombuffer(col.buffers()[2] or b"", "<u2")[at[0] : at[-1]].astype(np.int64))
    ends, upto = at - at[0], np.concatenate([[0], np.cumsum(parts[0])])
    return ends, upto[1:] - np.repeat(upto[ends[:-1]], np.diff(ends)), parts[1]


def counted(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, buckets and their counts (see `packed`): a row for each row of texts (doc_id, text). And a row for each task, which has
    sums alone: those of its documents, of every bucket."""
    if buckets > MOST + 1:
        raise ValueError("buckets are written in 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con, sums = connection(), np.zeros(buckets, np.int64)

        def counts_of(rows: list[int], some: list[str], before: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
            # Pieces are numbered, so that each is a text of its own; the numbers are turned back into rows.
            con.register("pieces", pa.table({"row": pa.array(range(len(rows)), pa.int64()), "text": pa.array(some, pa.string()), "before": pa.array(before, pa.string())}))
            got = con.sql(COUNTS.format(buckets=buckets)).fetchnumpy()
            con.unregister("pieces")
            piece, bucket, n, n_words = (np.asarray(got[c]).astype(np.int64) for c in ("row", "bucket", "n", "n_words"))
            return np.array(rows, np.int64)[piece], bucket, n, n_words

        def batch_of(ids: list, rows: list[int], some: list[str], before: list[str | None]) -> pa.RecordBatch:
            """One row for each of ids; rows name them."""
            row, bucket, n, n_words = counts_of(rows, some, before)
            key, at = np.unique(row * buckets + bucket, return_inverse=True)
            n = np.bincount(at, n, len(key)).astype(np.int64)
            np.add.at(sums, key % buckets, n)
            words = np.bincount(row, n_words, len(ids)).astype(np.int64)
            return record_batch(SPILLED, ids, words, *packed(len(ids), key // buckets, key % buckets, n), [None] * len(ids))

        def long_text(doc: int | None, text: str) -> pa.RecordBatch:
            total, words = np.zeros(buckets, np.int64), 0
            for piece, before in pieces(text):
                _, bucket, n, n_words = counts_of([0], [piece], [before])
                np.add.at(total, bucket, n)
                words += int(n_words.sum())
            np.add(sums, total, out=sums)
            some = np.flatnonzero(total)
            return record_batch(SPILLED, [doc], [words], *packed(1, np.zeros(len(some), np.int64), some, total[some]), [None])

        for batch in batches:
            for part in slices(batch, "text", AT_ONCE):
                ids, some = [], []
                for doc, text in zip(column(part, "doc_id"), column(part, "text")):
                    if text and len(text) > PIECE:
                        yield long_text(doc, text)
                    else:
                        ids.append(doc)
                        some.append(text or "")
                if ids:
                    yield batch_of(ids, list(range(len(ids))), some, [None] * len(ids))
        con.close()
        yield record_batch(SPILLED, [None], [None], [None], [None], [sums.tolist()])

    return texts.select("doc_id", "text").mapInArrow(run, SPILLED_DDL)


def by_bucket(counts: DataFrame, name: str) -> DataFrame:
    return counts.where("sums is not null").select(F.posexplode("sums").alias("bucket", "n")).groupBy("bucket").agg(F.sum("n").alias(name))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, gain: of every bucket, from the stored counts of documents and target texts."""
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = every.join(by_bucket(docs, "s"), "bucket", "left").join(by_bucket(target, "t"), "bucket", "left").select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    sums = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))  # one row
    real = lambda x: (F.col(x[0]) + x[1]).cast("double")
    ratio = real(("t", 1)) * real(("all_s", buckets)) / (real(("s", 1)) * real(("all_t", buckets)))
    return both.crossJoin(F.broadcast(sums)).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weighed(counts: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight: the floored mean gain of a document's features."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def means(some: pa.RecordBatch) -> pa.RecordBatch:
        of = lambda c: some.column(some.schema.get_field_index(c))
        ends, bucket, n = unpacked(of("buckets"), of("counts"))
        upto, total = (np.concatenate([[0], np.cumsum(x)]) for x in (n, gain[bucket] * n))
        features = upto[ends[1:]] - upto[ends[:-1]]
        return record_batch(schema, of("doc_id"), of("n_words"), features, (total[ends[1:]] - total[ends[:-1]]) // np.maximum(features, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), WEIGHED):
                yield means(batch.slice(i, WEIGHED))

    return counts.where("sums is null").select("doc_id", "n_words", "buckets", "counts").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of a digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def resampled(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null if not drawn) of every document; target has a column text.

    The draw orders all rows by ranges of score and doc_id, each written in order; a row's place is its range's offset and its
    place within the range, so no task holds more than a range.
    """
    spark = docs.sparkSession
    counts = stored(counted(docs, buckets), "counts")
    wanted = stored(counted(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), buckets), "target-counts")
    gain = np.zeros(buckets, np.int64)
    for r in gains(counts, wanted, buckets).collect():  # a row a bucket
        gain[r["bucket"]] = r["gain"]
    scored = weighed(counts, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn("fit", F.col("n_words") >= least_words)
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")]
    ranged = in_order(scored, order)
    sizes = sorted((r["part"], r["n"], r["fits"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n"), F.count_if("fit").alias("fits")).collect())  # a row a range
    drawn = percent * sum(fits for _, _, fits in sizes) // 100
    before, at = [], 0
    for p, n, _ in sizes:
        before.append((p, at))
        at += n
    offsets = spark.createDataFrame(before, "part long, before long")
    place = F.col("before") + F.col("at") + 1
    rows = ranged.join(F.broadcast(offsets), "part")
    return rows.select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))
