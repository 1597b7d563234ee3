"""Operator 13: which filters do the work, in whatever order they are applied.

Each partition of judged documents becomes a packed bitmap index: one NumPy bitset for each filter (the documents that fail
it), for each label and for each part. The documents that a prefix of filters leaves are those of the part AND NOT each of its
filters, and what the next filter takes from them is an AND more. Order within a prefix does not matter, so an order of
n filters needs the counts of 2^n prefix sets at most; popcounts of a partition are sums that Spark adds up, and all n!
orders are read off those sums.

Filters: A under 200 words; B words under half of them distinct; C more than 2 % of the code points in A-Z; D one of #$%&*|;
E the text of a document with a smaller doc_id. Words are runs of bytes other than ASCII white space.

Defined cases: a null text is an empty one (and equal to others); rows with equal doc_ids count one by one, and none is smaller
than the other; a row without a doc_id is never a copy and nobody's original, and has no label; of several labels of a doc_id,
one of 1 is enough; a null source is the empty part; an empty table has no parts and gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, record_batch, slices, stored

FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 2
_MARKS = re.compile(rb"[#$%&*|]")
_NOT_CAPITAL = bytes(b for b in range(256) if not 65 <= b <= 90)
_CONTINUED = bytes(range(0x80, 0xC0))
#: Documents of one index (sorted by part, so that few parts meet in it), and parts whose sums a task holds before it hands them on.
INDEXED, HELD_PARTS = 4_096, 5_000


def failed(text: bytes) -> int:
    """The filters A to D that a text fails, a bit each."""
    words = text.split()
    n_chars = len(text.translate(None, _CONTINUED))
    a = len(words) < FEWEST_WORDS
    b = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    c = 100 * len(text.translate(None, _NOT_CAPITAL)) > CAPITAL_PERCENT * n_chars
    return a | b << 1 | c << 2 | (_MARKS.search(text) is not None) << 3


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, bits (a filter each, failed), good, toxic: a row for each document. Only digests of texts are shuffled."""
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("bits", pa.int32()), ("digest", pa.binary())])

    def run(batches):
        for batch in batches:
            for some in slices(batch, "text"):
                texts = [t or b"" for t in column(some, "text")]
                yield record_batch(schema, column(some, "doc_id"), column(some, "part"), [failed(t) for t in texts], [hashlib.sha256(t).digest() for t in texts])

    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.col("text").cast("binary").alias("text"))
    rows = stored(rows.mapInArrow(run, "doc_id long, part string, bits int, digest binary"), "failed")
    firsts = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("digest", "first")
    # A row for each text that occurs again. It is written first, since Spark splits the many rows of a hot text only where nothing stands between the join and its exchanges.
    firsts = stored(firsts, "firsts")
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False)).cast("int")
    every = rows.join(firsts, "digest", "left").select("doc_id", "part", (F.col("bits") + copy * (1 << FILTERS.index("E"))).alias("bits"))
    return every.join(marks, "doc_id", "left").select("doc_id", "part", "bits", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))


class Bitmaps:
    """A packed index of some documents: bitsets of the filters they fail, of labels, and of parts."""

    def __init__(self, parts: np.ndarray, bits: np.ndarray, labels: list[np.ndarray]):
        self.names, at = np.unique(parts, return_inverse=True)
        self.filters = np.packbits((bits[None, :] >> np.arange(len(FILTERS))[:, None]) & 1, axis=1)
        self.labels = np.packbits(np.stack(labels).astype(bool), axis=1)
        self.parts = np.packbits(at[None, :] == np.arange(len(self.names))[:, None], axis=1)

    def left(self, prefix: int) -> np.ndarray:
        """Of each part, the documents that none of the prefix's filters has taken."""
        some = self.parts
        for f, fails in enumerate(self.filters):
            if prefix >> f & 1:
                some = some & ~fails
        return some

    def counts(self) -> np.ndarray:
        """Per part, for each (prefix, filter) of STEPS: documents left, taken, and of those taken how many have each label."""
        n = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
        out = []
        for prefix in range(1 << len(FILTERS)):
            some = self.left(prefix)
            for f in (f for f in range(len(FILTERS)) if not prefix >> f & 1):
                taken = some & self.filters[f]
                out.append(np.stack([n(some), n(taken), *(n(taken & x) for x in self.labels)], axis=1))
        return np.stack(out, axis=1)


#: What is counted: each set of filters before, and the filter that follows.
STEPS = [(prefix, f) for prefix in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not prefix >> f & 1]
SUMS = pa.schema([("part", pa.string()), *[(c, pa.int64()) for c in ("prefix", "filter", "before", "taken", "good", "toxic")]])


def summed(rows: DataFrame) -> DataFrame:
    """part, prefix, filter, before, taken, good, toxic: of judged rows, for each part and each step that some order has."""

    def batch_of(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        n, steps = len(held), np.array(STEPS)
        sums = np.concatenate(list(held.values()))
        return record_batch(SUMS, np.repeat(np.array(list(held), object), len(STEPS)), *np.tile(steps, (n, 1)).T, *sums.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            parts, bits, good, toxic = (np.array(column(batch, c)) for c in ("part", "bits", "good", "toxic"))
            order = np.argsort(parts)
            for some in (order[i : i + INDEXED] for i in range(0, len(order), INDEXED)):
                index = Bitmaps(parts[some], bits[some], [good[some], toxic[some]])
                for name, sums in zip(index.names.tolist(), index.counts()):
                    held[name] = held[name] + sums if name in held else sums
            if len(held) > HELD_PARTS:
                yield batch_of(held)
                held = {}
        if held:
            yield batch_of(held)

    got = rows.select("part", "bits", "good", "toxic").mapInArrow(run, "part string, prefix long, filter long, before long, taken long, good long, toxic long")
    return got.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in ("before", "taken", "good", "toxic")])


def orders() -> list[tuple]:
    """filter_order, step, filter, prefix, of every order of the filters."""
    out = []
    for order in permutations(range(len(FILTERS))):
        prefix = 0
        for step, f in enumerate(order, 1):
            out.append(("".join(FILTERS[x] for x in order), step, f, prefix))
            prefix |= 1 << f
    return out


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    spark, n = docs.sparkSession, len(FILTERS)
    sums = stored(summed(judged(docs, labels)), "steps")
    # All that a filter fails is what it takes when it is first; all that it alone fails, when it is last.
    weight = {i: 1 for i in range(n)}
    for i in range(n):
        for k in (*range(1, i + 1), *range(1, n - i)):
            weight[i] *= k  # i! (n - 1 - i)!, the orders that have just these i filters before
    share = F.element_at(F.create_map(*[F.lit(x) for kv in weight.items() for x in kv]), F.bit_count("prefix"))
    last = F.col("prefix") == (1 << n) - 1 - F.pow(2, F.col("filter")).cast("long")
    of_filter = sums.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("taken"))).alias("fails"), F.sum(F.when(last, F.col("taken"))).alias("unique_fails"), F.sum(F.col("taken") * share).cast("long").alias("shapley")
    )
    steps = spark.createDataFrame(orders(), "filter_order string, step int, filter long, prefix long")  # n! * n rows
    rows = sums.join(F.broadcast(steps), ["prefix", "filter"]).join(of_filter, ["part", "filter"])
    return rows.select(
        "part", "filter_order", "step", (F.col("before") - F.col("taken")).alias("kept"), F.col("taken").alias("removed"), (F.col("fails") - F.col("taken")).alias("redundant"),
        "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )
