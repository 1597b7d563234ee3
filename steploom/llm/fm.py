"""Operator 10: quality classifier, a factorisation machine.

Features are hashed words (square root of the count, scaled to unit length), structure statistics of the text and its length. The score
is a logistic of bias, linear terms and low-rank pairwise interactions; the interactions are computed in linear time by
the sum-of-squares identity: sum over pairs = (|sum v x|^2 - sum |v x|^2) / 2.

It is fitted in numpy on at most about TRAIN_ROWS labelled rows, a fixed share by hash of doc_id (a documented bound), of
documents whose crc32(doc_id as text) mod 3 is not 1. lang, source, doc_id and labels are never features.

Defined cases: a null text counts as empty and has the statistics of an empty text; equal doc_ids in labels count as one label, 1 if
half of them or more are, and of equal doc_ids in documents the least text is fitted on; with no labelled row every score is 0.5 (predicted 1); null doc_ids are held out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, held_out, record_batch, slices, word_hashes

HASHED, RANK, TRAIN_ROWS, EPOCHS = 1 << 14, 8, 6000, 8
STATS = 14
WIDTH = HASHED + STATS


def statistics(text: bytes, words: np.ndarray) -> list[float]:
    """Shares of kinds of bytes, and of repeats among words; each about 0 to 1."""
    n = len(text)
    if not n:
        return [1.0, *[0.0] * (STATS - 1)]
    c = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit, space, high = c[65:91].sum(), c[97:123].sum(), c[48:58].sum(), c[32] + c[9] + c[10] + c[13], c[128:].sum()
    mark = n - upper - lower - digit - space - high
    k = max(1, len(words))
    same = float((words[1:] == words[:-1]).sum()) / k
    distinct = len(np.unique(words)) / k
    full = c[46] + c[44]
    return [0.0, upper / n, digit / n, min(1.0, 4 * mark / n), min(1.0, 4 * (mark - full) / n), min(1.0, 8 * full / n), same, distinct, 1 - distinct, high / n, min(1.0, 20 * c[10] / n), min(1.0, n / k / 20), np.log1p(n) / 16, np.log1p(k) / 14]


def features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Indexes and values of all texts' features in turn, and where each text's begin."""
    idx, val, sizes = [], [], []
    for text in texts:
        text = text or b""
        words = word_hashes(text.split())
        at, n = np.unique((words % np.uint64(HASHED)).astype(np.int32), return_counts=True)
        x = np.sqrt(n)
        idx += [at, np.arange(HASHED, WIDTH, dtype=np.int32)]
        val += [x / max(1e-9, np.sqrt((x * x).sum())), np.array(statistics(text, words))]
        sizes.append(len(at) + STATS)
    return np.concatenate(idx), np.concatenate(val).astype(np.float32), np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)


class Machine:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v = 0.0, np.zeros(WIDTH, np.float32), (0.05 * rng.standard_normal((WIDTH, RANK))).astype(np.float32)

    def margins(self, idx, val, at) -> np.ndarray:
        xv = self.v[idx] * val[:, None]
        total = np.add.reduceat(xv, at, axis=0)
        squares = np.add.reduceat((xv * xv).sum(axis=1), at)
        return self.b + np.add.reduceat(self.w[idx] * val, at) + 0.5 * ((total * total).sum(axis=1) - squares)

    def scores(self, idx, val, at) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(idx, val, at), -30, 30).astype(np.float64)))

    def fit(self, rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = 0.1, batch: int = 64, seed: int = 11) -> "Machine":
        """AdaGrad on the logistic loss."""
        if not rows:
            self.v[:] = 0
            return self
        rng = np.random.default_rng(seed)
        share = np.clip(np.mean([y for y, _, _ in rows]), 0.01, 0.99)
        self.b = float(np.log(share / (1 - share)))
        gw, gv, gb = np.full(WIDTH, 1e-2), np.full((WIDTH, RANK), 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for i in range(0, len(order), batch):
                some = [rows[j] for j in order[i : i + batch]]
                idx, val = np.concatenate([r[1] for r in some]), np.concatenate([r[2] for r in some])
                sizes = np.array([len(r[1]) for r in some])
                at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                xv = self.v[idx] * val[:, None]
                total = np.add.reduceat(xv, at, axis=0)
                z = self.margins(idx, val, at)
                d = np.repeat((1 / (1 + np.exp(-np.clip(z, -30, 30))) - np.array([r[0] for r in some])) / len(some), sizes)
                where, back = np.unique(idx, return_inverse=True)
                dw = np.bincount(back, d * val, len(where)) + 1e-6 * self.w[where]
                each = (d * val)[:, None] * (np.repeat(total, sizes, axis=0) - xv)
                dv = np.stack([np.bincount(back, each[:, f], len(where)) for f in range(RANK)], axis=1) + 1e-5 * self.v[where]
                db = float(sum(d / sizes.repeat(sizes)))
                gw[where] += dw * dw
                gv[where] += dv * dv
                gb += db * db
                self.w[where] -= (rate * dw / np.sqrt(gw[where])).astype(np.float32)
                self.v[where] -= (rate * 0.3 * dv / np.sqrt(gv[where])).astype(np.float32)
                self.b -= rate * db / gb**0.5
        return self


SAMPLE = pa.schema([("label", pa.int32()), ("idx", pa.binary()), ("val", pa.binary())])


def fitted(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Machine:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out()).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    n = known.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(max(1, -(-n // most)))) == 0

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                idx, val, at = features(column(part, "text"))
                cuts = at[1:]
                yield record_batch(SAMPLE, column(part, "label"), [x.tobytes() for x in np.split(idx, cuts)], [x.tobytes() for x in np.split(val, cuts)])

    # The sample has about `most` rows whatever the input: small enough to send to every task, and its features, 8 bytes for each, to the driver.
    sample = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(F.broadcast(known.where(share)), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = [(r["label"], np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32)) for r in sample.select("label", "text").mapInArrow(run, "label int, idx binary, val binary").collect()]
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    return Machine().fit(rows)


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                s = model.value.scores(*features(column(part, "text")))
                yield record_batch(OUT, column(part, "doc_id"), column(part, "held_out"), s, (s >= 0.5).astype(np.int32))

    return docs.select("doc_id", held_out().alias("held_out"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents, with all their columns, that score 0.5 or more."""
    model = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 2_000_000):
                texts = [None if t is None else t.encode() for t in column(part, "text")]
                yield part.filter(pa.array(model.value.scores(*features(texts)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
