"""Operator 4: language identification by multilingual mixture inference.

Each language has a model of letter trigrams (hashed, add-one smoothed), counted over training documents. A document is
a mixture: each of its words was drawn from one of its languages, with a likelihood from its trigrams, and
expectation-maximisation estimates the proportions. The language set is chosen by penalised likelihood: a further language must
raise the log likelihood by more than PENALTY plus half the logarithm of the number of words.

Training counts come from at most about TRAIN_ROWS labelled rows, a fixed share by hash of doc_id and text (a documented bound; rows that are alike in both
are in or out together).

Defined cases: a text that is null or has no letter is `und`, with score 0; ties go to the language first in
alphabetical order; with no training rows all is `und`; null or equal doc_ids are rows of their own.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, held_out, mixed, record_batch, slices

BUCKETS, TRAIN_ROWS, ROUNDS, PENALTY = 1 << 15, 20_000, 12, 4.0
#: Text taken by one call of numpy's, in bytes.
STEP = 1_000_000


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point, itself in case of a letter, else 0."""
    return np.array([i if chr(i).isalpha() else 0 for i in range(0x110000)], np.uint32)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all words of all texts in turn, where each word's begin, and how many words each text has."""
    joined = "".join(f" {t.lower()}  " if t else "   " for t in texts)
    codes = letters()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)].astype(np.uint64)
    limits = np.cumsum([len(t.lower()) + 3 if t else 3 for t in texts])
    tri = mixed(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]) % np.uint64(BUCKETS)
    keep = codes[1:-1] > 0  # one trigram around each letter
    first = keep & (codes[:-2] == 0)
    at = np.cumsum(keep) - 1
    return tri[keep].astype(np.int64), at[first], np.diff(np.searchsorted(np.flatnonzero(first) + 1, limits), prepend=0)


COUNTS = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])


def counts(rows: DataFrame) -> DataFrame:
    """lang, bucket, n of labelled rows."""

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", STEP):
                by: dict[str, list] = {}
                for lang, text in zip(column(part, "lang"), column(part, "text")):
                    by.setdefault(lang, []).append(text)
                for lang, texts in by.items():
                    n = np.bincount(words_of(texts)[0], minlength=BUCKETS)
                    held[lang] = held[lang] + n if lang in held else n
        for lang, n in held.items():
            at = np.flatnonzero(n)
            yield record_batch(COUNTS, [lang] * len(at), at, n[at])

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fitted(docs: DataFrame, most: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities (bucket x language): a table of fixed size."""
    train = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    n = train.count()
    # By id and text, so that rows of one id are not in or out together; only where all rows are alike can the share be empty, and then all serve.
    share = F.pmod(F.xxhash64("doc_id", "text", F.lit("train")), F.lit(max(1, -(-n // most)))) == 0
    got = counts(train.where(share).select("lang", "text")).toPandas()
    if n and not len(got):
        got = counts(train.select("lang", "text")).toPandas()
    langs = sorted(got["lang"].unique())
    table = np.ones((BUCKETS, len(langs)))
    for i, lang in enumerate(langs):
        some = got[got["lang"] == lang]
        table[some["bucket"].to_numpy(), i] += some["n"].to_numpy()
    return langs, np.log(table / table.sum(axis=0)).astype(np.float32)


def proportions(like: np.ndarray, at: np.ndarray, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """EM: like (word x language), at where each text's words begin, start the first guess (text x language)."""
    # A row for each language: there are few, and sums along long rows are fast.
    pi, like = np.ascontiguousarray(start.T), np.ascontiguousarray(like.T)
    n, r = np.diff(np.append(at, like.shape[1])), np.empty(like.shape)
    for _ in range(rounds):
        np.multiply(like, np.repeat(pi, n, axis=1), out=r)
        r /= r.sum(axis=0)
        pi = np.add.reduceat(r, at, axis=1) / n
    return pi.T


def mixtures(log_like: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Proportions (text x language) of texts that all have words, under the chosen language sets."""
    at = np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64)
    of = np.repeat(np.arange(len(words)), words)
    top = log_like.max(axis=1, keepdims=True)
    like = np.exp(np.maximum(log_like - top, -60.0))
    base = np.add.reduceat(top[:, 0].astype(np.float64), at)
    total = np.add.reduceat(log_like.astype(np.float64), at, axis=0)
    best, langs = total.argmax(axis=1), log_like.shape[1]
    out = np.zeros((len(words), langs))
    out[np.arange(len(words)), best] = 1
    score = total.max(axis=1)
    cost = PENALTY + 0.5 * np.log(np.maximum(words, 2))
    # No mixture reaches more than each word's best language gives.
    open_ = np.flatnonzero(base - score > cost)
    if not len(open_) or langs < 2:
        return out
    pick = np.isin(of, open_)
    n = words[open_]
    some, at2 = like[pick], np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    of2 = np.repeat(np.arange(len(n)), n)
    full = proportions(some, at2, np.full((len(n), langs), 1 / langs))
    order = np.argsort(-full, axis=1, kind="stable")
    kept = score[open_]
    for k in range(2, langs + 1):
        # The same bound for k languages, of each document alone: what it rules out at k it rules out at any greater k.
        going = base[open_] - (k - 1) * cost[open_] > kept
        if not going.all():
            some, open_, full, order, n, kept = some[np.repeat(going, n)], open_[going], full[going], order[going], n[going], kept[going]
            if not len(open_):
                break
            at2, of2 = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64), np.repeat(np.arange(len(n)), n)
        allowed = np.zeros_like(full)
        np.put_along_axis(allowed, order[:, :k], 1.0, axis=1)
        start = allowed * (full + 1e-6)
        pi = proportions(some, at2, start / start.sum(axis=1, keepdims=True))
        gain = base[open_] + np.add.reduceat(np.log((some * pi[of2]).sum(axis=1)), at2) - (k - 1) * cost[open_]
        better = gain > kept
        out[open_[better]] = pi[better]
        kept = np.maximum(kept, gain)
    return out


def predicted(texts: list[str | None], langs: list[str], logs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and proportions of each text."""
    tri, at, n = words_of(texts)
    pi = np.zeros((len(texts), max(1, len(langs))))
    if len(langs) and len(tri):
        log_like = np.add.reduceat(logs[tri], at, axis=0)
        has = n > 0
        pi[has] = mixtures(log_like, n[has])
    top = pi.argmax(axis=1)
    return ["und" if not pi[i].any() else langs[t] for i, t in enumerate(top)], pi.max(axis=1), pi


OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string()))])


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the language's share of the text), langs (the chosen set, largest share first)."""
    langs, logs = fitted(docs)
    model = docs.sparkSession.sparkContext.broadcast((langs, logs))

    def run(batches):
        langs, logs = model.value
        for batch in batches:
            for part in slices(batch, "text", STEP):
                best, score, pi = predicted(column(part, "text"), langs, logs)
                sets = [[langs[i] for i in np.argsort(-p, kind="stable") if p[i] > 0.01] if p.any() else [] for p in pi]
                yield record_batch(OUT, column(part, "doc_id"), column(part, "held_out"), best, np.clip(score, 0, 1), sets)

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, langs array<string>")
