"""The relative parse against the words it names, and against brute force over blocks of any size."""

import hashlib
import random

import numpy as np
import pandas as pd

from steploom.llm import rlz


def corpus(seed=3, n=160):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(40)]
    passage = [" ".join(rng.choice(words) for _ in range(k)) for k in (9, 13, 14, 40, 90)]
    out = []
    for i in range(n):
        t = " ".join(rng.choice([rng.choice(words), rng.choice(words), rng.choice(passage)]) for _ in range(rng.randint(0, 30)))
        out.append((rng.choice([i, i, i, 7, None]), rng.choice([t, t, t, t, out[0][1] if out else t, "", None])))
    return out + [(1000, "na " * 500), (1001, "na " * 700), (1002, " ".join("u%d" % i for i in range(9000))), (1003, " ".join("u%d" % i for i in range(20, 9000)))]


def brute(rows):
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, w in split:
        if d is not None:
            for j in range(len(w) - 12):
                k = tuple(w[j : j + 13])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        hit = [False] * len(w)
        for j in range(len(w) - 12):
            if d is not None and first[tuple(w[j : j + 13])] < d:
                hit[j : j + 13] = [True] * 13
        out.append((d, len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit) if not h)).hexdigest()))
    return out


def test_parse_equals_brute_force(spark, monkeypatch):
    for seed, block in ((3, 1_000_000), (4, 900)):
        monkeypatch.setattr(rlz, "BLOCK", block)
        monkeypatch.setattr(rlz.repeated_keys, "__defaults__", (False, "text", block))
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = rlz.deduplicated(docs).collect()
        key = lambda r: (str(r[0]), *r[1:])
        assert sorted(map(key, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got))) == sorted(map(key, brute(rows)))


def test_parse_where_blocks_are_merged_in_parts(spark, monkeypatch):
    """Blocks of a few texts, merged two or three at a time; a line that all documents share."""
    monkeypatch.setattr(rlz, "BLOCK", 900)
    monkeypatch.setattr(rlz.repeated_keys, "__defaults__", (False, "text", 900))
    monkeypatch.setattr(rlz.repeated_keys, "__kwdefaults__", {"blocks": 1, "merged": 3})
    line = " ".join(f"license{i}" for i in range(20))
    rows = [(d, t if t is None or i % 3 else f"{line} {t}") for i, (d, t) in enumerate(corpus(6))]
    got = rlz.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(map(key, ((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got))) == sorted(map(key, brute(rows)))


def test_entries_of_a_hot_key_after_a_merge():
    """A key of every block is one entry of a merge, and the others pass with their reference; a key that a block had twice stays marked."""
    rng = np.random.default_rng(2)
    for places in (False, True):
        rows, hot = [], 77
        for block in range(40):
            own = rng.integers(1000, 1 << 60, 30).astype(np.uint64)
            keys = np.concatenate([own, [np.uint64(hot)], own[:1]])
            docs = np.concatenate([np.full(31, 1000 - block), [2000 + block]])
            rows += rlz.blocks_of(keys, np.zeros(32, np.uint64), docs.astype(np.int64), np.arange(32), 2, places)
        pdf = pd.DataFrame(rows, columns=[f.name for f in rlz.BLOCKS])
        out = rlz._merged(pdf, places, 2)
        own = out[out["many"].map(len) > 0]
        keys = np.concatenate([np.cumsum(rlz.unplaned(x), dtype=np.uint64) for x in own["keys"]])
        assert (keys == hot).sum() == 1 and len(keys) == len(set(keys.tolist())) == 40 * 30 + 1
        whole, merged = (pd.concat([rlz._found(x[x["bucket"] == b], places) for b in (0, 1)]) for x in (pdf, out))
        cols = ["doc_id", "name"] if places else ["doc_id", "key"]
        assert set(map(tuple, whole[cols].to_numpy().tolist())) == set(map(tuple, merged[cols].to_numpy().tolist()))
        if places:
            refs = dict(zip(zip(merged["doc_id"], merged["name"]), merged["ref"]))
            assert all(ref < doc for (doc, _), ref in refs.items()) and 961 in refs.values()


def test_factors_are_copies_of_what_they_name(spark):
    rows = [(i, t) for i, (_, t) in enumerate(corpus(5))]
    words = {d: (t or "").split() for d, t in rows}
    longest = 0
    for r in rlz.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        own, seen = words[r.doc_id], np.zeros(r.n_words, bool)
        for start, length, source, at in r.factors:
            assert length >= rlz.WINDOW and source < r.doc_id
            assert own[start : start + length] == words[source][at : at + length]
            seen[start : start + length] = True
            longest = max(longest, length)
        assert int(seen.sum()) == r.n_removed and r.kept.split() == [w for w, s in zip(own, seen) if not s]
    assert longest > 8000


def test_greedy_runs():
    hit = np.array([1, 1, 1, 0, 1, 1, 1, 1], bool)
    ref, at = np.array([2, 2, 2, 0, 2, 2, 3, 3]), np.array([5, 6, 7, 0, 9, 10, 0, 1])
    assert rlz.factors(hit, ref, at).tolist() == [[0, 15, 2, 5], [4, 14, 2, 9], [6, 14, 3, 0]]
