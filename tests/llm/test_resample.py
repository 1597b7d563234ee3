"""Importance resampling against a plain loop over Counters."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np

from steploom.llm import resample

SCHEMA = "doc_id long, text string, counts string, rank map<string,int>, fit boolean"


def features(text):
    ws = re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(ws), Counter(zlib.crc32(g.encode()) % 10000 for g in ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])])


def brute(rows, target, least=20, percent=25):
    got = [features(t) for _, t, *_ in rows]
    s, t = Counter(), Counter()
    for _, c in got:
        s.update(c)
    for x in target:
        t.update(features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for (d, *_), (n, c) in zip(rows, got):
        m = sum(c.values())
        w = sum(gain[b] * k for b, k in c.items()) // m if m else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, m, w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    drawn = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1], x[2]))
    places = {id(x): i for i, x in enumerate(drawn[: percent * len(drawn) // 100], 1)}
    return sorted((str(x[:4]), places.get(id(x)) or 0) for x in out)


def result(spark, rows, target):
    got = resample.resampled(spark.createDataFrame(rows, SCHEMA).repartition(3), spark.createDataFrame([(x, 1) for x in target], "text string, doc_id int"))
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    return sorted((str([r.doc_id, r.n_features, r.weight, r.score]), r.rank or 0) for r in got.collect())


def test_draw_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vocabulary = ["Ab", "b", "É", "straße", "x1", "don't", "日本", "İ", "a_b", "\x00", "Z z", "7"] + [f"w{i}" for i in range(40)]
    texts = [None, "", "... !", "one", "ſ K K"] + [" ".join(rng.choice(vocabulary, rng.integers(1, 80))) for _ in range(60)]
    rows = [(int(rng.integers(0, 90)) if rng.random() < 0.85 else None, texts[rng.integers(len(texts))], None, None, None) for _ in range(150)]
    rows += rows[:15] + [(1000, " ".join(rng.choice(vocabulary, 30_000)), None, None, None)]
    target = [texts[i] for i in (0, 1, 7, 8, 9, 9)]
    assert result(spark, rows, target) == brute(rows, target)


def test_no_documents_and_no_target(spark):
    assert result(spark, [], ["a b"]) == []
    rows = [(i, f"a b c{i} " * 20, None, None, None) for i in range(9)]
    assert result(spark, rows, []) == brute(rows, [])


def test_pieces_of_long_texts():
    """Cut anywhere, a text has the features it has as a whole; also where a piece has no word at all."""
    rng = np.random.default_rng(2)
    for _ in range(200):
        text = "".join(rng.choice(list("aB é.. \x00'"), rng.integers(0, 60)))
        ws, parts = [], list(resample.pieces(text, int(rng.integers(1, 9))))
        assert "".join(p for p, _ in parts) == text
        for p, before in parts:
            assert before == (ws[-1] if ws else None)
            ws += re.findall(r"[0-9a-zé]+", p.lower())
        assert ws == re.findall(r"[0-9a-zé]+", text.lower())


def test_a_text_of_many_pieces(spark):
    text = " ".join(f"Word{i % 5000}x{i % 7}" for i in range(200_000))
    assert len(text) > 2 * resample.PIECE
    rows = [(1, text, None, None, None), (2, "a b", None, None, None)]
    assert result(spark, rows, ["word1x1 word2x2"]) == brute(rows, ["word1x1 word2x2"])


def test_counts_as_they_are_stored():
    """Rows without entries, counts beyond 16 bits, and slices of a batch."""
    rng = np.random.default_rng(4)
    rows, want = [], []
    for i in range(40):
        some = np.unique(rng.integers(0, 10_000, rng.integers(0, 30))) if i % 5 else np.zeros(0, np.int64)
        n = rng.choice([1, 2, 65_535, 65_536, 300_000], len(some))
        want.append({int(b): int(k) for b, k in zip(some, n)})
        rows.append((np.full(len(some), i), some, n))
    row, bucket, n = (np.concatenate(x).astype(np.int64) for x in zip(*rows))
    columns = resample.packed(40, row, bucket, n)
    for a, b in ((0, 40), (7, 31), (5, 6), (3, 3)):
        ends, bucket, n = resample.unpacked(*(x.slice(a, b - a) for x in columns))
        got = []
        for x, y in zip(ends, ends[1:]):
            c = Counter()
            for k, m in zip(bucket[x:y].tolist(), n[x:y].tolist()):
                c[k] += m
            got.append(dict(c))
        assert got == want[a:b]
