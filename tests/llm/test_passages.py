"""Byte passages that repeat: the transform against plain sorting, the operator against a search of every string."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from steploom.llm import bwt, passages

SCHEMA = "doc_id long, text string, block long, whole string, data map<string,int>"


def brute(rows, length=passages.LENGTH):
    first = {}
    for d, t in rows:
        b = (t or "").encode() if not isinstance(t, bytes) else t
        for i in range(len(b) - length + 1):
            if d is not None and d < first.get(b[i : i + length], d + 1):
                first[b[i : i + length]] = d
    out = []
    for d, t in rows:
        b = (t or "").encode() if not isinstance(t, bytes) else t
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - length + 1):
            if d is not None and first[b[i : i + length]] < d:
                gone[i : i + length] = True
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((str(d), len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(rng, n, kinds="abcdefgh \n"):
    """Texts made of passages: of one another, cut anywhere, or changed in a byte."""
    base = ["".join(rng.choices(kinds, k=rng.randrange(20, 200))) for _ in range(6)]
    texts = []
    for _ in range(n):
        t = ""
        for _ in range(rng.randrange(0, 5)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            t += rng.choice([b, b[i:], b[:i], "".join(rng.choices(kinds, k=30)), b[:i] + "é" + b[i:], "a" * rng.randrange(120)])
        texts.append(t)
    return texts


def test_boundaries_by_plain_comparison():
    rng = random.Random(1)
    for _ in range(150):
        depth, kinds = rng.choice([1, 2, 5, 13, 50]), rng.choice([1, 2, 4])
        strings = [bytes(rng.choices(range(kinds), k=rng.randrange(0, 90))) for _ in range(rng.randrange(1, 8))]
        strings += [s[rng.randrange(len(s)) :] for s in strings if s]
        if rng.random() < 0.2:
            strings.append(bytes(rng.choices(range(256), k=900)) + strings[0])
        owner, at, group = bwt.repeats(strings, depth)
        want = {(i, p): s[p : p + depth] for i, s in enumerate(strings) for p in range(len(s) - depth + 1)}
        assert set(zip(owner.tolist(), at.tolist())) == set(want)
        classes = {(g, want[i, p]) for i, p, g in zip(owner.tolist(), at.tolist(), group.tolist())}
        assert len(classes) == len({g for g, _ in classes}) == len(set(want.values()))


@pytest.mark.parametrize("hot", [0, 3, 1000])
def test_rounds_without_spark(monkeypatch, hot):
    """All rounds by hand over several blocks, with every anchor hot, some, and none."""
    monkeypatch.setattr(passages, "HOT", hot)
    monkeypatch.setattr(passages, "SALTS", 2)
    monkeypatch.setattr(passages, "SLICE", 130)
    rng = random.Random(hot)
    for _ in range(12):
        rows = [(rng.randrange(20), t.encode()) for t in corpus(rng, 25, rng.choice(["ab", "abcdefgh \n"]))]
        blocks = {}
        for d, t in rows:
            blocks.setdefault(rng.randrange(5), []).append((d, t))
        tables = {b: pa.table({"doc_id": pa.array([d for d, _ in x]), "whole": pa.array([hash(t) for _, t in x]), "text": pa.array([t for _, t in x])}) for b, x in blocks.items()}

        def dealt(parts, key):
            every = pa.concat_tables(parts)
            return [every.filter(pa.compute.equal(every.column(key), k)) for k in every.column(key).unique()]

        none = passages.TOLD.empty_table()
        named = dealt([passages.block_anchors(b, t, none, 3) for b, t in tables.items()], "bucket")
        told = pa.concat_tables([passages.shared_anchors(x) for x in named] + [none])
        sent = [passages.block_runs(b, t, told.filter(pa.compute.equal(told.column("block"), b)), 3) for b, t in tables.items()]
        for _ in range(2):
            sent = [passages.merged(x, 3) for x in dealt(sent, "bucket")] or [passages.RUNS_SCHEMA.empty_table()]
        found = pa.concat_tables(sent)
        assert set(found.column("kind").to_pylist()) <= {passages.FOUND}
        got = [passages.block_results(t, found.filter(pa.compute.equal(found.column("block"), b)), none) for b, t in tables.items()]
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for x in got for r in x.to_pylist()) == brute(rows)


def test_few_rows_hold_bounded_transforms(monkeypatch):
    """A block sends a row for each tray, whatever it holds; in a tray, runs go through the transform in lots of bounded size, each once."""
    rng, through, transform = random.Random(4), [], passages.repeats_in
    monkeypatch.setattr(passages, "LOT", 6000)
    monkeypatch.setattr(passages, "HOT", 12)
    monkeypatch.setattr(passages, "repeats_in", lambda data, sizes, depth: through.append(len(data)) or transform(data, sizes, depth))
    base = ["".join(rng.choices("abcdefgh \n", k=400)) for _ in range(60)] + ["a line that stands in most of all documents, with others beside it"]
    rows = [(d, "".join(rng.choices(base, k=3) + base[-1:] + rng.choices(base, k=1)).encode()) for d in range(80)]
    tables = {b: pa.table({"doc_id": pa.array([d for d, _ in rows[b::4]]), "whole": pa.array([hash(t) for _, t in rows[b::4]]), "text": pa.array([t for _, t in rows[b::4]])}) for b in range(4)}

    def dealt(parts, key):
        every = pa.concat_tables(parts)
        return [every.filter(pa.compute.equal(every.column(key), k)) for k in every.column(key).unique()]

    none, trays = passages.TOLD.empty_table(), 2
    told = pa.concat_tables([passages.shared_anchors(x) for x in dealt([passages.block_anchors(b, t, none, 3) for b, t in tables.items()], "bucket")])
    sent = [passages.block_runs(b, t, told.filter(pa.compute.equal(told.column("block"), b)), trays) for b, t in tables.items()]
    assert max(len(x) for x in sent) <= 2 * trays + 1
    assert {passages.RUN, passages.PART} <= set(pa.concat_tables(sent).column("kind").to_pylist())
    for _ in range(2):
        sent = [passages.merged(x, trays) for x in dealt(sent, "bucket")]
    assert len(through) > 3 * trays and max(through) <= 2 * passages.LOT
    found = pa.concat_tables(sent)
    got = [passages.block_results(t, found.filter(pa.compute.equal(found.column("block"), b)), none) for b, t in tables.items()]
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for x in got for r in x.to_pylist()) == brute(rows)


def result(spark, rows):
    got = passages.deduplicated(spark.createDataFrame([(d, t, None, None, None) for d, t in rows], SCHEMA).repartition(3)).collect()
    for r in got:
        assert len(r.kept) == r.n_bytes - r.n_removed and sum(b - a for a, b in r.spans) == r.n_removed and len(r.spans) == r.n_spans
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def test_passages_by_brute_force(spark):
    """Nulls, empty and long texts, copies, repeated rows and ids, rows without an id, columns of other names."""
    rng = random.Random(9)
    texts = corpus(rng, 60) + [None, "", "x" * 49, "x" * 50, "x" * 51, "日本語" * 40]
    rows = [(rng.randrange(50) if rng.random() < 0.85 else None, rng.choice(texts)) for _ in range(150)]
    rows += rows[:10] + [(60, " ".join(t or "" for t in texts) * 3), (61, "x" * 5000)]
    assert result(spark, rows) == brute(rows)


def test_no_documents(spark):
    assert result(spark, []) == []
    assert result(spark, [(None, "x" * 60)]) == brute([(None, "x" * 60)])
