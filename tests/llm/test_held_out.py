"""Models judged on rows they were not fitted on, likeness against plain sets, and the pipeline's stages on odd tables."""

import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from steploom.llm import bpe, fm, langid, rlz, sketch
from steploom.llm.common import held_out

SMALL = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.exists(SMALL), reason="no test tables")


@needs_tables
def test_languages_held_out(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = langid.identified(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    rows = got.select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert len(rows) > 200 and np.mean([r.ok for r in rows]) > 0.97


@needs_tables
def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "labels"))
    rows = fm.scored(docs, labels).where("held_out").join(labels.select("doc_id", "quality"), "doc_id").collect()
    good, bad = ([r.score for r in rows if r.quality == k] for k in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([r.predicted == r.quality for r in rows])
    majority = max(len(good), len(bad)) / len(rows)
    assert len(rows) > 80 and auc > 0.95 and right > majority


def test_labels_out_of_the_fit_do_not_matter(spark):
    docs = spark.createDataFrame([(i, ("good tree house " if i % 2 else "BAD!! ") * (i % 9 + 1), "x" * i) for i in range(200)], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    wrong = labels.withColumn("quality", F.when(held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    got, other = ({r.doc_id: r.score for r in fm.scored(docs, x).collect()} for x in (labels, wrong))
    assert got == other
    kept = fm.accepted(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s >= 0.5}


def test_likeness_equals_plain_sets(spark):
    rng = np.random.default_rng(2)
    words = ["w%d" % i for i in range(300)]
    texts = [" ".join(rng.choice(words, rng.integers(0, 400))) for _ in range(40)] + ["", None, "short", "short", "é😀" * 400, "x" * 50_000]
    rows = [(int(i), t) for i, t in enumerate(texts)]

    def kept(t):  # every shingle's hash, one by one
        if len(t) < sketch.SHINGLE:
            return {int(h) for h in sketch.sketch(t)}
        each = (sketch.rolled(np.array([ord(c) for c in t[i : i + sketch.SHINGLE]], np.uint64), sketch.SHINGLE)[0] >> np.uint64(16) for i in range(len(t) - sketch.SHINGLE + 1))
        return {int(h) for h in each if h < sketch.FRACTION * (1 << 48)}

    def like(a, b, same):
        return len(a & b) / len(a | b) if a | b else float(same)

    got = {r.doc_id: r for r in sketch.fingerprinted(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        new, r = sketch.edited(t, after), got[i]
        s, e, n = kept(t), kept(new), kept(after)
        assert set(sketch.parse(r.fingerprint).tolist()) == s and set(sketch.parse(r.edited_fingerprint).tolist()) == e
        assert r.near_edited == pytest.approx(like(s, e, t == new)) and r.near_next == pytest.approx(like(s, n, t == after))


ODD = "doc_id long, text string, lang string, source string, n_chars long, label string, node long, item_id long"


@needs_tables
def test_stages_on_odd_tables(spark):
    word = lambda k, n=60: " ".join(f"{k}{i % 17}" for i in range(n))
    rows = [(1, word("a"), "en", None, 9, "l", 1, 2), (1, word("a"), "en", None, 9, "l", 1, 2), (None, word("b"), None, "s", None, None, None, None), (None, None, None, None, None, None, None, None), (2, "", "de", "s", 0, "", 0, 0), (3, "mail a@b.co " + word("c", 30_000), "en", "s", 5, "l", 1, 1)]
    odd = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        got, none = stage(spark, odd, SMALL), stage(spark, odd.where("false"), SMALL)
        assert none.count() == 0, name
        n = got.count()
        if name == "tokens":
            assert got.columns == ["doc_id", "n_tokens", "ids"] and n == len(rows)
        else:
            assert got.columns == odd.columns, name
        if name == "near_duplicates":
            # Equal rows are one, a null text and an empty one have no words and are one.
            assert n == 4
        if name == "personal_data":
            texts = {r.text for r in got.collect()}
            assert n == len(rows) and "mail <EMAIL> " + word("c", 30_000) in texts and None in texts
            assert {r.n_chars for r in got.where("doc_id = 3").collect()} == {len("mail <EMAIL> " + word("c", 30_000))}


@needs_tables
def test_pipeline_is_its_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SMALL).collect()}
    scores = {r.doc_id: r.score for r in fm.scored(docs, spark.read.parquet(f"{SMALL}/labels.parquet")).collect()}
    assert got and all(scores[d] >= 0.5 for d in got) and len(got) < docs.count()
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = {r.doc_id: r.text for r in bpe.decoded(spark.createDataFrame(list(got.values())), path).collect()}
    own = {r.doc_id: r.text for r in docs.collect()}
    # A kept text is its own, but for what was masked.
    assert np.mean([texts[d] == (own[d] or "") for d in got]) > 0.8
    assert all(texts[d] == (own[d] or "") or "<" in texts[d] for d in got)
    # No two kept texts are near copies (five words, 0.8), by brute force over their shingles.
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)} for d, w in ((d, (own[d] or "").split()) for d in got)}
    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    common = {}
    for ds in by.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    assert not [p for p, n in common.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)]


def test_null_ids_lose_nothing(spark):
    text = " ".join(f"w{i}" for i in range(40))
    got = rlz.deduplicated(spark.createDataFrame([(1, text), (2, text), (None, text), (None, text)], "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in got) == [("1", 0), ("2", 40), ("None", 0), ("None", 0)]
