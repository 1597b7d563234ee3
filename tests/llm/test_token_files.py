"""Ids of the token files against the public library, and the container against what was written."""

import json
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from steploom.llm import rans

WORD = public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    "the", "The", "DON'T", "'s", "'S", "'ve", "''ll", "x'd", "café", "café", "́", "ÀÉß", "ſ", "İ", "Σας", "ª", "º", "µ", "²", "½", "×", "÷", "¿qué", "«oui»", "…", "“q”", "–", "日本", "😀", "‍", "\x00", "\x1c", "\x1f", "\x7f", "\x85",
    "\xa0", "　", "\t", "\n", "\r\n", "\x0b", " ", "  ", "7", "42", "4111-1111", "!!", "--'s", "$$$", "<|", "<|endoftext|>", "<|startoftext|", "|>", "a" * 70, "ǅ", "ﬁ", "Ⅷ", "é" * 65,
]


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", "", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_words_equal_library():
    lib, table = Tokenizer.from_file(WORD), rans.Words(WORD)
    table.most = 40  # so that generations change often
    for k in range(30):
        some = texts(150, k)
        want = [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]
        assert [np.frombuffer(x, np.int32).tolist() for x in table(some)] == want
        assert len(table.now) <= 40 and len(table.before) <= 2000 and all(len(w) <= table.longest for w in table.now)


def test_unknown_file_is_read_by_the_library(tmp_path):
    with open(WORD, encoding="utf-8") as f:
        spec = json.load(f)
    spec["normalizer"] = None
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    some = texts(60, 99)
    assert [np.frombuffer(x, np.int32).tolist() for x in rans.Words(path)(some)] == [e.ids for e in Tokenizer.from_file(path).encode_batch(some, add_special_tokens=False)]


def test_segments_say_where_they_begin(spark):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(60)], "doc_id long, text string")
    rows = rans.segments(docs, WORD, 2, segment=20).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r.file, r.segment)):
        assert r.before == by.get(r.file, 0) and r.n_tokens == sum(r.lengths)
        by[r.file] = r.before + r.n_tokens
    got = rans.read_documents(spark.createDataFrame(rows, rans.SEGMENTS_DDL)).orderBy("start").collect()
    assert [r.doc_id for r in got] == list(range(60)) and [r.start for r in got] == [sum(i % 7 + 1 for i in range(k)) for k in range(60)]


def test_rows_without_an_id_are_parted(spark):
    rng = random.Random(2)
    rows = [(None if i % 3 else i, "".join(rng.choice("abc é") for _ in range(rng.randint(0, 60)))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    files = rans.segments(docs, WORD, 2)
    assert max(len([i for i in r.doc_ids if i is None]) for r in files.collect()) < 150  # of 200
    got = rans.stored_ids(docs, WORD).orderBy("start").collect()
    lib, at = Tokenizer.from_file(WORD), 0
    for (doc, text), r in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode())), got):
        n = len(lib.encode(text, add_special_tokens=False).ids) + 1
        assert (r.doc_id, r.start, r.n_tokens) == (doc, at, n)
        at += n
