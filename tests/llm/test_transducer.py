"""The transducer against the definition of BPE, for random merge lists; and every text goes through it."""

import json
import random

import public_tokenizers
from tokenizers import Tokenizer

from steploom.llm import bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def random_vocabulary(rng, path, letters="abc"):
    """A file with a random merge list over a few letters, each part of a merge a token already there."""
    shown = {b: c for c, b in bpe.byte_alphabet().items()}
    vocab = {shown[b]: b for b in range(256)}
    tokens, merges = list(letters), []
    for _ in range(rng.randint(1, 14)):
        a, b = rng.choice(tokens), rng.choice(tokens)
        if len(a + b) <= 9 and a + b not in vocab:
            merges.append([a, b])
            vocab[a + b] = len(vocab)
            tokens.append(a + b)
    path.write_text(json.dumps({"added_tokens": [], "model": {"vocab": vocab, "merges": merges}}))
    return bpe.Vocabulary(str(path))


def test_random_merge_lists(tmp_path):
    rng = random.Random(1)
    for k in range(120):
        v = random_vocabulary(rng, tmp_path / f"{k}.json")
        for _ in range(25):
            piece = "".join(rng.choice("abc") for _ in range(rng.randint(1, 160))).encode()
            want = [v.ids[t] for t in v.merge(piece)]
            t, out, i = bpe.PieceTransducer(v), [], 0
            while i < len(piece):
                n = rng.randint(1, 40)
                out += t.feed(piece[i : i + n])
                assert out == want[: len(out)]  # what is emitted is never taken back
                assert len(t.held) < t.most + v.lookahead + v.longest
                i += n
            assert out + t.finish() == want


def test_lookahead_is_sufficient(tmp_path):
    """A token with the lookahead known behind it stays, whatever follows."""
    rng = random.Random(9)
    for k in range(60):
        v = random_vocabulary(rng, tmp_path / f"{k}.json", "ab")
        for _ in range(40):
            whole = "".join(rng.choice("ab") for _ in range(40)).encode()
            cut = rng.randint(1, 40)
            at, final = 0, v.merge(whole)
            ends = {sum(map(len, final[: i + 1])): t for i, t in enumerate(final)}
            for t in v.merge(whole[:cut]):
                at += len(t)
                if at + v.lookahead <= cut:
                    assert ends.get(at) == t


def test_every_text_is_transduced(monkeypatch):
    v, said = bpe.Vocabulary(BYTE), []
    feed = bpe.PieceTransducer.feed
    monkeypatch.setattr(bpe.PieceTransducer, "feed", lambda self, data: said.append(data) or feed(self, data))
    text = "One short text, it's plain. \n\n Zwölf Boxkämpfer “jagen” 12 日本語 " + "x" * 20_000
    ids = [i for some in bpe.streamed(text, v, 100) for i in some]
    assert b"".join(said).decode() == text  # each piece is new here, or its like has been seen once
    assert ids == Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids


def test_windows_and_tables_do_not_matter():
    rng, lib = random.Random(7), Tokenizer.from_file(BYTE)
    v = bpe.Vocabulary(BYTE)
    v.pieces.most = 30
    parts = ["the", " the", "'s", "'", "re", " ", "  ", "\n", "\t", "é", "É", "日本", "7", "½", "²", "ª", "\xa0", "\x85", "\x1c", "\x00", " ", "!", "...", "<|endoftext|>", "<|endof", "😀", "́", "word"]
    for _ in range(400):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
        got = [i for some in bpe.streamed(text, v, rng.choice([1, 2, 3, 7, 1000])) for i in some]
        assert got == lib.encode(text, add_special_tokens=False).ids, text
        assert len(v.pieces) <= 30


def test_ids_and_back(spark):
    rows = [(1, "a text"), (1, "a text"), (None, "é😀 <|endoftext|>"), (2, None), (3, ""), (4, "long " * 50_000)]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, ids string, n_tokens int")
    coded = bpe.encoded(docs, BYTE)
    assert coded.columns == ["doc_id", "n_tokens", "ids"] and all(r.n_tokens == len(r.ids) for r in coded.collect())
    assert sorted((str(r.doc_id), r.text) for r in bpe.decoded(coded, BYTE).collect()) == sorted((str(d), t or "") for d, t in rows)
    empty = spark.createDataFrame([], "doc_id long, ids array<int>")
    assert bpe.decoded(empty, BYTE).count() == 0
    assert [r.text for r in bpe.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), BYTE).collect()] == [""]


def test_token_split(spark):
    lib = Tokenizer.from_file(BYTE)
    rows = [("a", "Let me think.", "42"), ("b", None, ""), ("c", "x" * 5000, "é😀")]
    calls = spark.createDataFrame([(*r, 7, "old") for r in rows], "item_id string, reasoning string, content string, answer_tokens int, tokenizer string")
    got = {r.item_id: r for r in bpe.token_split(calls, BYTE, "byte50k").collect()}
    n = lambda t: len(lib.encode(t or "", add_special_tokens=False).ids)
    assert all((got[i].reasoning_tokens, got[i].answer_tokens, got[i].tokenizer) == (n(a), n(b), "byte50k") for i, a, b in rows)
    for name, want in ((None, None), ("other", "other (unavailable)")):
        r = bpe.token_split(calls, None, name).first()
        assert (r.reasoning_tokens, r.answer_tokens, r.tokenizer) == (None, None, want)
