"""The training-data operators against brute force and the public library, odd rows included."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from steploom.llm import bpe, decontam, fm, jaccard, langid, pii, rans, rlz, sketch, slots

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key_id string, kept_id string, shared string"


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = text(80), text(30)
    near = base.split()
    near[40] = "changed"
    texts = [base, base, " ".join(near), text(60) + " " + passage, passage + " " + text(50), "", None, "one", "one", "one two", "x" * 30_000, text(3000), "a@b.co +1 (234) 555-1234 10.0.0.1", "  \n\t　 ", "na na " * 200, "na na " * 200 + "la", "ünï 😀 <|endoftext|> é"]
    return [(i if i != 8 else 7, t, None if i % 5 == 0 else ("en", "de")[i % 2], None, None if t is None else len(t), "k", "k", "s") for i, t in enumerate(texts)] + [(None, "null id", "en", "s", 7, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_equals_library(docs):
    lib = Tokenizer.from_file(BYTE)
    want = sorted((str(r[0]), hashlib.sha256(",".join(map(str, lib.encode(r[1] or "", add_special_tokens=False).ids)).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in corpus())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, BYTE).collect()) == want


def test_bpe_streams(spark):
    lib, v, rng = Tokenizer.from_file(BYTE), bpe.vocabulary(BYTE), random.Random(5)
    for x in ["aaaa" * 5000, " " * 20000 + "x", "'" * 7000 + "re", "é" * 9000 + " z", *("".join(rng.choice(["'", "s", " ", "\n", "re", "é", "\x1c", "<|endof", "text|>", "😀"]) for _ in range(30)) for _ in range(200))]:
        e, out, i = bpe.Encoder(v), [], 0
        while i < len(x):
            k = rng.choice([1, 3, 997, 5000])
            out += e.feed(x[i : i + k])
            i += k
        assert out + e.finish() == lib.encode(x, add_special_tokens=False).ids


def test_rans_files(docs):
    lib, at = Tokenizer.from_file(WORD), 0
    got = rans.stored_ids(docs, WORD).orderBy("start").collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    assert [r.doc_id for r in got] == [r[0] for r in rows]
    for r, g in zip(rows, got):
        ids = np.array(lib.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        assert (g.start, g.n_tokens, g.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_rans_damage():
    e = rans.encode_segment(np.random.default_rng(1).integers(0, 49000, 300_000))
    assert len(rans.decode_segment(**e, blocks=[1])) == 300_000 - rans.BLOCK
    with pytest.raises(ValueError):
        rans.decode_segment(**{**e, "sums": [0] * len(e["sums"])})


def test_rlz(docs):
    first = {}
    rows = [(rlz.LAST if r[0] is None else r[0], (r[1] or "").encode().split()) for r in corpus()]
    for i, w in sorted(rows, key=lambda r: r[0]):
        for j in range(len(w) - 12):
            first.setdefault(tuple(w[j : j + 13]), i)
    want = []
    for i, w in rows:
        hit = [0] * len(w)
        for j in range(len(w) - 12):
            if first[tuple(w[j : j + 13])] < i:
                hit[j : j + 13] = [1] * 13
        want.append((i, len(w), sum(hit), hashlib.sha256(b" ".join(x for x, h in zip(w, hit) if not h)).hexdigest()))
    got = [(rlz.LAST if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in rlz.deduplicated(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 100


def test_jaccard(docs):
    rows = [(r[0], (r[1] or "").encode().split()) for r in corpus()]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) for _, w in rows]
    link = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    want = sorted((str(i), sum(link(s, t) for t in sets) - 1) for (i, _), s in zip(rows, sets))
    got = jaccard.linked(docs).collect()
    assert sorted((str(r.doc_id), r.n_links) for r in got) == want
    by = {r.doc_id: r.class_id for r in got}
    assert by[0] == by[1] == by[2] == 0 and by[3] == 3 and by[14] == 14 and by[15] == 15 and by[None] is None
    kept = {r.doc_id for r in jaccard.one_of_each(docs).collect()}
    assert {0, 3, 14, 15} <= kept and not kept & {1, 2}


def test_jaccard_pruning_and_tiles():
    assert jaccard.least_matches(150) < 150 * 0.7
    s = [jaccard.shingles(b" ".join(b"w%d" % (i + (1000 if i % 40 == k else 0)) for i in range(300))) for k in range(30)]
    sigs = np.stack([jaccard.signature(x) for x in s])
    a, b = np.triu_indices(len(s), 1)
    exact = np.array([len(np.intersect1d(s[x], s[y])) / len(np.union1d(s[x], s[y])) >= 0.8 for x, y in zip(a, b)])
    assert not (set(np.flatnonzero(exact)) - set(jaccard.pruned(sigs, a, b).tolist()))


def test_slots(docs):
    got = slots.sharded(docs, 16).collect()
    texts = sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus())
    assert sorted((r.size, r.text_crc32) for r in got) == texts and all(r.grown_shard in (r.shard, 16) for r in got)
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    m = slots.slot_map(16)
    assert max(map(m.count, range(16))) - min(map(m.count, range(16))) <= 1
    even = slots.rebalanced(m, [1] * 4095 + [400], 16)
    loads = [sum(400 if s == 4095 else 1 for s in range(4096) if even[s] == k) for k in range(16)]
    assert max(loads) - min(loads) <= 400


def test_sketch(docs):
    got = sketch.fingerprinted(docs).collect()
    rows = sorted(corpus(), key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, (r[1] or "").encode()))
    want = [(r[0], len(r[1] or ""), hashlib.sha256(sketch.edited(r[1] or "", rows[(k + 1) % len(rows)][1] or "").encode()).hexdigest()) for k, r in enumerate(rows)]
    assert sorted(map(str, ((r.doc_id, r.n_chars, r.edited_sha256) for r in got))) == sorted(map(str, want))
    a, b = sketch.sketch("abcdefghij" * 3 + "xyz" * 2000), sketch.sketch("q" * 5 + "abc" * 900)
    assert (sketch.parse(sketch.fingerprint(a)) == a).all() and set(sketch.merged(a, b)) == set(a) | set(b)


def test_decontamination(spark):
    rng = random.Random(8)
    item = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    close = item[:50] + "Z" + item[51:120] + item[122:]
    far = "".join(c if rng.random() > 0.2 else "z" for c in item)
    docs = spark.createDataFrame([(1, f"x {item.upper()} y"), (2, f"x\n{close} y"), (3, far), (4, None), (5, ""), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, None), (9, "")], "item_id long, text string")
    assert sorted((str(r.doc_id), r.item_id, r.distance) for r in decontam.leaks(docs, bench).collect()) == [("1", 7, 0), ("2", 7, 3), ("None", 7, 0)]
    assert sorted(r.doc_id for r in decontam.cleaned(docs, bench).collect()) == [3, 4, 5]
    edit = lambda p, t: min_edit(p, t)
    for _ in range(200):
        p, t = ("".join(rng.choice("ab") for _ in range(n)) for n in (rng.randint(1, 8), rng.randint(0, 12)))
        assert decontam.nearest(p, t)[0] == edit(p, t)


def min_edit(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_langid(spark, docs, empty):
    rows = [(i, ("the cat and the hat is that " if i % 2 else "der hund und die katze nicht ") * 5, "en" if i % 2 else "de") for i in range(120)]
    df = spark.createDataFrame(rows + [(900, "123 !", None), (901, None, None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identified(df).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and got[900].lang_pred == got[901].lang_pred == "und" and got[901].score == 0
    langs, logs = langid.fitted(df)
    assert len(langid.identified(docs).collect()) == len(corpus())
    mixed = langid.predicted(["the cat and the hat is that " * 9 + "der hund und die katze nicht " * 3], langs, logs)
    assert mixed[0] == ["en"] and 0.6 < mixed[1][0] < 0.9


def test_pii_patterns_and_masking():
    t = "x a.b@c.de, 10.0.0.256; 10.1.2.3; 4539 1488 0343 6467; +1 (234) 555-1234"
    assert [(k, t[a:b]) for k, a, b in pii.base_spans(t)] == [("email", "a.b@c.de"), ("ip", "10.1.2.3"), ("card", "4539 1488 0343 6467"), ("phone", "+1 (234) 555-1234")]
    assert pii.masked("mail a@b.co now", [("email", 5, 11)]) == "mail <EMAIL> now"
    assert pii.luhn("4539148803436467") and not pii.luhn("4539148803436468")


def test_pii_tagger_learns(docs):
    carriers = ["lorem ipsum dolor sit amet. consectetur adipiscing elit " * 8]
    model = pii.Tagger().fit(*pii.training(carriers, 1200, seed=1), epochs=8)
    x, y = pii.training(carriers, 300, seed=2)
    assert (model.decode(x) == y).mean() > 0.95
    for text, (base, every) in zip(t := ["call (234) 555-1234 now", "a@b.com"], pii.found(t, model)):
        assert set(base) <= set(every)
    assert pii.spans(docs, model).count() == pii.redacted(docs, model).count() == len(corpus())


def test_fm(spark, docs, empty):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["tree", "house", "river", "stone"]) for _ in range(60)) if i % 3 else "SPAM!! " * 50) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows] + [(1, 1), (None, 0), (5, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in fm.scored(df, labels).collect()}
    assert np.mean([got[i].predicted == (i % 3 > 0) for i, _ in rows]) > 0.98
    assert {r.doc_id for r in fm.accepted(df, labels).collect()} == {i for i in got if got[i].predicted}
    assert all(r.score == 0.5 for r in fm.scored(docs, labels.where("false")).collect())
    m = fm.Machine()
    idx, val, at = fm.features([b"a b c a"])
    dense = m.b + (m.w[idx] * val).sum() + sum(float(m.v[idx[i]] @ m.v[idx[j]]) * val[i] * val[j] for i in range(len(idx)) for j in range(i))
    assert abs(dense - m.margins(idx, val, at)[0]) < 1e-3


def test_empty_tables(spark, empty):
    labels, bench = spark.createDataFrame([], "doc_id long, quality int"), spark.createDataFrame([], "item_id long, text string")
    frames = [bpe.round_trip(empty, BYTE), rans.stored_ids(empty, WORD), rlz.deduplicated(empty), langid.identified(empty), slots.sharded(empty), pii.spans(empty, pii.Tagger()), sketch.fingerprinted(empty), jaccard.linked(empty), decontam.leaks(empty, bench), fm.scored(empty, labels)]
    assert [f.count() for f in frames] == [0] * 10
