"""Base spans against the patterns as they are stated, and the tagger on labelled spans it was not fitted on."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from steploom.llm import pii

#: The patterns as stated, with no search for @ first and no check ahead.
STATED = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and pii.luhn(re.sub("[ -]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
]
CARRIER = ["lorem ipsum dolor sit amet. consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua " * 4]


def stated(text):
    return [(k, m.start(), m.end()) for k, p, ok in STATED for m in re.finditer(p, text) if ok(m[0])]


@pytest.fixture(scope="module")
def model():
    return pii.Tagger().fit(*pii.training(CARRIER, 2400, seed=1))


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a@b.co", "@", "x", "1.2.3.4", "300.1.1.1", ".", "4539 1488 0343 6467", "4539-1488-0343-6467", "7", "12", " ", "-", "+", "+1 (234) 555-1234", "(", ")", "é", "😀", "\n", "user.name+tag@mail.example.org", "000.0.0.255", "٣"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_base_spans_are_the_stated_patterns():
    for text in odd_texts(6000, 4):
        assert sorted(pii.base_spans(text)) == sorted(stated(text)), text


def test_query_columns(spark, model):
    rows = list(enumerate(odd_texts(150, 5))) + [(None, None), (7, ""), (7, ""), (8, "+1 (269) 555-3296 4524132264652876 " + "word " * 30_000 + "a@b.co")]
    got = pii.spans(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string"), model).collect()
    want = []
    for doc, text in rows:
        base = [s for k in pii.KINDS for s in stated(text or "") if s[0] == k]
        want.append((str(doc), *[sum(s[0] == k for s in base) for k in pii.KINDS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    for r in got:
        every = [tuple(s.split(":")) for s in r.spans.split(",") if s]
        assert every == sorted(every, key=lambda s: (pii.KINDS.index(s[0]), int(s[1]))) and len(every) >= r.n_email + r.n_ip + r.n_card + r.n_phone


def test_held_out_precision_and_recall(model):
    rng = random.Random(77)
    samples = [pii.sample(rng, CARRIER) for _ in range(700)]
    right, said, there = ({k: 0 for k in pii.KINDS} for _ in range(3))
    for (text, spans), got in zip(samples, pii.tagged([t for t, _ in samples], model)):
        got = [s for s in got if pii.plausible(s[0], text[s[1] : s[2]])]
        for s in got:
            said[s[0]] += 1
            right[s[0]] += s in spans
        for s in spans:
            there[s[0]] += 1
    print({k: (right[k] / said[k], right[k] / there[k]) for k in pii.KINDS})
    assert all(right[k] / said[k] > 0.9 and right[k] / there[k] > 0.6 for k in pii.KINDS)


def test_tagger_adds_what_greedy_patterns_lose(model):
    rng, added, wrong = random.Random(5), 0, 0
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for _ in range(150):
        phone, card = f"+1 ({d(3)}) {d(3)}-{d(4)}", pii.card(rng).replace(" ", "").replace("-", "")
        text = f"lorem ipsum {phone} {card} dolor sit"
        base, every = pii.found([text], model)[0]
        own = [text[a:b] for k, a, b in every if (k, a, b) not in base]
        assert set(base) <= set(every)
        added += sum(s in (phone, card) for s in own)
        wrong += sum(s not in (phone, card) for s in own)
    assert added > 150 and wrong < 0.1 * added


def test_windows_without_hints_change_nothing(model):
    """The grid's windows give what all windows give, where those with no digit or @ say nothing."""
    rng = random.Random(8)
    texts = [" ".join(rng.choice([CARRIER[0][:50], pii.written(rng)[1]]) for _ in range(12)) for _ in range(40)]
    for text, got in zip(texts, pii.tagged(texts, model)):
        code = pii.classes(text)
        x = pii.padded(code)
        e = model.emissions(x)
        quiet = ~pii.HINTS[x].any(axis=1)
        k = np.flatnonzero(~quiet)
        want = []
        for a, b in pii.stretches(k):
            want += pii.spans_of(model.viterbi(pii.reconciled(e[k[a:b]])[None])[0], int(k[a]) * pii.STRIDE, len(text))
        assert got == want


def test_long_stretches_are_decoded_as_a_whole(model, monkeypatch):
    """However the windows of a stretch are dealt to blocks, it has the tags of one pass over all of it."""
    rng = random.Random(3)
    text = " ".join(f"{pii.card(rng)}, +44 20 7946 {rng.randint(1000, 9999)}" for _ in range(400))
    x = pii.padded(pii.classes(text))[pii.grid(pii.classes(text))]
    want = pii.spans_of(model.viterbi(pii.reconciled(model.emissions(x))[None])[0], 0, len(text))
    assert len(x) > 400 and len(want) > 700
    for batch in (1, 7, 100, len(x) - 1, len(x), 10_000):
        monkeypatch.setattr(pii, "BATCH", batch)
        assert pii.tagged(["7", text, ""], model)[1] == want
    assert pii.tagged(["", "no hints", "7", "@" * 300], model)[:2] == [[], []]


def test_likeliest_tags_by_enumeration():
    """Viterbi, the marginals and the pair counts of the CRF against all tag sequences of a short row."""
    rng = np.random.default_rng(4)
    m = pii.Tagger()
    m.p["trans"] = rng.standard_normal((pii.TAGS, pii.TAGS)).astype(np.float32)
    e = rng.standard_normal((2, 4, pii.TAGS)).astype(np.float32)
    step, p, pairs = m._steps().astype(float), np.zeros(e.shape), np.zeros((pii.TAGS, pii.TAGS))
    for r in range(2):
        scores = {}
        for tags in itertools.product(range(pii.TAGS), repeat=4):
            if tags[0] % 2 == 1 or tags[0] == 0:
                scores[tags] = sum(float(e[r, i, t]) for i, t in enumerate(tags)) + sum(step[a, b] for a, b in zip(tags, tags[1:]))
        top = max(scores.values())
        z = sum(np.exp(v - top) for v in scores.values())
        for tags, v in scores.items():
            w = np.exp(v - top) / z
            p[r, np.arange(4), tags] += w
            np.add.at(pairs, (tags[:-1], tags[1:]), w)
        assert m.viterbi(e)[r].tolist() == list(max(scores, key=scores.get))
        assert m.likeliest(iter([e[r, :1], e[r, 1:3], e[r, 3:]])).tolist() == m.viterbi(e)[r].tolist()
    got, got_pairs = m._marginals(e)
    assert np.allclose(got, p, atol=1e-5) and np.allclose(got_pairs, pairs, atol=1e-5)


def test_gradients_by_differences():
    """Back propagation through the LSTMs and the CRF against differences of the likelihood, in doubles."""
    rng = np.random.default_rng(8)
    m = pii.Tagger()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    x, y = rng.integers(0, pii.CLASSES, (3, 6)), np.array([[0, 1, 2, 0, 3, 4], [5, 6, 6, 0, 0, 7], [0, 0, 0, 1, 1, 2]])

    def loss():
        e, step = m.emissions(x).astype(float), m._steps().astype(float)
        fw = e[:, 0] + np.where(np.arange(pii.TAGS) % 2 + (np.arange(pii.TAGS) == 0), 0, -1e4)
        for i in range(1, 6):
            fw = np.logaddexp.reduce(fw[:, :, None] + step, axis=1) + e[:, i]
        gold = e[np.arange(3)[:, None], np.arange(6), y].sum(axis=1) + step[y[:, :-1], y[:, 1:]].sum(axis=1)
        return float((np.logaddexp.reduce(fw, axis=1) - gold).mean())

    g = m._gradients(x, y)
    for name in m.p:
        flat, size = m.p[name].reshape(-1), 1e-2
        for i in rng.choice(len(flat), 12, replace=False) if len(flat) > 12 else range(len(flat)):
            old = flat[i]
            flat[i] = old + size
            up = loss()
            flat[i] = old - size
            down = loss()
            flat[i] = old
            assert abs((up - down) / (2 * size) - np.asarray(g[name]).reshape(-1)[i]) < 3e-3, (name, i)


def test_a_fitted_model_is_stored_and_read_back(spark, monkeypatch, tmp_path):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice([CARRIER[0][:60], pii.written(rng)[1]]) for _ in range(8))) for i in range(40)]
    docs = spark.createDataFrame([*rows, (99, f"{tmp_path} " * 20)], "doc_id long, text string")  # texts that no earlier run had
    first = pii.fitted(docs)
    monkeypatch.setattr(pii.Tagger, "fit", lambda *a: pytest.fail("fitted anew"))
    again = pii.fitted(docs)
    assert set(again.p) == set(first.p) and all(np.array_equal(first.p[k], again.p[k]) and again.p[k].dtype == np.float32 for k in first.p)
    with pytest.raises(BaseException, match="fitted anew"):
        pii.fitted(docs.where("doc_id < 30"))
