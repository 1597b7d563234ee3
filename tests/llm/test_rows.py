"""Results that depend on a row alone, and rows that share an id or have none."""

import numpy as np

from steploom.llm import jaccard, langid


def test_one_row_of_each_class(spark):
    a, b, c, d = (" ".join(f"{k}{i}" for i in range(80)) for k in "abcd")
    near = a.replace("a40 ", "changed ")
    rows = [(5, a), (5, a), (6, near), (None, b), (None, b), (3, c), (5, c), (None, d), (9, d), (9, d)]
    got = jaccard.one_of_each(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert got.columns == ["doc_id", "text"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(5, a), (None, b), (3, c), (9, d)]))


def test_language_sets_do_not_depend_on_neighbours():
    """The first text gains by three languages and not by two; the second gains by two."""
    three = np.full((30, 4), -60.0)
    three[:, 3] = -5
    three[np.arange(30), np.arange(30) % 3] = 0
    two = np.full((30, 4), -60.0)
    two[np.arange(30), np.arange(30) % 2] = 0
    one = np.full((30, 4), -60.0)
    one[:, 0] = 0
    every = [three, two, one]
    alone = np.concatenate([langid.mixtures(x, np.array([30])) for x in every])
    assert np.array_equal(alone, langid.mixtures(np.concatenate(every), np.array([30] * 3)))
    assert [int((x > 0.01).sum()) for x in alone] == [3, 2, 1]


def test_links_of_rows_without_an_id(spark):
    """A third of all rows has no id, some share one, and rows repeat."""
    rng = np.random.default_rng(6)
    bases = [[f"v{j}x{i}" for i in range(60)] for j in range(6)]
    rows = []
    for i in range(150):
        w = list(bases[rng.integers(6)])
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = f"n{rng.integers(3)}"
        rows.append((None if i % 3 == 0 else int(i % 40), " ".join(w)))
    rows += rows[:20] + [(None, None), (None, ""), (4, None)]
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) for w in ((t or "").split() for _, t in rows)]
    want = sorted((str(d), t or "", sum(len(s & o) >= 0.8 * len(s | o) for o in sets) - 1) for (d, t), s in zip(rows, sets))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = jaccard.linked(docs)
    assert sorted((str(r.doc_id), r.n_links) for r in got.collect()) == sorted((d, n) for d, _, n in want)
    assert sum(n > 0 for _, _, n in want) > 100


def test_one_row_of_each_class_with_columns_of_any_name_and_kind(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text, i, {"a": i}, f"k{i}", 2.5, i) for i in range(3)] + [(2, "other words", 9, None, None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int, m map<string,int>, Row string, `a.b` double, order int").selectExpr("*", "parse_json('[1]') AS v")
    got = jaccard.one_of_each(docs.repartition(2))
    assert got.columns == docs.columns
    kept = got.collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]
    one = next(r for r in kept if r.doc_id == 1)
    assert one._row == one.m["a"] == one.order and one.Row == f"k{one._row}" and one["a.b"] == 2.5


def test_languages_where_labelled_rows_share_an_id(spark):
    from steploom.llm.common import held_out

    words = {"aa": "mala pola tora", "bb": "zuk brin wex"}
    rows = [(1, f"{words[k]} {words[k].split()[i % 3]} {i}", k) for i in range(150) for k in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert docs.where(held_out()).count() == 0
    langs, table = langid.fitted(docs, 100)
    assert langs == ["aa", "bb"] and (table.max(axis=0) > table.min(axis=0)).all()
    n = langid.counts(docs.select("lang", "text")).agg({"n": "sum"}).first()[0]
    some = np.exp(table)  # with one added to each bucket, the least share is 1 in (all words + buckets)
    assert (1 / some.min(axis=0) - langid.BUCKETS).sum() < 0.7 * n
    same = spark.createDataFrame([(1, "mala pola", "aa")] * 300, "doc_id long, text string, lang string")
    assert langid.fitted(same, 10)[0] == ["aa"]


def plain_mixture(like):
    """One text's proportions, word by word: like (words x languages) are log likelihoods."""
    n, langs = like.shape
    p = [[float(np.exp(x)) for x in row] for row in like]

    def em(pi):
        for _ in range(langid.ROUNDS):
            new = [0.0] * langs
            for row in p:
                whole = sum(a * b for a, b in zip(row, pi))
                for j in range(langs):
                    new[j] += row[j] * pi[j] / whole / n
            pi = new
        return pi

    sums = [sum(float(x) for x in like[:, j]) for j in range(langs)]
    best = max(range(langs), key=lambda j: sums[j])
    out, kept = [float(j == best) for j in range(langs)], sums[best]
    full = em([1 / langs] * langs)
    order = sorted(range(langs), key=lambda j: -full[j])
    for k in range(2, langs + 1):
        start = [full[j] + 1e-6 if j in order[:k] else 0.0 for j in range(langs)]
        pi = em([x / sum(start) for x in start])
        gain = sum(np.log(sum(a * b for a, b in zip(row, pi))) for row in p) - (k - 1) * (langid.PENALTY + 0.5 * np.log(max(n, 2)))
        if gain > kept:
            out, kept = pi, gain
    return out


def test_mixtures_by_a_plain_loop():
    """EM and the choice of languages, of random texts side by side, against each text worked out alone by plain arithmetic."""
    rng = np.random.default_rng(11)
    sizes = rng.integers(1, 40, 60)
    likes = [rng.normal(-8, 3, (n, 4)).astype(np.float32) for n in sizes]
    got = langid.mixtures(np.concatenate(likes), sizes)
    for like, row in zip(likes, got):
        assert np.allclose(row, plain_mixture(like), atol=1e-4)


def test_pairs_in_parts_of_bounded_sets(monkeypatch):
    rng = np.random.default_rng(3)
    a, b = np.triu_indices(40, 1)
    size = rng.integers(1, 2000, 50)
    size[7] = 100_000
    monkeypatch.setattr(jaccard, "ROOM", 8 * 9000)
    parts = list(jaccard.fitting(a, b, size))
    assert sorted((x, y) for c, d in parts for x, y in zip(c.tolist(), d.tolist())) == list(zip(a.tolist(), b.tolist()))
    assert all(len(c) == 1 or size[np.unique(np.concatenate([c, d]))].sum() <= 9000 for c, d in parts) and len(parts) > 20


def test_sets_of_one_name_are_told_apart(spark):
    rows = spark.createDataFrame([(1, 5, 1), (2, 5, 2), (3, 5, 1), (4, 6, 1)], "doc_id long, node long, check long")
    got = {r.doc_id: r.node for r in jaccard.told_apart(rows, rows.where("node = 5").select("node").distinct()).collect()}
    assert got[1] == got[3] and len(set(got.values())) == 3 and got[4] == 6


def test_near_copies_of_long_texts(spark):
    """Texts of many sizes in one cluster; long ones are verified like short ones."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 10**9, 60_000)]
    rows = [(i, " ".join(base[: 60_000 - 4000 * i])) for i in range(6)] + [(10 + i, " ".join(base[100:160] + [f"x{k}" for k in range(i)])) for i in range(12)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    want = {d: sum(len(s & o) >= 0.8 * len(s | o) for o in sets) - 1 for (d, _), s in zip(rows, sets)}
    got = {r.doc_id: r.n_links for r in jaccard.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and sum(want.values()) > 20
