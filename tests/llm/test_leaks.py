"""Edit matching against a direct search of every substring, and odd test items."""

import random

from steploom.llm import decontam


def least(p, t):
    """The least edit distance of p to any substring of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def whole(p, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return row[-1]


def edited(rng, s, n):
    out = list(s)
    for _ in range(n):
        i = rng.randrange(len(out))
        out[i : i + 1] = rng.choice([[], [rng.choice("abcde")], [out[i], rng.choice("abcde")]])
    return "".join(out)


def test_search_finds_what_direct_search_finds():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 7)))
    found = 0
    for _ in range(150):
        item = decontam.normal(" ".join(word() for _ in range(rng.randint(9, 30))))
        k = int(len(item) * decontam.RATE)
        text = decontam.normal(" ".join([" ".join(word() for _ in range(rng.randint(0, 20))), edited(rng, item, rng.randint(0, k + 3)), " ".join(word() for _ in range(rng.randint(0, 20)))]))
        got, d = decontam.Items(((1, item),), decontam.RATE).matches(text), least(item, text)
        assert bool(got) == (d <= k)
        if got:
            _, near, start, end = got[0]
            assert near == d == whole(item, text[start:end])
            found += 1
    assert found > 60


def test_null_and_equal_item_ids(spark):
    item, other = "the quick brown fox jumps over the lazy dog again and again", "a second question that has nothing to do with the first one at all"
    bench = spark.createDataFrame([(None, item), (3, item), (3, other), (None, other), (4, None), (5, "short one")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "a short one, here"), (3, "a short one here"), (4, "x " * 200_000 + other)], "doc_id long, text string")
    got = sorted((r.doc_id, str(r.item_id)) for r in decontam.leaks(docs, bench).collect())
    assert got == [(1, "3"), (1, "None"), (3, "5"), (4, "3"), (4, "None")]
    assert [r.doc_id for r in decontam.cleaned(docs, bench).collect()] == [2]


def test_many_blocks_of_items_give_what_one_gives(spark, monkeypatch):
    rng = random.Random(6)
    items = [" ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(12)) for _ in range(30)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some words {items[i % 30]} and more" if i % 2 else "nothing here") for i in range(60)], "doc_id long, text string")
    one = sorted(map(tuple, decontam.leaks(docs, bench).collect())), sorted(r.doc_id for r in decontam.cleaned(docs, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1200)
    assert decontam.block_count(bench) > 2
    assert (sorted(map(tuple, decontam.leaks(docs, bench).collect())), sorted(r.doc_id for r in decontam.cleaned(docs, bench).collect())) == one
    assert len(one[0]) == 30 and one[1] == list(range(0, 60, 2))
