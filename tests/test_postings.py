"""Posting blocks against plain lists, and context by reference against joined texts."""

import random

from steploom.operators import picks, postings


def test_blocks_of_hot_and_rare_tags(spark):
    """A tag with most of all rows, one in each range, NULL as a tag, repeated pairs; the same blocks however many ranges there are."""
    rng = random.Random(3)
    rows = [("hot", rng.randrange(-5000, 50_000)) for _ in range(6000)] + [(rng.choice(["a", "b", None, "é"]), rng.randrange(300)) for _ in range(600)] + [("one", 7), ("none", None)] + [(f"t{i}", i) for i in range(40)]
    rows += rows[:100]
    df = spark.createDataFrame(rows, "k string, v int").repartition(5)
    want = {}
    for k, v in rows:
        if v is not None:
            want.setdefault(k, set()).add(v)
    for partitions in (1, 7, 40):
        blocks = postings.posted(df, "k", "v", 64, partitions)
        got = {}
        for r in blocks.collect():
            assert 0 < r.n == len(r.deltas) <= 64 and r.deltas[0] == 0
            got.setdefault(r.tag, {})[r.block] = (r.first, r.n, r.deltas)
        assert set(got) == set(want)
        for k, some in got.items():
            ids, every = [], sorted(want[k])
            for b in sorted(some):
                first, n, deltas = some[b]
                assert b * 64 == len(ids) and first == every[b * 64]
                for d in deltas:
                    first += d
                    ids.append(first)
            assert ids == every
        listed = {(r.tag, r.block): r.ids for r in postings.listed(blocks).collect()}
        assert listed["hot", 2] == sorted(want["hot"])[128:192]
    found = sorted((r.tag, r.id) for r in postings.looked_up(blocks, ["hot", "a"], 100, 250).collect())
    assert found == sorted((k, v) for k in ("hot", "a") for v in want[k] if 100 <= v <= 250)
    assert postings.posted(df.where("false"), "k", "v").count() == 0


def test_context_by_reference(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["x", "y", None]), i, rng.choice([None, "", "a", "bc é", "long " * 9])) for i in range(120)]
    df = spark.createDataFrame(rows, "trace string, n int, text string").repartition(4)
    wholes, parts = picks.running(df, ["trace"], ["n"], "text", 4)
    by = {}
    for t, _, text in rows:
        by.setdefault(t, []).append(text)
    joined = {t: "\n\n".join(x for x in some if x) for t, some in by.items()}
    assert {r.trace: r.whole for r in wholes.collect()} == joined
    got = picks.preceding(parts, wholes, ["trace"]).collect()
    assert len(got) == sum(-(-len(x) // 4) for x in by.values())
    for r in got:
        some = by[r.trace]
        assert r.preceding == "\n\n".join(x for x in some[: 4 * r.chunk] if x)
        own = "\n\n".join(x for x in some[4 * r.chunk : 4 * r.chunk + 4] if x)
        assert joined[r.trace][r.start : r.stop] == own and r.n == len(some[4 * r.chunk : 4 * r.chunk + 4])
