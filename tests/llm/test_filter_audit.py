"""The audit of filters against all orders applied one by one."""

from itertools import permutations

import numpy as np

from steploom.llm import audit

DOCS = "doc_id long, text string, source string, part string, bits map<string,int>"
LABELS = "doc_id long, quality int, toxic int, note string"


def words(n, distinct=None):
    return " ".join(f"w{i % (distinct or n)}" for i in range(n))


def fails(text, doc_id, rows):
    ws = text.encode().split()
    return {
        "A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * sum(c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text) > 2 * len(text),
        "D": any(c in text for c in "#$%&*|"), "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, *_ in rows),
    }


def brute(rows, labels):
    good, toxic = ({d for d, *x, _ in labels if d is not None and x[k] == 1} for k in (0, 1))
    every = [((r[2] or ""), fails(r[1] or "", r[0], rows), r[0] in good, r[0] in toxic) for r in rows]
    out = {}
    for part in {p for p, *_ in every}:
        mine = [x for x in every if x[0] == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, c in enumerate(order, 1):
                gone = [x for x in left if x[1][c]]
                left = [x for x in left if not x[1][c]]
                failing = [x for x in mine if x[1][c]]
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(sum(x[1].values()) == 1 for x in failing), sum(x[2] for x in gone), sum(x[3] for x in gone)]
    for (part, order, step), row in out.items():
        row.append(sum(r[1] for (p, o, s), r in out.items() if p == part and o[s - 1] == order[step - 1]))
    return {k: tuple(v) for k, v in out.items()}


def result(spark, rows, labels):
    got = audit.audited(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got.collect()}


def test_all_orders_by_brute_force(spark):
    """Nulls, empty and long texts, copies, repeated rows and ids, rows without an id, columns of other names; several labels of a document."""
    rng = np.random.default_rng(3)
    texts = [None, "", words(250), words(250, 40), words(199), words(200, 100), words(200, 99), "A" + "b" * 49, "AB" + "c" * 98, "ABC" + "c" * 97, "a | b", words(300) + " #", words(400, 10) + " $ ABCDEFGH" * 30, "é" * 49 + "A", "x y " * 120, words(20_000, 9_000), "\x0b\x0c \t", "a\x1cb " * 110]
    rows = [(int(rng.integers(0, 40)) if rng.random() < 0.8 else None, texts[rng.integers(len(texts))], [None, "", "s", "t"][rng.integers(4)], "x", None) for _ in range(120)]
    rows += rows[:10]
    labels = [(int(i), int(rng.integers(0, 2)), int(rng.integers(0, 2)), None) for i in rng.integers(0, 40, 30)] + [(None, 1, 1, None), (3, None, None, None), (3, 1, None, None)]
    assert result(spark, rows, labels) == brute(rows, labels)


def test_no_documents_and_no_labels(spark):
    assert result(spark, [], []) == {}
    rows = [(1, "a", "s", None, None)]
    assert result(spark, rows, []) == brute(rows, [])


def test_many_parts_in_a_batch():
    """Popcounts of an index against plain counts."""
    rng = np.random.default_rng(5)
    parts, bits, good = np.array([f"p{i}" for i in rng.integers(0, 300, 1000)]), rng.integers(0, 32, 1000), rng.integers(0, 2, 1000)
    index = audit.Bitmaps(parts, bits, [good, 1 - good])
    counts = index.counts()
    for i in (0, 7, len(index.names) - 1):
        mine = parts == index.names[i]
        for (prefix, f), got in zip(audit.STEPS, counts[i]):
            left = mine & (bits & prefix == 0)
            taken = left & (bits >> f & 1 == 1)
            assert got.tolist() == [left.sum(), taken.sum(), (taken & (good == 1)).sum(), (taken & (good == 0)).sum()]
