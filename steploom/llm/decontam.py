"""Operator 9: benchmark decontamination by pigeonhole edit matching.

A test item of m characters may differ in k = m * RATE edits. It is cut into k + 1 pieces; if at most k edits were made, one
piece stands unchanged, so every match holds an exact piece hit. Documents are scanned once for all pieces with an
Aho-Corasick automaton, and each hit's surroundings are verified with Myers' bit-parallel distance. Case and white space
are normalised on both sides.

The test items are a stated query set: they go to all tasks in blocks of at most BLOCK_CHARS characters, so what is sent
is bounded whatever the table holds; documents are not shuffled.

Defined cases: null or empty texts and items match nothing; an item shorter than SHORTEST characters is too short to tell a
leak from chance and must match whole and exactly between word limits; repeated rows match separately; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import column, record_batch, slices, stored

RATE, SHORTEST, BLOCK_CHARS = 0.05, 40, 8_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces, as even as can be, with their places."""
    n, out, at = len(item), [], 0
    for i in range(k + 1):
        end = n * (i + 1) // (k + 1)
        out.append((at, item[at:end]))
        at = end
    return out


def masks(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | 1 << i
    return out


def nearest(pattern: str, text: str, eq: dict[str, int] | None = None, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of the pattern to a substring of text (anchored: to a beginning of it), and where the first such substring ends (Myers, 1999)."""
    m = len(pattern)
    anchored = int(anchored)
    eq = masks(pattern) if eq is None else eq
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1 | anchored) & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


class Items:
    """The automaton of a block of test items."""

    def __init__(self, items: tuple[tuple[int, str], ...], rate: float):
        self.items, found = [], {}
        for item_id, text in items:
            text = normal(text)
            if not text:
                continue
            k = int(len(text) * rate) if len(text) >= SHORTEST else 0
            i = len(self.items)
            self.items.append((item_id, text, k, masks(text)))
            for at, piece in pieces(text, k):
                found.setdefault(piece, []).append((i, at))
        self.found = ahocorasick.Automaton()
        for piece, where in found.items():
            self.found.add_word(piece, (len(piece), where))
        self.any = bool(found)
        if self.any:
            self.found.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best match of each item (the first, where several are as good), in normalised characters."""
        if not text or not self.any:
            return []
        best: dict[int, tuple[int, int, int]] = {}
        tried: set[tuple[int, int]] = set()
        for end, (size, where) in self.found.iter(text):
            for i, at in where:
                item_id, item, k, eq = self.items[i]
                got = best.get(i)
                if got and got[0] == 0:
                    continue
                origin = end + 1 - size - at
                spot = (i, origin // (k + 1))
                if spot in tried:
                    continue
                tried.add(spot)
                a, b = max(0, origin - 2 * k - 1), origin + len(item) + 2 * k + 1
                if text.startswith(item, max(0, origin)) and origin >= 0:
                    d, stop = 0, origin + len(item)
                elif k:
                    d, e = nearest(item, text[a:b], eq)
                    stop = a + e
                else:
                    continue
                if len(item) < SHORTEST and not (text[stop - len(item) - 1 : stop - len(item)].strip() == "" and text[stop : stop + 1].strip() == ""):
                    continue
                if d <= k and (not got or d < got[0]):
                    # From the end of the match backwards, to where it begins.
                    size = nearest(item[::-1], text[max(0, stop - len(item) - k) : stop][::-1], anchored=True)[1] if d else len(item)
                    best[i] = (d, stop - size, stop)
        return [(self.items[i][0], *m) for i, m in sorted(best.items())]


@lru_cache(4)
def automaton(items: tuple[tuple[int, str], ...], rate: float) -> Items:
    return Items(items, rate)


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
OUT_DDL = "doc_id long, item_id long, distance int, start long, end long"


def block_count(benchmark: DataFrame) -> int:
    total = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    return total // (BLOCK_CHARS // 2) + 1


def block(benchmark: DataFrame, k: int, n: int) -> tuple[tuple[int, str], ...]:
    """The test items of the k-th of n blocks, in one order whatever their partitions: by text, then item_id, null first."""
    rows = benchmark.where((F.length(F.trim("text")) > 0) & (F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)).select("item_id", "text").collect()
    return tuple(sorted(((r["item_id"], r["text"]) for r in rows), key=lambda i: (i[1], i[0] is not None, i[0] or 0)))


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, start, end: a row for each document and test item it holds."""

    def scan(items):
        def run(batches):
            found = automaton(items, rate)
            for batch in batches:
                for part in slices(batch, "text"):
                    rows = [(doc, *m) for doc, text in zip(column(part, "doc_id"), column(part, "text")) for m in found.matches(normal(text))]
                    if rows:
                        yield record_batch(OUT, *zip(*rows))

        return docs.select("doc_id", "text").mapInArrow(run, OUT_DDL)

    n = block_count(benchmark)
    if n == 1:
        return scan(block(benchmark, 0, 1))
    # A scan for each block, one after another: the driver never holds two.
    out = stored(scan(block(benchmark, 0, n)), "leaks")
    for k in range(1, n):
        out = out.unionByName(stored(scan(block(benchmark, k, n)), "leaks"))
    return out


def cleaned(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, with all their columns, that hold no test item."""

    def without(docs, items):
        def run(batches):
            found = automaton(items, rate)
            for batch in batches:
                for part in slices(batch, "text"):
                    yield part.filter(pa.array([not found.matches(normal(t)) for t in column(part, "text")], pa.bool_()))

        return docs.mapInArrow(run, docs.schema)

    n = block_count(benchmark)
    for k in range(n):
        docs = without(docs, block(benchmark, k, n))
        if k + 1 < n:
            docs = stored(docs, "cleaned")
    return docs
