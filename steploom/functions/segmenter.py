"""Reasoning text to steps: the only sequential scan here, as a table of steps that goes out in batches of bounded size, and as an Arrow
function returning array<struct>.

A step is a half-open range of code points of the normalised text. Paragraphs are cut where a sentence or line begins
with a marker; fragments under MERGE words join the one before; ranges over SPLIT words are halved at the sentence start nearest
their middle. Nothing is cut inside fenced code or display mathematics.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Word limits and markers; those with a trailing blank need no word limit behind them.
MERGE, SPLIT = 10, 138
MARKERS = [
    "Wait", "Hmm", "Actually", "Alternatively", "But ", "However", "Let me", "Let's", "First", "Second", "Next", "Then", "So ", "Therefore", "Thus", "Check", "Verify", "Now", "Instead",
    "Hold on", "Recall",
]
OPENING = re.compile("(?:" + "|".join(re.escape(m) + ("" if m[-1] == " " else r"\b") for m in MARKERS) + r")|\s*(?:\d+[.)]|[-*]|Step \d+)")
CODE = re.compile(r"(```|~~~).*?(?:\1|\Z)", re.S)
MATHS = re.compile(r"\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$", re.S)
BLANK_LINE = re.compile(r"\n[ \t]*\n\s*")
STOP = re.compile(r"[.!?]+\s+")

STEP = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))


def normalised(text: str) -> str:
    return re.sub(r"</?think>", "", text.replace("\r\n", "\n").replace("\r", "\n")).strip()


class Shields:
    """Ranges in whose inside nothing is cut."""

    def __init__(self, text: str):
        self._set(m.span() for m in CODE.finditer(text))
        code = list(zip(self.starts, self.ends))
        self._set(sorted([*code, *(m.span() for m in MATHS.finditer(text) if not self.cover(m.start()))]))

    def _set(self, spans) -> None:
        """Spans in order of their starts; those that overlap have one inside."""
        self.starts, self.ends = [], []
        for a, b in spans:
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def cover(self, at: int) -> bool:
        i = bisect.bisect_left(self.starts, at) - 1
        return i >= 0 and at < self.ends[i]


def _tight(text: str, a: int, b: int) -> tuple[int, int] | None:
    part = text[a:b]
    bare = part.strip()
    if not bare:
        return None
    a += len(part) - len(part.lstrip())
    return a, a + len(bare)


def ranges(text: str) -> list[tuple[int, int]]:
    """The steps of a normalised text."""
    shields = Shields(text)

    def starts(a: int, b: int) -> list[int]:
        after = {m.end() for m in STOP.finditer(text, a, b) if not shields.cover(m.start()) and m.end() < b}
        i = text.find("\n", a, b - 1)
        while i >= 0:
            if not shields.cover(i):
                after.add(i + 1)
            i = text.find("\n", i + 1, b - 1)
        return sorted(after)

    pieces, at = [], 0
    for m in [*(m for m in BLANK_LINE.finditer(text) if not shields.cover(m.start())), None]:
        if paragraph := _tight(text, at, m.start() if m else len(text)):
            cuts = [paragraph[0], *(s for s in starts(*paragraph) if s > paragraph[0] and OPENING.match(text, s)), paragraph[1]]
            pieces += [t for a, b in zip(cuts, cuts[1:]) if (t := _tight(text, a, b))]
        at = m.end() if m else at

    merged: list[tuple[int, int]] = []
    waiting = None
    for a, b in pieces:
        a, waiting = (a if waiting is None else waiting), None
        if len(text[a:b].split()) >= MERGE:
            merged.append((a, b))
        elif merged:
            merged[-1] = merged[-1][0], b
        else:
            waiting = a
    if waiting is not None:
        merged.append((waiting, pieces[-1][1]))

    out, todo = [], merged[::-1]
    while todo:
        a, b = todo.pop()
        where = starts(a, b) if len(text[a:b].split()) > SPLIT else []
        where = [s for s in where if a < s < b]
        if where:
            middle = (a + b) / 2
            i = bisect.bisect_left(where, middle)
            cut = min(where[max(0, i - 1) : i + 1], key=lambda s: (abs(s - middle), s))
            halves = [t for t in (_tight(text, a, cut), _tight(text, cut, b)) if t]
            if len(halves) == 2:
                todo += halves[::-1]
                continue
        out.append((a, b))
    return out


#: About so many characters of steps are held as Python objects; one step may exceed it.
HELD = 1_000_000


def _cut(texts: Iterable) -> Iterator[tuple[list[int], list[int], list[int], list[int], list[str]]]:
    """Steps of Arrow strings, in order, about HELD characters at a time: the text's place among them, ordinal, start, end and text."""
    out, size = ([], [], [], [], []), 0
    for i, text in enumerate(texts):
        whole = normalised(text.as_py() or "")
        for k, (a, b) in enumerate(ranges(whole)):
            for column, x in zip(out, (i, k, a, b, whole[a:b])):
                column.append(x)
            size += b - a
            if size >= HELD:
                yield out
                out, size = ([], [], [], [], []), 0
    if out[0]:
        yield out


def step_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches of some columns and, last, a text: the columns and the steps of each text. A batch of steps has about HELD characters."""
    for batch in batches:
        *keys, texts = batch.columns
        for of, ordinal, start, end, text in _cut(texts):
            steps = [pa.array(ordinal, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, texts.type)]
            yield pa.RecordBatch.from_arrays([*(k.take(pa.array(of, pa.int32())) for k in keys), *steps], [*batch.schema.names[:-1], "ordinal", "start", "end", "text"])


def stepped(table: DataFrame, text: str) -> DataFrame:
    """A row for each step: the table's other columns, and ordinal, start, end, text. A task holds one Arrow batch of texts, and not its steps."""
    rows = table.select(*[x for x in table.columns if x != text], text)
    steps = [T.StructField("ordinal", T.IntegerType()), *STEP.elementType.fields]
    return rows.mapInArrow(step_batches, T.StructType([*rows.schema.fields[:-1], *steps]))


@F.arrow_udf(STEP)
def _segments(texts: pa.Array) -> pa.Array:
    counts, parts = [0] * len(texts), []
    for of, _, start, end, text in _cut(texts):
        for i in of:
            counts[i] += 1
        parts.append(pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(text, texts.type)], ["start", "end", "text"]))
    steps = pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", texts.type)]))
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(counts)], pa.int32()), steps)


def segments(text: Column) -> Column:
    """array of (start, end, text); NULL counts as empty, and gives none. Its rows are as long as the texts: `stepped` holds less."""
    return _segments(text)
