"""Table functions of the segmenter, for SQL: steps of a text, and of a trace whose texts come as rows."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession, types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from .segmenter import normalised, ranges

STEP = T.StructType([T.StructField("ordinal", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())])


def steps(text: str | None) -> Iterator[tuple[int, int, int, str]]:
    whole = normalised(text or "")
    for k, (a, b) in enumerate(ranges(whole)):
        yield k, a, b, whole[a:b]


class TextSteps:
    """text_steps(text): ordinal, start, end, text of the steps of one text; NULL counts as empty."""

    @staticmethod
    def analyze(text: AnalyzeArgument) -> AnalyzeResult:
        if text.isTable or not isinstance(text.dataType, (T.StringType, T.NullType)):
            raise Exception("text_steps takes a text")
        return AnalyzeResult(STEP)

    def eval(self, text: str | None) -> Iterator[tuple]:
        yield from steps(text)


class TraceSteps:
    """trace_steps(TABLE(key, order, text) PARTITION BY key ORDER BY order): key and the steps of the key's texts, joined by blank lines.

    The texts of one key are held together, as the segmenter needs them. Empty and NULL texts take no room.
    """

    def __init__(self):
        self.key, self.texts = None, []

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable or [f.name for f in rows.dataType.fields[::2]] != ["key", "text"] or len(rows.dataType.fields) != 3:
            raise Exception("trace_steps takes a table of key, an order, and text")
        return AnalyzeResult(T.StructType([rows.dataType.fields[0], *STEP.fields]))

    def eval(self, row) -> None:
        self.key = row[0]
        if row[2]:
            self.texts.append(row[2])

    def terminate(self) -> Iterator[tuple]:
        for step in steps("\n\n".join(self.texts)):
            yield self.key, *step


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_steps", udtf(TextSteps, useArrow=True))
    spark.udtf.register("trace_steps", udtf(TraceSteps, useArrow=True))
