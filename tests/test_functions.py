"""Scalar rules: tables of accepted and rejected values."""

import pytest
from pyspark.sql import functions as F

from steploom.functions import calculator, segmenter, text

CHECKS = [
    ("68", "68.", "exact", None, True), ("1,200", "$1200", "exact", None, True), ("68", "it is not 68", "exact", None, False), ("68", "not 68", "numeric_tol", 0.5, True), ("3.14", "3.141", "numeric_tol", 0.01, True),
    ("3.14", "3.2", "numeric_tol", 0.01, False), ("a, b", "B and a", "set_match", None, True), ("a, b", "a", "set_match", None, False), ("68", "68", "other", None, None),
]


def test_check(spark):
    df = spark.createDataFrame([(*c[:4], i) for i, c in enumerate(CHECKS)], "k string, a string, c string, t double, i int")
    got = {r.i: r.v for r in df.select("i", text.check(F.col("k"), F.col("a"), F.col("c"), F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(CHECKS))] == [c[4] for c in CHECKS]


def test_text_rules(spark):
    df = spark.createDataFrame([("x\n 42 \n\\]\n", "12 48", "5-3", "a b c")], "a string, b string, c string, d string")
    r = df.select(text.final_line(F.col("a")), text.sole_number(F.col("b")), text.sole_number(F.col("c")), text.word_count(F.col("d")), text.unfenced(F.lit("```json\n{}\n```")), text.shortened(F.lit("abcdef"), 4)).first()
    assert tuple(r) == ("42", 1248.0, None, 3, "{}", "abc…")


@pytest.mark.parametrize("said,want", [("2+3*4", "14"), ("10/4", "2.5"), ("9×3=", "27"), ("2**65", None), ("1/0", None), ("__import__('os')", None), ("", None), (None, None), ("1<2", None), ("(-8)**0.5", None)])
def test_calculator(said, want):
    result, error = calculator.evaluate(said)
    assert result == want and (error is None) == (want is not None)


def test_segmenter():
    words = "one two three four five six seven eight nine ten eleven."
    cut = lambda t: [t[a:b] for a, b in segmenter.ranges(segmenter.normalised(t))]
    assert cut("") == []
    assert cut(f"{words} Wait, {words}") == [words, f"Wait, {words}"]
    assert cut(f"{words}\n\nShort one.") == [f"{words}\n\nShort one."]  # merged back
    assert cut(f"Short one.\n\n{words}") == [f"Short one.\n\n{words}"]  # carried forward
    fenced = f"```\n{words} Wait, {words}\n\n{words}"
    assert cut(fenced) == [fenced]  # an open fence runs to the end
    assert len(cut(f"\\[ {words} Wait, {words}")) == 2  # open mathematics protects nothing
    halves = cut(" ".join(["w" * 4 + "."] * 200))
    assert len(halves) == 2 and abs(len(halves[0]) - len(halves[1])) <= 10
    assert cut(" ".join(["word"] * 200)) == [" ".join(["word"] * 200)]


def test_segments_column(spark):
    df = spark.createDataFrame([(1, "😀 Wait, so " + "a b c d e f g h i j k"), (2, None)], "i int, t string")
    got = {r.i: r.s for r in df.select("i", segmenter.segments(F.col("t")).alias("s")).collect()}
    assert got[2] == [] and got[1][0].start == 0
