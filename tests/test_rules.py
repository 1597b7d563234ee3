"""Rules at their edges: NULL groups and large counts, event time, ranges of steps, places in files, bounded arithmetic."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from steploom.functions import calculator, segmenter
from steploom.operators import agreement as A, judging, traces
from steploom.sources import readers, writers
from steploom.streaming import runs

PAIRS = [("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15


def test_kappa_of_a_null_group(spark):
    df = spark.createDataFrame([(k, *p) for k in ("g", None) for p in PAIRS], "k string, a string, b string")
    got = {r.k: r for r in A.kappa_of(A.cells(df, "a", "b", ["k"]), ["k"]).collect()}
    assert math.isclose(got["g"].kappa, 0.4) and got[None].kappa == got["g"].kappa and (got[None].total, got[None].hits) == (50, 35)
    two = spark.createDataFrame([(None, k, "x", "x") for k in (None, "h")] + [("g", None, *p) for p in PAIRS], "j string, k string, a string, b string")
    assert {(r.j, r.k): r.kappa for r in A.kappa_of(A.cells(two, "a", "b", ["j", "k"]), ["j", "k"]).collect()} == {(None, None): None, (None, "h"): None, ("g", None): got["g"].kappa}


def test_kappa_of_large_counts(spark):
    cell = spark.createDataFrame([("x", "x", 4 * 10**18), ("y", "y", 10**18), ("x", "y", 10**18)], "a string, b string, n long")
    po, pe = 5 / 6, (5 * 4 + 1 * 2) / 36
    assert math.isclose(A.kappa_of(cell).first().kappa, (po - pe) / (1 - pe))
    one = spark.createDataFrame([("x", "x", 9 * 10**18)], "a string, b string, n long")
    assert A.kappa_of(one).first().kappa is None
    none = A.kappa_of(one.where("false")).first()
    assert (none.total, none.hits, none.kappa) == (None, 0, None)
    boot = A.bootstrap_kappa(cell, 200).first()
    assert boot.defined == 200 and abs(boot.low - boot.value) < 1e-6 and abs(boot.high - boot.value) < 1e-6


def test_bootstrap_agrees_with_the_large_sample_variance(spark):
    p = [[0.4, 0.1], [0.2, 0.3]]
    n = 2000
    cell = spark.createDataFrame([(str(i), str(j), int(p[i][j] * n)) for i in (0, 1) for j in (0, 1)], "a string, b string, n long")
    row, col = [sum(x) for x in p], [sum(x) for x in zip(*p)]
    po, pe = p[0][0] + p[1][1], sum(a * b for a, b in zip(row, col))
    # Fleiss, Cohen and Everitt (1969).
    a = sum(p[i][i] * ((1 - pe) - (row[i] + col[i]) * (1 - po)) ** 2 for i in (0, 1))
    b = (1 - po) ** 2 * sum(p[i][j] * (col[i] + row[j]) ** 2 for i in (0, 1) for j in (0, 1) if i != j)
    se = math.sqrt((a + b - (po * pe - 2 * pe + po) ** 2) / n) / (1 - pe) ** 2
    got = A.bootstrap_kappa(cell, 4000).first()
    assert abs((got.high - got.low) / 2 - 1.96 * se) < 0.1 * 1.96 * se and abs((got.high + got.low) / 2 - got.value) < 0.2 * se


def test_limiter_stream_over_an_idle_time_and_out_of_order(spark, tmp_path):
    """Two live hits, then nothing for longer than the window of processing time, then the rest, out of order and one too late."""
    batches = [[("c", 100), ("c", 101)], [("d", 102)], [("c", 110), ("c", 105), ("c", 103)], [("c", 150), ("c", 90)], [("c", 161), ("d", 200)], [("e", 400)]]
    folder = tmp_path / "hits"
    for rows in batches:
        spark.createDataFrame(rows, "client string, s int").select("client", F.timestamp_seconds("s").alias("at")).coalesce(1).write.mode("append").parquet(str(folder))
        schema = "client string, at timestamp"
        hits = spark.readStream.schema(schema).parquet(str(folder))
        q = runs.limited_stream(hits, 3, 60, "20 seconds").writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
        assert q.exception() is None
    got = sorted((r.client, r.s, r.admitted) for r in spark.read.parquet(str(tmp_path / "out")).select("client", F.unix_seconds("at").alias("s"), "admitted").collect())
    # 90 is over 20 seconds late and goes; by event time 100, 101 and 103 are admitted, 105 and 110 are not, and 161 finds 103 live no more.
    assert got == [("c", 100, True), ("c", 101, True), ("c", 103, True), ("c", 105, False), ("c", 110, False), ("c", 150, False), ("c", 161, True), ("d", 102, True), ("d", 200, True)]


def test_places_in_label_files(spark, tmp_path):
    rows = [{"step_id": f"s{i % 5}", "behavior_label": f"l{i}", "annotator": "a"} for i in range(400)]
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "a.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n\n")
    (tmp_path / "l" / "held.jsonl").write_text(json.dumps({"step_id": "s1", "behavior_label": "later", "annotator": "a"}))
    path = str(tmp_path / "l")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")  # many splits of one file
    try:
        every = {r.step_id: r.behavior_label for r in readers.live_labels(readers.labels(spark, path)).collect()}
        order = [r.behavior_label for r in readers.labels(spark, path).where("source_file = 'a.jsonl' and step_id is not null").orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert order == [f"l{i}" for i in range(400)]
    assert every == {"s0": "l395", "s1": "later", "s2": "l397", "s3": "l398", "s4": "l399"}
    held = spark.createDataFrame([("s2",)], "step_id string")
    got = {r.step_id: r.behavior_label for r in readers.live_labels(readers.labels(spark, path, held, "held.jsonl")).collect()}
    assert got == {"s0": "l395", "s1": "l396", "s3": "l398", "s4": "l399"}


def test_first_finished_run_by_its_place(spark):
    df = spark.createDataFrame([("i", "failed", 1.0, 0), ("i", "done", 9.0, 1), ("i", "done", 3.0, 2), ("j", "failed", 1.0, 3)], "item string, status string, seconds double, place int")
    assert readers.latency_of(df, "i").first().seconds == 9.0 and readers.latency_of(df, "j").isEmpty()


def test_lines_in_a_bounded_number_of_files(spark, tmp_path):
    df = spark.range(500).select(F.concat(F.lit("i"), "id").alias("item_id"), F.lit("react").alias("strategy"), F.array(F.lit("x")).alias("spans"))
    writers.write_lines(df, str(tmp_path / "w"), ["item_id", "strategy"], 4)
    assert len(list((tmp_path / "w").glob("part-*.json"))) <= 4
    assert sorted(r.item_id for r in spark.read.json(str(tmp_path / "w")).collect()) == sorted(f"i{k}" for k in range(500))


def test_consistency_is_null_where_nothing_was_judged(spark):
    none, some = F.array().cast("array<string>"), F.array(F.lit("s"))
    got = spark.range(1).select(*[judging.consistency_of(F.lit(n), F.lit(v).cast("string"), c).alias(f"c{i}") for i, (n, v, c) in enumerate([(1, "contradicts", some), (2, None, some), (2, "contradicts", none), (2, "contradicts", some)])]).first()
    assert got.c0 is None and got.c1 is None and (got.c2.verdict, got.c2.flagged) == ("underdetermined", False) and (got.c3.verdict, got.c3.flagged) == ("contradicts", True)


def test_calculator_is_bounded_and_follows_the_rules():
    said = {"-2**2": "-4", "2**3**2": "512", "2**-1": "0.5", "7//2": "3", "-7//2": "-4", "7%-4": "-1", "min(3, 1+1,)": "2", "1_000*2": "2000", ".5+1.": "1.5", "floor(2.7)-ceil(2.2)": "-1", "round(2.567, 2)": "2.57", "10÷4=": "2.5", "(1+2)*(3-4)": "-3", "1e3": "1000"}
    assert {k: calculator.evaluate(k)[0] for k in said} == said
    for bad in ["((((9**64)**64)**64)**64)**64", "round(7, -99999999999)", "2(3)", "1 2", "007", "x", "(" * 120 + "1" + ")" * 120, "1,2", "abs", "2**65", "5!", "1__0", "1" * 501, "(9**64)**64*(9**64)**64"]:
        assert calculator.evaluate(bad)[0] is None and calculator.evaluate(bad)[1], bad


WORDS = "one two three four five six seven eight nine ten."


def cut(t):
    text = segmenter.normalised(t)
    return [text[a:b] for a, b in segmenter.ranges(text)]


def test_ranges_of_steps():
    """Texts of our own for each rule, with ranges worked out by hand."""
    assert segmenter.ranges(f"{WORDS} Wait, {WORDS}") == [(0, 49), (50, 105)]
    assert cut(f"{WORDS}\nWait, {WORDS}\nplain {WORDS}") == [WORDS, f"Wait, {WORDS}\nplain {WORDS}"]  # only a marker opens a step
    assert cut(f"{WORDS}\n \t\n\n{WORDS}") == [WORDS, WORDS]  # blank lines part paragraphs
    assert cut(f"<think>{WORDS}</think>\r\n\r\n{WORDS}\r") == [WORDS, WORDS]
    assert cut(f"{WORDS} Waiting {WORDS}") == [f"{WORDS} Waiting {WORDS}"]  # a marker is a word
    assert cut(f"{WORDS} 2) {WORDS} - {WORDS}") == [WORDS, f"2) {WORDS}", f"- {WORDS}"]  # numbered and bulleted
    assert cut(f"{WORDS} Step 3 {WORDS}") == [WORDS, f"Step 3 {WORDS}"]
    assert cut("Short. So short. But short.") == ["Short. So short. But short."]  # fragments only
    assert cut(f"{WORDS} So short. But short.") == [f"{WORDS} So short. But short."]  # join what is before
    fence = f"```py\n{WORDS} Wait, {WORDS}\n\nSo {WORDS}\n```"
    assert cut(f"{fence}\n\n{WORDS}") == [fence, WORDS]
    assert cut(f"~~~\n{WORDS}\n\n{WORDS}") == [f"~~~\n{WORDS}\n\n{WORDS}"]  # an open fence runs on
    for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), ("$$", "$$")):
        shut = f"{a} {WORDS} Wait, {WORDS}\n\n{WORDS} {b}"
        assert cut(f"{shut} Then {WORDS}") == [f"{shut} Then {WORDS}"]
        assert len(cut(f"{a} {WORDS} Wait, {WORDS}")) == 2  # not closed: no shield
    assert cut(" " + WORDS + " 😀 𝒳. Wait, " + WORDS) == [WORDS + " 😀 𝒳.", "Wait, " + WORDS]  # code points, and white space of all kinds
    assert cut(" \n\t ") == []


def test_long_ranges_are_halved_at_the_nearest_start():
    even = " ".join(f"{'w ' * 9}w{i}." for i in range(16))  # 160 words, a start every 10
    halves = cut(even)
    assert len(halves) == 2 and halves[0].endswith("w7.") and halves[1].endswith("w15.")
    assert cut(" ".join(["word"] * 300)) == [" ".join(["word"] * 300)]  # no start, no cut
    inside = "```\n" + " ".join(f"{'w ' * 9}w{i}." for i in range(30)) + "\n```"
    assert cut(inside) == [inside]


def brute_cover(spans, at):
    return any(a < at < b for a, b in spans)


def test_shields_equal_a_search_of_all_ranges():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice(["```", "~~~", r"\[", r"\]", r"\(", r"\)", "$$", "x", " ", "\n"]) for _ in range(rng.randint(0, 40)))
        code = [m.span() for m in segmenter.CODE.finditer(text)]
        spans = code + [m.span() for m in segmenter.MATHS.finditer(text) if not brute_cover(code, m.start())]
        got = segmenter.Shields(text)
        assert [got.cover(i) for i in range(len(text) + 1)] == [brute_cover(spans, i) for i in range(len(text) + 1)], text


def test_linear_traces(spark):
    """Direct and thinking arms: the first call's reasoning by the segmenter, then the last call's answer; other calls add no thoughts."""
    span = lambda kind, pos, **a: '{"name":"n","spanId":"s%d","attributes":%s}' % (pos, json.dumps({"openinference.span.kind": kind, **a}))
    call = lambda pos, seq, reasoning, content: span("LLM", pos, **{"app.seq": seq, "llm.output_messages.0.message.reasoning": reasoning, "llm.output_messages.0.message.content": content})
    rows = [("i", "thinking", 0, span("CHAIN", 0, **{"app.strategy": "thinking"})), ("i", "thinking", 1, call(1, 2, "later thoughts are not read", " The answer\n7 ")), ("i", "thinking", 2, call(2, 1, f"{WORDS} Wait, {WORDS}", "draft")), ("i", "direct", 0, call(3, 1, "", "8")), ("j", "direct", 0, call(4, 1, "  ", "  "))]
    raw = spark.createDataFrame(rows, "item_id string, strategy string, pos int, j string").withColumn("span", F.parse_json("j")).drop("j")
    s = traces.spans(raw, "app")
    steps = traces.steps(traces.calls(s), traces.tools(s))
    got = {}
    for r in steps.orderBy("item_id", "strategy", "ordinal").collect():
        got.setdefault((r.item_id, r.strategy), []).append((r.step_id, r.kind, r.text, r.start, r.end))
    second = len(WORDS) + 1
    assert got == {
        ("i", "direct"): [("direct:s3:0", "answer", "8", None, None)],
        ("i", "thinking"): [("thinking:s2:0", "thought", WORDS, 0, len(WORDS)), ("thinking:s2:1", "thought", f"Wait, {WORDS}", second, second + len(WORDS) + 6), ("thinking:s1:2", "answer", "The answer\n7", None, None)],
    }
    assert traces.violations(steps).isEmpty()


@pytest.mark.parametrize("change,rule", [("ordinal + 5", "dense"), ("ordinal", "step_id")])
def test_violations_are_found(spark, change, rule):
    """A check that never fires would pass on tables without faults."""
    df = spark.createDataFrame([("i", "direct", "direct:s:0", 0, "thought", "s"), ("i", "direct", "direct:s:1", 1, "answer", "s")], "item_id string, strategy string, step_id string, ordinal int, kind string, span_id string")
    assert traces.violations(df).isEmpty()
    bad = df.withColumn("ordinal", F.expr(change)) if rule == "dense" else df.withColumn("step_id", F.lit("direct:s:1"))
    assert rule in {r.rule for r in traces.violations(bad).collect()}
    assert "answer" in {r.rule for r in traces.violations(df.withColumn("kind", F.lit("answer"))).collect()}
