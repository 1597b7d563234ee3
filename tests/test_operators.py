"""Relational operators on small tables, null rules included."""

import math

from pyspark.sql import functions as F

from steploom.operators import agreement as A, guards, joins, judging, picks, ranks, traces
from steploom.streaming import runs


def test_kappa_and_nulls(spark):
    df = spark.createDataFrame([("x", "x"), ("x", "x"), (None, "x"), ("", "x")], "a string, b string")
    assert A.kappa_of(A.cells(df, "a", "b")).first().kappa is None  # chance agreement is certain
    df = spark.createDataFrame([("x", "x")] * 20 + [("x", "y")] * 5 + [("y", "x")] * 10 + [("y", "y")] * 15, "a string, b string")
    assert math.isclose(A.kappa_of(A.cells(df, "a", "b")).first().kappa, 0.4)
    boot = A.bootstrap_kappa(A.cells(df, "a", "b"), 500).first()
    assert boot.low < 0.4 < boot.high and boot.defined == 500


def test_per_class(spark):
    df = spark.createDataFrame([("x", "y"), ("x", "x")], "a string, b string")
    got = {r["class"]: r for r in A.per_class(df, "a", "b", ["x", "y", "z"]).collect()}
    assert got["y"].f1 is None and got["y"].precision == 0.0 and got["y"].recall is None
    assert math.isclose(got["x"].f1, 2 / 3) and got["z"].precision is None
    c = A.confusion(df, "a", "b", ["x"]).first()
    assert (c.n, c.n_dropped) == (1, 1)


def test_empty_estimate(spark):
    e = A.by_group(spark.createDataFrame([("g", 1)], "k string, v int"), ["k"], F.col("v") == 1).first().estimate
    assert e.value == 1.0 and math.isclose(e.low, 0.2065493, rel_tol=1e-5)


def test_picks(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c")], "k int, at int, v string")
    assert picks.newest(df, ["k"], ["at", "v"]).first().v == "c" and picks.first(df, ["k"], ["at", "v"]).first().v == "a"
    assert [r.start for r in picks.offsets(df, ["k"], ["at", "v"], "v").orderBy("at", "v").collect()] == [0, 3, 6]
    assert picks.capped(df, ["k"], ["at"], 2).count() == 2


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "")], "k int, l string")
    b = spark.createDataFrame([(1, "p"), (2, None), (5, "p")], "k int, p string")
    assert [r.k for r in joins.paired(a, b, "k", "l", "p").collect()] == [1]
    assert [r.k for r in joins.unmatched(a, b, "k", "l", "p").collect()] == [2]
    assert tuple(joins.reconciled(a, b, "k").first()) == (2, 1, 2)


def test_graded_degrades_whole_trace(spark):
    row = '{"step_id":"%s","behavior":"linear","behavior_confidence":0.9,"verdict":"sound","validity_confidence":0.9,"error_type":null,"rationale":"r"}'
    ok = '```json\n{"steps":[%s]}\n```'
    df = spark.createDataFrame([("t", ["a"], ok % (row % "a")), ("t", ["b"], "not json"), ("u", ["a"], ok % (row % "a")), ("v", ["a"], ok % (row % "other"))], "trace string, wanted array<string>, payload string")
    got = {r.trace: r.rows for r in judging.graded(df, ["trace"]).collect()}
    assert got["t"] is None and got["v"] is None and got["u"][0].verdict == "sound"


def test_consistency_and_breaker(spark):
    r = spark.range(1).select(judging.consistency(F.lit("contradicts"), F.array().cast("array<string>")).alias("c"), guards.breaker(F.lit(None).cast("double"), F.lit(False), F.lit(1.0)).alias("b"), guards.breaker(F.lit(None).cast("double"), F.lit(True), F.lit(1.0)).alias("d")).first()
    assert r.c.verdict == "underdetermined" and r.c.downgraded and not r.c.flagged and not r.b.allowed and r.d.allowed


def test_limiter(spark):
    times = [0.0, 10.0, 20.0, 30.0, 60.0, 61.0, 70.0]
    got = spark.range(1).select(runs.admitted(F.array(*map(F.lit, times)), 3, 60).alias("a")).first().a
    assert [x.admitted for x in got] == [True, True, True, False, True, False, True]


def test_limiter_stream(spark, tmp_path):
    rows = [("c", i, t) for i, t in enumerate([0, 10, 20, 30, 60, 61, 70])]
    df = spark.createDataFrame(rows, "client string, i int, s int").select("client", F.timestamp_seconds("s").alias("at"))
    df.coalesce(1).write.parquet(str(tmp_path / "hits"))
    q = runs.limited_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "hits")), 3, 60).writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [r.admitted for r in spark.table("limited").orderBy("at").collect()] == [True, True, True, False, True, False, True]


def test_trace_ingest(spark):
    span = lambda kind, pos, **a: '{"name":"n","spanId":"s%d","attributes":%s}' % (pos, __import__("json").dumps({"openinference.span.kind": kind, **a}))
    rows = [
        span("CHAIN", 0, **{"app.strategy": "react"}), span("LLM", 1, **{"app.seq": 1, "llm.output_messages.0.message.reasoning": "think", "llm.output_messages.0.message.content": "", "llm.token_count.prompt": 3}),
        span("TOOL", 2, **{"app.seq": 2, "tool.name": "calc", "input.value": {"b": 1}, "output.value": " 4 "}), span("LLM", 3, **{"app.seq": 3, "llm.output_messages.0.message.content": "The answer\n4"}),
    ]
    raw = spark.createDataFrame([("i", "react", k, r) for k, r in enumerate(rows)], "item_id string, strategy string, pos int, j string").withColumn("span", F.parse_json("j")).drop("j")
    s = traces.spans(raw, "app")
    t = traces.traces(s).first()
    assert (t.final_answer, t.trace_quality, t.input_tokens, t.reasoning_tokens, t.turns) == ("4", "full", 3, None, 2)
    steps = traces.steps(traces.calls(s), traces.tools(s))
    got = [(r.kind, r.text, r.step_id) for r in steps.orderBy("ordinal").collect()]
    assert got == [("thought", "think", "react:s1:0"), ("tool_call", 'calc({"b":1})', "react:s2:1"), ("observation", "4", "react:s2:2"), ("answer", "The answer\n4", "react:s3:3")]
    assert traces.violations(steps).isEmpty()


def test_exact_ranks(spark):
    """Against sorted values: ties, a group larger than the sketch is accurate for, NULLs, a NULL key, one row."""
    many = [("big", float((i * 7919) % 50021)) for i in range(50021)] + [("ties", 5.0)] * 400 + [("ties", 1.0), ("one", 3.0), (None, 2.0), (None, 4.0), ("none", None)]
    df = spark.createDataFrame(many, "k string, v double")
    got = {r.k: r for r in ranks.nearest(df, ["k"], "v", {"p50": 0.5, "p90": 0.9, "top": 1.0}).collect()}
    for k in ("big", "ties", "one", None):
        vs = sorted(v for x, v in many if x == k)
        assert [got[k][c] for c in ("p50", "p90", "top")] == [vs[max(1, math.ceil(p * len(vs))) - 1] for p in (0.5, 0.9, 1.0)], k
    assert "none" not in got
    middle = {r.k: r.m for r in ranks.medians(df, ["k"], "v", "m").collect()}
    assert (middle["big"], middle["ties"], middle[None], middle["one"]) == (25010.0, 5.0, 3.0, 3.0)
    assert ranks.medians(df.where("k = 'x'"), [], "v").isEmpty()


def test_capped_and_selected(spark):
    rows = [("a", i, "unsound" if i % 2 else "sound", i / 20) for i in range(20)] + [(None, 99, "unsound", None)]
    df = spark.createDataFrame(rows, "t string, i int, verdict string, validity_confidence double")
    got = sorted(((r.t or "", r.i, r.n, r.capped) for r in picks.capped(df, ["t"], ["i"], 2).collect()))
    assert got == [("", 99, 1, False), ("a", 0, 20, True), ("a", 1, 20, True)]
    s = judging.selected(df, ["t"], judging.doubtful(F.col("verdict"), F.col("validity_confidence"), F.lit("")), "i", cap=3).collect()
    assert sorted((r.t or "", r.i, r.n_steps, r.n_selected, r.capped) for r in s) == [("", 99, 1, 1, False), ("a", 1, 20, 17, True), ("a", 3, 20, 17, True), ("a", 5, 20, 17, True)]
    plan = picks.capped(df, ["t"], ["i"], 2)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
