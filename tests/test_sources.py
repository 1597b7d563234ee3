"""Readers and writers on files, malformed ones included, and the event log as a stream."""

import json

from pyspark.sql import functions as F

from steploom.operators import guards, rules
from steploom.sources import readers, writers
from steploom.streaming import runs


def put(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, body in files.items():
        (folder / name.replace("__", ".")).write_text(body if isinstance(body, str) else json.dumps(body))
    return str(folder)


def test_span_files(spark, tmp_path):
    path = put(tmp_path / "s", i1__react__json={"resourceSpans": [{"name": "a"}, {"name": "b"}]}, i2__direct__json=[{"name": "c"}], i3__direct__json="{oops")
    got = {(r.item_id, r.strategy, r.pos, r.n) for r in readers.span_files(spark, path).select("item_id", "strategy", "pos", F.try_variant_get("span", "$.name", "string").alias("n")).collect()}
    assert got == {("i1", "react", 0, "a"), ("i1", "react", 1, "b"), ("i2", "direct", 0, "c"), ("i3", "direct", None, None)}


def test_items_and_facts(spark, tmp_path):
    path = put(tmp_path / "i", a__json={"id": "a", "known_answer": ["x", "y"], "checker": "set_match"}, b__json={"id": "b", "known_answer": "68"})
    got = {r.id: (r.answers, r.answer_is_list) for r in readers.items(spark, path).collect()}
    assert got == {"a": (["x", "y"], True), "b": (["68"], False)}
    assert [tuple(r) for r in readers.facts(spark, put(tmp_path / "f", f__json={"facts": {"k": "v"}})).collect()] == [("k", "v")]


def test_labels_newest_and_default_annotator(spark, tmp_path):
    path = put(tmp_path / "l", dev__jsonl='{"step_id":"s1","behavior_label":"linear"}\n\n{"step_id":"s1","behavior_label":"verification","annotator":"b"}\n')
    got = [(r.step_id, r.behavior_label, r.annotator) for r in readers.labels(spark, path).where("step_id is not null").orderBy("line_no").collect()]
    assert got == [("s1", "linear", "dev"), ("s1", "verification", "b")]


def test_predictions(spark, tmp_path):
    step = lambda label: {"step_id": "s", "kind": "thought", "behavior": {"label": label}}
    report = lambda label: {"item": {"id": "i"}, "arms": [{"strategy": "direct", "steps": [step(label)]}, {"strategy": "react"}]}
    r = readers.reports(spark, put(tmp_path / "r", a__json=report("linear"), b__json=report("verification")))
    one = readers.predictions(r).first()
    assert (one.behavior, one.verdict, one.copies) == ("verification", None, 2)
    try:
        readers.predictions(r, unique=True).collect()
    except Exception as e:
        assert "several predictions" in str(e)
    else:
        raise AssertionError("a repeated step has to abort")


def test_tolerant_trials_and_draw(spark, tmp_path):
    path = put(tmp_path / "t", good__json={"n": 1}, bad__json="{", other__json="[1]")
    assert {r.file_name: r.value and r.value.n for r in readers.tolerant(spark, path, "n:int").collect()} == {"good.json": 1, "bad.json": None, "other.json": None}
    path = put(tmp_path / "u", a__json={"trials": [{"k": "x", "v": 1}, {"k": "x", "v": 2}]}, b__json={"trials": [{"k": "x", "v": 3}, {"k": "y", "v": 4}]})
    assert {(r.k, r.v) for r in readers.trials(spark, path, "k:string,v:int", ["k"]).collect()} == {("x", 1), ("y", 4)}
    path = put(tmp_path / "d", s__json={"draw": {"ordered_step_ids": ["a", "b", "c"]}})
    assert [tuple(r) for r in readers.held_out_ids(spark, path, 1).orderBy("pos").collect()] == [(1, "b"), (2, "c")]
    path = put(tmp_path / "p", b__json={"case_id": "2", "report": {"item": {"id": "i"}}}, a__json={"case_id": "1", "judge_flagged_steps": ["s"]})
    assert [(r.case_id, r.judge_flagged_steps) for r in readers.replays(spark, path).collect()] == [("1", ["s"]), ("2", None)]


def test_recorded(spark, tmp_path):
    rows = spark.createDataFrame([("g.a", "d1", "p"), ("classify.b", None, "q"), ("g.c", "old", "r")], "name string, digest string, payload string")
    writers.record(rows, str(tmp_path / "rec"))
    back = spark.read.schema("name string, digest string, payload string").json(str(tmp_path / "rec"))
    wanted = spark.createDataFrame([("g.a", "d1"), ("classify.b", "d2"), ("g.c", "new"), ("none", "x")], "name string, digest string")
    got = {r.name: (r.payload, r.refused) for r in readers.recorded(back, wanted).collect()}
    assert got == {"g.a": ("p", False), "classify.b": ("q", False), "g.c": (None, True), "none": (None, False)}
    assert {r.kind: r.n for r in writers.manifest(back, ["classify"]).collect()} == {"generation": 2, "analysis": 1}


def test_settings_and_guards(spark):
    spark.conf.set("app.pin.model", "m-1")
    row = readers.pin(spark, ["model", "effort"], "app.pin")
    assert row.select(guards.unpinned({k: F.col(k) for k in row.columns})).first()[0] == ["effort"]
    assert readers.setting(spark, "app.none", "here") == "here"
    got = spark.range(1).select(rules.trap_outcome(F.lit("7"), F.lit("8"), F.lit(None).cast("array<string>"), F.lit("exact"), F.lit(None).cast("double")), guards.vintage(F.lit(None), F.lit("b"), F.lit(None)), runs.precheck(F.lit(58))["reason"]).first()
    assert tuple(got) == ("other", "undeclared", "call budget exhausted")


def test_writers(spark, tmp_path):
    spans = spark.createDataFrame([("i", "react", [("a",)])], "item_id string, strategy string, spans array<struct<name:string>>")
    writers.write_spans(spans, str(tmp_path / "w"))
    assert spark.read.text(str(tmp_path / "w")).first().value == '{"resourceSpans":[{"name":"a"}]}'
    writers.append_labels(spark.createDataFrame([("s",)], "step_id string"), str(tmp_path / "a"))
    writers.append_labels(spark.createDataFrame([("s",)], "step_id string"), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a")).count() == 2


def test_event_log(spark, tmp_path):
    e = spark.createDataFrame([("r", 1, "accepted", "ok", None, 1), ("r", 1, "accepted", "ok", None, 1), ("r", 2, "assembling", "ok", None, 2)], "run_id string, seq long, stage string, status string, detail string, s int").withColumn("at", F.timestamp_seconds("s"))
    runs.append_events(e, str(tmp_path / "log"))
    q = runs.tailed(runs.event_log(spark, str(tmp_path / "log"))).writeStream.format("memory").queryName("tailed").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r.seq for r in spark.table("tailed").collect()) == [1, 2]


def test_limiter_keeps_state_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    rows = [("c", t) for t in (0, 10, 20, 30, 60, 61, 70)] + [("d", 5), (None, 1), (None, 2), ("d", None)]
    df = spark.createDataFrame(rows, "client string, s int").withColumn("at", F.timestamp_seconds("s"))
    got = runs.limited(df, "client", "at", 3, 60).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert [r.admitted for r in sorted((r for r in got if r.client == "c"), key=lambda r: r.t)] == [True, True, True, False, True, False, True]
    assert sorted((str(r.client), r.admitted) for r in got if r.client != "c") == [("None", True), ("None", True), ("d", False), ("d", True)]
