"""Queries that write what they derive from the tables as files in the shared folder, and read it back by the readers of such files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from ..operators import picks, traces
from ..operators.layout import shared_dir
from ..sources import readers, run_log, writers
from .base import query
from .texts import steps_of

c = F.col


def _folder(t, name: str) -> str:
    """A new folder in the one that all tasks see."""
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def _trees(t) -> DataFrame:
    """A span tree of each conversation, its turns as calls, written as lines and read back."""
    attributes = F.struct(
        F.lit("LLM").alias("openinference.span.kind"), c("turn").alias("app.seq"), c("text").alias("llm.output_messages.0.message.reasoning"), F.concat(F.lit(" "), c("text"), F.lit("\n")).alias("llm.output_messages.0.message.content"),
        F.length("text").alias("llm.token_count.completion"),
    )
    span = F.struct("turn", c("role").alias("name"), F.concat(F.lit("s"), c("turn")).alias("spanId"), attributes.alias("attributes"))
    rows = t.conversations.groupBy(c("conv_id").cast("string").alias("item_id")).agg(F.array_sort(F.collect_list(span)).alias("spans")).select("item_id", F.lit("thinking").alias("strategy"), "spans")
    path = _folder(t, "trees")
    writers.write_lines(rows, path, ["item_id", "strategy"], 8)
    return traces.spans(readers.span_lines(t.spark, path), "app")


@query("""SELECT conv_id::VARCHAR AS item_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, role AS name, 's' || turn AS span_id, turn::INT AS seq, length(text)::BIGINT AS completion_tokens, md5(text) AS reasoning FROM conversations""")
def src1_span_trees(t):
    """Trees that were written are read back as typed spans."""
    return _trees(t).select("item_id", "pos", "name", "span_id", "seq", "completion_tokens", F.md5("reasoning").alias("reasoning"))


@query("SELECT doc_id::VARCHAR AS item_id, ordinal, 'thought' AS kind, start, \"end\", text FROM (" + steps_of("(SELECT conv_id AS doc_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1)") + r""") UNION ALL
SELECT conv_id::VARCHAR, n::INT, 'answer', NULL, NULL, regexp_replace(arg_max(text, turn), '^\s+|\s+$', '', 'g') FROM conversations JOIN (SELECT d.conv_id, count(s.doc_id) AS n FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN (""" + steps_of("(SELECT conv_id AS doc_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1)") + """) s ON s.doc_id = d.conv_id GROUP BY 1) USING (conv_id) GROUP BY conv_id, n""")
def seg11_linear(t):
    """Steps of linear traces: the first call's reasoning by the segmenter, then the last call's answer."""
    s = _trees(t)
    return traces.steps(traces.calls(s), traces.tools(s)).select("item_id", "ordinal", "kind", "start", "end", "text")


@query("""WITH o AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS o, turn, role, text FROM conversations)
SELECT conv_id || ':react' AS trace, 'react:s' || turn || ':' || o AS step_id, text FROM o WHERE role <> 'assistant'""")
def src23_thoughts(t):
    """The corpus of thought steps of all traces, with their trace's name."""
    kind = F.when(c("role") == "assistant", "answer").otherwise("thought")
    rows = t.conversations.select(c("conv_id").cast("string").alias("item_id"), F.lit("react").alias("strategy"), F.concat(F.lit("s"), "turn").alias("span_id"), "turn", kind.alias("kind"), "text")
    steps = picks.ordinals(rows, ["item_id"], ["turn"]).withColumn("step_id", F.concat_ws(":", "strategy", "span_id", "ordinal"))
    return readers.thoughts(steps)


@query("""SELECT p_partkey::VARCHAR AS id, p_name AS prompt, CASE WHEN p_size % 2 = 0 THEN p_brand || '|' || p_type ELSE p_name END AS answers, p_size % 2 = 0 AS answer_is_list, p_brand AS tag FROM part""")
def src3_bank(t):
    """A bank of items whose answer is a list for some and one value for others."""
    answer = F.when(c("p_size") % 2 == 0, F.to_json(F.array("p_brand", "p_type"))).otherwise(F.to_json(F.array("p_name")))
    one = F.when(c("p_size") % 2 == 0, answer).otherwise(F.regexp_extract(answer, r"^\[(.*)\]$", 1))
    head = F.to_json(F.struct(c("p_partkey").cast("string").alias("id"), c("p_name").alias("prompt"), F.array("p_brand").alias("tags")))
    path = _folder(t, "bank")
    writers.write_arrays(t.part.select(F.concat(F.substring(head, 1, F.length(head) - 1), F.lit(',"known_answer":'), one, F.lit("}")).alias("value")), path, 8)
    return readers.items(t.spark, path).select("id", "prompt", F.array_join("answers", "|").alias("answers"), "answer_is_list", c("tags")[0].alias("tag"))


@query("""SELECT doc_id::VARCHAR AS step_id, 'a' AS annotator, CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END AS label FROM labels UNION ALL SELECT doc_id::VARCHAR, 'b', CASE WHEN toxic = 1 THEN 'toxic' ELSE 'clean' END FROM labels WHERE doc_id % 10 <> 3""")
def src6_labels(t):
    """Labels of two annotators, appended one after the other; held-out steps of the second go."""
    path = _folder(t, "labels")
    row = lambda who, label: t.labels.select(c("doc_id").cast("string").alias("step_id"), label.alias("behavior_label"), F.lit(who).alias("annotator"))
    held = t.labels.where("doc_id % 10 = 3").select(c("doc_id").cast("string").alias("step_id"))
    writers.append_labels(row("a", F.when(c("quality") == 1, "good").otherwise("bad")), path)
    writers.append_labels(row("b", F.when(c("toxic") == 1, "toxic").otherwise("clean")), f"{path}-b")
    live = readers.live_labels(readers.labels(t.spark, path).unionByName(readers.labels(t.spark, f"{path}-b", held)))
    return live.select("step_id", "annotator", c("behavior_label").alias("label"))


def _reports(t) -> DataFrame:
    """A report of each conversation: an arm for each role, a step for each turn."""
    step = F.struct(F.concat_ws(":", "conv_id", "turn").alias("step_id"), F.lit("thought").alias("kind"), F.struct(c("role").alias("label")).alias("behavior"), F.struct(F.when(F.length("text") > 200, "sound").otherwise("unsound").alias("verdict")).alias("validity"))
    arms = t.conversations.groupBy("conv_id", "role").agg(F.array_sort(F.collect_list(step)).alias("steps")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(c("role").alias("strategy"), "steps"))).alias("arms"))
    path = _folder(t, "reports")
    writers.write_arrays(arms.select(F.to_json(F.struct(F.struct(c("conv_id").cast("string").alias("id")).alias("item"), "arms")).alias("value")), path, 8)
    return readers.reports(t.spark, path)


@query("""SELECT conv_id || ':' || turn AS step_id, conv_id::VARCHAR AS item_id, role AS strategy, role AS behavior, CASE WHEN length(text) > 200 THEN 'sound' ELSE 'unsound' END AS verdict, 1 AS copies FROM conversations""")
def src5_unique_predictions(t):
    """Predictions of all reports; a step that two of them had would be an error."""
    return readers.predictions(_reports(t), unique=True).select("step_id", "item_id", "strategy", "behavior", "verdict", "copies")


@query("""SELECT doc_id::VARCHAR AS key, source || '/' || lang AS value FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL""")
def src7_facts(t):
    """Fact corpora of all sources."""
    rows = t.documents.where("source is not null and lang is not null").groupBy("source", (c("doc_id") % 16).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(c("doc_id").cast("string").alias("key"), F.concat_ws("/", "source", "lang").alias("value")))).alias("facts"))
    path = _folder(t, "facts")
    writers.write_arrays(rows.select(F.to_json(F.struct("facts")).alias("value")), path, 8)
    return readers.facts(t.spark, path)


@query("""WITH p AS (SELECT o_orderpriority AS k, count(*) AS n, CASE WHEN min(o_orderkey) % 2 = 0 THEN 'cut' ELSE 'whole' END AS how FROM orders GROUP BY 1)
SELECT CASE WHEN how = 'whole' THEN k END AS k, CASE WHEN how = 'whole' THEN n END AS n FROM p""")
def src9_tolerant(t):
    """Artefacts, some of them cut off in the middle: those are NULL."""
    rows = t.orders.groupBy(c("o_orderpriority").alias("k")).agg(F.count("*").alias("n"), (F.min("o_orderkey") % 2 == 0).alias("cut"))
    text = F.to_json(F.struct("k", "n"))
    path = _folder(t, "artefacts")
    rows.select("k", F.when(c("cut"), F.substring(text, 1, 12)).otherwise(text).alias("value")).repartition("k").write.partitionBy("k").text(path)
    return readers.tolerant(t.spark, path, "k:string,n:bigint").select("value.k", "value.n")


@query("""SELECT o_custkey AS item, o_orderstatus AS cue, arg_min(o_totalprice, o_orderkey) AS score FROM orders GROUP BY 1, 2""")
def src10_trials(t):
    """Trials of all files, each (item, cue) as it was first tried."""
    trial = F.struct("o_orderkey", c("o_custkey").alias("item"), c("o_orderstatus").alias("cue"), c("o_totalprice").alias("score"))
    path = _folder(t, "trials")
    files = t.orders.groupBy((c("o_custkey") % 8).alias("part")).agg(F.array_sort(F.collect_list(trial)).alias("trials"))
    files.select("part", F.to_json(F.struct("trials")).alias("value")).write.partitionBy("part").text(path)
    return readers.trials(t.spark, path, "item:bigint,cue:string,score:double", ["item", "cue"]).select("item", "cue", "score")


@query("""SELECT conv_id::VARCHAR AS case_id, 's' || max(turn) AS mutated_step_id, count(*) FILTER (length(text) < 200) AS n_flagged, bool_or(role = 'system') AS flagged FROM conversations GROUP BY 1""")
def src17_replays(t):
    """Replayed cases with the steps that were flagged."""
    rows = t.conversations.groupBy(c("conv_id").cast("string").alias("case_id")).agg(
        F.concat(F.lit("s"), F.max("turn")).alias("mutated_step_id"), F.bool_or(c("role") == "system").alias("judge_flagged_the_mutated_step"), F.sort_array(F.collect_list(F.when(F.length("text") < 200, F.concat(F.lit("s"), "turn")))).alias("judge_flagged_steps")
    )
    path = _folder(t, "replays")
    writers.write_arrays(rows.select(F.to_json(F.struct("*")).alias("value")), path, 8)
    return readers.replays(t.spark, path).select("case_id", "mutated_step_id", F.size("judge_flagged_steps").cast("long").alias("n_flagged"), c("judge_flagged_the_mutated_step").alias("flagged"))


@query("""SELECT event_type || '.' || event_id AS name, md5(props) AS digest, props AS payload, CASE WHEN event_type IN ('click', 'view') THEN 'analysis' ELSE 'generation' END AS kind FROM events""")
def snk5_cassettes(t):
    """Recorded responses with the manifest that names what was recorded: in the shared folder, as one version."""
    path = _folder(t, "cassettes")
    rows = t.events.select(F.concat_ws(".", "event_type", "event_id").alias("name"), F.md5("props").alias("digest"), c("props").alias("payload"))
    run_log.tape(rows, path, ["click", "view"])
    return run_log.tapes(t.spark, path)


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(value), 6) AS spent, count(*) AS n FROM events GROUP BY 1""")
def snk12_booked(t):
    """Spend booked in two versions of a ledger, the second on what the first has left."""
    path = _folder(t, "ledger")
    spend = t.events.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), c("value").alias("spent"), "event_type")
    run_log.book(spend.where("event_type = 'click'").select("day", "spent"), path)
    run_log.book(spend.where("event_type <> 'click' or event_type is null").select("day", "spent"), path)
    return run_log.ledger(t.spark, path).select("day", F.round("spent", 6).alias("spent"), "n")
