"""Span trees made of conversations (a span a turn), and what is read from them: calls, tools, traces, steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import joins, traces
from ..sources import writers
from ..streaming import frames, runs
from .base import query


def spans(t):
    """A turn of the assistant is an LLM span, of the user a TOOL span, of the system the root. Attributes are left out as a tracer would leave them out."""
    said, user, turn = F.col("role") == "assistant", F.col("role") == "user", F.col("turn")
    attributes = F.struct(
        F.when(said, "LLM").when(user, "TOOL").otherwise("CHAIN").alias("openinference.span.kind"), F.when(~said & ~user, "react").alias("app.strategy"), F.when(turn % 2 == 0, turn * 10).alias("app.seq"), F.when(turn % 3 == 0, turn).alias("app.turn"),
        F.when(said, F.col("text")).alias("llm.output_messages.0.message.content"), F.when(said & (turn % 3 > 0), F.substring("text", 1, 20)).alias("llm.output_messages.0.message.reasoning"), F.when(said, F.length("text")).alias("llm.token_count.prompt"), F.when(said & (turn % 5 > 0), turn * 3).alias("llm.token_count.completion"),
        F.when(said & (turn % 4 == 1), turn).alias("app.token_count.reasoning"), F.when(user & (turn % 4 == 0), "calc").alias("tool.name"), F.when(user, F.col("text")).alias("input.value"), F.when(user, F.col("text")).alias("output.value"),
    )
    span = F.parse_json(F.to_json(F.struct(F.col("role").alias("name"), F.concat(F.lit("s"), F.col("conv_id") * 1000 + turn).alias("spanId"), attributes.alias("attributes"))))
    return traces.spans(t.conversations.select(F.col("conv_id").cast("string").alias("item_id"), F.lit("react").alias("strategy"), turn.alias("pos"), span.alias("span")), "app")


STRIPPED = r"regexp_replace(coalesce({}, ''), '^\s+|\s+$', '', 'g')"
SEQ = "CASE WHEN turn % 2 = 0 THEN turn * 10 ELSE turn END"
TURNS = f"""SELECT conv_id::VARCHAR AS item_id, turn, conv_id * 1000 + turn AS span, role, coalesce(text, '') AS text, {SEQ} AS seq, CASE WHEN turn % 3 > 0 THEN substr(coalesce(text, ''), 1, 20) ELSE '' END AS reasoning, CASE WHEN turn % 4 = 0 THEN 'calc' ELSE 'user' END AS tool FROM conversations"""


@query("""SELECT CASE role WHEN 'assistant' THEN 'LLM' WHEN 'user' THEN 'TOOL' ELSE 'CHAIN' END AS kind, count(*) AS n FROM conversations GROUP BY 1""")
def flt1_by_kind(t):
    return spans(t).groupBy("kind").agg(F.count("*").alias("n"))


@query("""SELECT conv_id::VARCHAR AS item_id, min(turn) AS pos FROM conversations WHERE role NOT IN ('assistant', 'user') GROUP BY 1""")
def flt2_roots(t):
    root = spans(t).where("kind = 'CHAIN' and root_strategy is not null")
    return root.groupBy("item_id").agg(F.min("pos").alias("pos"))


@query(f"""SELECT item_id, 's' || span AS span_id, CASE WHEN turn % 3 = 0 THEN turn ELSE 0 END::INT AS turn, reasoning, text AS content FROM ({TURNS}) WHERE role = 'assistant'""")
def flt3_calls(t):
    return traces.calls(spans(t)).select("item_id", "span_id", "turn", "reasoning", "content")


@query(f"""SELECT item_id, 's' || span AS span_id, tool AS name, text AS arguments, text AS observation FROM ({TURNS}) WHERE role = 'user'""")
def flt4_tools(t):
    return traces.tools(spans(t)).select("item_id", "span_id", "name", "arguments", "observation")


@query(f"""SELECT item_id, turn AS pos, seq FROM ({TURNS})""")
def flt5_seq(t):
    return spans(t).select("item_id", "pos", F.col("seq").cast("long").alias("seq"))


@query(f"""SELECT item_id, CASE WHEN bool_or(reasoning <> '') AND {STRIPPED.format('arg_max(text, seq)')} <> '' THEN 'full' ELSE 'partial' END AS trace_quality FROM ({TURNS}) WHERE role = 'assistant' GROUP BY 1""")
def flt6_quality(t):
    return traces.traces(spans(t)).select("item_id", "trace_quality")


@query("""SELECT conv_id::VARCHAR AS item_id, sum(length(text))::BIGINT AS input_tokens, sum(CASE WHEN turn % 5 > 0 THEN turn * 3 ELSE 0 END)::BIGINT AS output_tokens, sum(CASE WHEN turn % 4 = 1 THEN turn END)::BIGINT AS reasoning_tokens, count(*) AS turns FROM conversations WHERE role = 'assistant' GROUP BY 1""")
def agg1_usage(t):
    return traces.traces(spans(t)).select("item_id", "input_tokens", "output_tokens", "reasoning_tokens", "turns")


_PARTS = f"""WITH c AS ({TURNS}), parts AS (SELECT item_id, seq, 0 AS sub, 'thought' AS kind, {STRIPPED.format('reasoning')} AS text, span FROM c WHERE role = 'assistant' AND {STRIPPED.format('reasoning')} <> ''
UNION ALL SELECT item_id, seq, 1, 'tool_call', tool || '(' || text || ')', span FROM c WHERE role = 'user' UNION ALL SELECT item_id, seq, 2, 'observation', {STRIPPED.format('text')}, span FROM c WHERE role = 'user'
UNION ALL SELECT * FROM (SELECT item_id, 2147483647, 0, 'answer', {STRIPPED.format('arg_max(text, seq)')} AS text, arg_max(span, seq) FROM c WHERE role = 'assistant' GROUP BY 1) WHERE text <> '')"""


@query(f"""{_PARTS} SELECT item_id, 'react:s' || span || ':' || (row_number() OVER (PARTITION BY item_id ORDER BY seq, sub) - 1) AS step_id, kind, text FROM parts""")
def seg12_react_steps(t):
    s = spans(t)
    return traces.steps(traces.calls(s), traces.tools(s)).select("item_id", "step_id", "kind", "text")


@query(f"""{_PARTS} SELECT item_id, span, text FROM parts WHERE kind = 'answer'""")
def seg13_answers(t):
    s = spans(t)
    steps = traces.steps(traces.calls(s), traces.tools(s)).where("kind = 'answer'")
    return steps.select("item_id", F.substring("span_id", 2, 20).cast("long").alias("span"), "text")


@query(f"""{_PARTS} SELECT kind, count(*) AS n, count(DISTINCT item_id) AS traces FROM parts WHERE kind <> 'answer' GROUP BY 1""")
def flt8_labellable(t):
    s = spans(t)
    steps = traces.steps(traces.calls(s), traces.tools(s)).where(F.col("kind").isin("thought", "tool_call", "observation"))
    return steps.groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("item_id").alias("traces"))


@query(f"""{_PARTS} SELECT 'dense' AS rule, count(DISTINCT item_id) AS n FROM parts WHERE item_id::BIGINT % 10 = 0 UNION ALL SELECT 'all', count(DISTINCT item_id) + count(*) FROM parts WHERE item_id::BIGINT % 10 = 0""")
def seg14_invariants(t):
    """Broken invariants of the steps: none but where the ordinals are moved by one on purpose, in every tenth trace (a gap each, and a step_id of another ordinal for each step)."""
    s = spans(t)
    steps = traces.steps(traces.calls(s), traces.tools(s))
    bad = traces.violations(steps.withColumn("ordinal", F.col("ordinal") + F.when(F.col("item_id").cast("long") % 10 == 0, 1).otherwise(0)))
    return bad.agg(F.count_if(F.expr("rule = 'dense'")).alias("dense"), F.count("*").alias("all")).select(F.explode(F.create_map(F.lit("dense"), F.col("dense"), F.lit("all"), F.col("all"))).alias("rule", "n"))


@query(f"""SELECT item_id, 's' || span AS span_id, seq, text FROM ({TURNS}) c WHERE role = 'user' AND EXISTS (SELECT 1 FROM ({TURNS}) a WHERE a.item_id = c.item_id AND a.turn = c.turn + 1 AND a.role = 'assistant')""")
def jon17_calls_of_turn(t):
    """Tool calls with the assistant turn that follows them."""
    s = spans(t)
    said = s.where("kind = 'LLM'").select("item_id", (F.col("pos") - 1).alias("pos"))
    used = s.where("kind = 'TOOL'").select("item_id", "pos", "span_id", F.col("seq").cast("long").alias("seq"), F.col("output").alias("text"))
    return used.join(said, ["item_id", "pos"], "left_semi").drop("pos")


@query("""SELECT conv_id, turn, 'event: progress' || chr(10) || 'data: {"seq":' || turn || ',"stage":"' || role || '","status":"ok","detail":"d"}' || chr(10) || chr(10) AS value FROM conversations""")
def snk10_frames(t):
    e = t.conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.col("role").alias("stage"), F.lit("ok").alias("status"), F.lit("d").alias("detail"))
    return e.select("conv_id", "turn", writers.frame().alias("value"))


@query("""SELECT conv_id, turn, '{"conv_id":' || conv_id || ',"role":"' || role || '","turn":' || turn || '}' AS line FROM conversations""")
def snk1_canonical(t):
    return t.conversations.select("conv_id", "turn", writers.canonical("turn", "role", "conv_id").alias("line"))


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn >= 3 THEN 'assembling' ELSE role END AS stage, CASE WHEN length(text) < 40 THEN 'failed' ELSE 'ok' END AS status FROM conversations),
m AS (SELECT *, CASE WHEN status = 'failed' THEN 'failed' WHEN stage = 'assembling' THEN 'done' END AS fin, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM e),
k AS (SELECT *, count(fin) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM m)
SELECT conv_id AS run_id, turn AS seq, 'progress' AS kind, stage, status FROM k WHERE place = turn AND ended = 0 UNION ALL SELECT conv_id, turn + 1, 'end', NULL, fin FROM k WHERE place = turn AND ended = 0 AND fin IS NOT NULL""")
def stm1_frames(t):
    """What a subscriber of each run sees, though each event is logged twice: all from the first on, and the end last."""
    stage = F.when((F.col("role") == "assistant") & (F.col("turn") >= 3), frames.LAST_STAGE).otherwise(F.col("role"))
    e = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), stage.alias("stage"), F.when(F.length("text") < 40, "failed").otherwise("ok").alias("status"), F.lit("d").alias("detail"), F.lit(0.0).alias("at"))
    return frames.framed(e.unionByName(e.withColumn("at", F.lit(1.0)))).select("run_id", "seq", "kind", "stage", "status")


@query("""SELECT conv_id AS run_id, turn AS seq, role AS stage FROM conversations""")
def stm2_replay(t):
    """Every event once, though each is logged twice."""
    e = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("role").alias("stage"), F.lit(0.0).alias("at"))
    return runs.replayed(e.unionByName(e.withColumn("at", F.lit(1.0)))).select("run_id", "seq", "stage")


@query("""SELECT conv_id AS run_id, CASE WHEN arg_max(role, turn) = 'assistant' AND count(*) FILTER (length(text) < 40) = 0 THEN 'done' ELSE 'failed' END AS status FROM conversations GROUP BY 1""")
def stm6_completion(t):
    """Only a run whose last stage is the last of all, with no failure before, is done."""
    stage = F.when(F.col("role") == "assistant", runs.STAGES[-1]).otherwise(runs.STAGES[0])
    e = t.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), stage.alias("stage"), F.when(F.length("text") < 40, "failed").otherwise("ok").alias("status"))
    return runs.states(e).select("run_id", "status")


@query("""SELECT conv_id FROM conversations GROUP BY 1 ORDER BY count(*) DESC, conv_id DESC LIMIT 32""")
def stm7_registry(t):
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return runs.newest_runs(n.select("conv_id", F.struct("n", "conv_id").alias("at")), "at").select("conv_id")


@query("""SELECT conv_id, list_sort(list(turn)) = list_sort(list(turn) || [99]) AS same, count(*) FILTER (turn < 2) AS kept, 1 AS extra FROM conversations GROUP BY 1""")
def jon14_id_check(t):
    """Returned ids with one too many, and cited ids that the trace has."""
    ids = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.col("turn").cast("int"))).alias("ids"))
    check = joins.id_check(F.col("ids"), F.concat("ids", F.array(F.lit(99))))
    known = joins.cited(F.col("ids"), F.array(F.lit(0), F.lit(77), F.lit(1)))
    return ids.select("conv_id", check.alias("c"), known.alias("k")).select("conv_id", F.col("c.ok").alias("same"), F.size("k").cast("long").alias("kept"), F.size("c.extra").alias("extra"))


@query(r"""SELECT conv_id, string_agg(k || '. ' || CASE WHEN length(x) > 30 THEN substr(x, 1, 30) || ' …' ELSE x END, chr(10) ORDER BY k) AS prompt FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, replace(text, chr(10), ' ') AS x FROM conversations WHERE text IS NOT NULL) GROUP BY 1""")
def str25_numbered(t):
    """Turns as a numbered list of snippets."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"])
    return t.conversations.where("text is not null").groupBy("conv_id").agg(lines.alias("lines")).select("conv_id", F.array_join(text.numbered(F.col("lines"), 30), "\n").alias("prompt"))
