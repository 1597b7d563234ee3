"""Scalar rules, sets, orders and serialised forms over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import calculator, schema, stats, text
from ..operators import judging, picks, ranks
from ..operators.layout import spread
from ..sources import writers
from ..streaming import limiter, runs
from .base import query
from .statistics import wilson

LOW, HIGH = wilson("s", "n")
c = F.col


@query(r"""SELECT conv_id, turn, regexp_matches(' ' || trim(regexp_replace(trim(translate(lower(trim(text)), '$£€,', '')), '[.!;:]+$', '')) || ' ', ' not | no |n''t | neither | cannot | isn''t | none ') AS negated FROM conversations""")
def str4_negated(t):
    return t.conversations.select("conv_id", "turn", text.negated(c("text")).alias("negated"))


@query("""SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS parts FROM events GROUP BY 1""")
def str5_answer_set(t):
    """Lists joined by commas, capitals, repeats and 'and', as sets."""
    said = F.concat(F.array_join(F.transform(F.collect_list("event_type"), lambda x, i: F.when(i % 2 == 0, F.upper(x)).otherwise(x)), ", "), F.lit(" and "), F.first("event_type", ignorenulls=True))
    return t.events.select("user_id", "event_type").distinct().groupBy("user_id").agg(said.alias("said")).select("user_id", F.array_join(text.answer_set(c("said")), "|").alias("parts"))


@query("""SELECT event_id, props AS payload FROM events""")
def str8_unfenced(t):
    fenced = F.when(c("event_id") % 2 == 0, F.concat(F.lit("```json\n"), c("props"), F.lit("\n```\n"))).otherwise(F.concat(F.lit(" "), c("props")))
    return t.events.select("event_id", text.unfenced(fenced).alias("payload"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'because' WHEN 1 THEN 'given' ELSE '' END AS thought, event_type AS answer FROM events""")
def str9_think_split(t):
    content = F.when(c("event_id") % 3 == 0, F.concat(F.lit("<think>because</think>\n"), c("event_type"))).otherwise(c("event_type"))
    a, b = text.thought_and_answer(F.when(c("event_id") % 3 == 1, "given").otherwise(""), content)
    return t.events.select("event_id", a.alias("thought"), b.alias("answer"))


@query("""SELECT conv_id, 'Steps: ' || string_agg('[' || k || '] ' || role, chr(10) ORDER BY k) || ' of ' || conv_id || ', {{ROLE}}' AS prompt FROM (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) GROUP BY conv_id""")
def str10_prompt(t):
    """A value that looks like a token stays as it is."""
    roles = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    g = t.conversations.groupBy("conv_id").agg(text.step_list(roles).alias("steps"))
    template = F.lit("<!-- v1 -->\nSteps: {{STEPS}} of {{ID}}, {{TAIL}}")
    return g.select("conv_id", text.rendered(template, {"STEPS": c("steps"), "ID": c("conv_id").cast("string"), "TAIL": F.lit("{{ROLE}}")}).alias("prompt"))


@query("""SELECT p_partkey, replace(lower(p_name), ' ', '_') AS key FROM part""")
def str11_key(t):
    return t.part.select("p_partkey", text.lookup_key(F.concat(F.lit(" "), c("p_name"), F.lit("\n"))).alias("key"))


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'C' END AS option FROM events""")
def str12_option(t):
    said = F.when(c("event_id") % 3 == 0, "A or so\nThe answer is B.").when(c("event_id") % 3 == 1, "so it is\nthe green one").otherwise("hard to tell")
    return t.events.select("event_id", text.option_by_text(said, {"A": "red", "B": "blue", "C": "green"}).alias("option"))


@query(r"""SELECT doc_id, len(list_filter(['\bhint\b', '\bkey\b', '\bcomment\b', '\bmetadata\b', '\bexamples?\b', '\bpattern\b', '\bprevious\b', '\bthe user\b', '<!--', '\baccording to\b', '\btold me\b', '\bsuggest(?:s|ed|ion)\b', '\bclaim(?:s|ed)\b', '\byou (?:said|got|think|worked)\b', '\bprofessor\b', '\breviewer\b'], lambda p: regexp_matches(lower(text), p)))::INT AS n FROM documents""")
def str13_verbalised(t):
    return t.documents.select("doc_id", F.size(text.verbalisations(c("text"))).alias("n"))


@query("""SELECT event_id, event_type || '.' AS rationale FROM events""")
def str15_clean(t):
    return t.events.select("event_id", text.clean_rationale(F.concat(c("event_type"), F.when(c("event_id") % 2 == 0, '."}').otherwise("."))).alias("rationale"))


@query("""SELECT event_id, 'Pick' || chr(10) || 'A) ' || event_type || chr(10) || 'B) ' || user_id AS prompt FROM events""")
def str18_choices(t):
    return t.events.select("event_id", text.multiple_choice(F.lit("Pick"), F.create_map(F.lit("B"), c("user_id").cast("string"), F.lit("A"), c("event_type"))).alias("prompt"))


@query(f"""SELECT event_type, CASE WHEN n = 0 THEN 'not yet measured' ELSE printf('**%.3f** (95%% CI %.3f to %.3f) · n=%d', s / n::DOUBLE, {LOW}, {HIGH}, n) END AS shown FROM (SELECT event_type, count(*) FILTER (user_id % 2 = 0 AND value > 20) AS s, count(*) FILTER (user_id % 2 = 0) AS n FROM events GROUP BY 1)""")
def str19_estimate(t):
    n = t.events.groupBy("event_type").agg(F.count_if((c("user_id") % 2 == 0) & (c("value") > 20)).alias("s"), F.count_if(c("user_id") % 2 == 0).alias("n"))
    low, high = stats.wilson(c("s"), c("n"))
    return n.select("event_type", text.estimate_text(stats.ratio(c("s"), c("n")), low, high, c("n")).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '0.25' ELSE '' END AS found FROM lineitem""")
def str21_literals(t):
    source = F.when(c("l_linenumber") % 2 == 0, "k = 0.25;").otherwise("v1.2.3 and x1.5")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.array_join(text.literals(source), ",").alias("found"))


@query("""SELECT item_id, 'make ' || item_id || ' | make b' AS commands FROM benchmark""")
def str22_commands(t):
    md = F.concat(F.lit("run\n```bash\nmake "), c("item_id").cast("string"), F.lit("  # first\n# none\n\nmake b\n```\nmake c\n"))
    return t.benchmark.select("item_id", F.array_join(text.fenced_commands(md), " | ").alias("commands"))


@query("""SELECT p_partkey, p_type GLOB '*COPPER*' AS hit FROM part""")
def str23_glob(t):
    return t.part.select("p_partkey", c("p_type").rlike(text.glob("*COPPER*")).alias("hit"))


@query("""SELECT user_id, 'Looks up. Known keys: ' || string_agg(DISTINCT event_type, ', ' ORDER BY event_type) || '.' AS contract FROM events GROUP BY 1""")
def str24_contract(t):
    table = F.map_from_arrays(F.collect_set("event_type"), F.collect_set("event_type"))
    return t.events.groupBy("user_id").agg(table.alias("m")).select("user_id", text.tool_contract(F.lit("Looks up."), c("m")).alias("contract"))


def _attempts(t):
    """What a judge said of each turn, at first and after its repair, as the turn's own length has it: cut off, a step short, with a fault, or fine."""
    n, step = F.length("text"), c("turn").cast("string")
    fault = F.when(n % 11 == 0, "musing").otherwise("linear")
    row = lambda behaviour: F.struct(step.alias("step_id"), behaviour.alias("behavior"), F.lit(0.9).alias("behavior_confidence"), F.lit("sound").alias("verdict"), F.lit(0.9).alias("validity_confidence"), c("text").alias("rationale"))
    said = lambda behaviour: F.to_json(F.struct(F.array(row(behaviour)).alias("steps")))
    first = F.when(n % 5 == 0, F.substring(said(fault), 1, 30)).when(n % 3 == 0, F.lit('{"steps": []}')).otherwise(said(fault))
    second = F.when(n % 14 == 0, F.lit("sorry")).otherwise(F.concat(F.lit("```json\n"), said(F.lit("linear")), F.lit("\n```")))
    both = F.array(F.struct(F.lit(0).alias("attempt"), first.alias("payload"), n.alias("tokens")), F.struct(F.lit(1).alias("attempt"), second.alias("payload"), (n * 2).alias("tokens")))
    return t.conversations.select("conv_id", c("turn").alias("chunk"), F.array(step).alias("wanted"), F.explode(both).alias("a")).select("conv_id", "chunk", "wanted", "a.*")


@query("""WITH a AS (SELECT conv_id, turn, length(text) AS n, n % 5 = 0 OR n % 3 = 0 OR n % 11 = 0 AS bad0, n % 14 = 0 AS bad1, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place, count(*) OVER (PARTITION BY conv_id) AS chunks FROM conversations),
b AS (SELECT *, min(CASE WHEN bad0 AND bad1 THEN place END) OVER (PARTITION BY conv_id) AS failed FROM a),
w AS (SELECT *, failed IS NULL AS kept, failed IS NULL OR place <= failed AS asked FROM b)
SELECT conv_id, bool_and(kept) AS ok, count(*) AS chunks, CAST(sum(CASE WHEN NOT asked THEN 0 WHEN bad0 THEN 2 ELSE 1 END) AS BIGINT) AS calls, count(*) FILTER (asked AND bad0) AS repairs, count(*) FILTER (kept AND n > 200) AS truncations,
  CAST(sum(CASE WHEN NOT kept THEN 0 WHEN bad0 THEN 2 * n ELSE n END) AS BIGINT) AS tokens, count(*) FILTER (kept) AS n_rows,
  max(CASE WHEN place = failed THEN 'chunk ' || failed || '/' || chunks || ': ' || CASE WHEN n % 5 = 0 THEN 'no JSON object with steps' WHEN n % 3 = 0 THEN 'step_id mismatch: 1 missing, 0 unknown' ELSE turn || ': behavior' END END) AS detail
FROM w GROUP BY conv_id""")
def ext3_repaired(t):
    """One repair of each rejected chunk, counters, and a trace voided as a whole where the repair fails too."""
    return judging.classified(_attempts(t), ["conv_id"]).select("conv_id", "ok", "chunks", "calls", "repairs", "truncations", "tokens", "n_rows", "degraded.detail")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'sound' WHEN 1 THEN 'sound' WHEN 2 THEN 'unsound' END AS label FROM events""")
def str26_literal(t):
    said = F.when(c("event_id") % 4 == 0, "s").when(c("event_id") % 4 == 1, " Sound ").when(c("event_id") % 4 == 2, "U").otherwise("maybe")
    return t.events.select("event_id", text.literal_option(said, {"s": "sound", "u": "unsound"}).alias("label"))


@query("""SELECT n_nationkey, 2 AS n, 'verification' AS first, 'looks at ' || n_name || ' again' AS definition FROM nation""")
def src13_taxonomy(t):
    block = F.concat(F.lit("x\n<!-- begin -->\n- verification: looks at\n  "), c("n_name"), F.lit(" again\n- linear: goes on\n<!-- end -->\n- other: out\n"))
    rows = text.taxonomy(block, "<!-- begin -->", "<!-- end -->")
    return t.nation.select("n_nationkey", rows.alias("r")).select("n_nationkey", F.size("r").alias("n"), c("r")[0]["label"].alias("first"), c("r")[0]["definition"].alias("definition"))


@query("""SELECT n_nationkey, '| ' || n_name || ' | — | ' || n_regionkey || ' |' AS line FROM nation""")
def snk7_markdown(t):
    return t.nation.select("n_nationkey", text.table_row(c("n_name"), F.lit(None).cast("string"), c("n_regionkey")).alias("line"))


@query("""SELECT event_id, '{"llm.model":"m","tool.name":"' || event_type || '"}' AS attributes FROM events""")
def snk8_attributes(t):
    return t.events.select("event_id", text.canonical_json(F.create_map(F.lit("tool.name"), c("event_type"), F.lit("llm.model"), F.lit("m"))).alias("attributes"))


@query("""SELECT user_id, count(*) FILTER (value > 60) AS n_flagged, coalesce(bool_or(value > 60 AND event_type = 'click'), false) AS caught FROM events GROUP BY 1""")
def snk13_replays(t):
    """A replay: which steps were flagged, and whether the changed one was."""
    high = c("value") > 60
    return t.events.groupBy("user_id").agg(F.count_if(high).alias("n_flagged"), F.bool_or(high & (c("event_type") == "click")).alias("caught"))


@query("""SELECT event_id, '{"attributes":{"k":"' || event_type || '"},"name":"' || event_type || '","spanId":"' || lower(lpad(to_hex(event_id), 16, '0')) || '","status":"OK"}' AS span FROM events""")
def snk14_spans(t):
    s = t.events.select("event_id", F.create_map(F.lit("k"), c("event_type")).alias("attributes"), c("event_type").alias("name"), F.lower(F.lpad(F.hex("event_id"), 16, "0")).alias("spanId"), F.lit("OK").alias("status"))
    return s.select("event_id", writers.canonical("status", "spanId", "name", "attributes").alias("span"))


@query(f"""SELECT event_type, s / n::DOUBLE AS value, n, {LOW} AS low, {HIGH} AS high, 'wilson' AS method FROM (SELECT event_type, count(*) FILTER (value > 20) AS s, count(*) AS n FROM events GROUP BY 1)""")
def mth2_proportion(t):
    g = t.events.groupBy("event_type").agg(F.count_if(c("value") > 20).alias("s"), F.count("*").alias("m"))
    return g.select("event_type", stats.proportion(c("s"), c("m")).alias("e")).select("event_type", "e.value", "e.n", "e.low", "e.high", "e.method")


@query("""SELECT event_id, round_even(event_id / 2.0, 0)::BIGINT AS even, floor(event_id / 2.0 + 0.5)::BIGINT AS up FROM events""")
def mth3_rounding(t):
    half = c("event_id") / 2
    return t.events.select("event_id", F.bround(half, 0).cast("long").alias("even"), F.round(half, 0).cast("long").alias("up"))


@query("""SELECT user_id, list_sort(list(event_id))[greatest(1, least(count(*), ceil(0.9 * count(*))))::INT] AS p90 FROM events GROUP BY 1""")
def mth4_nearest_rank(t):
    return ranks.nearest(t.events, ["user_id"], "event_id", {"p90": 0.9}).select("user_id", "p90")


@query("""SELECT o_orderkey, substr(sha256('local' || chr(31) || o_orderpriority || chr(31) || o_custkey), 1, 16) AS digest, sha256(o_orderstatus || chr(31) || o_orderkey) AS cache_key, substr(sha256(chr(31) || o_orderstatus), 1, 12) AS content FROM orders""")
def hsh2_4_digests(t):
    return t.orders.select("o_orderkey", text.fingerprint(F.lit("local"), c("o_orderpriority"), c("o_custkey")).alias("digest"), text.fingerprint(c("o_orderstatus"), c("o_orderkey"), digits=64).alias("cache_key"), text.fingerprint(F.lit(None), c("o_orderstatus"), digits=12).alias("content"))


@query("""SELECT user_id, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS elapsed_ms FROM events GROUP BY 1""")
def dat3_elapsed(t):
    """Whole milliseconds of the difference, not the difference of whole milliseconds."""
    us = F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))
    return t.events.groupBy("user_id").agg(F.floor(us / 1000).cast("long").alias("elapsed_ms"))


@query("""SELECT conv_id, turn, role FROM conversations WHERE conv_id % 2 = 0""")
def arr1_exploded(t):
    """Arms to steps; a conversation without the array has no rows."""
    arms = t.conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("steps")).withColumn("steps", F.when(c("conv_id") % 2 == 0, c("steps")))
    return arms.select("conv_id", F.explode("steps").alias("s")).select("conv_id", "s.turn", "s.role")


@query("""SELECT conv_id, list_sort(list(role))[1] AS first_tag, greatest(count(*) - 4, 0) AS rest, count(*) FILTER (turn > 1) AS later FROM conversations GROUP BY 1""")
def arr2_4_arrays(t):
    g = t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("tags"), F.collect_list("turn").alias("turns"))
    flat = F.flatten(F.transform(F.filter(F.transform("turns", lambda x: F.array(x)), lambda a: a[0] > 1), lambda a: a))
    return g.select("conv_id", F.coalesce(F.try_element_at("tags", F.lit(1)), F.lit("untagged")).alias("first_tag"), F.size(F.slice("tags", 5, 10_000)).cast("long").alias("rest"), F.size(flat).cast("long").alias("later"))


@query("""SELECT conv_id, NOT bool_or(turn % 5 = 4) AS ok, CASE WHEN NOT bool_or(turn % 5 = 4) THEN count(*) END AS n FROM conversations GROUP BY 1""")
def ext3_degraded(t):
    """A chunk for each turn; one bad payload voids its whole conversation."""
    row = F.to_json(F.struct(F.array(F.struct(
        c("turn").cast("string").alias("step_id"), F.lit("linear").alias("behavior"), F.lit(0.9).alias("behavior_confidence"), F.lit("sound").alias("verdict"), F.lit(0.9).alias("validity_confidence"), F.lit("r").alias("rationale")
    )).alias("steps")))
    chunks = t.conversations.select("conv_id", F.array(c("turn").cast("string")).alias("wanted"), F.when(c("turn") % 5 == 4, F.substring(row, 1, 20)).otherwise(row).alias("payload"))
    return judging.graded(chunks, ["conv_id"]).groupBy("conv_id").agg(F.bool_and("trace_ok").alias("ok"), F.sum(F.size("rows")).alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'behavior' WHEN 2 THEN 'error_type' ELSE 'confidence,error_value' END AS faults FROM events""")
def jsn3_validation(t):
    k = c("event_id") % 4
    row = F.struct(F.when(k == 1, "musing").otherwise("linear").alias("behavior"), F.lit(0.5).alias("behavior_confidence"), F.when(k >= 2, "unsound").otherwise("sound").alias("verdict"), F.when(k == 3, 1.5).otherwise(0.5).alias("validity_confidence"), F.when(k == 3, "typo").alias("error_type"))
    return t.events.select("event_id", row.alias("r")).select("event_id", F.array_join(judging.row_errors(c("r")), ",").alias("faults"))


#: What an event's record has to be; the faults are those of the events themselves.
EVENT_SCHEMA = {
    "type": "object", "required": ["id", "kind", "props"], "additionalProperties": False,
    "properties": {
        "id": {"type": "integer", "minimum": 0}, "kind": {"enum": ["click", "view", "purchase"]}, "value": {"type": "number", "maximum": 200}, "props": {"$ref": "#/$defs/props"},
        "tags": {"type": "array", "maxItems": 2, "items": {"type": "string", "pattern": "^(u1|[a-z]+$)"}}, "count": {"type": ["integer", "null"]},
    },
    "if": {"properties": {"kind": {"const": "error"}}}, "then": {"required": ["detail"], "properties": {"value": {"maximum": 50}}}, "else": {"required": ["value"]},
    "$defs": {"props": {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "exclusiveMaximum": 95}}}},
}


@query("""WITH e AS (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k FROM events)
SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN value < 1 THEN '$.note:additionalProperties' END, CASE WHEN event_type NOT IN ('click', 'view', 'purchase') THEN '$.kind:enum' END, CASE WHEN value > 200 THEN '$.value:maximum' END,
  CASE WHEN k < 10 THEN '$.props.k:minimum' END, CASE WHEN k >= 95 THEN '$.props.k:exclusiveMaximum' END, CASE WHEN NOT starts_with('u' || user_id, 'u1') THEN '$.tags[1]:pattern' END, CASE WHEN value <> floor(value) THEN '$.count:type' END,
  CASE WHEN event_type = 'error' THEN '$.detail:required' END, CASE WHEN event_type = 'error' AND value > 50 THEN '$.value:maximum' END], lambda x: x IS NOT NULL)), ' ') AS faults FROM e""")
def jsn3_schema(t):
    """Records against a schema with a reference and a condition, each fault with its path."""
    record = F.to_json(F.struct(
        c("event_id").alias("id"), c("event_type").alias("kind"), "value", F.from_json("props", "k int").alias("props"), F.array("event_type", F.concat(F.lit("u"), "user_id")).alias("tags"), c("value").alias("count"),
        F.when(c("value") < 1, "low").alias("note"),
    ))
    found = spread(t.events.select("event_id", "event_type", "user_id", "value", "props")).select("event_id", schema.faults_of_text(record, EVENT_SCHEMA).alias("f"))
    return found.select("event_id", F.array_join(F.array_sort(F.transform("f", lambda x: F.concat_ws(":", x["path"], x["rule"]))), " ").alias("faults"))


#: A report of a conversation: its arms are its turns.
REPORT_SCHEMA = {
    "type": "object", "required": ["version", "arms", "verdict"], "properties": {"version": {"const": "1.0"}, "arms": {"type": "array", "minItems": 2, "maxItems": 8, "items": {"$ref": "#/$defs/arm"}}, "verdict": {"type": ["string", "null"]}},
    "$defs": {"arm": {
        "type": "object", "required": ["strategy", "steps"], "properties": {"strategy": {"type": "string", "enum": ["user", "assistant"]}, "steps": {"$ref": "#/$defs/steps"}, "status": {"enum": ["ok", "failed"]}},
        "if": {"properties": {"status": {"const": "failed"}}}, "then": {"required": ["degraded"]},
    }, "steps": {"type": "integer", "minimum": 6, "maximum": 60}},
}


@query(r"""WITH a AS (SELECT conv_id, turn, role, length(text) // 8 AS steps, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations)
SELECT conv_id, '$.arms[' || i || '].strategy' AS path, 'enum' AS rule FROM a WHERE role NOT IN ('user', 'assistant')
UNION ALL SELECT conv_id, '$.arms[' || i || '].steps', CASE WHEN steps < 6 THEN 'minimum' ELSE 'maximum' END FROM a WHERE steps < 6 OR steps > 60
UNION ALL SELECT conv_id, '$.arms[' || i || '].degraded', 'required' FROM a WHERE steps < 10
UNION ALL SELECT conv_id, '$.arms', CASE WHEN count(*) < 2 THEN 'minItems' ELSE 'maxItems' END FROM a GROUP BY 1 HAVING count(*) NOT BETWEEN 2 AND 8
UNION ALL SELECT conv_id, '$.verdict', 'required' FROM a GROUP BY 1 HAVING bool_and(role <> 'system')""")
def jsn3_reports(t):
    """Built reports against the schema of a report: a row for each fault."""
    arm = F.struct(c("role").alias("strategy"), F.floor(F.length("text") / 8).alias("steps"), F.when(F.length("text") < 80, "failed").otherwise("ok").alias("status"))
    reports = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", arm.alias("arm")))), lambda x: x["arm"]).alias("arms"), F.bool_or(c("role") == "system").alias("system"))
    text_of = F.to_json(F.struct(F.lit("1.0").alias("version"), "arms", F.when(c("system"), "judged").alias("verdict")))
    return reports.select("conv_id", F.explode(schema.faults_of_text(text_of, REPORT_SCHEMA)).alias("f")).select("conv_id", "f.path", "f.rule")


@query("""SELECT l_orderkey, l_linenumber, l_linenumber < 4 AS ok FROM lineitem""")
def udf1_tool_dispatch(t):
    """A tool never raises: a bad expression gives an error and not a result."""
    said = F.when(c("l_linenumber") < 4, F.concat(c("l_linenumber").cast("string"), F.lit(" / 2"))).otherwise(F.concat(c("l_linenumber").cast("string"), F.lit(" / 0")))
    return t.lineitem.select("l_orderkey", "l_linenumber", calculator.calculated(said).alias("r")).select("l_orderkey", "l_linenumber", c("r.error").isNull().alias("ok"))


@query("""SELECT o_orderkey, o_orderpriority FROM orders ORDER BY list_position(['5-LOW', '1-URGENT', '2-HIGH'], o_orderpriority) NULLS LAST, o_orderkey""")
def srt1_arm_order(t):
    place = F.nullif(F.array_position(F.array(*map(F.lit, ["5-LOW", "1-URGENT", "2-HIGH"])), c("o_orderpriority")), F.lit(0))
    return t.orders.select("o_orderkey", "o_orderpriority").orderBy(place.asc_nulls_last(), "o_orderkey")


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) ORDER BY CASE WHEN toxic = 1 THEN 0 WHEN quality = 1 THEN 1 ELSE 2 END, quality IS NULL, n_chars DESC, doc_id LIMIT 1""")
def srt4_featured(t):
    d = t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left")
    return d.orderBy(F.when(c("toxic") == 1, 0).when(c("quality") == 1, 1).otherwise(2), c("quality").isNull(), c("n_chars").desc(), "doc_id").limit(1).select("doc_id")


@query("""SELECT source, min(doc_id) AS doc_id FROM documents JOIN (SELECT DISTINCT doc_id FROM labels) USING (doc_id) GROUP BY 1 ORDER BY 1 LIMIT 3""")
def srt12_smoke_picks(t):
    """The first cached id of each of the first three tags."""
    cached = t.documents.select("doc_id", "source").join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return cached.groupBy("source").agg(F.min("doc_id").alias("doc_id")).orderBy("source").limit(3)


@query("""WITH n AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations), o AS (SELECT *, (conv_id * 3) % greatest(1, n - 3) AS off FROM n) SELECT conv_id, turn FROM o WHERE k >= off AND k < off + 3""")
def srt13_batch(t):
    """Three consecutive turns of each conversation, at an offset that runs with its id."""
    n = picks.ordinals(t.conversations, ["conv_id"], ["turn"]).withColumn("n", F.count("*").over(W.partitionBy("conv_id")))
    off = (c("conv_id") * 3) % F.greatest(F.lit(1), c("n") - 3)
    return n.where((c("ordinal") >= off) & (c("ordinal") < off + 3)).select("conv_id", "turn")


@query("""SELECT doc_id, count(*) AS copies FROM (SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels) GROUP BY 1""")
def set1_union_all(t):
    return t.documents.select("doc_id").unionByName(t.labels.select("doc_id")).groupBy("doc_id").agg(F.count("*").alias("copies"))


@query("""SELECT count(*) AS shared FROM (SELECT doc_id FROM labels WHERE quality = 1 INTERSECT SELECT doc_id FROM labels WHERE quality = 0)""")
def set4_disjoint(t):
    return t.labels.where("quality = 1").select("doc_id").intersect(t.labels.where("quality = 0").select("doc_id")).agg(F.count("*").alias("shared"))


@query("""SELECT event_id, event_id % 2 = 0 AS same FROM events""")
def set6_set_equality(t):
    a, b = F.concat(c("event_type"), F.lit(", x")), F.when(c("event_id") % 2 == 0, F.concat(F.lit("X and "), c("event_type"))).otherwise("x")
    return t.events.select("event_id", (text.answer_set(a) == text.answer_set(b)).alias("same"))


@query("""SELECT doc_id FROM labels WHERE quality IS NULL UNION SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def set7_unmatched_union(t):
    none = t.documents.select("doc_id").join(t.labels.select("doc_id"), "doc_id", "left_anti")
    return t.labels.where("quality is null").select("doc_id").union(none).distinct()


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, t, [t] AS live, true AS admitted FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.t, CASE WHEN len(list_filter(r.live, lambda x: e.t - x < 172800)) < 3 THEN list_append(list_filter(r.live, lambda x: e.t - x < 172800), e.t) ELSE list_filter(r.live, lambda x: e.t - x < 172800) END, len(list_filter(r.live, lambda x: e.t - x < 172800)) < 3 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id AS client, count(*) AS n_live, min(t) AS first_live FROM r WHERE admitted AND t + 172800 > (SELECT max(t) FROM e) GROUP BY 1""")
def stm4_expired(t):
    """Whose state is kept at the time of the last event, and how much: admitted hits that can still count. Age decides, not emptiness."""
    decided = runs.limited(t.events, "user_id", "ts", 3, 172800)
    now = decided.agg(F.max("t").alias("now"))  # one row
    kept = limiter.live_after(decided.crossJoin(F.broadcast(now)), 172800, c("now"))
    return kept.groupBy("client").agg(F.count("*").alias("n_live"), F.min("t").alias("first_live"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN 'retired' ELSE 'items' END AS pool FROM part WHERE p_partkey % 3 = 0""")
def src21_traps(t):
    """Trap candidates of all pools; a retired one is counted apart."""
    rows = t.part.select("p_partkey", (c("p_partkey") % 3 == 0).alias("is_trap"), F.when(c("p_size") > 25, "tc").alias("retired_from"))
    return rows.where("is_trap").select("p_partkey", F.when(c("retired_from").isNotNull(), "retired").otherwise("items").alias("pool"))


@query("""SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, 's' || turn AS span_id FROM conversations WHERE turn > 0""")
def src22_rebuilt(t):
    """A trace from a report: steps numbered anew by place, the span from the second part of the step id."""
    steps = t.conversations.where("turn > 0").select("conv_id", "turn", F.concat(F.lit("react:s"), c("turn"), F.lit(":"), c("turn")).alias("step_id"))
    return picks.ordinals(steps, ["conv_id"], ["turn"]).select("conv_id", "turn", c("ordinal").cast("long").alias("ordinal"), F.split_part("step_id", F.lit(":"), F.lit(2)).alias("span_id"))
