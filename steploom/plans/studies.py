"""Rules, audits and samples over the test tables: each binds an operator to columns with the same shape."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import stats, text
from ..operators import audits, picks, reports, rules
from . import texts  # noqa: F401  registers str14_visible, whose SQL is reused
from .base import SQL, query
from .statistics import wilson

LOW, HIGH = wilson("s", "n")
_ARMS = """SELECT o_custkey, max(CASE WHEN o_orderpriority = '5-LOW' THEN (o_orderstatus = 'F')::INT END) = 1 AS d, max(CASE WHEN o_orderpriority = '1-URGENT' THEN (o_orderstatus = 'F')::INT END) = 1 AS t,
max(CASE WHEN o_orderpriority = '2-HIGH' THEN (o_orderstatus = 'F')::INT END) = 1 AS r, count(*) FILTER (o_orderpriority = '1-URGENT') AS u, count(*) FILTER (o_orderpriority = '5-LOW') AS l, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders GROUP BY 1"""


def arms(t):
    ok, prio = F.col("o_orderstatus") == "F", F.col("o_orderpriority")
    had = lambda k: F.bool_or(F.when(prio == k, ok))
    return t.orders.groupBy("o_custkey").agg(
        had("5-LOW").alias("d"), had("1-URGENT").alias("t"), had("2-HIGH").alias("r"), F.count_if(prio == "1-URGENT").alias("u"), F.count_if(prio == "5-LOW").alias("l"), F.count_if(F.col("o_orderstatus") == "P").alias("p")
    )


RATIO = "CASE WHEN u > 0 AND l > 0 THEN u / l::DOUBLE END"


def _ratio():
    return stats.ratio(stats.falsy_to_null(F.col("u")), stats.falsy_to_null(F.col("l")))


@query(f"""WITH a AS ({_ARMS}), b AS (SELECT *, {RATIO} AS x FROM a) SELECT o_custkey, CASE WHEN o_custkey % 2 = 0 AND r AND (d IS NOT NULL OR t IS NOT NULL) AND NOT coalesce(d, false) AND NOT coalesce(t, false) THEN 'Only the tool-using agent could ground this — the others guessed fluently.'
WHEN t AND NOT d AND floor(x * 4) / 4 <> 0 THEN 'Thinking earned its tokens here: +100 pp accuracy for ' || floor(x * 4) / 4 || '× the output cost.' WHEN d IS NOT DISTINCT FROM t AND floor(x * 4) / 4 >= 3 THEN 'Extended thinking spent ' || floor(x * 4) / 4 || '× the output tokens of Direct for the same answer.'
WHEN p > 0 THEN p || ' step(s) flagged; 0 confirmed by the escalated judge.' END AS line FROM b""")
def flt23_verdict_line(t):
    x = (F.floor(_ratio() * 4) / 4).cast("double")
    delta = 100.0 * (F.col("t").cast("int") - F.col("d").cast("int"))
    return arms(t).select("o_custkey", reports.verdict_line(F.col("d"), F.col("t"), F.col("r"), F.col("o_custkey") % 2 == 0, F.when(_ratio().isNotNull(), x), delta, F.col("p"), F.lit(0).cast("long")).alias("line"))


@query(f"""WITH a AS ({_ARMS}) SELECT o_custkey, CASE WHEN (coalesce(d, false) OR coalesce(t, false) OR coalesce(r, false)) AND (NOT coalesce(d, true) OR NOT coalesce(t, true) OR NOT coalesce(r, true)) THEN CASE WHEN r THEN 'tool' ELSE 'accuracy' END WHEN u > 0 AND l > 0 THEN 'cost' ELSE 'plain' END AS kind FROM a""")
def flt24_headline_kind(t):
    return arms(t).select("o_custkey", rules.headline_kind(F.col("d"), F.col("t"), F.col("r"), _ratio()).alias("kind"))


@query(f"""WITH a AS ({_ARMS}) SELECT o_custkey, CASE WHEN d AND p > 1 THEN 0 WHEN NOT d AND p > 1 THEN 1 WHEN (d OR t) AND (d IS NULL OR NOT d OR t IS NULL OR NOT t) THEN 2 END AS rank FROM a""")
def flt25_start_rank(t):
    both = F.array(F.struct(F.col("d").alias("correct"), F.when(F.col("p") > 1, F.col("p")).otherwise(0).alias("unsound")), F.struct(F.col("t").alias("correct"), F.lit(None).cast("long").alias("unsound")))
    return arms(t).select("o_custkey", rules.start_rank(both).alias("rank"))


@query(f"""WITH a AS ({_ARMS}) SELECT o_custkey, CASE WHEN d IS NULL OR t IS NULL THEN NULL WHEN u = 0 THEN 'unverified' WHEN l / u::DOUBLE > 0.5 THEN 'collapse' END AS regime FROM a""")
def flt26_regime(t):
    return arms(t).select("o_custkey", rules.regime(F.col("d").isNotNull() & F.col("t").isNotNull(), F.col("l"), F.col("u")).alias("regime"))


@query("""SELECT event_id, CASE WHEN event_type = 'view' THEN 'another tool' WHEN event_id % 4 = 1 THEN 'arguments are not JSON' WHEN event_id % 4 = 2 THEN 'arguments are empty or no object' END AS reason FROM events""")
def flt36_tool_call(t):
    expect = F.when(F.col("event_type") == "view", "lookup").otherwise(F.col("event_type"))
    args = F.when(F.col("event_id") % 4 == 1, F.substring("props", 1, 5)).when(F.col("event_id") % 4 == 2, F.lit("{}")).otherwise(F.col("props"))
    return t.events.select("event_id", rules.tool_call(F.col("event_type"), args, expect)["reason"].alias("reason"))


@query("""SELECT conv_id, CASE conv_id % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'step_id_mismatch' WHEN 2 THEN 'invalid_json' WHEN 3 THEN 'no_steps_array' WHEN 4 THEN 'invalid_enum' ELSE 'transport_error' END AS outcome FROM conversations GROUP BY conv_id""")
def flt37_batch_outcome(t):
    ids = t.conversations.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("turn")), lambda x: x.cast("string")).alias("ids"))
    m = F.col("conv_id") % 6
    given = F.when(m == 1, F.concat("ids", F.array(F.lit("x")))).otherwise(F.col("ids"))
    rows = F.transform(given, lambda i: F.struct(i.alias("step_id"), F.when(m == 4, "musing").otherwise("linear").alias("behavior"), F.lit("sound").alias("verdict")))
    whole = F.to_json(F.struct(rows.alias("steps")))
    payload = F.when(m == 2, F.substring(whole, 1, 9)).when(m == 3, F.lit('{"steps": "none"}')).when(m < 5, whole)
    return ids.select("conv_id", rules.batch_outcome(payload, F.col("ids")).alias("outcome"))


@query("""SELECT event_type, avg(value) < 20 AS short FROM events GROUP BY 1""")
def flt38_shortfall(t):
    return t.events.groupBy("event_type").agg(F.avg("value").alias("v")).select("event_type", rules.short_of(F.col("v"), F.lit(20)).alias("short"))


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN 'planted' WHEN quality = 0 THEN 'illustrative' ELSE 'measured' END AS provenance FROM documents LEFT JOIN labels USING (doc_id)""")
def flt39_provenance(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", rules.provenance(F.col("quality") == 0, F.col("toxic") == 1).alias("provenance"))


@query("""SELECT event_id, CASE WHEN json_extract_string(props, '$.k') IS NOT NULL THEN 'reasoning.k' ELSE '' END AS carrying, CASE WHEN event_type = 'error' THEN 'output' ELSE '' END AS buried FROM events""")
def flt43_reasoning(t):
    k = F.get_json_object("props", "$.k")
    blob = F.when(F.col("event_type") == "error", F.lit('{"reasoning": "x"}')).otherwise(F.lit("{}"))
    found = rules.reasoning(F.create_map(F.lit("reasoning.k"), k, F.lit("output"), blob), ["reasoning", "thought"])
    return t.events.select("event_id", found.alias("r")).select("event_id", F.array_join("r.carrying", ",").alias("carrying"), F.array_join("r.buried", ",").alias("buried"))


@query("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'no trap answers' ELSE 'accepts a trap answer' END AS faults FROM part""")
def flt44_trap_lint(t):
    k = F.col("p_partkey")
    traps = F.when(k % 3 == 0, F.array((k + 1).cast("string"))).when(k % 3 == 2, F.array(F.concat(k.cast("string"), F.lit("."))))
    return t.part.select("p_partkey", F.array_join(rules.trap_faults(k.cast("string"), traps, F.lit("exact"), F.lit(None).cast("double")), ",").alias("faults"))


@query("""SELECT conv_id, turn, CASE WHEN coalesce(length(text), 0) = 0 THEN CASE WHEN role = 'user' AND turn > 0 THEN 'EXPECTED' ELSE 'FAIL' END WHEN turn > 0 AND length(text) / turn::DOUBLE < 40 THEN 'SUMMARY' WHEN role = 'user' THEN 'UNEXPECTED' ELSE 'PASS' END AS verdict FROM conversations""")
def flt45_fidelity(t):
    return t.conversations.select("conv_id", "turn", rules.fidelity(F.col("text"), F.col("turn"), F.col("turn") * 20, F.col("role") == "user").alias("verdict"))


@query("""SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'unset' WHEN 1 THEN 'alias' WHEN 2 THEN 'same as analyzer' END AS refusal FROM supplier""")
def flt46_pin_refusal(t):
    k = F.col("s_suppkey")
    pin = F.when(k % 4 == 0, " ").when(k % 4 == 1, "tier-latest").when(k % 4 == 2, "tier-2024-01-01").otherwise(F.concat(F.lit("tier-"), k.cast("string")))
    return t.supplier.select("s_suppkey", rules.pin_refusal(pin, F.lit("tier-2024-01-01")).alias("refusal"))


@query("""SELECT c_custkey, c_custkey % 3 = 0 OR (c_acctbal > 0 AND c_custkey % 5 > 0) AS ready, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_acctbal IS NULL OR c_acctbal <= 0 THEN 'key missing' WHEN c_custkey % 5 = 0 THEN 'model missing' END AS reason FROM customer""")
def flt47_readiness(t):
    k = F.col("c_custkey")
    r = rules.readiness(F.when(k % 3 == 0, "local").otherwise("hybrid"), F.col("c_acctbal") > 0, F.when(k % 5 > 0, "m"))
    return t.customer.select("c_custkey", r.alias("r")).select("c_custkey", "r.ready", "r.reason")


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'held-out set missing' WHEN 1 THEN 'not frozen' WHEN 2 THEN 'bundle changed since the freeze' END AS refusal FROM nation""")
def flt48_final_refusal(t):
    k = F.col("n_nationkey")
    freeze = F.when(k % 4 == 2, "bundle old").when(k % 4 == 3, F.concat(F.lit("bundle "), k.cast("string")))
    return t.nation.select("n_nationkey", rules.final_refusal(k % 4 > 0, freeze, k.cast("string")).alias("refusal"))


@query(f"""WITH v AS ({SQL["str14_visible"]}) SELECT page_id, concat_ws(',', CASE WHEN length(visible) < 800 THEN 'short' END, CASE WHEN NOT contains(lower(visible), 'the') THEN 'phrase' END, CASE WHEN contains(lower(html), 'ads.example.com') OR contains(lower(html), 'fr/8') THEN 'host' END) AS faults FROM v JOIN pages USING (page_id)""")
def flt50_page_lint(t):
    return t.pages.select("page_id", F.array_join(rules.page_faults(text.visible(F.col("html")), F.col("html"), "the", 800, ["ads.example.com", "fr/8"]), ",").alias("faults"))


_PRICES = [("1-URGENT", 10.0, 30.0), ("2-HIGH", 5.0, None), ("5-LOW", 1.0, 2.0)]


@query("""SELECT o_orderkey, (100 * pi + (o_orderkey % 50) * po) / 1e6 AS usd FROM orders LEFT JOIN (VALUES ('1-URGENT', 10.0::DOUBLE, 30.0::DOUBLE), ('2-HIGH', 5.0, NULL), ('5-LOW', 1.0, 2.0)) p(model, pi, po) ON model = o_orderpriority""")
def jon16_price_lookup(t):
    prices = F.broadcast(t.spark.createDataFrame(_PRICES, "model string, pi double, po double"))  # a price list: one row a model
    j = t.orders.join(prices, F.col("o_orderpriority") == F.col("model"), "left")
    return j.select("o_orderkey", reports.cost(F.lit(100), F.col("o_orderkey") % 50, F.col("pi"), F.col("po"), F.col("model").isNotNull()).alias("usd"))


@query("""SELECT user_id, event_type, count(*) AS n FROM events e WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id AND b.event_type = e.event_type AND b.value < 0.5) GROUP BY ALL""")
def jon18_without_baseline(t):
    """Trials (kinds of events of a user) none of which is a baseline (of next to no value)."""
    baseline = t.events.where("value < 0.5").select("user_id", "event_type").distinct()
    return t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n")).join(baseline, ["user_id", "event_type"], "left_anti")


@query("""SELECT user_id, coalesce(string_agg(DISTINCT event_type, ',' ORDER BY event_type) FILTER (value > 20 AND event_type <> 'click' AND NOT ok), '') AS collateral FROM (SELECT e.*, event_type IN (SELECT event_type FROM events b WHERE b.user_id = e.user_id AND b.value < 0.5) AS ok FROM events e) GROUP BY 1""")
def jon21_collateral(t):
    per = t.events.groupBy("user_id").agg(F.collect_set(F.when(F.col("value") > 20, F.col("event_type"))).alias("flags"), F.collect_set(F.when(F.col("value") < 0.5, F.col("event_type"))).alias("base"))
    return per.select("user_id", F.array_join(audits.collateral(F.col("flags"), F.lit("click"), F.col("base")), ",").alias("collateral"))


@query("""SELECT source, count(*) AS n, count(l.doc_id) AS cached FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1""")
def jon22_cached_by_tag(t):
    flags = t.labels.select("doc_id").distinct().withColumn("cached", F.lit(1))
    return t.documents.select("doc_id", "source").join(flags, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n"), F.count("cached").alias("cached"))


_KIND = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderpriority END"
_HIT = "CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END"


def cases(t):
    hit = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F")
    return t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("kind"), hit.alias("hit"), (hit & (F.col("o_orderkey") % 3 > 0)).alias("triage"))


@query(f"""SELECT n AS n_graded, s AS n_hits, s / n::DOUBLE AS value, {LOW} AS low, {HIGH} AS high FROM (SELECT count(h) AS n, count(*) FILTER (h) AS s FROM (SELECT {_HIT} AS h FROM orders))""")
def agg18_recall(t):
    return audits.recall(cases(t), F.col("hit")).select("n_graded", "n_hits", "recall.value", "recall.low", "recall.high")


@query(f"""SELECT coalesce(k, '?') AS kind, count(*) FILTER (h) || '/' || count(*) AS caught FROM (SELECT {_KIND} AS k, {_HIT} AS h FROM orders) WHERE h IS NOT NULL GROUP BY 1""")
def agg19_recall_by_type(t):
    return audits.recall_by_type(cases(t), "kind", F.col("hit"))


@query(f"""SELECT count(*) FILTER (h) - count(*) FILTER (h AND k % 3 > 0) AS delta FROM (SELECT o_orderkey AS k, {_HIT} AS h FROM orders)""")
def agg20_escalation_delta(t):
    return audits.escalation_delta(cases(t), F.col("hit"), F.col("triage"), F.lit(True))


_STEPS = """SELECT source, d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN NULL WHEN d.doc_id % 3 = 0 THEN 'unsound' WHEN d.doc_id % 3 = 1 THEN 'unverifiable' ELSE 'sound' END AS v,
CASE WHEN toxic = 1 THEN 'unsound' WHEN quality = 0 THEN 'unverifiable' WHEN quality = 1 THEN 'sound' END AS h FROM documents d LEFT JOIN labels USING (doc_id)"""


def steps(t):
    k = F.col("doc_id")
    v = F.when(k % 7 == 0, F.lit(None).cast("string")).when(k % 3 == 0, "unsound").when(k % 3 == 1, "unverifiable").otherwise("sound")
    h = F.when(F.col("toxic") == 1, "unsound").when(F.col("quality") == 0, "unverifiable").when(F.col("quality") == 1, "sound")
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left").select("doc_id", "source", v.alias("v"), h.alias("h"))


@query(f"""SELECT n AS flags, s AS hits_strict, b AS hits_symmetric, s / n::DOUBLE AS strict, b / n::DOUBLE AS symmetric, {LOW} AS low, {HIGH} AS high FROM (SELECT count(*) AS n, count(*) FILTER (h = 'unsound') AS s, count(*) FILTER (h IN ('unsound', 'unverifiable')) AS b FROM ({_STEPS}) WHERE v IN ('unsound', 'unverifiable'))""")
def agg21_pooled_precision(t):
    p = audits.pooled_precision(steps(t).where("v in ('unsound', 'unverifiable')"), F.lit(False), F.col("h"))
    return p.select("flags", "hits_strict", "hits_symmetric", F.col("strict.value").alias("strict"), F.col("symmetric.value").alias("symmetric"), "strict.low", "strict.high")


_TABLE = f"""SELECT source, count(*) AS steps, count(*) FILTER (v IS NOT NULL AND h IS NOT NULL) AS labelled, count(*) FILTER (v IN ('unsound', 'unverifiable')) AS flags, count(*) FILTER (v IN ('unsound', 'unverifiable') AND h = 'sound') AS false_flags FROM ({_STEPS}) GROUP BY 1"""


@query(f"""SELECT s AS false_flags, n AS labelled, s / n::DOUBLE AS value FROM (SELECT sum(false_flags)::BIGINT AS s, sum(labelled)::BIGINT AS n FROM ({_TABLE}))""")
def agg22_false_flag_rate(t):
    return audits.false_flag_rate(audits.flag_table(steps(t), "source", F.col("v"), F.col("h"))).select("false_flags", "labelled", "rate.value")


@query(_TABLE)
def agg23_flag_table(t):
    return audits.flag_table(steps(t), "source", F.col("v"), F.col("h"))


@query("""SELECT n, f AS flagged, d AS downgrades, f / nullif(n, 0)::DOUBLE AS rate, n > 0 AND f = 0 AS met FROM (SELECT count(*) AS n, count(*) FILTER (toxic = 1) AS f, count(*) FILTER (toxic = 0 AND quality = 0) AS d FROM labels WHERE quality IS NOT NULL AND doc_id % 5 > 0)""")
def agg24_consistency_fp(t):
    return audits.consistency_fp(t.labels, F.col("quality").isNotNull(), F.col("doc_id") % 5 == 0, F.col("toxic") == 1, (F.col("toxic") == 0) & (F.col("quality") == 0))


@query("""SELECT o_custkey, sum(coalesce(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END, 0))::BIGINT AS reasoning, sum(o_orderkey)::BIGINT AS output FROM orders GROUP BY 1""")
def agg40_token_totals(t):
    rows = t.orders.select("o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")).alias("reasoning"), F.col("o_orderkey").alias("output"))
    return audits.totals(rows, ["o_custkey"], ["reasoning", "output"])


@query("""SELECT string_agg(DISTINCT source, ',' ORDER BY source) AS annotators, count(*) FILTER (n_chars < 100) AS skipped FROM documents""")
def agg41_annotators(t):
    return audits.who_labelled(t.documents, "source", F.col("n_chars") < 100).select(F.array_join("annotators", ",").alias("annotators"), "skipped")


@query("""SELECT 'k' AS attribute, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS spans FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL""")
def agg42_inventory(t):
    spans = t.events.select("event_type", F.from_json("props", "map<string,string>").alias("a"))
    return audits.inventory(spans, "event_type", "a").select("attribute", F.array_join("spans", ",").alias("spans"))


@query("""SELECT concept, CASE WHEN EXISTS (SELECT 1 FROM events WHERE event_type = expected) THEN 'CONFIRMED' WHEN EXISTS (SELECT 1 FROM events WHERE event_type GLOB pattern) THEN 'CORRECTED' ELSE 'ABSENT' END AS state
FROM (VALUES ('open', 'view', 'vi*'), ('buy', 'bought', 'purch*'), ('thought', 'reasoning', '*reason*'), ('enter', 'login', 'sign?p')) v(concept, expected, pattern)""")
def agg43_contract_delta(t):
    contract = t.spark.createDataFrame([("open", "view", text.glob("vi*")), ("buy", "bought", text.glob("purch*")), ("thought", "reasoning", text.glob("*reason*")), ("enter", "login", text.glob("sign?p"))], "concept string, expected string, pattern string")
    return audits.contract_delta(contract, t.events.select("event_type").distinct(), "event_type")


@query("""SELECT count(*) FILTER (n BETWEEN 8 AND 15) AS in_band, count(*) AS n FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)""")
def agg45_band(t):
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n").between(8, 15)).alias("in_band"), F.count("*").alias("n"))


@query("""SELECT k AS class, c AS candidates, least(c, 500) AS selected, greatest(500 - c, 0) AS short_of_target, c / n::DOUBLE AS base_rate, n / sum(c) OVER ()::DOUBLE AS factor FROM (SELECT k, count(*) FILTER (event_type = k) AS c, count(*) AS n FROM events, (SELECT unnest(['purchase', 'signup', 'error']) AS k) GROUP BY 1)""")
def agg46_enrichment(t):
    return audits.enrichment(t.events, "event_type", ["purchase", "signup", "error"], 500)


@query("""WITH s AS (SELECT event_type, avg((value > 10)::INT) AS rate FROM events GROUP BY 1) SELECT event_type, rate, (SELECT min(rate) FROM s) AS worst FROM s""")
def agg47_scenarios(t):
    s = t.events.groupBy("event_type").agg(F.avg((F.col("value") > 10).cast("int")).alias("rate"))
    return s.withColumn("worst", F.min("rate").over(W.partitionBy(F.lit(1))))  # a row a scenario


@query("""SELECT source, min(f) AS lowest FROM (SELECT source, lang, CASE WHEN count(quality) > 0 THEN count(*) FILTER (quality = 1) / count(quality)::DOUBLE END AS f FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2) GROUP BY 1""")
def agg48_lowest(t):
    j = t.documents.select("doc_id", "source", "lang").join(t.labels, "doc_id", "left")
    f = j.groupBy("source", "lang").agg(stats.ratio(F.count_if(F.col("quality") == 1), F.count("quality")).alias("f"))
    return f.groupBy("source").agg(F.min("f").alias("lowest"))


@query("""SELECT left(sha256(string_agg(n_name || sha256(n_nationkey::VARCHAR), '' ORDER BY n_name)), 12) AS bundle FROM nation""")
def agg51_bundle_hash(t):
    return audits.bundle_hash(t.nation.select("n_name", F.col("n_nationkey").cast("string").alias("body")), "n_name", "body")


@query("""SELECT CASE WHEN event_type IN ('click', 'view') THEN 'generation' ELSE 'analysis' END AS kind, count(*) AS n FROM events GROUP BY 1""")
def agg54_record_counts(t):
    return t.events.groupBy(F.when(F.col("event_type").isin("click", "view"), "generation").otherwise("analysis").alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(DISTINCT turn) AS turns, count(*) AS calls, count(*) FILTER (length(text) <= 100 OR text IS NULL) AS failed_calls, count(DISTINCT turn) >= 6 AS exhausted FROM conversations GROUP BY 1""")
def agg55_loop_counters(t):
    return audits.loop_counters(t.conversations, ["conv_id"], F.length("text") > 100, 6)


@query("""SELECT doc_id, CASE WHEN n > 0 AND n_chars > 0 THEN n / (n + n_chars)::DOUBLE END AS share, 2 * n_chars - n - n_chars AS residual FROM (SELECT doc_id, n_chars, nullif(doc_id % 4, 0) AS n FROM documents)""")
def agg56_token_split(t):
    n = F.nullif(F.col("doc_id") % 4, F.lit(0))
    s = audits.token_split(n, F.nullif(F.col("n_chars"), F.lit(0)), 2 * F.col("n_chars"))
    return t.documents.select("doc_id", s.alias("s")).select("doc_id", "s.share", "s.residual")


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS n_error, count(*) FILTER (event_type = 'view') AS n_view FROM events GROUP BY 1""")
def agg58_value_maps(t):
    m = audits.value_maps(t.events, "user_id", ["event_type"], {"event_type": ["error", "view"]})
    at = lambda k: F.coalesce(F.try_element_at("event_type", F.lit(k)), F.lit(0).cast("long"))
    return m.select("user_id", at("error").alias("n_error"), at("view").alias("n_view"))


@query("""SELECT sum(o_orderkey % 2)::BIGINT AS used, 60::BIGINT AS "limit", least(8, greatest(60 - sum(o_orderkey % 2), 0))::BIGINT AS next_run FROM orders""")
def agg59_call_budget(t):
    b = audits.budget_state(t.orders.select((F.col("o_orderkey") % 2).alias("used")), "used", 60, 8)
    return b.select("used", F.col("limit").cast("long").alias("limit"), F.col("next_run").cast("long").alias("next_run"))


@query("""SELECT user_id, count(*) AS selected FROM events WHERE value > 40 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6""")
def srt8_heaviest(t):
    return t.events.where("value > 40").groupBy("user_id").agg(F.count("*").alias("selected")).orderBy(F.desc("selected"), "user_id").limit(6)


@query("""WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS pos FROM documents QUALIFY pos < 90) SELECT doc_id, pos FROM d WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY pos""")
def srt10_label_queue(t):
    """The draw of 90 (as srt6_sample) less what is labelled, in its order."""
    draw = picks.sample(t.documents.select("doc_id"), 90, 7, "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"))
    return draw.join(t.labels.select("doc_id"), "doc_id", "left_anti").orderBy("pos")


@query("""SELECT conv_id, array_to_string(list_transform(e[1:4], lambda x: x), '; ') || CASE WHEN len(e) > 4 THEN ' (and ' || (len(e) - 4) || ' more)' ELSE '' END AS message FROM (SELECT conv_id, list(turn || ': ' || role ORDER BY turn) AS e FROM conversations GROUP BY 1)""")
def srt11_first_errors(t):
    e = F.array_sort(F.collect_list(F.struct("turn", F.col("turn").cast("string").alias("loc"), F.col("role").alias("msg"))))
    return t.conversations.groupBy("conv_id").agg(e.alias("e")).select("conv_id", text.first_errors(F.col("e")).alias("message"))


@query("""SELECT conv_id, turn, (turn + 1) % 25 AS item FROM conversations""")
def srt14_round_robin(t):
    return t.conversations.select("conv_id", "turn", ((F.col("turn") + 1) % 25).alias("item"))


@query("""SELECT conv_id, turn, 'run-' || lower(to_hex(conv_id * 1000 + turn)) AS run FROM conversations""")
def str20_run_id(t):
    return t.conversations.select("conv_id", "turn", text.hex_clock(F.col("conv_id") * 1000 + F.col("turn")).alias("run"))


@query("""SELECT item_id, CASE WHEN instr(text, 'the') > 0 THEN substr(text, 1, instr(text, 'the') - 1) || 'THE' || substr(text, instr(text, 'the') + 3) END AS patched FROM benchmark""")
def str16_patched(t):
    return t.benchmark.select("item_id", text.patched(F.col("text"), F.lit("the"), F.lit("THE")).alias("patched"))


@query("""SELECT user_id, sum(n) AS spent, max(n) AS largest FROM (SELECT user_id, date_trunc('day', ts) AS d, count(*) AS n FROM events GROUP BY ALL) GROUP BY 1""")
def snk12_ledger(t):
    daily = t.events.groupBy("user_id", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n"))
    return daily.groupBy("user_id").agg(F.sum("n").alias("spent"), F.max("n").alias("largest"))


@query("""SELECT coalesce(l.doc_id, d.doc_id) AS doc_id, l.doc_id IS NOT NULL AS measured FROM documents d FULL JOIN (SELECT DISTINCT doc_id FROM labels WHERE quality = 1) l USING (doc_id)""")
def src16_measured_first(t):
    measured = t.labels.where("quality = 1").select("doc_id").distinct().withColumn("measured", F.lit(True))
    authored = t.documents.select("doc_id").withColumn("measured", F.lit(False))
    return measured.unionByName(authored.join(measured.select("doc_id"), "doc_id", "left_anti"))


@query("""SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS pos FROM documents QUALIFY pos >= 40 AND pos < 90""")
def src12_held_out(t):
    # The draw is of 90 rows by its nature, so its places are counted over 90 rows.
    draw = t.documents.select("doc_id", F.md5(F.concat(F.lit("7:"), F.col("doc_id").cast("string"))).alias("r")).orderBy("r", "doc_id").limit(90)
    return draw.withColumn("pos", F.row_number().over(W.orderBy("r", "doc_id")) - 1).where("pos >= 40").select("doc_id", F.col("pos").cast("long").alias("pos"))
