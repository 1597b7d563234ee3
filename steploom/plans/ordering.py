"""Ordered picks, joins and sets over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import guards, joins, judging, picks
from ..streaming import runs
from .base import query


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def win1_newest_wins(t):
    return picks.newest(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1""")
def win2_first_wins(t):
    return picks.first(t.events.select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).drop("ts")


@query("""SELECT conv_id, turn, row_number() OVER w - 1 AS ordinal, coalesce(sum(CASE WHEN length(text) > 0 THEN length(text) + 2 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, ((row_number() OVER w - 1) // 3)::INT AS chunk FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def win5_ordinals_offsets(t):
    c = picks.ordinals(t.conversations, ["conv_id"], ["turn"])
    return picks.chunks(picks.offsets(c, ["conv_id"], ["turn"], "text"), 3).select("conv_id", "turn", F.col("ordinal").cast("long").alias("ordinal"), "start", "chunk")


@query("""WITH c AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations),
s AS (SELECT conv_id, chunk, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS own, sum(length(text) + 2) AS room FROM c GROUP BY ALL),
o AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY conv_id ORDER BY chunk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM s)
SELECT conv_id, CAST(chunk AS INTEGER) AS chunk, n, CAST(start AS BIGINT) AS start, CAST(start + length(own) AS BIGINT) AS stop, own FROM o""")
def win9_context(t):
    """Each chunk of three turns with the range of its own text; what precedes it is the conversation's one text up to there."""
    wholes, parts = picks.running(t.conversations, ["conv_id"], ["turn"], "text", 3)
    both = picks.with_totals(parts, wholes, ["conv_id"])
    return both.select("conv_id", "chunk", "n", "start", "stop", F.substring("whole", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("own"))


@query("""WITH c AS (SELECT conv_id, turn, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 3 AS chunk FROM conversations),
l AS (SELECT *, max(chunk) OVER (PARTITION BY conv_id) AS last FROM c)
SELECT conv_id, CAST(last AS INTEGER) AS chunk, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (chunk < last), '') AS preceding FROM l GROUP BY ALL""")
def win9_rendered(t):
    """The context spelled out, for the chunk of each conversation that is asked about next."""
    wholes, parts = picks.running(t.conversations, ["conv_id"], ["turn"], "text", 3)
    last = parts.groupBy("conv_id").agg(F.max(F.struct("chunk", "start", "stop")).alias("p")).select("conv_id", "p.*")
    return picks.preceding(last, wholes, ["conv_id"]).select("conv_id", "chunk", "preceding")


@query("""SELECT user_id, event_id, rank, n, n > 8 AS capped FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY (event_type = 'view')::INT, value, event_id) AS rank, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE rank <= 8""")
def win7_capped(t):
    e = picks.capped(t.events, ["user_id"], [(F.col("event_type") == "view").cast("int"), "value", "event_id"], 8)
    return e.select("user_id", "event_id", F.col("rank").cast("long").alias("rank"), "n", "capped")


@query("""SELECT conv_id, arg_max(role, turn) AS last_role, arg_max(text, turn) AS last_text FROM conversations GROUP BY 1""")
def win12_last_call(t):
    return t.conversations.groupBy("conv_id").agg(F.max_by("role", "turn").alias("last_role"), F.max_by("text", "turn").alias("last_text"))


@query("""SELECT conv_id, kind, seq, row_number() OVER (PARTITION BY conv_id ORDER BY seq, kind) - 1 AS place FROM (SELECT conv_id, turn // 2 AS seq, CASE WHEN role = 'assistant' THEN 'llm' ELSE 'tool' END AS kind FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn // 2, CASE WHEN role = 'assistant' THEN 'llm' ELSE 'tool' END ORDER BY turn) = 1)""")
def win11_interleave(t):
    c = t.conversations.select("conv_id", F.floor(F.col("turn") / 2).cast("long").alias("seq"), "role").dropDuplicates(["conv_id", "seq", "role"])
    llm, tool = c.where("role = 'assistant'").drop("role"), c.where("role <> 'assistant'").drop("role").distinct()
    return picks.interleaved(llm, tool, ["conv_id"]).select("conv_id", "kind", "seq", F.col("place").cast("long").alias("place"))


@query("""SELECT doc_id, lang, quality FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND lang <> ''""")
def jon1_matched(t):
    return joins.paired(t.documents.select("doc_id", "lang"), t.labels, "doc_id", "lang", "quality").select("doc_id", "lang", "quality")


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE nullif(l.quality, 0) IS NULL AND d.lang <> ''""")
def jon2_unmatched(t):
    p = t.labels.withColumn("quality", F.nullif("quality", F.lit(0)))
    return joins.unmatched(t.documents.select("doc_id", "lang"), p, "doc_id", "lang", "quality").select("doc_id")


@query("""SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)""")
def jon3_left(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", "quality", "toxic")


@query("""WITH v AS (SELECT conv_id, role, min(text) AS v FROM conversations GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY role) k FROM v)
SELECT a.conv_id, a.role AS first, b.role AS second, a.v AS first_value, b.v AS second_value FROM r a JOIN r b ON a.conv_id = b.conv_id AND a.k = 1 AND b.k = 2""")
def jon4_two_first(t):
    return picks.two_first(t.conversations, ["conv_id"], "role", "text")


@query("""SELECT count(*) FILTER (l.doc_id IS NULL) AS only_a, count(*) FILTER (d.doc_id IS NULL) AS only_b, count(*) FILTER (d.doc_id = l.doc_id) AS "both" FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def jon5_reconciled(t):
    return joins.reconciled(t.documents, t.labels, "doc_id")


@query("""SELECT doc_id, source FROM documents SEMI JOIN labels USING (doc_id)""")
def jon7_semi(t):
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left_semi")


@query("""SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)""")
def jon8_anti(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left_anti")


@query("""SELECT l_orderkey, max(l_quantity) FILTER (l_returnflag = 'A') AS a, max(l_quantity) FILTER (l_returnflag = 'N') AS n, max(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1""")
def jon12_pivot(t):
    return joins.pivoted(t.lineitem, "l_orderkey", "l_returnflag", ["A", "N", "R"], "l_quantity")


@query("""SELECT event_id, CASE WHEN again THEN 'sound' ELSE verdict END AS verdict, CASE WHEN again THEN 0.9 ELSE value / 1000 END AS validity_confidence, CASE WHEN again AND event_id % 2 = 0 THEN 'new' ELSE 'old' END AS rationale, again AS escalated FROM (SELECT *, event_id % 7 = 0 AS again, CASE WHEN value > 30 THEN 'unsound' ELSE 'sound' END AS verdict FROM events)""")
def jon10_replaced(t):
    old = t.events.select(F.col("event_id"), F.when(F.col("value") > 30, "unsound").otherwise("sound").alias("verdict"), (F.col("value") / 1000).alias("validity_confidence"), F.lit(None).cast("string").alias("error_type"), F.lit("old").alias("rationale"))
    new = t.events.where("event_id % 7 = 0").select("event_id", F.lit("sound").alias("verdict"), F.lit(0.9).alias("validity_confidence"), F.lit(None).cast("string").alias("error_type"), F.when(F.col("event_id") % 2 == 0, "new").otherwise(" ").alias("rationale"))
    return joins.replaced(old, new, "event_id").drop("error_type")


@query("""SELECT d.doc_id, coalesce(q.quality::VARCHAR, 'no such key') AS observation FROM documents d LEFT JOIN labels q USING (doc_id)""")
def jon15_lookup(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.coalesce(F.col("quality").cast("string"), F.lit("no such key")).alias("observation"))


@query("""WITH d AS (SELECT doc_id, md5('7:' || doc_id) AS h FROM documents ORDER BY 2, 1 LIMIT 90) SELECT doc_id, (row_number() OVER (ORDER BY h, doc_id) - 1)::BIGINT AS pos FROM d""")
def srt6_sample(t):
    return picks.sample(t.documents.select("doc_id"), 90, 7, "doc_id").select("doc_id", F.col("pos").cast("long").alias("pos"))


@query("""SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('9:' || doc_id), doc_id) <= 15""")
def srt7_stratified(t):
    return picks.stratified(t.documents, "lang", 15, 9, "doc_id").select("lang", "doc_id")


@query("""SELECT c_custkey FROM (SELECT c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) k FROM customer) ORDER BY CASE WHEN k = 1 THEN 0 ELSE 1 END, c_acctbal DESC, c_custkey LIMIT 40""")
def srt3_diverse(t):
    return picks.diverse(t.customer, "c_nationkey", [F.col("c_acctbal").desc(), "c_custkey"], 40).select("c_custkey")


@query("""SELECT c_custkey, (c_acctbal NOT BETWEEN 0 AND 5000)::INT AS outside, abs(c_acctbal - 2500) AS distance FROM customer ORDER BY 2, 3, 1""")
def srt2_ranking(t):
    keys = [(~F.col("c_acctbal").between(0, 5000)).cast("int").alias("outside"), F.abs(F.col("c_acctbal") - 2500).alias("distance")]
    return t.customer.select("c_custkey", *keys).orderBy("outside", "distance", "c_custkey")


@query("""SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1""")
def set2_except(t):
    return t.documents.select("doc_id").subtract(t.labels.where("quality = 1").select("doc_id"))


@query("""SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE toxic = 1""")
def set3_intersect(t):
    return t.documents.select("doc_id").intersect(t.labels.where("toxic = 1").select("doc_id"))


@query("""(SELECT doc_id FROM labels WHERE quality = 1 EXCEPT SELECT doc_id FROM labels WHERE toxic = 0) UNION (SELECT doc_id FROM labels WHERE toxic = 0 EXCEPT SELECT doc_id FROM labels WHERE quality = 1)""")
def set5_symmetric(t):
    a, b = t.labels.where("quality = 1").select("doc_id"), t.labels.where("toxic = 0").select("doc_id")
    return a.subtract(b).union(b.subtract(a))


@query("""WITH s AS (SELECT user_id, event_id, value, value / 100 AS conf, event_type, CASE WHEN value < 5 THEN 'unsound' WHEN value < 10 THEN 'unverifiable' ELSE 'sound' END AS verdict FROM events), c AS (SELECT *, verdict = 'unsound' OR conf < 0.07 AS chosen FROM s)
SELECT count(*) AS n, count(*) FILTER (chosen) AS selected, count(*) FILTER (chosen) / count(*)::DOUBLE AS rate FROM c""")
def agg25_escalation_rate(t):
    v = F.when(F.col("value") < 5, "unsound").when(F.col("value") < 10, "unverifiable").otherwise("sound")
    chosen = judging.doubtful(v, F.col("value") / 100, F.lit("no computation"), 0.07, 0.0)
    return t.events.agg(F.count("*").alias("n"), F.count_if(chosen).alias("selected"), stats.ratio(F.count_if(chosen), F.count("*")).alias("rate"))


@query("""SELECT user_id, count(*) FILTER (value > 60) AS spent, CASE WHEN count(*) FILTER (event_type = 'error') > 3 THEN 'spend unreadable' WHEN count(*) FILTER (value > 60) >= 5 THEN 'limit reached' END AS reason FROM events GROUP BY 1""")
def flt31_breaker(t):
    e = t.events.groupBy("user_id").agg(F.count_if(F.expr("value > 60")).alias("spent"), (F.count_if(F.expr("event_type = 'error'")) <= 3).alias("readable"))
    return e.select("user_id", "spent", guards.breaker(F.col("spent"), F.col("readable"), F.lit(5))["reason"].alias("reason"))


@query("""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'cached mode' WHEN value > 80 THEN 'breaker' WHEN event_type = 'error' THEN 'tier not ready' WHEN event_id % 5 = 0 THEN 'rate limited' WHEN user_id > 100 THEN 'unknown item' END AS reason FROM events""")
def flt32_admission(t):
    c = F.col
    return t.events.select("event_id", guards.admission(c("event_id") % 11 == 0, c("value") <= 80, c("event_type") != "error", c("event_id") % 5 == 0, c("user_id") <= 100).alias("reason"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN quality IS DISTINCT FROM 1 THEN 'quality' END, CASE WHEN toxic IS DISTINCT FROM 0 THEN 'toxic' END], lambda x: x IS NOT NULL), ',') AS drifted FROM documents LEFT JOIN labels USING (doc_id)""")
def flt28_staleness(t):
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return d.select("doc_id", F.array_join(guards.drift({"quality": F.col("quality"), "toxic": F.col("toxic")}, {"quality": F.lit(1), "toxic": F.lit(0)}), ",").alias("drifted"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT user_id, k, t, [t] AS live, true AS admitted FROM e WHERE k = 1 UNION ALL SELECT e.user_id, e.k, e.t, CASE WHEN len(list_filter(r.live, lambda x: e.t - x < 172800)) < 3 THEN list_append(list_filter(r.live, lambda x: e.t - x < 172800), e.t) ELSE list_filter(r.live, lambda x: e.t - x < 172800) END, len(list_filter(r.live, lambda x: e.t - x < 172800)) < 3 FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id AS client, count(*) AS n, count(*) FILTER (admitted) AS n_admitted FROM r GROUP BY 1""")
def stm3_limiter(t):
    return runs.limited(t.events, "user_id", "ts", 3, 172800).groupBy("client").agg(F.count("*").alias("n"), F.count_if(F.expr("admitted")).alias("n_admitted"))


@query("""SELECT user_id::VARCHAR AS run_id, count(*) AS n_events, arg_max(event_type, (ts, event_id)) AS stage FROM events GROUP BY 1""")
def stm5_run_state(t):
    e = t.events.select(F.col("user_id").cast("string").alias("run_id"), F.struct("ts", "event_id").alias("seq"), F.col("event_type").alias("stage"), F.lit("ok").alias("status"))
    return runs.states(e).select("run_id", "n_events", "stage")
