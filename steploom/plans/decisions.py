"""Flags, gates, joins of judgements, and their summaries over the test tables."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from ..functions import stats, text
from ..operators import agreement as A, guards, joins, judging, picks, reports, rules
from ..sources import writers
from .base import query
from .studies import steps
from .statistics import wilson

LOW, HIGH = wilson("s", "n")
VERDICT = "CASE WHEN event_id % 13 = 0 THEN NULL WHEN value < 5 THEN 'unsound' WHEN value < 10 THEN 'unverifiable' ELSE 'sound' END"


def verdicts(t):
    """Events as judged steps: verdict (NULL: not judged), confidence and text."""
    v = F.when(F.col("event_id") % 13 == 0, F.lit(None).cast("string")).when(F.col("value") < 5, "unsound").when(F.col("value") < 10, "unverifiable").otherwise("sound")
    said = F.when(F.col("event_id") % 2 == 0, "so 3 + 4 is 7").otherwise("so it follows")
    return t.events.select("event_id", "user_id", "event_type", "value", v.alias("verdict"), (F.col("value") / 100).alias("validity_confidence"), said.alias("text"))


@query(f"""SELECT count(*) FILTER (v = 'unsound' OR c < 0.7 OR (e % 2 = 0 AND c < 0.85)) AS shipped, count(*) FILTER (v <> 'sound' OR c < 0.7 OR (e % 2 = 0 AND c < 0.85)) AS original, count(*) AS n FROM (SELECT event_id AS e, {VERDICT} AS v, value / 100 AS c FROM events)""")
def flt12_13_escalation(t):
    v = verdicts(t)
    a = [F.col("verdict"), F.col("validity_confidence"), F.col("text")]
    return v.agg(F.count_if(judging.doubtful(*a)).alias("shipped"), F.count_if(judging.doubtful_before(*a)).alias("original"), F.count("*").alias("n"))


@query(f"""SELECT event_id, v AS verdict FROM (SELECT event_id, {VERDICT} AS v FROM events) WHERE v IS NOT NULL""")
def flt15_policy_input(t):
    return verdicts(t).where("event_type is not null and verdict is not null and validity_confidence is not null").select("event_id", "verdict")


@query(f"""SELECT user_id, count(*) FILTER (v <> 'sound') AS broad, count(*) FILTER (v = 'unsound') AS narrow, CASE WHEN count(v) > 0 THEN count(*) FILTER (v <> 'sound') END AS flagged FROM (SELECT user_id, {VERDICT} AS v FROM events) GROUP BY 1""")
def flt16_17_flags(t):
    """The broad and the narrow sense of a flag, and the count that a report carries (NULL where nothing is judged)."""
    v = verdicts(t)
    both = v.groupBy("user_id").agg(F.count_if(F.col("verdict") != "sound").alias("broad"), F.count_if(F.col("verdict") == "unsound").alias("narrow"))
    return both.join(reports.soundness(v, ["user_id"], "verdict").select("user_id", "flagged"), "user_id")


@query("""SELECT conv_id, CASE WHEN conv_id % 3 = 0 AND count(*) FILTER (turn = 4) = 0 THEN 'underdetermined' WHEN conv_id % 3 = 0 THEN 'contradicts' ELSE 'supports' END AS verdict, conv_id % 3 = 0 AND count(*) FILTER (turn = 4) > 0 AS flagged FROM conversations GROUP BY 1""")
def flt18_consistency(t):
    """A contradiction has to cite a step that the trace has."""
    # Of a trace's steps, only those that are cited are collected.
    ids = t.conversations.groupBy("conv_id").agg(F.collect_set(F.when(F.col("turn") == 4, F.col("turn").cast("int"))).alias("ids"))
    c = judging.consistency(F.when(F.col("conv_id") % 3 == 0, "contradicts").otherwise("supports"), joins.cited(F.col("ids"), F.array(F.lit(4))))
    return ids.select("conv_id", c.alias("c")).select("conv_id", "c.verdict", "c.flagged")


@query("""SELECT conv_id, n_turns, CASE WHEN n_turns >= 2 AND v IS NOT NULL THEN CASE WHEN v = 'contradicts' AND NOT hit THEN 'underdetermined' ELSE v END END AS verdict, CASE WHEN n_turns >= 2 AND v IS NOT NULL THEN v = 'contradicts' AND hit END AS flagged
FROM (SELECT conv_id, count(*) AS n_turns, CASE conv_id % 3 WHEN 0 THEN 'contradicts' WHEN 1 THEN 'follows' END AS v, bool_or(turn = 3) AS hit FROM conversations GROUP BY 1)""")
def ext4_consistency(t):
    """Nothing is judged in a conversation of one turn, or where the check failed (no verdict)."""
    verdict = F.when(F.col("conv_id") % 3 == 0, "contradicts").when(F.col("conv_id") % 3 == 1, "follows")
    per = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.collect_set(F.when(F.col("turn") == 3, F.col("turn").cast("int"))).alias("ids"))
    got = judging.consistency_of(F.col("n_turns"), verdict, joins.cited(F.array(F.lit(3).cast("int")), F.col("ids")))
    return per.select("conv_id", "n_turns", got.alias("c")).select("conv_id", "n_turns", "c.verdict", "c.flagged")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 2 = 0 END AS correct FROM events""")
def flt19_correct(t):
    """Correct, wrong, or unknown: no answer, or nothing known."""
    k = F.col("event_id")
    known, answer = F.when(k % 7 != 0, k.cast("string")), F.when(k % 5 == 0, " ").otherwise((k + k % 2).cast("string"))
    return t.events.select("event_id", reports.correct(answer, known, text.check(known, answer, F.lit("exact"), F.lit(None).cast("double"))).alias("correct"))


_SAID = "CASE event_id % 3 WHEN {a} THEN 'correct' WHEN {b} THEN 'wrong' ELSE 'unparsed' END"


@query(f"""SELECT event_id, d, t, CASE WHEN d = 'unparsed' OR t = 'unparsed' THEN 'incomplete' WHEN d = 'correct' AND t = 'correct' THEN 'agreed' WHEN t = 'correct' THEN 'separated' WHEN d = 'correct' THEN 'inverted' ELSE 'both_wrong' END AS pattern
FROM (SELECT event_id, {_SAID.format(a=0, b=1)} AS d, CASE user_id % 4 WHEN 0 THEN 'unparsed' WHEN 1 THEN 'wrong' ELSE 'correct' END AS t FROM events)""")
def flt20_21_contrast(t):
    """Outcomes of two arms and the pattern that they make."""
    k = F.col("event_id").cast("string")
    said = lambda c: F.when(c == "correct", k).when(c == "wrong", F.concat(k, F.lit("1"))).otherwise("cannot tell")
    d = F.when(F.col("event_id") % 3 == 0, "correct").when(F.col("event_id") % 3 == 1, "wrong").otherwise("unparsed")
    h = F.when(F.col("user_id") % 4 == 0, "unparsed").when(F.col("user_id") % 4 == 1, "wrong").otherwise("correct")
    got = lambda c: rules.outcome(k, said(c), text.check(k, said(c), F.lit("exact"), F.lit(None).cast("double")))
    return t.events.select("event_id", got(d).alias("d"), got(h).alias("t")).withColumn("pattern", reports.contrast(F.col("d"), F.col("t")))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'trap' WHEN 2 THEN 'unparsed' ELSE 'other' END AS outcome FROM part""")
def flt22_trap_grade(t):
    k = F.col("p_partkey")
    said = F.when(k % 4 == 0, k.cast("string")).when(k % 4 == 1, (k + 1).cast("string")).when(k % 4 == 2, "who knows").otherwise((k + 2).cast("string"))
    return t.part.select("p_partkey", rules.trap_outcome(k.cast("string"), said, F.array((k + 1).cast("string")), F.lit("exact"), F.lit(None).cast("double")).alias("outcome"))


@query("""SELECT event_id, coalesce(event_type = 'error' OR (value > 60 AND user_id % 2 = 0), false) AS bound FROM events""")
def flt27_budget_bound(t):
    budget = F.when(F.col("user_id") % 2 == 0, 60.0).otherwise(0.0)
    finish = F.when(F.col("event_type") == "error", "length").otherwise("stop")
    tokens = F.when(F.col("value") > 60, 60.0).otherwise(F.lit(0.0))
    return t.events.select("event_id", guards.budget_bound(finish, tokens, budget).alias("bound"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN lang IS NOT DISTINCT FROM 'en' THEN 'clean' WHEN l.doc_id IS NOT NULL THEN 'declared' ELSE 'undeclared' END AS status FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)) GROUP BY 1""")
def flt29_vintage(t):
    on_record = t.labels.select("doc_id").distinct().withColumn("declared", F.lit(True))
    d = t.documents.select("doc_id", "lang").join(on_record, "doc_id", "left")
    return d.groupBy(guards.vintage(F.col("lang"), F.lit("en"), F.col("declared")).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1""")
def flt30_unstamped(t):
    d = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return d.where(~F.col("quality").eqNullSafe(F.lit(1))).select("doc_id")


@query("""SELECT conv_id, turn, conv_id % 2 = 0 AS shaped FROM conversations WHERE conv_id IN (SELECT item_id FROM benchmark)""")
def flt33_allowlist(t):
    """Rows on the allowlist, and whether their run id is well formed."""
    on_list = t.conversations.join(t.benchmark.select(F.col("item_id").alias("conv_id")), "conv_id", "left_semi")
    run = F.when(F.col("conv_id") % 2 == 0, text.hex_clock(F.col("turn"))).otherwise(F.concat(F.lit("run-x"), F.col("turn").cast("string")))
    return on_list.select("conv_id", "turn", guards.run_id(run).alias("shaped"))


@query("""SELECT s_suppkey, s_suppkey % 4 < 3 AS alias, CASE WHEN s_suppkey % 3 = 0 THEN 'model' WHEN s_suppkey % 3 = 1 THEN 'effort' ELSE '' END AS unpinned FROM supplier""")
def flt34_35_pins(t):
    k = F.col("s_suppkey")
    model = F.concat(F.lit("m-"), F.when(k % 4 == 0, "latest-2").when(k % 4 == 1, "x-preview").when(k % 4 == 2, "x-turbo").otherwise("2024"))
    blank = guards.unpinned({"model": F.when(k % 3 != 0, "m"), "effort": F.when(k % 3 == 1, " ").otherwise("low")})
    return t.supplier.select("s_suppkey", guards.alias(model).alias("alias"), F.array_join(blank, ",").alias("unpinned"))


@query("""SELECT conv_id, count(*) FILTER (length(text) < 60) AS short, bool_or(role = 'system') AS has_system FROM conversations GROUP BY 1""")
def flt40_41_filters(t):
    """A tag filter, and how many arms meet a predicate: counted, and not collected."""
    return t.conversations.groupBy("conv_id").agg(F.count_if(rules.yes(F.length("text") < 60)).alias("short"), F.bool_or(F.col("role") == "system").alias("has_system"))


@query("""SELECT gate, count(*) AS n FROM (SELECT coalesce(quality = 1, false) AS gate FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1""")
def flt49_gate(t):
    """Only the flag '1' opens; '0', 'true' and a missing flag do not."""
    d = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return d.groupBy(rules.gated(F.col("quality").cast("string")).alias("gate")).agg(F.count("*").alias("n"))


@query("""WITH draw AS (SELECT doc_id FROM documents ORDER BY md5('7:' || doc_id), doc_id LIMIT 90) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM draw) AND NOT contains(source, 'heldout')""")
def flt10_held_out(t):
    """Out by membership of the draw and by the file's name."""
    draw = picks.sample(t.documents.select("doc_id"), 90, 7, "doc_id").select("doc_id")
    return t.documents.where(~F.contains("source", F.lit("heldout"))).select("doc_id").join(draw, "doc_id", "left_anti")


@query("""SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type = 'error' THEN 'status' WHEN user_id % 5 = 0 THEN 'trap' WHEN event_id % 4 = 0 THEN 'unlabelled' WHEN value > 40 THEN 'unsound' END AS reason FROM events) GROUP BY 1""")
def flt11_eligible(t):
    e = guards.eligible(F.when(F.col("event_type") == "error", "failed").otherwise("ok"), F.col("user_id") % 5 == 0, F.col("event_id") % 4, F.when(F.col("value") > 40, 1).otherwise(0))
    return t.events.select(e["reason"].alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT c_custkey, n_name, coalesce(n_regionkey = 1, false) AS trap FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def jon6_with_bank(t):
    bank = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", (F.col("n_regionkey") == 1).alias("trap"))
    return t.customer.select("c_custkey", "c_nationkey").join(bank, "c_nationkey", "left").select("c_custkey", "n_name", F.coalesce("trap", F.lit(False)).alias("trap"))


@query("""SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'unsound' WHEN toxic = 0 THEN 'sound' END AS human FROM documents d LEFT JOIN labels USING (doc_id) WHERE d.doc_id % 7 <> 0 AND d.doc_id % 3 IN (0, 1)""")
def jon9_flags_with_humans(t):
    human = t.labels.select("doc_id", F.when(F.col("toxic") == 1, "unsound").when(F.col("toxic") == 0, "sound").alias("human"))
    return steps(t).where("v in ('unsound', 'unverifiable')").select("doc_id").join(human, "doc_id", "left")


def _again(t):
    v = verdicts(t).select("event_id", "verdict")
    return v, v.where("event_id % 7 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, "sound").otherwise("unsound").alias("after"))


@query(f"""SELECT event_id, v AS before, a AS after FROM (SELECT event_id, {VERDICT} AS v, CASE WHEN event_id % 2 = 0 THEN 'sound' ELSE 'unsound' END AS a FROM events WHERE event_id % 7 = 0) WHERE v IS DISTINCT FROM a""")
def jon11_changed(t):
    before, after = _again(t)
    return before.join(after, "event_id").where(~F.col("verdict").eqNullSafe(F.col("after"))).select("event_id", F.col("verdict").alias("before"), "after")


@query(f"""SELECT event_id, CASE WHEN event_id % 7 > 0 THEN {VERDICT} WHEN event_id % 2 = 0 THEN 'sound' ELSE 'unsound' END AS verdict FROM events""")
def jon24_verdict_only(t):
    before, after = _again(t)
    return before.join(after, "event_id", "left").select("event_id", F.coalesce("after", "verdict").alias("verdict"))


@query("""SELECT count(*) FILTER ((quality = 1) IS DISTINCT FROM (lang = 'en')) AS changed, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id)""")
def jon19_regraded(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return d.agg(F.count_if(~(F.col("quality") == 1).eqNullSafe(F.col("lang") == "en")).alias("changed"), F.count("*").alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice > o_totalprice / 2 AS above FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def jon20_shared_baseline(t):
    base = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice").join(base, "l_orderkey").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") > F.col("o_totalprice") / 2).alias("above"))


@query("""WITH c AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k FROM conversations) SELECT w.conv_id, c.turn, CASE WHEN c.turn IS NULL THEN 'no such step' WHEN NOT contains(c.text, 'the') THEN 'patch does not fit' END AS fault FROM (SELECT DISTINCT conv_id FROM conversations) w LEFT JOIN c ON c.conv_id = w.conv_id AND c.k = 5""")
def jon23_resolved(t):
    """The step of an ordinal for each case, and why a patch cannot be made."""
    steps = picks.ordinals(t.conversations, ["conv_id"], ["turn"]).where("ordinal = 5").select("conv_id", "turn", "text")
    cases = t.conversations.select("conv_id").distinct().join(steps, "conv_id", "left")
    return cases.select("conv_id", "turn", F.when(F.col("turn").isNull(), "no such step").when(text.patched(F.col("text"), F.lit("the"), F.lit("x")).isNull(), "patch does not fit").alias("fault"))


@query("""SELECT DISTINCT event_type AS used FROM events WHERE event_type NOT IN (SELECT r_name FROM region)""")
def jon25_undefined(t):
    """What is used and defined nowhere."""
    return t.events.select(F.col("event_type").alias("used")).distinct().join(t.region.select(F.col("r_name").alias("used")), "used", "left_anti")


@query("""SELECT lab AS label, n, total, n / total::DOUBLE AS value FROM (SELECT quality::VARCHAR AS lab, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS total, min(doc_id) AS seen FROM labels WHERE quality IS NOT NULL GROUP BY 1) ORDER BY n DESC, seen LIMIT 1""")
def agg10_majority(t):
    return A.majority(t.labels, "quality", F.col("doc_id")).select("label", "n", "total", "value")


@query(f"""SELECT s / n::DOUBLE AS raw, {LOW} AS low, {HIGH} AS high FROM (SELECT count(*) FILTER (quality = toxic) AS s, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)""")
def agg9_raw_agreement(t):
    return A.agreement(t.labels, "quality", "toxic", F.col("doc_id")).select("raw", F.col("raw_low").alias("low"), F.col("raw_high").alias("high"))


@query("""WITH v AS (SELECT user_id, date_trunc('day', ts) AS d, event_type AS who, min(CASE WHEN value > 20 THEN 'y' ELSE 'n' END) AS v FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id, d ORDER BY who) AS k FROM v),
p AS (SELECT a.v AS a, b.v AS b FROM r a JOIN r b ON a.user_id = b.user_id AND a.d = b.d AND a.k = 1 AND b.k = 2) SELECT count(*) AS n, count(*) FILTER (a = b) / count(*)::DOUBLE AS raw FROM p""")
def agg16_inter_annotator(t):
    """Agreement of the two first voters on each step."""
    votes = t.events.select("user_id", F.date_trunc("day", "ts").alias("d"), "event_type", F.when(F.col("value") > 20, "y").otherwise("n").alias("v"))
    pairs = picks.two_first(votes, ["user_id", "d"], "event_type", "v")
    return A.agreement(pairs, "first_value", "second_value", F.xxhash64("user_id", "d")).select("n", "raw")


@query("""SELECT count(*) AS n, count(*) FILTER (value > 40) AS flipped, count(*) FILTER (value > 40 AND event_id % 3 = 0) AS verbalised, count(*) FILTER (event_id % 11 = 0) AS no_answer, CASE WHEN count(*) FILTER (value > 40) > 0 THEN 'flips seen' ELSE 'no flip' END AS verdict FROM events""")
def agg26_trials(t):
    flip, answer = F.col("value") > 40, F.when(F.col("event_id") % 11 == 0, F.when(F.col("event_id") % 2 == 0, "")).otherwise("A")
    n = t.events.agg(F.count("*").alias("n"), F.count_if(flip).alias("flipped"), F.count_if(flip & (F.col("event_id") % 3 == 0)).alias("verbalised"), F.count_if(stats.truthy(answer).isNull()).alias("no_answer"))
    return n.withColumn("verdict", F.when(F.col("flipped") > 0, "flips seen").otherwise("no flip"))


@query("""SELECT event_type AS cue, count(*) AS n, string_agg(DISTINCT (user_id % 4)::VARCHAR, ',' ORDER BY (user_id % 4)::VARCHAR) AS problems FROM events GROUP BY 1""")
def agg27_by_cue(t):
    n = t.events.groupBy(F.col("event_type").alias("cue"), (F.col("user_id") % 4).alias("p")).agg(F.count("*").alias("n"))
    return n.groupBy("cue").agg(F.sum("n").alias("n"), F.array_join(F.sort_array(F.collect_list(F.col("p").cast("string"))), ",").alias("problems"))


@query("""WITH w AS (SELECT l_orderkey, bool_or(l_quantity > 25) FILTER (l_returnflag = 'A') AS a, bool_or(l_quantity > 25) FILTER (l_returnflag = 'N') AS n, bool_or(l_quantity > 25) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)
SELECT count(*) FILTER (a) AS a_correct, count(*) FILTER (n) AS n_correct, count(*) FILTER (r) AS r_correct, count(*) FILTER (r AND NOT coalesce(a, false) AND NOT coalesce(n, false)) AS rescued FROM w""")
def agg33_arm_accuracy(t):
    w = joins.pivoted(t.lineitem.select("l_orderkey", "l_returnflag", (F.col("l_quantity") > 25).alias("ok")), "l_orderkey", "l_returnflag", ["A", "N", "R"], "ok")
    return w.agg(*[F.count_if(c).alias(f"{c}_correct") for c in ("a", "n", "r")], F.count_if(F.col("r") & ~rules.yes(F.col("a")) & ~rules.yes(F.col("n"))).alias("rescued"))


@query(f"""SELECT event_type, count(*) FILTER (v = 'unsound') AS caught, count(*) FILTER (v = 'unsound' AND event_id % 2 = 0) AS named, count(*) FILTER (v = 'unverifiable') AS baseline_flags FROM (SELECT event_type, event_id, {VERDICT} AS v FROM events) GROUP BY 1""")
def agg52_harness(t):
    caught = F.col("verdict") == "unsound"
    return verdicts(t).groupBy("event_type").agg(F.count_if(caught).alias("caught"), F.count_if(caught & (F.col("event_id") % 2 == 0)).alias("named"), F.count_if(F.col("verdict") == "unverifiable").alias("baseline_flags"))


@query("""SELECT count(*) AS reports, count(*) FILTER (quality <> 1) AS stale, count(*) > 0 AND count(*) FILTER (quality <> 1) = 0 AS ok FROM labels WHERE quality IS NOT NULL""")
def agg53_readiness(t):
    n = t.labels.where("quality is not null").agg(F.count("*").alias("reports"), F.count_if(F.col("quality") != 1).alias("stale"))
    return n.withColumn("ok", (F.col("reports") > 0) & (F.col("stale") == 0))


@query("""SELECT conv_id, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS reasoning, count(*) FILTER (role = 'assistant') AS turns, count(*) FILTER (role = 'user') AS calls, count(*) FILTER (role = 'user' AND length(text) < 60) AS failed FROM conversations GROUP BY 1""")
def agg57_arm_cell(t):
    said, used = F.col("role") == "assistant", F.col("role") == "user"
    return t.conversations.groupBy("conv_id").agg(
        F.sum(F.when(said, F.coalesce(F.length("text"), F.lit(0))).otherwise(0)).alias("reasoning"), F.count_if(said).alias("turns"), F.count_if(used).alias("calls"), F.count_if(used & (F.length("text") < 60)).alias("failed")
    )


@query("""SELECT user_id AS run_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1 ORDER BY 1""")
def win3_run_merge(t):
    return picks.newest(t.events.select(F.col("user_id").alias("run_id"), "ts", "event_id"), ["run_id"], ["ts", "event_id"]).select("run_id", "event_id").orderBy("run_id")


@query("""SELECT user_id % 10 AS problem, event_type AS cue, arg_min(event_id, event_id) AS event_id FROM events GROUP BY ALL""")
def win4_first_trial(t):
    e = t.events.select((F.col("user_id") % 10).alias("problem"), F.col("event_type").alias("cue"), "event_id", F.col("event_id").alias("at"))
    return picks.first(e, ["problem", "cue"], ["at"]).select("problem", "cue", "event_id")


@query("""WITH m AS (SELECT *, max(turn) FILTER (length(text) < 60) OVER (PARTITION BY conv_id) AS last FROM conversations) SELECT conv_id, turn FROM m WHERE turn <= last AND NOT coalesce(length(text) < 60, false)""")
def win10_escalation_context(t):
    """Steps up to the last chosen one, the chosen left out."""
    chosen = rules.yes(F.length("text") < 60)
    c = t.conversations.select("conv_id", "turn", chosen.alias("chosen"))
    last = F.max(F.when(F.col("chosen"), F.col("turn"))).over(W.partitionBy("conv_id"))
    return c.withColumn("last", last).where("turn <= last and not chosen").select("conv_id", "turn")


@query("""SELECT doc_id, CASE WHEN quality IS NULL THEN toxic ELSE quality END AS block, quality IS NULL AND toxic IS NOT NULL AS carried_forward FROM documents LEFT JOIN labels USING (doc_id)""")
def snk3_carried(t):
    new = t.documents.select("doc_id").join(t.labels.select("doc_id", F.col("quality").alias("block")), "doc_id", "left")
    return writers.carried(new, t.labels.select("doc_id", F.col("toxic").alias("block")), "doc_id", "block")


@query("""SELECT doc_id, coalesce(l.n, 0) AS stamp FROM documents LEFT JOIN (SELECT source AS k, count(*) AS n FROM documents GROUP BY 1) l ON l.k = source""")
def snk6_stamped(t):
    """One measured context on every report."""
    context = t.documents.groupBy("source").agg(F.count("*").alias("stamp"))
    return t.documents.select("doc_id", "source").join(context, "source", "left").select("doc_id", F.coalesce("stamp", F.lit(0)).alias("stamp"))


@query("""SELECT conv_id, CASE WHEN bool_or(role = 'assistant' AND turn % 3 = 0) OR count(*) FILTER (role = 'assistant' AND length(text) > 0) = 0 THEN 'partial' ELSE 'full' END AS trace_quality FROM conversations GROUP BY 1""")
def flt7_runner_quality(t):
    """Partial where a call that was asked to think gave no reasoning, or nothing was answered."""
    said = F.col("role") == "assistant"
    reasoning = F.when(F.col("turn") % 3 == 0, "").otherwise("because")
    g = t.conversations.groupBy("conv_id").agg(F.bool_or(said & (reasoning == "")).alias("silent"), F.count_if(said & (F.length("text") > 0)).alias("answers"))
    return g.select("conv_id", F.when(F.col("silent") | (F.col("answers") == 0), "partial").otherwise("full").alias("trace_quality"))


@query("""SELECT count(*) FILTER (event_type = 'error') AS not_replayed, count(*) AS n FROM events""")
def flt51_not_replayed(t):
    reason = F.when(F.col("event_type") == "error", "analysis_unavailable")
    return t.events.agg(F.count_if(reason == "analysis_unavailable").alias("not_replayed"), F.count("*").alias("n"))


@query("""SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 OR quality = 0 ORDER BY toxic = 0, doc_id LIMIT 2""")
def srt5_start_here(t):
    """The two best entries: right with unsound steps before wrong ones."""
    d = t.documents.select("doc_id").join(t.labels, "doc_id")
    both = F.array(F.struct((F.col("toxic") == 1).alias("correct"), (F.col("toxic") + (1 - F.col("quality"))).alias("unsound")))
    return d.withColumn("rank", rules.start_rank(both)).where("rank is not null").orderBy("rank", "doc_id").limit(2).select("doc_id")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN props END AS payload, event_id % 3 = 1 AS refused FROM events WHERE event_id % 3 > 0 UNION ALL SELECT event_id, props, false FROM events WHERE event_id % 3 = 0""")
def src8_recorded(t):
    """A recorded payload is used if its digest fits or none was recorded."""
    from ..sources import readers

    k = F.col("event_id")
    have = t.events.select(k.alias("name"), F.when(k % 3 > 0, F.when(k % 3 == 2, "d").otherwise("old")).alias("digest"), F.col("props").alias("payload"))
    return readers.recorded(have, t.events.select(k.alias("name"), F.lit("d").alias("digest"))).select(F.col("name").alias("event_id"), "payload", "refused")


@query("""SELECT conv_id || ':' || role AS step_id, arg_max(text, turn) AS behavior, count(*) AS copies FROM conversations GROUP BY conv_id, role""")
def src4_predictions(t):
    """Reports of one turn each, nested as a report nests: a later report's row takes the place of an earlier one's."""
    from ..sources import readers

    step = F.struct(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("role")).alias("step_id"), F.lit("thought").alias("kind"), F.struct(F.col("text").alias("label"), F.lit(1.0).alias("confidence")).alias("behavior"), F.struct(F.lit("sound").alias("verdict"), F.lit(1.0).alias("confidence")).alias("validity"))
    r = t.conversations.select(F.format_string("%08d.json", "turn").alias("source_file"), F.struct(F.col("conv_id").cast("string").alias("id")).alias("item"), F.array(F.struct(F.lit("react").alias("strategy"), F.array(step).alias("steps"))).alias("arms"))
    return readers.predictions(r).select("step_id", "behavior", "copies")


@query("""SELECT user_id AS item, arg_min(value, event_id) AS seconds FROM events WHERE event_type = 'purchase' AND user_id = 7 GROUP BY 1""")
def src20_latency(t):
    from ..sources import readers

    status = F.when(F.col("event_type") == "purchase", "done").otherwise("failed")
    return readers.latency_of(t.events.select(F.col("user_id").alias("item"), F.col("value").alias("seconds"), status.alias("status"), F.col("event_id").alias("place")), 7).select("item", "seconds")


@query("""SELECT c_custkey, least(8, 60 - c_custkey % 70) AS calls, CASE WHEN least(8, 60 - c_custkey % 70) < 3 THEN 'call budget exhausted' END AS reason FROM customer""")
def stm5_precheck(t):
    from ..streaming import runs

    p = runs.precheck(F.col("c_custkey") % 70)
    return t.customer.select("c_custkey", p.alias("p")).select("c_custkey", "p.calls", "p.reason")


@query("""SELECT user_id, 'A professor says ' || min(event_type) || '.' || chr(10) || 'Q' || user_id AS prompt FROM events GROUP BY 1""")
def str17_cue(t):
    """A cue before the question, from a template."""
    g = t.events.groupBy("user_id").agg(F.min("event_type").alias("option"))
    return g.select("user_id", text.rendered(F.lit("A professor says {{OPTION}}.\n{{QUESTION}}"), {"OPTION": F.col("option"), "QUESTION": F.concat(F.lit("Q"), F.col("user_id").cast("string"))}).alias("prompt"))
