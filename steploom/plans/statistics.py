"""Agreement, estimates and grouped studies over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import agreement as A, postings, ranks, reports
from .base import query

WILSON = "(({s} / {n}::DOUBLE + 1.959963984540054 * 1.959963984540054 / (2 * {n})) {sign} 1.959963984540054 * sqrt(({s} / {n}::DOUBLE) * (1 - {s} / {n}::DOUBLE) / {n} + 1.959963984540054 * 1.959963984540054 / (4.0 * {n} * {n}))) / (1 + 1.959963984540054 * 1.959963984540054 / {n})"


def wilson(s: str, n: str) -> tuple[str, str]:
    return f"greatest(0.0, {WILSON.format(s=s, n=n, sign='-').replace(f'/ (1 +', '/ (1 +')})", f"least(1.0, {WILSON.format(s=s, n=n, sign='+')})"


LOW, HIGH = wilson("s", "n")


@query("""WITH c AS (SELECT quality::VARCHAR a, toxic::VARCHAR b, count(*) n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), k AS (SELECT unnest(['0', '1']) x)
SELECT p.x AS truth, q.x AS predicted, coalesce(n, 0) AS n, 0::BIGINT AS n_dropped FROM k p CROSS JOIN k q LEFT JOIN c ON a = p.x AND b = q.x""")
def agg6_confusion(t):
    return A.confusion(t.labels, "quality", "toxic", ["0", "1"])


_AGREE = f"""WITH c AS (SELECT quality::VARCHAR a, toxic::VARCHAR b, count(*) m FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2),
t AS (SELECT sum(m)::BIGINT n, coalesce(sum(m) FILTER (a = b), 0)::BIGINT s FROM c), ra AS (SELECT a x, sum(m) na FROM c GROUP BY 1), rb AS (SELECT b x, sum(m) nb FROM c GROUP BY 1),
e AS (SELECT coalesce(sum(na * nb), 0) chance FROM ra JOIN rb USING (x)), bl AS (SELECT a lab, sum(m)::BIGINT bn FROM c GROUP BY 1 ORDER BY 2 DESC LIMIT 1)
SELECT n, CASE WHEN chance <> n * n THEN (s / n::DOUBLE - chance / (n * n)::DOUBLE) / (1 - chance / (n * n)::DOUBLE) END AS kappa, s / n::DOUBLE AS raw, {LOW} AS raw_low, {HIGH} AS raw_high, lab AS baseline_label, bn / n::DOUBLE AS baseline, 100 * (s / n::DOUBLE - bn / n::DOUBLE) AS over_baseline_pp FROM t, e, bl"""


@query(_AGREE)
def agg14_agreement(t):
    return A.agreement(t.labels, "quality", "toxic", F.col("doc_id"))


@query("""WITH k AS (SELECT unnest(['0', '1']) AS class), p AS (SELECT quality::VARCHAR a, toxic::VARCHAR b FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL),
s AS (SELECT class, (SELECT count(*) FROM p WHERE a = class) support, (SELECT count(*) FROM p WHERE b = class) predicted, (SELECT count(*) FROM p WHERE a = class AND b = class) tp FROM k)
SELECT class, support, predicted, tp, tp / nullif(predicted, 0)::DOUBLE AS "precision", tp / nullif(support, 0)::DOUBLE AS recall, CASE WHEN support > 0 THEN 2 * tp / (support + predicted)::DOUBLE END AS f1 FROM s""")
def agg8_per_class(t):
    return A.per_class(t.labels, "quality", "toxic", ["0", "1"])


@query("""WITH p AS (SELECT source k, quality a, toxic b FROM labels JOIN documents USING (doc_id)), c AS (SELECT k, a, b, count(*) n FROM p GROUP BY ALL),
t AS (SELECT k, sum(n)::BIGINT total, coalesce(sum(n) FILTER (a = b), 0)::BIGINT hits FROM c GROUP BY 1), r AS (SELECT k, a x, sum(n) na FROM c GROUP BY ALL), q AS (SELECT k, b x, sum(n) nb FROM c GROUP BY ALL),
e AS (SELECT k, sum(na * nb)::BIGINT chance FROM r JOIN q USING (k, x) GROUP BY 1)
SELECT k AS source, total AS n, CASE WHEN coalesce(chance, 0) <> total * total THEN (hits / total::DOUBLE - coalesce(chance, 0) / (total * total)::DOUBLE) / (1 - coalesce(chance, 0) / (total * total)::DOUBLE) END AS kappa FROM t LEFT JOIN e USING (k)""")
def agg15_kappa_by_group(t):
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return A.kappa_of(A.cells(d, "quality", "toxic", ["source"]), ["source"]).select("source", F.col("total").alias("n"), "kappa")


@query("""WITH cells AS (SELECT quality::VARCHAR AS a, toxic::VARCHAR AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL),
steps AS (SELECT a, b, n, k, sum(exp(k * ln(n) - n - lgamma(k + 1))) OVER (PARTITION BY a, b ORDER BY k) AS upto FROM (SELECT *, unnest(range(greatest(n - CAST(ceil(8 * sqrt(n)) AS BIGINT) - 10, 0), n + CAST(ceil(8 * sqrt(n)) AS BIGINT) + 11)) AS k FROM cells)),
lists AS (SELECT a, b, min(k) AS first, list(upto ORDER BY k) AS cdf FROM steps GROUP BY a, b),
draws AS (SELECT rep, a, b, md5('20260930:' || rep || ':' || a || ':' || b) AS h FROM lists, range(1, 2001) r(rep)),
us AS (SELECT rep, a, b, (list_reduce(list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', h[i]) - 1 AS BIGINT)), lambda x, y: 16 * x + y) + 0.5) / 4294967296.0 AS u FROM draws),
counts AS (SELECT rep, a, b, first + len(list_filter(cdf, lambda x: x < u)) AS m FROM us JOIN lists USING (a, b)),
every AS (SELECT rep, a, b, m FROM counts UNION ALL SELECT 0, a, b, n FROM cells),
tables AS (SELECT rep, sum(m) AS t, sum(m) FILTER (a = b) AS hits FROM every GROUP BY rep),
sides AS (SELECT rep, c, sum(na) AS na, sum(nb) AS nb FROM (SELECT rep, a AS c, m AS na, 0 AS nb FROM every UNION ALL SELECT rep, b, 0, m FROM every) GROUP BY rep, c),
chance AS (SELECT rep, sum(na * nb) AS s FROM sides GROUP BY rep),
kappas AS (SELECT rep, CASE WHEN s <> t * t THEN (coalesce(hits, 0) / t::DOUBLE - s / (t * t)::DOUBLE) / (1 - s / (t * t)::DOUBLE) END AS kappa FROM tables JOIN chance USING (rep)),
sorted AS (SELECT list(kappa ORDER BY kappa) AS k FROM kappas WHERE rep > 0 AND kappa IS NOT NULL)
SELECT (SELECT kappa FROM kappas WHERE rep = 0) AS value, (SELECT CAST(sum(n) AS BIGINT) FROM cells) AS n, k[1 + CAST(floor(0.025 * len(k)) AS BIGINT)] AS low, k[least(len(k), 1 + CAST(floor(0.975 * len(k)) AS BIGINT))] AS high, len(k) AS defined, '' AS note FROM sorted""")
def agg13_bootstrap_kappa(t):
    return A.bootstrap_kappa(A.cells(t.labels, "quality", "toxic"))


@query(f"""WITH g AS (SELECT source, count(*) FILTER (quality = 1) s, count(*) n FROM labels JOIN documents USING (doc_id) GROUP BY 1)
SELECT source, s AS successes, n, s / n::DOUBLE AS value, {LOW} AS low, {HIGH} AS high FROM g""")
def mth1_wilson_by_source(t):
    d = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    return A.by_group(d, ["source"], F.col("quality") == 1).select("source", "successes", "n", "estimate.value", "estimate.low", "estimate.high")


@query("""SELECT string_agg(x, ',' ORDER BY x) AS absent FROM (SELECT unnest(['0', '1', '2']) x) WHERE x NOT IN (SELECT quality::VARCHAR FROM labels WHERE quality IS NOT NULL) AND x NOT IN (SELECT toxic::VARCHAR FROM labels WHERE toxic IS NOT NULL)""")
def agg12_absent_classes(t):
    return t.labels.agg(F.array_join(A.absent(t.labels, "quality", "toxic", ["0", "1", "2"]), ",").alias("absent"))


_TYPES = ["click", "view", "purchase", "signup", "error"]


@query("""SELECT user_id, event_type, n / sum(n) OVER (PARTITION BY user_id)::DOUBLE AS share FROM (SELECT u.user_id, k.event_type, coalesce(c.n, 0) n FROM (SELECT DISTINCT user_id FROM events) u CROSS JOIN (SELECT DISTINCT event_type FROM events) k
LEFT JOIN (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL) c ON c.user_id = u.user_id AND c.event_type = k.event_type)""")
def agg2_profile(t):
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    total = n.groupBy("user_id").agg(F.sum(F.when(F.col("event_type").isNotNull(), F.col("n"))).alias("total"))
    every = total.crossJoin(t.events.select("event_type").distinct())
    own = n.select(F.col("user_id").alias("u"), F.col("event_type").alias("k"), "n")
    share = stats.ratio(F.coalesce("n", F.lit(0)), F.col("total"))
    return every.join(own, F.col("user_id").eqNullSafe(F.col("u")) & (F.col("event_type") == F.col("k")), "left").select("user_id", "event_type", share.alias("share"))


@query("""SELECT user_id, count(*) FILTER (v = 'sound') / count(*)::DOUBLE AS soundness_score, count(*) FILTER (v <> 'sound') AS flagged FROM (SELECT user_id, CASE WHEN value >= 20 THEN 'sound' WHEN value >= 5 THEN 'unsound' ELSE 'unverifiable' END v FROM events) GROUP BY 1""")
def agg3_soundness(t):
    v = F.when(F.col("value") >= 20, "sound").when(F.col("value") >= 5, "unsound").otherwise("unverifiable")
    return reports.soundness(t.events.withColumn("v", v), ["user_id"], "v")


@query("""WITH w AS (SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') u, count(*) FILTER (o_orderpriority = '5-LOW') l, max(CASE WHEN o_orderpriority = '1-URGENT' THEN (o_orderstatus = 'F')::INT END) uk, max(CASE WHEN o_orderpriority = '5-LOW' THEN (o_orderstatus = 'F')::INT END) lk FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN u > 0 AND l > 0 THEN u / l::DOUBLE END AS cost_of_thought, 100.0 * (uk - lk) AS accuracy_delta_pp FROM w""")
def agg5_scoreboard(t):
    urgent, low = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "5-LOW"
    ok = (F.col("o_orderstatus") == "F").cast("int")
    wide = t.orders.groupBy("o_custkey").agg(F.count_if(urgent).alias("u"), F.count_if(low).alias("l"), F.max(F.when(urgent, ok)).alias("uk"), F.max(F.when(low, ok)).alias("lk"))
    return reports.scoreboard(wide, "u", "l", "uk", "lk").select("o_custkey", "cost_of_thought", F.col("accuracy_delta_pp").cast("double").alias("accuracy_delta_pp"))


@query("""SELECT least(floor(least(value, 100.0) / 5.0), 19)::BIGINT AS bucket, count(*) AS n FROM events GROUP BY 1""")
def agg36_histogram(t):
    return t.events.groupBy(F.least(F.floor(F.least("value", F.lit(100.0)) / 5.0), F.lit(19)).cast("long").alias("bucket")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT value, count(*) n FROM events GROUP BY 1) SELECT min(value) AS low, (SELECT median(value) FROM events) AS middle, max(value) AS high, max(value) - min(value) AS spread, count(*) AS n_distinct, max(n) / sum(n)::DOUBLE AS identical_share FROM c""")
def agg37_summary(t):
    e = t.events.groupBy("value").agg(F.count("*").alias("n"))
    return e.agg(F.min("value").alias("low"), F.max("value").alias("high"), (F.max("value") - F.min("value")).alias("spread"), F.count("*").alias("n_distinct"), stats.ratio(F.max("n"), F.sum("n")).alias("identical_share")).crossJoin(ranks.medians(t.events, [], "value", "middle"))


@query("""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, min(value) AS low, max(value) AS high, avg(value) AS mean, stddev_samp(value) AS sd, count(*) FILTER (value > 50) AS over_budget FROM events GROUP BY 1""")
def agg39_latency(t):
    e = t.events.select("event_type", "value")
    rest = e.groupBy("event_type").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count_if(F.col("value") > 50).alias("over_budget"))
    return ranks.nearest(e, ["event_type"], "value", {"p50": 0.5, "p90": 0.9}).drop("n").join(rest, "event_type")


@query("""SELECT 'all' AS scope, min(n) AS low, median(n) AS middle, avg(n) AS mean, max(n) AS high, count(*) FILTER (n > 5) AS n_over FROM (SELECT conv_id, count(*) n FROM conversations GROUP BY 1)""")
def agg38_trace_lengths(t):
    n = t.conversations.groupBy("conv_id").agg(F.count("*").alias("n"))
    return n.agg(F.lit("all").alias("scope"), F.min("n").alias("low"), F.median("n").alias("middle"), F.avg("n").alias("mean"), F.max("n").alias("high"), F.count_if(F.expr("n > 5")).alias("n_over"))


@query("""SELECT source AS tag, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1""")
def agg29_tag_index(t):
    return t.documents.groupBy(F.col("source").alias("tag")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("""WITH p AS (SELECT tag, id, (row_number() OVER (PARTITION BY tag ORDER BY id) - 1) // 16 AS block FROM (SELECT DISTINCT role AS tag, conv_id AS id FROM conversations))
SELECT tag, block, min(id) AS first, CAST(count(*) AS INTEGER) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM p GROUP BY tag, block""")
def agg30_ids_by_tag(t):
    """The conversations of each role, in blocks; a role that most of them have is in many."""
    blocks = postings.posted(t.conversations, "role", "conv_id", 16)
    ids = postings.listed(blocks).select(F.col("tag").alias("t"), F.col("block").alias("b"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))
    both = blocks.join(ids, F.col("tag").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")))
    return both.select("tag", "block", "first", "n", "ids")


@query("""SELECT event_type AS cue, user_id % 4 AS regime, count(*) AS n, count(*) FILTER (value > 40) AS flips, count(*) FILTER (value > 40 AND event_id % 3 <> 0) AS silent, count(*) FILTER (value > 40) / count(*)::DOUBLE AS flip_rate FROM events GROUP BY ALL""")
def agg28_cue_by_regime(t):
    flip = F.col("value") > 40
    return t.events.groupBy(F.col("event_type").alias("cue"), (F.col("user_id") % 4).alias("regime")).agg(F.count("*").alias("n"), F.count_if(flip).alias("flips"), F.count_if(flip & (F.col("event_id") % 3 != 0)).alias("silent"), stats.ratio(F.count_if(flip), F.count("*")).alias("flip_rate"))


@query("""SELECT l_returnflag AS arm, l_linestatus AS regime, count(*) FILTER (l_quantity < 10) AS trap, count(*) FILTER (l_quantity >= 10 AND l_quantity < 40) AS correct, count(*) FILTER (l_quantity >= 40) AS other, count(*) AS n FROM lineitem GROUP BY ALL""")
def agg31_tally(t):
    q = F.col("l_quantity")
    return t.lineitem.groupBy(F.col("l_returnflag").alias("arm"), F.col("l_linestatus").alias("regime")).agg(F.count_if(q < 10).alias("trap"), F.count_if((q >= 10) & (q < 40)).alias("correct"), F.count_if(q >= 40).alias("other"), F.count("*").alias("n"))


@query("""SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) FILTER (event_id % 2 = 0) >= 1 AND count(*) FILTER (event_id % 2 = 1) >= 3""")
def agg32_earned(t):
    return t.events.groupBy("user_id", "event_type").agg(F.count_if(F.expr("event_id % 2 = 0")).alias("a"), F.count_if(F.expr("event_id % 2 = 1")).alias("b")).where("a >= 1 and b >= 3").select("user_id", "event_type")


@query("""SELECT lang, count(*) AS n, count(*) FILTER (quality IS NOT NULL) AS labelled, count(*) FILTER (quality IS NULL) AS unmatched, count(*) FILTER (quality IS NULL) = 0 AS ready FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def agg17_coverage(t):
    d = t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.expr("quality is null")).alias("unmatched"), (F.count_if(F.expr("quality is null")) == 0).alias("ready"))


@query("""SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(lower(text), '^(the|that)')) AS marked FROM conversations GROUP BY 1""")
def agg35_marker_coverage(t):
    return t.conversations.groupBy("role").agg(F.count("*").alias("n"), F.count_if(F.lower("text").rlike("^(the|that)")).alias("marked"))


@query("""WITH c AS (SELECT user_id, event_type, count(*) n FROM events GROUP BY ALL), m AS (SELECT user_id, max(n) m, sum(n)::BIGINT total FROM c GROUP BY 1) SELECT user_id, m * 2 > total AS dominated FROM m""")
def agg44_deviation(t):
    c = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return c.groupBy("user_id").agg((F.max("n") * 2 > F.sum("n")).alias("dominated"))


@query("""SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS hardest, arg_min(o_orderkey, (o_totalprice, o_orderkey)) AS cheapest FROM (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) GROUP BY 1""")
def agg49_hardest_cheapest(t):
    key = F.struct("o_totalprice", "o_orderkey")
    return t.orders.groupBy("o_custkey").agg(F.max_by("o_orderkey", key).alias("hardest"), F.min_by("o_orderkey", key).alias("cheapest"))


@query("""SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN value END) AS spent, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY 1""")
def agg50_spend(t):
    buy = F.col("event_type") == "purchase"
    return t.events.groupBy("user_id").agg(F.sum(F.when(buy, F.col("value"))).alias("spent"), F.count_if(buy).alias("n"))


@query("""SELECT count(*) AS calls, count(*) FILTER (event_type = 'error') AS degraded, count(*) FILTER (event_type = 'error') / nullif(count(*), 0)::DOUBLE AS share, count(DISTINCT user_id) AS traces FROM events""")
def agg34_reliability(t):
    bad = F.count_if(F.col("event_type") == "error")
    return t.events.agg(F.count("*").alias("calls"), bad.alias("degraded"), stats.ratio(bad, F.count("*")).alias("share"), F.count_distinct("user_id").alias("traces"))
