"""Text, parsing and step queries over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calculator, segmenter, tables, text
from ..operators.layout import spread
from .base import query


@query(r"""SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS words FROM documents""")
def seg2_word_count(t):
    return t.documents.select("doc_id", text.word_count(F.col("text")).alias("words"))


@query(r"""SELECT doc_id, coalesce(list_extract(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''), -1), '') AS answer FROM documents""")
def str1_final_line(t):
    return t.documents.select("doc_id", text.final_line(F.col("text")).alias("answer"))


@query(r"""SELECT item_id, trim(regexp_replace(trim(replace(lower(trim(text)), ',', '')), '[.!;:]+$', '')) AS plain FROM benchmark""")
def str2_normalise(t):
    return t.benchmark.select("item_id", text.normalise(F.col("text")).alias("plain"))


@query(r"""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id::DOUBLE END AS number FROM events""")
def str3_sole_number(t):
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" $"), F.col("event_id").cast("string"), F.lit("."))).when(F.col("event_id") % 3 == 1, F.lit("5-3")).otherwise(F.lit("none of them"))
    return t.events.select("event_id", text.sole_number(said).alias("number"))


@query(r"""SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE true END AS correct FROM events""")
def str6_check(t):
    k, n = F.col("event_id") % 4, F.col("event_id").cast("string")
    known = F.when(k == 3, "red, blue").otherwise(n)
    said = F.when(k == 0, F.concat(F.lit("$"), n, F.lit("."))).when(k == 1, F.concat(F.lit("it is not "), n)).when(k == 2, F.concat(F.lit("not "), n)).otherwise("Blue and red")
    checker = F.when(k < 2, "exact").when(k == 2, "numeric_tol").otherwise("set_match")
    return t.events.select("event_id", text.check(known, said, checker, F.lit(0.5)).alias("correct"))


@query(r"""SELECT event_id, CASE WHEN length(props) > 6 THEN substr(props, 1, 5) || '…' ELSE props END AS short FROM events""")
def str7_shortened(t):
    return t.events.select("event_id", text.shortened(F.col("props"), 6).alias("short"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS visible FROM pages""")
def str14_visible(t):
    return t.pages.select("page_id", text.visible(F.col("html")).alias("visible"))


@query(r"""SELECT doc_id, regexp_matches(text, '\d\s*[-+*/=]\s*\d|\d\s*[×÷]\s*\d|\d+\s*(?:percent|%)') AS numeric_step FROM documents""")
def flt14_numeric(t):
    return t.documents.select("doc_id", text.is_numeric(F.col("text")).alias("numeric_step"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '^(check|verify|let me check|let me verify|double[- ]check|confirm|recompute|sanity)') THEN 'verification' WHEN regexp_matches(lower(text), '^(wait|actually|hold on|hmm,? no|that''?s wrong|no,|but wait|let me try (a )?different|instead|on second thought|scratch that)') THEN 'backtracking' WHEN regexp_matches(lower(text), '^(first|first,? i|step 1|to (start|begin)|i need to|let''?s start|begin by)') THEN 'subgoal_setting' WHEN regexp_matches(lower(text), '^(to get|for the answer|working backward|what i (ultimately )?need|the answer must)') THEN 'backward_chaining' ELSE 'linear' END AS signal FROM documents""")
def flt42_signal(t):
    return t.documents.select("doc_id", text.signal_class(F.col("text")).alias("signal"))


@query(r"""SELECT event_id, TRY_CAST(props->>'k' AS BIGINT) AS k FROM events""")
def jsn2_props(t):
    return t.events.select("event_id", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"))


@query(r"""SELECT c_custkey, substr(sha256(c_name || chr(31) || c_mktsegment || chr(31) || c_nationkey), 1, 16) AS pin FROM customer""")
def hsh1_fingerprint(t):
    return t.customer.select("c_custkey", text.fingerprint(F.col("c_name"), F.col("c_mktsegment"), F.col("c_nationkey")).alias("pin"))


@query(r"""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp, 'cal-' || strftime(o_orderdate, '%Y-%m-%d') AS run_id FROM orders""")
def dat1_stamps(t):
    return t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"), F.concat(F.lit("cal-"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("run_id"))


@query(r"""SELECT l_orderkey, l_linenumber, (l_quantity::BIGINT + l_linenumber * 2)::VARCHAR AS result FROM lineitem""")
def mth5_calculator(t):
    said = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" + "), F.col("l_linenumber").cast("string"), F.lit(" × 2 ="))
    return t.lineitem.select("l_orderkey", "l_linenumber", calculator.calculated(said)["result"].alias("result"))


@query(r"""SELECT user_id, event_id, (value * 3.0 + 2 * 15.0) / 1e6 AS usd FROM events WHERE event_type = 'purchase'""")
def mth6_cost(t):
    from ..operators import reports

    e = t.events.where("event_type = 'purchase'")
    return e.select("user_id", "event_id", reports.cost(F.col("value"), F.lit(2), F.lit(3.0), F.lit(15.0), F.lit(True)).alias("usd"))


#: White space as the segmenter sees it.
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The segmenter rule by rule: places of code, mathematics, blank lines and sentence ends from the lengths of what stands between them; paragraphs, cuts at
#: markers, short pieces joined, long ranges halved again and again. @SOURCE has doc_id and text.
_STEPS = r"""
WITH RECURSIVE norm AS (
  SELECT doc_id, regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '</?think>', '', 'g'), '^@W+|@W+$', '', 'g') AS t FROM @SOURCE
), found AS (
  SELECT doc_id, 'code' AS kind, regexp_extract_all(t, '(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)') AS ms, regexp_split_to_array(t, '(?s)```.*?(?:```|\z)|~~~.*?(?:~~~|\z)') AS ps FROM norm
  UNION ALL SELECT doc_id, 'maths', regexp_extract_all(t, '(?s)\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$'), regexp_split_to_array(t, '(?s)\\\[.*?\\\]|\\\(.*?\\\)|\$\$.*?\$\$') FROM norm
  UNION ALL SELECT doc_id, 'blank', regexp_extract_all(t, '\n[ \t]*\n@W*'), regexp_split_to_array(t, '\n[ \t]*\n@W*') FROM norm
  UNION ALL SELECT doc_id, 'stop', regexp_extract_all(t, '[.!?]+@W+'), regexp_split_to_array(t, '[.!?]+@W+') FROM norm
  UNION ALL SELECT doc_id, 'line', regexp_extract_all(t, '\n'), regexp_split_to_array(t, '\n') FROM norm
), parts AS (
  SELECT doc_id, kind, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p, unnest(range(len(ms))) AS k FROM found WHERE len(ms) > 0
), spans AS (
  SELECT doc_id, kind, CAST(sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS BIGINT) AS a, CAST(sum(length(p)) OVER w + sum(length(m)) OVER w AS BIGINT) AS b FROM parts WINDOW w AS (PARTITION BY doc_id, kind ORDER BY k)
), code AS (
  SELECT * FROM spans WHERE kind = 'code'
), shields AS (
  SELECT doc_id, a, b FROM code UNION ALL SELECT doc_id, a, b FROM spans s WHERE kind = 'maths' AND NOT EXISTS (SELECT 1 FROM code c WHERE c.doc_id = s.doc_id AND c.a < s.a AND s.a < c.b)
), open AS (
  SELECT * FROM spans s WHERE kind IN ('blank', 'stop', 'line') AND NOT EXISTS (SELECT 1 FROM shields c WHERE c.doc_id = s.doc_id AND c.a < s.a AND s.a < c.b)
), lists AS (
  SELECT doc_id, t, coalesce(list({'a': a, 'b': b} ORDER BY a) FILTER (kind <> 'blank'), []) AS starts, coalesce(list({'a': a, 'b': b} ORDER BY a) FILTER (kind = 'blank'), []) AS blanks FROM norm LEFT JOIN open USING (doc_id) GROUP BY doc_id, t
), rough AS (
  SELECT doc_id, t, starts, unnest(list_prepend(CAST(0 AS BIGINT), list_transform(blanks, lambda x: x.b))) AS a, unnest(list_append(list_transform(blanks, lambda x: x.a), length(t))) AS b FROM lists
), paragraphs AS (
  SELECT doc_id, t, starts, a + length(s) - length(regexp_replace(s, '^@W+', '')) AS a, b - length(s) + length(regexp_replace(s, '@W+$', '')) AS b FROM (SELECT *, substr(t, a + 1, b - a) AS s FROM rough) WHERE regexp_replace(s, '^@W+', '') <> ''
), cuts AS (
  SELECT doc_id, t, starts, a, b, list_sort(list_distinct(list_append(list_append(list_filter(list_transform(list_filter(starts, lambda x: x.a >= paragraphs.a AND x.b < paragraphs.b), lambda x: x.b), lambda s: s > paragraphs.a AND regexp_matches(substr(t, s + 1), '^(?:(?:Wait|Hmm|Actually|Alternatively|However|Let me|Let''s|First|Second|Next|Then|Therefore|Thus|Check|Verify|Now|Instead|Hold on|Recall)(?:[^\p{L}\p{N}_]|\z)|But |So |@W*(?:\p{Nd}+[.)]|[-*]|Step \p{Nd}+))')), a), b))) AS cs FROM paragraphs
), between AS (
  SELECT doc_id, t, starts, unnest(cs[1:len(cs) - 1]) AS a, unnest(cs[2:]) AS b FROM cuts
), pieces AS (
  SELECT doc_id, t, starts, a + length(s) - length(regexp_replace(s, '^@W+', '')) AS a, b - length(s) + length(regexp_replace(s, '@W+$', '')) AS b, len(list_filter(regexp_split_to_array(s, '@W+'), lambda x: x <> '')) AS n
  FROM (SELECT *, substr(t, a + 1, b - a) AS s FROM between) WHERE regexp_replace(s, '^@W+', '') <> ''
), sums AS (
  SELECT *, sum(n) OVER w AS upto FROM pieces WINDOW w AS (PARTITION BY doc_id ORDER BY a)
), opened AS (
  SELECT *, coalesce(lag(upto) OVER (PARTITION BY doc_id ORDER BY a), 0) >= 10 AND n >= 10 AS opens FROM sums
), grouped AS (
  SELECT *, count(*) FILTER (opens) OVER (PARTITION BY doc_id ORDER BY a) AS g FROM opened
), halves AS (
  SELECT doc_id, any_value(t) AS t, any_value(starts) AS starts, min(a) AS a, max(b) AS b FROM grouped GROUP BY doc_id, g
  UNION ALL SELECT doc_id, t, starts, x.a, x.b FROM (
    SELECT doc_id, t, starts, unnest([{'a': a, 'b': a + length(regexp_replace(substr(t, a + 1, cut - a), '@W+$', ''))}, {'a': b - length(regexp_replace(substr(t, cut + 1, b - cut), '^@W+', '')), 'b': b}]) AS x FROM (
      SELECT *, list_sort(list_transform(list_filter(starts, lambda x: x.a >= halves.a AND x.b < halves.b AND x.b > halves.a), lambda x: {'d': abs(2 * x.b - halves.a - halves.b), 's': x.b}))[1].s AS cut
      FROM halves WHERE len(list_filter(regexp_split_to_array(substr(t, a + 1, b - a), '@W+'), lambda x: x <> '')) > 138
    ) WHERE cut IS NOT NULL)
), leaves AS (
  SELECT * FROM halves WHERE len(list_filter(regexp_split_to_array(substr(t, a + 1, b - a), '@W+'), lambda x: x <> '')) <= 138 OR len(list_filter(starts, lambda x: x.a >= halves.a AND x.b < halves.b AND x.b > halves.a)) = 0
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS INTEGER) AS ordinal, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", substr(t, a + 1, b - a) AS text FROM leaves
"""


def steps_of(source: str) -> str:
    return _STEPS.replace("@W", _SPACE).replace("@SOURCE", source)


@query(steps_of("documents"))
def seg_steps(t):
    """Steps of every document, as reasoning text."""
    return segmenter.stepped(spread(t.documents.select("doc_id", "text")), "text")


@query(steps_of("documents"))
def udf4_lateral(t):
    """The steps of every document by a table function, called from SQL for each row."""
    tables.register(t.spark)
    return t.spark.sql("SELECT d.doc_id, s.* FROM {docs} d, LATERAL text_steps(d.text) s", docs=spread(t.documents.select("doc_id", "text")))


@query(steps_of("(SELECT conv_id AS doc_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1)").replace("SELECT doc_id, CAST(row_number()", "SELECT doc_id AS conv_id, CAST(row_number()"))
def udf4_traces(t):
    """The steps of every conversation as one text, by a table function of its turns, partitioned and in order."""
    tables.register(t.spark)
    return t.spark.sql("SELECT key AS conv_id, ordinal, start, `end`, text FROM trace_steps(TABLE(SELECT conv_id AS key, turn, text FROM {turns}) PARTITION BY key ORDER BY turn)", turns=t.conversations)
