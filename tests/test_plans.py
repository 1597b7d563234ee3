"""Queries as a whole: every row that the survey names, against SQL over the same files that has no cut."""

import duckdb
import pytest

from steploom.registry import queries

DIR = "/root/testdata/sf0.001"


def rows(df):
    return [tuple(r) for r in df.collect()]


def sql(text, folder=DIR):
    """text's rows; a table's name in braces is its file."""
    names = ("conversations", "customer", "documents", "events", "labels", "orders")
    return duckdb.sql(text.format(**{n: f"read_parquet('{folder}/{n}.parquet{'' if folder == DIR else '/*.parquet'}')" for n in names})).fetchall()


NEGATED = r"""SELECT conv_id, turn, regexp_matches(' ' || trim(regexp_replace(trim(translate(lower(trim(text)), '$£€,', '')), '[.!;:]+$', '')) || ' ', ' not | no |n''t | neither | cannot | isn''t | none ') AS negated FROM {conversations}"""


def test_negated_keeps_every_row(spark, tmp_path):
    got = rows(queries()["str4_negated"](spark, DIR))
    assert got and sorted(got) == sorted(sql(NEGATED))
    said = ["It is not.", "None!", "$5, no ;", "another note.", "they don't :", "an isn't", "neither", "68", None]
    spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = rows(queries()["str4_negated"](spark, str(tmp_path)))
    assert [r[2] for r in sorted(got)] == [True, True, True, False, True, True, True, False, None]
    assert sorted(got) == sorted(sql(NEGATED, tmp_path))


ORDERS = {
    "srt1_arm_order": "SELECT o_orderkey, o_orderpriority FROM {orders} ORDER BY CASE o_orderpriority WHEN '5-LOW' THEN 1 WHEN '1-URGENT' THEN 2 WHEN '2-HIGH' THEN 3 END NULLS LAST, o_orderkey",
    "srt2_ranking": "SELECT c_custkey, (c_acctbal NOT BETWEEN 0 AND 5000)::INT AS outside, abs(c_acctbal - 2500) AS distance FROM {customer} ORDER BY 2, 3, 1",
    "srt10_label_queue": "WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS pos FROM {documents} QUALIFY pos < 90) SELECT doc_id, pos FROM d WHERE doc_id NOT IN (SELECT doc_id FROM {labels}) ORDER BY pos",
}


@pytest.mark.parametrize("name", ORDERS)
def test_orders_have_no_cap(spark, name):
    got = rows(queries()[name](spark, DIR))
    assert len(got) > 50 or name == "srt10_label_queue"
    assert got == sql(ORDERS[name])
    if name == "srt1_arm_order":
        assert {p for _, p in got} > {"5-LOW", "1-URGENT", "2-HIGH"}


def test_label_queue_is_the_draw_less_the_labelled(spark):
    queue, draw = rows(queries()["srt10_label_queue"](spark, DIR)), rows(queries()["srt6_sample"](spark, DIR))
    labelled = {r[0] for r in sql("SELECT doc_id FROM {labels}")}
    assert queue == sorted(((d, p) for d, p in draw if d not in labelled), key=lambda r: r[1])


def test_every_flag_is_joined(spark):
    got = rows(queries()["jon9_flags_with_humans"](spark, DIR))
    want = sql("SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'unsound' WHEN toxic = 0 THEN 'sound' END FROM {documents} d LEFT JOIN {labels} USING (doc_id) WHERE d.doc_id % 7 <> 0 AND d.doc_id % 3 IN (0, 1)")
    assert sorted(map(str, got)) == sorted(map(str, want)) and {d % 3 for d, _ in got} == {0, 1}


def test_profile_has_every_kind(spark, tmp_path):
    spark.createDataFrame([(i % 2, f"k{i:04}") for i in range(1100)] + [(2, None), (0, "k0000")], "user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {(u, k): s for u, k, s in rows(queries()["agg2_profile"](spark, str(tmp_path)))}
    assert len(got) == 3 * 1101 and got[0, "k0000"] == 2 / 551 and got[1, "k1099"] == 1 / 550 and got[0, "k1099"] == 0


def test_answer_set_is_made_of_distinct_parts(spark):
    df = queries()["str5_answer_set"](spark, DIR)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2  # no list of all events of a user
    assert sorted(rows(df)) == sorted(sql("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) FROM {events} GROUP BY 1"))


def test_profile_equals_its_sql(spark):
    got = rows(queries()["agg2_profile"](spark, DIR))
    want = sql("WITH u AS (SELECT user_id, count(event_type) AS n FROM {events} GROUP BY 1), k AS (SELECT DISTINCT event_type FROM {events}) SELECT user_id, k.event_type, (SELECT count(*) FROM {events} e WHERE e.user_id = u.user_id AND e.event_type = k.event_type) / n FROM u, k")
    assert sorted(got) == sorted(want)
