"""The segmenter, its statement in SQL, and the table functions: three forms of the same steps."""

import random

import duckdb
import pyarrow as pa
import pytest

from steploom import registry
from steploom.functions import segmenter, tables

WORDS = "alpha beta gamma delta. eps! zeta? Wait Waiting Waité But So Then, Let's Step 3 4) - * \n \n\n \r\n ``` ~~~ $$ \\[ \\] \\( \\) Now é Éa <think> </think>   \x0b   ... ?! 12. \n\n\n".split(" ")


def texts_of(seed, n):
    rng = random.Random(seed)
    return [" ".join(rng.choice(WORDS) if rng.random() < rng.choice([0.05, 0.35]) else rng.choice(["word", "and", "is", "x1", "ok"]) for _ in range(rng.choice([0, 3, 20, 100, 600]))) for _ in range(n)]


def steps_of(text):
    whole = segmenter.normalised(text or "")
    return [(k, a, b, whole[a:b]) for k, (a, b) in enumerate(segmenter.ranges(whole))]


def test_segmenter_equals_its_statement_in_sql():
    texts = [*texts_of(1, 400), None, "", " \n ", "```never closed. Wait", "$$ a $$ b", "one. two"]
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))
    got = sorted(con.sql(registry.oracle_sql()["seg_steps"]).fetchall())
    assert got == [(i, *s) for i, t in enumerate(texts) for s in steps_of(t)] and len(got) > 500


def test_table_functions(spark):
    texts = [*texts_of(2, 30), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    tables.register(spark)
    got = spark.sql("SELECT i, s.* FROM {df}, LATERAL text_steps(text) s", df=df).collect()
    assert sorted(map(tuple, got)) == [(i, *s) for i, t in enumerate(texts) for s in steps_of(t)]
    rows = [(k, i, t) for i, t in enumerate(texts) for k in ["b", None, "a"][i % 3 : i % 3 + 1]]
    traces = spark.createDataFrame(rows, "key string, i int, text string").repartition(3)
    got = spark.sql("SELECT * FROM trace_steps(TABLE(SELECT key, i, text FROM {t}) PARTITION BY key ORDER BY i)", t=traces).collect()
    want = {k: steps_of("\n\n".join(t for key, _, t in rows if key == k and t)) for k in ("a", "b", None)}
    assert sorted(map(tuple, got), key=str) == sorted(((k, *s) for k, some in want.items() for s in some), key=str)
    for bad in ("SELECT * FROM text_steps(1)", "SELECT * FROM trace_steps('x')", "SELECT * FROM trace_steps(TABLE(SELECT 1 AS a) PARTITION BY a)"):
        with pytest.raises(Exception, match="takes a t"):
            spark.sql(bad).collect()


def test_steps_go_out_in_bounded_batches(spark, monkeypatch):
    texts = [*texts_of(3, 60), None, "", " \n "]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], ["i", "text"])
    monkeypatch.setattr(segmenter, "HELD", 2000)
    got = list(segmenter.step_batches(iter([batch, batch.slice(5, 9)])))
    want = [(i, *s) for i, t in enumerate(texts) for s in steps_of(t)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == [*want, *(x for x in want if 5 <= x[0] < 14)]
    assert all(sum(b - a for a, b in zip(x["start"].to_pylist()[:-1], x["end"].to_pylist()[:-1])) < 2000 for x in got) and len(got) > 10
    arrays = segmenter._segments.func(batch["text"])
    assert arrays.to_pylist() == [[{"start": a, "end": b, "text": s} for _, a, b, s in steps_of(t)] for t in texts]


def test_the_table_of_steps_and_the_column(spark):
    texts = [*texts_of(4, 40), None, "", " \n "]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(3)
    want = sorted((i, *s) for i, t in enumerate(texts) for s in steps_of(t))
    assert sorted(map(tuple, segmenter.stepped(df, "t").collect())) == want
    assert sorted((r.i, k, *s) for r in df.select("i", segmenter.segments(df.t).alias("s")).collect() for k, s in enumerate(r.s)) == want
    plan = registry.queries()["seg_steps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "EvalPython" not in plan
