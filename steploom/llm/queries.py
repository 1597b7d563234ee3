"""Queries of the training-data operators over whole tables, and SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, decontam, fm, jaccard, langid, passages, pii, rans, resample, rlz, sketch, slots
from .common import documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op2_rans_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.stored_ids(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2)


def op3_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rlz.deduplicated(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_mixture_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.sharded(_table(spark, sf_dir, "documents"), 16, map_path=slots.map_folder(spark))


def op6_pii_bilstm_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans(documents(spark, sf_dir))


def op7_scaled_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.fingerprinted(_table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(documents(spark, sf_dir))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm.scored(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op12_bwt_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.deduplicated(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    all_ = (op1_bpe_round_trip, op2_rans_token_files, op3_rlz_dedup, op4_mixture_langid, op5_virtual_slots, op6_pii_bilstm_crf, op7_scaled_sketch, op8_jaccard_join, op9_decontamination, op10_quality_fm, op11_importance_resampling, op12_bwt_dedup, op13_filter_audit, pipeline)
    return {f.__name__: f for f in all_}


_OP3 = r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), wins AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM words WHERE len(ws) >= 13)
), firsts AS (
  SELECT win, min(doc_id) AS first_id FROM wins GROUP BY win
), hits AS (
  SELECT doc_id, i FROM wins JOIN firsts USING (win) WHERE first_id < doc_id
), covered AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM hits, range(13) r(k)
), each_word AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM words
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS t, count(*) AS n FROM each_word ANTI JOIN covered USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

_OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM common JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE c >= 0.8 * (s.n + t.n - c)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), classes AS (
  SELECT x AS doc_id, min(y) AS class_id FROM reach GROUP BY x
), counts AS (
  SELECT x AS doc_id, count(*) AS n_links FROM links GROUP BY x
)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links FROM classes LEFT JOIN counts USING (doc_id)
"""


_OP11 = r"""
WITH RECURSIVE rounds AS (
  SELECT i, i AS v, 0 AS k FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM rounds WHERE k < 8
), crc_table AS (
  SELECT list(v ORDER BY i) AS tab FROM rounds WHERE k = 8
), texts AS (
  SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), text FROM benchmark
), words AS (
  SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts
), grams AS (
  SELECT kind, doc_id, unnest(ws) AS g FROM words
  UNION ALL SELECT kind, doc_id, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM words WHERE len(ws) > 1
), hexed AS (
  SELECT g, hex(encode(g)) AS h FROM (SELECT DISTINCT g FROM grams)
), bytes AS (
  SELECT g, list_transform(range(len(h) // 2), lambda i: 16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bs FROM hexed
), buckets AS (
  SELECT g, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bs), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc_table
), counts AS (
  SELECT kind, doc_id, bucket, count(*) AS n FROM grams JOIN buckets USING (g) GROUP BY ALL
), sums AS (
  SELECT b.bucket, coalesce(sum(n) FILTER (kind = 'd'), 0) AS s, coalesce(sum(n) FILTER (kind = 'b'), 0) AS t FROM range(10000) b(bucket) LEFT JOIN counts USING (bucket) GROUP BY b.bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (sum(s) OVER () + 10000) / (CAST(s + 1 AS DOUBLE) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain FROM sums
), means AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM counts JOIN gains USING (bucket) WHERE kind = 'd' GROUP BY doc_id
), hashed AS (
  SELECT doc_id, len(ws) AS n_words, list_reduce(list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', sha256('7:' || doc_id)[i]) - 1 AS BIGINT)), lambda a, b: 16 * a + b) AS h FROM words WHERE kind = 'd'
), scored AS (
  SELECT doc_id, n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM hashed LEFT JOIN means USING (doc_id)
), places AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank FROM scored LEFT JOIN places USING (doc_id)
"""

_OP12 = r"""
WITH hexed AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents
), strings AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(n - 49)) AS i FROM hexed WHERE n >= 50)
), firsts AS (
  SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s
), hits AS (
  SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS begins FROM strings JOIN firsts USING (s) WHERE first_id < doc_id
), numbered AS (
  SELECT doc_id, i, sum(begins) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM hits
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span
), gaps AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans
), cut AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept
  FROM gaps JOIN hexed USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM hexed LEFT JOIN cut USING (doc_id)
"""

_OP13 = r"""
WITH marked AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), lab AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id
), firsts AS (
  SELECT t, min(doc_id) AS first_id FROM marked GROUP BY t
), judged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    MAP {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), 'D': regexp_matches(t, '[#$%&*|]'), 'E': coalesce(first_id < doc_id, false)} AS f
  FROM marked LEFT JOIN firsts USING (t) LEFT JOIN lab USING (doc_id)
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT o, s, o[s] AS c, string_split(o[1:s - 1], '') AS before FROM orders, range(1, 6) r(s)
), sums AS (
  SELECT part, o, s, c,
    count(*) FILTER (NOT f[c] AND NOT early) AS kept, count(*) FILTER (f[c] AND NOT early) AS removed, count(*) FILTER (f[c] AND early) AS redundant,
    count(*) FILTER (f[c] AND len(list_filter(['A', 'B', 'C', 'D', 'E'], lambda x: f[x])) = 1) AS unique_fails,
    count(*) FILTER (f[c] AND NOT early AND good = 1) AS good_lost, count(*) FILTER (f[c] AND NOT early AND toxic = 1) AS toxic_lost
  FROM (SELECT j.*, o, s, c, len(list_filter(before, lambda x: x <> '' AND f[x])) > 0 AS early FROM judged j, steps)
  GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(s AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, c) AS BIGINT) AS shapley FROM sums
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_rlz_dedup": _OP3, "op8_jaccard_join": _OP8, "op11_importance_resampling": _OP11, "op12_bwt_dedup": _OP12, "op13_filter_audit": _OP13}
