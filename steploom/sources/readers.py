"""Readers with explicit schemas: JSON documents, JSON lines, small dimensions. Spark lists and reads all paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SPAN = "struct<name:string,spanId:string,parentSpanId:string,attributes:variant,events:array<variant>>"
ITEM = "id string, prompt string, tags array<string>, known_answer variant, checker string, tolerance double, is_trap boolean, trap_note string, trap_answers array<string>, source string, retired_from string"
LABEL = "step_id string, item_id string, strategy string, text string, behavior_label string, soundness_label string, annotator string, labeled_at string, rubric_version string, notes string, skipped boolean"
STEP = "struct<step_id:string,kind:string,text:string,behavior:struct<label:string,confidence:double>,validity:struct<verdict:string,confidence:double,error_type:string,escalated:boolean,rationale:string>>"
REPORT = f"item struct<id:string,tags:array<string>,is_trap:boolean>, generated_at string, arms array<struct<strategy:string,status:string,trace_quality:string,final_answer:string,correct:boolean,steps:array<{STEP}>>>"


def span_files(spark: SparkSession, path: str) -> DataFrame:
    """item_id, strategy (from the file name `item.strategy.json`), pos, span: whole trees, either enveloped or a bare list."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.([^./]+)\.json$", 1).alias("item_id"), F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.([^./]+)\.json$", 2).alias("strategy"), "value")
    tree = F.try_parse_json("value")
    listed = F.coalesce(F.try_variant_get(tree, "$.resourceSpans", "array<variant>"), F.try_variant_get(tree, "$", "array<variant>"))
    return whole.select("item_id", "strategy", F.posexplode_outer(listed).alias("pos", "span"))


def span_lines(spark: SparkSession, path: str) -> DataFrame:
    """item_id, strategy, pos, span: the trees that `writers.write_lines` has written, one a line."""
    rows = spark.read.schema("item_id string, strategy string, spans array<variant>").json(path)
    return rows.select("item_id", "strategy", F.posexplode_outer("spans").alias("pos", "span"))


def items(spark: SparkSession, path: str) -> DataFrame:
    """The bank, one JSON document an item; answers as an array, with answer_is_list."""
    raw = spark.read.schema(ITEM).json(path, multiLine=True)
    listed = F.try_variant_get("known_answer", "$", "array<string>")
    return raw.withColumn("answers", F.coalesce(listed, F.array(F.try_variant_get("known_answer", "$", "string")))).withColumn("answer_is_list", listed.isNotNull()).drop("known_answer")


def labels(spark: SparkSession, path: str, held: DataFrame | None = None, held_file: str | None = None) -> DataFrame:
    """Appended labels, with their file and their place in it (line_no, which orders the lines of a file however it is split); a missing annotator is the file's name.

    held (step_id) are the held-out steps, whose labels go whatever file they are in; held_file names a file that goes as a whole.
    """
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    raw = spark.read.schema(LABEL).json(path).select("*", F.col("_metadata.file_name").alias("source_file"), place.alias("line_no"))
    rows = raw.withColumn("annotator", F.coalesce("annotator", F.regexp_extract("source_file", r"^(.*?)\.[^.]*$", 1)))
    if held_file is not None:
        rows = rows.where(F.col("source_file") != held_file)
    return rows if held is None else rows.join(held.select("step_id"), "step_id", "left_anti")


def live_labels(labels: DataFrame) -> DataFrame:
    """The last label of each (annotator, step_id): by file name, then by place in the file."""
    rest = [c for c in labels.columns if c not in ("annotator", "step_id")]
    last = labels.where("step_id is not null").groupBy("annotator", "step_id").agg(F.max_by(F.struct(*rest), F.struct("source_file", "line_no")).alias("r"))
    return last.select("annotator", "step_id", "r.*")


def reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path, multiLine=True).withColumn("source_file", F.col("_metadata.file_name"))


def predictions(report: DataFrame, unique: bool = False) -> DataFrame:
    """step_id, behavior, verdict of all arms; the later file's row wins, or with unique a repeated step is an error."""
    arms = report.select("source_file", F.col("item.id").alias("item_id"), F.explode("arms").alias("arm"))
    steps = arms.select("source_file", "item_id", F.col("arm.strategy").alias("strategy"), F.explode("arm.steps").alias("s")).select("source_file", "item_id", "strategy", "s.step_id", "s.kind", F.col("s.behavior.label").alias("behavior"), F.col("s.validity.verdict").alias("verdict"), F.col("s.validity.confidence").alias("confidence"))
    rest = ["source_file", "item_id", "strategy", "kind", "behavior", "verdict", "confidence"]
    last = steps.groupBy("step_id").agg(F.max_by(F.struct(*rest), "source_file").alias("r"), F.count("*").alias("copies"))
    if unique:
        last = last.withColumn("copies", F.when(F.assert_true(F.col("copies") == 1, F.lit("a step has several predictions")).isNull(), F.col("copies")))
    return last.select("step_id", "r.*", "copies")


def facts(spark: SparkSession, path: str) -> DataFrame:
    """key, value of a fact corpus."""
    return spark.read.schema("facts map<string,string>").json(path, multiLine=True).select(F.explode("facts").alias("key", "value"))


def recorded(responses: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (name, digest) with its recorded payload; another digest than the recorded one is refused, none recorded is accepted."""
    found = wanted.join(responses.withColumnRenamed("digest", "recorded_digest"), "name", "left")
    fits = F.coalesce(F.col("recorded_digest").isNull() | (F.col("recorded_digest") == F.col("digest")), F.lit(False))
    return found.withColumn("refused", ~fits).withColumn("payload", F.when(fits, F.col("payload")))


def merged_reports(measured: DataFrame, authored: DataFrame, key: str) -> DataFrame:
    """Measured rows, and authored ones whose key is not measured."""
    return measured.withColumn("measured", F.lit(True)).unionByName(authored.join(measured.select(key), key, "left_anti").withColumn("measured", F.lit(False)))


def tolerant(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """file_name, value: a whole JSON document a file, NULL where it is malformed or has another shape."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), "value")
    return raw.select("file_name", F.try_variant_get(F.try_parse_json("value"), "$", f"struct<{schema}>").alias("value"))


def trials(spark: SparkSession, path: str, schema: str, keys: list[str]) -> DataFrame:
    """Trials of all files; of those with the same keys, the one of the first file by name, then of the first place in it."""
    whole = spark.read.schema(f"trials array<struct<{schema}>>").json(path, multiLine=True).select(F.col("_metadata.file_name").alias("file_name"), F.posexplode("trials").alias("place", "t"))
    flat = whole.select("file_name", "place", "t.*")
    rest = [c for c in flat.columns if c not in keys]
    return flat.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("file_name", "place")).alias("r")).select(*keys, "r.*").drop("place")


def named(df: DataFrame, part: str) -> DataFrame:
    """Rows of the files whose name holds `part`."""
    return df.where(F.contains("source_file", F.lit(part)))


def held_out_ids(spark: SparkSession, path: str, first: int = 40) -> DataFrame:
    """pos, step_id of a recorded draw, from place `first` on."""
    draw = spark.read.schema("draw struct<ordered_step_ids:array<string>>").json(path, multiLine=True)
    return draw.select(F.posexplode("draw.ordered_step_ids").alias("pos", "step_id")).where(F.col("pos") >= first)


def replays(spark: SparkSession, path: str) -> DataFrame:
    """Replayed cases in order of case_id."""
    return spark.read.schema(f"case_id string, mutated_step_id string, judge_flagged_the_mutated_step boolean, judge_flagged_steps array<string>, report struct<{REPORT.replace(' string', ':string').replace(' struct', ':struct').replace(' array', ':array')}>").json(path, multiLine=True).orderBy("case_id")


def pin(spark: SparkSession, fields: list[str], prefix: str) -> DataFrame:
    """One row of the pin's fields from the session's settings `prefix.field`; NULL where unset."""
    values = [spark.conf.get(f"{prefix}.{f}", None) for f in fields]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{f} string" for f in fields))


def latency_of(runs: DataFrame, item: str, place: str = "place") -> DataFrame:
    """The first finished run of an item, by its place in the record, if there is one."""
    return runs.where((F.col("item") == item) & (F.col("status") == "done")).orderBy(place).limit(1)


def thoughts(steps: DataFrame) -> DataFrame:
    """Thought steps with the name of their trace."""
    return steps.where("kind = 'thought'").select(F.concat_ws(":", "item_id", "strategy").alias("trace"), "step_id", "text")


def setting(spark: SparkSession, name: str, default: str) -> str:
    """A path or a flag: the session's setting, else the default."""
    return spark.conf.get(name, None) or default
