"""Span trees to typed calls, tools, traces and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.segmenter import segments
from ..functions.stats import truthy
from ..functions.text import final_line, strip

STRATEGIES = ["direct", "thinking", "react"]


def attribute(name: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.try_variant_get("span", "$.attributes", "variant"), f'$["{name}"]', kind)


def spans(raw: DataFrame, prefix: str) -> DataFrame:
    """item_id, strategy, pos, span -> typed columns. prefix names the attributes of the emitting application."""
    a = lambda n, k="string": attribute(f"{prefix}.{n}", k)
    return raw.select(
        "item_id", "strategy", "pos", F.coalesce(attribute("openinference.span.kind"), F.lit("")).alias("kind"), F.try_variant_get("span", "$.name", "string").alias("name"),
        F.try_variant_get("span", "$.spanId", "string").alias("span_id"), a("strategy").alias("root_strategy"), a("trace_quality").alias("declared"), F.coalesce(a("seq", "int"), F.col("pos")).alias("seq"),
        F.coalesce(a("turn", "int"), F.lit(0)).alias("turn"), a("tool.ok", "boolean").alias("ok"), a("token_count.reasoning", "long").alias("reasoning_tokens"), a("token_count.answer", "long").alias("answer_tokens"), a("tokenizer").alias("tokenizer"),
        attribute("llm.output_messages.0.message.content").alias("content"), attribute("llm.output_messages.0.message.reasoning").alias("reasoning"), attribute("llm.token_count.prompt", "long").alias("prompt_tokens"),
        attribute("llm.token_count.completion", "long").alias("completion_tokens"), attribute("tool.name").alias("tool"), attribute("input.value", "variant").alias("input"), attribute("output.value").alias("output"),
    )


def calls(s: DataFrame) -> DataFrame:
    number = F.row_number().over(W.partitionBy("item_id", "strategy").orderBy("pos")) - 1
    return s.where("kind = 'LLM'").select("item_id", "strategy", F.coalesce("span_id", F.concat(F.lit("llm-"), number)).alias("span_id"), "seq", "turn", F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.coalesce("content", F.lit("")).alias("content"), "reasoning_tokens", "answer_tokens", "tokenizer", "prompt_tokens", "completion_tokens")


def tools(s: DataFrame) -> DataFrame:
    number = F.row_number().over(W.partitionBy("item_id", "strategy").orderBy("pos")) - 1
    plain = F.try_variant_get("input", "$", "string")
    shown = F.when(F.schema_of_variant("input") == "STRING", plain).otherwise(F.to_json("input"))
    return s.where("kind = 'TOOL'").select("item_id", "strategy", F.coalesce("span_id", F.concat(F.lit("tool-"), number)).alias("span_id"), "seq", "turn", F.coalesce("tool", "name", F.lit("tool")).alias("name"), F.coalesce(shown, F.lit("")).alias("arguments"), F.coalesce("output", F.lit("")).alias("observation"), "ok")


def traces(s: DataFrame) -> DataFrame:
    """A row for each trace: usage, answer, quality. Sums of what no span reported are NULL; a reported 0 stays."""
    root = s.where("kind = 'CHAIN' and root_strategy is not null").groupBy("item_id", "strategy").agg(F.min_by("declared", "pos").alias("declared"))
    per = calls(s).groupBy("item_id", "strategy").agg(
        F.sum(F.coalesce("prompt_tokens", F.lit(0))).alias("input_tokens"), F.sum(F.coalesce("completion_tokens", F.lit(0))).alias("output_tokens"), F.sum("reasoning_tokens").alias("reasoning_tokens"), F.sum("answer_tokens").alias("answer_tokens"),
        F.min_by("tokenizer", F.when(truthy(F.col("tokenizer")).isNotNull(), F.col("seq"))).alias("tokenizer"), F.count("*").alias("turns"), F.max_by("content", "seq").alias("last_content"), F.bool_or(F.col("reasoning") != "").alias("reasoned"),
    )
    answer = final_line(F.col("last_content"))
    quality = F.when(F.col("declared").isin("full", "partial", "provider_summarised"), F.col("declared")).when(F.col("reasoned") & (answer != ""), "full").otherwise("partial")
    return per.join(root, ["item_id", "strategy"], "left").select("*", answer.alias("final_answer"), quality.alias("trace_quality")).drop("declared", "reasoned")


def _numbered(parts: DataFrame, order: list) -> DataFrame:
    out = parts.withColumn("ordinal", (F.row_number().over(W.partitionBy("item_id", "strategy").orderBy(*order)) - 1).cast("int"))
    return out.withColumn("step_id", F.concat_ws(":", "strategy", "span_id", "ordinal")).select("item_id", "strategy", "step_id", "ordinal", "kind", "text", "span_id", "start", "end", F.lit(None).cast("int").alias("tokens_out"))


def steps(call: DataFrame, tool: DataFrame) -> DataFrame:
    """Steps of all traces: linear strategies by the segmenter over the first call's reasoning, react by structure, the answer last."""
    key = ["item_id", "strategy"]
    none = F.lit(None).cast("int")
    linear = call.where("strategy <> 'react'").groupBy(*key).agg(F.min_by(F.struct("span_id", "reasoning"), "seq").alias("c")).select(*key, "c.span_id", F.posexplode(segments(F.col("c.reasoning"))).alias("i", "s")).select(*key, F.lit(0).alias("seq"), F.col("i").alias("sub"), F.lit("thought").alias("kind"), "s.text", "span_id", "s.start", "s.end")
    react = call.where("strategy = 'react'").withColumn("text", strip(F.col("reasoning"))).where("text <> ''")
    before = F.coalesce(F.sum(F.length("text") + 2).over(W.partitionBy(*key).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast("int")
    thoughts = react.withColumn("start", before).select(*key, "seq", F.lit(0).alias("sub"), F.lit("thought").alias("kind"), "text", "span_id", "start", (F.col("start") + F.length("text")).alias("end"))
    used = tool.where("strategy = 'react'").select(*key, "seq", F.explode(F.array(F.struct(F.lit(1).alias("sub"), F.lit("tool_call").alias("kind"), F.concat("name", F.lit("("), "arguments", F.lit(")")).alias("text")), F.struct(F.lit(2).alias("sub"), F.lit("observation").alias("kind"), strip(F.col("observation")).alias("text")))).alias("x"), "span_id")
    used = used.select(*key, "seq", "x.sub", "x.kind", "x.text", "span_id", none.alias("start"), none.alias("end"))
    last = call.groupBy(*key).agg(F.max_by(F.struct("span_id", "content"), "seq").alias("c")).select(*key, F.lit(2147483647).alias("seq"), F.lit(0).alias("sub"), F.lit("answer").alias("kind"), strip(F.col("c.content")).alias("text"), F.col("c.span_id").alias("span_id"), none.alias("start"), none.alias("end")).where("text <> ''")
    return _numbered(linear.unionByName(thoughts).unionByName(used).unionByName(last), ["seq", "sub"])


def violations(step: DataFrame) -> DataFrame:
    """rule, key, detail: broken invariants of a steps table."""
    key = ["item_id", "strategy"]
    bad_id = step.where(~F.col("step_id").eqNullSafe(F.concat_ws(":", "strategy", "span_id", "ordinal"))).select(F.lit("step_id").alias("rule"), F.col("step_id").alias("key"), F.lit("not strategy:span:ordinal").alias("detail"))
    twice = step.groupBy("step_id").count().where("count > 1").select(F.lit("unique").alias("rule"), F.col("step_id").alias("key"), F.col("count").cast("string").alias("detail"))
    per = step.groupBy(*key).agg(F.count("*").alias("n"), F.count_distinct("ordinal").alias("d"), F.max("ordinal").alias("m"), F.count_if(F.expr("kind = 'answer'")).alias("a"), F.max_by("kind", "ordinal").alias("last"))
    name = F.concat_ws(":", *key)
    gap = per.where("n <> d or m + 1 <> n").select(F.lit("dense").alias("rule"), name.alias("key"), F.lit("ordinals are not 0 to n - 1").alias("detail"))
    answer = per.where("a > 1 or (a = 1 and last <> 'answer')").select(F.lit("answer").alias("rule"), name.alias("key"), F.lit("not one, or not last").alias("detail"))
    return bad_id.unionByName(twice).unionByName(gap).unionByName(answer)
