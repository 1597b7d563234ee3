"""Judgements: payloads, escalation, consistency, whole-trace degradation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import is_numeric, shortened, unfenced
from .picks import with_totals

VERDICTS = ["sound", "unsound", "unverifiable"]
BEHAVIOURS = ["verification", "backtracking", "subgoal_setting", "backward_chaining", "linear"]
ERRORS = ["arithmetic", "logical", "factual", "constraint_violation", "unsupported_leap"]
PAYLOAD = "struct<steps:array<struct<step_id:string,behavior:string,behavior_confidence:double,verdict:string,validity_confidence:double,error_type:string,rationale:string>>>"


def doubtful(verdict: Column, confidence: Column, text: Column, low: float = 0.70, numeric_low: float = 0.85) -> Column:
    """Whether a step is judged again: unsound, or unsure, or unsure enough about a computation."""
    return F.coalesce((verdict == "unsound") | (confidence < low) | (is_numeric(text) & (confidence < numeric_low)), F.lit(False))


def doubtful_before(verdict: Column, confidence: Column, text: Column) -> Column:
    """The rule before its amendment: anything not sound."""
    return F.coalesce((verdict != "sound") | (confidence < 0.70) | (is_numeric(text) & (confidence < 0.85)), F.lit(False))


def selected(rows: DataFrame, trace: list[str], chosen: Column, order: str, cap: int = 8) -> DataFrame:
    """The most doubtful steps of each trace, with n_selected, capped, and rate (of the trace's steps)."""
    marked = rows.withColumn("chosen", chosen)
    order_by = [(F.col("verdict") == "sound").cast("int"), "validity_confidence", order]
    top = marked.where("chosen").withColumn("rank", F.row_number().over(W.partitionBy(*trace).orderBy(*order_by))).where(F.col("rank") <= cap)
    n = marked.groupBy(*trace).agg(F.count("*").alias("n_steps"), F.count_if(F.col("chosen")).alias("n_selected"))
    return with_totals(top, n, trace).withColumn("capped", F.col("n_selected") > cap).withColumn("rate", F.try_divide("n_selected", "n_steps"))


def consistency_of(n_steps: Column, verdict: Column, known_citations: Column) -> Column:
    """The consistency of a trace, NULL where nothing was judged: fewer than two steps, or a check that failed (a NULL verdict)."""
    return F.when((n_steps >= 2) & verdict.isNotNull(), consistency(verdict, known_citations))


def consistency(verdict: Column, known_citations: Column) -> Column:
    """A contradiction that cites no known step is taken back to underdetermined."""
    down = (verdict == "contradicts") & (F.coalesce(F.size(known_citations), F.lit(0)) <= 0)
    final = F.when(down, "underdetermined").otherwise(verdict)
    return F.struct(final.alias("verdict"), (final == "contradicts").alias("flagged"), down.alias("downgraded"))


def parsed(payload: Column) -> Column:
    """The payload's rows; NULL if it is no such JSON."""
    return F.from_json(unfenced(payload), PAYLOAD)["steps"]


def row_errors(r: Column) -> Column:
    """What is wrong with a judgement row, as an array of rule names."""
    rules = {
        "behavior": ~F.coalesce(r["behavior"].isin(BEHAVIOURS), F.lit(False)),
        "verdict": ~F.coalesce(r["verdict"].isin(VERDICTS), F.lit(False)),
        "confidence": ~F.coalesce(r["behavior_confidence"].between(0, 1) & r["validity_confidence"].between(0, 1), F.lit(False)),
        "error_type": F.coalesce((r["verdict"] == "unsound") != r["error_type"].isNotNull(), F.lit(True)),
        "error_value": F.coalesce(~r["error_type"].isin(ERRORS), F.lit(False)),
    }
    return F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())


def graded(chunks: DataFrame, trace: list[str]) -> DataFrame:
    """chunks (trace, wanted array<string>, payload): each gets ok and rows; one bad chunk voids its whole trace."""
    out = chunks.withColumn("rows", parsed(F.col("payload")))
    out = out.withColumn("ok", valid(F.col("rows"), F.col("wanted")))
    whole = F.every("ok").over(W.partitionBy(*trace))
    rationale = F.transform("rows", lambda r: r.withField("rationale", shortened(r["rationale"], 200)))
    return out.withColumn("trace_ok", whole).withColumn("rows", F.when(F.col("trace_ok"), rationale)).withColumn("degraded", F.when(~F.col("trace_ok"), "classifier_parse_failure"))


def valid(rows: Column, wanted: Column) -> Column:
    """Whether parsed rows are those wanted, each once, with nothing wrong in any of them."""
    ids = F.transform(rows, lambda r: r["step_id"])
    return F.coalesce(rows.isNotNull() & (F.array_sort(ids) == F.array_sort(wanted)) & F.forall(rows, lambda r: F.size(row_errors(r)) == 0), F.lit(False))


def rejection(rows: Column, wanted: Column, most: int = 4) -> Column:
    """What the repair is told about a rejected payload: no JSON, other ids than those wanted, or the first few faults of its rows and how many more there are."""
    faults = F.flatten(F.transform(rows, lambda r: F.transform(row_errors(r), lambda e: F.concat_ws(": ", r["step_id"], e))))
    more = F.when(F.size(faults) > most, F.concat(F.lit(" (and "), (F.size(faults) - most).cast("string"), F.lit(" more)"))).otherwise("")
    ids = F.transform(rows, lambda r: r["step_id"])
    lost, extra = F.array_except(wanted, ids), F.array_except(ids, wanted)
    mismatch = F.concat(F.lit("step_id mismatch: "), F.size(lost).cast("string"), F.lit(" missing, "), F.size(extra).cast("string"), F.lit(" unknown"))
    return F.when(rows.isNull(), "no JSON object with steps").when(F.array_sort(ids) != F.array_sort(wanted), mismatch).otherwise(F.concat(F.array_join(F.slice(faults, 1, most), "; "), more))


def repaired(attempts: DataFrame, trace: list[str]) -> DataFrame:
    """One row for each chunk. attempts: trace columns, chunk, attempt, wanted array<string>, payload, tokens.

    An attempt is what the judge said: 0 at first, 1 after it was told what was wrong; more do not count. The first valid one is the chunk's; a chunk whose
    first is rejected and has no valid second fails, and with it its whole trace: no row of it is kept, and the chunks behind it were never asked for.
    Columns: place (of the chunk in its trace), asked, ok, repair, told (why the first was rejected), calls, rows, truncated, tokens (of the attempt used),
    failed_at (the place of the trace's first failed chunk). A repeated attempt counts as its least payload.
    """
    said = lambda k: F.min(F.when(F.col("attempt") == k, F.struct("payload", "tokens")))
    by = attempts.where(F.col("attempt").isin(0, 1)).groupBy(*trace, "chunk").agg(F.min("wanted").alias("wanted"), said(0).alias("a0"), said(1).alias("a1"))
    by = by.withColumns({"r0": parsed(F.col("a0.payload")), "r1": parsed(F.col("a1.payload"))}).withColumns({"v0": valid(F.col("r0"), F.col("wanted")), "v1": valid(F.col("r1"), F.col("wanted"))})
    order = W.partitionBy(*trace).orderBy("chunk")
    by = by.withColumn("place", F.row_number().over(order)).withColumn("fine", F.col("v0") | F.col("v1"))
    by = by.withColumn("failed_at", F.min(F.when(~F.col("fine"), F.col("place"))).over(W.partitionBy(*trace)))
    kept, asked = F.col("failed_at").isNull(), F.col("failed_at").isNull() | (F.col("place") <= F.col("failed_at"))
    used = F.when(F.col("v0"), F.col("r0")).when(F.col("v1"), F.col("r1"))
    return by.select(
        *trace, "chunk", "place", asked.alias("asked"), F.when(asked, F.col("fine")).alias("ok"), (asked & ~F.col("v0")).alias("repair"), F.when(asked & ~F.col("v0"), rejection(F.col("r0"), F.col("wanted"))).alias("told"),
        F.when(asked, F.when(F.col("v0"), 1).otherwise(2)).otherwise(0).alias("calls"), F.when(kept, F.transform(used, lambda r: r.withField("rationale", shortened(r["rationale"], 200)))).alias("rows"),
        F.when(kept, F.size(F.filter(used, lambda r: F.length(r["rationale"]) > 200))).otherwise(0).alias("truncated"), F.when(kept, F.when(F.col("v0"), F.col("a0.tokens")).otherwise(F.col("a1.tokens"))).otherwise(0).alias("tokens"), "failed_at",
    )


def classified(attempts: DataFrame, trace: list[str]) -> DataFrame:
    """One row for each trace: ok, chunks, calls, repairs, truncations, tokens, n_rows, degraded (reason, affects, detail; NULL if ok)."""
    chunks = repaired(attempts, trace)
    out = chunks.groupBy(*trace).agg(
        F.count("*").alias("chunks"), F.sum("calls").alias("calls"), F.count_if("repair").alias("repairs"), F.sum("truncated").alias("truncations"), F.sum("tokens").alias("tokens"),
        F.coalesce(F.sum(F.size("rows")), F.lit(0)).alias("n_rows"), F.min("failed_at").alias("failed_at"), F.max(F.when(F.col("place") == F.col("failed_at"), F.col("told"))).alias("told"),
    )
    detail = F.format_string("chunk %d/%d: %s", "failed_at", "chunks", "told")
    degraded = F.struct(F.lit("classifier_parse_failure").alias("reason"), F.array(F.lit("behavior"), F.lit("validity")).alias("affects"), detail.alias("detail"))
    return out.withColumn("ok", F.col("failed_at").isNull()).withColumn("degraded", F.when(F.col("failed_at").isNotNull(), degraded)).drop("failed_at", "told")
