"""Arms, scoreboards, verdict lines, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import falsy_to_null, ratio
from .judging import BEHAVIOURS

#: The lines a report can carry.
LINES = {
    "tool": "Only the tool-using agent could ground this — the others guessed fluently.",
    "earned": "Thinking earned its tokens here: +%.0f pp accuracy for %s× the output cost.",
    "spent": "Extended thinking spent %s× the output tokens of Direct for the same answer.",
    "flagged": "%d step(s) flagged; %d confirmed by the escalated judge.",
}


def profile(df: DataFrame, keys: list[str], label: str, classes: list[str] = tuple(BEHAVIOURS)) -> DataFrame:
    """keys and a map of shares, zeros explicit; NULL for groups without a label."""
    labelled = F.count_if(F.col(label).isNotNull())
    shares = [x for c in classes for x in (F.lit(c), ratio(F.count_if(F.col(label) == c), labelled))]
    return df.groupBy(*keys).agg(F.when(labelled > 0, F.create_map(*shares)).alias("profile"))


def soundness(df: DataFrame, keys: list[str], verdict: str) -> DataFrame:
    """keys, soundness_score (sound among labelled; unverifiable counts against) and flagged (labelled and not sound); NULL if none is labelled."""
    n = F.count(verdict)
    return df.groupBy(*keys).agg(ratio(F.count_if(F.col(verdict) == "sound"), n).alias("soundness_score"), F.when(n > 0, F.count_if(F.col(verdict) != "sound")).alias("flagged"))


def scoreboard(wide: DataFrame, think: str, direct: str, think_ok: str, direct_ok: str) -> DataFrame:
    """cost_of_thought (NULL if either side is NULL or 0) and accuracy_delta_pp (NULL if either is NULL)."""
    return wide.withColumn("cost_of_thought", ratio(falsy_to_null(F.col(think)), falsy_to_null(F.col(direct)))).withColumn("accuracy_delta_pp", 100.0 * (F.col(think_ok).cast("int") - F.col(direct_ok).cast("int")))


def verdict_line(direct_ok: Column, think_ok: Column, react_ok: Column, tool_required: Column, ratio: Column, delta: Column, flagged: Column, confirmed: Column) -> Column:
    """The first that holds: tools made the difference; thinking did; the same answer at three times the tokens; steps are flagged; else NULL."""
    others_failed = (direct_ok.isNotNull() | think_ok.isNotNull()) & ~F.coalesce(direct_ok, F.lit(False)) & ~F.coalesce(think_ok, F.lit(False))
    return (
        F.when(tool_required & react_ok & others_failed, LINES["tool"])
        .when(think_ok & ~direct_ok & delta.isNotNull() & (ratio != 0), F.format_string(LINES["earned"], delta, ratio.cast("string")))
        .when(direct_ok.eqNullSafe(think_ok) & (ratio >= 3), F.format_string(LINES["spent"], ratio.cast("string")))
        .when(flagged > 0, F.format_string(LINES["flagged"], flagged, confirmed))
    )


def cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column, priced: Column) -> Column:
    """USD; NULL unless the model is priced and both rates are known."""
    return F.when(priced & rate_in.isNotNull() & rate_out.isNotNull(), (tokens_in * rate_in + tokens_out * rate_out) / 1e6)


def correct(answer: Column, known: Column, checked: Column) -> Column:
    """TRUE, FALSE, or NULL: no answer, nothing known, or a checker that cannot be applied."""
    return F.when((F.trim(answer) == "") | known.isNull(), F.lit(None).cast("boolean")).otherwise(checked)


def contrast(direct: Column, thinking: Column) -> Column:
    return F.when((direct == "unparsed") | (thinking == "unparsed"), "incomplete").when((direct == "correct") & (thinking == "correct"), "agreed").when((direct != "correct") & (thinking == "correct"), "separated").when((direct == "correct") & (thinking != "correct"), "inverted").otherwise("both_wrong")
