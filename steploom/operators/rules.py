"""Ordered decision rules over rows. Each gives a name or a reason; NULL means that no rule applies, and is an answer of its own."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..functions.text import check, sole_number, strip
from .guards import alias
from .judging import BEHAVIOURS, VERDICTS

#: Texts that give away reasoning inside a serialised attribute.
BURIED = ['"reasoning"', "'reasoning'", "reasoning_content", "<think>"]


def yes(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def headline_kind(direct_ok: Column, think_ok: Column, react_ok: Column, ratio: Column) -> Column:
    """tool or accuracy where an arm is right and another wrong (tool if the tool arm is right); cost where a ratio is known; plain."""
    arms = F.array(direct_ok, think_ok, react_ok)
    separates = F.array_contains(arms, True) & yes(F.exists(arms, lambda x: x.eqNullSafe(F.lit(False))))
    return F.when(yes(separates) & yes(react_ok), "tool").when(yes(separates), "accuracy").when(ratio.isNotNull() & (ratio != 0), "cost").otherwise("plain")


def start_rank(arms: Column) -> Column:
    """arms: array of (correct, unsound). 0: right with unsound steps; 1: wrong with unsound steps; 2: the arms differ; else NULL."""
    right, wrong = (lambda a: a["correct"].eqNullSafe(F.lit(True))), (lambda a: a["correct"].eqNullSafe(F.lit(False)))
    return (
        F.when(F.exists(arms, lambda a: right(a) & (F.coalesce(a["unsound"], F.lit(0)) > 0)), 0)
        .when(F.exists(arms, lambda a: wrong(a) & (F.coalesce(a["unsound"], F.lit(0)) > 0)), 1)
        .when(F.exists(arms, right) & F.exists(arms, lambda a: ~right(a)), 2)
    )


def regime(has_both: Column, direct: Column, thinking: Column, most: float = 0.5) -> Column:
    """collapse where the direct arm reasoned more than `most` of the thinking arm's tokens; unverified without counts; NULL if separate."""
    lost = direct.isNull() | thinking.isNull() | (thinking == 0)
    return F.when(~has_both, F.lit(None).cast("string")).when(lost, "unverified").when(F.try_divide(direct.cast("double"), thinking.cast("double")) > most, "collapse")


def tool_call(name: Column, arguments: Column, expect: Column) -> Column:
    """struct(ok, reason). The right tool with arguments that are a non-empty JSON object; with expect '', no call at all. name is NULL without a call."""
    parsed = F.try_parse_json(arguments)
    # A JSON null and text after the value are not objects; an object without keys is empty.
    keys = F.size(F.map_keys(F.try_variant_get(parsed, "$", "map<string,variant>")))
    want_none = F.coalesce(expect, F.lit("")) == ""
    reason = (
        F.when(want_none, F.when(name.isNotNull(), "called when none was needed"))
        .when(name.isNull(), "no call")
        .when(name != expect, "another tool")
        .when(parsed.isNull(), "arguments are not JSON")
        .when(F.coalesce(keys, F.lit(0)) < 1, "arguments are empty or no object")
    )
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def batch_outcome(payload: Column, wanted: Column, labels: list[str] = tuple(BEHAVIOURS), verdicts: list[str] = tuple(VERDICTS)) -> Column:
    """transport_error (no payload), invalid_json, no_steps_array, step_id_mismatch, invalid_enum or ok: the first that holds."""
    rows = F.try_variant_get(F.try_parse_json(payload), "$.steps", "array<variant>")
    got = F.filter(F.transform(rows, lambda r: F.try_variant_get(r, "$.step_id", "string")), lambda x: x.isNotNull())
    differ = (F.size(F.array_except(wanted, got)) > 0) | (F.size(F.array_except(got, wanted)) > 0)
    known = lambda r: F.try_variant_get(r, "$.behavior", "string").isin(*labels) & F.try_variant_get(r, "$.verdict", "string").isin(*verdicts)
    return (
        F.when(payload.isNull(), "transport_error").when(F.try_parse_json(payload).isNull(), "invalid_json").when(rows.isNull(), "no_steps_array")
        .when(differ, "step_id_mismatch").when(F.exists(rows, lambda r: ~yes(known(r))), "invalid_enum").otherwise("ok")
    )


def short_of(value: Column, floor: Column) -> Column:
    """A measured value below its floor; what is not measured is no shortfall."""
    return yes(value.isNotNull() & (value < floor))


def provenance(authored: Column, planted: Column) -> Column:
    return F.when(yes(planted), "planted").when(yes(authored), "illustrative").otherwise("measured")


def reasoning(attributes: Column, hints: list[str]) -> Column:
    """struct(carrying, buried): names of attributes that hold reasoning under a name with a hint, and of others that hold it inside a blob."""
    named = lambda k: F.exists(F.array(*map(F.lit, hints)), lambda h: F.contains(F.lower(k), h))
    carrying = F.map_keys(F.map_filter(attributes, lambda k, v: named(k) & yes(strip(v) != "")))
    inside = F.map_keys(F.map_filter(attributes, lambda k, v: ~(named(k) & yes(strip(v) != "")) & yes(F.exists(F.array(*map(F.lit, BURIED)), lambda m: F.contains(v, m)))))
    return F.struct(F.array_sort(carrying).alias("carrying"), F.array_sort(inside).alias("buried"))


def trap_faults(known: Column, traps: Column, checker: Column, tolerance: Column) -> Column:
    """Why a trap cannot be measured: no trap answers, a checker that rejects its own answer, or one that takes a trap answer; [] if it can."""
    parts = F.array(
        F.when(F.coalesce(F.size(traps), F.lit(0)) < 1, "no trap answers"),
        F.when(~yes(check(known, known, checker, tolerance)), "rejects its own answer"),
        F.when(yes(F.exists(traps, lambda x: yes(check(known, x, checker, tolerance)))), "accepts a trap answer"),
    )
    return F.filter(parts, lambda x: x.isNotNull())


def fidelity(trace: Column, billed: Column, tokens: Column, summarises: Column) -> Column:
    """FAIL without a trace, EXPECTED where tokens are billed but a summarising provider shows none, SUMMARY below 2 characters a token, else PASS (UNEXPECTED of a summarising provider)."""
    none = F.coalesce(F.length(trace), F.lit(0)) == 0
    return (
        F.when(none & yes(summarises) & (F.coalesce(billed, F.lit(0)) > 0), "EXPECTED").when(none, "FAIL")
        .when(yes(F.try_divide(F.length(trace).cast("double"), tokens.cast("double")) < 2), "SUMMARY").when(yes(summarises), "UNEXPECTED").otherwise("PASS")
    )


def pin_refusal(pin: Column, other: Column | None = None) -> Column:
    """Why a model pin is refused: unset, an alias, or the same as the other tier's."""
    out = F.when(F.coalesce(strip(pin), F.lit("")) == "", "unset").when(alias(pin), "alias")
    return out if other is None else out.when(yes(pin == other), "same as analyzer")


def readiness(backend: Column, has_key: Column, model: Column) -> Column:
    """struct(ready, reason)."""
    reason = F.when(backend == "local", F.lit(None).cast("string")).when(~yes(has_key), "key missing").when(F.coalesce(model, F.lit("")) == "", "model missing")
    return F.struct(reason.isNull().alias("ready"), reason.alias("reason"))


def final_refusal(has_set: Column, freeze: Column, bundle: Column) -> Column:
    """Why the held-out set may not be read: absent, not frozen (NULL), or frozen for another bundle."""
    return F.when(~yes(has_set), "held-out set missing").when(freeze.isNull(), "not frozen").when(~F.contains(freeze, bundle), "bundle changed since the freeze")


def gated(flag: Column) -> Column:
    """On only if the flag is exactly '1'."""
    return yes(flag == "1")


def page_faults(visible: Column, raw: Column, phrase: str, least: int, hosts: list[str]) -> Column:
    """Faults of a page, in order: too short, phrase missing, forbidden host."""
    parts = F.array(
        F.when(F.length(visible) < least, "short"),
        F.when(~F.contains(F.lower(visible), F.lit(phrase.lower())), "phrase"),
        F.when(F.exists(F.array(*map(F.lit, hosts)), lambda h: F.contains(F.lower(raw), h)), "host"),
    )
    return F.filter(parts, lambda x: x.isNotNull())


def outcome(known: Column, answer: Column, checked: Column) -> Column:
    """correct, unparsed (a number is known and the answer holds none), or wrong; no answer is unparsed only where a number is known."""
    return F.when(yes(checked), "correct").when(sole_number(known).isNotNull() & sole_number(answer).isNull(), "unparsed").otherwise("wrong")


def trap_outcome(known: Column, answer: Column, traps: Column, checker: Column, tolerance: Column) -> Column:
    """correct, trap (the checker takes a trap answer for it), unparsed or other: the first that holds."""
    fell = yes(F.exists(traps, lambda x: yes(check(x, answer, checker, tolerance))))
    return F.when(yes(check(known, answer, checker, tolerance)), "correct").when(fell, "trap").when(sole_number(known).isNotNull() & sole_number(answer).isNull(), "unparsed").otherwise("other")
