"""Admission, staleness and configuration rules. The order of the branches is the rule."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def breaker(spent: Column, readable: Column, limit: Column) -> Column:
    """struct(allowed, reason): a ledger that cannot be read denies; a missing one counts as 0."""
    reason = F.when(~readable, "spend unreadable").when(F.coalesce(spent, F.lit(0.0)) >= limit, "limit reached")
    return F.struct(reason.isNull().alias("allowed"), reason.alias("reason"))


def admission(cached: Column, breaker_allows: Column, tier_ready: Column, limited: Column, known: Column) -> Column:
    """Why a run is refused, NULL if it is not: mode, breaker, tier, rate, allowlist, in this order."""
    return F.when(cached, "cached mode").when(~breaker_allows, "breaker").when(~tier_ready, "tier not ready").when(limited, "rate limited").when(~known, "unknown item")


def drift(have: dict[str, Column], want: dict[str, Column]) -> Column:
    """Names of the fields that differ, NULL-safe."""
    parts = [F.when(~have[k].eqNullSafe(want[k]), F.lit(k)) for k in want]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def alias(model: Column) -> Column:
    return F.contains(model, F.lit("latest")) | model.endswith("-preview") | model.endswith("-turbo")


def run_id(c: Column) -> Column:
    return c.rlike(r"^run-[0-9a-f]{1,16}$")


def budget_bound(finish: Column, tokens: Column, budget: Column) -> Column:
    return F.coalesce((finish == "length") | ((budget > 0) & (tokens >= budget)), F.lit(False))


def eligible(status: Column, trap: Column, labelled: Column, unsound: Column) -> Column:
    """struct(ok, reason): the first rule that fails."""
    reason = F.when(status != "ok", "status").when(trap, "trap").when(labelled == 0, "unlabelled").when(unsound > 0, "unsound")
    return F.struct(reason.isNull().alias("ok"), reason.alias("reason"))


def unpinned(fields: dict[str, Column]) -> Column:
    """Names of the fields that are NULL or blank."""
    parts = [F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) == "", F.lit(k)) for k, c in fields.items()]
    return F.filter(F.array(*parts), lambda x: x.isNotNull())


def vintage(have: Column, want: Column, declared: Column) -> Column:
    """clean if the bundle is the current one (NULL-safe), declared if its drift is on record, else undeclared."""
    return F.when(have.eqNullSafe(want), "clean").when(F.coalesce(declared, F.lit(False)), "declared").otherwise("undeclared")
