"""Audits of judgements and runs: what was caught, what was flagged for nothing, what was spent. All are grouped sums, so rows are summed before they move."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import proportion, ratio
from .rules import yes


def recall(cases: DataFrame, hit: Column) -> DataFrame:
    """One row: n_graded, n_hits, recall (an Estimate). Cases with a NULL hit are ungraded and out."""
    return cases.agg(F.count(hit).alias("n_graded"), F.count_if(hit).alias("n_hits")).withColumn("recall", proportion(F.col("n_hits"), F.col("n_graded")))


def recall_by_type(cases: DataFrame, kind: str, hit: Column) -> DataFrame:
    """kind and 'hits/n', never a bare share; an unnamed kind is '?'."""
    graded = cases.where(hit.isNotNull()).groupBy(F.coalesce(F.col(kind), F.lit("?")).alias(kind))
    return graded.agg(F.format_string("%d/%d", F.count_if(hit), F.count("*")).alias("caught"))


def escalation_delta(cases: DataFrame, hit: Column, triage: Column, escalated: Column) -> DataFrame:
    """One row: hits less hits by triage alone, NULL if nothing was escalated."""
    graded = F.coalesce(triage, hit)
    return cases.where(hit.isNotNull()).agg(F.when(F.count_if(escalated) > 0, F.count_if(hit) - F.count_if(graded)).alias("delta"))


def flag_table(steps: DataFrame, trace: str, verdict: Column, human: Column) -> DataFrame:
    """A row for each trace: steps, labelled (of judged steps), flags, false_flags (flagged, and sound to a human)."""
    flagged = yes(verdict.isin("unsound", "unverifiable"))
    return steps.groupBy(trace).agg(
        F.count("*").alias("steps"), F.count_if(verdict.isNotNull() & human.isNotNull()).alias("labelled"), F.count_if(flagged).alias("flags"), F.count_if(flagged & yes(human == "sound")).alias("false_flags")
    )


def pooled_precision(flags: DataFrame, planted: Column, human: Column) -> DataFrame:
    """One row over the flags of both halves. strict: a planted flaw or unsound to a human; symmetric: unverifiable counts as well."""
    strict, both = yes(planted) | yes(human == "unsound"), yes(planted) | yes(human.isin("unsound", "unverifiable"))
    n = flags.agg(F.count("*").alias("flags"), F.count_if(strict).alias("hits_strict"), F.count_if(both).alias("hits_symmetric"))
    return n.withColumn("strict", proportion(F.col("hits_strict"), F.col("flags"))).withColumn("symmetric", proportion(F.col("hits_symmetric"), F.col("flags")))


def false_flag_rate(table: DataFrame) -> DataFrame:
    """From a flag table: false flags for each labelled step, an Estimate."""
    return table.agg(F.sum("false_flags").alias("false_flags"), F.sum("labelled").alias("labelled")).withColumn("rate", proportion(F.col("false_flags"), F.col("labelled")))


def consistency_fp(rows: DataFrame, found: Column, skipped: Column, flagged: Column, downgraded: Column) -> DataFrame:
    """One row; the target counts as met only if something was read."""
    t = rows.agg(F.count_if(found & ~skipped).alias("n"), F.count_if(found & ~skipped & flagged).alias("flagged"), F.count_if(found & ~skipped & downgraded).alias("downgrades"))
    return t.withColumn("rate", ratio(F.col("flagged"), F.col("n"))).withColumn("met", (F.col("n") > 0) & (F.col("flagged") == 0))


def totals(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Sums in which NULL counts as 0."""
    return rows.groupBy(*keys).agg(*[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in columns])


def who_labelled(rows: DataFrame, who: str, skipped: Column) -> DataFrame:
    return rows.agg(F.array_sort(F.collect_set(who)).alias("annotators"), F.count_if(skipped).alias("skipped"))


def inventory(spans: DataFrame, name: str, attributes: str) -> DataFrame:
    """attribute, spans: where each attribute occurs. Pairs are made distinct first, so a group holds span names, not spans."""
    pairs = spans.select(F.col(name).alias("span"), F.explode(F.map_keys(attributes)).alias("attribute")).distinct()
    return pairs.groupBy("attribute").agg(F.array_sort(F.collect_list("span")).alias("spans"))


#: The most concepts of a contract.
CONCEPTS = 10_000


def contract_delta(concepts: DataFrame, observed: DataFrame, name: str) -> DataFrame:
    """concepts: (concept, expected, pattern), a contract of a page or two, so it is what goes to the tasks; observed: any number of names.

    CONFIRMED if the expected name occurs, CORRECTED if only another that fits the pattern does, else ABSENT.
    """
    if concepts.limit(CONCEPTS + 1).count() > CONCEPTS:
        raise ValueError(f"a contract has {CONCEPTS} concepts at most: it is sent to all tasks")
    exact = F.col(name) == F.col("expected")
    hit = observed.select(name).join(F.broadcast(concepts), exact | F.regexp_like(F.col(name), F.col("pattern")))
    seen = hit.groupBy("concept").agg(F.bool_or(exact).alias("exact"))
    state = F.when(F.col("exact"), "CONFIRMED").when(~F.col("exact"), "CORRECTED").otherwise("ABSENT")
    return concepts.select("concept").join(seen, "concept", "left").select("concept", state.alias("state"))


def enrichment(pool: DataFrame, label: str, rare: list[str], target: int) -> DataFrame:
    """A row for each rare class: candidates, selected, short_of_target, base_rate, factor (1 / share of all rare classes; NULL if none)."""
    counts = [F.count_if(F.col(label) == c).alias(f"n{i}") for i, c in enumerate(rare)]
    one = pool.agg(F.count("*").alias("n"), *counts)
    every = sum((F.col(f"n{i}") for i in range(len(rare))), F.lit(0))
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), F.col(f"n{i}").alias("candidates")) for i, c in enumerate(rare)]))
    return one.select("n", ratio(F.col("n"), every).alias("factor"), rows.alias("r")).select(
        F.col("r.class").alias("class"), F.col("r.candidates").alias("candidates"), F.least(F.col("r.candidates"), F.lit(target)).alias("selected"),
        F.greatest(F.lit(target) - F.col("r.candidates"), F.lit(0)).alias("short_of_target"), ratio(F.col("r.candidates"), F.col("n")).alias("base_rate"), "factor",
    )


def value_maps(rows: DataFrame, key: str, labels: list[str], values: dict[str, list[str]]) -> DataFrame:
    """A map of counts for each label column, zeros left out; the classes are named, so it is one aggregation."""
    def one(c: str) -> Column:
        entries = F.array(*[F.struct(F.lit(v), F.count_if(F.col(c) == v)) for v in values[c]])
        return F.map_filter(F.map_from_entries(entries), lambda k, n: n > 0).alias(c)

    return rows.groupBy(key).agg(*[one(c) for c in labels])


def loop_counters(tools: DataFrame, keys: list[str], ok: Column, limit: int) -> DataFrame:
    """turns, calls, failed_calls, exhausted (the limit of turns is reached)."""
    n = tools.groupBy(*keys).agg(F.count_distinct("turn").alias("turns"), F.count("*").alias("calls"), F.count_if(~yes(ok)).alias("failed_calls"))
    return n.withColumn("exhausted", F.col("turns") >= limit)


def bundle_hash(files: DataFrame, name: str, body: str, digits: int = 12) -> DataFrame:
    """One row: the first digits of a SHA-256 over the files' names and digests in order of name. Bodies are digested where they are; only digests meet, and a bundle is a handful of files."""
    part = F.struct(F.col(name).alias("k"), F.sha2(F.coalesce(body, F.lit("")), 256).alias("d"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: F.concat(x["k"].cast("string"), x["d"])), "")
    return files.agg(F.substring(F.sha2(joined, 256), 1, digits).alias("bundle"))


def budget_state(runs: DataFrame, used: str, limit: int, per_run: int) -> DataFrame:
    """used, limit, per_run, and what a next run may take: the least of its share and the rest."""
    u = F.coalesce(F.sum(used), F.lit(0))
    return runs.agg(u.alias("used"), F.lit(limit).alias("limit"), F.least(F.lit(per_run), F.greatest(F.lit(limit) - u, F.lit(0))).alias("next_run"))


def collateral(flags: Column, target: Column, baseline: Column) -> Column:
    """Flags that neither the change nor the trace's baseline explains, in order."""
    return F.array_sort(F.array_except(F.array_except(flags, F.array(target)), baseline))


def token_split(reasoning: Column, answer: Column, billed: Column) -> Column:
    """struct(share, residual): NULL where a count is missing."""
    return F.struct(F.try_divide(reasoning.cast("double"), (reasoning + answer).cast("double")).alias("share"), (billed - (reasoning + answer)).alias("residual"))
