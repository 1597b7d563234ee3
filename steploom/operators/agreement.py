"""Agreement of two label columns: one shuffle for the contingency table, all statistics from its few cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.stats import proportion, ratio, truthy, wilson


def cells(df: DataFrame, truth: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """keys, a, b, n: pairs in which both labels are there (not NULL, not '')."""
    pairs = df.select(*keys, truthy(F.col(truth).cast("string")).alias("a"), truthy(F.col(predicted).cast("string")).alias("b"))
    return pairs.where("a is not null and b is not null").groupBy(*keys, "a", "b").agg(F.count("*").alias("n"))


def class_frame(df: DataFrame, classes: list[str], name: str = "class") -> DataFrame:
    return df.sparkSession.createDataFrame([(c, i) for i, c in enumerate(classes)], f"{name} string, ord int")


def confusion(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """truth, predicted, n over the whole grid, zeros included, and n_dropped: pairs outside the class list."""
    c = cells(df, truth, predicted)
    grid = class_frame(df, classes, "a").select("a").crossJoin(class_frame(df, classes, "b").select("b"))  # of the class list, not of rows
    known = F.col("a").isin(classes) & F.col("b").isin(classes)
    dropped = c.agg(F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("n_dropped"))
    return grid.join(c, ["a", "b"], "left").crossJoin(F.broadcast(dropped)).select(F.col("a").alias("truth"), F.col("b").alias("predicted"), F.coalesce("n", F.lit(0)).alias("n"), "n_dropped")


def kappa_of(cell: DataFrame, keys: list[str] = ()) -> DataFrame:
    """keys, total, hits, chance, kappa from cells: (po - pe) / (1 - pe), NULL if pe is 1, tested on whole numbers.

    Each cell counts once for either of its labels, so both margins come from one aggregation, in which NULL keys are a group as any
    other. Products of counts are decimals of 38 digits, which holds them for any count that a long holds.
    """
    side = lambda label, na, nb, hits: F.struct(F.col(label).alias("c"), na.alias("na"), nb.alias("nb"), hits.alias("hits"))
    zero, n = F.lit(0).cast("long"), F.col("n")
    both = F.array(side("a", n, zero, F.when(F.col("a") == F.col("b"), n).otherwise(zero)), side("b", zero, n, zero))
    margins = cell.select(*keys, F.explode(both).alias("x")).groupBy(*keys, F.col("x.c").alias("c")).agg(*[F.sum(f"x.{k}").alias(k) for k in ("na", "nb", "hits")])
    whole = lambda x: x.cast("decimal(19,0)")
    out = margins.groupBy(*keys).agg(F.sum("na").alias("total"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum(whole(F.col("na")) * whole(F.col("nb"))), F.lit(0)).cast("decimal(38,0)").alias("chance"))
    square = whole(F.col("total")) * whole(F.col("total"))
    pe, po = ratio(F.col("chance").cast("double"), square.cast("double")), ratio(F.col("hits"), F.col("total"))
    return out.withColumn("kappa", F.when(F.col("chance") != square, (po - pe) / (1 - pe)))


def per_class(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> DataFrame:
    """class, support, predicted, tp, precision, recall, f1. f1 is NULL without support, and 0 if precision is NULL or both are 0."""
    c = cells(df, truth, predicted)
    # Each cell counts once for its truth and once for its prediction.
    sides = c.select(F.explode(F.array(F.struct(F.col("a").alias("class"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p")), F.struct(F.col("b").alias("class"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p")))).alias("x"), F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0).alias("hit"))
    sums = sides.groupBy("x.class").agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted"), (F.sum("hit") / 2).cast("long").alias("tp"))
    out = class_frame(df, classes).join(sums, "class", "left").select("class", *[F.coalesce(k, F.lit(0)).cast("long").alias(k) for k in ("support", "predicted", "tp")])
    return out.select("*", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), F.when(F.col("support") > 0, ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"))).alias("f1"))


def majority(df: DataFrame, truth: str, order: Column) -> DataFrame:
    """label, n, total, value, low, high of the most frequent truth label; ties go to the label seen first in order."""
    counts = df.where(truthy(F.col(truth).cast("string")).isNotNull()).groupBy(F.col(truth).cast("string").alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    best = counts.agg(F.max_by("label", F.struct("n", -F.col("seen"))).alias("label"), F.max("n").alias("n"), F.sum("n").alias("total"))
    low, high = wilson(F.col("n"), F.col("total"))
    return best.select("label", "n", "total", ratio(F.col("n"), F.col("total")).alias("value"), low.alias("low"), high.alias("high"))


def agreement(df: DataFrame, truth: str, predicted: str, order: Column) -> DataFrame:
    """One row: n, kappa, raw agreement with its interval, majority baseline, and points over it."""
    both = df.where(truthy(F.col(truth).cast("string")).isNotNull() & truthy(F.col(predicted).cast("string")).isNotNull())
    k = kappa_of(cells(both, truth, predicted))
    base = majority(both, truth, order).select(F.col("label").alias("baseline_label"), F.col("value").alias("baseline"))
    low, high = wilson(F.col("hits"), F.col("total"))
    raw = ratio(F.col("hits"), F.col("total"))
    return k.crossJoin(base).select(F.col("total").alias("n"), "kappa", raw.alias("raw"), low.alias("raw_low"), high.alias("raw_high"), "baseline_label", "baseline", (100 * (raw - F.col("baseline"))).alias("over_baseline_pp"))


def absent(df: DataFrame, truth: str, predicted: str, classes: list[str]) -> Column:
    """Of an aggregation: the classes in neither column, in class order."""
    seen = F.array_union(F.collect_set(F.col(truth).cast("string")), F.collect_set(F.col(predicted).cast("string")))
    return F.array_except(F.array(*map(F.lit, classes)), seen)


#: A rational approximation of the normal quantile, the middle and (of sqrt(-2 ln u)) the tails; 1e-9 is its error.
_MIDDLE = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_MIDDLE_BELOW = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_TAIL = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_TAIL_BELOW = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]
#: Counts up to which a Poisson quantile is summed up term by term; beyond, an expansion that is off by less than one count serves.
SUMMED = 10_000


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from the first 32 bits of an MD5, so that any engine draws the same."""
    h = F.conv(F.substring(F.md5(F.concat_ws(":", *[x.cast("string") for x in parts])), 1, 8), 16, 10).cast("double")
    return (h + 0.5) / 4294967296.0


def normal_quantile(u: Column) -> Column:
    def poly(coefficients: list[float], x: Column) -> Column:
        out = F.lit(coefficients[0])
        for k in coefficients[1:]:
            out = out * x + k
        return out

    side = F.sqrt(-2 * F.log(F.least(u, 1 - u)))
    tail = poly(_TAIL, side) / poly(_TAIL_BELOW, side)
    middle = (u - 0.5) * poly(_MIDDLE, (u - 0.5) * (u - 0.5)) / poly(_MIDDLE_BELOW, (u - 0.5) * (u - 0.5))
    return F.when(u < 0.02425, tail).when(u > 0.97575, -tail).otherwise(middle)


def poisson_steps(n: Column) -> Column:
    """struct(first, cdf) of a Poisson variable of mean n: its distribution function over all values that matter, from `first` on."""
    wide = F.ceil(8 * F.sqrt(n.cast("double"))) + 10
    first = F.greatest(n - wide, F.lit(0)).cast("long")
    log_first = F.aggregate(F.when(first > 0, F.sequence(F.lit(1).cast("long"), first)).otherwise(F.array().cast("array<bigint>")), F.lit(0.0), lambda s, k: s + F.log(k.cast("double")))
    start = F.struct((first * F.log(n.cast("double")) - n - log_first).alias("p"), F.lit(0.0).alias("sum"), F.array().cast("array<double>").alias("cdf"))

    def step(s, k):
        p = F.when(k > first, s["p"] + F.log(n.cast("double")) - F.log(k.cast("double"))).otherwise(s["p"])
        total = s["sum"] + F.exp(p)
        return F.struct(p.alias("p"), total.alias("sum"), F.array_append(s["cdf"], total).alias("cdf"))

    cdf = F.aggregate(F.sequence(first, (n + wide).cast("long")), start, step, lambda s: s["cdf"])
    return F.struct(first.alias("first"), cdf.alias("cdf"))


def resampled(cell: DataFrame, resamples: int, seed: int, keys: list[str] = ()) -> DataFrame:
    """keys, rep, a, b, n: the cells of every resample. In one of a large number of rows each counts Poisson(1) times, so a cell counts Poisson(n)
    times: the quantile of a hash of seed, resample and cell. Cells are drawn where they lie; neither rows nor other cells are needed."""
    some = cell.where("n > 0").withColumn("steps", F.when(F.col("n") <= SUMMED, poisson_steps(F.col("n"))))
    each = some.select(*keys, "a", "b", "n", "steps", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("rep"))
    each = each.withColumn("u", uniform(F.lit(seed), F.col("rep"), *[F.col(k) for k in keys], F.col("a"), F.col("b")))
    z, n = normal_quantile(F.col("u")), F.col("n").cast("double")
    beyond = F.greatest(F.round(n + z * F.sqrt(n) + (z * z - 1) / 6 - 0.5), F.lit(0.0)).cast("long")
    drawn = F.when(F.col("steps").isNull(), beyond).otherwise(F.col("steps.first") + F.size(F.filter("steps.cdf", lambda x: x < F.col("u"))))
    return each.select(*keys, "rep", "a", "b", drawn.alias("n"))


def bootstrap_kappa(cell: DataFrame, resamples: int = 2000, seed: int = 20260930) -> DataFrame:
    """value, n, low, high, defined, note. Kappa depends on the contingency table alone, so a resample draws counts for its cells, whatever the number
    of rows. Undefined resamples are dropped and counted; the interval is left out if fewer than half are defined."""
    drawn = kappa_of(resampled(cell, resamples, seed).where("n > 0"), ["rep"])
    # One number for each resample.
    every = drawn.agg(F.sort_array(F.collect_list("kappa")).alias("k"))
    m = F.size("k")
    wide = (m * 2 >= resamples) & (m > 0)
    at = lambda share: F.when(wide, F.element_at("k", F.least(m, F.floor(share * m).cast("int") + 1)))
    bounds = every.select(at(0.025).alias("low"), at(0.975).alias("high"), m.cast("long").alias("defined"), F.when(wide, "").otherwise("too few defined resamples").alias("note"))
    total = cell.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return kappa_of(cell).select(F.col("kappa").alias("value")).crossJoin(total).crossJoin(bounds)  # one row each


def by_group(df: DataFrame, keys: list[str], success: Column) -> DataFrame:
    """keys and the Estimate of a success rate."""
    return df.groupBy(*keys).agg(F.count_if(success).alias("successes"), F.count("*").alias("n")).select(*keys, "successes", "n", proportion(F.col("successes"), F.col("n")).alias("estimate"))
