"""Paired tests and resampling. Input: one row per example with true_label, pred_a, pred_b (paired systems).

Replicates are drawn in count space (`resampling`): one pass counts the cells that the statistic depends on, and permutations and bootstrap
samples are drawn of these counts, so their cost does not depend on the number of examples. A permutation p never reaches 0: (extreme + 1) / (B + 1).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio, tost_p
from ..sources.tables import stored
from .resampling import binomial, multinomial, replicated, uniform

TOLERANCE = 1e-12
REPLICATES = 10_000


def _right(pred: str) -> Column:
    return F.coalesce(F.col("true_label") == F.col(pred), F.lit(False)).cast("int")


def _p(extreme: str, differ: str, reps: int) -> Column:
    return F.when(F.col(differ) == 0, 1.0).otherwise((F.col(extreme) + 1) / F.lit(float(reps + 1)))


def _flips(rows: DataFrame, n: str, reps: int, seed: int, namespace: str, *key: str) -> DataFrame:
    """Replicates of a few rows with x, how many of their n examples swap the systems."""
    drawn = replicated(rows, reps, *key).withColumn("p", F.lit(0.5)).withColumn("u", uniform(seed, namespace, "rep", *key))
    return binomial(drawn, n, "p", "u", "x").drop("p", "u")


def permutation_accuracy(pairs: DataFrame, reps: int = REPLICATES, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """One row (of each `by`): n, delta, extreme, p. Only examples whose correctness differs are signed; the divisor is all n."""
    by = by or []
    d = pairs.select(*by, (_right("pred_a") - _right("pred_b")).alias("d"))
    base = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("sum_d"), F.count_if(F.col("d") != 0).alias("n_differ"))
    each = _flips(base, "n_differ", reps, seed, "perm_acc", *by)  # x of n_differ signs are positive
    out = each.groupBy(*by, "n", "sum_d", "n_differ").agg(F.count_if(F.abs(2 * F.col("x") - F.col("n_differ")) >= F.abs("sum_d")).alias("extreme"))
    out = out.withColumn("extreme", F.when(F.col("n_differ") == 0, 0).otherwise(F.col("extreme")))
    return out.select(*by, "n", "n_differ", ratio(F.col("sum_d"), F.col("n")).alias("delta"), "extreme", _p("extreme", "n_differ", reps).alias("p"))


def _label_cells(pairs: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Counts by true label and both predictions; whatever is no label of 0..k-1 is k."""
    known = lambda c: F.when(F.col(c).between(0, k - 1), F.col(c).cast("int")).otherwise(k)
    return pairs.groupBy(*by, known("true_label").alias("t"), known("pred_a").alias("a"), known("pred_b").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _class_sums(k: int, parts: list[tuple[str, str, str]]) -> list[Column]:
    """tp<name><class> and pred<name><class> of systems; parts: a system's name, a prediction, and how many examples have it, as expressions' texts."""
    out = []
    for name in sorted({p[0] for p in parts}):
        for i in range(k):
            for kind, also in (("tp", f" AND t = {i}"), ("pred", "")):
                counts = " + ".join(f"IF({pred} = {i}{also}, {n}, 0L)" for x, pred, n in parts if x == name)
                out.append(F.expr(f"sum({counts}) AS {kind}{name}{i}"))
    return out


def _support(k: int) -> list[Column]:
    return [F.expr(f"sum(IF(t = {i}, n, 0L)) AS support{i}") for i in range(k)]


def _macro(k: int, system: str, *more: str) -> Column:
    """Macro-F1 of a system from its class sums; those of the names in `more` are added."""
    add = lambda kind, i: " + ".join(f"{kind}{x}{i}" for x in (system, *more))
    f1 = [f"coalesce(try_divide(2D * ({add('tp', i)}), CAST({add('pred', i)} + support{i} AS DOUBLE)), 0D)" for i in range(k)]
    return F.expr(f"({' + '.join(f1)}) / {k}D")


def permutation_macro(pairs: DataFrame, k: int, reps: int = REPLICATES, seed: int = 42, by: list[str] | None = None) -> DataFrame:
    """One row (of each `by`): n, delta, extreme, p; each example's predictions swap with probability one half.

    Of the cells with two different predictions a binomial share swaps; the counts of the others are the same in every replicate."""
    by = by or []
    cells = stored(_label_cells(pairs, k, by), "cells")
    base = cells.groupBy(*by).agg(*_support(k), *_class_sums(k, [("a", "a", "n"), ("b", "b", "n"), ("same", "a", "IF(a = b, n, 0L)")]), F.expr("coalesce(sum(n), 0L) AS n"), F.expr("coalesce(sum(IF(a != b, n, 0L)), 0L) AS n_differ"))
    base = base.withColumn("actual", _macro(k, "a") - _macro(k, "b")).drop(*(f"{c}{s}{i}" for c in ("tp", "pred") for s in "ab" for i in range(k)))
    base = stored(base.withColumn("__g", F.struct(F.lit(0), *by)), "cells-base")  # a struct is never null, a `by` may be
    swapped = _flips(cells.where("a != b"), "n", reps, seed, "perm_macro", *by, "t", "a", "b")
    per = swapped.groupBy(*by, "rep").agg(*_class_sums(k, [("x", "a", "(n - x)"), ("x", "b", "x"), ("z", "b", "(n - x)"), ("z", "a", "x")]))
    each = per.withColumn("__g", F.struct(F.lit(0), *by)).drop(*by).join(base.drop(*by), "__g")
    stat = each.select("__g", "actual", (_macro(k, "x", "same") - _macro(k, "z", "same")).alias("delta"))
    count = stat.groupBy("__g").agg(F.count_if(F.abs("delta") >= F.abs("actual") - TOLERANCE).alias("extreme"))
    out = base.join(count, "__g", "left").withColumn("extreme", F.coalesce("extreme", F.lit(0)))
    return out.select(*by, "n", "n_differ", F.coalesce("actual", F.lit(0.0)).alias("delta"), "extreme", _p("extreme", "n_differ", reps).alias("p"))


def percentile_interval(stat: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return stat.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("reps"), F.percentile(value, F.lit(0.025)).alias("ci_low"), F.percentile(value, F.lit(0.975)).alias("ci_high"))


def bootstrap_delta(pairs: DataFrame, k: int, reps: int = REPLICATES, seed: int = 42, metric: str = "accuracy", strata: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Interval of metric(a) - metric(b) under shared resamples, within each `by`; strata keep their sizes."""
    by, strata = by or [], strata or []
    groups = [*by, *(s for s in strata if s not in by)]
    if metric == "accuracy":
        cell = (2 * _right("pred_a") + _right("pred_b")).alias("cell")
        drawn = multinomial(pairs.groupBy(*groups, cell).agg(F.count(F.lit(1)).alias("n")), reps, seed, "boot", groups)
        sign = F.when(F.col("cell") == 2, F.col("n")).when(F.col("cell") == 1, -F.col("n")).otherwise(0)
        stat = drawn.groupBy(*by, "rep").agg(ratio(F.sum(sign), F.sum("n")).alias("delta"))
    else:
        keys = [*by, *(f"__s{i}" for i in range(len(strata)))]
        cells = _label_cells(pairs.select("*", *(F.col(s).alias(f"__s{i}") for i, s in enumerate(strata))), k, keys)
        split = multinomial(cells.select(*keys, F.struct("t", "a", "b").alias("cell"), "n"), reps, seed, "boot", keys).select(*by, "rep", "n", "cell.*")
        sums = split.groupBy(*by, "rep").agg(*_support(k), *_class_sums(k, [("a", "a", "n"), ("b", "b", "n")]))
        stat = sums.select(*by, "rep", (_macro(k, "a") - _macro(k, "b")).alias("delta"))
    return percentile_interval(stat, "delta", by)


def bootstrap_gain(wide: DataFrame, members: list[str], reps: int = REPLICATES, seed: int = 42, rechoose: bool = True, by: list[str] | None = None) -> DataFrame:
    """Interval of the ensemble's accuracy over the best member's, within each `by`; wide has 0/1 columns `ensemble` and the members.

    rechoose: the best member is chosen again in each replicate, else once on all examples. Replicates are drawn of the 2 ** (members + 1) patterns of who is right."""
    by = by or []
    columns = ["ensemble", *members]
    pattern = sum((F.coalesce(F.col(c), F.lit(0)) * (1 << i) for i, c in enumerate(columns)), F.lit(0)).cast("int")
    cells = stored(wide.groupBy(*by, pattern.alias("cell")).agg(F.count(F.lit(1)).alias("n")), "patterns")
    has = lambda i: F.call_function("shiftright", F.col("cell"), F.lit(i)) % 2 * F.col("n")
    share = [ratio(F.sum(has(i)), F.sum("n"), None).alias(c) for i, c in enumerate(columns)]
    means = multinomial(cells, reps, seed, "boot", by).groupBy(*by, "rep").agg(*share)
    if rechoose:
        best = F.greatest(*(F.col(m) for m in members))
    else:
        top = cells.groupBy(*by).agg(*share)
        peak = F.greatest(*(F.col(m) for m in members))
        first = F.coalesce(*(F.when(F.col(m) == peak, F.lit(m)) for m in members))
        chosen = top.select(F.struct(F.lit(0), *by).alias("__g"), first.alias("chosen"))
        means = means.withColumn("__g", F.struct(F.lit(0), *by)).join(chosen, "__g").drop("__g")
        best = F.coalesce(*(F.when(F.col("chosen") == m, F.col(m)) for m in members))
    return percentile_interval(means.select(*by, (F.col("ensemble") - best).alias("gain")), "gain", by)


def tost(pairs: DataFrame, margin: float = 0.01, by: list[str] | None = None) -> DataFrame:
    """Equivalence of paired accuracies (of each `by`): mean difference, se (ddof 1), the two z (null without variance) and the larger one-sided p."""
    by = by or []
    d = (_right("pred_a") - _right("pred_b")).cast("double")
    t = pairs.select(*by, d.alias("d")).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg("d").alias("diff"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss"))
    n = F.col("n").cast("double")
    var = F.when(F.col("n") > 1, (F.col("ss") - F.col("s") * F.col("s") / n) / (n - 1)).otherwise(0.0)
    t = t.withColumn("se", F.sqrt(F.greatest(var, F.lit(0.0)) / n))
    t = t.select(*by, "n", "diff", "se", F.try_divide(F.col("diff") + margin, F.col("se")).alias("z_low"), F.try_divide(F.col("diff") - margin, F.col("se")).alias("z_high"), (F.abs("diff") < margin).alias("inside"))
    return t.withColumn("p", tost_p(F.col("z_low"), F.col("z_high"), F.col("se"), F.col("inside")))


def holm(tests: DataFrame, family: list[str], name: str = "test", p: str = "p") -> DataFrame:
    """Step-down adjusted p values, monotone and at most 1; equal p by name."""
    w = Window.partitionBy(*family) if family else Window.partitionBy(F.lit(0))
    ranked = tests.withColumn("rank", F.row_number().over(w.orderBy(p, name))).withColumn("m", F.count(F.lit(1)).over(w))
    step = F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("rank") + 1))
    return ranked.withColumn("__s", step).withColumn("p_holm", F.max("__s").over(w.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).drop("__s", "m")


def replication_verdict(delta_first: Column, delta: Column, low: Column, high: Column) -> Column:
    """Same sign and an interval without 0: replicated; same sign alone: directionally consistent."""
    same = F.signum(delta_first) == F.signum(delta)
    return F.when(same & ((low > 0) | (high < 0)), "replicated").when(same, "directionally consistent").otherwise("not replicated")
