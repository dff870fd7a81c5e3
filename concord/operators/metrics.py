"""Classification metrics over a fixed label domain 0..k-1: an absent class counts with 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import argmax, percent, ratio


def confusion(df: DataFrame, by: list[str], k: int, y: str = "true_label", p: str = "pred_label") -> DataFrame:
    """Counts of all k * k pairs of each group, zeros included."""
    pairs = [(i, j) for i in range(k) for j in range(k)]
    counts = df.groupBy(*by, y, p).agg(F.count(F.lit(1)).alias("n"))
    cells = counts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct((F.col(y) * k + F.col(p)).cast("int"), "n"))).alias("m"))  # k * k entries at most
    each = F.inline(F.array(*(F.struct(F.lit(i).alias(y), F.lit(j).alias(p), F.coalesce(F.try_element_at("m", F.lit(i * k + j)), F.lit(0).cast("bigint")).alias("n")) for i, j in pairs)))
    return cells.select(*by, each)


def class_counts(df: DataFrame, by: list[str], k: int, y: str = "true_label", p: str = "pred_label", weight: str | None = None) -> DataFrame:
    """tp, predicted and support of each class: one partial aggregation, no matrix. A row counts `weight` times."""
    w = F.col(weight) if weight else F.lit(1).cast("bigint")
    none = F.lit(0).cast("bigint")
    hit = df.select(*by, F.inline(F.array(F.struct(F.col(y).alias("label"), w.alias("s"), none.alias("q"), F.when(F.col(y) == F.col(p), w).otherwise(none).alias("t")), F.struct(F.col(p).alias("label"), none.alias("s"), w.alias("q"), none.alias("t")))))
    per = hit.groupBy(*by, "label").agg(F.sum("t").alias("tp"), F.sum("q").alias("predicted"), F.sum("s").alias("support"))
    cells = per.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("label", F.struct("tp", "predicted", "support")))).alias("m"))
    none = F.struct(*(F.lit(0).cast("bigint").alias(c) for c in ("tp", "predicted", "support")))
    each = F.transform(F.array(*map(F.lit, range(k))), lambda i: F.struct(i.alias("label"), F.coalesce(F.try_element_at("m", i), none).alias("c")))
    return cells.select(*by, F.explode(each).alias("e")).select(*by, "e.label", "e.c.*")


def f1(tp: Column, predicted: Column, support: Column) -> Column:
    return ratio(2 * tp, predicted + support)


def per_class(counts: DataFrame) -> DataFrame:
    tp, predicted, support = F.col("tp"), F.col("predicted"), F.col("support")
    return counts.withColumns({"precision": ratio(tp, predicted), "recall": ratio(tp, support), "f1": f1(tp, predicted, support)})


def bundle(df: DataFrame, by: list[str], k: int, y: str = "true_label", p: str = "pred_label", weight: str | None = None) -> DataFrame:
    """n, accuracy, macro and weighted F1, balanced accuracy (the recall of an absent class is 0), MCC and kappa."""
    c = per_class(class_counts(df, by, k, y, p, weight))
    n, hits = F.sum("support"), F.sum("tp")
    s, q = F.col("support").cast("double"), F.col("predicted").cast("double")
    total = n.cast("double")
    chance = F.sum(s * q)
    mcc = F.try_divide(total * hits - chance, F.sqrt((total * total - F.sum(q * q)) * (total * total - F.sum(s * s))))
    pe = F.try_divide(chance, total * total)
    kappa = F.try_divide(F.try_divide(hits.cast("double"), total) - pe, 1 - pe)
    return c.groupBy(*by).agg(n.alias("n"), ratio(hits, n).alias("accuracy"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"), F.avg("recall").alias("balanced_accuracy"), F.coalesce(mcc, F.lit(0.0)).alias("mcc"), F.coalesce(kappa, F.lit(0.0)).alias("kappa"))


def macro_f1_without(df: DataFrame, by: list[str], k: int, absent: int, y: str = "true_label", p: str = "pred_label") -> DataFrame:
    """Rows whose true label is `absent` go; the mean is over the others; predictions of it stay errors."""
    c = per_class(class_counts(df.where(F.col(y) != absent), by, k, y, p)).where(F.col("label") != absent)
    return c.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.sum("support").alias("n"))


def prediction_distribution(df: DataFrame, by: list[str], p: str = "pred_label") -> DataFrame:
    n = df.groupBy(*by, p).agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy(*by).agg(F.sum("n").alias("t"))
    return n.join(total, by).select(*by, p, "n", (F.col("n") / F.col("t")).alias("proportion"))


def family_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample sd, min and max of a metric over the runs of a family."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_runs"), F.avg(value).alias("mean"), F.when(F.count(F.lit(1)) > 1, F.stddev_samp(value)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))


def violations(df: DataFrame, k: int, tolerance: float = 1e-5) -> DataFrame:
    """Predictions that break a constraint: wrong width, not finite, sum off 1, label other than the argmax, label outside the domain."""
    p = F.col("probs")
    bad = F.exists(p, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    total = F.aggregate(p, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    checks = {"width": F.size(p) != k, "not_finite": bad, "sum": F.abs(total - 1) > tolerance, "argmax": argmax(p) != F.col("pred_label"), "domain": (F.col("true_label") < 0) | (F.col("true_label") >= k)}
    found = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in checks.items())))
    return df.withColumn("violations", found).where(F.size("violations") > 0)


def composition(df: DataFrame, dims: list[str]) -> DataFrame:
    """Counts and shares by every subset of the dimensions."""
    flags = [F.grouping(d).cast("int").alias(f"all_{d}") for d in dims]
    return df.cube(*dims).agg(F.count(F.lit(1)).alias("n"), *flags)


def rates(part: Column, whole: Column) -> Column:
    return percent(part, whole)
