"""Votes of several jurors on the same examples. A prediction row: juror, example_id, true_label, pred_label, probs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import argmax, percent, ratio, softmax_over

EX = ["example_id", "true_label"]


def alignment_errors(a: DataFrame, b: DataFrame) -> DataFrame:
    """Examples that one of two runs lacks, or whose true labels differ."""
    x, y = a.select("example_id", F.col("true_label").alias("ya")), b.select("example_id", F.col("true_label").alias("yb"))
    return x.join(y, "example_id", "full_outer").where("ya IS NULL OR yb IS NULL OR ya != yb")


def juror_weights(scores: DataFrame, by: list[str], score: str = "macro_f1", temperature: float = 1.0) -> DataFrame:
    """Softmax of validation scores at full precision."""
    return scores.select(*by, "juror", softmax_over(F.col(score), by, temperature).alias("weight"))


def mean_probs(preds: DataFrame, k: int, weights: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Weighted mean probabilities of each example (within each `by`); the weights of its jurors are brought to sum 1."""
    rows = preds.withColumn("weight", F.lit(1.0)) if weights is None else preds.join(F.broadcast(weights.select(*by, "juror", "weight")), [*by, "juror"])  # one row for each juror (and `by`)
    total = F.sum("weight")
    sums = F.array(*(F.sum(F.col("weight") * F.col("probs")[i]) / total for i in range(k)))
    return rows.groupBy(*by, *EX).agg(sums.alias("probs"))


def soft_vote(preds: DataFrame, k: int, weights: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    return mean_probs(preds, k, weights, by).select(*by, *EX, argmax(F.col("probs")).alias("pred_label"), "probs")


def _counts(preds: DataFrame, k: int, weights: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Votes (or weight) for each class and mean probabilities of each example, in one aggregation."""
    rows = preds.withColumn("weight", F.lit(1.0)) if weights is None else preds.join(F.broadcast(weights.select("juror", "weight")), "juror")
    n = F.array(*(F.sum(F.when(F.col("pred_label") == i, F.col("weight")).otherwise(0.0)) for i in range(k)))
    mean = F.array(*(F.avg(F.col("probs")[i]) for i in range(k)))
    return rows.groupBy(*by, *EX).agg(n.alias("n"), mean.alias("mean"))


def hard_vote_any(preds: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Majority if two or more agree, else the argmax of the mean over all classes (which nobody may have chosen)."""
    c = _counts(preds, k, by=by)
    return c.select(*by, *EX, F.when(F.array_max("n") >= 2, argmax(F.col("n"))).otherwise(argmax(F.col("mean"))).alias("pred_label"))


def hard_vote_tied(preds: DataFrame, k: int) -> DataFrame:
    """Majority; ties by the mean probability among the tied classes, then by label order."""
    c = _counts(preds, k)
    best = F.zip_with("n", "mean", lambda n, m: F.when(n == F.array_max(F.col("n")), m).otherwise(F.lit(-1.0)))
    return c.select(*EX, argmax(best).alias("pred_label"))


def weighted_hard(preds: DataFrame, k: int, weights: DataFrame) -> DataFrame:
    """The class with most juror weight; ties by label order."""
    return _counts(preds, k, weights).select(*EX, argmax(F.col("n")).alias("pred_label"))


def weight_activation(preds: DataFrame, k: int, weights: DataFrame) -> DataFrame:
    """How often weights can matter, and do: three-way disagreement, a weight above one half, changed predictions."""
    equal = soft_vote(preds, k).select("example_id", F.col("pred_label").alias("p_equal"))
    weighted = soft_vote(preds, k, weights).select("example_id", F.col("pred_label").alias("p_weighted"))
    spread = preds.groupBy("example_id").agg(F.count_distinct("pred_label").alias("kinds"))
    rows = equal.join(weighted, "example_id").join(spread, "example_id")
    top = weights.agg(F.max("weight").alias("max_weight"))
    got = rows.agg(F.count(F.lit(1)).alias("n"), percent(F.count_if(F.col("kinds") >= 3), F.count(F.lit(1))).alias("three_way_pct"), percent(F.count_if(F.col("p_equal") != F.col("p_weighted")), F.count(F.lit(1))).alias("changed_pct"))
    return got.crossJoin(top).withColumn("dominant", F.col("max_weight") > 0.5)  # two single rows


def wide_correct(preds: DataFrame, jurors: list[str], by: Sequence[str] = ()) -> DataFrame:
    """example_id and a 0/1 column of correctness for each juror."""
    return preds.groupBy(*by, "example_id").agg(*(F.max(F.when(F.col("juror") == j, (F.col("true_label") == F.col("pred_label")).cast("int"))).alias(j) for j in jurors))


def dependence(preds: DataFrame, jurors: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Of each pair of jurors: 2x2 counts of correctness, correlation (null without variance), Q, disagreement, kappa."""
    pairs = [(a, b) for i, a in enumerate(jurors) for b in jurors[i + 1 :]]
    rows = wide_correct(preds, jurors, by).select(*by, F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in pairs))))
    cell = lambda x, y: F.count_if((F.col("x") == x) & (F.col("y") == y))
    t = rows.groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n"), cell(1, 1).alias("n11"), cell(1, 0).alias("n10"), cell(0, 1).alias("n01"), cell(0, 0).alias("n00"))
    d = {c: F.col(c).cast("double") for c in ("n", "n11", "n10", "n01", "n00")}
    vx, vy = (d["n11"] + d["n10"]) * (d["n01"] + d["n00"]), (d["n11"] + d["n01"]) * (d["n10"] + d["n00"])
    det = d["n11"] * d["n00"] - d["n10"] * d["n01"]
    po = ratio(d["n11"] + d["n00"], d["n"])
    pe = ratio((d["n11"] + d["n10"]) * (d["n11"] + d["n01"]) + (d["n01"] + d["n00"]) * (d["n10"] + d["n00"]), d["n"] * d["n"])
    return t.withColumns({"r": F.when((vx > 0) & (vy > 0), F.try_divide(det, F.sqrt(vx * vy))), "q": F.try_divide(det, d["n11"] * d["n00"] + d["n10"] * d["n01"]), "disagreement": ratio(d["n10"] + d["n01"], d["n"]), "kappa": F.try_divide(po - pe, 1 - pe)})


def error_summary(preds: DataFrame, jurors: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean of the defined pairwise correlations, and how many are defined."""
    return dependence(preds, jurors, by).groupBy(*by).agg(F.avg("r").alias("mean_r"), F.count("r").alias("n_defined"), F.count(F.lit(1)).alias("n_pairs"))


def gain(ensemble: DataFrame, members: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """The ensemble's metric over that of its best member (ties by name)."""
    best = members.groupBy(*by).agg(F.max(metric).alias("best"), F.min_by("juror", F.struct(-F.col(metric), F.col("juror"))).alias("best_member"))
    joined = ensemble.select(*by, F.col(metric).alias("value")).join(best, by) if by else ensemble.select(F.col(metric).alias("value")).crossJoin(best)
    return joined.withColumn("gain", F.col("value") - F.col("best"))


def rank_consistency(scores: DataFrame, item: str, by: str, metric: str) -> DataFrame:
    """Ranks of systems within each split and their spread over splits."""
    r = F.rank().over(Window.partitionBy(by).orderBy(F.desc(metric)))
    return scores.select(item, by, r.alias("rank")).groupBy(item).agg(F.min("rank").alias("best_rank"), F.max("rank").alias("worst_rank"), F.avg("rank").alias("mean_rank"))
