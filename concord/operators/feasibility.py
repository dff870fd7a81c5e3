"""Feasibility of an overlap design: activity profile, dose probe, decision, detectable effects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..functions.stats import percent
from ..sources.tables import stored
from .splits import LEVELS

#: Thresholds of the decision. Fixed values.
MIN_ELIGIBLE_TEST, MIN_OVERLAP_PCT, MIN_CLASS_SUPPORT, FULL_COVERAGE_PCT = 1500, 5.0, 50, 99.9
DOSES = (1, 2, 3)
DISCORDANCE = (0.05, 0.10, 0.20, 0.50)
Z_ALPHA, Z_BETA = 1.96, 0.84


def activity_profile(corpus: DataFrame) -> DataFrame:
    """Posts per author: shares of authors with at least 2, 3, 5, and of posts by authors with several; the most."""
    per = corpus.groupBy("author").agg(F.count(F.lit(1)).alias("n"))
    n = F.count(F.lit(1))
    return per.agg(n.alias("n_authors"), F.sum("n").alias("n_posts"), *(percent(F.count_if(F.col("n") >= k), n).alias(f"pct_authors_ge{k}") for k in (2, 3, 5)), percent(F.sum(F.when(F.col("n") >= 2, F.col("n")).otherwise(0)), F.sum("n")).alias("pct_posts_multi"), F.max("n").alias("max_posts"))


def role_profile(roles: DataFrame) -> DataFrame:
    """Of each split: sizes of the roles, shares of the analysis set, the reserve's share of the corpus."""
    count = lambda r: F.count_if(F.col("role") == r)
    t = roles.groupBy("split_seed").agg(F.count(F.lit(1)).alias("n"), *(count(r).alias(f"n_{r}") for r in ("train", "val", "test", "reserve", "excluded")), F.count_if((F.col("role") == "test") & F.col("strict")).alias("n_eligible_test"))
    whole = F.col("n_train") + F.col("n_val") + F.col("n_test")
    return t.withColumns({"train_pct": percent(F.col("n_train"), whole), "val_pct": percent(F.col("n_val"), whole), "test_pct": percent(F.col("n_test"), whole), "reserve_pct": percent(F.col("n_reserve"), F.col("n")), "dense": percent(F.col("n_reserve"), F.col("n")) > 25})


def reserve_per_author(roles: DataFrame) -> DataFrame:
    per = roles.where("role = 'reserve'").groupBy("split_seed", "author").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("split_seed").agg(F.count(F.lit(1)).alias("n_authors"), F.percentile("n", F.lit(0.5)).alias("median"))


def dose_probe(roles: DataFrame, doses: tuple[int, ...] = DOSES) -> DataFrame:
    """(split_seed, dose): coverage, injected rows, share of training, levels of the matches in percent.

    No row is matched for it. A level pairs as many rows of a key as its smaller side has free, and the levels' keys are nested, so how many pairs each level
    makes follows from the rows of the finest keys on either side (`matched_doses` says which ones). One pass over the roles counts them."""
    keys, names = list(LEVELS[0][1]), [name for name, _ in LEVELS]
    h = F.when(F.col("role") == "reserve", F.unhex(order_key(F.col("split_seed"), "dose", "id")))
    rows = roles.select("split_seed", "author", "role", "strict", *keys, h.alias("h"), F.when(F.col("role") == "reserve", F.col("id")).alias("id"))
    own, any_ = Window.partitionBy("split_seed", "author", "role", "strict"), Window.partitionBy("split_seed", "author", "role")
    most = F.lit(max(doses))
    rows = rows.withColumns({"r": F.row_number().over(own.orderBy("h", "id")), "n": F.count(F.lit(1)).over(own)})
    rows = rows.withColumns({"first": F.row_number().over(any_.orderBy("strict", "h", "id")) == 1, "all": F.count(F.lit(1)).over(any_)})
    capped = {c: F.when(F.col("role") == "reserve", F.least(F.col(c), most + 1)) for c in ("r", "n", "all")} | {"first": F.when(F.col("role") == "reserve", F.col("first"))}
    cells = stored(rows.withColumns(capped).groupBy("split_seed", "role", "strict", *keys, "r", "n", "first", "all").agg(F.count(F.lit(1)).alias("c")), "cells")

    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("c"))), F.lit(0))
    reserve = F.col("role") == "reserve"
    sizes = cells.groupBy("split_seed").agg(total(F.col("role") == "train").alias("n_train"), total((F.col("role") == "test") & F.col("strict")).alias("n_eligible"), *(total(reserve & F.col("first") & (F.col("all") >= k)).alias(f"ge{k}") for k in doses))
    each = F.inline(F.array(*(F.struct(F.lit(k).alias("dose"), F.col(f"ge{k}").alias("covered")) for k in doses)))
    every = F.explode(F.array(*map(F.lit, doses))).alias("dose")
    free = cells.select("*", every).groupBy("split_seed", "dose", *keys).agg(total(F.col("role") == "train").alias("s0"), total(reserve & F.col("strict") & (F.col("r") <= F.col("dose")) & (F.col("n") >= F.col("dose"))).alias("s1"))
    injected = free.groupBy("split_seed", "dose").agg(F.sum("s1").alias("n_injected"))
    hits = None
    for name, cols in LEVELS:
        free = stored(free.groupBy("split_seed", "dose", *cols).agg(F.sum("s0").alias("s0"), F.sum("s1").alias("s1")), "free-cells")
        hit = F.least("s0", "s1")
        part = free.groupBy("split_seed", "dose").agg(F.sum(hit).alias("n")).withColumn("level", F.lit(name))
        hits = part if hits is None else hits.unionByName(part)
        free = free.withColumns({"s0": F.col("s0") - hit, "s1": F.col("s1") - hit})
    hits = hits.groupBy("split_seed", "dose").agg(*(F.sum(F.when(F.col("level") == x, F.col("n"))).alias(f"n_{x}") for x in names))
    matched = injected.join(hits, ["split_seed", "dose"]).withColumn("n_failed", F.col("n_injected") - sum((F.col(f"n_{x}") for x in names), F.lit(0)))
    out = sizes.select("split_seed", "n_train", "n_eligible", each).join(matched, ["split_seed", "dose"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    shares = {f"{name}_pct": percent(zero(f"n_{name}"), zero("n_injected")) for name in names}
    return out.select("split_seed", "dose", "n_train", "n_eligible", zero("n_injected").alias("n_injected"), zero("n_failed").alias("n_failed"), percent(F.col("covered"), F.col("n_eligible")).alias("coverage_pct"), percent(zero("n_injected"), F.col("n_train")).alias("overlap_pct"), *(v.alias(k) for k, v in shares.items()))


def decision(probe: DataFrame, support: DataFrame) -> DataFrame:
    """One row. probe: dose_probe; support: (split_seed, label, n) of eligible test rows, zeros included.

    The dose is the largest that, in every split, covers all eligible authors, changes enough of the training set and
    finds a partner for each injected row; the exploratory dose need not change enough of it."""
    ok = (F.col("coverage_pct") >= FULL_COVERAGE_PCT) & (F.col("n_failed") == 0)
    per = probe.groupBy("dose").agg(F.bool_and(ok).alias("covers"), F.bool_and(ok & (F.col("overlap_pct") >= MIN_OVERLAP_PCT)).alias("full"), F.min("n_eligible").alias("n"))
    t = per.agg(F.max(F.when(F.col("full"), F.col("dose"))).alias("dose"), F.max(F.when(F.col("covers"), F.col("dose"))).alias("exploratory_dose"), F.min("n").alias("min_eligible"))
    s = support.agg(F.min("n").alias("min_support"))
    t = t.crossJoin(s)  # two single rows
    feasible = F.col("dose").isNotNull() & (F.col("min_eligible") >= MIN_ELIGIBLE_TEST)
    return t.withColumns({"feasible": feasible, "status": F.when(feasible, "confirmatory").otherwise("requires_amendment"), "metric": F.when(F.col("min_support") >= MIN_CLASS_SUPPORT, "macro_f1").otherwise("accuracy")})


def detectable_effect(sizes: DataFrame, n: str) -> DataFrame:
    """Least accuracy difference (in points) that a paired test can detect, by assumed discordance."""
    r = F.inline(F.array(*(F.struct(F.lit(x).alias("discordance")) for x in DISCORDANCE)))
    effect = F.when(F.col(n) > 0, 100 * (Z_ALPHA + Z_BETA) * F.sqrt(F.try_divide(F.col("discordance"), F.col(n).cast("double"))))
    return sizes.select("*", r).withColumn("mde_points", effect)


def structural_diagnosis(profile: DataFrame, probe: DataFrame, activity: DataFrame) -> DataFrame:
    """Is there a mechanism at all: the least reserve and the least overlap at dose 1 over the splits; and how active authors are."""
    a = profile.agg(F.min("reserve_pct").alias("min_reserve_pct"))
    b = probe.where("dose = 1").agg(F.min("overlap_pct").alias("max_overlap_pct"))
    c = activity.select(F.try_divide(F.col("n_posts").cast("double"), F.col("n_authors").cast("double")).alias("posts_per_author"), "pct_authors_ge2", "pct_posts_multi")
    return a.crossJoin(b).withColumn("mechanism", F.col("max_overlap_pct") >= MIN_OVERLAP_PCT).crossJoin(c)  # three single rows


def eligible_support(roles: DataFrame, labels: list[str]) -> DataFrame:
    """(split_seed, label, n) of strictly eligible test rows over the whole label domain."""
    n = roles.groupBy("split_seed").agg(*(F.count_if((F.col("role") == "test") & F.col("strict") & (F.col("label") == x)).alias(f"n{i}") for i, x in enumerate(labels)))
    return n.select("split_seed", F.inline(F.array(*(F.struct(F.lit(x).alias("label"), F.col(f"n{i}").alias("n")) for i, x in enumerate(labels)))))


