"""Labels from annotations: folding, consensus, agreement, multi-label retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import percent, ratio


def drop_unclear(df: DataFrame, flag: str = "example_very_unclear") -> DataFrame:
    return df.where(~F.coalesce(F.col(flag), F.lit(False)))


def fold_categories(df: DataFrame, category_map: dict[str, list[str]]) -> DataFrame:
    """Coarse 0/1 columns from wide fine ones: any fine label of a group counts once for a rater."""
    one = lambda xs: F.greatest(F.lit(0), *(F.coalesce(F.col(x), F.lit(0)) for x in xs))
    return df.select("*", *((one(fine) > 0).cast("int").alias(coarse) for coarse, fine in category_map.items()))


def rater_rows(df: DataFrame, item: str, rater: str, category: str, domain: list[str]) -> DataFrame:
    """Long votes to one row per (item, rater) with a 0/1 column for each category; repeated votes count once."""
    return df.groupBy(item, rater).agg(*(F.max((F.col(category) == c).cast("int")).alias(c) for c in domain))


def first_kept(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The first row of each key by an explicit order: a partial aggregation, not a sort of the whole group."""
    rest = [c for c in df.columns if c != key]
    first = F.min_by(F.struct(*rest), F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))))
    return df.groupBy(key).agg(first.alias("__f")).select(key, *(F.col(f"__f.{c}").alias(c) for c in rest))


def votes(rows: DataFrame, item: str, domain: list[str], threshold: int = 2) -> DataFrame:
    """Votes of each category, raters (rows), categories at the threshold, outcome and label of each item."""
    v = rows.groupBy(item).agg(*(F.sum(c).cast("bigint").alias(c) for c in domain), F.count(F.lit(1)).alias("n_raters"))
    return reach(v, domain, lambda c: F.col(c) >= threshold)


def reach(v: DataFrame, domain: list[str], reached) -> DataFrame:
    hit = F.array_compact(F.array(*(F.when(reached(c), F.lit(c)) for c in domain)))
    out = v.withColumn("__hit", hit).withColumn("n_reached", F.size("__hit"))
    out = out.withColumn("outcome", F.when(F.col("n_reached") == 1, "single").when(F.col("n_reached") > 1, "multi").otherwise("none"))
    return out.withColumn("label", F.when(F.col("n_reached") == 1, F.element_at("__hit", 1))).withColumn("top_votes", F.greatest(*(F.col(c) for c in domain))).drop("__hit")


def outcome_counts(v: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    each = [F.count_if(F.col("outcome") == x).alias(f"n_{x}") for x in ("single", "multi", "none")]
    return v.groupBy(*by).agg(F.count(F.lit(1)).alias("n_items"), *each)


def strict_majority(v: DataFrame, domain: list[str]) -> DataFrame:
    """Outcomes if more than half of the raters must agree."""
    return outcome_counts(reach(v.select("n_raters", *domain), domain, lambda c: 2 * F.col(c) > F.col("n_raters")))


def fleiss_kappa(v: DataFrame, domain: list[str]) -> DataFrame:
    """Binary kappa of each category with varying numbers of raters; items with one rater are left out."""
    long = v.where("n_raters >= 2").select("n_raters", F.inline(F.array(*(F.struct(F.lit(c).alias("category"), F.col(c).alias("yes")) for c in domain))))
    n, yes = F.col("n_raters").cast("double"), F.col("yes").cast("double")
    agree = (yes * yes + (n - yes) * (n - yes) - n) / (n * (n - 1))
    per = long.groupBy("category").agg(F.count(F.lit(1)).alias("n_items"), F.avg(agree).alias("p_bar"), ratio(F.sum("yes"), F.sum("n_raters")).alias("p"))
    pe = F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p"))
    return per.withColumn("p_e", pe).withColumn("kappa", F.try_divide(F.col("p_bar") - F.col("p_e"), 1 - F.col("p_e")))


def multiselect(rows: DataFrame, item: str, domain: list[str]) -> DataFrame:
    """Share of rater rows with several categories, and of items with such a row."""
    many = (sum((F.col(c) for c in domain[1:]), F.col(domain[0])) > 1).cast("int")
    per = rows.groupBy(item).agg(F.count(F.lit(1)).alias("n"), F.sum(many).alias("m"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_items"), percent(F.sum("m"), F.sum("n")).alias("multi_row_pct"), percent(F.sum((F.col("m") > 0).cast("int")), F.count(F.lit(1))).alias("multi_item_pct"))


def decode_multi_hot(vector: Column, names: list[str]) -> Column:
    """Active names of a 0/1 vector; null if its length is not that of the names."""
    array = F.array(*map(F.lit, names))
    got = F.filter(F.transform(vector, lambda v, i: F.when(v == 1, F.get(array, i))), lambda x: x.isNotNull())
    return F.when(F.size(vector) == len(names), got)


def retention(active: Column, mapping: dict[str, str]) -> tuple[Column, Column]:
    """(target, reason): the one category that all active names map to, or why there is none.

    Precedence: no active name, an unmapped name, several categories."""
    m = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else F.create_map().cast("map<string,string>")
    mapped = F.transform(active, lambda x: F.try_element_at(m, x))
    kinds = F.array_distinct(mapped)
    reason = F.when(active.isNull(), "malformed").when(F.size(active) == 0, "no_active").when(F.exists(mapped, lambda x: x.isNull()), "unmapped").when(F.size(kinds) > 1, "multiple").otherwise("retained")
    return F.when(reason == "retained", F.element_at(kinds, 1)), reason
