"""Set algebra on bitmaps: ids get dense numbers once, a set is a bit for each of its ids, and sizes, unions and overlaps are counts of bits.

A bitmap is cut into buckets of 32,768 ids (4 KB). Buckets are built by a partial aggregation, so a set that holds every id is many rows of many
tasks, and sets meet bucket by bucket, never id by id. A set costs an eighth of a byte for each id of all sets together: right for a few large sets (training sets of
all splits, classes), wrong for a set for each of many authors. Null ids are in no set; repeated ones count once; empty sets have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..plans.prefix import running_totals
from ..sources.tables import stored


def numbered(ids: DataFrame, key: str) -> DataFrame:
    """(key, number): the distinct ids numbered from 1 without a gap, in the order of their hash; no task sees more than a range of them."""
    d = stored(ids.select(key).where(F.col(key).isNotNull()).distinct().withColumn("__h", F.sha2(F.col(key).cast("string"), 256)), "ids")
    return running_totals(d, "__h", key, {"n": F.lit(1).cast("bigint")}, []).select(key, F.col("run_n").alias("number"))


def bitmaps(sets: DataFrame, key: str, by: list[str], numbers: DataFrame | None = None) -> DataFrame:
    """by, bucket, bits: the sets of key that by names. numbers: those of another call, so that both can be compared; an id without one is an error."""
    rows = sets.select(*by, key).where(F.col(key).isNotNull())
    rows = rows.join(numbered(sets, key) if numbers is None else numbers, key, "left")
    known = F.when(F.col("number").isNull(), F.raise_error(F.concat(F.lit("no number for id "), F.col(key).cast("string"))).cast("bigint")).otherwise(F.col("number"))
    rows = rows.select(*by, known.alias("number"))
    return rows.groupBy(*by, F.bitmap_bucket_number("number").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def merged(maps: DataFrame, by: list[str]) -> DataFrame:
    """The unions of sets that agree in by: coarser sets, made from the finer ones without another look at the ids."""
    return maps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def sizes(maps: DataFrame, by: list[str]) -> DataFrame:
    return maps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def overlaps(maps: DataFrame, by: list[str]) -> DataFrame:
    """(a, b, n_a, n_b, n_both, overlap, jaccard, disjoint, subset, equal) of every pair of sets, a before b, common ids or not; a and b are structs of by.

    The names of the sets, not their ids, are gathered in one row."""
    maps = maps.select(F.struct(*by).alias("s"), "bucket", "bits")
    pair = maps.select(F.col("s").alias("a"), "bucket", F.col("bits").alias("x")).join(maps.select(F.col("s").alias("b"), "bucket", F.col("bits").alias("y")), "bucket").where("a < b")
    shared = pair.select("a", "b", "bucket", F.explode(F.array("x", "y")).alias("bits")).groupBy("a", "b", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    shared = shared.groupBy("a", "b").agg(F.sum(F.bitmap_count("bits")).alias("n_both"))
    names = sizes(maps, ["s"]).agg(F.collect_list(F.struct("s", "n")).alias("all"))
    pairs = names.select("all", F.explode("all").alias("a")).select("a", F.explode("all").alias("b")).where("a.s < b.s").select(F.col("a.s").alias("a"), F.col("b.s").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))
    out = pairs.join(shared, (pairs["a"].eqNullSafe(shared["a"])) & (pairs["b"].eqNullSafe(shared["b"])), "left").select(pairs["a"], pairs["b"], "n_a", "n_b", F.coalesce("n_both", F.lit(0)).cast("bigint").alias("n_both"))
    out = out.withColumn("overlap", ratio(F.col("n_both"), F.least("n_a", "n_b"))).withColumn("jaccard", ratio(F.col("n_both"), F.col("n_a") + F.col("n_b") - F.col("n_both")))
    return out.withColumns({"disjoint": F.col("n_both") == 0, "subset": F.col("n_both") == F.least("n_a", "n_b"), "equal": (F.col("n_both") == F.col("n_a")) & (F.col("n_a") == F.col("n_b"))})
