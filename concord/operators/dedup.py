"""Exact and near de-duplication: normalised text, cosine neighbours, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import dot
from ..functions.text import clean_authors, normalise
from ..sources.tables import dropped, replaced, stored
from . import neighbours


def exact_groups(df: DataFrame, key: str, text: str = "text", norm: Column | None = None) -> DataFrame:
    """Each row with its normalised text, the key that stays (the smallest) and whether it is it; empty texts never stay."""
    rows = df.withColumn("norm", F.coalesce(norm if norm is not None else normalise(F.col(text)), F.lit("")))
    first = rows.where("norm != ''").groupBy("norm").agg(F.min(key).alias("keep_key"), F.count(F.lit(1)).alias("copies"))
    return rows.join(first, "norm", "left").withColumn("kept", F.coalesce(F.col(key) == F.col("keep_key"), F.lit(False)))


def exact_dedup(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    return exact_groups(df, key, text).where("kept").drop("norm", "keep_key", "copies", "kept")


def build_corpus(df: DataFrame, key: str, author: str = "author", text: str = "text") -> DataFrame:
    """Authors are cleaned before texts are compared: the other order can drop every row of a group."""
    return exact_dedup(clean_authors(df, author), key, text)


def knn_edges(vectors: DataFrame, key: str, vector: str, k: int = 10, threshold: float = 0.85, planes: int = 0, tables: int = 0, seed: int = 7) -> DataFrame:
    """(a, b, sim): cosine above the threshold among the k - 1 nearest others, made symmetric; a < b.

    Without `tables` it is exact (`neighbours`). With them, only pairs are compared that share the signs of `planes` random directions in one of `tables` tables, which
    keeps the work near-linear in any dimension but may miss pairs."""
    if not tables:
        index = neighbours.build(vectors, key, vector, k)
        found = neighbours.edges(index, k, threshold)
        dropped(index.blocks)
        return found
    unit = F.transform(F.col(vector), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(unit, F.lit(0.0), lambda s, x: s + x * x))
    v = vectors.select(F.col(key).alias("a"), F.transform(unit, lambda x: F.try_divide(x, norm)).alias("va"))
    sign = lambda t, p: F.aggregate(F.transform("va", lambda x, i: x * (F.pmod(F.xxhash64(F.lit(seed), F.lit(t), F.lit(p), i), F.lit(2)) * 2 - 1)), F.lit(0.0), lambda s, x: s + x) > 0
    code = lambda t: F.concat_ws("", F.lit(f"{t}:"), *(sign(t, p).cast("int").cast("string") for p in range(planes)))
    v = v.withColumn("bucket", F.explode(F.array(*(code(t) for t in range(tables)))))
    w = v.select(F.col("a").alias("b"), F.col("va").alias("vb"), "bucket")
    pairs = v.join(w, "bucket").where("a != b").dropDuplicates(["a", "b"])
    near = pairs.select("a", "b", dot(F.col("va"), F.col("vb")).alias("sim")).where(F.col("sim") > threshold)  # ranks among these are the ranks among all
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "b"))
    top = near.withColumn("rank", rank).where(F.col("rank") <= k - 1)
    return top.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "sim").groupBy("a", "b").agg(F.max("sim").alias("sim"))


def components(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """(key, comp): the least key that each node reaches. Labels spread along edges and jump to their label's label;
    every round is stored, so lineage stays short and lost executors cost no recomputation, and takes the place of the one before."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = both.groupBy("a").agg(F.least("a", F.min("b")).alias("comp"))
    now = stored(now, "labels")
    while True:
        near = both.join(now.select(F.col("a").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        jump = now.select(F.col("a").alias("comp"), F.col("comp").alias("next"))
        after = now.join(near, "a").join(jump, "comp", "left").select("a", F.least("comp", "near", F.coalesce("next", "comp")).alias("comp"), F.col("comp").alias("was"))
        after = replaced(after, "labels", now)
        now = after.select("a", "comp")
        if after.where("comp != was").isEmpty():
            break
    dropped(both)
    found = now.withColumnRenamed("a", key)
    return nodes.select(key).join(found, key, "left").select(key, F.coalesce("comp", key).alias("comp"))


def near_components(vectors: DataFrame, key: str, vector: str, k: int = 10, threshold: float = 0.85, **how) -> DataFrame:
    """`components` of the edges of `knn_edges`. Without `tables` nothing of the index stays on disk once its links are stored."""
    if how.get("tables"):
        return components(vectors, knn_edges(vectors, key, vector, k, threshold, **how), key)
    index = neighbours.build(vectors, key, vector, k)
    links = neighbours.links(index, k, threshold)
    dropped(index.blocks)
    dropped(index.rows)
    found = components(vectors, links, key)
    dropped(links)
    return found


def near_dedup(df: DataFrame, key: str, vector: str, **how) -> DataFrame:
    """Rows that are the least of their component of near copies."""
    comps = near_components(df, key, vector, **how)
    return df.join(comps.where(F.col(key) == F.col("comp")).select(key), key, "left_semi")
