"""Digests of tables of any size: a Merkle tree over the rows' own digests.

A row's digest is the SHA-256 of its columns; rows are laid out by the first hexadecimal digits of their digest, so ranges are even whatever the
keys are, and a key that any share of the rows have is spread like all others. Equal rows are counted before they meet. A leaf is the digest of the digests (and counts) in its
range, a node that of its sixteen children, and the root that of the table: it depends neither on order nor on partitions, and no task sees more than a
leaf's rows or a node's children. Two trees are compared from the root down, so only ranges that differ are ever looked into.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: Rows to a leaf, about.
LEAF_ROWS = 16


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of the columns' texts, each with its length, so that no two rows read alike; null is told from every text."""
    said = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat_ws(",", *map(said, columns)), 256)


@dataclass(frozen=True)
class Tree:
    by: list[str]
    rows: DataFrame  # by, key, digest, n: each distinct row
    levels: list[DataFrame]  # root first: by, prefix (as many digits as the level), digest, n

    @property
    def depth(self) -> int:
        return len(self.levels) - 1

    def roots(self) -> DataFrame:
        """by, sha256, n_rows."""
        return self.levels[0].select(*self.by, F.col("digest").alias("sha256"), F.col("n").alias("n_rows"))


def depth_for(rows: int) -> int:
    return max(0, math.ceil(math.log(max(rows, 1) / LEAF_ROWS, 16)))


def build(df: DataFrame, key: str, columns: list[str], by: list[str] | None = None, depth: int | None = None) -> Tree:
    """The tree of df (one for each `by`). Trees are comparable if they have the same columns and depth; without one it follows from the number of rows."""
    by = by or []
    digests = df.select(*by, F.col(key).alias("key"), row_digest([key, *(c for c in columns if c != key)]).alias("digest"))
    rows = stored(digests.groupBy(*by, "key", "digest").agg(F.count(F.lit(1)).alias("n")), "merkle-rows")
    if depth is None:
        depth = depth_for(rows.count())
    entry = F.struct("digest", "n")
    each = F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.concat(e["digest"], F.lit(":"), e["n"].cast("string")))
    now = rows.groupBy(*by, F.substring("digest", 1, depth).alias("prefix")).agg(F.sha2(F.array_join(each, ","), 256).alias("digest"), F.sum("n").alias("n"))  # a leaf's rows
    levels = [stored(now, "merkle-leaves")]
    for level in range(depth - 1, -1, -1):
        child = F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda e: F.concat(F.substring(e["prefix"], -1, 1), F.lit(":"), e["digest"]))
        up = levels[-1].groupBy(*by, F.substring("prefix", 1, level).alias("__up")).agg(F.sha2(F.array_join(child, ","), 256).alias("digest"), F.sum("n").alias("n"))  # 16 children at most
        levels.append(stored(up.withColumnRenamed("__up", "prefix").select(*by, "prefix", "digest", "n"), "merkle-nodes"))
    return Tree(by, rows, levels[::-1])


def _group(by: list[str]) -> Column:
    return F.struct(F.lit(0), *by)  # never null, a `by` may be


def differing_ranges(a: Tree, b: Tree) -> list[DataFrame]:
    """For each level, root first: by (as __g) and prefix of the nodes whose digests differ or that one side lacks; below a node that is equal nothing is read."""
    if a.by != b.by or a.depth != b.depth:
        raise ValueError("trees of other groups or depths can't be compared")
    out: list[DataFrame] = []
    for level, (x, y) in enumerate(zip(a.levels, b.levels, strict=True)):
        sides = []
        for tree, name in ((x, "a"), (y, "b")):
            nodes = tree.select(_group(a.by).alias("__g"), "prefix", F.col("digest").alias(name))
            if out:
                above = out[-1].select("__g", F.col("prefix").alias("__up"))
                nodes = nodes.withColumn("__up", F.substring("prefix", 1, level - 1)).join(above, ["__g", "__up"], "left_semi").drop("__up")
            sides.append(nodes)
        apart = sides[0].join(sides[1], ["__g", "prefix"], "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
        out.append(stored(apart.select("__g", "prefix"), "merkle-apart"))
    return out


def differences(a: Tree, b: Tree) -> DataFrame:
    """by, key, side (a or b), n: rows that only one side has, or has more often (by n)."""
    leaves = differing_ranges(a, b)[-1]
    sides = []
    for tree, name in ((a, "a"), (b, "b")):
        rows = tree.rows.select(_group(a.by).alias("__g"), "key", "digest", F.col("n").alias(name)).withColumn("prefix", F.substring("digest", 1, a.depth))
        sides.append(rows.join(leaves, ["__g", "prefix"], "left_semi").withColumn("__k", F.struct("key")).drop("prefix", "key"))
    both = sides[0].join(sides[1], ["__g", "__k", "digest"], "full_outer").withColumn("more", F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).where("more != 0")
    return both.select(*(F.col("__g")[c].alias(c) for c in a.by), F.col("__k.key").alias("key"), F.when(F.col("more") > 0, "a").otherwise("b").alias("side"), F.abs("more").alias("n"))
