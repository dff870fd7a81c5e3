"""Leakage-controlled splits, matched substitution, balanced blocks, hash-rank samples.

All draws follow hash order (functions.hashing); split_seed is a column, so one plan makes the splits of all seeds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..plans.prefix import running_totals
from ..schemas import JURORS
from ..sources.tables import dropped, stored
from .greedy import nested_greedy

TEST_SHARE = VAL_SHARE = 0.15
SEEDS = (42, 123, 2024)


def eligibility(corpus: DataFrame) -> DataFrame:
    """Posts of each author, with a valid thread, distinct valid threads; loose and strict eligibility."""
    valid = F.when(F.col("link_id_valid"), F.col("link_id"))
    per = corpus.groupBy("author").agg(F.count(F.lit(1)).alias("n_posts"), F.count(valid).alias("n_valid"), F.count_distinct(valid).alias("n_threads"))
    return per.withColumn("loose", F.col("n_posts") >= 2).withColumn("strict", (F.col("n_valid") >= 2) & (F.col("n_threads") >= 2))


def author_partitions(corpus: DataFrame, seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(split_seed, author, partition, strict, n_posts): author-disjoint test, val and train.

    Authors come in hash order. Each test author gives one row to the test set and drains the others; test stops with
    the author that brings its share of what remains to 15 %; val takes the next ones while it is below 15 % of that."""
    a = eligibility(corpus).select("author", "n_posts", "strict", F.explode(F.array(*map(F.lit, seeds))).alias("split_seed"))
    a = a.withColumn("h", order_key(F.col("split_seed"), "permute", "author"))
    a = running_totals(a, "h", "author", {"posts": F.col("n_posts"), "rank": F.lit(1).cast("bigint")}, ["split_seed"])
    reached = F.col("run_rank") / ((F.col("all_posts") - F.col("run_posts")) + F.col("run_rank")) >= TEST_SHARE
    stop = a.groupBy("split_seed").agg(F.min(F.when(reached, F.struct("run_rank", "run_posts", "all_posts"))).alias("s"))
    stop = stop.select("split_seed", F.col("s.run_rank").alias("stop"), F.col("s.run_posts").alias("drained"), (F.col("s.all_posts") - F.col("s.run_posts") + F.col("s.run_rank")).alias("analysis"))
    a = a.join(F.broadcast(stop), "split_seed")  # one row for each seed
    val = F.col("run_posts") - F.col("drained") - F.col("n_posts") < VAL_SHARE * F.col("analysis")
    part = F.when(F.col("run_rank") <= F.col("stop"), "test").when(val, "val").otherwise("train")
    return a.select("split_seed", "author", "n_posts", "strict", part.alias("partition"))


def assign_roles(corpus: DataFrame, partitions: DataFrame) -> DataFrame:
    """Every row of the corpus for each seed, with partition, role and strict.

    A strictly eligible test author's target is drawn over distinct valid threads, then within the thread. Their
    other posts in valid other threads are the reserve; all other posts of test authors are excluded."""
    rows = corpus.join(partitions.select("split_seed", "author", "partition", "strict"), "author")
    test = rows.where("partition = 'test'").select("split_seed", "author", "strict", "id", F.when(F.col("link_id_valid"), F.col("link_id")).alias("thread"))
    test = test.withColumn("hp", order_key(F.col("split_seed"), "post", "id"))
    threads = test.groupBy("split_seed", "author", "strict", "thread").agg(F.min(F.struct("hp", "id")).alias("p"))
    threads = threads.withColumn("ht", order_key(F.col("split_seed"), "thread", "author", F.coalesce("thread", F.lit(""))))
    pick = threads.groupBy("split_seed", "author").agg(F.min(F.when(F.col("thread").isNotNull(), F.struct("ht", "thread", F.col("p.id").alias("id")))).alias("e"), F.min("p").alias("i"), F.max("strict").alias("s"))
    target = pick.select("split_seed", "author", F.when(F.col("s"), F.col("e.id")).otherwise(F.col("i.id")).alias("target_id"), F.when(F.col("s"), F.col("e.thread")).alias("target_thread"))
    # by author alone, as rows and targets already lie: a join on the seed too would deal every row of every seed anew
    each = target.groupBy("author").agg(F.collect_list(F.struct("split_seed", "target_id", "target_thread")).alias("targets"))  # one for each seed
    own = F.try_element_at(F.filter("targets", lambda t: t["split_seed"] == F.col("split_seed")), F.lit(1))
    rows = rows.join(each, "author", "left").withColumns({"target_id": own["target_id"], "target_thread": own["target_thread"]}).drop("targets")
    role = F.when(F.col("partition") != "test", F.col("partition")).when(F.col("id") == F.col("target_id"), "test")
    role = role.when(F.col("strict") & F.col("link_id_valid") & (F.col("link_id") != F.col("target_thread")), "reserve").otherwise("excluded")
    return rows.withColumn("role", role)


LEVELS = (("exact", ("label", "sub", "len_bucket", "ppa_bucket")), ("no_activity", ("label", "sub", "len_bucket")), ("label_sub", ("label", "sub")), ("label_only", ("label",)))


def injected(roles: DataFrame, dose: int = 1) -> DataFrame:
    """`dose` reserve rows of each strictly eligible test author that has as many."""
    reserve = roles.where("role = 'reserve' AND strict").withColumn("h", order_key(F.col("split_seed"), "dose", "id"))
    w = Window.partitionBy("split_seed", "author")
    ranked = reserve.withColumn("r", F.row_number().over(w.orderBy("h", "id"))).withColumn("n", F.count(F.lit(1)).over(w))
    return ranked.where((F.col("r") <= dose) & (F.col("n") >= dose)).drop("h", "r", "n")


def matched_doses(roles: DataFrame, doses: tuple[int, ...] = (1,)) -> DataFrame:
    """(split_seed, dose, injected_id, removed_id, level): for each injected row one training row to remove, once each, at every dose.

    Set-based: at every level, rows that are still free get a rank in hash order within their key, on either side; equal
    ranks are partners. A rank is a running total over hash ranges, so a label that holds every row is still many tasks. A level
    writes its partners and what stays free, which the next level takes up; all doses go through it together."""
    every = F.explode(F.array(*map(F.lit, doses))).alias("dose")
    keys = ["label", "sub", "len_bucket", "ppa_bucket"]
    least = [injected(roles, k).select("split_seed", F.lit(k).alias("dose"), "id", *keys, F.lit(1).alias("side")) for k in doses]
    free = roles.where("role = 'train'").select("split_seed", every, "id", *keys, F.lit(0).alias("side"))
    for rows in least:
        free = free.unionByName(rows)
    free = free.withColumn("h", order_key(F.col("split_seed"), "match", "id"))
    by, paired = ["split_seed", "dose", "key"], None
    for name, cols in LEVELS:
        rows = stored(free.withColumn("key", F.to_json(F.struct(*cols))), "free")  # a null is a missing field, so it equals itself
        rows = running_totals(rows, "h", "id", {f"s{i}": (F.col("side") == i).cast("bigint") for i in (0, 1)}, by)
        rank = F.when(F.col("side") == 1, F.col("run_s1")).otherwise(F.col("run_s0"))
        rows = stored(rows.select(*free.columns, "key", rank.alias("rank"), (rank <= F.least("all_s0", "all_s1")).alias("hit")), "ranked")
        a = rows.where("hit AND side = 1").select(*by, "rank", F.col("id").alias("injected_id"))
        b = rows.where("hit AND side = 0").select(*by, "rank", F.col("id").alias("removed_id"))
        part = a.join(b, [*by, "rank"]).select("split_seed", "dose", "injected_id", "removed_id", F.lit(name).alias("level"))
        paired = part if paired is None else paired.unionByName(part)
        free = rows.where("NOT hit").select(*free.columns)
    failed = free.where("side = 1").select("split_seed", "dose", F.col("id").alias("injected_id"), F.lit(None).cast(free.schema["id"].dataType).alias("removed_id"), F.lit("failed").alias("level"))
    return paired.unionByName(failed)


def matched_substitution(roles: DataFrame, dose: int = 1) -> DataFrame:
    """(split_seed, injected_id, removed_id, level) at one dose."""
    return matched_doses(roles, (dose,)).drop("dose")


def exact_greedy_match(roles: DataFrame, dose: int = 1) -> DataFrame:
    """The sequential rule: injected rows in the order of their authors take the first unused row at the tightest level.

    Every key has the label, so labels are independent groups, and so is all within them that cannot run out (`greedy`)."""
    author = F.when(F.col("role") == "reserve", F.col("author")).alias("author")
    rows = roles.where("role = 'train' OR role = 'reserve' AND strict").select("split_seed", author, "id", *LEVELS[0][1], "role", "strict")
    rows = stored(rows, "greedy-roles")
    put = stored(injected(rows, dose), "greedy-put")
    train = rows.where("role = 'train'").withColumn("h", order_key(F.col("split_seed"), "match", "id"))
    out = nested_greedy(put, train, LEVELS)
    dropped(rows)
    dropped(put)
    return out


def overlap_training(roles: DataFrame, matches: DataFrame) -> DataFrame:
    """(split_seed, id): train without the removed rows, with the injected ones."""
    train = roles.where("role = 'train'").select("split_seed", "id")
    gone = matches.where("removed_id IS NOT NULL").select("split_seed", F.col("removed_id").alias("id"))
    return train.join(gone, ["split_seed", "id"], "left_anti").unionByName(matches.select("split_seed", F.col("injected_id").alias("id")))


def stratified_cut(rows: DataFrame, key: str = "id", label: str = "label") -> DataFrame:
    """(split_seed, id, label, partition) of rows that have a split_seed: 70/15/15 of each label by position in the split's hash order."""
    rows = rows.select("split_seed", key, label).withColumn("h", order_key(F.col("split_seed"), "random", key))
    rows = running_totals(rows, "h", key, {"n": F.lit(1).cast("bigint")}, ["split_seed", label])
    at = F.col("run_n") - 1
    part = F.when(at < F.floor(0.7 * F.col("all_n")), "train").when(at < F.floor(0.85 * F.col("all_n")), "val").otherwise("test")
    return rows.select("split_seed", key, label, part.alias("partition"))


def stratified_split(corpus: DataFrame, key: str = "id", label: str = "label", seeds: tuple[int, ...] = SEEDS) -> DataFrame:
    """(split_seed, id, label, partition): the whole corpus, cut with each seed."""
    return stratified_cut(corpus.select(key, label, F.explode(F.array(*map(F.lit, seeds))).alias("split_seed")), key, label)


def hash_sample(df: DataFrame, key: str, n: int, seed: int, namespace: str) -> DataFrame:
    """The n rows that come first by hash: top n, no global sort."""
    return df.withColumn("h", order_key(seed, namespace, key)).orderBy("h", key).limit(n)


def serpentine_blocks(rows: DataFrame, blocks: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """(split_seed, author, block): authors of each dominant label by size, dealt back and forth over the blocks."""
    per = rows.groupBy("split_seed", "author", "label").agg(F.count(F.lit(1)).alias("n"))
    top = per.groupBy("split_seed", "author").agg(F.sum("n").alias("posts"), F.max(F.struct("n", F.col("label"))).alias("t")).select("split_seed", "author", "posts", F.col("t.label").alias("dominant"))
    rank = F.row_number().over(Window.partitionBy("split_seed", "dominant").orderBy(F.desc("posts"), "author")) - 1
    k = len(blocks)
    at = F.when(F.floor(rank / k) % 2 == 0, rank % k).otherwise(k - 1 - rank % k)
    return top.withColumn("block", F.element_at(F.array(*map(F.lit, blocks)), (at + 1).cast("int"))).select("split_seed", "author", "posts", "dominant", "block")


def greedy_blocks(rows: DataFrame, labels: list[str], blocks: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """Authors by size, each to the block that keeps the class counts most even; ties by hash. Sequential by nature:
    one task for each seed, over authors, not posts."""
    per = rows.groupBy("split_seed", "author").agg(*(F.count_if(F.col("label") == x).alias(f"c{i}") for i, x in enumerate(labels))).withColumn("h", order_key(F.col("split_seed"), "block", "author"))
    names = [f"c{i}" for i in range(len(labels))]

    def deal(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(posts=part[names].sum(axis=1)).sort_values(["posts", "h"], ascending=[False, True])
        counts = np.zeros((len(blocks), len(names)))
        out = []
        for seed, author, own in zip(part.split_seed, part.author, part[names].to_numpy(), strict=True):
            uneven = [(counts + np.eye(len(blocks))[b][:, None] * own).std(axis=0).sum() for b in range(len(blocks))]
            b = int(np.argmin(uneven))
            counts[b] += own
            out.append((seed, author, int(own.sum()), blocks[b]))
        return pd.DataFrame(out, columns=["split_seed", "author", "posts", "block"])

    return per.groupBy("split_seed").applyInPandas(deal, "split_seed int, author string, posts bigint, block string")


def juror_training(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """(split_seed, juror, id): the rows of each juror's two blocks."""
    pairs = F.inline(F.array(*(F.struct(F.lit(j).alias("juror"), F.lit(b).alias("of")) for j, b in JURORS)))
    return rows.join(blocks.select("split_seed", "author", "block"), ["split_seed", "author"]).select("split_seed", "id", "label", "block", pairs).where("block = of").drop("of", "block")


def share_drift(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """The largest spread of a class's share between blocks."""
    per = rows.join(blocks.select("split_seed", "author", "block"), ["split_seed", "author"]).groupBy("split_seed", "block", "label").agg(F.count(F.lit(1)).alias("n"))
    share = per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("split_seed", "block")))
    return share.groupBy("split_seed", "label").agg((F.max("share") - F.min("share")).alias("d")).groupBy("split_seed").agg(F.max("d").alias("max_share_drift"))
