"""Audits: set relations, duplicates within and across splits, overlaps, split checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from ..sources.tables import stored


def duplicate_audit(df: DataFrame, split: str, norm: str, label: str) -> DataFrame:
    """Within each split: groups of equal texts, rows beyond the first of each, groups with several labels."""
    g = df.where(F.col(norm) != "").groupBy(split, norm).agg(F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    return g.groupBy(split).agg(F.count_if(F.col("n") > 1).alias("n_groups"), F.sum(F.greatest(F.col("n") - 1, F.lit(0))).alias("extra_rows"), F.count_if((F.col("n") > 1) & (F.col("lo") != F.col("hi"))).alias("conflicting_groups"))


def boundary_overlap(df: DataFrame, source: str, norm: str) -> DataFrame:
    """Distinct texts that each pair of sources (or partitions) shares. Texts are reduced to one row a source first."""
    d = df.where(F.col(norm) != "").select(F.col(norm).alias("t"), F.col(source).alias("s")).distinct()
    pairs = d.select("t", F.col("s").alias("a")).join(d.select("t", F.col("s").alias("b")), "t").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n_shared"))


def pairwise_overlap(sets: DataFrame, name: str = "set_name", key: str = "id", by: list[str] | None = None) -> DataFrame:
    """Intersection, O = intersection / smaller, Jaccard of every pair of sets (of each `by`); pairs without a common id are left out."""
    by = by or []
    size = sets.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))
    a, b = sets.select(*by, F.col(name).alias("a"), key), sets.select(*by, F.col(name).alias("b"), key)
    both = a.join(b, [*by, key]).where("a < b").groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("n_both"))
    both = both.join(size.select(*by, F.col(name).alias("a"), F.col("n").alias("n_a")), [*by, "a"]).join(size.select(*by, F.col(name).alias("b"), F.col("n").alias("n_b")), [*by, "b"])
    return both.withColumn("overlap", ratio(F.col("n_both"), F.least("n_a", "n_b"))).withColumn("jaccard", ratio(F.col("n_both"), F.col("n_a") + F.col("n_b") - F.col("n_both")))


def set_relations(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: sizes, intersection, differences; disjoint, subset, equal."""
    x, y = a.select(key).distinct().withColumn("x", F.lit(1)), b.select(key).distinct().withColumn("y", F.lit(1))
    t = x.join(y, key, "full_outer").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count_if(F.col("x").isNotNull() & F.col("y").isNotNull()).alias("n_both"))
    return t.withColumns({"disjoint": F.col("n_both") == 0, "subset": F.col("n_both") == F.col("n_a"), "equal": (F.col("n_both") == F.col("n_a")) & (F.col("n_a") == F.col("n_b"))})


def lookup(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """Rows of table for the ids; an id without a row is an error when the result is read."""
    got = ids.join(table.withColumn("__found", F.lit(True)), key, "left")
    check = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("no row for key "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return got.withColumn("__found", check).where("__found").drop("__found")


def boundary_audit(df: DataFrame, split: str, norm: str, closed: tuple[str, ...] = ("train", "val", "test")) -> DataFrame:
    """One row: texts that occur twice or more in train alone (reported), texts that span closed splits, and whether that fails."""
    g = df.where(F.col(norm) != "").groupBy(norm).agg(F.collect_set(F.when(F.col(split).isin(*closed), F.col(split))).alias("s"), F.count_if(F.col(split) == closed[0]).alias("n"))
    t = g.agg(F.count_if((F.size("s") == 1) & (F.col("n") > 1)).alias("n_within_train"), F.count_if(F.size("s") > 1).alias("n_spanning"))
    return t.withColumn("failed", F.col("n_spanning") > 0)


def contamination(df: DataFrame, key: str, text: Column, benchmark: DataFrame, bench_key: str, bench_text: Column, width: int = 8) -> DataFrame:
    """(key, bench_key): rows whose words have those of a benchmark text in a row, whatever its length; benchmark texts without words
    are in nothing.

    Candidates share the benchmark text's first `width` words (all of a shorter one) in a row: an equi-join of hashes and
    keys. Texts are fetched for candidates only, and compared."""
    words = lambda t: F.filter(F.split(t, " "), lambda x: x != "")
    gram = lambda w, i, n: F.xxhash64(n, F.array_join(F.slice(w, i, n), " "))
    b = benchmark.select(bench_key, words(bench_text).alias("__w")).where(F.size("__w") > 0).withColumn("__n", F.least(F.size("__w"), F.lit(width)))
    b = b.select(bench_key, F.array_join("__w", " ").alias("__bt"), "__n", gram(F.col("__w"), F.lit(1), F.col("__n")).alias("__g"))
    lengths = [r["__n"] for r in b.select("__n").distinct().collect()]  # `width` of them at most
    if not lengths:
        return df.select(key).limit(0).crossJoin(benchmark.select(bench_key).limit(0))  # no rows on either side
    d = df.select(key, words(text).alias("__w"))
    at = lambda n: F.when(F.size("__w") >= n, F.transform(F.sequence(F.lit(1), F.size("__w") - n + 1), lambda i: gram(F.col("__w"), i, F.lit(n))))
    grams = d.select(key, F.explode(F.array_distinct(F.flatten(F.array(*(F.coalesce(at(n), F.array().cast("array<bigint>")) for n in lengths))))).alias("__g"))
    hits = grams.join(b.select(bench_key, "__g"), "__g").select(key, bench_key).distinct()
    padded = lambda t: F.concat(F.lit(" "), t, F.lit(" "))
    found = hits.join(d.select(key, F.array_join("__w", " ").alias("__t")), key).join(b.select(bench_key, "__bt"), bench_key)
    return found.where(F.contains(padded(F.col("__t")), padded(F.col("__bt")))).select(key, bench_key).distinct()


#: Checks of one split, in order. Fixed values.
CHECKS = ("ids_unique", "partitions_disjoint", "partitions_cover", "train_val_author_disjoint", "train_test_author_disjoint", "val_test_author_disjoint", "one_target_per_author", "eligible_targets", "injected_from_reserve_removed_from_train", "overlap_reconstructed", "sizes_identical", "class_counts_identical", "uniform_coverage", "injected_thread_disjoint", "match_complete", "random_partitions_disjoint", "blocks_partition_train_authors")


def split_checks(corpus: DataFrame, roles: DataFrame, matches: DataFrame, overlap: DataFrame, random_split: DataFrame, blocks: DataFrame, dose: int = 1) -> DataFrame:
    """(split_seed, check_id, name, passed): 17 checks of each split, each recomputed from the relations themselves.

    Every relation's counts are a plan of their own that writes a row for each split: one plan for all of them would be of hundreds of operators, which the driver has to hold."""
    n_corpus = corpus.agg(F.count(F.lit(1)).alias("n_corpus"))
    seeds = stored(roles.select("split_seed").distinct(), "facts")
    base = roles.groupBy("split_seed").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_if(F.col("role") == "train").alias("n_train"))
    authors = roles.groupBy("split_seed", "author").agg(*(F.max((F.col("role") == r).cast("int")).alias(r) for r in ("train", "val", "test")), F.count_if(F.col("role") == "test").alias("targets"), F.max((F.col("partition") == "test").cast("int")).alias("part"), F.max(F.col("strict").cast("int")).alias("strict"))
    both = lambda a, b: F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}")
    au = authors.groupBy("split_seed").agg(both("train", "val"), both("train", "test"), both("val", "test"), F.count_if((F.col("part") == 1) & (F.col("targets") != 1)).alias("bad_targets"))
    target = roles.where("role = 'test'").select("split_seed", "author", F.col("link_id").alias("t_thread"), "strict", F.col("link_id_valid").alias("t_valid"))
    el = target.groupBy("split_seed").agg(F.count_if(F.col("strict") & ~F.col("t_valid")).alias("bad_eligible"), F.count_if("strict").alias("n_eligible"))
    role = roles.select("split_seed", "id", "author", "role", "label", "link_id")
    inj = matches.select("split_seed", F.col("injected_id").alias("id"), "level").join(role, ["split_seed", "id"], "left").join(target.select("split_seed", "author", "t_thread"), ["split_seed", "author"], "left")
    i = inj.groupBy("split_seed").agg(F.count(F.lit(1)).alias("n_inj"), F.count_if(F.coalesce(F.col("role") != "reserve", F.lit(True))).alias("bad_inj"), F.count_if(F.coalesce(F.col("link_id") == F.col("t_thread"), F.lit(True))).alias("bad_thread"), F.count_if(F.col("level") == "failed").alias("failed"))
    per = inj.groupBy("split_seed", "author").agg(F.count(F.lit(1)).alias("n")).groupBy("split_seed").agg(F.count(F.lit(1)).alias("n_inj_authors"), F.count_if(F.col("n") != dose).alias("bad_dose"))
    rem = matches.where("removed_id IS NOT NULL").select("split_seed", F.col("removed_id").alias("id")).join(role, ["split_seed", "id"], "left")
    r = rem.groupBy("split_seed").agg(F.count_if(F.coalesce(F.col("role") != "train", F.lit(True))).alias("bad_rem"), F.count(F.lit(1)).alias("n_rem"), F.count_distinct("id").alias("n_rem_ids"))
    ov = overlap.join(role.select("split_seed", "id", F.col("role").alias("own"), "label"), ["split_seed", "id"], "left")
    o = ov.groupBy("split_seed").agg(F.count(F.lit(1)).alias("n_overlap"), F.count_distinct("id").alias("n_overlap_ids"), F.count_if(F.col("own") == "train").alias("from_train"), F.count_if(F.col("own") == "reserve").alias("from_reserve"))
    side = role.where("role = 'train'").select("split_seed", "label", F.lit(1).alias("d")).unionByName(ov.select("split_seed", "label", F.lit(-1).alias("d")))
    c = side.groupBy("split_seed", "label").agg(F.sum("d").alias("d")).groupBy("split_seed").agg(F.count_if(F.col("d") != 0).alias("bad_classes"))
    rs = random_split.groupBy("split_seed").agg(F.count(F.lit(1)).alias("rand_rows"), F.count_distinct("id").alias("rand_ids"))
    tr = roles.where("role = 'train'").select("split_seed", "author").distinct().withColumn("t", F.lit(1))
    bl = blocks.select("split_seed", "author", "block").join(tr, ["split_seed", "author"], "full_outer").groupBy("split_seed").agg(F.count_if(F.col("block").isNull() | F.col("t").isNull()).alias("bad_block"), F.count(F.lit(1)).alias("block_rows"), F.count_distinct("author").alias("block_authors"))
    facts, names = None, []
    for part in (base, au, el, i, per, r, o, c, rs, bl):
        own = [n for n in part.columns if n != "split_seed"]
        part = stored(part.select("split_seed", F.explode(F.array(*(F.struct(F.lit(n).alias("fact"), F.col(n).cast("bigint").alias("n")) for n in own))).alias("f")).select("split_seed", "f.*"), "facts")
        facts, names = part if facts is None else facts.unionByName(part), names + own
    facts = facts.groupBy("split_seed").agg(*(F.max(F.when(F.col("fact") == n, F.col("n"))).alias(n) for n in names))
    all_ = seeds.join(facts, "split_seed", "left").crossJoin(F.broadcast(stored(n_corpus, "facts")))  # a row for each seed; a single row
    x = F.col
    tests = (
        x("rows") == x("ids"), x("rows") == x("ids"), x("ids") == x("n_corpus"), x("train_val") == 0, x("train_test") == 0, x("val_test") == 0,
        x("bad_targets") == 0, x("bad_eligible") == 0, (x("bad_inj") == 0) & (x("bad_rem") == 0) & (x("n_rem") == x("n_rem_ids")),
        (x("n_overlap") == x("n_overlap_ids")) & (x("from_train") == x("n_train") - x("n_rem")) & (x("from_reserve") == x("n_inj")), x("n_overlap") == x("n_train"),
        x("bad_classes") == 0, (x("n_inj_authors") == x("n_eligible")) & (x("bad_dose") == 0), x("bad_thread") == 0, x("failed") == 0, x("rand_rows") == x("rand_ids"),
        (x("bad_block") == 0) & (x("block_rows") == x("block_authors")),
    )
    rows = F.inline(F.array(*(F.struct(F.lit(k + 1).alias("check_id"), F.lit(n).alias("name"), F.coalesce(t, F.lit(False)).alias("passed")) for k, (n, t) in enumerate(zip(CHECKS, tests, strict=True)))))
    return all_.select("split_seed", rows)
