"""Queries on annotations, texts, splits, feasibility and provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import audit, dedup, feasibility, labels, metrics, neighbours, splits
from ..plans import freeze, provenance
from ..schemas import struct
from ..sources.tables import read_csvs, read_ids, read_json_lines, replace_directory, scratch, stored, write_csv
from .surrogates import CATEGORIES, CORPUS_SQL, ELIGIBLE_SQL, PARTITIONS_SQL, PRIORITIES, RATERS_SQL, SPLIT_SQL, corpus, match_sql, r, rater_rows, roles, sql_int, sql_key, table, votes

QUERIES, SQL = {}, {}


def roles_once(spark, sf_dir):
    """The roles, written once for queries that read them several times."""
    return stored(roles(spark, sf_dir), "roles")


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- annotations
@query
def consensus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes(spark, sf_dir).select("item", "n_raters", "n_reached", "outcome", "label", F.col("top_votes").cast("bigint").alias("top_votes"))


SQL["consensus_labels"] = f"WITH {RATERS_SQL} SELECT item, n_raters, n_reached, outcome, label, top_votes FROM votes"


@query
def rater_breakdown(spark, sf_dir):
    return labels.outcome_counts(votes(spark, sf_dir), ("n_raters",))


SQL["rater_breakdown"] = f"WITH {RATERS_SQL} SELECT n_raters, count(*) AS n_items, count(*) FILTER (WHERE outcome = 'single') AS n_single, count(*) FILTER (WHERE outcome = 'multi') AS n_multi, count(*) FILTER (WHERE outcome = 'none') AS n_none FROM votes GROUP BY n_raters"


@query
def strict_majority(spark, sf_dir):
    return labels.strict_majority(votes(spark, sf_dir), CATEGORIES)


SQL["strict_majority"] = f"""WITH {RATERS_SQL}, m AS (SELECT {' + '.join(f'(2 * "{c}" > n_raters)::INT' for c in CATEGORIES)} AS k FROM vv)
SELECT count(*) AS n_items, count(*) FILTER (WHERE k = 1) AS n_single, count(*) FILTER (WHERE k > 1) AS n_multi, count(*) FILTER (WHERE k = 0) AS n_none FROM m"""


@query
def fleiss_kappa(spark, sf_dir):
    return labels.fleiss_kappa(votes(spark, sf_dir), CATEGORIES)


SQL["fleiss_kappa"] = f"""WITH {RATERS_SQL}, l AS (UNPIVOT (SELECT n_raters, {', '.join(f'"{c}"' for c in CATEGORIES)} FROM vv WHERE n_raters >= 2) ON {', '.join(f'"{c}"' for c in CATEGORIES)} INTO NAME category VALUE yes),
k AS (SELECT category, count(*) AS n_items, avg((yes * yes + (n_raters - yes) * (n_raters - yes) - n_raters)::DOUBLE / (n_raters * (n_raters - 1))) AS p_bar, sum(yes)::DOUBLE / sum(n_raters) AS p FROM l GROUP BY category),
e AS (SELECT *, p * p + (1 - p) * (1 - p) AS p_e FROM k)
SELECT category, n_items, {r('p_bar')} AS p_bar, {r('p')} AS p, {r('p_e')} AS p_e, {r('(p_bar - p_e) / (1 - p_e)')} AS kappa FROM e"""


@query
def multiselect_rate(spark, sf_dir):
    return labels.multiselect(rater_rows(spark, sf_dir), "item", CATEGORIES)


SQL["multiselect_rate"] = f"""WITH {RATERS_SQL}, p AS (SELECT item, count(*) AS n, sum(({' + '.join(f'"{c}"' for c in CATEGORIES)} > 1)::INT) AS m FROM rr GROUP BY item)
SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_items, {r('100 * sum(m) / sum(n)')} AS multi_row_pct, {r('100 * sum((m > 0)::INT) / count(*)')} AS multi_item_pct FROM p"""


# --- multi-hot
FLAGS = ["RF", "RO", "AF", "AO", "NF", "NO"]
MAPPING = {"RF": "returned", "RO": "returned", "AF": "accepted", "AO": "accepted", "NF": "none"}


def _multi_hot(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat("l_returnflag", "l_linestatus").alias("f"))
    on = F.array(*(F.max((F.col("f") == x).cast("int")) for x in FLAGS))
    v = l.groupBy("l_orderkey").agg(on.alias("v"))
    target, reason = labels.retention(labels.decode_multi_hot(F.col("v"), FLAGS), MAPPING)
    return v.select("l_orderkey", target.alias("target"), reason.alias("reason"))


_HOT_SQL = f"""hot AS (SELECT l_orderkey, {', '.join(f"max((l_returnflag || l_linestatus = '{x}')::INT) AS {x}" for x in FLAGS)} FROM lineitem GROUP BY l_orderkey),
kept AS (SELECT l_orderkey, ({' + '.join(FLAGS)}) AS n_on, "NO" AS unmapped, (greatest(RF, RO) + greatest(AF, AO) + NF) AS kinds, CASE WHEN greatest(RF, RO) = 1 THEN 'returned' WHEN greatest(AF, AO) = 1 THEN 'accepted' ELSE 'none' END AS t FROM hot),
reasons AS (SELECT l_orderkey, t, CASE WHEN n_on = 0 THEN 'no_active' WHEN unmapped = 1 THEN 'unmapped' WHEN kinds > 1 THEN 'multiple' ELSE 'retained' END AS reason FROM kept)"""


@query
def multihot_retention(spark, sf_dir):
    return _multi_hot(spark, sf_dir)


SQL["multihot_retention"] = f"WITH {_HOT_SQL} SELECT l_orderkey, CASE WHEN reason = 'retained' THEN t END AS target, reason FROM reasons"


@query
def exclusion_reasons(spark, sf_dir):
    return _multi_hot(spark, sf_dir).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


SQL["exclusion_reasons"] = f"WITH {_HOT_SQL} SELECT reason, count(*) AS n FROM reasons GROUP BY reason"

# --- texts
_NORM = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\[(name|religion)\]', ' ', 'g'), 'http\S+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))"


def norm_sql(c: str) -> str:
    return _NORM.replace("{0}", c)


@query
def exact_dedup(spark, sf_dir):
    g = dedup.exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return g.select("doc_id", "keep_key", "copies", "kept")


SQL["exact_dedup"] = f"""WITH d AS (SELECT doc_id, coalesce({norm_sql('text')}, '') AS t FROM documents)
SELECT doc_id, CASE WHEN t <> '' THEN min(doc_id) OVER (PARTITION BY t) END AS keep_key, CASE WHEN t <> '' THEN count(*) OVER (PARTITION BY t) END AS copies, t <> '' AND doc_id = min(doc_id) OVER (PARTITION BY t) AS kept FROM d"""


@query
def dup_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", F.coalesce(text.normalise(F.col("text")), F.lit("")).alias("norm"))
    return audit.duplicate_audit(d, "source", "norm", "lang")


SQL["dup_audit"] = f"""WITH d AS (SELECT source, lang, coalesce({norm_sql('text')}, '') AS t FROM documents),
g AS (SELECT source, t, count(*) AS n, min(lang) AS lo, max(lang) AS hi FROM d WHERE t <> '' GROUP BY source, t)
SELECT source, count(*) FILTER (WHERE n > 1) AS n_groups, sum(greatest(n - 1, 0))::BIGINT AS extra_rows, count(*) FILTER (WHERE n > 1 AND lo <> hi) AS conflicting_groups FROM g GROUP BY source"""


@query
def nfkc_dup_audit(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang", text.normalise_nfkc(F.col("text")).alias("norm"))
    return audit.duplicate_audit(d, "source", "norm", "lang")


def _union(spark, sf_dir):
    part = lambda name, key, col: table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.concat(F.lit(f"{name}::"), F.col(key).cast("string")).alias("id"), F.col(col).alias("text"))
    return part("documents", "doc_id", "text").unionByName(part("conversations", "conv_id", "text")).unionByName(part("benchmark", "item_id", "text"))


@query
def boundary_overlap(spark, sf_dir):
    u = _union(spark, sf_dir).withColumn("norm", F.coalesce(text.normalise(F.col("text")), F.lit("")))
    d = table(spark, sf_dir, "documents").select(F.col("source"), F.coalesce(text.normalise(F.col("text")), F.lit("")).alias("norm"))
    return audit.boundary_overlap(u.select("source", "norm").unionByName(d), "source", "norm")


SQL["boundary_overlap"] = f"""WITH u AS (SELECT 'documents' AS s, coalesce({norm_sql('text')}, '') AS t FROM documents UNION SELECT 'conversations', coalesce({norm_sql('text')}, '') FROM conversations UNION SELECT 'benchmark', coalesce({norm_sql('text')}, '') FROM benchmark UNION SELECT source, coalesce({norm_sql('text')}, '') FROM documents)
SELECT a.s AS a, b.s AS b, count(*) AS n_shared FROM u a JOIN u b ON a.t = b.t AND a.s < b.s WHERE a.t <> '' GROUP BY ALL"""


@query
def contamination_hits(spark, sf_dir):
    d, b = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return audit.contamination(d, "doc_id", text.normalise(F.col("text")), b, "item_id", text.normalise(F.col("text")))


SQL["contamination_hits"] = f"""WITH d AS (SELECT doc_id, {norm_sql('text')} AS t FROM documents), b AS (SELECT item_id, {norm_sql('text')} AS t FROM benchmark)
SELECT doc_id, item_id FROM d JOIN b ON contains(' ' || d.t || ' ', ' ' || b.t || ' ') WHERE b.t <> ''"""


def _parted(spark, sf_dir):
    part = hashing.uniform_int(10, 42, "boundary", F.col("doc_id").cast("string"))
    d = table(spark, sf_dir, "documents").select(F.col("text"), F.when(part < 7, "train").when(part < 8, "val").when(part < 9, "test").otherwise("spare").alias("part"))
    return d.select("part", F.coalesce(text.normalise(F.col("text")), F.lit("")).alias("norm"))


@query
def boundary_audit(spark, sf_dir):
    return audit.boundary_audit(_parted(spark, sf_dir), "part", "norm")


SQL["boundary_audit"] = f"""WITH p AS (SELECT {sql_int(sql_key('boundary', 'doc_id'))} % 10 AS p, coalesce({norm_sql('text')}, '') AS t FROM documents),
g AS (SELECT t, count(DISTINCT CASE WHEN p < 7 THEN 1 WHEN p < 8 THEN 2 WHEN p < 9 THEN 3 END) AS s, count(*) FILTER (WHERE p < 7) AS n FROM p WHERE t <> '' GROUP BY t)
SELECT count(*) FILTER (WHERE s = 1 AND n > 1) AS n_within_train, count(*) FILTER (WHERE s > 1) AS n_spanning, count(*) FILTER (WHERE s > 1) > 0 AS failed FROM g"""


@query
def composition_cube(spark, sf_dir):
    return metrics.composition(table(spark, sf_dir, "documents"), ["source", "lang"])


SQL["composition_cube"] = "SELECT source, lang, count(*) AS n, grouping(source)::INT AS all_source, grouping(lang)::INT AS all_lang FROM documents GROUP BY CUBE (source, lang)"


@query
def token_buckets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.token_count(F.col("text")), F.lit(0)).alias("n_tokens"))
    return text.quartile_bucket(d, "n_tokens")


SQL["token_buckets"] = r"""WITH d AS (SELECT doc_id, coalesce(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '')), 0)::INT AS n_tokens FROM documents),
e AS (SELECT list_distinct(quantile_cont(n_tokens, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM d)
SELECT doc_id, n_tokens, greatest(len(list_filter(e, lambda x: x < n_tokens)) - 1, 0)::INT AS len_bucket FROM d, e"""


# --- corpus
@query
def quartile_buckets(spark, sf_dir):
    return corpus(spark, sf_dir).groupBy("len_bucket", "ppa_bucket").agg(F.count(F.lit(1)).alias("n"), F.min("n_tokens").alias("lo"), F.max("n_tokens").alias("hi"))


SQL["quartile_buckets"] = f"WITH {CORPUS_SQL} SELECT len_bucket, ppa_bucket, count(*) AS n, min(n_tokens) AS lo, max(n_tokens) AS hi FROM corpus GROUP BY ALL"


@query
def activity_profile(spark, sf_dir):
    return feasibility.activity_profile(corpus(spark, sf_dir))


SQL["activity_profile"] = f"""WITH {CORPUS_SQL}, p AS (SELECT author, count(*) AS n FROM corpus GROUP BY author)
SELECT count(*) AS n_authors, sum(n)::BIGINT AS n_posts, {', '.join(f"{r(f'100 * count(*) FILTER (WHERE n >= {k}) / count(*)')} AS pct_authors_ge{k}" for k in (2, 3, 5))}, {r('100 * sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n)')} AS pct_posts_multi, max(n) AS max_posts FROM p"""


@query
def author_label_pivot(spark, sf_dir):
    p = corpus(spark, sf_dir).groupBy("author").pivot("label", PRIORITIES).agg(F.count(F.lit(1)))
    return p.select("author", *(F.coalesce(F.col(f"`{x}`"), F.lit(0)).cast("bigint").alias(f"n{i}") for i, x in enumerate(PRIORITIES)))


SQL["author_label_pivot"] = f"WITH {CORPUS_SQL} SELECT author, {', '.join(f"count(*) FILTER (WHERE label = '{x}') AS n{i}" for i, x in enumerate(PRIORITIES))} FROM corpus GROUP BY author"


@query
def eligibility(spark, sf_dir):
    return splits.eligibility(corpus(spark, sf_dir))


SQL["eligibility"] = f"WITH {CORPUS_SQL}, {ELIGIBLE_SQL} SELECT * FROM elig"


@query
def first_post(spark, sf_dir):
    return labels.first_kept(corpus(spark, sf_dir).select("author", "id", "label", "link_id"), "author", [F.col("id").cast("bigint")])


SQL["first_post"] = f"WITH {CORPUS_SQL} SELECT author, id, label, link_id FROM corpus QUALIFY row_number() OVER (PARTITION BY author ORDER BY id::BIGINT) = 1"


# --- splits
@query
def author_split(spark, sf_dir):
    return splits.author_partitions(corpus(spark, sf_dir))


SQL["author_split"] = f"WITH {CORPUS_SQL},\n{ELIGIBLE_SQL},\n{PARTITIONS_SQL} SELECT split_seed, author, n_posts, strict, \"partition\" FROM parts"


@query
def split_roles(spark, sf_dir):
    return roles(spark, sf_dir).select("split_seed", "id", "partition", "role")


SQL["split_roles"] = f"WITH {SPLIT_SQL} SELECT split_seed, id, \"partition\", role FROM roles"


@query
def reserve_pool(spark, sf_dir):
    return feasibility.reserve_per_author(roles(spark, sf_dir))


SQL["reserve_pool"] = f"WITH {SPLIT_SQL}, p AS (SELECT split_seed, author, count(*) AS n FROM roles WHERE role = 'reserve' GROUP BY ALL) SELECT split_seed, count(*) AS n_authors, {r('median(n)')} AS median FROM p GROUP BY split_seed"


@query
def role_profile(spark, sf_dir):
    return feasibility.role_profile(roles(spark, sf_dir))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE role = '{x}') AS n_{x}" for x in ("train", "val", "test", "reserve", "excluded"))
_PROFILE = f"rp AS (SELECT split_seed, count(*) AS n, {_COUNTS}, count(*) FILTER (WHERE role = 'test' AND strict) AS n_eligible_test FROM roles GROUP BY split_seed)"
SQL["role_profile"] = f"""WITH {SPLIT_SQL}, {_PROFILE} SELECT *, {', '.join(f"{r(f'100 * n_{x} / (n_train + n_val + n_test)')} AS {x}_pct" for x in ('train', 'val', 'test'))}, {r('100 * n_reserve / n')} AS reserve_pct, 100 * n_reserve / n > 25 AS dense FROM rp"""


@query
def matched_substitution(spark, sf_dir):
    return splits.matched_substitution(roles_once(spark, sf_dir))


SQL["matched_substitution"] = f"WITH {SPLIT_SQL},\n{match_sql()} SELECT * FROM match"


@query
def exact_greedy_match(spark, sf_dir):
    return splits.exact_greedy_match(roles(spark, sf_dir))


@query
def overlap_training(spark, sf_dir):
    x = roles_once(spark, sf_dir)
    return splits.overlap_training(x, splits.matched_substitution(x))


SQL["overlap_training"] = f"""WITH {SPLIT_SQL},\n{match_sql()} SELECT split_seed, id FROM roles WHERE role = 'train' AND NOT EXISTS (SELECT 1 FROM match m WHERE m.split_seed = roles.split_seed AND m.removed_id = roles.id) UNION ALL SELECT split_seed, injected_id FROM match"""


@query
def stratified_split(spark, sf_dir):
    return splits.stratified_split(corpus(spark, sf_dir))


SQL["stratified_split"] = f"""WITH {CORPUS_SQL}, s AS (SELECT split_seed, id, label, row_number() OVER (PARTITION BY split_seed, label ORDER BY {sql_key('random', 'id', seed='split_seed')}, id) - 1 AS pos, count(*) OVER (PARTITION BY split_seed, label) AS n FROM corpus, (SELECT unnest([42, 123, 2024])::INT AS split_seed))
SELECT split_seed, id, label, CASE WHEN pos < floor(0.7::DOUBLE * n) THEN 'train' WHEN pos < floor(0.85::DOUBLE * n) THEN 'val' ELSE 'test' END AS "partition" FROM s"""


@query
def stratified_split_analysis(spark, sf_dir):
    """The other population: the rows with a role in each split's own analysis set, cut with that split's seed."""
    return splits.stratified_cut(roles(spark, sf_dir).where("role IN ('train', 'val', 'test')").select("split_seed", "id", "label"))


SQL["stratified_split_analysis"] = f"""WITH {SPLIT_SQL}, s AS (SELECT split_seed, id, label, row_number() OVER (PARTITION BY split_seed, label ORDER BY {sql_key('random', 'id', seed='split_seed')}, id) - 1 AS pos, count(*) OVER (PARTITION BY split_seed, label) AS n FROM roles WHERE role IN ('train', 'val', 'test'))
SELECT split_seed, id, label, CASE WHEN pos < floor(0.7::DOUBLE * n) THEN 'train' WHEN pos < floor(0.85::DOUBLE * n) THEN 'val' ELSE 'test' END AS "partition" FROM s"""


@query
def hash_sample(spark, sf_dir):
    return splits.hash_sample(corpus(spark, sf_dir).select("id", "label"), "id", 200, 42, "R")


SQL["hash_sample"] = f"WITH {CORPUS_SQL} SELECT id, label, {sql_key('R', 'id')} AS h FROM corpus ORDER BY h, id LIMIT 200"


@query
def serpentine_blocks(spark, sf_dir):
    return splits.serpentine_blocks(roles(spark, sf_dir).where("role = 'train'"))


_SERPENTINE = """per AS (SELECT split_seed, author, label, count(*) AS n FROM roles WHERE role = 'train' GROUP BY ALL),
tops AS (SELECT split_seed, author, sum(n)::BIGINT AS posts, arg_max(label, (n, label)) AS dominant FROM per GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY split_seed, dominant ORDER BY posts DESC, author) - 1 AS k FROM tops),
blocks AS (SELECT split_seed, author, posts, dominant, ['A', 'B', 'C'][CASE WHEN (k // 3) % 2 = 0 THEN k % 3 ELSE 2 - k % 3 END + 1] AS block FROM rk)"""
SQL["serpentine_blocks"] = f"WITH {SPLIT_SQL}, {_SERPENTINE} SELECT * FROM blocks"


@query
def greedy_blocks(spark, sf_dir):
    return splits.greedy_blocks(roles(spark, sf_dir).where("role = 'train'"), PRIORITIES)


def _jurors(spark, sf_dir):
    t = roles_once(spark, sf_dir).where("role = 'train'")
    return splits.juror_training(t, splits.serpentine_blocks(t))


@query
def juror_training(spark, sf_dir):
    return _jurors(spark, sf_dir).groupBy("split_seed", "juror", "label").agg(F.count(F.lit(1)).alias("n"))


_JURORS = "jt AS (SELECT roles.split_seed, j.juror, id, label FROM roles JOIN blocks ON roles.split_seed = blocks.split_seed AND roles.author = blocks.author JOIN (VALUES ('J1', 'A'), ('J1', 'B'), ('J2', 'A'), ('J2', 'C'), ('J3', 'B'), ('J3', 'C')) j(juror, b) ON j.b = blocks.block WHERE role = 'train')"
SQL["juror_training"] = f"WITH {SPLIT_SQL}, {_SERPENTINE}, {_JURORS} SELECT split_seed, juror, label, count(*) AS n FROM jt GROUP BY ALL"


@query
def training_overlap(spark, sf_dir):
    return audit.pairwise_overlap(_jurors(spark, sf_dir).select("split_seed", F.col("juror").alias("set_name"), "id"), by=["split_seed"])


SQL["training_overlap"] = f"""WITH {SPLIT_SQL}, {_SERPENTINE}, {_JURORS}, n AS (SELECT split_seed, juror, count(*) AS n FROM jt GROUP BY ALL),
p AS (SELECT a.split_seed, a.juror AS a, b.juror AS b, count(*) AS n_both FROM jt a JOIN jt b ON a.split_seed = b.split_seed AND a.id = b.id AND a.juror < b.juror GROUP BY ALL)
SELECT p.split_seed, a, b, n_both, x.n AS n_a, y.n AS n_b, {r('n_both / least(x.n, y.n)')} AS overlap, {r('n_both / (x.n + y.n - n_both)')} AS jaccard
FROM p JOIN n x ON a = x.juror AND p.split_seed = x.split_seed JOIN n y ON b = y.juror AND p.split_seed = y.split_seed"""


@query
def share_drift(spark, sf_dir):
    t = roles_once(spark, sf_dir).where("role = 'train'")
    return splits.share_drift(t, splits.serpentine_blocks(t))


SQL["share_drift"] = f"""WITH {SPLIT_SQL}, {_SERPENTINE}, c AS (SELECT roles.split_seed, block, label, count(*) AS n FROM roles JOIN blocks ON roles.split_seed = blocks.split_seed AND roles.author = blocks.author WHERE role = 'train' GROUP BY ALL),
s AS (SELECT *, n / sum(n) OVER (PARTITION BY split_seed, block) AS share FROM c), d AS (SELECT split_seed, label, max(share) - min(share) AS d FROM s GROUP BY ALL)
SELECT split_seed, {r('max(d)')} AS max_share_drift FROM d GROUP BY split_seed"""


@query
def split_invariants(spark, sf_dir):
    return _split_invariants(stored(corpus(spark, sf_dir), "corpus"))


def _split_invariants(c):
    """c: the corpus, written once."""
    x = stored(splits.assign_roles(c, stored(splits.author_partitions(c), "partitions")), "roles")
    m = stored(splits.matched_substitution(x), "matches")
    blocks = stored(splits.serpentine_blocks(x.where("role = 'train'")), "blocks")
    return audit.split_checks(c, x, m, splits.overlap_training(x, m), splits.stratified_split(c), blocks)


_FREEZE_DIGEST = "c" * 64


def _freeze_documents(spark, sf_dir, c, cases: dict[str, str]):
    """Chains of a report, an amendment and a manifest about the corpus, one bundle for each case; a case names the document and the field that is wrong in it."""
    root = scratch(spark, "freeze")
    facts = c.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("n_examples"), F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("class_distribution"))
    facts = facts.crossJoin(F.broadcast(c.agg(F.count_distinct("author").alias("n_authors"))))
    content = F.sha2(F.to_json(F.struct("n_examples", "n_authors")), 256)
    facts = stored(facts.withColumn("content", content), "freeze-facts")

    def write(name: str, **fields) -> None:
        for bundle, wrong in cases.items():
            own = dict(fields)
            if wrong.startswith(f"{name}."):
                field = wrong.split(".", 1)[1]
                old = own[field]
                own[field] = F.lit(_FREEZE_DIGEST) if field.endswith("sha256") else F.lit("confirmatory") if field.endswith("status") else F.struct((F.col("n_examples") + 1).alias("n_examples"), "n_authors", "class_distribution") if field == "corpus" else old
            freeze.write_document(joined.where(F.col("bundle") == bundle).select(*(v.alias(k) for k, v in own.items())), root, bundle, name)

    def known() -> DataFrame:
        """A row for each bundle: the facts and the digests of the documents written so far."""
        rows = spark.createDataFrame([(b,) for b in cases], "bundle string").crossJoin(F.broadcast(facts))
        if not written:
            return stored(rows, "freeze-known")
        found = freeze.read_documents(spark, root).groupBy("bundle").pivot("name", written).agg(F.first("digest"))
        return stored(rows.join(found, "bundle"), "freeze-known")

    written: list[str] = []
    joined = known()
    decision = F.struct(F.lit(False).alias("h1_confirmatory_feasible"), F.lit(1).alias("exploratory_dose_k"), F.lit("accuracy").alias("h1_primary_metric"))
    write("section0", freeze_quality=F.lit(True), decision=decision, meta=F.struct(F.col("content").alias("corpus_content_sha256")))
    written.append("section0")
    joined = known()
    write("amendment", hypothesis=F.lit("H1"), from_status=F.lit("confirmatory"), to_status=F.lit("exploratory"), section0_report_sha256=F.col("section0"), corpus_content_sha256=F.col("content"), exploratory_dose_k=F.lit(1), h1_primary_metric=F.lit("accuracy"))
    written.append("amendment")
    joined = known()
    write("manifest", section0_report_sha256=F.col("section0"), h1_amendment_sha256=F.col("amendment"), corpus_content_sha256=F.col("content"), h1_status=F.lit("exploratory"), dose_k=F.lit(1), h1_primary_metric=F.lit("accuracy"), corpus=F.struct("n_examples", "n_authors", "class_distribution"))
    return freeze.read_documents(spark, root)


#: A bundle without a mistake, and one for each check with the field that is wrong.
FREEZE_CASES = {"sound": "", "P01": "manifest.section0_report_sha256", "P02": "manifest.h1_amendment_sha256", "P03": "amendment.section0_report_sha256", "P04": "manifest.h1_status", "P05": "amendment.corpus_content_sha256", "P06": "manifest.corpus"}


@query
def verifier(spark, sf_dir):
    """All 57 checks: six of the freeze chain and 17 of each split."""
    c = stored(corpus(spark, sf_dir), "corpus")
    chain = stored(freeze.freeze_checks(_freeze_documents(spark, sf_dir, c, {"sound": ""}), c), "chain")
    return chain.select(F.lit(None).cast("int").alias("split_seed"), "check_id", "passed").unionByName(_split_invariants(c).select("split_seed", F.format_string("S%02d", "check_id").alias("check_id"), "passed"))


@query
def freeze_chain(spark, sf_dir):
    """The six checks on seven chains, six of which have one mistake each."""
    c = stored(corpus(spark, sf_dir), "corpus")
    return freeze.freeze_checks(_freeze_documents(spark, sf_dir, c, FREEZE_CASES), c)


SQL["freeze_chain"] = f"SELECT bundle, check_id, bundle <> check_id AS passed FROM (SELECT unnest([{', '.join(map(repr, FREEZE_CASES))}]) AS bundle), (SELECT unnest([{', '.join(map(repr, freeze.CHECKS))}]) AS check_id) WHERE EXISTS (SELECT 1 FROM orders)"


@query
def digest_closure(spark, sf_dir):
    """What each document of the seven chains rests on: a citation with a wrong digest leads nowhere."""
    return freeze.closure(_freeze_documents(spark, sf_dir, stored(corpus(spark, sf_dir), "corpus"), FREEZE_CASES))


SQL["digest_closure"] = f"""WITH RECURSIVE e AS (SELECT bundle, f, t FROM (SELECT unnest([{', '.join(map(repr, FREEZE_CASES))}]) AS bundle), (VALUES ('amendment', 'section0', 'P03'), ('manifest', 'section0', 'P01'), ('manifest', 'amendment', 'P02')) x(f, t, broken) WHERE bundle <> broken AND EXISTS (SELECT 1 FROM orders)),
reach AS (SELECT bundle, f, t, 1 AS depth FROM e UNION ALL SELECT r.bundle, r.f, e.t, depth + 1 FROM reach r JOIN e ON r.bundle = e.bundle AND r.t = e.f)
SELECT bundle, f AS name, t AS rests_on, min(depth)::INT AS depth FROM reach GROUP BY ALL"""


#: What is wrong in the configuration of a nation, by its key modulo the number of mistakes; what then breaks.
CONFIG_MISTAKES = ["", "tokenization.padding", "optimization.optimizer", "checkpoint_rule.restore_best_before_test", "frozen", "class_weighting", "labels", "revision", "baseline", "no labels"]
CONFIG_LABELS = ["anger", "joy"]


def _configs(spark, sf_dir):
    """A configuration for each nation, in one folder of its own, most with one mistake."""
    kind = F.element_at(F.array(*map(F.lit, CONFIG_MISTAKES)), (F.col("n_nationkey") % len(CONFIG_MISTAKES) + 1).cast("int"))
    n = table(spark, sf_dir, "nation").withColumn("wrong", kind)
    say = lambda when, bad, good: F.when(F.col("wrong") == when, F.lit(bad)).otherwise(F.lit(good))
    digest = F.sha2("n_name", 256)
    fields = {
        "frozen": say("frozen", False, True), "class_weighting": say("class_weighting", "balanced", "none"),
        "models": F.create_map(F.lower("n_name"), F.struct(F.when(F.col("wrong") == "revision", F.lit("main")).otherwise(F.substring(digest, 1, 40)).alias("revision"))),
        "tokenization": F.struct(say("tokenization.padding", "longest", "max_length").alias("padding"), F.lit(True).alias("truncation")),
        "optimization": F.struct(say("optimization.optimizer", "SGD", "AdamW").alias("optimizer"), F.lit("linear_with_warmup").alias("scheduler"), F.lit("cross_entropy").alias("loss")),
        "checkpoint_rule": F.struct(F.lit("validation_macro_f1").alias("selection_metric"), F.lit("max").alias("selection_mode"), F.lit("epoch").alias("evaluate_every"), F.lit(True).alias("restore_best_before_test")),
        "model_seeds": F.array(F.lit(1), F.lit(2)), "labels": F.when(F.col("wrong") == "no labels", F.lit(None)).when(F.col("wrong") == "labels", F.array(*map(F.lit, CONFIG_LABELS[::-1]))).otherwise(F.array(*map(F.lit, CONFIG_LABELS))),
        "determinism": F.struct(F.lit(True).alias("seed_python_numpy_torch")),
        "data_provenance": F.struct(digest.alias("dataset_manifest_sha256"), digest.alias("corpus_content_sha256"), F.array(F.lit(42)).alias("split_seeds")),
        "h2_single_model_baseline": F.struct(F.lower("n_name").alias("model"), F.lit("r_clean").alias("regime"), say("baseline", 9, 1).alias("model_seed")),
    }
    text = F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
    text = F.when(F.col("wrong") == "checkpoint_rule.restore_best_before_test", F.replace(text, F.lit('"restore_best_before_test":true'), F.lit('"restore_best_before_test":"true"'))).otherwise(text)  # a string is no boolean
    root = scratch(spark, "configs")
    n.select(F.lit("nations").alias("bundle"), F.col("n_name").alias("name"), text.alias("value")).repartition("name").write.partitionBy("bundle", "name").text(root)
    docs = freeze.read_documents(spark, root)
    return docs.withColumns({"bundle": F.substring_index("bundle", "=", -1), "name": F.url_decode(F.substring_index("name", "=", -1))})


@query
def config_check(spark, sf_dir):
    return freeze.config_violations(_configs(spark, sf_dir), CONFIG_LABELS)


_CONFIG_RULES = [(1, "structure:tokenization.padding"), (2, "structure:optimization.optimizer"), (3, "structure:checkpoint_rule.restore_best_before_test"), (4, "frozen"), (5, "class_weighting"), (6, "labels"), (7, "revision"), (8, "baseline"), (9, "missing:labels"), (9, "labels")]
SQL["config_check"] = f"SELECT 'nations' AS bundle, n_name AS name, rule FROM nation JOIN (VALUES {', '.join(f'({k}, {v!r})' for k, v in _CONFIG_RULES)}) t(k, rule) ON n_nationkey % {len(CONFIG_MISTAKES)} = k"


@query
def config_binding(spark, sf_dir):
    """Configurations against a list of digests, in which one in four is another's and one nation has no document."""
    docs = stored(_configs(spark, sf_dir), "config-documents")
    key = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k"))
    listed = docs.join(key, "name").select("bundle", "name", F.when(F.col("k") % 4 == 1, F.lit("0" * 64)).otherwise(F.col("digest")).alias("expected"))
    return freeze.unbound(docs, listed.unionByName(spark.range(1).select(F.lit("nations").alias("bundle"), F.lit("ATLANTIS").alias("name"), F.lit("1" * 64).alias("expected"))))


SQL["config_binding"] = "SELECT 'nations' AS bundle, n_name AS name, 'digest differs' AS reason FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT 'nations', 'ATLANTIS', 'missing'"


_OWN = "split_seed = {seed}"  # filled in for each split: what does not depend on an outer row needs no correlated subquery
_SHARED = lambda a, b: f"(SELECT count(*) FROM (SELECT author FROM roles WHERE {_OWN} AND role = '{a}' INTERSECT SELECT author FROM roles WHERE {_OWN} AND role = '{b}')) = 0"
_INVARIANTS = [
    f"(SELECT count(*) = count(DISTINCT id) FROM roles WHERE {_OWN})",
    f"(SELECT max(n) = 1 FROM (SELECT count(*) AS n FROM roles WHERE {_OWN} GROUP BY id))",
    f"(SELECT count(DISTINCT id) FROM roles WHERE {_OWN}) = (SELECT count(*) FROM corpus)",
    _SHARED("train", "val"), _SHARED("train", "test"), _SHARED("val", "test"),
    f"(SELECT count(*) FROM (SELECT author FROM roles WHERE {_OWN} AND \"partition\" = 'test' GROUP BY author HAVING count(*) FILTER (WHERE role = 'test') <> 1)) = 0",
    f"(SELECT bool_and(link_id_valid OR NOT strict) FROM roles WHERE {_OWN} AND role = 'test')",
    f"(SELECT bool_and(role IS NOT DISTINCT FROM 'reserve') FROM injr WHERE {_OWN}) AND (SELECT bool_and(role IS NOT DISTINCT FROM 'train') AND count(*) = count(DISTINCT removed_id) FROM remr WHERE {_OWN})",
    f"(SELECT count(*) = count(DISTINCT id) AND count(*) FILTER (WHERE own = 'train') = (SELECT count(*) FROM roles WHERE {_OWN} AND role = 'train') - (SELECT count(*) FROM remr WHERE {_OWN}) AND count(*) FILTER (WHERE own = 'reserve') = (SELECT count(*) FROM injr WHERE {_OWN}) FROM ovr WHERE {_OWN}) AND (SELECT count(*) > 0 FROM remr WHERE {_OWN}) AND (SELECT count(*) > 0 FROM injr WHERE {_OWN})",
    f"(SELECT count(*) FROM ovr WHERE {_OWN}) = (SELECT count(*) FROM roles WHERE {_OWN} AND role = 'train')",
    f"(SELECT count(*) FROM (SELECT label, count(*) AS n FROM ovr WHERE {_OWN} GROUP BY label) x FULL JOIN (SELECT label, count(*) AS n FROM roles WHERE {_OWN} AND role = 'train' GROUP BY label) y ON x.label = y.label WHERE x.n IS DISTINCT FROM y.n) = 0",
    f"(SELECT count(*) > 0 AND max(n) = 1 AND min(n) = 1 AND count(*) = (SELECT count(*) FROM roles WHERE {_OWN} AND role = 'test' AND strict) FROM (SELECT author, count(*) AS n FROM injr WHERE {_OWN} GROUP BY author))",
    f"(SELECT bool_and(coalesce(injr.link_id <> t.link_id, false)) FROM injr LEFT JOIN (SELECT * FROM roles WHERE role = 'test') t ON injr.author = t.author AND injr.split_seed = t.split_seed WHERE injr.{_OWN})",
    f"(SELECT bool_and(level <> 'failed') FROM injr WHERE {_OWN})",
    f"(SELECT count(*) = count(DISTINCT id) FROM strat WHERE {_OWN})",
    f"(SELECT count(*) = count(DISTINCT author) FROM blocks WHERE {_OWN}) AND (SELECT count(*) FROM ((SELECT author FROM blocks WHERE {_OWN} EXCEPT SELECT author FROM roles WHERE {_OWN} AND role = 'train') UNION ALL (SELECT author FROM roles WHERE {_OWN} AND role = 'train' EXCEPT SELECT author FROM blocks WHERE {_OWN}))) = 0",
]
SQL["split_invariants"] = f"""WITH {SPLIT_SQL},\n{match_sql()}, {_SERPENTINE}, strat AS ({SQL['stratified_split']}),
injr AS (SELECT m.split_seed, m.injected_id, m.level, x.role, x.author, x.link_id FROM match m LEFT JOIN roles x ON x.split_seed = m.split_seed AND x.id = m.injected_id),
remr AS (SELECT m.split_seed, m.removed_id, x.role FROM match m LEFT JOIN roles x ON x.split_seed = m.split_seed AND x.id = m.removed_id WHERE m.removed_id IS NOT NULL),
ovr AS (SELECT x.split_seed, x.id, x.label, x.role AS own FROM roles x WHERE role = 'train' AND NOT EXISTS (SELECT 1 FROM match m WHERE m.split_seed = x.split_seed AND m.removed_id = x.id)
  UNION ALL SELECT m.split_seed, m.injected_id, x.label, x.role FROM match m LEFT JOIN roles x ON x.split_seed = m.split_seed AND x.id = m.injected_id),
{', '.join(f"v{i}_{seed} AS (SELECT {seed} AS split_seed, {i + 1} AS check_id, coalesce({e.replace('{seed}', str(seed))}, false) AS passed)" for seed in splits.SEEDS for i, e in enumerate(_INVARIANTS))}
SELECT split_seed::INT AS split_seed, check_id::INT AS check_id, [{', '.join(repr(x) for x in audit.CHECKS)}][check_id] AS name, passed FROM ({' UNION ALL '.join(f'SELECT * FROM v{i}_{seed}' for seed in splits.SEEDS for i in range(len(_INVARIANTS)))})"""


SQL["verifier"] = f"""SELECT NULL::INT AS split_seed, check_id, true AS passed FROM (SELECT unnest([{', '.join(map(repr, freeze.CHECKS))}]) AS check_id) UNION ALL SELECT split_seed, printf('S%02d', check_id), passed FROM ({SQL['split_invariants']})"""


# --- feasibility
@query
def dose_probe(spark, sf_dir):
    return feasibility.dose_probe(roles(spark, sf_dir))


_LEVEL_NAMES = [n for n, _ in splits.LEVELS]
_PROBE = f"""sizes AS (SELECT split_seed, count(*) FILTER (WHERE role = 'train') AS n_train, count(*) FILTER (WHERE role = 'test' AND strict) AS n_eligible FROM roles GROUP BY split_seed),
resv AS (SELECT split_seed, author, count(*) AS n FROM roles WHERE role = 'reserve' GROUP BY ALL),
{(',' + chr(10)).join(match_sql(k, f'_{k}') for k in feasibility.DOSES)},
every AS ({' UNION ALL '.join(f"SELECT split_seed, {k} AS dose, level FROM match_{k}" for k in feasibility.DOSES)}),
probe AS (SELECT s.split_seed, k.dose, any_value(n_train) AS n_train, any_value(n_eligible) AS n_eligible, count(level) AS n_injected, count(*) FILTER (WHERE level = 'failed') AS n_failed,
  100 * (SELECT count(*) FROM resv WHERE resv.split_seed = s.split_seed AND resv.n >= k.dose) / any_value(n_eligible) AS coverage_pct, 100 * count(level) / any_value(n_train) AS overlap_pct,
  {', '.join(f"CASE WHEN count(level) = 0 THEN 0 ELSE 100 * count(*) FILTER (WHERE level = '{n}') / count(level) END AS {n}_pct" for n in _LEVEL_NAMES)}
  FROM sizes s CROSS JOIN (SELECT unnest([1, 2, 3])::INT AS dose) k LEFT JOIN every e ON e.split_seed = s.split_seed AND e.dose = k.dose GROUP BY s.split_seed, k.dose)"""
SQL["dose_probe"] = f"WITH {SPLIT_SQL},\n{_PROBE} SELECT split_seed, dose, n_train, n_eligible, n_injected, n_failed, {', '.join(f'{r(c)} AS {c}' for c in ('coverage_pct', 'overlap_pct', *(f'{n}_pct' for n in _LEVEL_NAMES)))} FROM probe"


@query
def feasibility_decision(spark, sf_dir):
    x = roles_once(spark, sf_dir)
    return feasibility.decision(feasibility.dose_probe(x), feasibility.eligible_support(x, PRIORITIES))


SQL["feasibility_decision"] = f"""WITH {SPLIT_SQL},\n{_PROBE}, d AS (SELECT dose, bool_and(coverage_pct >= 99.9 AND n_failed = 0) AS covers, bool_and(coverage_pct >= 99.9 AND n_failed = 0 AND overlap_pct >= 5) AS ok, min(n_eligible) AS n FROM probe GROUP BY dose),
t AS (SELECT max(dose) FILTER (WHERE ok) AS dose, max(dose) FILTER (WHERE covers) AS exploratory_dose, min(n) AS min_eligible FROM d),
sup AS (SELECT s.split_seed, l.label, count(roles.id) AS n FROM sizes s CROSS JOIN (SELECT unnest([{', '.join(repr(x) for x in PRIORITIES)}]) AS label) l LEFT JOIN roles ON roles.split_seed = s.split_seed AND roles.label = l.label AND role = 'test' AND strict GROUP BY ALL)
SELECT dose, exploratory_dose, min_eligible, (SELECT min(n) FROM sup) AS min_support, dose IS NOT NULL AND min_eligible >= 1500 AS feasible, CASE WHEN dose IS NOT NULL AND min_eligible >= 1500 THEN 'confirmatory' ELSE 'requires_amendment' END AS status, CASE WHEN (SELECT min(n) FROM sup) >= 50 THEN 'macro_f1' ELSE 'accuracy' END AS metric FROM t"""


@query
def mde(spark, sf_dir):
    return feasibility.detectable_effect(feasibility.role_profile(roles(spark, sf_dir)).select("split_seed", "n_eligible_test"), "n_eligible_test")


SQL["mde"] = f"WITH {SPLIT_SQL}, {_PROFILE} SELECT split_seed, n_eligible_test, d.discordance, {r('100 * 2.8::DOUBLE * sqrt(d.discordance / n_eligible_test)')} AS mde_points FROM rp, (SELECT unnest([0.05, 0.1, 0.2, 0.5])::DOUBLE AS discordance) d"


@query
def structural_diagnosis(spark, sf_dir):
    x = roles_once(spark, sf_dir)
    return feasibility.structural_diagnosis(feasibility.role_profile(x), feasibility.dose_probe(x, (1,)), feasibility.activity_profile(corpus(spark, sf_dir)))


SQL["structural_diagnosis"] = f"""WITH {SPLIT_SQL},\n{_PROBE}, {_PROFILE}, act AS (SELECT author, count(*) AS n FROM corpus GROUP BY author)
SELECT {r('(SELECT min(100 * n_reserve / n) FROM rp)')} AS min_reserve_pct, {r('min(overlap_pct)')} AS max_overlap_pct, min(overlap_pct) >= 5 AS mechanism, {r('(SELECT sum(n) / count(*) FROM act)')} AS posts_per_author,
  {r('(SELECT 100 * count(*) FILTER (WHERE n >= 2) / count(*) FROM act)')} AS pct_authors_ge2, {r('(SELECT 100 * sum(CASE WHEN n >= 2 THEN n ELSE 0 END) / sum(n) FROM act)')} AS pct_posts_multi FROM probe WHERE dose = 1"""


# --- near copies
_NEAR = {"key": "vec_id", "vector": "embedding", "k": 10, "threshold": 0.40}


_KNN = """u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
nn AS (SELECT a.vec_id AS a, b.vec_id AS b, list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v)) / sqrt(list_dot_product(b.v, b.v)) AS sim FROM u a JOIN u b ON a.vec_id <> b.vec_id),
top AS (SELECT * FROM nn QUALIFY row_number() OVER (PARTITION BY a ORDER BY sim DESC, b) <= 9),
e AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(sim) AS sim FROM top WHERE sim > 0.40 GROUP BY 1, 2)"""


@query
def knn_edges(spark, sf_dir):
    return dedup.knn_edges(table(spark, sf_dir, "embeddings"), **_NEAR)


SQL["knn_edges"] = f"WITH {_KNN} SELECT a, b, {r('sim')} AS sim FROM e"


@query
def knn_pruning(spark, sf_dir):
    """What the index compares at the threshold of near copies, of all pairs of distinct vectors. (The number depends on the pivots: no SQL.)"""
    return neighbours.report(neighbours.build(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 10, rows=64), 0.85)


@query
def components(spark, sf_dir):
    return dedup.near_components(table(spark, sf_dir, "embeddings"), **_NEAR)


SQL["components"] = f"""WITH RECURSIVE {_KNN}, sym AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT reach.vec_id, sym.b FROM reach JOIN sym ON reach.other = sym.a)
SELECT vec_id, min(other) AS comp FROM reach GROUP BY vec_id"""


# --- provenance
@query
def id_set_hashes(spark, sf_dir):
    x = roles(spark, sf_dir)
    return hashing.id_set_hash(x, "id", "construction", ("split_seed", "role"))


SQL["id_set_hashes"] = f"WITH {SPLIT_SQL} SELECT split_seed, role, sha256(string_agg(id, ',' ORDER BY id)) AS set_sha256, count(*) AS n_ids FROM roles GROUP BY ALL"


@query
def stable_seeds(spark, sf_dir):
    return corpus(spark, sf_dir).select("author").distinct().select("author", hashing.stable_seed(F.col("author"), 7).alias("seed"))


SQL["stable_seeds"] = f"WITH {CORPUS_SQL} SELECT DISTINCT author, ({sql_int('sha256(author)')} + 7) % 4294967295 AS seed FROM corpus"


@query
def fingerprint(spark, sf_dir):
    return hashing.fingerprint(corpus(spark, sf_dir), "id", ["label", "author", "sub", "link_id"])


@query
def ordered_fingerprint(spark, sf_dir):
    return hashing.ordered_fingerprint(corpus(spark, sf_dir), "id", ["label", "author", "sub", "link_id"])


SQL["ordered_fingerprint"] = f"""WITH {CORPUS_SQL}, l AS (SELECT id, '"' || id || '","' || label || '","' || author || '","' || sub || '","' || link_id || '"' AS l FROM corpus)
SELECT sha256(string_agg(l, chr(10) ORDER BY id) || chr(10)) AS sha256, count(*) AS n_rows FROM l"""


# --- set relations, bindings, sources and sinks
@query
def set_relations(spark, sf_dir):
    x = roles_once(spark, sf_dir).where("split_seed = 42")
    own = lambda *r: x.where(F.col("role").isin(*r)).select("id")
    tag = lambda name, df: df.select(F.lit(name).alias("pair"), "*")
    disjoint = tag("train-test", audit.set_relations(own("train"), own("test")))
    subset = tag("test-all", audit.set_relations(own("test"), corpus(spark, sf_dir).select("id")))
    equal = tag("roles-all", audit.set_relations(x.select("id"), corpus(spark, sf_dir).select("id")))
    return disjoint.unionByName(subset).unionByName(equal)


_SETS = {"train-test": ("SELECT id FROM roles WHERE split_seed = 42 AND role = 'train'", "SELECT id FROM roles WHERE split_seed = 42 AND role = 'test'"), "test-all": ("SELECT id FROM roles WHERE split_seed = 42 AND role = 'test'", "SELECT id FROM corpus"), "roles-all": ("SELECT id FROM roles WHERE split_seed = 42", "SELECT id FROM corpus")}
SQL["set_relations"] = f"WITH {SPLIT_SQL} SELECT *, n_both = 0 AS disjoint, n_both = n_a AS subset, n_both = n_a AND n_a = n_b AS equal FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS pair, (SELECT count(DISTINCT id) FROM ({a})) AS n_a, (SELECT count(DISTINCT id) FROM ({b})) AS n_b, (SELECT count(*) FROM ({a} INTERSECT {b})) AS n_both" for k, (a, b) in _SETS.items()) + ")"


@query
def strict_lookup(spark, sf_dir):
    return audit.lookup(table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")


SQL["strict_lookup"] = "SELECT doc_id, lang FROM labels JOIN documents USING (doc_id) WHERE toxic = 1"


@query
def split_hash_mismatches(spark, sf_dir):
    h = hashing.id_set_hash(roles_once(spark, sf_dir), "id", "construction", ("split_seed", "role"))
    reported = h.where("role != 'reserve'").withColumn("set_sha256", F.when(F.col("role") == "val", F.lit("x")).otherwise(F.col("set_sha256")))
    return provenance.split_hash_mismatches(reported, h)


SQL["split_hash_mismatches"] = f"WITH {SPLIT_SQL} SELECT DISTINCT split_seed, role FROM roles WHERE role IN ('reserve', 'val')"


@query
def evaluation_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("text")
    pool = provenance.evaluation_pool({"documents": d, "benchmark": table(spark, sf_dir, "benchmark").select("text")})
    return pool.groupBy("set_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


SQL["evaluation_pool"] = "SELECT 'documents' AS set_name, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT FROM benchmark"


@query
def inconsistent_metrics(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias("run_id"), (F.col("n_nationkey") / 7).alias("m"))
    chosen = n.where("m != 0").withColumn("m", F.when(F.col("run_id") < "C", F.col("m") + 1e-6).otherwise(F.col("m") + 1e-14))
    return provenance.inconsistent_metrics(n, chosen, "m").select("run_id")


SQL["inconsistent_metrics"] = "SELECT n_name AS run_id FROM nation WHERE n_name < 'C' OR n_nationkey = 0"


@query
def csv_source(spark, sf_dir):
    """Two CSV files in a given order, written and read back."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("int").alias("k"), F.col("n_name").alias("name"))
    paths = [scratch(spark, "csv"), scratch(spark, "csv")]
    n.where("k < 10").write.option("header", True).csv(paths[0])
    write_csv(n.where("k >= 10"), paths[1])
    return read_csvs(spark, paths, struct("k int, name string")).select("k", "name", "_src")


SQL["csv_source"] = "SELECT n_nationkey::INT AS k, n_name AS name, (n_nationkey >= 10)::INT AS _src FROM nation"


@query
def json_lines_source(spark, sf_dir):
    table(spark, sf_dir, "conversations").select("conv_id", "role", "text").write.json(path := scratch(spark, "jsonl"))
    return read_json_lines(spark, path, table(spark, sf_dir, "conversations").select("conv_id", "role", "text").schema)


SQL["json_lines_source"] = "SELECT conv_id, role, text FROM conversations"


@query
def id_list_source(spark, sf_dir):
    table(spark, sf_dir, "customer").select(F.concat(F.lit(" "), F.col("c_custkey").cast("string"), F.lit(" ")).alias("v")).write.text(path := scratch(spark, "ids"))
    return read_ids(spark, path).select("id")


SQL["id_list_source"] = "SELECT c_custkey::VARCHAR AS id FROM customer"


@query
def replaced_directory(spark, sf_dir):
    """A sink that is written twice, the second time whole over the first."""
    path = scratch(spark, "sink")
    replace_directory(table(spark, sf_dir, "region"), path)
    replace_directory(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), path)
    return spark.read.parquet(path)


SQL["replaced_directory"] = "SELECT n_nationkey, n_name FROM nation"
