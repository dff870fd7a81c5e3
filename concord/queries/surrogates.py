"""Stand-ins for the engine's relations over the test tables, as frames and as SQL (common table expressions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..functions.hashing import uniform_int
from ..functions.stats import argmax, dot, softmax
from ..operators import labels, splits

CATEGORIES = ["click", "error", "purchase", "signup", "view"]
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
#: Classes; replicates of the resampling queries.
K, REPS = 10, 10_000
JUROR_BLOCKS = {"J1": (0, 1), "J2": (0, 2), "J3": (1, 2)}
JURORS = list(JUROR_BLOCKS)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to 10 decimals: the order of a sum differs between engines."""
    return df.select(*((F.round(F.col(c), 10) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def r(expr: str) -> str:
    return f"(round(({expr})::DOUBLE, 10) + 0.0::DOUBLE)"


def sql_key(namespace: str, *key: str, seed: str = "42") -> str:
    return f"sha256(concat_ws('|', {seed if not seed.isdigit() else repr(seed)}, '{namespace}', {', '.join(key)}))"


def sql_int(digest: str) -> str:
    return f"('0x' || substr({digest}, 1, 8))::BIGINT"


# raters: an item is ten minutes of events, a rater a user, a category an event type
def rater_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.substring(F.date_format("ts", "yyyy-MM-dd HH:mm"), 1, 15).alias("item"), F.col("user_id").alias("rater"), F.col("event_type").alias("category"))
    return labels.rater_rows(e, "item", "rater", "category", CATEGORIES)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.votes(rater_rows(spark, sf_dir), "item", CATEGORIES)


_REACHED = "list_filter(['click', 'error', 'purchase', 'signup', 'view'], lambda c, i: [click, error, purchase, signup, \"view\"][i] {cond})"
RATERS_SQL = f"""rr AS (SELECT substr(strftime(ts, '%Y-%m-%d %H:%M'), 1, 15) AS item, user_id AS rater,
  {', '.join(f"max((event_type = '{c}')::INT) AS \"{c}\"" for c in CATEGORIES)} FROM events GROUP BY ALL),
vv AS (SELECT item, {', '.join(f'sum("{c}")::BIGINT AS "{c}"' for c in CATEGORIES)}, count(*) AS n_raters FROM rr GROUP BY item),
votes AS (SELECT *, len(hit)::INT AS n_reached, CASE len(hit) WHEN 1 THEN 'single' WHEN 0 THEN 'none' ELSE 'multi' END AS outcome,
  CASE len(hit) WHEN 1 THEN hit[1] END AS label, greatest({', '.join(f'"{c}"' for c in CATEGORIES)}) AS top_votes
  FROM (SELECT *, {_REACHED.format(cond='>= 2')} AS hit FROM vv))"""


# corpus: a post is an order, its author the customer, its thread the quarter
def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    author = F.when(F.col("o_custkey") % 101 == 0, "[deleted]").otherwise(F.concat(F.lit("c"), F.col("o_custkey").cast("string")))
    thread = F.when(F.col("o_orderkey") % 17 == 0, "nan").otherwise(F.concat(F.year("o_orderdate").cast("string"), F.lit("q"), F.quarter("o_orderdate").cast("string")))
    c = o.select(F.col("o_orderkey").cast("string").alias("id"), author.alias("author"), thread.alias("link_id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("sub"), F.floor(F.col("o_totalprice") / 1000).alias("n_tokens"))
    c = text.clean_authors(c)
    c = text.quartile_bucket(c, "n_tokens").withColumn("link_id_valid", text.thread_valid(F.col("link_id")))
    per = c.groupBy("author").agg(F.count(F.lit(1)).alias("author_n_posts"))
    return c.join(per, "author").withColumn("ppa_bucket", text.activity_bucket(F.col("author_n_posts")))


CORPUS_SQL = """c0 AS (SELECT o_orderkey::VARCHAR AS id, CASE WHEN o_custkey % 101 = 0 THEN '[deleted]' ELSE 'c' || o_custkey END AS author,
  CASE WHEN o_orderkey % 17 = 0 THEN 'nan' ELSE year(o_orderdate) || 'q' || quarter(o_orderdate) END AS link_id, o_orderpriority AS label,
  o_orderstatus AS sub, floor(o_totalprice / 1000)::BIGINT AS n_tokens FROM orders),
c1 AS (SELECT *, link_id <> 'nan' AS link_id_valid FROM c0 WHERE author <> '[deleted]'),
edges AS (SELECT list_distinct(quantile_cont(n_tokens, [0.0, 0.25, 0.5, 0.75, 1.0])) AS e FROM c1),
corpus AS (SELECT c1.*, greatest(len(list_filter(e, lambda x: x < n_tokens)) - 1, 0)::INT AS len_bucket, count(*) OVER (PARTITION BY author) AS author_n_posts,
  CASE WHEN count(*) OVER (PARTITION BY author) <= 1 THEN '1' WHEN count(*) OVER (PARTITION BY author) <= 2 THEN '2' WHEN count(*) OVER (PARTITION BY author) <= 4 THEN '3-4'
  WHEN count(*) OVER (PARTITION BY author) <= 9 THEN '5-9' ELSE '10+' END AS ppa_bucket FROM c1, edges)"""

ELIGIBLE_SQL = """elig AS (SELECT author, n_posts, n_valid, n_threads, n_posts >= 2 AS loose, n_valid >= 2 AND n_threads >= 2 AS strict FROM
  (SELECT author, count(*) AS n_posts, count(*) FILTER (WHERE link_id_valid) AS n_valid, count(DISTINCT link_id) FILTER (WHERE link_id_valid) AS n_threads FROM corpus GROUP BY author))"""

PARTITIONS_SQL = f"""a0 AS (SELECT split_seed, author, n_posts, strict, {sql_key('permute', 'author', seed='split_seed')} AS h FROM elig, (SELECT unnest([42, 123, 2024])::INT AS split_seed)),
a1 AS (SELECT *, sum(n_posts) OVER w AS run_posts, row_number() OVER w AS run_rank, sum(n_posts) OVER (PARTITION BY split_seed) AS all_posts FROM a0 WINDOW w AS (PARTITION BY split_seed ORDER BY h, author)),
stop AS (SELECT split_seed, min(run_rank) AS stop FROM a1 WHERE run_rank / ((all_posts - run_posts) + run_rank) >= 0.15::DOUBLE GROUP BY split_seed),
drained AS (SELECT a1.split_seed, stop, run_posts AS drained, all_posts - run_posts + run_rank AS analysis FROM a1 JOIN stop ON a1.split_seed = stop.split_seed AND run_rank = stop),
parts AS (SELECT a1.split_seed, author, n_posts, strict, CASE WHEN run_rank <= stop THEN 'test' WHEN run_posts - drained - n_posts < 0.15::DOUBLE * analysis THEN 'val' ELSE 'train' END AS "partition"
  FROM a1 JOIN drained ON a1.split_seed = drained.split_seed)"""

ROLES_SQL = f"""t0 AS (SELECT split_seed, parts.author, strict, id, CASE WHEN link_id_valid THEN link_id END AS thread, {sql_key('post', 'id', seed='split_seed')} AS hp
  FROM corpus JOIN parts ON corpus.author = parts.author WHERE "partition" = 'test'),
t1 AS (SELECT split_seed, author, strict, thread, min({{'hp': hp, 'id': id}}) AS p, {sql_key('thread', 'author', "coalesce(thread, '')", seed='split_seed')} AS ht FROM t0 GROUP BY ALL),
pick AS (SELECT split_seed, author, bool_or(strict) AS s, min({{'ht': ht, 'thread': thread, 'id': p.id}}) FILTER (WHERE thread IS NOT NULL) AS e, min(p) AS i FROM t1 GROUP BY ALL),
target AS (SELECT split_seed, author, CASE WHEN s THEN e.id ELSE i.id END AS target_id, CASE WHEN s THEN e.thread END AS target_thread FROM pick),
roles AS (SELECT corpus.*, parts.split_seed, "partition", strict, CASE WHEN "partition" <> 'test' THEN "partition" WHEN id = target_id THEN 'test'
  WHEN strict AND link_id_valid AND link_id <> target_thread THEN 'reserve' ELSE 'excluded' END AS role
  FROM corpus JOIN parts ON corpus.author = parts.author LEFT JOIN target ON target.split_seed = parts.split_seed AND target.author = corpus.author)"""


def roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = corpus(spark, sf_dir)
    return splits.assign_roles(c, splits.author_partitions(c))


def match_sql(dose: int = 1, tag: str = "") -> str:
    """Relation match<tag>: split_seed, injected_id, removed_id, level."""
    cols = "split_seed, label, sub, len_bucket, ppa_bucket"
    out = [
        f"inj{tag} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split_seed, author ORDER BY {sql_key('dose', 'id', seed='split_seed')}, id) AS r, count(*) OVER (PARTITION BY split_seed, author) AS n FROM roles WHERE role = 'reserve' AND strict) WHERE r <= {dose} AND n >= {dose})",
        f"b0{tag} AS (SELECT *, {sql_key('match', 'id', seed='split_seed')} AS h, NULL::VARCHAR AS level, NULL::BIGINT AS rank FROM (SELECT id, {cols}, 1 AS side FROM inj{tag} UNION ALL SELECT id, {cols}, 0 FROM roles WHERE role = 'train'))",
    ]
    for k, (name, keys) in enumerate(splits.LEVELS):
        by = ", ".join(("split_seed", *keys))
        out.append(
            f"b{k + 1}{tag} AS (SELECT id, {cols}, side, h, CASE WHEN level IS NULL AND own <= lo THEN '{name}' ELSE level END AS level, CASE WHEN level IS NULL AND own <= lo THEN own ELSE rank END AS rank FROM "
            f"(SELECT *, sum((level IS NULL)::INT) OVER (PARTITION BY {by}, side ORDER BY h, id ROWS UNBOUNDED PRECEDING)::BIGINT AS own, least(coalesce(sum((level IS NULL)::INT) FILTER (WHERE side = 1) OVER (PARTITION BY {by}), 0), coalesce(sum((level IS NULL)::INT) FILTER (WHERE side = 0) OVER (PARTITION BY {by}), 0)) AS lo FROM b{k}{tag}))"
        )
    key = "concat_ws('|', level, " + ", ".join(f"CASE WHEN level IN ({', '.join(repr(n) for n, cs in splits.LEVELS if c in cs)}) THEN {c}::VARCHAR ELSE '' END" for c in ("label", "sub", "len_bucket", "ppa_bucket")) + ")"
    out.append(f"keyed{tag} AS (SELECT *, {key} AS k FROM b4{tag} WHERE level IS NOT NULL OR side = 1)")
    out.append(f"match{tag} AS (SELECT a.split_seed, a.id AS injected_id, b.id AS removed_id, coalesce(a.level, 'failed') AS level FROM (SELECT * FROM keyed{tag} WHERE side = 1) a LEFT JOIN (SELECT * FROM keyed{tag} WHERE side = 0) b ON a.split_seed = b.split_seed AND a.k = b.k AND a.rank = b.rank)")
    return ",\n".join(out)


SPLIT_SQL = f"{CORPUS_SQL},\n{ELIGIBLE_SQL},\n{PARTITIONS_SQL},\n{ROLES_SQL}"


# predictions: three nearest-centroid jurors over the vectors; two of three training blocks each
def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id").cast("string")
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("label").alias("true_label"), "embedding", uniform_int(10, 42, "part", key).alias("part"), uniform_int(3, 42, "block", key).alias("block"))
    jurors = F.array(*(F.when(F.col("block").isin(*b), F.lit(j)) for j, b in JUROR_BLOCKS.items()))
    train = e.where("part < 6").select("true_label", F.posexplode("embedding").alias("d", "x"), F.array_compact(jurors).alias("js")).select("true_label", "d", "x", F.explode("js").alias("juror"))
    mean = train.groupBy("juror", "true_label", "d").agg(F.avg(F.col("x").cast("double")).alias("m"))
    one = mean.groupBy("juror", "true_label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v"))
    model = one.groupBy("juror").agg(F.array_sort(F.collect_list(F.struct("true_label", F.col("v.m").alias("v")))).alias("c"))  # a row for each juror
    scored = e.where("part >= 6").crossJoin(F.broadcast(model))
    scored = scored.withColumn("scores", F.transform("c", lambda c: 4.0 * dot(F.col("embedding"), c["v"])))  # a column of its own is computed once
    probs = F.explode(F.array(softmax(F.col("scores"))))  # one row each; filters on what a generator makes are not moved below it, where they would compute it again
    out = scored.select("juror", "example_id", "true_label", F.when(F.col("part") < 8, "val").otherwise("test").alias("part"), probs.alias("probs"))
    return out.withColumn("pred_label", argmax(F.col("probs")))


PRED_SQL = f"""emb AS (SELECT vec_id AS example_id, label AS true_label, embedding, {sql_int(sql_key('part', 'vec_id'))} % 10 AS part, {sql_int(sql_key('block', 'vec_id'))} % 3 AS block FROM embeddings),
jb AS (SELECT * FROM (VALUES {', '.join(f"('{j}', {b})" for j, bs in JUROR_BLOCKS.items() for b in bs)}) t(juror, block)),
dims AS (SELECT juror, true_label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM emb JOIN jb ON emb.block = jb.block WHERE part < 6),
cent AS (SELECT juror, true_label AS c, d, avg(x) AS m FROM dims GROUP BY ALL),
test_dims AS (SELECT example_id, true_label, CASE WHEN part < 8 THEN 'val' ELSE 'test' END AS part, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM emb WHERE part >= 6),
dots AS (SELECT juror, example_id, true_label, part, c, 4.0::DOUBLE * sum(x * m) AS s FROM test_dims JOIN cent ON test_dims.d = cent.d GROUP BY ALL),
soft AS (SELECT juror, example_id, true_label, part, c, exp(s - max(s) OVER (PARTITION BY juror, example_id)) AS e FROM dots),
long AS (SELECT juror, example_id, true_label, part, c, e / sum(e) OVER (PARTITION BY juror, example_id) AS p FROM soft),
preds AS (SELECT juror, example_id, true_label, part, arg_max(c, (p, -c)) AS pred_label FROM long GROUP BY ALL)"""


ALL_THREE = (0, 1, 2)
#: Ensembles of three jurors. Of each: the share of its training rows that two jurors have in common, and each juror's blocks and the
#: features that it sees (their places modulo 3).
LADDER = {
    "same_rows": (1.0, [(ALL_THREE, (0, 1)), (ALL_THREE, (0, 2)), (ALL_THREE, (1, 2))]),
    "two_blocks": (0.5, [((0, 1), ALL_THREE), ((0, 2), ALL_THREE), ((1, 2), ALL_THREE)]),
    "own_block": (0.0, [((0,), ALL_THREE), ((1,), ALL_THREE), ((2,), ALL_THREE)]),
    "own_features": (1.0, [(ALL_THREE, (0,)), (ALL_THREE, (1,)), (ALL_THREE, (2,))]),
}


def ladder_predictions(spark: SparkSession, sf_dir: str, configs: tuple[str, ...] = tuple(LADDER), least: int = 8) -> DataFrame:
    """Predictions of the jurors of the ladder on each split for parts from `least` on (6 and 7: validation, 8 and 9: test): split_seed, config,
    part, juror, and those of a prediction row."""
    ints = lambda xs: F.array(*map(F.lit, xs))
    jurors = F.array(*(F.struct(F.lit(c).alias("config"), F.lit(j).alias("juror"), ints(b).alias("blocks"), ints(x).alias("places")) for c, (_, of) in LADDER.items() if c in configs for j, (b, x) in zip(JURORS, of, strict=True)))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("example_id"), F.col("label").alias("true_label"), "embedding", F.explode(ints(splits.SEEDS)).alias("split_seed"))
    draw = lambda n, ns: uniform_int(n, F.col("split_seed"), ns, F.col("example_id").cast("string")).cast("int")
    e = e.withColumns({"part": draw(10, "part"), "block": draw(3, "block")})
    train = e.where("part < 6").select("split_seed", "block", "true_label", F.posexplode("embedding").alias("d", "x"))
    sums = train.groupBy("split_seed", "block", "true_label", "d").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    own = sums.select("split_seed", "true_label", "d", "s", "n", F.inline(F.filter(jurors, lambda j: F.array_contains(j["blocks"], F.col("block")))))
    seen = F.when(F.array_contains("places", F.col("d") % 3), F.col("s")).otherwise(0.0)
    mean = own.groupBy("split_seed", "config", "juror", "true_label", "d").agg((F.sum(seen) / F.sum("n")).alias("m"))
    one = mean.groupBy("split_seed", "config", "juror", "true_label").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("v"))
    model = one.groupBy("split_seed", "config", "juror").agg(F.array_sort(F.collect_list(F.struct("true_label", F.col("v.m").alias("v")))).alias("c"))
    scored = e.where(F.col("part") >= least).join(F.broadcast(model), "split_seed")  # a row for each split and juror
    scored = scored.withColumn("scores", F.transform("c", lambda c: 4.0 * dot(F.col("embedding"), c["v"])))
    probs = F.explode(F.array(softmax(F.col("scores"))))
    return scored.select("split_seed", "config", "part", "juror", "example_id", "true_label", probs.alias("probs")).withColumn("pred_label", argmax(F.col("probs")))


def ladder_sql(configs: tuple[str, ...] = tuple(LADDER), least: int = 8) -> str:
    return f"""lj AS (SELECT * FROM (VALUES {', '.join(f"('{c}', '{j}', {list(b)}, {list(x)})" for c, (_, of) in LADDER.items() if c in configs for j, (b, x) in zip(JURORS, of, strict=True))}) t(config, juror, blocks, places)),
le AS (SELECT split_seed, vec_id AS example_id, label AS true_label, embedding, {sql_int(sql_key('part', 'vec_id', seed='split_seed'))} % 10 AS part, {sql_int(sql_key('block', 'vec_id', seed='split_seed'))} % 3 AS block FROM embeddings, (SELECT unnest({list(splits.SEEDS)})::INT AS split_seed)),
lx AS (SELECT split_seed, example_id, true_label, part, block, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS d FROM le),
lm AS (SELECT split_seed, config, juror, true_label AS c, d, avg(CASE WHEN list_contains(places, d % 3) THEN x ELSE 0 END) AS m FROM lx JOIN lj ON list_contains(blocks, block) WHERE part < 6 GROUP BY ALL),
ls AS (SELECT lx.split_seed, config, part, juror, example_id, true_label, c, 4.0::DOUBLE * sum(x * m) AS s FROM lx JOIN lm ON lx.split_seed = lm.split_seed AND lx.d = lm.d WHERE part >= {least} GROUP BY ALL),
lf AS (SELECT *, exp(s - max(s) OVER (PARTITION BY split_seed, config, juror, example_id)) AS e FROM ls),
lp AS (SELECT *, e / sum(e) OVER (PARTITION BY split_seed, config, juror, example_id) AS p FROM lf),
lone AS (SELECT split_seed, config, part, juror, example_id, true_label, arg_max(c, (p, -c)) AS pred_label FROM lp GROUP BY ALL),
lvote AS (SELECT split_seed, config, example_id, true_label, arg_max(c, (p, -c)) AS pred_label FROM (SELECT split_seed, config, example_id, true_label, c, avg(p) AS p FROM lp GROUP BY ALL) GROUP BY ALL),
lwide AS (SELECT t.split_seed, t.config, t.example_id, {', '.join(f"max((t.true_label = t.pred_label)::INT) FILTER (WHERE juror = '{j}') AS {j}" for j in JURORS)}, max((v.true_label = v.pred_label)::INT) AS e
  FROM lone t JOIN lvote v ON t.split_seed = v.split_seed AND t.config = v.config AND t.example_id = v.example_id GROUP BY ALL)"""


LADDER_SQL = ladder_sql()


def class_sql(rows: str, by: list[str], name: str = "cc", y: str = "true_label", p: str = "pred_label", k: int = K) -> str:
    """Relation <name>: by, label, tp, predicted, support, precision, recall, f1."""
    b = "".join(f"{c}, " for c in by)
    return f"""{name}0 AS (SELECT {b}l.label, count(*) FILTER (WHERE {y} = l.label AND {p} = l.label) AS tp, count(*) FILTER (WHERE {p} = l.label) AS predicted, count(*) FILTER (WHERE {y} = l.label) AS support
  FROM {rows}, (SELECT unnest(range({k}))::INT AS label) l GROUP BY ALL),
{name} AS (SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall, CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1 FROM {name}0)"""


def bundle_select(name: str, by: list[str]) -> str:
    b = "".join(f"{c}, " for c in by)
    t = "sum(support)"
    return f"""SELECT {b}{t}::BIGINT AS n, {r(f'sum(tp) / {t}')} AS accuracy, {r('avg(f1)')} AS macro_f1, {r(f'sum(f1 * support) / {t}')} AS weighted_f1, {r('avg(recall)')} AS balanced_accuracy,
  {r(f"coalesce(({t} * sum(tp) - sum(support * predicted)) / nullif(sqrt(({t}::DOUBLE * {t} - sum(predicted * predicted)) * ({t}::DOUBLE * {t} - sum(support * support))), 0), 0)")} AS mcc,
  {r(f"coalesce((sum(tp) / {t} - sum(support * predicted) / ({t}::DOUBLE * {t})) / nullif(1 - sum(support * predicted) / ({t}::DOUBLE * {t}), 0), 0)")} AS kappa FROM {name} {'GROUP BY ' + ', '.join(by) if by else ''}"""


WEIGHTS_SQL = f"""val AS (SELECT * FROM preds WHERE part = 'val'),
{class_sql('val', ['juror'], 'vc')},
vs AS (SELECT juror, avg(f1) AS macro_f1 FROM vc GROUP BY juror),
w AS (SELECT juror, exp(macro_f1 - max(macro_f1) OVER ()) / sum(exp(macro_f1)) OVER () * exp(max(macro_f1) OVER ()) AS weight FROM vs)"""

ENSEMBLE_SQL = f"""{PRED_SQL},
{WEIGHTS_SQL},
test AS (SELECT * FROM preds WHERE part = 'test'),
tl AS (SELECT * FROM long WHERE part = 'test'),
eq AS (SELECT example_id, true_label, c, avg(p) AS p FROM tl GROUP BY ALL),
we AS (SELECT example_id, true_label, c, sum(weight * p) / sum(weight) AS p FROM tl JOIN w ON tl.juror = w.juror GROUP BY ALL),
soft_eq AS (SELECT example_id, true_label, arg_max(c, (p, -c)) AS pred_label FROM eq GROUP BY ALL),
soft_we AS (SELECT example_id, true_label, arg_max(c, (p, -c)) AS pred_label FROM we GROUP BY ALL),
vn AS (SELECT example_id, true_label, pred_label AS c, count(*) AS n FROM test GROUP BY ALL),
pairs AS (SELECT soft_eq.example_id, soft_eq.true_label, soft_eq.pred_label AS pred_a, test.pred_label AS pred_b FROM soft_eq JOIN test ON soft_eq.example_id = test.example_id WHERE juror = 'J1')"""
