"""Queries on digests of tables, versions of several tables, verified files, and the remaining sources, sinks and cleaning steps."""

from __future__ import annotations

from contextlib import suppress
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import bitmaps, dedup, labels, merkle, quantiles
from ..plans import provenance
from ..schemas import struct
from ..sources import tables, verified, versions
from ..sources.tables import scratch, stored
from .corpus import _JURORS, _SERPENTINE, _jurors, norm_sql
from .surrogates import CORPUS_SQL, RATERS_SQL, SPLIT_SQL, corpus, r, rater_rows, roles, table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# --- digests
DEPTH = 2


def _role_tree(x: DataFrame):
    return merkle.build(x.select("split_seed", "role", "id", "label"), "id", ["id", "label"], ["split_seed", "role"], DEPTH)


@query
def merkle_roots(spark, sf_dir):
    """The digest of each role of each split."""
    return _role_tree(roles(spark, sf_dir)).roots()


def _merkle_sql(rows: str, by: list[str], depth: int) -> str:
    """rows: a query with by and the digest d of each row."""
    b = "".join(f"{c}, " for c in by)
    out = [f"mr AS (SELECT {b}d, count(*) AS n FROM ({rows}) GROUP BY ALL)", f"m{depth} AS (SELECT {b}substr(d, 1, {depth}) AS p, sha256(string_agg(d || ':' || n, ',' ORDER BY d)) AS h, sum(n)::BIGINT AS n FROM mr GROUP BY ALL)"]
    out += [f"m{k} AS (SELECT {b}substr(p, 1, {k}) AS p, sha256(string_agg(right(q, 1) || ':' || h, ',' ORDER BY q)) AS h, sum(n)::BIGINT AS n FROM (SELECT {b}p, p AS q, h, n FROM m{k + 1}) GROUP BY ALL)" for k in range(depth - 1, -1, -1)]
    return ", ".join(out)


_ROW = "sha256(concat_ws(',', strlen(id) || ':' || id, strlen(label) || ':' || label))"
SQL["merkle_roots"] = f"WITH {SPLIT_SQL}, {_merkle_sql(f'SELECT split_seed, role, {_ROW} AS d FROM roles', ['split_seed', 'role'], DEPTH)} SELECT split_seed, role, h AS sha256, n AS n_rows FROM m0"


@query
def merkle_differences(spark, sf_dir):
    """Where reported splits differ from rebuilt ones: the report has another label for one id in a thousand, about, of the first split."""
    x = stored(roles(spark, sf_dir).select("split_seed", "role", "id", "label"), "roles")
    wrong = (F.col("split_seed") == 42) & (F.substring(F.sha2("id", 256), 1, 3) < "004")
    reported = x.withColumn("label", F.when(wrong, F.lit("none")).otherwise(F.col("label")))
    return merkle.differences(_role_tree(x), _role_tree(reported))


SQL["merkle_differences"] = f"WITH {SPLIT_SQL} SELECT split_seed, role, id AS key, side, 1::BIGINT AS n FROM roles, (VALUES ('a'), ('b')) s(side) WHERE split_seed = 42 AND substr(sha256(id), 1, 3) < '004'"


# --- quantiles
QUARTILES = [0.0, 0.25, 0.5, 0.75, 1.0]


@query
def exact_quantiles(spark, sf_dir):
    """Quartiles of prices and the ends of their middle 95 %, by status, without holding the prices."""
    return quantiles.quantiles(table(spark, sf_dir, "orders"), "o_totalprice", [*QUARTILES, 0.025, 0.975], ["o_orderstatus"])


SQL["exact_quantiles"] = f"SELECT o_orderstatus, a AS at, {r('quantile')} AS quantile FROM (SELECT o_orderstatus, {[*QUARTILES, 0.025, 0.975]}::DOUBLE[] AS ats, quantile_cont(o_totalprice::DOUBLE, {[*QUARTILES, 0.025, 0.975]}) AS qs FROM orders GROUP BY 1), LATERAL (SELECT unnest(ats) AS a, unnest(qs) AS quantile)"


# --- versions
@query
def versioned_tables(spark, sf_dir):
    """Three tables committed together; a second commit is cut off in its last table, a third replaces one: readers never see a part of the second."""
    root = scratch(spark, "versions")
    names = ("nation", "supplier", "customer")
    own = {n: table(spark, sf_dir, n) for n in names}
    versions.commit(spark, root, own)

    def cut_off(df: DataFrame, path: str) -> None:
        if path.endswith("/customer"):
            raise OSError("cut off")
        df.write.parquet(path)

    with suppress(OSError):
        versions.commit(spark, root, {n: own[n].where("false") for n in names}, write=cut_off)
    first, _ = versions.current(spark, root)
    versions.commit(spark, root, {"nation": own["nation"].where("n_regionkey = 1")}, expected=first)
    count = lambda n, v: versions.read(spark, root, n, v, verify=True).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), F.lit(v).alias("version"), "n")
    return reduce(DataFrame.unionByName, (count(n, v) for v in versions.versions(spark, root) for n in names))


SQL["versioned_tables"] = "SELECT name, version::INT AS version, n FROM (SELECT 'nation' AS name, 1 AS version, count(*) AS n FROM nation UNION ALL SELECT 'nation', 2, count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'supplier', v, count(*) FROM supplier, (VALUES (1), (2)) t(v) GROUP BY v UNION ALL SELECT 'customer', v, count(*) FROM customer, (VALUES (1), (2)) t(v) GROUP BY v)"


# --- verified files
def _customer_files(spark, sf_dir):
    """Customers as one CSV file for each nation (Spark's writer names them), and a manifest of them in the order of nations."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("bigint").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("int").alias("nation"))
    c.withColumn("part", F.col("nation")).repartition("part").sortWithinPartitions("k").write.partitionBy("part").option("header", True).csv(root := scratch(spark, "customers"))
    found = tables.file_digests(spark, root).where("path RLIKE '[.]csv$'").withColumn("part", F.regexp_extract("path", "part=([0-9]+)", 1).cast("int"))
    return root, stored(found, "customer-files")


@query
def verified_source(spark, sf_dir):
    root, found = _customer_files(spark, sf_dir)
    got = verified.read_csv(spark, found.select(F.col("part").alias("src"), "digest", "path"), root, struct("k bigint, name string, nation int"))
    return got.select("k", "name", "nation", "_src", "_pos")


SQL["verified_source"] = "SELECT c_custkey AS k, c_name AS name, c_nationkey::INT AS nation, c_nationkey::INT AS _src, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS _pos FROM customer"


@query
def manifest_check(spark, sf_dir):
    """The files of customers against a manifest that has a wrong digest for nations 3 and 11, lists nation 5 twice, leaves out nation 7 and names a file that is not there."""
    root, found = _customer_files(spark, sf_dir)
    lines = found.where("part != 7").select("part", F.when(F.col("part").isin(3, 11), F.lit("0" * 64)).otherwise(F.col("digest")).alias("digest"), "path")
    lines = lines.unionByName(lines.where("part = 5")).unionByName(spark.range(1).select(F.lit(99).alias("part"), F.lit("1" * 64).alias("digest"), F.lit("part=99/gone.csv").alias("path")))
    lines.orderBy("part").select(F.concat("digest", F.lit("  "), "path").alias("value")).coalesce(1).write.text(at := scratch(spark, "manifest"))
    bad = verified.violations(verified.listed(spark, at).drop("src"), found.select("path", "digest"))
    return bad.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("nation"), "reason")


SQL["manifest_check"] = "SELECT DISTINCT c_nationkey::INT AS nation, CASE c_nationkey WHEN 5 THEN 'listed twice' WHEN 7 THEN 'not listed' ELSE 'digest differs' END AS reason FROM customer WHERE c_nationkey IN (3, 5, 7, 11) UNION ALL SELECT 99, 'missing'"


# --- the run grid of the given corpus
def _run_grid(spark, sf_dir):
    """The run grid with the number of test examples that each run has to predict."""
    n = roles(spark, sf_dir).where("role = 'test'").groupBy("split_seed").agg(F.count(F.lit(1)).alias("n_expected"))
    return provenance.job_grid(spark).join(F.broadcast(n), "split_seed")  # a row for each split


def _ledger(grid: DataFrame) -> DataFrame:
    """A ledger by hash: some runs are only started, some have another file's digest, some lack an example."""
    h = F.sha2("run_id", 256)
    return grid.select("run_id", F.when(F.substring(h, 1, 1) < "8", "complete").otherwise("started").alias("status"), h.alias("digest"), F.when(F.substring(h, 2, 1) < "c", h).otherwise(F.lit("x")).alias("file_digest"), (F.col("n_expected") - (F.substring(h, 3, 1) < "4").cast("int")).alias("n_rows"), "n_expected")


@query
def job_grid(spark, sf_dir):
    return _run_grid(spark, sf_dir)


_JOBS = [(m, x, p or "", 1) for m, x, p in provenance.JOBS] + [(m, x, "", s) for m, x, s in provenance.ROBUST]
_GRID = f"""{SPLIT_SQL}, grid AS (SELECT backbone || '__' || regime || CASE WHEN part <> '' THEN '_' || part ELSE '' END || '__split' || split_seed || '__seed' || model_seed AS run_id, backbone, regime, part, model_seed, split_seed, n_expected
  FROM (VALUES {', '.join(f"('{m}', '{x}', '{p}', {s})" for m, x, p, s in _JOBS)}) t(backbone, regime, part, model_seed), (SELECT split_seed, count(*) AS n_expected FROM roles WHERE role = 'test' GROUP BY split_seed)),
pending AS (SELECT * FROM grid WHERE NOT (substr(sha256(run_id), 1, 1) < '8' AND substr(sha256(run_id), 2, 1) < 'c' AND substr(sha256(run_id), 3, 1) >= '4'))"""
SQL["job_grid"] = f"WITH {_GRID} SELECT * FROM grid"


@query
def pending_runs(spark, sf_dir):
    grid = stored(_run_grid(spark, sf_dir), "grid")
    return provenance.pending_runs(grid, _ledger(grid))


SQL["pending_runs"] = f"WITH {_GRID} SELECT * FROM pending"


@query
def session_runs(spark, sf_dir):
    grid = stored(_run_grid(spark, sf_dir), "grid")
    return provenance.session_runs(provenance.pending_runs(grid, _ledger(grid)), 7)


SQL["session_runs"] = f"WITH {_GRID} SELECT * FROM pending ORDER BY run_id LIMIT 7"


# --- sources, sinks, cleaning
@query
def json_documents_source(spark, sf_dir):
    """One JSON document of several lines for each region."""
    n = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("nations"))
    said = F.concat(F.lit('{\n "region": '), F.col("n_regionkey").cast("string"), F.lit(',\n "nations": '), F.to_json("nations"), F.lit("\n}"))
    n.repartition("n_regionkey").select(F.col("n_regionkey").alias("r"), said.alias("value")).write.partitionBy("r").option("lineSep", "\n").text(path := scratch(spark, "json"))
    return tables.read_json_documents(spark, path, struct("region bigint, nations array<string>")).select("region", F.array_join("nations", ",").alias("nations"))


SQL["json_documents_source"] = "SELECT n_regionkey AS region, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation GROUP BY 1"


@query
def fallback_source(spark, sf_dir):
    """A table that is there as Parquet, and one that is there as compressed CSV only."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("bigint").alias("k"), F.col("s_name").alias("name"))
    stem = scratch(spark, "stem")
    s.where("k % 2 = 0").write.parquet(f"{stem}-a.parquet")
    s.where("k % 2 = 1").write.option("header", True).option("compression", "gzip").csv(f"{stem}-b.csv.gz")
    return reduce(DataFrame.unionByName, (tables.read_table(spark, f"{stem}-{x}", struct("k bigint, name string")).withColumn("part", F.lit(x)) for x in "ab"))


SQL["fallback_source"] = "SELECT s_suppkey AS k, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS part FROM supplier"


@query
def table_sink(spark, sf_dir):
    """A partitioned table, written twice."""
    path = scratch(spark, "table")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    tables.write_table(o.limit(5), path, ["o_orderstatus"])
    tables.write_table(o, path, ["o_orderstatus"])
    return spark.read.parquet(path).select("o_orderkey", "o_orderstatus")


SQL["table_sink"] = "SELECT o_orderkey, o_orderstatus FROM orders"


@query
def cleaned_labels(spark, sf_dir):
    """Raters' rows without the unclear ones, fine categories folded into coarse ones: any of them counts once."""
    rows = labels.drop_unclear(rater_rows(spark, sf_dir).withColumn("example_very_unclear", F.col("view") == 1))
    return labels.fold_categories(rows, {"act": ["click", "purchase"], "state": ["error", "signup"]}).groupBy("act", "state").agg(F.count(F.lit(1)).alias("n"))


SQL["cleaned_labels"] = f"WITH {RATERS_SQL} SELECT greatest(click, purchase) AS act, greatest(error, signup) AS state, count(*) AS n FROM rr WHERE \"view\" = 0 GROUP BY 1, 2"


@query
def epochs(spark, sf_dir):
    """Times as texts, some of which are none or have fractions."""
    k = F.col("o_orderkey")
    seconds = F.datediff("o_orderdate", F.lit("1970-01-01")).cast("bigint") * 86400
    said = F.when(k % 7 == 0, F.lit("n/a")).when(k % 11 == 0, F.lit(None)).when(k % 2 == 0, F.concat(seconds.cast("string"), F.lit(".75"))).otherwise(seconds.cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.epoch_seconds(said).alias("at"))


SQL["epochs"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN -1 ELSE date_diff('day', DATE '1970-01-01', o_orderdate::DATE) * 86400 END::BIGINT AS at FROM orders"


@query
def corpus_order(spark, sf_dir):
    """Authors are cleaned before texts are compared: of equal texts one by a real author stays, even if a deleted one came first."""
    author = F.when(F.col("doc_id") % 3 == 0, " [deleted] ").otherwise(F.concat(F.lit(" a"), (F.col("doc_id") % 50).cast("string")))
    return dedup.build_corpus(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), author.alias("author"), "text"), "id").select("id", "author")


SQL["corpus_order"] = f"""WITH d AS (SELECT doc_id AS id, 'a' || doc_id % 50 AS author, coalesce({norm_sql('text')}, '') AS t FROM documents WHERE doc_id % 3 <> 0)
SELECT id, author FROM d WHERE t <> '' QUALIFY id = min(id) OVER (PARTITION BY t)"""


@query
def overlap_matrix(spark, sf_dir):
    """Every pair of training sets of all splits, from one scan of their ids."""
    by = ["split_seed", "juror"]
    sets = stored(_jurors(spark, sf_dir).select(*by, "id"), "sets")
    o = bitmaps.overlaps(stored(bitmaps.bitmaps(sets, "id", by), "bitmaps"), by)
    flat = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for side in ("a", "b") for c in by]
    return o.select(*flat, "n_a", "n_b", "n_both", "overlap", "jaccard", "disjoint", "subset", "equal")


SQL["overlap_matrix"] = f"""WITH {SPLIT_SQL}, {_SERPENTINE}, {_JURORS}, s AS (SELECT DISTINCT split_seed, juror, id FROM jt), n AS (SELECT split_seed, juror, count(*) AS n FROM s GROUP BY ALL),
i AS (SELECT x.split_seed AS sa, x.juror AS ja, y.split_seed AS sb, y.juror AS jb, count(*) AS k FROM s x JOIN s y ON x.id = y.id GROUP BY ALL),
p AS (SELECT x.split_seed AS split_seed_a, x.juror AS juror_a, y.split_seed AS split_seed_b, y.juror AS juror_b, x.n AS n_a, y.n AS n_b, coalesce(k, 0)::BIGINT AS n_both
FROM n x JOIN n y ON (x.split_seed, x.juror) < (y.split_seed, y.juror) LEFT JOIN i ON sa = x.split_seed AND ja = x.juror AND sb = y.split_seed AND jb = y.juror)
SELECT *, {r('n_both / least(n_a, n_b)')} AS overlap, {r('n_both / (n_a + n_b - n_both)')} AS jaccard, n_both = 0 AS disjoint, n_both = least(n_a, n_b) AS subset, n_both = n_a AND n_a = n_b AS equal FROM p"""


@query
def distinct_rollup(spark, sf_dir):
    """Distinct authors of each label and sub, of each label, and of all: the coarser ones are unions of the finer bitmaps."""
    fine = stored(bitmaps.bitmaps(stored(corpus(spark, sf_dir).select("label", "sub", "author"), "authors"), "author", ["label", "sub"]), "bitmaps")
    none = F.lit(None).cast("string")
    a = bitmaps.sizes(fine, ["label", "sub"]).select("label", "sub", F.lit(0).alias("level"), "n")
    b = bitmaps.sizes(bitmaps.merged(fine, ["label"]), ["label"]).select("label", none.alias("sub"), F.lit(1).alias("level"), "n")
    c = bitmaps.sizes(bitmaps.merged(fine, []), []).select(none.alias("label"), none.alias("sub"), F.lit(2).alias("level"), "n")
    return a.unionByName(b).unionByName(c).withColumnRenamed("n", "n_authors")


SQL["distinct_rollup"] = f"WITH {CORPUS_SQL} SELECT label, sub, grouping(label)::INT + grouping(sub)::INT AS level, count(DISTINCT author) AS n_authors FROM corpus GROUP BY ROLLUP (label, sub)"
