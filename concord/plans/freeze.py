"""The freeze chain: JSON documents that cite each other and the corpus by digest, and what must hold between them.

Documents are files root/<bundle>/<name>/<file>; a bundle is one chain. One scan reads their bytes, hashes and parses them. A field whose value is a
SHA-256 digest is a citation, an edge to the document (or the content) with that digest; what a document rests on is the closure of the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CITATION = r'"([A-Za-z0-9_]+)"\s*:\s*"([0-9a-f]{64})"'

#: The documents of a chain and the fields that the checks read. Fixed values.
REPORT = "freeze_quality boolean, decision struct<h1_confirmatory_feasible:boolean,exploratory_dose_k:int,h1_primary_metric:string>, meta struct<corpus_content_sha256:string>"
AMENDMENT = "hypothesis string, to_status string, section0_report_sha256 string, corpus_content_sha256 string, exploratory_dose_k int, h1_primary_metric string"
MANIFEST = "section0_report_sha256 string, h1_amendment_sha256 string, corpus_content_sha256 string, h1_status string, dose_k int, h1_primary_metric string, corpus struct<n_examples:bigint,n_authors:bigint,class_distribution:map<string,bigint>>"
CHECKS = ("P01", "P02", "P03", "P04", "P05", "P06")

#: What a run's configuration must say where the runner has no choice. Fixed values.
STRUCTURE = {
    "tokenization.padding": '"max_length"',
    "tokenization.truncation": "true",
    "optimization.optimizer": '"AdamW"',
    "optimization.scheduler": '"linear_with_warmup"',
    "optimization.loss": '"cross_entropy"',
    "checkpoint_rule.selection_metric": '"validation_macro_f1"',
    "checkpoint_rule.selection_mode": '"max"',
    "checkpoint_rule.evaluate_every": '"epoch"',
    "checkpoint_rule.restore_best_before_test": "true",
}
#: Fields that a configuration must have, and digests and seeds that must be filled in. Fixed values.
REQUIRED = ("class_weighting", "models", "tokenization", "optimization", "checkpoint_rule", "model_seeds", "labels", "determinism", "data_provenance", "h2_single_model_baseline")
FILLED = ("dataset_manifest_sha256", "corpus_content_sha256", "split_seeds")
CONFIG = "frozen boolean, class_weighting string, models map<string,struct<revision:string>>, labels array<string>, model_seeds array<int>, determinism struct<seed_python_numpy_torch:boolean>, h2_single_model_baseline struct<model:string,regime:string,model_seed:int>"


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """(bundle, name, digest, text) of all documents below root; the digest is that of the file's bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(root)
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -3).alias("bundle"), F.element_at(parts, -2).alias("name"), F.sha2("content", 256).alias("digest"), F.decode("content", "UTF-8").alias("text"))


def write_document(row: DataFrame, root: str, bundle: str, name: str) -> None:
    """One JSON document from a frame of one row."""
    row.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.text(f"{root}/{bundle}/{name}")


def citations(docs: DataFrame) -> DataFrame:
    """(bundle, name, field, cited): every digest that a document names."""
    found = F.regexp_extract_all("text", F.lit(CITATION), F.lit(0))
    each = docs.select("bundle", "name", F.explode(found).alias("c"))
    return each.select("bundle", "name", F.regexp_extract("c", CITATION, 1).alias("field"), F.regexp_extract("c", CITATION, 2).alias("cited"))


def dangling(docs: DataFrame, contents: DataFrame) -> DataFrame:
    """Citations of a digest that is neither a document's of the bundle nor one of `contents` (bundle, digest)."""
    known = docs.select("bundle", F.col("digest").alias("cited")).unionByName(contents.select("bundle", F.col("digest").alias("cited"))).distinct()
    return citations(docs).join(known, ["bundle", "cited"], "left_anti")


def closure(docs: DataFrame) -> DataFrame:
    """(bundle, name, rests_on, depth): the documents that each one rests on and the length of the shortest way there. A digest can't be cited before it exists, so
    chains end; a path that comes back is not followed."""
    spark = docs.sparkSession
    edges = citations(docs).join(docs.select("bundle", F.col("name").alias("rests_on"), F.col("digest").alias("cited")), ["bundle", "cited"]).select("bundle", "name", "rests_on").distinct()
    return spark.sql(
        """WITH RECURSIVE e AS (SELECT * FROM {edges}),
        reach (bundle, name, rests_on, path) AS (SELECT bundle, name, rests_on, array(name, rests_on) FROM e
          UNION ALL SELECT r.bundle, r.name, e.rests_on, array_append(r.path, e.rests_on) FROM reach r JOIN e ON r.bundle = e.bundle AND r.rests_on = e.name WHERE NOT array_contains(r.path, e.rests_on))
        SELECT bundle, name, rests_on, min(size(path)) - 1 AS depth FROM reach GROUP BY bundle, name, rests_on""",
        edges=edges,
    )


def freeze_checks(docs: DataFrame, corpus: DataFrame, report: str = "section0", amendment: str = "amendment", manifest: str = "manifest", label: str = "label", author: str = "author") -> DataFrame:
    """(bundle, check_id, passed): the six provenance checks of each bundle. What is absent fails."""
    one = lambda name, schema, tag: docs.where(F.col("name") == name).select("bundle", F.col("digest").alias(f"{tag}_sha"), F.from_json("text", schema).alias(tag))
    chain = docs.select("bundle").distinct()
    for part in (one(report, REPORT, "s"), one(amendment, AMENDMENT, "a"), one(manifest, MANIFEST, "m")):
        chain = chain.join(part, "bundle", "left")  # a row for each bundle
    found = corpus.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    facts = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.map_from_entries(F.collect_list(F.struct(label, "n"))).alias("classes"))  # a label each
    facts = facts.crossJoin(F.broadcast(corpus.agg(F.count_distinct(author).alias("authors"))))  # single rows
    chain = chain.crossJoin(F.broadcast(facts))
    s, a, m = F.col("s"), F.col("a"), F.col("m")
    listed = F.map_filter(m["corpus"]["class_distribution"], lambda k, v: v != 0)
    classes = (F.size(listed) == F.size("classes")) & F.forall(F.map_entries("classes"), lambda e: F.coalesce(F.try_element_at(listed, e["key"]) == e["value"], F.lit(False)))
    tests = (
        m["section0_report_sha256"] == F.col("s_sha"),
        m["h1_amendment_sha256"] == F.col("a_sha"),
        a["section0_report_sha256"] == F.col("s_sha"),
        s["freeze_quality"] & ~s["decision"]["h1_confirmatory_feasible"] & (a["hypothesis"] == "H1") & (a["to_status"] == "exploratory") & (m["h1_status"] == "exploratory") & (a["exploratory_dose_k"] == m["dose_k"]) & (a["h1_primary_metric"] == "accuracy") & (m["h1_primary_metric"] == "accuracy"),
        (m["corpus_content_sha256"] == s["meta"]["corpus_content_sha256"]) & (m["corpus_content_sha256"] == a["corpus_content_sha256"]),
        (m["corpus"]["n_examples"] == F.col("n")) & (m["corpus"]["n_authors"] == F.col("authors")) & classes,
    )
    rows = F.inline(F.array(*(F.struct(F.lit(c).alias("check_id"), F.coalesce(t, F.lit(False)).alias("passed")) for c, t in zip(CHECKS, tests, strict=True))))
    return chain.select("bundle", rows)


def unbound(docs: DataFrame, expected: DataFrame) -> DataFrame:
    """(bundle, name, reason): documents of `expected` (bundle, name, expected) that are missing or have another digest."""
    got = expected.join(docs.select("bundle", "name", "digest"), ["bundle", "name"], "left")
    reason = F.when(F.col("digest").isNull(), "missing").when(F.col("digest") != F.col("expected"), "digest differs")
    return got.select("bundle", "name", reason.alias("reason")).where("reason IS NOT NULL")


def config_violations(configs: DataFrame, labels: list[str]) -> DataFrame:
    """(bundle, name, rule): what a run's configuration lacks or contradicts; configs: documents."""
    c = F.col("c")
    value = lambda path: F.to_json(F.variant_get(F.col("v"), f"$.{path}", "variant"))
    rules: list[tuple[Column | str, Column]] = [(f"missing:{f}", value(f).isNull()) for f in REQUIRED]
    rules.append(("frozen", ~F.coalesce(c["frozen"], F.lit(False))))
    rules += [(f"structure:{path}", ~F.coalesce(value(path) == want, F.lit(False))) for path, want in STRUCTURE.items()]
    rules.append(("class_weighting", ~F.coalesce(c["class_weighting"] == "none", F.lit(False))))
    rules.append(("determinism", ~F.coalesce(c["determinism"]["seed_python_numpy_torch"], F.lit(False))))
    rules.append(("labels", ~F.coalesce(c["labels"] == F.array(*map(F.lit, labels)), F.lit(False))))
    rules += [(f"provenance:{f}", F.coalesce(value(f"data_provenance.{f}").isin('""', "[]", "null") | value(f"data_provenance.{f}").startswith('"<'), F.lit(True))) for f in FILLED]
    pinned = F.forall(F.map_values(c["models"]), lambda m: F.coalesce(m["revision"].rlike("^[0-9a-fA-F]{40}$"), F.lit(False)))
    rules.append(("revision", ~F.coalesce(pinned, F.lit(False))))
    base = c["h2_single_model_baseline"]
    trained = F.array_contains(F.map_keys(c["models"]), base["model"]) & (base["regime"] == "r_clean") & F.array_contains(c["model_seeds"], base["model_seed"])
    rules.append(("baseline", ~F.coalesce(trained, F.lit(False))))
    parsed = configs.withColumn("v", F.try_parse_json("text")).withColumn("c", F.from_json("text", CONFIG))
    broken = F.when(F.col("v").isNull(), F.array(F.lit("no JSON"))).otherwise(F.array_compact(F.array(*(F.when(bad, F.lit(rule)) for rule, bad in rules))))
    return parsed.select("bundle", "name", F.explode(broken).alias("rule"))
