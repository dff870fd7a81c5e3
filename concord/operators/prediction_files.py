"""Prediction files against their sidecars and themselves: constraints on whole files joined to constraints on rows.

A run is a CSV file of predictions and a JSON sidecar that names the run and the file's digest. Files are hashed, and their header taken from their first bytes, where they
are read; rows are read by Spark's splittable CSV source as texts, so that a number that is none is a finding and not a failed job, and meet their file by its path.
Rows of a file whose header is wrong are not judged: their columns would be taken for each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest departure of a row's sum of probabilities from 1: absolute and relative parts together.
SUM_SLACK = 2e-5
FILE_RULES = ("columns", "no sidecar", "run_id", "digest")
ROW_RULES = ("finite", "sum", "label", "argmax")


def columns(k: int) -> list[str]:
    return ["example_id", "true_label", "pred_label", *(f"prob_{i}" for i in range(k))]


def _run(path: Column) -> Column:
    """The run that a file belongs to: the name of its folder."""
    return F.element_at(F.split(path, "/"), -2)


def _csv(spark: SparkSession, root: str):
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*.csv").load(root)


def file_violations(spark: SparkSession, root: str, sidecars: DataFrame, k: int) -> DataFrame:
    """(run, rule) of files below root/<run>/; sidecars: (run, run_id, prediction_file_sha256)."""
    header = F.regexp_replace(F.substring_index(F.decode(F.substring("content", 1, 64 * (k + 3)), "UTF-8"), "\n", 1), "\r$", "")
    files = _csv(spark, root).select(_run(F.col("path")).alias("run"), F.sha2("content", 256).alias("digest"), header.alias("header"))
    both = files.join(sidecars.select("run", "run_id", "prediction_file_sha256", F.lit(True).alias("there")), "run", "left")
    lacks = F.col("there").isNull()
    tests = (F.col("header") != ",".join(columns(k)), lacks, ~lacks & ~F.col("run_id").eqNullSafe(F.col("run")), ~lacks & ~F.col("prediction_file_sha256").eqNullSafe(F.col("digest")))
    broken = F.array_compact(F.array(*(F.when(t, F.lit(rule)) for rule, t in zip(FILE_RULES, tests, strict=True))))
    return both.select("run", F.explode(broken).alias("rule"))


def row_violations(spark: SparkSession, root: str, k: int, wrong: DataFrame) -> DataFrame:
    """(run, example_id, rule) of rows of files but those of `wrong` (run), whose header is."""
    schema = ", ".join(f"{c} string" for c in columns(k))
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*.csv").csv(root)
    rows = rows.select(_run(F.col("_metadata.file_path")).alias("run"), "example_id", F.col("true_label").try_cast("int").alias("t"), F.col("pred_label").try_cast("int").alias("q"), F.array(*(F.col(f"prob_{i}").try_cast("double") for i in range(k))).alias("probs"))
    rows = rows.join(wrong.select("run"), "run", "left_anti")
    finite = F.forall("probs", lambda p: p.isNotNull() & ~F.isnan(p) & (F.abs(p) < float("inf")))
    total = F.aggregate("probs", F.lit(0.0), lambda s, p: s + p)
    known = F.coalesce(F.col("t").between(0, k - 1) & F.col("q").between(0, k - 1), F.lit(False))
    tests = (~finite, finite & (F.abs(total - 1) > SUM_SLACK), ~known, finite & known & (F.array_position("probs", F.array_max("probs")) - 1 != F.col("q")))
    broken = F.array_compact(F.array(*(F.when(t, F.lit(rule)) for rule, t in zip(ROW_RULES, tests, strict=True))))
    return rows.select("run", "example_id", F.explode(broken).alias("rule"))


def violations(spark: SparkSession, root: str, sidecars: DataFrame, k: int) -> DataFrame:
    """(run, example_id, rule): one row for each broken rule of each file (example_id null) and each of its rows."""
    files = file_violations(spark, root, sidecars, k)
    rows = row_violations(spark, root, k, files.where("rule = 'columns'").distinct())
    return files.select("run", F.lit(None).cast("string").alias("example_id"), "rule").unionByName(rows)
