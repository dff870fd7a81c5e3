"""Readers and sinks. Schemas are given, never inferred; sinks stage what they write and then move it into place."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); a temporary one only where none is set and all workers are on this machine."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(scratch, "own", None)
        if base is None:
            base = scratch.own = tempfile.mkdtemp(prefix="concord-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/concord-{name}-{uuid.uuid4().hex[:12]}"


#: Spark's own setting; off by default, so that shuffle files stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and lost executors cost no recomputation. The shuffle files of the write go with its end."""
    conf = df.sparkSession.conf
    was = conf.get(CLEANUP)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path := scratch(df.sparkSession, name))
    finally:
        conf.set(CLEANUP, was)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete a table that `stored` returned and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if not folder.rsplit("/", 1)[1].startswith("concord-"):
            raise ValueError(f"not a scratch table: {folder}")
        at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def replaced(df: DataFrame, name: str, *used: DataFrame) -> DataFrame:
    """`stored`; after it the tables in `used`, which `stored` returned and nothing else reads, are deleted."""
    out = stored(df, name)
    for table in used:
        dropped(table)
    return out


def read_csvs(spark: SparkSession, paths: list[str], schema: T.StructType, header: bool = True) -> DataFrame:
    """Several CSV files in the given order; _src and _pos say where a row came from. A missing file is an error."""
    out = None
    for i, path in enumerate(paths):
        part = spark.read.schema(schema).option("header", header).option("mode", "FAILFAST").csv(path).select("*", F.lit(i).alias("_src"), F.monotonically_increasing_id().alias("_pos"))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no files")
    return out


def read_table(spark: SparkSession, stem: str, schema: T.StructType | None = None) -> DataFrame:
    """stem.parquet if it exists, else stem.csv.gz."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{stem}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.read.schema(schema).parquet(f"{stem}.parquet") if schema else spark.read.parquet(f"{stem}.parquet")
    if schema is None:
        raise ValueError("a CSV table needs a schema")
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(f"{stem}.csv.gz")


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id a line, stripped, without blank lines; pos keeps the order within a file."""
    return spark.read.text(path).select(F.trim("value").alias("id"), F.monotonically_increasing_id().alias("pos")).where("id != ''")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(digest, path) of lines `digest  path`."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    return spark.read.text(path).where("trim(value) != ''").select(F.lower(parts[0]).alias("digest"), F.ltrim(parts[1]).alias("path"))


def file_digests(spark: SparkSession, root: str) -> DataFrame:
    """(path, digest) of every file under root; files are hashed where they are read."""
    base = root.rstrip("/") + "/"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace("path", r"^[a-z0-9]+:/*", "/")
    return rows.select(F.substring_index(name, base, -1).alias("path"), F.sha2("content", 256).alias("digest"))


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet; the job's commit protocol makes it appear as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def replace_directory(df: DataFrame, path: str) -> None:
    """Write next to path, then put it in path's place in one rename; a failed write leaves path as it was."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    new, old = f"{path.rstrip('/')}.new-{uuid.uuid4().hex[:8]}", f"{path.rstrip('/')}.old-{uuid.uuid4().hex[:8]}"
    df.write.parquet(new)
    make = jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(conf)
    had = fs.exists(make(path))
    if had and not fs.rename(make(path), make(old)):
        raise OSError(f"cannot move {path}")
    if not fs.rename(make(new), make(path)):
        if had:
            fs.rename(make(old), make(path))
        raise OSError(f"cannot move {new}")
    if had:
        fs.delete(make(old), True)


def write_csv(df: DataFrame, path: str) -> None:
    """A report of a few rows as one CSV part with a header."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_report(rows: DataFrame, path: str, title: str, most: int = 10_000) -> None:
    """A small result as JSON and as a Markdown table, moved into place when complete. More than `most` rows are refused."""
    got = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else str(v)
    lines = [f"# {title}", "", "| " + " | ".join(rows.columns) + " |", "| " + " | ".join("---" for _ in rows.columns) + " |", *("| " + " | ".join(cell(r[c]) for c in rows.columns) + " |" for r in got)]
    for suffix, text in ((".json", json.dumps(got, indent=2, default=str, sort_keys=True)), (".md", "\n".join(lines) + "\n")):
        target = Path(path + suffix)
        temp = target.with_name(target.name + ".tmp")
        temp.write_text(text, encoding="utf-8")
        temp.replace(target)
