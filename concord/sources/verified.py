"""Files that are read only as their manifest describes them: one scan hashes the bytes that it parses.

Each file is a row of Spark's binary source, so any file system that Spark reads will do. The task that has a file's bytes compares their digest with the manifest's
and parses the same bytes; a file that differs fails the job before any of its rows are used, and so does a file that the manifest lists and the folder
lacks, or the other way round. Rows keep the manifest's order of files and their order within each.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv as pv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .tables import file_digests

ROWS_AT_ONCE = 20_000


def listed(spark: SparkSession, path: str) -> DataFrame:
    """(src, digest, path) of a manifest's lines `digest  path`; src is the line's place among them, from 0."""
    text = F.filter(F.split(F.decode("content", "UTF-8"), "\n"), lambda x: F.trim(x) != "")
    lines = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(path).orderBy("path").limit(2).select(F.posexplode(text).alias("src", "line"))
    parts = F.split(F.trim("line"), r"\s+", 2)
    return lines.select("src", F.lower(parts[0]).alias("digest"), F.ltrim(parts[1]).alias("path"))


def violations(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason) of files that are missing, differ, are listed twice or are not listed; files: (path, digest)."""
    mine = manifest.groupBy("path").agg(F.count(F.lit(1)).alias("times"), F.min("digest").alias("digest"))
    both = mine.join(files.select("path", F.col("digest").alias("found")), "path", "full_outer")
    reason = F.when(F.col("times").isNull(), "not listed").when(F.col("times") > 1, "listed twice").when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("digest"), "digest differs")
    return both.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def read_csv(spark: SparkSession, manifest: DataFrame, root: str, schema: T.StructType) -> DataFrame:
    """The rows of all CSV files (with headers; plain or .gz) below root, and _src and _pos, their file's and their own place.

    The header must have the schema's names in its order."""
    plain = r"^[a-z0-9]+:/*"  # a scheme
    base = re.sub(plain, "/", root.rstrip("/") + "/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "[!_.]*").load(root)
    name = F.substring_index(F.regexp_replace("path", plain, "/"), base, -1)
    rows = manifest.select("src", F.col("digest").alias("listed"), "path").join(files.select(name.alias("path"), "content"), "path", "full_outer")
    names = [f.name for f in schema]
    kinds = {f.name: f.type for f in to_arrow_schema(schema)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, src, digest, content = (batch[c][i].as_py() for c in ("path", "src", "listed", "content"))
                if content is None or digest is None:
                    raise ValueError(f"{path}: {'missing' if content is None else 'not listed'}")
                if hashlib.sha256(content).hexdigest() != digest:
                    raise ValueError(f"{path}: digest differs")
                data = gzip.decompress(content) if path.endswith(".gz") else content
                table = pv.read_csv(io.BytesIO(data), parse_options=pv.ParseOptions(newlines_in_values=True), convert_options=pv.ConvertOptions(column_types=kinds, strings_can_be_null=True, quoted_strings_can_be_null=False, null_values=[""]))
                if table.column_names != names:
                    raise ValueError(f"{path}: columns {table.column_names}, not {names}")
                table = table.append_column("_src", pa.array([src] * table.num_rows, pa.int32())).append_column("_pos", pa.array(range(table.num_rows), pa.int64()))
                yield from table.to_batches(ROWS_AT_ONCE)

    out = T.StructType([*schema.fields, T.StructField("_src", T.IntegerType()), T.StructField("_pos", T.LongType())])
    return rows.select("path", F.col("src").cast("int").alias("src"), "listed", "content").mapInArrow(run, out)


def verified(spark: SparkSession, manifest: DataFrame, root: str) -> DataFrame:
    """(path, reason) of what differs between a manifest and the files below root."""
    return violations(manifest, file_digests(spark, root).where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")))
