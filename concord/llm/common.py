"""Helpers shared by the training-data operators: scratch tables, bounded broadcasts, Arrow batches."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as a Java and RE2 character class.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of text that one step of a Python operator holds at a time.
SLICE_BYTES = 8 << 20
#: The same for operators that gain nothing from words that texts share.
SMALL_SLICE = 2 << 20

#: A table is broadcast only when it was counted and has at most so many rows and bytes.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 2 << 20
#: A file of a table that `stored` wrote, in one go; its part's number is its name in every run.
OWN_FILE = r"^.*/concord-[^/]*-[0-9a-f]{12}/part-(\d+)-[0-9a-f-]{36}-c(\d+).*$"
#: Keys with most rows that are joined by broadcast, so that no task gets all rows of such a key.
HEAVY = 1_000


def ready(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches and let local Python workers import this package."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * SLICE_BYTES))
    return spark


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir).

    Only where that setting is absent and all workers are on this machine (tests) a temporary folder takes its place."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = getattr(scratch, "own", None)
        if base is None:
            base = scratch.own = tempfile.mkdtemp(prefix="concord-")
            atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/concord-{name}-{uuid.uuid4().hex[:12]}"


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage, and lost executors cost no recomputation.

    few: the table is narrow next to the data; it is written by four tasks for each core at most."""
    spark = df.sparkSession
    (df.coalesce(4 * max(2, spark.sparkContext.defaultParallelism)) if few else df).write.parquet(path := scratch(spark, name))
    return spark.read.schema(df.schema).parquet(path)


def bytes_of_column(c: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.coalesce(F.size(c), F.lit(0)) * 8 + 16
    if isinstance(kind, T.StructType):
        return sum((bytes_of_column(c[f.name], f.dataType) for f in kind), F.lit(16))
    return F.lit(8)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, most: int = BROADCAST_BYTES) -> DataFrame:
    """A stored table, with a broadcast hint only if it was measured to be small; larger ones are shuffled."""
    each = sum((bytes_of_column(df[f.name], f.dataType) for f in df.schema), F.lit(0))
    n, size = df.select(each.cast("bigint").alias("b")).limit(rows + 1).agg(F.count(F.lit(1)), F.sum("b")).first()
    return F.broadcast(df) if n <= rows and (size or 0) <= most else df


def by_place(rows: DataFrame, table: DataFrame, how: str = "inner") -> DataFrame:
    """Join rows (which hold texts) with a table that has one row for some places. Both are dealt by place and the table is
    hashed, whatever its size: it grows with the rows, so it is not broadcast. The order of the rows that come out is that
    of their places, so a later step that depends on it (packing) does the same in every run."""
    return rows.join(table.hint("shuffle_hash"), ["__file", "__row"], how).sortWithinPartitions("__file", "__row")


def skew_join(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of stored rows with one stored row for each key, whose column `size` says how many rows the key has.

    The HEAVY largest keys are broadcast and the others shuffled, so a task gets no key with more than 1 / HEAVY of the rows."""
    heavy = F.broadcast(groups.orderBy(F.desc(size), key).limit(HEAVY))
    rest = groups.join(heavy.select(key), key, "left_anti")
    columns = [*rows.columns, *(c for c in groups.columns if c != key)]
    some = rows.join(heavy, key).select(columns)
    return some.unionByName(rows.join(heavy.select(key), key, "left_anti").join(rest, key).select(columns))


def reserved(docs: DataFrame, *names: str) -> None:
    """Refuse columns of docs that have the names of result columns."""
    if clash := sorted({*map(str.lower, docs.columns)} & set(names)):
        raise ValueError(f"the operator adds columns of these names: {', '.join(clash)}")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_mod(n: int, col: str = "doc_id") -> Column:
    """crc32(col as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")) % n


def plain(docs: DataFrame, name: str = "rows") -> DataFrame:
    """docs itself if Spark can tell the file and row of its rows; other frames are stored first."""
    try:
        docs.select(docs.metadataColumn("_metadata")["row_index"])
        return docs
    except AnalysisException:
        return stored(docs, name)


def located(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """The chosen columns of a plain frame, and __file (a 64-bit hash of the file's path) and __row, which name a row for good."""
    place = docs.metadataColumn("_metadata")
    file = F.regexp_replace(place["file_path"], OWN_FILE, "$1-$2")
    return docs.select(*columns, F.xxhash64(file).alias("__file"), place["row_index"].alias("__row"))


def whole(docs: DataFrame) -> DataFrame:
    """The rows of a plain frame as one column __all, which no other name can clash with, and their places."""
    return located(docs, F.struct("*").alias("__all"))


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, after which the worker gives freed memory back: workers stay alive and would keep the most they ever used."""

    def wrapper(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return wrapper


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | Iterator[pa.RecordBatch]], schema: str, most: int = SLICE_BYTES) -> DataFrame:
    """Apply f to slices of each Arrow batch that hold a bounded amount of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most):
                out = f(part)
                yield from ([out] if isinstance(out, pa.RecordBatch) else out)

    return df.mapInArrow(trimmed(run), schema)


def grouped(df: DataFrame, keys: list[str], f: Callable[[list[pa.Table]], pa.Table], schema: str, batch_bytes: int = 4 << 20, large: int = 64) -> DataFrame:
    """Apply f to lists of groups, each with the rows of one key; groups of more than `large` rows come alone.

    Rows are dealt and sorted by Spark and cut where the key changes, which for many small groups costs far less than
    a call for each."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            own = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(own)) if own[i] != own[i - 1]), len(own)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and own[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = own[a]
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, size = [], 0
        for group in groups(batches):
            if group.num_rows > large:
                yield from f([group]).to_batches()
                continue
            some.append(group)
            size += group.nbytes
            if size >= batch_bytes:
                yield from f(some).to_batches()
                some, size = [], 0
        if some:
            yield from f(some).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(trimmed(run), schema)


def slices(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows with about `most` bytes of text (one row at least)."""
    if "text" not in batch.schema.names:
        yield batch
        return
    size = pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(size) else np.array([], int)
    for a, b in zip(starts, [*starts[1:], len(size)], strict=True):
        yield batch.slice(int(a), int(b - a))


def texts_of(batch: pa.RecordBatch) -> pa.Array:
    """The texts, null as empty, in buffers of their own: some Arrow functions misread a slice of larger buffers."""
    text = pc.fill_null(batch["text"].cast(pa.large_string()), "")
    return text.take(pa.array(np.arange(len(text)))) if len(text) else text


def split_words(text: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, one after the other, and the places where each text's words begin (and the end)."""
    lists = pc.ascii_split_whitespace(text)
    flat = lists.flatten()
    full = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.r_[0, np.cumsum(full)]
    starts = np.asarray(lists.offsets) - int(lists.offsets[0].as_py() if len(lists.offsets) else 0)
    return flat.filter(pa.array(full)), ends[starts]


def encode(flat: pa.Array) -> tuple[np.ndarray, list[bytes]]:
    """A code for each word, and the distinct words by code."""
    coded = pc.dictionary_encode(flat)
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.cast(pa.large_binary()).to_pylist()


def bytes_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (and the end)."""
    at = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2] if len(text) else None
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places from each start on."""
    ends = np.cumsum(size)
    return np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


def sums(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sum of x between neighbouring places of `at`."""
    if not len(x):
        return np.zeros(len(at) - 1, np.int64)
    out = np.add.reduceat(x, np.minimum(at[:-1], len(x) - 1), dtype=np.float64 if x.dtype.kind == "f" else np.int64)
    return np.where(at[1:] > at[:-1], out, 0)


def mix(h: np.ndarray) -> np.ndarray:
    """Murmur3's 64-bit finaliser."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h
