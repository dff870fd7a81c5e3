"""Vector code compression: product quantisation with exact integer codebooks, fitted by tree aggregation over NumPy blocks.

Components become integers floor(1024 x); a vector is cut into four equal consecutive parts, each of which is replaced by the index of the
nearest entry of its part's codebook (256 entries, squared Euclidean distance, the lower index on ties).

Vectors are stored once as columnar blocks (int64, one run of rows for each dimension). Every round is one `RDD.treeAggregate` over them:
a task adds up distances dimension by dimension into a (rows x entries) table that stays in the processor's cache, takes the nearest
entries, and adds its rows into int64 sums and counts with np.add.at; these tensors (4 x 256 x part's width) merge through the
tree. All is integer arithmetic, so results depend on no order, partition or repetition of a task. What is broadcast is the codebooks: 1,024 entries, whatever
the table's size.

Defined results. Rows are dropped if the vector is null or holds a null, NaN or infinite component. A codebook starts with the 256 smallest keys' vectors,
null keys last, equal keys by vector; with fewer rows it has fewer entries. Repeated rows are coded alike and all count. Widths that four doesn't divide are
filled up with zeros, as are narrower vectors. Null labels are one label. An empty table has no codes. Components whose squared distances
could leave 64 bits (|x| of about a million at 64 dimensions) are refused. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Rows whose distances to all entries are held at a time.
ROWS_AT_ONCE = 256


@dataclass(frozen=True)
class Codebooks:
    entries: np.ndarray  # (parts, entries, width of a part), int64
    wide: int  # width of the vectors that it was made for
    peak: int  # largest absolute component of the fitted rows

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _padded(wide: int) -> int:
    return -(-wide // PARTS) * PARTS


def nearest(block: np.ndarray, entries: np.ndarray, bound: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(part, first row, nearest entries, squared distances) for runs of rows of a block with a row for each dimension.

    bound: no component of either side is larger; where squares fit into 32 bits they are added up there."""
    parts, k, w = entries.shape
    kind = np.int32 if w * (2 * bound) ** 2 < 1 << 31 else np.int64
    block, entries = block.astype(kind, copy=False), entries.astype(kind)
    rows = min(ROWS_AT_ONCE, block.shape[1])
    total, diff = np.empty((rows, k), kind), np.empty((rows, k), kind)
    for p in range(parts):
        columns = [np.ascontiguousarray(entries[p, :, d]) for d in range(w)]
        for at in range(0, block.shape[1], max(rows, 1)):
            n = min(rows, block.shape[1] - at)
            sums, one = total[:n], diff[:n]
            sums[:] = 0
            for d in range(w):
                np.subtract.outer(block[p * w + d, at : at + n], columns[d], out=one)
                np.multiply(one, one, out=one)
                np.add(sums, one, out=sums)
            code = sums.argmin(axis=1)
            yield p, at, code, sums[np.arange(n), code].astype(np.int64)


def fit(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", rounds: int = ROUNDS) -> Codebooks | None:
    """The codebooks after `rounds` rounds; None for a table without vectors."""
    spark = rows.sparkSession
    some = V.kept(rows, vector, key)
    first = some.orderBy(F.col(key).asc_nulls_last(), F.transform("vector", lambda x: F.floor(x * SCALE))).limit(ENTRIES).select("vector").toArrow()
    if not first.num_rows:
        return None
    wide = V.width(some)
    full = _padded(wide)
    own = lambda b: V.integers(b["vector"], SCALE, full)
    blocks = C.stored(some.select("vector").mapInArrow(C.trimmed(lambda batches: V.as_blocks(batches, own, True)), V.BLOCK_SCHEMA), "code-blocks")
    n, peak = blocks.agg(F.sum("n"), F.max("peak")).first()
    if full * (2 * peak) ** 2 >= 1 << 63 or n * peak >= 1 << 63:
        raise ValueError(f"components of up to {peak / SCALE:.3g} have squared distances or sums beyond 64 bits")
    start = V.integers(first["vector"].combine_chunks(), SCALE, full)
    now = np.ascontiguousarray(start.reshape(len(start), PARTS, full // PARTS).transpose(1, 0, 2))
    shape = now.shape
    for _ in range(rounds):
        held = spark.sparkContext.broadcast(now)  # 1,024 entries

        def add(done: tuple | None, data: np.ndarray, rows: int) -> tuple:
            sums, counts = done or (np.zeros(shape, np.int64), np.zeros(shape[:2], np.int64))
            block = data.reshape(full, rows)
            for p, at, code, _ in nearest(block, held.value, peak):
                np.add.at(sums[p], code, block[p * shape[2] : (p + 1) * shape[2], at : at + len(code)].T)
                np.add.at(counts[p], code, 1)
            return sums, counts

        sums, counts = V.tree_sum(blocks, add, lambda a, b: (a[0] + b[0], a[1] + b[1]))
        held.destroy()
        used = counts > 0
        now = np.where(used[:, :, None], sums // np.maximum(counts, 1)[:, :, None], now)
    return Codebooks(now, wide, peak)


def encode(rows: DataFrame, books: Codebooks, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: key, label, code (two hex digits a part) and error (squared distances summed over parts).

    The books must have been fitted to vectors as wide and with components as large; others are refused."""
    full, bound, entries = _padded(books.wide), books.peak, books.entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = V.integers(batch["vector"], SCALE, full)
            if V.peak(x) > bound:
                raise ValueError("a component is larger than those that the codebooks were fitted to")
            codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, at, code, distance in nearest(np.ascontiguousarray(x.T), entries, bound):
                codes[at : at + len(code), p] = code
                error[at : at + len(code)] += distance
            text = codes.tobytes().hex()
            names = [text[i : i + 2 * PARTS] for i in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([batch[key], batch[label], pa.array(names, pa.string()), pa.array(error)], [key, label, "code", "error"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return V.kept(rows, vector, key, label).mapInArrow(C.trimmed(run), f"`{key}` {kind(key)}, `{label}` {kind(label)}, code string, error bigint")


def with_label_error(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded with label_error, the errors of all rows of the label; nulls are one label, and a label may have any share of the rows."""
    rows = C.stored(coded.withColumn("__label", F.struct(F.col(label).alias("l"))), "codes")  # a struct is never null itself
    totals = C.stored(rows.groupBy("__label").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")), "code-errors", few=True)
    return C.skew_join(rows, totals, "__label", "n").drop("__label", "n")


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """key, label, code, error, label_error, codebooks_sha256."""
    books = fit(rows, key, vector)
    if books is None:
        return rows.select(key, label, *(F.lit(None).cast(t).alias(c) for c, t in (("code", "string"), ("error", "bigint"), ("label_error", "bigint"), ("codebooks_sha256", "string")))).limit(0)
    return with_label_error(encode(rows, books, key, vector, label), label).withColumn("codebooks_sha256", F.lit(books.sha256))
