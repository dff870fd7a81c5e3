"""Tables of vectors as NumPy blocks: which rows count, exact integers of their components, and sums over all blocks by a reduction tree.

A vector counts unless it is null or holds a null, NaN or infinite component. Vectors of one table should be of one width; narrower ones
count as if zeros followed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rows to a block.
BLOCK_ROWS = 2_000


def finite(vector: str) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.exists(F.col(vector), odd)


def kept(rows: DataFrame, vector: str, *others: str) -> DataFrame:
    """The rows whose vector counts: the other columns and `vector`, an array of doubles."""
    C.ready(rows.sparkSession)
    return rows.where(finite(vector)).select(*others, F.col(vector).cast("array<double>").alias("vector"))


def width(rows: DataFrame) -> int:
    """The largest width of a vector of `kept` rows; 0 without rows."""
    return rows.agg(F.max(F.size("vector"))).first()[0] or 0


def integers(vectors: pa.Array, scale: int, wide: int) -> np.ndarray:
    """floor(scale * component) as int64, a row for each vector; what is beyond 64 bits stops at their ends."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    if size.max(initial=0) > wide:
        raise ValueError(f"a vector is wider than {wide}")
    x = np.floor(vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    end = 2.0**63
    with np.errstate(invalid="ignore"):
        whole = np.where(x >= end, np.iinfo(np.int64).max, np.where(x < -end, np.iinfo(np.int64).min, x.astype(np.int64)))
    if (size == wide).all():
        return whole.reshape(len(size), wide)
    out = np.zeros((len(size), wide), np.int64)
    out[np.repeat(np.arange(len(size)), size), C.ragged(np.zeros(len(size), np.int64), size)] = whole
    return out


def peak(x: np.ndarray) -> int:
    """The largest absolute value."""
    return max(-int(x.min()), int(x.max())) if x.size else 0


def as_blocks(batches: Iterator[pa.RecordBatch], rows_of: Callable[[pa.RecordBatch], np.ndarray], by_dimension: bool) -> Iterator[pa.RecordBatch]:
    """(n, peak, data) of blocks of at most BLOCK_ROWS rows; data are int64, dimension after dimension or row after row."""
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK_ROWS):
            x = rows_of(batch.slice(at, BLOCK_ROWS))
            data = np.ascontiguousarray(x.T if by_dimension else x, "<i8").tobytes()
            # the largest absolute value of 64 bits is one more than a long holds
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(x)], pa.int64()), "peak": pa.array([min(peak(x), (1 << 63) - 1)], pa.int64()), "data": pa.array([data], pa.binary())})


BLOCK_SCHEMA = "n bigint, peak bigint, data binary"


def tree_sum(blocks: DataFrame, add: Callable[[Any, np.ndarray, int], Any], merge: Callable[[Any, Any], Any], depth: int = 2) -> Any:
    """Fold `add` over the blocks of each partition and `merge` the partial results through a reduction tree; None without blocks.

    The tree's last level brings about the root of the number of partitions of partial results to the driver; each is as large as what `add` makes."""

    def step(done: Any, row: Any) -> Any:
        return add(done, np.frombuffer(row["data"], "<i8"), row["n"])

    def meet(a: Any, b: Any) -> Any:
        return b if a is None else a if b is None else merge(a, b)

    return blocks.select("n", "data").rdd.treeAggregate(None, step, meet, depth)
