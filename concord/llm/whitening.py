"""Embedding whitening by matrix-free block subspace iteration.

Components become integers x = floor(256 c). The principal components of the distinct x vectors (the fit list) are found without forming their covariance matrix V:
a pass over Spark's partitions computes Xᵀ(XQ) on centred rows for a block Q of a few columns, partial products meet through a
reduction tree, and the driver does a QR step and a Rayleigh-Ritz projection on matrices of width x block. Passes go on until the residuals |Vq - eq| of all k
components are below TOLERANCE times the largest eigenvalue, which certifies them. Where eigenvalues lie so close together that the
residuals would need more than PATIENCE further passes, the block is doubled; a block as wide as the vectors spans the space, so that its
Rayleigh-Ritz step is exact, and the iteration ends for every input.

Each pass reads the stored blocks of the fit list and sends width x block doubles from each partition into the tree; nothing else travels, so passes cost the
same network at any number of rows. Counts, sums and squares that define the mean and the trace are exact integers.

Defined results. Rows are dropped if the vector is null or holds a null, NaN or infinite entry. Repeated vectors count once in the fit and are
all whitened. Directions without variance (eigenvalues at rounding level; all of them for fewer than two distinct vectors) have no whitened component and no row; an empty table has no rows. Equal eigenvalues: any
orthonormal basis of their space, the same for all rows. Narrower vectors count as if zeros followed. A deviation beyond 38 digits is null. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

SCALE, COMPONENTS = 256, 4
#: Columns of the first block beyond the wanted components; residuals relative to the largest eigenvalue; further passes that are worth waiting for.
EXTRA, TOLERANCE, PATIENCE = 12, 1e-13, 12
#: Eigenvalues below this share of the trace are rounding.
NO_VARIANCE = 1e-13
COLUMNS = {"component": "int", "n": "bigint", "deviation": "decimal(38,0)", "whitened": "double", "explained": "double", "identity_error": "double"}


@dataclass(frozen=True)
class Whitener:
    n: int
    sums: list[int]  # per dimension
    peak: int
    mean: np.ndarray
    components: np.ndarray  # (width, k), unit columns
    eigenvalues: np.ndarray
    explained: np.ndarray
    residuals: np.ndarray  # relative to the largest eigenvalue
    passes: int
    block: int  # columns of the last pass
    identity_error: float


def fit_list(rows: DataFrame, wide: int) -> DataFrame:
    """Each distinct x vector once, in stored blocks."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = V.integers(batch["vector"], SCALE, wide).astype("<i8")
            ends = np.arange(len(x) + 1, dtype=np.int32) * (8 * wide)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x.tobytes())])], ["x"])

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(batch["x"].to_pylist()), "<i8").reshape(batch.num_rows, wide)

    once = rows.select("vector").mapInArrow(C.trimmed(packed), "x binary").distinct()
    return C.stored(once.mapInArrow(C.trimmed(lambda b: V.as_blocks(b, rows_of, False)), V.BLOCK_SCHEMA), "whitening-blocks")


def _exact(blocks: DataFrame, wide: int, peak: int) -> tuple[int, list[int], int]:
    """Rows, sums by dimension, and the sum of all squares, as Python's integers."""
    fits = V.BLOCK_ROWS * wide * peak * peak < 1 << 63

    def add(done: tuple | None, data: np.ndarray, rows: int) -> tuple:
        x = data.reshape(rows, wide) if fits else data.reshape(rows, wide).astype(object)
        n, sums, squares = done or (0, np.zeros(wide, object), 0)
        return n + rows, sums + x.sum(axis=0).astype(object), squares + int((x * x).sum())

    n, sums, squares = V.tree_sum(blocks, add, lambda a, b: (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
    return n, [int(s) for s in sums], squares


def _product(blocks: DataFrame, mean: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """V q, from one pass."""
    sc = blocks.sparkSession.sparkContext
    held = sc.broadcast((mean, q))  # width x block

    def add(done: np.ndarray | None, data: np.ndarray, rows: int) -> np.ndarray:
        mean, q = held.value
        x = data.reshape(rows, len(mean)) - mean
        own = x.T @ (x @ q)
        return own if done is None else done + own

    out = V.tree_sum(blocks, add, lambda a, b: a + b) / n
    held.destroy()
    return out


def _iterate(blocks: DataFrame, mean: np.ndarray, n: int, k: int, extra: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Eigenvalues, components, relative residuals, passes and the last block's columns."""
    wide = len(mean)
    random = np.random.default_rng(13)
    q = np.linalg.qr(random.standard_normal((wide, min(wide, k + extra))))[0]
    was, passes = math.inf, 0
    while True:
        vq = _product(blocks, mean, q, n)
        passes += 1
        t = q.T @ vq
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, image = q @ turn, vq @ turn
        residuals = np.linalg.norm(image - ritz * values, axis=0)[:k] / max(values[0], np.finfo(float).tiny)
        now = residuals.max(initial=0.0)
        if now <= TOLERANCE or q.shape[1] == wide:
            return values[:k], ritz[:, :k], residuals, passes, q.shape[1]
        more = math.inf if now >= was else math.log(now / TOLERANCE) / math.log(was / now) if was < math.inf else 0
        block = image
        if more > PATIENCE:
            block = np.c_[image, random.standard_normal((wide, min(q.shape[1], wide - q.shape[1]))) * values[0]]
            now = math.inf  # a new block's rate is not known yet
        was = now
        q = np.linalg.qr(block)[0]


def fit(rows: DataFrame, vector: str = "embedding", k: int = COMPONENTS, extra: int = EXTRA) -> Whitener | None:
    """The first k components and what whitening needs; None for a table without vectors."""
    some = V.kept(rows, vector)
    wide = V.width(some)
    blocks = fit_list(some, wide)
    peak = blocks.agg(F.max("peak")).first()[0]
    if peak is None:
        return None
    n, sums, squares = _exact(blocks, wide, peak)
    mean = np.array([s / n for s in sums], float)
    trace = (n * squares - sum(s * s for s in sums)) / (n * n)
    k = min(k, wide)
    if trace == 0 or not k:
        empty = np.zeros(0)
        return Whitener(n, sums, peak, mean, np.zeros((wide, 0)), empty, empty, empty, 0, 0, 0.0)
    values, components, residuals, passes, block = _iterate(blocks, mean, n, k, extra)
    real = values > NO_VARIANCE * trace
    values, components, residuals = values[real], components[:, real], residuals[real]

    def add(done: tuple | None, data: np.ndarray, rows: int) -> tuple:
        w = (data.reshape(rows, wide) - mean) @ components / np.sqrt(values)
        own = w.sum(axis=0), w.T @ w
        return own if done is None else (done[0] + own[0], done[1] + own[1])

    first, second = V.tree_sum(blocks, add, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    covariance = second / n - np.outer(first / n, first / n)
    return Whitener(n, sums, peak, mean, components, values, values / trace, residuals, passes, block, float(np.abs(covariance - np.eye(len(values))).max(initial=0.0)))


def whiten(rows: DataFrame, by: Whitener, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A row for each vector and component: key, component, n, deviation (exact), whitened, explained, identity_error."""
    n, sums, k, wide = by.n, by.sums, len(by.eigenvalues), len(by.sums)

    def deviations(x: np.ndarray) -> list[Decimal | None]:
        bound = n * max(V.peak(x), by.peak) + max(map(abs, sums), default=0)
        if wide * bound * bound < 1 << 63:
            d = n * x - np.array(sums, np.int64)
            return [Decimal(v) for v in (d * d).sum(axis=1).tolist()]
        d = n * x.astype(object) - np.array(sums, object)
        return [Decimal(int(v)) if v < 10**38 else None for v in (d * d).sum(axis=1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not k:
                return
            x = V.integers(batch["vector"], SCALE, wide)
            w = (x - by.mean) @ by.components / np.sqrt(by.eigenvalues)
            at = np.repeat(np.arange(len(x)), k)
            dev = deviations(x)
            each = lambda v: np.tile(v, len(x))
            cols = [batch[key].take(pa.array(at)), pa.array(each(np.arange(1, k + 1, dtype=np.int32))), pa.array(np.full(len(at), n, np.int64)), pa.array([v for v in dev for _ in range(k)], pa.decimal128(38, 0)), pa.array(w.ravel()), pa.array(each(by.explained)), pa.array(np.full(len(at), by.identity_error))]
            yield pa.RecordBatch.from_arrays(cols, [key, *COLUMNS])

    kind = rows.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}", *(f"{c} {t}" for c, t in COLUMNS.items())])
    return V.kept(rows, vector, key).mapInArrow(C.trimmed(run), schema)


def whitened(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    by = fit(rows, vector)
    if by is None:
        return rows.select(key, *(F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items())).limit(0)
    return whiten(rows, by, key, vector)
