"""Deterministic randomness and the id-set hashes.

Random order is the ascending order of sha256("seed|namespace|key"), a uniform integer its first 8 hex digits modulo n.
Every use has a namespace of its own, so draws do not nest. Bias of the modulo is below n / 2**32.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored


def order_key(seed: Column | int, namespace: str, *key: Column | str) -> Column:
    first = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    return F.sha2(F.concat_ws("|", first, F.lit(namespace), *(F.col(k) if isinstance(k, str) else k for k in key)), 256)


def as_integer(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform_int(n: Column | int, seed: Column | int, namespace: str, *key: Column | str) -> Column:
    return as_integer(order_key(seed, namespace, *key)) % (F.lit(n) if isinstance(n, int) else n)


def stable_seed(name: Column, base: int) -> Column:
    """A seed from a name: the first 8 hex digits of its SHA-256, moved by base, modulo 2**32 - 1."""
    return (as_integer(F.sha2(name, 256)) + F.lit(base)) % F.lit(4294967295)


#: How ids are joined for a set's hash: separator, end, whether they are sorted.
ID_SET_STYLES = {"construction": (",", "", True), "training_order": ("\n", "\n", False), "training_sorted": ("\n", "\n", True)}


def id_set_hash(df: DataFrame, id_col: str, style: str = "construction", by: tuple[str, ...] = (), position: str | None = None) -> DataFrame:
    """SHA-256 of a set of ids, per group of `by`. The set must be small enough for one string (its ids are joined)."""
    sep, end, ordered = ID_SET_STYLES[style]
    ids = F.col(id_col).cast("string")
    if ordered:
        joined = F.array_join(F.array_sort(F.collect_list(ids)), sep)
    else:
        if position is None:
            raise ValueError("training_order needs a position column")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), ids.alias("i")))), lambda x: x["i"]), sep)
    return df.groupBy(*by).agg(F.sha2(F.concat(joined, F.lit(end)), 256).alias("set_sha256"), F.count(F.lit(1)).alias("n_ids"))


def fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: row count and an order-free digest of the content (xor and sum of 64-bit row hashes), for tables of any size."""
    row = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in [key, *columns]))
    return df.select(row.alias("h")).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor("h").alias("xor_hash"), F.sum(F.col("h").cast("decimal(38,0)")).cast("string").alias("sum_hash"))


def ordered_fingerprint(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """SHA-256 over the CSV lines of all rows sorted by key (then line), for tables of any size.

    Lines are sorted in ranges of the key by all tasks, which join them to pieces of about `PIECE` bytes. A digest goes over its bytes from first to last, so one
    task reads the pieces in order; it holds one batch of them and the digest's state, and its sort spills."""
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    line = F.concat_ws(",", *(quote(c) for c in [key, *columns]))
    rows = df.select(F.col(key).cast("string").alias("k"), line.alias("l"))
    ranged = stored(rows.sort("k", "l").select("l", F.spark_partition_id().alias("part")).mapInArrow(_pieces, "part int, seq bigint, n bigint, data binary"), "pieces")
    one = ranged.repartition(1).sortWithinPartitions("part", "seq").mapInArrow(_digest, "sha256 string, n_rows bigint")
    empty = hashlib.sha256(b"\n").hexdigest()
    return one.agg(F.coalesce(F.max("sha256"), F.lit(empty)).alias("sha256"), F.coalesce(F.max("n_rows"), F.lit(0)).alias("n_rows"))


#: Bytes of lines that go into one piece, about.
PIECE = 1 << 16


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, seq = ["part", "seq", "n", "data"], 0
    for b in batches:
        lines = b["l"].to_pylist()
        for a, e in _runs(lines):
            data = "".join(f"{x}\n" for x in lines[a:e]).encode()
            yield pa.RecordBatch.from_arrays([pa.array([b["part"][0].as_py()], pa.int32()), pa.array([seq]), pa.array([e - a]), pa.array([data], pa.binary())], names)
            seq += 1


def _runs(lines: list[str]) -> Iterator[tuple[int, int]]:
    a = size = 0
    for e, x in enumerate(lines):
        size += len(x) + 1
        if size >= PIECE:
            yield a, e + 1
            a, size = e + 1, 0
    if a < len(lines):
        yield a, len(lines)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    state, n = hashlib.sha256(), 0
    for b in batches:
        for data in b["data"]:
            state.update(data.as_buffer())
        n += sum(b["n"].to_pylist())
    if n:
        yield pa.RecordBatch.from_arrays([pa.array([state.hexdigest()]), pa.array([n])], ["sha256", "n_rows"])
