"""Exact cosine neighbours by a metric index, without comparing all pairs where distances rule pairs out.

Angles between vectors obey the triangle inequality: with d(x, p) and d(y, p) to a pivot p, d(x, y) >= |d(x, p) - d(y, p)|. Distinct unit vectors are sorted by their nearest
pivot and the ring around it (their angle to it) and cut into blocks, each with the interval of its angles to every pivot; blocks
form a tree whose nodes have their children's intervals joined. Pairs of nodes are followed down from the root, level by level, and dropped as soon as one
pivot's intervals lie further apart than the threshold's angle. Only blocks of pairs that survive meet, as two matrices; a
task keeps each vector's best few over all pairs that it sees, so a few rows a vector leave a task, and the lists of tasks merge to the result.
Where most pairs survive, tasks read the blocks from the shared folder instead of getting them by a shuffle: disk grows with the vectors, time with the pairs.
Vectors are kept in the precision that they came in and become unit vectors where they are read; each step's scratch table goes once the next one is written.

Nothing is approximate: pruning only drops pairs that can't pass the threshold. How much it drops depends on the data: in many dimensions without
structure all angles to a pivot are alike, and most pairs remain (`report` says how many); what is left then is blocked matrix products. Equal vectors are one vector with its smallest
keys, so that a vector that a third of all rows share costs no more than any other; blocks have at most `rows` vectors
however many lie in a ring.

Vectors that are null, empty, of length zero or hold null or non-finite components have no neighbours.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import dropped, replaced, stored

#: Pivots; vectors to a block; blocks to a range partition, about; children of a node above the partitions.
PIVOTS, ROWS, BLOCKS, FAN = 16, 1024, 16, 16
#: Vectors from which pivots are chosen; radians and cosine that rounding can't reach.
SAMPLE, SLACK, NEAR = 2048, 1e-6, 1e-9
#: Blocks that a block meets on average, at most, for blocks to travel to their pairs; candidates of a row from which a pair of blocks ranks them first.
MEETS, MANY = 4, 16
#: Neighbours that a task keeps until it hands them on; places in a block.
HELD, PLACES = 3_000_000, 1 << 20


@dataclass(frozen=True)
class Index:
    rows: DataFrame  # key, at (the place of its vector: its block's and its own there)
    blocks: DataFrame  # block, n, ids (of each vector its smallest keys, ascending), data (vectors, row after row), lo<j>, hi<j>
    levels: list[DataFrame]  # leaves first: node, parent, lo<j>, hi<j>
    pivots: int
    wide: int
    dtype: str  # of data


def _dtype(vectors: DataFrame, vector: str) -> str:
    return "<f4" if vectors.schema[vector].dataType.elementType.simpleString() == "float" else "<f8"


def _normed(data: bytes, wide: int, dtype: str) -> np.ndarray:
    """The unit vectors of vectors in a row. Squares are added up in one order, so that a vector has the same one wherever it is read."""
    x = np.frombuffer(data, dtype).astype(np.float64).reshape(-1, wide)
    x /= np.abs(x).max(1, initial=0.0)[:, None]  # squares of huge or tiny components stay finite
    s = np.zeros(len(x))
    for d in range(wide):
        s += x[:, d] * x[:, d]
    x /= np.sqrt(s)[:, None]
    return x + 0.0


def _units(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """key, unit (the vector's bytes as given, from which `_normed` makes the unit vector), vid (a hash of the unit vector) of vectors that have a direction."""
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))
    dtype = _dtype(vectors, vector)
    x = F.col(vector) if dtype == "<f4" else F.transform(F.col(vector), lambda v: v.cast("double"))
    rows = vectors.where(F.col(vector).isNotNull() & ~F.exists(F.col(vector), odd) & F.exists(F.col(vector), lambda v: v != 0)).select(F.col(key).alias("key"), x.alias("x"))
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [v.astype(dtype).tobytes() for v in b["x"].to_numpy(zero_copy_only=False)]
            vids = [b""] * len(raw)
            for size in {*map(len, raw)}:  # one, as a rule
                at = [i for i, r in enumerate(raw) if len(r) == size]
                for i, u in zip(at, _normed(b"".join(raw[i] for i in at), size // int(dtype[2]), dtype), strict=True):
                    vids[i] = hashlib.md5(u.astype("<f8").tobytes(), usedforsecurity=False).digest()
            yield pa.RecordBatch.from_arrays([b["key"], pa.array(raw, pa.binary()), pa.array(vids, pa.binary())], ["key", "unit", "vid"])

    return rows.mapInArrow(run, f"key {kind}, unit binary, vid binary")


def _distinct(units: DataFrame, k: int) -> DataFrame:
    """vid, unit, ids: each distinct unit vector with its k smallest keys. Batches keep the k smallest of each before anything is shuffled."""

    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, vids = b["key"].to_pylist(), b["vid"].to_pylist()
            seen: dict = {}
            keep = []
            for i in sorted(range(len(ids)), key=ids.__getitem__):
                seen[vids[i]] = seen.get(vids[i], 0) + 1
                if seen[vids[i]] <= k:
                    keep.append(i)
            yield b.take(pa.array(sorted(keep), pa.int64()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in units.schema)
    rank = F.row_number().over(Window.partitionBy("vid").orderBy("key"))
    best = units.where("key IS NOT NULL").mapInArrow(few, schema).withColumn("rank", rank).where(F.col("rank") <= k)
    return best.groupBy("vid").agg(F.first("unit").alias("unit"), F.array_sort(F.collect_list("key")).alias("ids"))  # k at most


def _pivots(vectors: DataFrame, pivots: int, wide: int, dtype: str) -> np.ndarray:
    """Vectors far from each other, from a sample that does not grow."""
    rows = vectors.orderBy("vid").limit(SAMPLE).select("unit").toArrow()["unit"].to_pylist()
    if not rows:
        return np.zeros((0, 0))
    x = _normed(b"".join(rows), wide, dtype)
    chosen = [0]
    far = x @ x[0]
    while len(chosen) < min(pivots, len(x)):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, x @ x[chosen[-1]])
    return x[chosen]


def build(vectors: DataFrame, key: str, vector: str, k: int, pivots: int = PIVOTS, rows: int = ROWS) -> Index:
    """The index of all vectors; `vectors` keep k keys each. Of the stored vectors only those in blocks stay."""
    dtype = _dtype(vectors, vector)
    units = stored(_units(vectors, key, vector), "units")
    distinct = stored(_distinct(units, k), "unit-vectors")
    keys = stored(units.select("key", "vid"), "keys")
    dropped(units)
    n, wide, least = distinct.agg(F.count(F.lit(1)), F.max(F.octet_length("unit")), F.min(F.octet_length("unit"))).first()
    if wide != least:
        raise ValueError("the vectors of an index have one width")
    wide = (wide or 0) // int(dtype[2])
    at = _pivots(distinct, pivots, wide, dtype)
    p = len(at)

    def to_pivots(units: list[bytes]) -> np.ndarray:
        return np.arccos(np.clip(_normed(b"".join(units), wide, dtype) @ at.T, -1, 1))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = to_pivots(b["unit"].to_pylist())
            yield pa.RecordBatch.from_arrays([b["vid"], b["unit"], b["ids"], pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1))], ["vid", "unit", "ids", "cell", "ring"])

    kind = units.schema["key"].dataType.simpleString()
    ringed = distinct.select("vid", "unit", "ids")
    if p:
        ringed = ringed.mapInArrow(angles, f"vid binary, unit binary, ids array<{kind}>, cell int, ring double")
    else:
        ringed = ringed.select("*", F.lit(0).alias("cell"), F.lit(0.0).alias("ring"))
    parts = max(1, -(-n // (rows * BLOCKS)))
    dealt = ringed.repartitionByRange(parts, "cell", "ring", "vid").sortWithinPartitions("cell", "ring", "vid").withColumn("part", F.spark_partition_id())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of at most `rows` vectors of one cell; within a block vectors are in the order of their first key."""
        held: list[pa.RecordBatch] = []
        count = 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            first = [ids[0] for ids in t["ids"].to_pylist()]
            t = t.take(pa.array(sorted(range(t.num_rows), key=first.__getitem__), pa.int64()))
            units = t["unit"].to_pylist()
            d = to_pivots(units)
            one = {"part": [t["part"][0].as_py()], "seq": [count], "n": [t.num_rows], "vids": [t["vid"].to_pylist()], "ids": [t["ids"].to_pylist()], "data": [b"".join(units)]}
            one |= {f"lo{j}": [float(d[:, j].min())] for j in range(p)} | {f"hi{j}": [float(d[:, j].max())] for j in range(p)}
            return pa.RecordBatch.from_pydict(one, schema=arrow)

        cell = None
        for b in batches:
            cells = b["cell"].to_pylist()
            a = 0
            while a < len(cells):
                if held and (cells[a] != cell or sum(h.num_rows for h in held) == rows):
                    yield block()
                    held, count = [], count + 1
                cell = cells[a]
                e, room = a, rows - sum(h.num_rows for h in held)
                while e < len(cells) and cells[e] == cell and e - a < room:
                    e += 1
                held.append(b.slice(a, e - a))
                a = e
        if held:
            yield block()

    fields = [("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int32()), ("vids", pa.list_(pa.binary())), ("ids", pa.list_(ringed.limit(0).toArrow().schema.field("ids").type)), ("data", pa.binary()), *((f"{s}{j}", pa.float64()) for s in ("lo", "hi") for j in range(p))]
    arrow = pa.schema(fields)
    box = "".join(f", {s}{j} double" for s in ("lo", "hi") for j in range(p))
    blocks = dealt.mapInArrow(cut, f"part int, seq int, n int, vids array<binary>, ids array<array<{kind}>>, data binary{box}")
    blocks = stored(blocks.withColumn("block", F.col("part").cast("bigint") * (1 << 24) + F.col("seq")), "blocks")
    dropped(distinct)
    places = blocks.select("block", F.posexplode("vids").alias("j", "vid")).select((F.col("block") * PLACES + F.col("j")).alias("at"), "vid")
    keys = replaced(keys.join(places, "vid").select("key", "at"), "places", keys)
    sides = [F.min(f"lo{j}").alias(f"lo{j}") for j in range(p)] + [F.max(f"hi{j}").alias(f"hi{j}") for j in range(p)]
    names = [f"{s}{j}" for s in ("lo", "hi") for j in range(p)]
    levels = [blocks.select(F.col("block").alias("node"), F.col("part").cast("bigint").alias("parent"), *names)]
    top = max(parts - 1, 0)
    while True:
        own = stored(levels[-1].groupBy(F.col("parent").alias("node")).agg(F.lit(0).alias("__x"), *sides).drop("__x"), "nodes")
        levels.append(own.withColumn("parent", F.floor(F.col("node") / FAN)))
        if top == 0:
            return Index(keys, blocks.select("block", "n", "ids", "data", *names), levels, p, wide, dtype)
        top //= FAN


def block_pairs(index: Index, threshold: float) -> DataFrame:
    """(a, b), a <= b: blocks that can hold a pair above the threshold, from the root down. Every step is a join on the parent."""
    widest = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    root = index.levels[-1]
    pairs = root.select(F.col("node").alias("a"), F.col("node").alias("b"))
    for level in reversed(index.levels[:-1]):
        side = lambda s: level.select(F.col("parent").alias(s), F.col("node").alias(f"child_{s}"), *(F.col(f"{x}{j}").alias(f"{x}{j}{s}") for x in ("lo", "hi") for j in range(index.pivots)))  # noqa: B023, E731
        apart = [F.greatest(F.col(f"lo{j}a") - F.col(f"hi{j}b"), F.col(f"lo{j}b") - F.col(f"hi{j}a")) <= widest for j in range(index.pivots)]
        both = pairs.join(side("a"), "a").join(side("b"), "b").where("child_a <= child_b")
        for near in apart:
            both = both.where(near)
        pairs = stored(both.select(F.col("child_a").alias("a"), F.col("child_b").alias("b")), "block-pairs")
    return pairs


def report(index: Index, threshold: float) -> DataFrame:
    """One row: distinct vectors, blocks, pairs of vectors, those in pairs of blocks that meet, and their share."""
    size = index.blocks.select("block", F.col("n").cast("bigint").alias("n"))
    met = block_pairs(index, threshold).join(size.select(F.col("block").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("block").alias("b"), F.col("n").alias("nb")), "b")
    compared = met.agg(F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))), F.lit(0)).cast("bigint").alias("n_compared"))
    total = size.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_vectors"), F.count(F.lit(1)).alias("n_blocks"))
    pairs = total.withColumn("n_pairs", (F.col("n_vectors") * (F.col("n_vectors") - 1) / 2).cast("bigint"))
    return pairs.crossJoin(F.broadcast(compared)).withColumn("share", F.try_divide(F.col("n_compared"), F.col("n_pairs")))  # single rows


def _best(x: np.ndarray, y: np.ndarray, low: np.ndarray, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, cosine) of pairs above the threshold that can be among the k best of a row whose k-th best so far is `low`: no fewer than its k best, and ties.

    Products in single precision only rule pairs out, by more than they can be wrong; cosines are added up in one order for every pair, so that equal pairs are equal."""
    wrong = NEAR + 2.4e-7 * (x.shape[1] + 4)
    sim = x.astype(np.float32) @ y.astype(np.float32).T
    floor = (np.maximum(low, threshold) - wrong).astype(np.float32)
    some = sim >= floor[:, None]
    if sim.shape[1] > k and np.count_nonzero(some) > MANY * len(sim):
        floor = np.maximum(floor, np.partition(sim, sim.shape[1] - k, axis=1)[:, sim.shape[1] - k] - np.float32(2 * wrong))
        some = sim >= floor[:, None]
    i, j = np.divmod(np.flatnonzero(some), sim.shape[1])
    s = np.zeros(len(i))
    for d in range(x.shape[1]):
        s += x[i, d] * y[j, d]
    keep = (s > threshold) & (s >= low[i])
    return i[keep], j[keep], s[keep]


class _Lists:
    """The best k so far of the vectors of one block: row, cosine and key, by row and then best first."""

    def __init__(self, n: int, k: int):
        self.k, self.low = k, np.full(n, -np.inf)  # low: the k-th best cosine of each row
        self.row, self.sim, self.key = np.zeros(0, np.int64), np.zeros(0), None

    def add(self, i: np.ndarray, s: np.ndarray, j: np.ndarray, ids: pa.ListArray) -> None:
        """Pairs (i, j) of cosine s; ids: the keys of each j."""
        if not len(i):
            return
        at = np.asarray(ids.offsets) - ids.offsets[0].as_py()
        size = (at[1:] - at[:-1])[j]
        ends = np.cumsum(size)
        key = ids.flatten().to_numpy(zero_copy_only=False)[np.repeat(at[j] - ends + size, size) + np.arange(ends[-1])]
        i, s = np.r_[self.row, np.repeat(i, size)], np.r_[self.sim, np.repeat(s, size)]
        key = key if self.key is None else np.concatenate([self.key, key])
        order = np.lexsort((np.unique(key, return_inverse=True)[1], -s, i))
        i = i[order]
        begins = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        place = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)]))
        order = order[place < self.k]
        self.low[i[place == self.k - 1]] = s[order][place[place < self.k] == self.k - 1]
        self.row, self.sim, self.key = i[place < self.k], s[order], key[order]


def _met(index: Index, threshold: float) -> DataFrame:
    """Ordered pairs of blocks (a, b) that can hold a pair above the threshold, with the vectors of both.

    If they are few for each block, blocks travel to their pairs, MEETS times the vectors at most. Else nothing is shuffled: each task reads a part of the
    blocks, and all blocks after it, from the shared folder, so that no disk grows with the pairs; single tasks then go on through all blocks."""
    names = [f"{s}{j}" for s in ("lo", "hi") for j in range(index.pivots)]
    side = lambda s, *more: index.blocks.select(F.col("block").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in more))
    columns = ["a", "data_a", "b", "data_b", "ids_b"]
    pairs = block_pairs(index, threshold)
    both = pairs.unionByName(pairs.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    if both.count() <= MEETS * index.blocks.count():
        return both.join(side("b", "data", "ids"), "b").join(side("a", "data"), "a").select(columns)
    widest = math.acos(max(-1.0, min(1.0, threshold))) + SLACK
    near = F.lit(True)
    for j in range(index.pivots):
        near = near & (F.greatest(F.col(f"lo{j}_a") - F.col(f"hi{j}_b"), F.col(f"lo{j}_b") - F.col(f"hi{j}_a")) <= widest)
    own, others = side("a", "data", *names), side("b", "data", "ids", *names).hint("shuffle_replicate_nl")
    parts = own.rdd.getNumPartitions()
    every = own.join(others, near).select(columns)
    return every.coalesce(max(parts, 3 * every.sparkSession.sparkContext.defaultParallelism))


def neighbours(index: Index, k: int, threshold: float) -> DataFrame:
    """at, sims, keys: its best k above the threshold, those of its own vector included, best first, smallest key on ties. Stored; the index is not read again.

    A vector goes by the place of its block and its place there."""
    wide, dtype, kind = index.wide, index.dtype, index.rows.schema["key"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Lists] = {}
        last = x = None

        def lists() -> Iterator[pa.RecordBatch]:
            for a, own in held.items():
                if own.key is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(a * PLACES + own.row), pa.array(own.sim), pa.array(own.key, keys)], ["at", "sim", "key"])

        for batch in batches:
            keys = batch.schema.field("ids_b").type.value_type.value_type
            for row in range(batch.num_rows):
                r = batch.slice(row, 1)
                a = r["a"][0].as_py()
                if a != last:
                    last, x = a, _normed(r["data_a"][0].as_py(), wide, dtype)
                y = _normed(r["data_b"][0].as_py(), wide, dtype)
                if a not in held and (sum(len(h.low) for h in held.values()) + len(x)) * k > HELD:
                    yield from lists()
                    held = {}
                own = held.setdefault(a, _Lists(len(x), k))
                i, j, s = _best(x, y, own.low, k, threshold)
                own.add(i, s, j, r["ids_b"].flatten())
        yield from lists()

    found = stored(_met(index, threshold).mapInArrow(compare, f"at bigint, sim double, key {kind}"), "found")
    best = F.row_number().over(Window.partitionBy("at").orderBy(F.desc("sim"), "key"))
    near = found.withColumn("rank", best).where(F.col("rank") <= k).groupBy("at").agg(F.array_sort(F.collect_list(F.struct("rank", "sim", "key"))).alias("near"))  # k at most
    return replaced(near.select("at", F.col("near.sim").alias("sims"), F.col("near.key").alias("keys")), "near", found)


def edges(index: Index, k: int, threshold: float) -> DataFrame:
    """(a, b, sim), a < b: pairs one of which is among the k - 1 best others of the other one."""
    near = index.rows.join(neighbours(index, k, threshold), "at")
    others = F.slice(F.filter(F.arrays_zip("sims", "keys"), lambda x: x["keys"] != F.col("key")), 1, k - 1)
    pairs = near.select("key", F.explode(others).alias("o"))
    return pairs.select(F.least("key", "o.keys").alias("a"), F.greatest("key", "o.keys").alias("b"), F.col("o.sims").alias("sim")).groupBy("a", "b").agg(F.max("sim").alias("sim"))


def links(index: Index, k: int, threshold: float) -> DataFrame:
    """(a, b): the pairs of `edges`, some twice, either end first. Stored; only blocks and places of the index stay beside it."""
    near = neighbours(index, k, threshold)
    others = F.slice(F.filter("keys", lambda x: x != F.col("key")), 1, k - 1)
    return replaced(index.rows.join(near.select("at", "keys"), "at").select(F.col("key").alias("a"), F.explode(others).alias("b")), "links", near)
