"""The metric index against all pairs."""

import collections
import math
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.operators import dedup, neighbours
from concord.sources import tables

SCHEMA = "id long, v array<float>"


def plain_edges(rows, k, threshold):
    units = {}
    for i, v in rows:
        if v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v):
            units.setdefault(tuple(np.float32(v).astype(float)), []).append(i)
    x = np.array(list(units))
    x /= np.sqrt((x * x).sum(1))[:, None]
    keys = list(units.values())
    sim = np.zeros((len(x), len(x)))
    for d in range(x.shape[1]):
        sim += np.outer(x[:, d], x[:, d])
    out = {}
    for n, own in enumerate(keys):
        ranked = sorted((-round(sim[n, m], 12), i) for m in range(len(x)) if sim[n, m] > threshold for i in keys[m])
        for a in own:
            for s, b in [r for r in ranked if r[1] != a][: k - 1]:
                out[min(a, b), max(a, b)] = -s
    return out


def check(spark, rows, k, threshold, pivots=4, size=16, key=lambda i: i, schema=SCHEMA):
    df = spark.createDataFrame([(key(i), v) for i, v in rows], schema).repartition(5)
    index = neighbours.build(df, "id", "v", k, pivots, size)
    got = {(r["a"], r["b"]): round(r["sim"], 12) for r in neighbours.edges(index, k, threshold).collect()}
    expected = plain_edges([(key(i), v) for i, v in rows], k, threshold)
    assert got.keys() == expected.keys()
    assert all(abs(got[p] - expected[p]) < 1e-9 for p in got)
    return index


def clusters(n, groups, d, spread, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    return [(i, [float(np.float32(x)) for x in centres[i % groups] + spread * rng.standard_normal(d)]) for i in range(n)]


def test_clustered_vectors_prune(spark):
    rows = clusters(600, 8, 6, 0.05)
    index = check(spark, rows, 6, 0.95)
    r = neighbours.report(index, 0.95).first()
    assert r["n_vectors"] == 600 and r["n_pairs"] == 600 * 599 // 2
    assert r["share"] < 0.5
    met = {(x["a"], x["b"]) for x in neighbours.block_pairs(index, 0.95).collect()}
    assert met <= {(x["a"], x["b"]) for x in neighbours.block_pairs(index, 0.5).collect()}


def test_unstructured_vectors(spark):
    rng = np.random.default_rng(2)
    check(spark, [(i, [float(np.float32(x)) for x in rng.standard_normal(16)]) for i in range(300)], 10, 0.4)


def test_copies_ties_and_odd_rows(spark):
    rows = clusters(150, 5, 4, 0.02, 1)
    rows += [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(200)]  # a very common vector
    rows += [(2000 + i, [2.0, 0.0, 0.0, 0.0]) for i in range(40)]  # the same direction
    rows += [(3000 + i, [0.9, 0.1 * (-1) ** i, 0.0, 0.0]) for i in range(30)]  # ties
    rows += [(5000, None), (5001, [None, 1.0, 1.0, 1.0]), (5002, [math.nan] * 4), (5003, [0.0] * 4), (5004, [math.inf] * 4), (5005, [])]
    random.Random(3).shuffle(rows)
    # equal directions of other lengths are one vector to the index
    as_units = [(i, [x / (max(map(abs, v)) or 1) for x in v] if v and i >= 2000 and i < 2040 else v) for i, v in rows]
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = {(r["a"], r["b"]) for r in neighbours.edges(neighbours.build(df, "id", "v", 7, 4, 16), 7, 0.9).collect()}
    assert got == set(plain_edges(as_units, 7, 0.9))
    degree = collections.Counter(x for p in got for x in p)
    assert not any(k >= 5000 for k in degree)


def test_string_keys_and_small_tables(spark):
    rows = clusters(90, 4, 5, 0.05, 4)
    check(spark, rows, 4, 0.9, key=lambda i: f"id{i:03}", schema="id string, v array<float>")
    check(spark, rows[:1], 4, 0.9)
    empty = spark.createDataFrame([], SCHEMA)
    assert dedup.knn_edges(empty, "id", "v").collect() == []
    with pytest.raises(ValueError, match="one width"):
        neighbours.build(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], SCHEMA), "id", "v", 3)


def test_no_nested_loop_join(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("sim", F.lit(1))
    plan = dedup.knn_edges(df, "vec_id", "embedding", threshold=0.4)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def watched(monkeypatch):
    """What `stored` writes, by name."""
    seen, real = {}, neighbours.stored
    monkeypatch.setattr(neighbours, "stored", lambda df, name: seen.setdefault(name, []).append(df) or real(df, name))
    return seen


def test_disk_does_not_grow_with_pairs_of_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(600)]
    seen = watched(monkeypatch)
    index = check(spark, rows, 4, 0.1)
    assert neighbours.block_pairs(index, 0.1).count() > 400  # nearly all pairs of 38 blocks or more
    met = seen["found"][0]
    assert "Exchange" not in met._jdf.queryExecution().executedPlan().toString()  # no block is shipped
    parts = index.blocks.rdd.getNumPartitions()
    assert 600 * 4 <= met.count() <= 600 * 4 * max(parts, 12)
    assert met.rdd.getNumPartitions() <= max(parts, 12)


@pytest.mark.parametrize("meets", [0, 10_000])
@pytest.mark.parametrize("held", [1, 100, 3_000_000])
def test_both_ways_of_blocks_and_any_memory(spark, monkeypatch, meets, held):
    monkeypatch.setattr(neighbours, "MEETS", meets)
    monkeypatch.setattr(neighbours, "HELD", held)
    monkeypatch.setattr(neighbours, "MANY", 1)
    rows = clusters(160, 5, 4, 0.05, 6) + [(1000 + i, [1.0, 0.0, 0.0, 0.0]) for i in range(30)] + [(3000 + i, [0.9, 0.1 * (-1) ** i, 0.0, 0.0]) for i in range(20)]
    check(spark, rows, 5, 0.8)


def test_ties_between_blocks_go_to_the_smallest_key(spark):
    rows = [(0, [1.0, 0.0, 0.0])] + [(1 + i, [0.8, 0.6 * math.cos(i / 7), 0.6 * math.sin(i / 7)]) for i in range(40)]
    unit = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    spread = [(i, v) for i, v in unit] + [(100 + i, [v[0], -v[1], v[2]]) for i, v in unit[1:]] + [(200 + i, [v[0], v[1], -v[2]]) for i, v in unit[1:]]
    check(spark, spread, 6, 0.5, pivots=2, size=8)


def test_components_of_vectors_without_structure(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(400)]
    seen = watched(monkeypatch)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    edges = neighbours.edges(neighbours.build(df, "id", "v", 3, 4, 16), 3, 0.5)
    got = {r["id"]: r["comp"] for r in dedup.components(df, edges, "id").collect()}
    above = {i: i for i, _ in rows}

    def top(i):
        while above[i] != i:
            i = above[i]
        return i

    for a, b in plain_edges(rows, 3, 0.5):
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    assert got == {i: top(i) for i, _ in rows}
    assert "Exchange" not in seen["found"][0]._jdf.queryExecution().executedPlan().toString()


def test_only_blocks_keep_vectors(spark, sf_dir, monkeypatch):
    seen = watched(monkeypatch)
    real, wide = neighbours.dropped, []
    monkeypatch.setattr(neighbours, "dropped", lambda df: wide.append(df.columns) or real(df))
    check(spark, clusters(120, 4, 5, 0.05, 9), 4, 0.9)
    assert wide == [["key", "unit", "vid"], ["vid", "unit", "ids"]]
    kept = {name for name, (df, *_) in seen.items() if {"unit", "data"} & {*df.columns}}
    assert kept - {"units", "unit-vectors"} == {"blocks"}
    with pytest.raises(ValueError, match="scratch"):
        real(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def test_components_leave_only_labels(spark, monkeypatch):
    seen, real = [], tables.scratch
    monkeypatch.setattr(tables, "scratch", lambda spark, name: seen.append(real(spark, name)) or seen[-1])
    rows = clusters(300, 6, 8, 0.2, 10) + [(1000 + i, [1.0] * 8) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = {r["id"]: r["comp"] for r in dedup.components(df, neighbours.edges(neighbours.build(df, "id", "v", 4), 4, 0.9), "id").collect()}
    assert 6 < len(set(expected.values())) < 300
    seen.clear()
    found = dedup.near_components(df, "id", "v", 4, 0.9)
    left = [p.rsplit("/", 1)[1].split("-")[1] for p in seen if os.path.exists(p)]
    assert {*left} <= {"labels", "nodes", "block"} and left.count("labels") == 1  # the last labels, and the boxes of blocks
    assert {r["id"]: r["comp"] for r in found.collect()} == expected


def test_blocks_keep_the_precision_of_the_vectors(spark):
    rows = clusters(100, 4, 6, 0.05, 11)
    single = check(spark, rows, 4, 0.9)
    double = check(spark, rows, 4, 0.9, schema="id long, v array<double>")
    size = lambda index: index.blocks.agg(F.sum(F.octet_length("data"))).first()[0]
    assert size(single) == 100 * 6 * 4 and size(double) == 100 * 6 * 8


def test_shuffle_files_go_with_the_write(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    was = spark.conf.get(tables.CLEANUP)
    out = tables.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("x")).count(), "groups")
    for _ in range(50):  # they are deleted in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and out.count() == 7 and spark.conf.get(tables.CLEANUP) == was
