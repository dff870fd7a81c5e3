"""The sequential matching rule against lists in plain Python, and what it holds in memory."""

import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from concord.operators import greedy, splits

from .test_matching import SCHEMA, order, some_rows


def plain(rows, dose):
    """Injected rows by author and id; each takes the first unused row of its label at the tightest level."""
    out = set()
    for seed in {r["split_seed"] for r in rows}:
        own = [r for r in rows if r["split_seed"] == seed]
        put = []
        for author in {r["author"] for r in own}:
            reserve = [r for r in own if r["author"] == author and r["role"] == "reserve" and r["strict"]]
            if len(reserve) >= dose:
                put += sorted(reserve, key=lambda r: order(seed, "dose", r["id"]))[:dose]
        train, used = sorted((r for r in own if r["role"] == "train"), key=lambda r: order(seed, "match", r["id"])), set()
        for p in sorted(put, key=lambda r: (r["author"], r["id"])):
            hits = ((t["id"], name) for name, cols in splits.LEVELS for t in train if t["id"] not in used and all(t[c] == p[c] for c in cols))
            hit = next(hits, (None, "failed"))
            used.add(hit[0])
            out.add((seed, p["id"], *hit))
    return out


@pytest.mark.parametrize(("seed", "n", "dose", "digits"), [(1, 400, 1, 2), (2, 400, 2, 2), (3, 120, 1, 1), (4, 400, 1, 0), (5, 900, 1, 2)])
def test_sequential_rule_equals_lists(spark, monkeypatch, seed, n, dose, digits):
    """Nulls equal themselves, keys run out at every level, labels have too few rows, and ranges of any width leave the same rows."""
    monkeypatch.setattr(greedy, "DIGITS", digits)
    monkeypatch.setattr(greedy, "BROADCAST_CELLS", 20_000 if seed % 2 else 0)
    rng = random.Random(seed)
    rows = some_rows(n, (42, 123), rng, labels=("x", "x", "x", "y", "z", None))
    rows += [(123, f"e{i}", f"t{i}", "w", rng.choice("abc"), rng.choice([0, 1]), rng.choice("12"), "train", False) for i in range(n)]  # many to take, few to place
    rows += [(123, f"f{i}", f"b{i}", "w", rng.choice("abd"), rng.choice([0, 1, 2]), rng.choice("123"), "reserve", True) for i in range(dose * n // 20)]
    rows = [r for r in rows if r[3] != "z" or r[7] != "train" or rng.random() < 0.3]
    df = spark.createDataFrame(rows, SCHEMA)
    expected = plain([dict(zip(df.columns, r, strict=True)) for r in rows], dose)
    out = splits.exact_greedy_match(df, dose)
    got = [tuple(r) for r in out.select("split_seed", "injected_id", "removed_id", "level").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    if n >= 400:
        assert {level for *_, level in expected} == {"exact", "no_activity", "label_sub", "label_only", "failed"}


def test_keys_that_cannot_run_out_pair_by_rank(spark):
    """No key has more to place than to take: nothing is walked, and rows far behind are left before the sort."""
    rows = [(1, f"t{i}", f"t{i}", "x", "sq"[i % 2], i % 3, "1", "train", False) for i in range(6000)] + [(1, f"r{i}", f"a{i}", "x", "sq"[i % 2], i % 3, "1", "reserve", True) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = splits.exact_greedy_match(df)
    expected = plain([dict(zip(df.columns, r, strict=True)) for r in rows], 1)
    assert {tuple(r) for r in out.collect()} == expected and {r[3] for r in expected} == {"exact"}
    placed = spark.read.parquet(*{f.rsplit("/", 1)[0] for f in out.inputFiles()})
    assert placed.where("open").count() == 0 and 60 <= placed.where("side = 0").count() < 600


def test_no_task_holds_a_label(spark):
    df = spark.createDataFrame(some_rows(60, (42,), random.Random(3)), SCHEMA)
    plan = splits.exact_greedy_match(df)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "author" not in plan  # not the rows of a label as one frame


def test_hot_cell_is_ranked_by_ranges(spark):
    df = spark.createDataFrame(some_rows(200, (42,), random.Random(4), labels=("x",)), SCHEMA)
    plan = splits.exact_greedy_match(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and " at#" in line]
    assert windows and all("__range" in line for line in windows)


def test_walk_holds_cells_not_rows():
    """A million rows of two cells that come in batches: what is held does not grow with them."""
    n, each = 1_000_000, 10_000

    def batch(side, cell, at):
        k = len(at)
        cols = {"split_seed": pa.array([1] * k, pa.int32()), "id": pa.array([f"r{x}" for x in at] if side else [None] * k, pa.string()), "comp": pa.array([7] * k, pa.int64()), "side": pa.array([side] * k, pa.int32())}
        return pa.RecordBatch.from_pydict(cols | {f"g{i}": pa.array([(7, 7, 7, cell)[i]] * k, pa.int64()) for i in range(4)} | {"at": pa.array(at, pa.int64())})

    def batches():
        for cell in (8, 9):
            for a in range(0, n // 2, each):
                yield batch(0, cell, [2 * x + (cell == 9) for x in range(a, a + each)])
        yield batch(1, 8, list(range(2 * n, 2 * n + 3)))
        yield batch(1, 10, list(range(2 * n + 3, 2 * n + 6)))

    tracemalloc.start()
    got = [r for b in greedy.walk([name for name, _ in splits.LEVELS])(batches()) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["at"], r["level"]) for r in got] == [(0, "exact"), (2, "exact"), (4, "exact"), (1, "no_activity"), (3, "no_activity"), (5, "no_activity")]
    assert peak < 6_000_000  # of 8 MB of places, let alone rows


def test_without_rows(spark):
    assert splits.exact_greedy_match(spark.createDataFrame([], SCHEMA)).collect() == []
    one = spark.createDataFrame([(1, "r", "a", "x", None, None, None, "reserve", True)], SCHEMA)
    assert [tuple(r) for r in splits.exact_greedy_match(one).collect()] == [(1, "r", None, "failed")]
    assert splits.exact_greedy_match(one.withColumn("role", F.lit("train"))).collect() == []
