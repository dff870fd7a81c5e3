"""Matching by running totals over hash ranges against ranks in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from concord.operators import feasibility, splits

SCHEMA = "split_seed int, id string, author string, label string, sub string, len_bucket int, ppa_bucket string, role string, strict boolean"
PLACE = ("label", "sub", "len_bucket", "ppa_bucket")


def order(seed, namespace, key):
    return hashlib.sha256(f"{seed}|{namespace}|{key}".encode()).hexdigest(), key


def plain(rows, dose):
    """The set-based rule, written with lists."""
    out = set()
    for seed in {r["split_seed"] for r in rows}:
        own = [r for r in rows if r["split_seed"] == seed]
        left = {0: [r for r in own if r["role"] == "train"], 1: []}
        for author in {r["author"] for r in own}:
            reserve = [r for r in own if r["author"] == author and r["role"] == "reserve" and r["strict"]]
            if len(reserve) >= dose:
                left[1] += sorted(reserve, key=lambda r: order(seed, "dose", r["id"]))[:dose]
        for name, cols in splits.LEVELS:
            groups = {}
            for side in left:
                for r in sorted(left[side], key=lambda r: order(seed, "match", r["id"])):
                    groups.setdefault(tuple(r[c] for c in cols), ([], []))[side].append(r)
            gone = set()
            for train, put in groups.values():
                for t, p in zip(train, put, strict=False):
                    out.add((seed, p["id"], t["id"], name))
                    gone |= {t["id"], p["id"]}
            left = {side: [r for r in left[side] if r["id"] not in gone] for side in left}
        out |= {(seed, r["id"], None, "failed") for r in left[1]}
    return out


def some_rows(n, seeds, rng, labels=("x", "x", "x", "y", None)):
    rows = []
    for seed in seeds:
        for i in range(n):
            role = rng.choice(["train", "reserve", "reserve", "val"])
            author = f"a{rng.randrange(n // 3)}" if role == "reserve" else f"t{i}"
            rows.append((seed, f"p{i}", author, rng.choice(labels), rng.choice(["s", "q", None, "s|q"]), rng.choice([0, 1, None]), rng.choice(["1", "2", ""]), role, rng.random() < 0.9))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_all_doses_equal_plain_ranks(spark, seed):
    rows = some_rows(400, (42, 123), random.Random(seed))
    df = spark.createDataFrame(rows, SCHEMA)
    names = df.columns
    got = splits.matched_doses(df, (1, 2, 3)).collect()
    for dose in (1, 2, 3):
        expected = plain([dict(zip(names, r, strict=True)) for r in rows], dose)
        mine = [(r.split_seed, r.injected_id, r.removed_id, r.level) for r in got if r.dose == dose]
        assert len(mine) == len(set(mine)) and set(mine) == expected
        assert {level for *_, level in expected} >= {"exact", "no_activity", "label_sub", "label_only"}
    single = {(r.split_seed, r.injected_id, r.removed_id, r.level) for r in splits.matched_substitution(df, 2).collect()}
    assert single == plain([dict(zip(names, r, strict=True)) for r in rows], 2)


def test_more_injected_than_training_rows_fail(spark):
    rows = [(1, f"r{i}", f"a{i}", "x", "s", 0, "1", "reserve", True) for i in range(9)] + [(1, f"t{i}", f"t{i}", "x", "q", 1, "2", "train", False) for i in range(4)]
    got = [r.level for r in splits.matched_substitution(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == ["failed"] * 5 + ["label_only"] * 4


def test_without_reserve_or_training_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert splits.matched_doses(empty, (1, 2)).collect() == []
    train = spark.createDataFrame([(1, "t", "a", "x", "s", 0, "1", "train", False)], SCHEMA)
    assert splits.matched_substitution(train).collect() == []
    probe = feasibility.dose_probe(train, (1, 2)).orderBy("dose").collect()
    assert [(r.dose, r.n_train, r.n_injected, r.n_failed) for r in probe] == [(1, 1, 0, 0), (2, 1, 0, 0)]


def test_ranks_are_cut_by_ranges(spark):
    """Every window that sees rows is partitioned by the range of the hash too."""
    df = spark.createDataFrame(some_rows(60, (42,), random.Random(3)), SCHEMA)
    rows = df.withColumn("h", F.sha2("id", 256)).withColumn("key", F.to_json(F.struct(*PLACE[:1])))
    plan = splits.running_totals(rows, "h", "id", {"n": F.lit(1).cast("bigint")}, ["split_seed", "key"])._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and " h#" in line]  # the others see totals of ranges
    assert windows and all("__range" in line for line in windows)


def test_dose_probe_counts_what_matching_pairs(spark):
    """Levels come from counts of cells; none of the rows is matched, so the plan of the probe has no shuffle of rows for each level."""
    rows = some_rows(500, (42, 123), random.Random(9))
    df = spark.createDataFrame(rows, SCHEMA)
    probe = feasibility.dose_probe(df, (1, 2, 3))
    pairs = splits.matched_doses(df, (1, 2, 3)).groupBy("split_seed", "dose", "level").count().collect()
    n = {(r["split_seed"], r["dose"], r["level"]): r["count"] for r in pairs}
    for r in probe.collect():
        at = (r["split_seed"], r["dose"])
        injected = sum(c for k, c in n.items() if k[:2] == at)
        assert (r["n_injected"], r["n_failed"]) == (injected, n.get((*at, "failed"), 0))
        assert [round(r[f"{x}_pct"] * injected / 100) for x, _ in splits.LEVELS] == [n.get((*at, x), 0) for x, _ in splits.LEVELS]
        own = {}
        for row in rows:
            if row[0] == r["split_seed"] and row[7] == "reserve":
                own[row[2]] = own.get(row[2], 0) + 1
        eligible = sum(row[0] == r["split_seed"] and row[7] == "test" and row[8] for row in rows)
        assert r["coverage_pct"] == pytest.approx(100 * sum(c >= r["dose"] for c in own.values()) / eligible if eligible else 0)
    assert "removed_id" not in probe._jdf.queryExecution().optimizedPlan().toString() and probe.count() == 6
    assert len(probe.inputFiles()) and not any("ranked" in f or "concord-free-" in f and "free-cells" not in f for f in probe.inputFiles())
