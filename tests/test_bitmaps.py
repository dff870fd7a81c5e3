"""Bitmaps against sets in plain Python."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from concord.operators import bitmaps as B


def test_numbers_have_no_gap(spark):
    ids = spark.createDataFrame([(x,) for x in ["b", "a", "a", None, "", "c|d"]], "id string")
    assert sorted((r.id, r.number) for r in B.numbered(ids, "id").collect()) == sorted(zip(sorted(["b", "a", "", "c|d"], key=lambda x: hashlib.sha256(x.encode()).hexdigest()), range(1, 5), strict=True))


def test_overlaps_across_buckets(spark):
    """Enough ids for three buckets, a set of all, one of a few, equal ones, disjoint ones, a null name, null and repeated ids."""
    rng = random.Random(4)
    ids = range(70_000)
    sets = {"all": set(ids), "same": set(ids), "half": set(rng.sample(ids, 35_000)), "few": {5, 69_999}, "low": set(range(100)), "high": set(range(60_000, 60_100)), None: {7}}
    rows = spark.range(70_000).select(F.explode(F.array(F.lit("all"), F.lit("same"))).alias("name"), "id")
    rest = [(k, i) for k, v in sets.items() if k not in ("all", "same") for i in v] + [("few", None), ("few", 5), ("nothing", None)]
    maps = B.bitmaps(rows.unionByName(spark.createDataFrame(rest, "name string, id bigint")), "id", ["name"]).cache()
    assert maps.select("bucket").distinct().count() == 3
    assert {r.name: r.n for r in B.sizes(maps, ["name"]).collect()} == {k: len(v) for k, v in sets.items()}
    got = B.overlaps(maps, ["name"]).collect()
    assert len(got) == len({(r.a.name, r.b.name) for r in got}) == len(sets) * (len(sets) - 1) // 2
    for r in got:
        a, b = sets[r.a.name], sets[r.b.name]
        assert (r.n_a, r.n_b, r.n_both) == (len(a), len(b), len(a & b))
        assert (r.disjoint, r.subset, r.equal) == (not a & b, a <= b or b <= a, a == b)
        assert r.jaccard == pytest.approx(len(a & b) / len(a | b)) and r.overlap == pytest.approx(len(a & b) / min(len(a), len(b)))
    union = B.merged(maps.where("name IN ('few', 'low', 'high')"), [])
    assert [r.n for r in B.sizes(union, []).collect()] == [len(sets["few"] | sets["low"] | sets["high"])]


def test_empty_and_unknown_ids(spark):
    none = spark.createDataFrame([], "name string, id string")
    assert B.overlaps(B.bitmaps(none, "id", ["name"]), ["name"]).collect() == []
    known = B.numbered(spark.createDataFrame([("a",)], "id string"), "id")
    with pytest.raises(Exception, match="no number for id b"):
        B.bitmaps(spark.createDataFrame([("x", "b")], "name string, id string"), "id", ["name"], known).collect()
