"""Quantiles by histograms against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from concord.operators import quantiles as Q


def plain(values, at):
    v = sorted(values)
    place = at * (len(v) - 1)
    a, b = v[math.floor(place)], v[math.ceil(place)]
    return a if a == b else a + (b - a) * (place - math.floor(place))


def test_quantiles_of_odd_distributions(spark):
    rng = random.Random(2)
    groups = {
        "ties": [1.0] * 900 + [2.0] * 50 + [3.0] * 51,
        "skewed": [rng.lognormvariate(0, 6) for _ in range(777)],
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)],
        "one": [5.5],
        "two": [-0.0, 4.0],
        "close": [1.0 + i * 2.0**-52 for i in range(64)],
        "ends": [1.7e308, -1.7e308, 0.0, 1.0, 2.0],
        None: [float(i % 10) for i in range(333)],
    }
    rows = [(g, x) for g, values in groups.items() for x in values] + [("ties", None), ("ties", math.nan), ("none", None)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    at = [0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0]
    got = {(r["g"], r["at"]): r["quantile"] for r in Q.quantiles(df, "x", at, ["g"]).collect()}
    assert got == {(g, a): pytest.approx(plain(v, a), rel=1e-12, abs=0) for g, v in groups.items() for a in at}


def test_infinite_values_are_the_ends(spark):
    values = [-math.inf] * 3 + [float(i) for i in range(94)] + [math.inf] * 4
    df = spark.createDataFrame([(x,) for x in values], "x double")
    ranks = spark.createDataFrame([(i,) for i in (0, 2, 3, 50, 96, 97, 100)], "rank long")
    got = {r["rank"]: r["value"] for r in Q.order_statistics(df, "x", ranks, []).collect()}
    assert got == {i: sorted(values)[i] for i in (0, 2, 3, 50, 96, 97, 100)}


def test_quantiles_of_nothing(spark):
    none = spark.createDataFrame([], "x double")
    assert Q.quantiles(none, "x", [0.5]).collect() == []
    whole = spark.range(1001).select(F.col("id").alias("x"))
    assert [r["quantile"] for r in Q.quantiles(whole, "x", [0.5]).collect()] == [500.0]
