"""Draws in count space: the distributions against exact ones, and replicates against resampled rows."""

import bisect
import collections
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from concord.operators import inference
from concord.operators import resampling as R

POINTS = 4001


def exact(n, p):
    """(k, P(X <= k)) over all k that matter."""
    sd = math.sqrt(n * p * (1 - p))
    out, total = [], 0.0
    for k in range(max(0, int(n * p - 12 * sd - 20)), min(n, int(n * p + 12 * sd + 20)) + 1):
        total += math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
        out.append((k, total))
    return out


def test_normal_quantile(spark):
    us = [(i + 0.5) / POINTS for i in range(POINTS)] + [2.0**-53, 1e-12, 1e-6, 1 - 1e-9]
    got = R.normal_quantile(spark.createDataFrame([(u,) for u in us], "u double"), "u", "z").collect()
    assert [r["z"] for r in got] == pytest.approx([statistics.NormalDist().inv_cdf(r["u"]) for r in got], abs=1e-12)


def test_binomial_quantiles(spark):
    """Exact up to the variance that is added up; beyond it the uniform at which a draw changes is right to 1e-4."""
    us = [((i + 0.5) / POINTS,) for i in range(POINTS)]
    cases = [(1, 0.5), (10, 0.3), (64, 0.5), (1000, 0.999), (300, 0.06), (400, 0.05), (1000, 0.98), (10_000, 0.002), (100_000, 0.3)]
    df = spark.createDataFrame(us, "u double").crossJoin(spark.createDataFrame(cases, "n long, p double"))
    got = collections.defaultdict(list)
    for r in R.binomial(df, "n", "p", "u", "x").collect():
        got[r["n"], r["p"]].append((r["u"], r["x"]))
    for (n, p), rows in got.items():
        table = exact(n, p)
        sums, at = [c for _, c in table], dict(table)
        for u, x in rows:
            k = table[min(bisect.bisect_left(sums, u), len(table) - 1)][0]
            if k != x:
                assert n * p * (1 - p) > R.EXACT
                assert abs(at[min(k, x)] - u) < 1e-4
    edge = spark.createDataFrame([(0, 0.5, 0.3), (7, 0.0, 0.9), (7, 1.0, 0.1), (10**11, 0.5, 0.5), (10**11, 1e-11, 0.9)], "n long, p double, u double")
    assert [r["x"] for r in R.binomial(edge, "n", "p", "u", "x").collect()] == [0, 0, 7, 5 * 10**10, 2]


def test_multinomial(spark):
    """Every replicate has as many as the group, groups with a null key count, means and variances are those of the multinomial."""
    cells = [("a", 3, 50), ("a", 9, 30), ("a", 40, 20), ("b", 0, 7), (None, 5, 600), (None, 6, 400), (None, 7, 0)]
    reps = 4000
    df = spark.createDataFrame(cells, "g string, cell int, n long")
    rows = R.multinomial(df, reps, 42, "boot", ["g"]).collect()
    total, counts = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        total[r["g"], r["rep"]] += r["n"]
        counts[r["g"], r["cell"]].append(r["n"])
    sizes = {"a": 100, "b": 7, None: 1000}
    assert len(total) == 3 * reps and all(v == sizes[g] for (g, _), v in total.items())
    assert set(counts) == {(g, c) for g, c, n in cells if n}
    for (g, c), got in counts.items():
        n, p = sizes[g], dict(((g, c), n) for g, c, n in cells)[g, c] / sizes[g]
        sd = math.sqrt(n * p * (1 - p))
        assert abs(sum(got) / reps - n * p) <= 5 * sd / math.sqrt(reps) + 1e-9
        if sd:
            assert abs(math.sqrt(sum((x - n * p) ** 2 for x in got) / reps) / sd - 1) < 0.06
    again = R.multinomial(df.repartition(5), reps, 42, "boot", ["g"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert R.multinomial(df.where("n < 0"), reps, 42, "boot", ["g"]).collect() == []


def example_rows(n, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = rng.randrange(4)
        rows.append((i, t, t if rng.random() < 0.7 else rng.randrange(4), t if rng.random() < 0.6 else rng.choice([0, 1, 2, 3, None])))
    return rows


def macro(rows, k):
    out = []
    for s in (1, 2):
        f = []
        for c in range(k):
            tp = sum(r[0] == c and r[s] == c for r in rows)
            both = sum(r[0] == c for r in rows) + sum(r[s] == c for r in rows)
            f.append(2 * tp / both if both else 0.0)
        out.append(sum(f) / k)
    return out[0] - out[1]


def test_tests_agree_with_resampled_rows(spark):
    rows = example_rows(120)
    df = spark.createDataFrame(rows, "example_id int, true_label int, pred_a int, pred_b int")
    plain = [r[1:] for r in rows]
    rng = random.Random(1)
    reps = 2000
    hit = lambda r: (r[0] == r[1]) - (r[0] == r[2])
    actual, actual_macro = sum(map(hit, plain)), macro(plain, 4)
    flipped = [[(t, a, b) if rng.random() < 0.5 else (t, b, a) for t, a, b in plain] for _ in range(reps)]
    expect = (sum(abs(sum(map(hit, f))) >= abs(actual) for f in flipped) + 1) / (reps + 1)
    got = inference.permutation_accuracy(df, 10_000).first()
    assert got["n"] == 120 and got["delta"] == pytest.approx(actual / 120)
    assert got["p"] == pytest.approx(expect, abs=5 * math.sqrt(expect / reps) + 0.003)
    expect = (sum(abs(macro(f, 4)) >= abs(actual_macro) - 1e-12 for f in flipped) + 1) / (reps + 1)
    got = inference.permutation_macro(df, 4, 10_000).first()
    assert got["delta"] == pytest.approx(actual_macro) and got["n_differ"] == sum(a != b for _, a, b in plain)
    assert got["p"] == pytest.approx(expect, abs=5 * math.sqrt(expect / reps) + 0.003)
    drawn = [[rng.choice(plain) for _ in plain] for _ in range(reps)]
    for metric, stat in (("accuracy", lambda f: sum(map(hit, f)) / len(f)), ("macro_f1", lambda f: macro(f, 4))):
        cuts = statistics.quantiles([stat(f) for f in drawn], n=40)
        got = inference.bootstrap_delta(df, 4, 10_000, metric=metric).first()
        width = cuts[-1] - cuts[0]
        assert got["ci_low"] == pytest.approx(cuts[0], abs=0.08 * width) and got["ci_high"] == pytest.approx(cuts[-1], abs=0.08 * width)


def test_groups_are_those_of_single_calls(spark):
    one, two = example_rows(60, 3), example_rows(90, 4)
    schema = "example_id int, true_label int, pred_a int, pred_b int"
    both = spark.createDataFrame(one, schema).withColumn("g", F.lit("x")).unionByName(spark.createDataFrame(two, schema).withColumn("g", F.lit(None).cast("string")))
    acc = {r["g"]: r for r in inference.permutation_accuracy(both, 500, by=["g"]).collect()}
    mac = {r["g"]: r for r in inference.permutation_macro(both, 4, 500, by=["g"]).collect()}
    ci = {r["g"]: r for r in inference.bootstrap_delta(both, 4, 500, metric="macro_f1", by=["g"]).collect()}
    gain = {r["g"]: r for r in inference.bootstrap_gain(both.select("g", *((F.col("true_label") == F.col(c)).cast("int").alias(n) for c, n in (("pred_a", "ensemble"), ("pred_b", "m1"), ("pred_a", "m2")))), ["m1", "m2"], 500, by=["g"]).collect()}
    for g, rows in (("x", one), (None, two)):
        plain = [r[1:] for r in rows]
        assert acc[g]["n"] == mac[g]["n"] == len(rows) and mac[g]["delta"] == pytest.approx(macro(plain, 4))
        assert ci[g]["reps"] == 500 and ci[g]["ci_low"] <= macro(plain, 4) <= ci[g]["ci_high"]
        assert gain[g]["ci_high"] <= 0  # the ensemble is one of its members


def test_empty_tables(spark):
    none = spark.createDataFrame([], "example_id int, true_label int, pred_a int, pred_b int")
    assert tuple(inference.permutation_accuracy(none, 50).first()) == (0, 0, 0.0, 0, 1.0)
    assert tuple(inference.permutation_macro(none, 3, 50).first()) == (0, 0, 0.0, 0, 1.0)
    assert inference.bootstrap_delta(none, 3, 50).first()["reps"] == 0
