"""Expensive columns are computed once for each row, whatever is built and filtered on top of them."""

import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from concord.functions import stats


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_softmax_equals_plain_and_names_its_input_once(spark):
    rows = [([1.0, -2.0, 700.0],), ([0.5, 0.5],), ([-1000.0],), (None,)]
    df = spark.createDataFrame(rows, "x array<double>").repartition(1).select(stats.softmax(F.transform("x", lambda v: v * 2)).alias("p"), "x")
    for r in df.collect():
        want = None if r["x"] is None else [math.exp(2 * v - 2 * max(r["x"])) for v in r["x"]]
        assert r["p"] == (None if want is None else pytest.approx([w / sum(want) for w in want]))
    assert optimized(df).count("* 2") == 1


def test_prediction_violations_filter_does_not_repeat_the_model(spark, sf_dir):
    assert optimized(__spark_entry__.queries()["prediction_violations"](spark, sf_dir)).upper().count("EXP(") == 1


def test_split_checks_are_no_single_plan(spark, sf_dir):
    """The counts of each relation are written; what is left joins rows of one split each."""
    plan = optimized(__spark_entry__.queries()["split_invariants"](spark, sf_dir))
    assert plan.count("Join") <= 2 and "Window" not in plan


def test_roles_are_dealt_by_author_once(spark, sf_dir):
    from concord.queries.surrogates import roles

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = roles(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"hashpartitioning\((split_seed#\d+, author|author#\d+, split_seed)", plan)
