"""The ordered fingerprint against plain Python, over several ranges and pieces."""

import hashlib
import random

from concord.functions import hashing


def test_ordered_fingerprint_streams_its_lines(spark):
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(9000)}" if i % 50 else None, rng.choice(['a"b', "ü,", None, "x\ny"]) , "z" * rng.randrange(90)) for i in range(12_000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, "id string, a string, b string").repartition(7)
        fp = hashing.ordered_fingerprint(df, "id", ["a", "b"])
        got = fp.first()
        plan = fp._jdf.queryExecution().optimizedPlan().toString()
        none = hashing.ordered_fingerprint(df.limit(0), "id", ["a", "b"]).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    quoted = lambda v: '"' + (v or "").replace('"', '""') + '"'
    lines = sorted(((r[0] is not None, (r[0] or "").encode(), ",".join(map(quoted, r)).encode()) for r in rows))
    assert (got["sha256"], got["n_rows"]) == (hashlib.sha256(b"".join(x[2] + b"\n" for x in lines)).hexdigest(), len(rows))
    assert (none["sha256"], none["n_rows"]) == (hashlib.sha256(b"\n").hexdigest(), 0)
    assert "collect_list" not in plan  # no row that holds all lines
