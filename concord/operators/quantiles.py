"""Exact quantiles of a column of any size: selection by histograms instead of an aggregate that holds the distinct values.

A linearly interpolated quantile is made of one or two order statistics. Each round counts, for every wanted rank, the values of the rank's range in CELLS equal cells, and keeps
the cell that has the rank together with the least and the largest value in it; a range ends when these are one value. Cells are equal in value, or in logarithm where a range
spans orders of magnitude, so about ten rounds do, whatever the number of rows and their distribution; no more than CELLS counts for each rank and group are aggregated, and nothing but ranges reaches the next round.

Null and NaN values don't count; infinite ones do, as the ends of the order. Groups without values have no row. Equal values, any number of them, are one cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

CELLS, WIDE = 256, 1000.0
#: Rounds after which a range would be a single double in any case.
MOST_ROUNDS = 60


def _steep(x: Column) -> Column:
    """Rises with x, and with the logarithm of its size: 746 is beyond the logarithm of the smallest double."""
    return F.when(x == 0, 0.0).otherwise(F.signum(x) * (F.log(F.abs(x)) + 746.0))


def _cell(x: Column, lo: Column, hi: Column) -> Column:
    """The cell of a value between the ends of its range: equal cells, of the logarithm where the range has zero in it or spans a factor of WIDE. Both ends are halved before they are subtracted, so
    that no difference overflows. Any rule that never falls would be right; this one makes ranges shrink by CELLS wherever the values are."""
    wide = ((lo <= 0) & (hi >= 0)) | (F.greatest(F.abs(lo), F.abs(hi)) / WIDE > F.least(F.abs(lo), F.abs(hi)))
    share = F.when(wide, (_steep(x) - _steep(lo)) / (_steep(hi) - _steep(lo))).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))
    return (1 + F.least(F.floor(share * CELLS), F.lit(CELLS - 1))).cast("int")


def order_statistics(df: DataFrame, value: str, ranks: DataFrame, by: list[str]) -> DataFrame:
    """by, rank, value: the values at the ranks (from 0) of `ranks` (by, rank) within each group."""
    group = F.struct(F.lit(0), *by)  # never null, a `by` may be
    x = F.col(value).cast("double")
    rows = df.where(x.isNotNull() & ~F.isnan(x)).select(group.alias("__g"), (x + 0.0).alias("x"))
    ends = rows.groupBy("__g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    open_ = stored(ranks.select(group.alias("__g"), "rank").distinct().join(ends, "__g").withColumn("left", F.col("rank").cast("bigint")), "ranks")
    done = []
    for _ in range(MOST_ROUNDS):
        done.append(open_.where("lo = hi").select("__g", "rank", F.col("lo").alias("value")))
        open_ = open_.where("lo != hi")
        if open_.isEmpty():
            break
        ranges = open_.select("__g", "lo", "hi").distinct()
        # infinite ends get cells of their own; between them the range is finite from the next round on
        lo, hi = F.greatest("lo", F.lit(-1.7976931348623157e308)), F.least("hi", F.lit(1.7976931348623157e308))
        inside = rows.join(ranges, "__g").where("x >= lo AND x <= hi")  # a row for each of its group's ranges, a few
        cell = F.when(F.col("x") == F.col("lo"), 0).when(F.col("x") == F.col("hi"), CELLS + 1).otherwise(_cell(F.col("x"), lo, hi))
        counts = inside.groupBy("__g", "lo", "hi", cell.alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
        cells = counts.groupBy("__g", "lo", "hi").agg(F.array_sort(F.collect_list(F.struct("cell", "n", "least", "most"))).alias("cells"))  # CELLS + 2 at most
        zero = F.struct(F.lit(0).cast("bigint").alias("before"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(None).cast("bigint").alias("left"))

        def step(s: Column, c: Column) -> Column:
            here = s["left"].isNull() & (s["before"] + c["n"] > F.col("left"))
            return F.struct((s["before"] + c["n"]).alias("before"), F.when(here, c["least"]).otherwise(s["lo"]).alias("lo"), F.when(here, c["most"]).otherwise(s["hi"]).alias("hi"), F.when(here, F.col("left") - s["before"]).otherwise(s["left"]).alias("left"))

        found = open_.join(cells, ["__g", "lo", "hi"]).withColumn("f", F.aggregate("cells", zero, step))
        open_ = stored(found.select("__g", "rank", F.col("f.lo").alias("lo"), F.col("f.hi").alias("hi"), F.col("f.left").alias("left")), "ranks")
    else:
        raise RuntimeError("a range did not end")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*(F.col("__g")[c].alias(c) for c in by), "rank", "value")


def quantiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None) -> DataFrame:
    """by, at, quantile: linearly interpolated quantiles (those of `quantile_cont`) of each group."""
    by = by or []
    x = F.col(value).cast("double")
    group = F.struct(F.lit(0), *by).alias("__g")
    sizes = df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    place = F.col("at") * (F.col("n") - 1)
    wanted = stored(sizes.withColumn("at", F.explode(F.array(*map(F.lit, at)))).withColumn("below", F.floor(place)).withColumn("above", F.ceil(place)).withColumn("part", place - F.floor(place)), "wanted")
    ranks = wanted.select(*by, F.explode(F.array("below", "above")).alias("rank"))
    found = stored(order_statistics(df, value, ranks, by).select(group, "rank", "value"), "order-statistics")
    side = lambda name, out: found.select("__g", F.col("rank").alias(name), F.col("value").alias(out))
    both = wanted.select("*", group).join(side("below", "lo"), ["__g", "below"]).join(side("above", "hi"), ["__g", "above"])
    value_ = F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    return both.select(*(F.col("__g")[c].alias(c) for c in by), "at", value_.alias("quantile"))
