"""Running totals over a whole table without putting it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_totals(df: DataFrame, digest: str, tie: str, sums: dict[str, Column], by: list[str], cut: Column | None = None) -> DataFrame:
    """df with run_<name> (sum up to and with the row, in the order of the hex digest and then tie) and all_<name>.

    Rows are cut into 4096 ranges of the digest. Only the totals of the ranges (4096 for each group of `by`) are
    summed in one place; rows are sorted within their range. `cut` names the range where the order is not that of a digest."""
    rows = df.select("*", *(c.alias(f"__{k}") for k, c in sums.items())).withColumn("__range", F.substring(digest, 1, 3) if cut is None else cut)
    totals = rows.groupBy(*by, "__range").agg(*(F.sum(f"__{k}").alias(f"__{k}") for k in sums))
    order = Window.partitionBy(*by).orderBy("__range")
    before = totals.select(*by, "__range", *((F.sum(f"__{k}").over(order) - F.col(f"__{k}")).alias(f"__before_{k}") for k in sums), *(F.sum(f"__{k}").over(Window.partitionBy(*by)).alias(f"all_{k}") for k in sums))
    inner = Window.partitionBy(*by, "__range").orderBy(digest, tie).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(f"__{k}").over(inner).alias(f"__in_{k}") for k in sums)).join(before, [*by, "__range"])
    out = out.withColumns({f"run_{k}": F.col(f"__before_{k}") + F.col(f"__in_{k}") for k in sums})
    return out.drop("__range", *(f"__{x}{k}" for k in sums for x in ("", "before_", "in_")))
