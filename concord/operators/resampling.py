"""Resampling in count space: replicates of a table of cell counts, at a cost that does not depend on the number of rows.

Metrics of paired systems depend on the examples only through the counts of a few cells (by label and predictions, or by which systems
are right). A bootstrap replicate of n rows is then a multinomial draw over the cells, and a permutation that swaps each row with probability one half is a binomial draw
for each cell. A multinomial is drawn by halving: the cells are the leaves of a binary tree, and each node hands a binomial share
of its count to its left child, so all nodes of a level are drawn at once, no row waits for another, and B replicates of C cells cost B x C whatever n is.

A binomial is the quantile of a hashed uniform. Up to a variance of EXACT the distribution is added up term by term; beyond it, the
Cornish-Fisher expansion up to the fourth cumulant is rounded, which moves the distribution function by less
than 2e-4 anywhere (a test measures it), far below what 10,000 replicates can resolve. All of it is column arithmetic that SQL repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from ..sources.tables import stored

#: Variance up to which a binomial is added up.
EXACT = 16.0
#: Digits of a digest that make a uniform, and how many values they have.
DIGITS, VALUES = 13, float(2**52)

# Rational approximations of the normal quantile (Wichura 1988, algorithm AS 241, PPND16), numerator and denominator, lowest power
# first; for |u - 1/2| <= 0.425, then for sqrt(-log(tail)) <= 5, then beyond.
CENTRE = (
    (3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3),
    (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3),
)
SHOULDER = (
    (1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
TAIL = (
    (6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def uniform(seed: int, namespace: str, *key: Column | str) -> Column:
    """Between 0 and 1, neither included, from the hash of the key."""
    digits = F.substring(order_key(seed, namespace, *key), 1, DIGITS)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + 0.5) / VALUES


def _rational(of: tuple, x: str) -> str:
    """A quotient of polynomials as an expression's text: one call for a column instead of one for each operation."""

    def horner(c: tuple) -> str:
        out = f"{c[-1]!r}D"
        for v in reversed(c[:-1]):
            out = f"({out} * {x} + {v!r}D)"
        return out

    return f"{horner(of[0])} / {horner(of[1])}"


#: The standard normal quantile at 1/2 + __d, __r being the root of minus the logarithm of the smaller tail.
QUANTILE = f"""CASE WHEN abs(__d) <= 0.425D THEN __d * {_rational(CENTRE, "(0.180625D - __d * __d)")}
  ELSE sign(__d) * CASE WHEN __r <= 5 THEN {_rational(SHOULDER, "(__r - 1.6D)")} ELSE {_rational(TAIL, "(__r - 5.0D)")} END END"""
#: Added up from 0, so far that what lies beyond is less than a uniform can tell.
ADDED = """aggregate(sequence(1, CAST(least(__n, ceil(__mean + 9 * sqrt(__var) + 12)) AS INT)),
  named_struct('k', 0, 'term', exp(__n * ln(1 - __q)), 'sum', exp(__n * ln(1 - __q))),
  (s, j) -> IF(s.sum >= __v, s, named_struct('k', j, 'term', s.term * (__n - j + 1) / j * (__q / (1 - __q)), 'sum', s.sum + s.term * (__n - j + 1) / j * (__q / (1 - __q))))).k"""
#: The smooth density that has the count's probabilities at whole numbers: summing it over them is integrating it up to half a unit further, with
#: cumulants less Sheppard's corrections; its quantile is rounded.
SMOOTH = """least(greatest(floor(__mean + sqrt(__var - 1D / 12) * (__z + __skew * (__z * __z - 1) / 6 + __kurt * (__z * __z * __z - 3 * __z) / 24
  - __skew * __skew * (2 * __z * __z * __z - 5 * __z) / 36) + 0.5D), 0), __n)"""


def normal_quantile(df: DataFrame, u: str, out: str) -> DataFrame:
    """df with the standard normal quantile of column u."""
    rows = df.withColumns({"__d": F.col(u) - 0.5, "__r": F.sqrt(-F.log(F.least(F.col(u), 1 - F.col(u))))})
    return rows.withColumn(out, F.expr(QUANTILE)).drop("__d", "__r")


def binomial(df: DataFrame, n: str, p: str, u: str, out: str) -> DataFrame:
    """df with the quantile at u of the binomial distribution of n trials with probability p, as a bigint.

    The steps are columns of their own, so that each is computed once."""
    columns = df.columns
    rows = df.selectExpr("*", f"`{n}` AS __n", f"IF(`{p}` > 0.5D, 1 - `{p}`, `{p}`) AS __q", f"IF(`{p}` > 0.5D, 1 - `{u}`, `{u}`) AS __v")
    rows = rows.selectExpr("*", "__n * __q AS __mean", "__n * __q * (1 - __q) AS __var", "__v - 0.5D AS __d", "sqrt(-ln(least(__v, 1 - __v))) AS __r")
    rows = rows.selectExpr("*", f"{QUANTILE} AS __z", "IF(__var > 1, __var * (1 - 2 * __q) / ((__var - 1D / 12) * sqrt(__var - 1D / 12)), 0D) AS __skew", "IF(__var > 1, (__var * (1 - 6 * __q * (1 - __q)) + 1D / 120) / ((__var - 1D / 12) * (__var - 1D / 12)), 0D) AS __kurt")
    rows = rows.selectExpr("*", f"CAST(CASE WHEN __n <= 0 OR __q <= 0 THEN 0 WHEN __var <= {EXACT!r}D THEN {ADDED} ELSE {SMOOTH} END AS BIGINT) AS __k")
    return rows.selectExpr(*(f"`{c}`" for c in columns), f"IF(`{p}` > 0.5D, __n - __k, __k) AS `{out}`")


def replicated(rows: DataFrame, reps: int, *keys: str) -> DataFrame:
    """A few rows (one for each group or cell, not one for each example) with a column rep from 1 to reps, dealt over all tasks."""
    return rows.withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).repartition("rep", *keys)


def multinomial(cells: DataFrame, reps: int, seed: int, namespace: str, by: list[str], cell: str = "cell") -> DataFrame:
    """Bootstrap replicates of counts: by, rep, cell, n; cells that get nothing have no row.

    cells: by, cell and its count n, one row each: as many as the statistic tells apart, whatever the examples. Each `by` is drawn with as many as it has. The leaves are
    the cells by rank, so the tree is as deep as the logarithm of the number of cells that occur."""
    group = F.struct(F.lit(0), *by).alias("__g")  # a struct is never null, a `by` may be
    rank = F.row_number().over(Window.partitionBy("__g").orderBy(cell)) - 1
    ranked = stored(cells.where("n > 0").select(group, cell, "n").withColumn("__leaf", rank), "cells")
    bits = max(0, (ranked.agg(F.max("__leaf")).first()[0] or 0)).bit_length()
    path = F.transform(F.sequence(F.lit(0), F.lit(bits)), lambda h: F.call_function("shiftright", F.col("__leaf") + F.lit(1 << bits), h))
    nodes = ranked.select("__g", F.explode(path).alias("node"), "n").groupBy("__g", "node").agg(F.sum("n").alias("weight"))
    left = nodes.where("node % 2 = 0").select("__g", (F.col("node") / 2).cast("int").alias("node"), F.col("weight").alias("left"))
    inner = nodes.where((F.col("node") < 1 << bits) | (F.col("node") == 1)).join(left, ["__g", "node"], "left").select("__g", "node", "weight", (F.coalesce("left", F.lit(0)) / F.col("weight")).alias("p"))
    inner = stored(inner, "halves")  # of a known size, so that Spark broadcasts it if it is small
    now = replicated(inner.where("node = 1").select("__g", "node", F.col("weight").alias("n")), reps, "__g")
    inner = inner.drop("weight")
    for _ in range(bits):
        drawn = now.join(inner, ["__g", "node"]).withColumn("u", uniform(seed, namespace, "rep", *(F.col("__g")[c] for c in by), "node"))
        drawn = binomial(drawn, "n", "p", "u", "x")
        children = F.array(F.struct((2 * F.col("node")).alias("node"), F.col("x").alias("n")), F.struct((2 * F.col("node") + 1).alias("node"), (F.col("n") - F.col("x")).alias("n")))
        now = drawn.select("__g", "rep", F.inline(children)).where("n > 0")
    leaves = now.select("__g", "rep", (F.col("node") - F.lit(1 << bits)).alias("__leaf"), "n")
    return leaves.join(ranked.drop("n"), ["__g", "__leaf"]).select(*(F.col("__g")[c].alias(c) for c in by), "rep", cell, "n")
