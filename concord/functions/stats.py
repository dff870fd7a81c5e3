"""Scalar statistics: guarded ratios, softmax, argmax, binomial tails, the normal distribution function."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, undefined: float | None = 0.0) -> Column:
    """a / b, and `undefined` where b is 0."""
    got = F.try_divide(a.cast("double"), b.cast("double"))
    return got if undefined is None else F.coalesce(got, F.lit(undefined))


def percent(a: Column, b: Column) -> Column:
    return ratio(100.0 * a, b)


def softmax_over(x: Column, by: list[str], temperature: float = 1.0) -> Column:
    w = Window.partitionBy(*by)
    e = F.exp((x - F.max(x).over(w)) / F.lit(temperature))
    return e / F.sum(e).over(w)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value being computed once for each row however often `then` names it, in lambdas too."""
    return F.element_at(F.transform(F.array(value), then), 1)


def softmax(values: Column) -> Column:
    """Of an array."""
    total = lambda e: F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    shares = lambda e: let(total(e), lambda t: F.transform(e, lambda v: v / t))
    return let(values, lambda x: let(F.array_max(x), lambda top: let(F.transform(x, lambda v: F.exp(v - top)), shares)))


def argmax(values: Column) -> Column:
    """Position (from 0) of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def correlation(a: str, b: str) -> Column:
    """Pearson r of two columns; null if either has no variance (corr() raises there under ANSI)."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    n = F.count(F.lit(1)).cast("double")
    sx, sy, sxy, sxx, syy = F.sum(x), F.sum(y), F.sum(x * y), F.sum(x * x), F.sum(y * y)
    vx, vy = n * sxx - sx * sx, n * syy - sy * sy
    return F.when((vx > 0) & (vy > 0), F.try_divide(n * sxy - sx * sy, F.sqrt(vx * vy)))


def _stirling(x: Column) -> Column:
    """ln(x!) less Stirling's formula, for x >= 1."""
    exact = F.log(F.factorial(F.least(x, F.lit(15)).cast("int")).cast("double")) - 0.5 * F.log(2 * math.pi * x) - x * F.log(x) + x
    return F.when(x <= 15, exact).otherwise(1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5))) - 1 / (1680 * F.pow(x, F.lit(7))))


#: Terms that are added up in one array.
RUN = 1024


def mcnemar_exact(b: Column, c: Column) -> Column:
    """Two-sided exact binomial p of discordant counts; 1 without any.

    The probability of the smaller count comes from its deviance and Stirling's remainders, which keeps its precision at any size. The ratios of the terms below it
    are added up over five standard deviations and more, in runs, so that arrays stay short: both are of the order of n^(1/4)."""
    n, k, m = (b + c).cast("double"), F.least(b, c).cast("double"), F.greatest(b, c).cast("double")
    d = (m - k) / n
    deviance = n / 2 * ((1 - d) * F.log1p(-d) + (1 + d) * F.log1p(d))
    at_k = F.when(k == 0, F.exp(-n * math.log(2.0))).otherwise(F.sqrt(n / (2 * math.pi * k * m)) * F.exp(_stirling(n) - _stirling(k) - _stirling(m) - deviance))
    last = F.least(k, F.ceil(10 * F.sqrt(n)) + 60)
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(s: Column, j: Column) -> Column:
        term = s["term"] * F.greatest(k - j + 1, F.lit(0.0)) / (m + j)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    runs = F.sequence(F.lit(0).cast("bigint"), F.floor(last / RUN).cast("bigint"))
    below = F.aggregate(runs, start, lambda s, r: F.aggregate(F.sequence(F.lit(1), F.lit(RUN)), s, lambda t, i: step(t, r * RUN + i)))["sum"]
    return F.when(n == 0, 1.0).when(k == m, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * at_k * below))


def cohen_h(p1: Column, p2: Column) -> Column:
    return 2 * F.asin(F.sqrt(p1)) - 2 * F.asin(F.sqrt(p2))


#: Terms of the normal distribution function's series and levels of its continued fraction; where the one gives way to the other.
TERMS, LEVELS, EDGE = 80, 100, 3.0


def normal_tail(x: Column) -> Column:
    """The normal probability above x >= 0: a half less the series about 0, or the continued fraction of Mills' ratio."""
    x = x.cast("double")
    density = F.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    first = F.struct(x.alias("term"), x.alias("sum"))

    def add(s: Column, i: Column) -> Column:
        term = s["term"] * x * x / (2 * i + 1)
        return F.struct(term.alias("term"), (s["sum"] + term).alias("sum"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), first, add)["sum"]
    fraction = F.aggregate(F.sequence(F.lit(LEVELS), F.lit(1), F.lit(-1)), x, lambda f, i: x + i / f)
    return F.when(x < EDGE, 0.5 - density * series).otherwise(density / fraction)


def normal_cdf(z: Column | str) -> Column:
    z = F.col(z) if isinstance(z, str) else z
    return F.when(z >= 0, 1 - normal_tail(z)).when(z < 0, normal_tail(-z))


def tost_p(z_low: Column, z_high: Column, se: Column, inside: Column) -> Column:
    """The larger p of the two one-sided tests; without variance 0 inside the margins and 1 outside."""
    lower = F.when(z_low >= 0, normal_tail(F.abs(z_low))).otherwise(1 - normal_tail(F.abs(z_low)))
    return F.when(se > 0, F.greatest(lower, normal_cdf(z_high))).otherwise(F.when(inside, 0.0).otherwise(1.0))
