"""The draws of operators.resampling as DuckDB SQL: relations (common table expressions) that repeat every replicate."""

from __future__ import annotations

from ..functions import stats
from ..operators import resampling as R
from .surrogates import r, sql_key


def number(v: float) -> str:
    return f"{v!r}" if "e" in repr(v) else f"{v!r}e0"


def uniform(namespace: str, *key: str) -> str:
    return f"((('0x' || substr({sql_key(namespace, *key)}, 1, {R.DIGITS}))::BIGINT)::DOUBLE + 0.5e0) / {number(R.VALUES)}"


def _rational(of: tuple, x: str) -> str:
    def horner(c: tuple) -> str:
        out = number(c[-1])
        for v in reversed(c[:-1]):
            out = f"({out} * {x} + {number(v)})"
        return out

    return f"{horner(of[0])} / {horner(of[1])}"


def binomial(source: str) -> str:
    """A query: the columns of source, which has n, p and u, and x, the binomial quantile."""
    term = "acc.term * (n - e.k + 1) / e.k * (q / (1 - q))"
    return f"""SELECT * EXCLUDE (q, v, mean, va, d, rr, z, sk, ku, k), CASE WHEN p > 0.5e0 THEN n - k ELSE k END AS x FROM (
SELECT *, (CASE WHEN n <= 0 OR q <= 0 THEN 0 WHEN va <= {number(R.EXACT)} THEN
  list_reduce(list_transform(range(1, least(n, ceil(mean + 9 * sqrt(va) + 12))::BIGINT + 1), lambda j: {{'k': j, 'term': 0e0, 'sum': 0e0}}),
    lambda acc, e: CASE WHEN acc.sum >= v THEN acc ELSE {{'k': e.k, 'term': {term}, 'sum': acc.sum + {term}}} END,
    {{'k': 0::BIGINT, 'term': exp(n * ln(1 - q)), 'sum': exp(n * ln(1 - q))}}).k
  ELSE least(greatest(floor(mean + sqrt(va - 1e0 / 12) * (z + sk * (z * z - 1) / 6 + ku * (z * z * z - 3 * z) / 24 - sk * sk * (2 * z * z * z - 5 * z) / 36) + 0.5e0), 0), n) END)::BIGINT AS k
FROM (SELECT *, va * (1 - 2 * q) / ((va - 1e0 / 12) * CASE WHEN va > 1 THEN sqrt(va - 1e0 / 12) END) AS sk, (va * (1 - 6 * q * (1 - q)) + 1e0 / 120) / ((va - 1e0 / 12) * (va - 1e0 / 12)) AS ku,
  CASE WHEN abs(d) <= 0.425e0 THEN d * {_rational(R.CENTRE, '(0.180625e0 - d * d)')}
  ELSE sign(d) * CASE WHEN rr <= 5 THEN {_rational(R.SHOULDER, '(rr - 1.6e0)')} ELSE {_rational(R.TAIL, '(rr - 5e0)')} END END AS z
FROM (SELECT *, n * q AS mean, n * q * (1 - q) AS va, v - 0.5e0 AS d, sqrt(-ln(least(v, 1 - v))) AS rr
FROM (SELECT *, CASE WHEN p > 0.5e0 THEN 1 - p ELSE p END AS q, CASE WHEN p > 0.5e0 THEN 1 - u ELSE u END AS v FROM ({source}) s0) s1) s2) s3) s4"""


def flips(name: str, source: str, reps: int, namespace: str, keys: list[str]) -> str:
    """Relation <name>: the rows of source, which have a count n, for each replicate rep with x, how many swap."""
    return f"{name} AS ({binomial(f'SELECT *, 0.5e0 AS p, {uniform(namespace, "rep", *keys)} AS u FROM {source}, (SELECT unnest(range(1, {reps + 1})) AS rep)')})"


def multinomial(name: str, cells: str, reps: int, namespace: str, by: list[str], order: str = "cell") -> str:
    """Relation <name>: by, rep, the columns of `order`, n. cells: a relation with by, these columns and n. The statement must begin WITH RECURSIVE."""
    b = "".join(f"{c}, " for c in by)
    same = lambda x, y, *more: " AND ".join([*(f"{x}.{c} IS NOT DISTINCT FROM {y}.{c}" for c in by), *more] or ["true"])
    of = lambda x: "".join(f"{x}.{c}, " for c in by)
    step = binomial(f"SELECT {of('t')}t.rep, t.node, t.n, h.p, {uniform(namespace, 't.rep', *(f't.{c}' for c in by), 't.node')} AS u FROM {name}_t t JOIN {name}_h h ON {same('t', 'h', 't.node = h.node')} WHERE t.n > 0")
    return f"""{name}_l AS MATERIALIZED (SELECT *, row_number() OVER ({f"PARTITION BY {', '.join(by)} " if by else ''}ORDER BY {order}) - 1 AS leaf FROM {cells} WHERE n > 0),
{name}_k AS MATERIALIZED (SELECT CASE WHEN coalesce(max(leaf), 0) = 0 THEN 0 ELSE length(bin(max(leaf))) END::INT AS bits FROM {name}_l),
{name}_w AS MATERIALIZED (SELECT {b}node, sum(n)::BIGINT AS weight FROM (SELECT {b}n, unnest(list_transform(range(0, bits + 1), lambda h: (leaf + (1 << bits))::BIGINT >> h::INT)) AS node FROM {name}_l, {name}_k) GROUP BY ALL),
{name}_h AS MATERIALIZED (SELECT {of('a')}a.node, coalesce(l.weight, 0) / a.weight AS p FROM {name}_w a LEFT JOIN {name}_w l ON {same('a', 'l', 'l.node = 2 * a.node')}, {name}_k WHERE a.node < (1 << bits)),
{name}_t AS (SELECT {b}rep, node, weight AS n FROM {name}_w, (SELECT unnest(range(1, {reps + 1})) AS rep) WHERE node = 1
  UNION ALL SELECT {b}rep, unnest([2 * node, 2 * node + 1]) AS node, unnest([x, n - x]) AS n FROM ({step})),
{name} AS (SELECT {of('t')}rep, {', '.join(f'l.{c.strip()}' for c in order.split(','))}, t.n FROM {name}_t t JOIN {name}_k ON node >= (1 << bits) JOIN {name}_l l ON {same('t', 'l', 't.node = l.leaf + (1 << bits)')} WHERE t.n > 0)"""


def label_cells(source: str, k: int, by: list[str]) -> str:
    """A query: by, t, a, b, n."""
    known = lambda c: f"CASE WHEN {c} BETWEEN 0 AND {k - 1} THEN {c} ELSE {k} END"
    return f"SELECT {''.join(f'{c}, ' for c in by)}{known('true_label')} AS t, {known('pred_a')} AS a, {known('pred_b')} AS b, count(*) AS n FROM {source} GROUP BY ALL"


def macro(name: str, votes: str, k: int, by: list[str]) -> str:
    """Relation <name>: by, sys, f (macro-F1). votes: a relation with by, sys, t, q (prediction), n."""
    b = "".join(f"{c}, " for c in by)
    hit = f"sum(CASE WHEN t = l.label AND q = l.label THEN n ELSE 0 END)"
    both = f"sum(CASE WHEN t = l.label THEN n ELSE 0 END) + sum(CASE WHEN q = l.label THEN n ELSE 0 END)"
    return f"{name} AS (SELECT {b}sys, avg(f) AS f FROM (SELECT {b}sys, l.label, CASE WHEN {both} = 0 THEN 0e0 ELSE 2 * {hit} / ({both}) END AS f FROM {votes}, (SELECT unnest(range({k})) AS label) l GROUP BY ALL) GROUP BY ALL)"


def perm_accuracy(pairs: str, reps: int, by: list[str], name: str = "pa") -> str:
    """Relations, the last of which is <name>: by, n, n_differ, delta, extreme, p."""
    b = "".join(f"{c}, " for c in by)
    group = f"GROUP BY {', '.join(by)}" if by else ""
    return f"""{name}_0 AS (SELECT {b}count(*) AS rows, coalesce(sum(d), 0) AS sum_d, count(*) FILTER (WHERE d <> 0) AS n FROM (SELECT {b}(coalesce(true_label = pred_a, false))::INT - (coalesce(true_label = pred_b, false))::INT AS d FROM {pairs}) {group}),
{flips(f'{name}_1', f'{name}_0', reps, 'perm_acc', by)},
{name} AS (SELECT {b}rows AS n, n AS n_differ, {r('sum_d / rows')} AS delta, CASE WHEN n = 0 THEN 0 ELSE count(*) FILTER (WHERE abs(2 * x - n) >= abs(sum_d)) END AS extreme,
  {r(f'CASE WHEN n = 0 THEN 1 ELSE (count(*) FILTER (WHERE abs(2 * x - n) >= abs(sum_d)) + 1) / {reps + 1} END')} AS p FROM {name}_1 GROUP BY {b}rows, n, sum_d)"""


def perm_macro(pairs: str, k: int, reps: int, by: list[str], name: str = "pm") -> str:
    """Relations, the last of which is <name>: by, n, n_differ, delta, extreme, p."""
    b = "".join(f"{c}, " for c in by)
    same = lambda x, y: " AND ".join([f"{x}.{c} IS NOT DISTINCT FROM {y}.{c}" for c in by] or ["true"])
    return f"""{name}_c AS MATERIALIZED ({label_cells(pairs, k, by)}),
{name}_f AS MATERIALIZED (SELECT * FROM ({binomial(f"SELECT *, 0.5e0 AS p, {uniform('perm_macro', 'rep', *by, 't', 'a', 'b')} AS u FROM {name}_c, (SELECT unnest(range(1, {reps + 1})) AS rep) WHERE a <> b")})),
{name}_r AS (SELECT DISTINCT {b}rep FROM {name}_f),
{name}_v AS (SELECT {b}0 AS rep, 'x' AS sys, t, a AS q, n FROM {name}_c UNION ALL SELECT {b}0, 'z', t, b, n FROM {name}_c
  UNION ALL SELECT {b}rep, 'x', t, a, n - x FROM {name}_f UNION ALL SELECT {b}rep, 'x', t, b, x FROM {name}_f UNION ALL SELECT {b}rep, 'z', t, b, n - x FROM {name}_f UNION ALL SELECT {b}rep, 'z', t, a, x FROM {name}_f
  UNION ALL SELECT {''.join(f'c.{c}, ' for c in by)}rep, sys, t, a, n FROM {name}_c c JOIN {name}_r r ON {same('c', 'r')}, (VALUES ('x'), ('z')) s(sys) WHERE a = b),
{macro(f'{name}_m', f'{name}_v', k, [*by, 'rep'])},
{name}_d AS (SELECT {b}rep, max(f) FILTER (WHERE sys = 'x') - max(f) FILTER (WHERE sys = 'z') AS d FROM {name}_m GROUP BY ALL),
{name}_0 AS (SELECT {b}sum(n)::BIGINT AS n, coalesce(sum(n) FILTER (WHERE a <> b), 0)::BIGINT AS n_differ FROM {name}_c {f"GROUP BY {', '.join(by)}" if by else ''}),
{name} AS (SELECT {''.join(f'o.{c}, ' for c in by)}o.n, n_differ, {r('o0.d')} AS delta, count(e.rep) FILTER (WHERE abs(e.d) >= abs(o0.d) - 1e-12) AS extreme,
  {r(f'CASE WHEN n_differ = 0 THEN 1 ELSE (count(e.rep) FILTER (WHERE abs(e.d) >= abs(o0.d) - 1e-12) + 1) / {reps + 1} END')} AS p
  FROM {name}_0 o JOIN {name}_d o0 ON o0.rep = 0 AND {same('o', 'o0')} LEFT JOIN {name}_d e ON e.rep > 0 AND {same('o', 'e')} GROUP BY {''.join(f'o.{c}, ' for c in by)}o.n, n_differ, o0.d)"""


def interval(name: str, stat: str, value: str, by: list[str]) -> str:
    b = "".join(f"{c}, " for c in by)
    return f"{name} AS (SELECT {b}count(*) AS reps, {r(f'quantile_cont({value}, 0.025)')} AS ci_low, {r(f'quantile_cont({value}, 0.975)')} AS ci_high FROM {stat} {f'GROUP BY {", ".join(by)}' if by else ''})"


def boot_accuracy(pairs: str, reps: int, by: list[str], strata: list[str] | None = None, name: str = "ba") -> str:
    """Relations, the last of which is <name>: by, reps, ci_low, ci_high."""
    b, keys = "".join(f"{c}, " for c in by), [*by, *(strata or [])]
    kb = "".join(f"{c}, " for c in keys)
    return f"""{name}_c AS MATERIALIZED (SELECT {kb}2 * (coalesce(true_label = pred_a, false))::INT + (coalesce(true_label = pred_b, false))::INT AS cell, count(*) AS n FROM {pairs} GROUP BY ALL),
{multinomial(f'{name}_d', f'{name}_c', reps, 'boot', keys)},
{name}_s AS (SELECT {b}rep, sum(CASE cell WHEN 2 THEN n WHEN 1 THEN -n ELSE 0 END) / sum(n) AS d FROM {name}_d GROUP BY ALL),
{interval(name, f'{name}_s', 'd', by)}"""


def boot_macro(pairs: str, k: int, reps: int, by: list[str], name: str = "bm") -> str:
    b = "".join(f"{c}, " for c in by)
    return f"""{name}_c AS MATERIALIZED ({label_cells(pairs, k, by)}),
{multinomial(f'{name}_d', f'{name}_c', reps, 'boot', by, 't, a, b')},
{name}_v AS (SELECT {b}rep, 'x' AS sys, t, a AS q, n FROM {name}_d UNION ALL SELECT {b}rep, 'z', t, b, n FROM {name}_d),
{macro(f'{name}_m', f'{name}_v', k, [*by, 'rep'])},
{name}_s AS (SELECT {b}rep, max(f) FILTER (WHERE sys = 'x') - max(f) FILTER (WHERE sys = 'z') AS d FROM {name}_m GROUP BY ALL),
{interval(name, f'{name}_s', 'd', by)}"""


def boot_gain(wide: str, members: list[str], reps: int, by: list[str], rechoose: bool = True, name: str = "bg") -> str:
    """wide: a relation with by, e (the ensemble) and the members, 0 or 1 each."""
    b, columns = "".join(f"{c}, " for c in by), ["e", *members]
    pattern = " + ".join(f"{1 << i} * {c}" for i, c in enumerate(columns))
    means = lambda source, more: f"SELECT {b}{more}" + ", ".join(f"sum((cell >> {i}) % 2 * n) / sum(n) AS {c}" for i, c in enumerate(columns)) + f" FROM {source} {('GROUP BY ' + (b + more).rstrip(', ')) if b + more else ''}"
    best = f"greatest({', '.join(members)})"
    first = "CASE " + " ".join(f"WHEN {m} = {best} THEN '{m}'" for m in members) + " END"
    on = " AND ".join([f"m.{c} IS NOT DISTINCT FROM w.{c}" for c in by] or ["true"])
    chosen = "CASE w.chosen " + " ".join(f"WHEN '{m}' THEN m.{m}" for m in members) + " END"
    gain = f"{name}_g AS (SELECT {b}rep, e - {best} AS g FROM {name}_m)" if rechoose else f"{name}_w0 AS (SELECT {b}{first} AS chosen FROM ({means(f'{name}_c', '')})),\n{name}_g AS (SELECT {''.join(f'm.{c}, ' for c in by)}rep, m.e - {chosen} AS g FROM {name}_m m JOIN {name}_w0 w ON {on})"
    return f"""{name}_c AS MATERIALIZED (SELECT {b}({pattern})::INT AS cell, count(*) AS n FROM {wide} GROUP BY ALL),
{multinomial(f'{name}_d', f'{name}_c', reps, 'boot', by)},
{name}_m AS ({means(f'{name}_d', 'rep, ')}),
{gain},
{interval(name, f'{name}_g', 'g', by)}"""


def _tail(x: str) -> str:
    """The normal probability above x >= 0."""
    density = f"exp(-{x} * {x} / 2) / sqrt(2 * pi())"
    # an element of the list stands for a level of the continued fraction, or a term of the series
    fraction = f"list_reduce(list_transform(range({stats.LEVELS}, 0, -1), lambda i: i::DOUBLE), lambda f, i: {x} + i / f, {x})"
    start = f"{{'i': 0::BIGINT, 'term': {x}, 'sum': {x}}}"
    term = f"acc.term * {x} * {x} / (2 * e.i + 1)"
    series = f"list_reduce(list_transform(range(1, {stats.TERMS + 1}), lambda j: {{'i': j, 'term': 0e0, 'sum': 0e0}}), lambda acc, e: {{'i': e.i, 'term': {term}, 'sum': acc.sum + {term}}}, {start}).sum"
    return f"CASE WHEN {x} < {number(stats.EDGE)} THEN 0.5e0 - {density} * {series} ELSE {density} / {fraction} END"


def tost(pairs: str, by: list[str], margin: float = 0.01, name: str = "tost") -> str:
    """Relation <name>: by, n, diff, se, z_low, z_high, inside, p."""
    b, m = "".join(f"{c}, " for c in by), number(margin)
    return f"""{name} AS (SELECT *, CASE WHEN se > 0 THEN greatest(CASE WHEN z_low >= 0 THEN tl ELSE 1 - tl END, CASE WHEN z_high >= 0 THEN 1 - th ELSE th END) WHEN inside THEN 0 ELSE 1 END AS p FROM (
SELECT *, {_tail('abs(z_low)')} AS tl, {_tail('abs(z_high)')} AS th FROM (SELECT {b}n, diff, se, (diff + {m}) / nullif(se, 0) AS z_low, (diff - {m}) / nullif(se, 0) AS z_high, abs(diff) < {m} AS inside FROM
  (SELECT {b}count(*) AS n, avg(d) AS diff, coalesce(stddev_samp(d), 0) / sqrt(count(*)) AS se FROM (SELECT {b}(coalesce(true_label = pred_a, false))::INT - (coalesce(true_label = pred_b, false))::INT AS d FROM {pairs}) {f"GROUP BY {', '.join(by)}" if by else ''}))))"""
