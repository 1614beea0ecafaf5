"""SQL of linear systems and of logistic fits, for the queries that fit a model."""

from __future__ import annotations


def solved(m: str, n: int, carried: str) -> str:
    """A subquery with ``m``, lists of ``n`` rows of ``n`` + 1 numbers, turned into the identity and the solution; ``carried`` columns pass through."""
    sub = m
    for k in range(1, n + 1):
        step = f"""list_transform(range(1, {n + 1}), lambda i: CASE WHEN i = {k} THEN list_transform(m[{k}], lambda q: q / m[{k}][{k}])
            ELSE list_transform(range(1, {n + 2}), lambda j: m[i][j] - m[i][{k}] * m[{k}][j] / m[{k}][{k}]) END)"""
        sub = f"(SELECT {carried}, {step} AS m FROM {sub})"
    return sub


def newton(name: str, data: str, keys: str, n: int, c: float = 1.0, rounds: int = 12) -> str:
    """Recursive CTEs: ``name`` has ``keys`` and ``v``, the weights of a ridge logistic fit to each key's rows ``x`` (list of ``n``), ``y``, ``w`` of ``data``."""
    zero = ", ".join(["0.0::DOUBLE"] * n)
    rows = ", ".join(
        "[" + ", ".join([f"sum(h * x[{i}] * x[{j}]) + {1 / c if i == j else 0}::DOUBLE" for j in range(1, n + 1)] + [f"sum(g * x[{i}]) + v[{i}] / {c}::DOUBLE"]) + "]" for i in range(1, n + 1)
    )
    z = " + ".join(f"v[{i}] * x[{i}]" for i in range(1, n + 1))
    sums = f"""(SELECT it, {keys}, v, [{rows}] AS m FROM (SELECT *, w * (p - y) AS g, w * p * (1 - p) AS h FROM (SELECT *, 1 / (1 + exp(-({z}))) AS p FROM {name}_steps JOIN {data} USING ({keys}) WHERE it < {rounds})) GROUP BY it, {keys}, v)"""
    return f"""{name}_steps AS (SELECT 0 AS it, {keys}, [{zero}] AS v FROM (SELECT DISTINCT {keys} FROM {data})
        UNION ALL SELECT it + 1, {keys}, list_transform(range(1, {n + 1}), lambda i: v[i] - m[i][{n + 1}]) FROM {solved(sums, n, f'it, {keys}, v')}),
    {name} AS (SELECT {keys}, v FROM {name}_steps WHERE it = {rounds})"""


def product(v: str, x: str, n: int) -> str:
    return "(" + " + ".join(f"{v}[{i}] * {x}[{i}]" for i in range(1, n + 1)) + ")"
