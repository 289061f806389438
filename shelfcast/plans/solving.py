"""SQL text that fits linear models in the checking database."""

from __future__ import annotations


def features_sql(fourier: int = 4, new_year: bool = False) -> str:
    """The dated features of day number t as a list; the trend is scaled down, which leaves fitted values alone."""
    phase = "(day(date) - 1) / CAST(day(last_day(date)) AS DOUBLE)"
    parts = ["1.0", "t / 1000.0"] + [f"CAST((t - 1) % 7 = {k} AS INTEGER)" for k in range(1, 7)]
    for k in range(1, fourier + 1):
        parts += [f"sin(2 * pi() * {k} * {phase})", f"cos(2 * pi() * {k} * {phase})"]
    if new_year:
        parts.append("CAST(dayofyear(date) = 1 AS INTEGER)")
    return f"CAST([{', '.join(parts)}] AS DOUBLE[])"


def feature_count(fourier: int = 4, new_year: bool = False) -> int:
    return 8 + 2 * fourier + int(new_year)


def solve_sql(name: str, rows: str, keys: str, p: int) -> str:
    """CTEs that end in ``name(keys, beta)``: least squares of y on the list x, per key, by elimination."""
    zero = f"abs(m[{{i}}][{{i}}]) < 1e-9"
    return f"""{name}_sums AS (SELECT {keys}, i, j, sum(x[i] * CASE WHEN j = {p + 1} THEN y ELSE x[j] END) AS v
    FROM {rows}, range(1, {p + 1}) a(i), range(1, {p + 2}) b(j) GROUP BY ALL),
{name}_lines AS (SELECT {keys}, i, list(v ORDER BY j) AS line FROM {name}_sums GROUP BY ALL),
{name}_steps AS (
    SELECT {keys}, 1 AS k, list(line ORDER BY i) AS m FROM {name}_lines GROUP BY {keys}
    UNION ALL
    SELECT {keys}, k + 1, list_transform(range(1, {p + 1}), lambda i: CASE WHEN i = k OR {zero.format(i='k')} THEN m[i]
        ELSE list_transform(range(1, {p + 2}), lambda j: m[i][j] - m[i][k] * m[k][j] / m[k][k]) END)
    FROM {name}_steps WHERE k <= {p}),
{name} AS (SELECT {keys}, list_transform(range(1, {p + 1}), lambda i:
    CASE WHEN {zero.format(i='i')} THEN 0.0 ELSE m[i][{p + 1}] / m[i][i] END) AS beta FROM {name}_steps WHERE k = {p + 1})"""


def mixed_key_sql(key: str, seed: int) -> str:
    """The scrambled key as nested subexpressions."""
    prime = 2147483647
    start = f"(({key} % {prime} + ({key} // {prime}) % {prime} * 31 + {seed}) % {prime})"
    once = f"(({start} * {start} + {seed}) % {prime})"
    twice = f"(({once} * {once} + {start}) % {prime})"
    return f"(({twice} * {twice} + {once}) % {prime})"
