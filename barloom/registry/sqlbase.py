"""Building blocks of the DuckDB statements the results are checked against."""

from __future__ import annotations

# One symbol per brand, one bar per ship day.
BARS = """trades AS (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, l_extendedprice / l_quantity AS price,
         (l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k, l_quantity AS q, l_extendedprice AS a
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bars AS MATERIALIZED (
  SELECT symbol, date, arg_min(price, k) AS open, max(price) AS high, min(price) AS low,
         arg_max(price, k) AS close, sum(q) AS volume, sum(a) AS value
  FROM trades GROUP BY symbol, date)"""

S0 = """s0 AS (
  SELECT *, close / pc - 1 AS ret, greatest(high - low, abs(high - pc), abs(low - pc)) AS tr,
         (high + low + close) / 3.0 AS tp, ln(close) AS lnp
  FROM (SELECT *, lag(close) OVER w AS pc, lag(open) OVER w AS po, lag(high) OVER w AS ph,
               lag(low) OVER w AS pl, row_number() OVER w AS rn
        FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)))"""

W = "PARTITION BY symbol ORDER BY date"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


def ov(n: int) -> str:
    """The last n rows of the symbol."""
    return f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def full(agg: str, x: str, n: int) -> str:
    """agg over n rows, NULL until n values are there; {x} stands for the value."""
    call = agg.format(x=x) if "{x}" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) {ov(n)} = {n} THEN {call} {ov(n)} END"


def lag(x: str, n: int) -> str:
    return f"lag({x}, {n}) OVER ({W})"


def upto(call: str) -> str:
    return f"{call} OVER ({W} ROWS UNBOUNDED PRECEDING)"


def staged(*stages: dict[str, str], base: str = "s0", prefix: str = "s") -> tuple[str, str]:
    """CTE text adding one set of columns per stage, and the last CTE's name."""
    parts, name = [], base
    for i, cols in enumerate(stages, 1):
        new = f"{prefix}{i}"
        items = ", ".join(f"{e} AS {n}" for n, e in cols.items())
        parts.append(f"{new} AS (SELECT *, {items} FROM {name})")
        name = new
    return "".join(",\n" + p for p in parts), name


def factor_sql(value: str, *stages: dict[str, str], digits: int = 6) -> str:
    ctes, name = staged(*stages)
    return (
        f"WITH {BARS},\n{S0}{ctes}\n"
        f"SELECT symbol, date, {r('(' + value + ')', digits)} AS value FROM {name}"
    )


def with_bars(body: str, *ctes: str) -> str:
    return f"WITH {BARS},\n{S0}" + "".join(",\n" + x for x in ctes) + "\n" + body
