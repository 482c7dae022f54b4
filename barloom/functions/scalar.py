"""Small column helpers that pin down NULL and division behaviour.

Missing values are always NULL, never NaN, and a zero divisor gives NULL
instead of the ANSI error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: str | Column) -> Column:
    """Column by name; names with dots (numeric parameters) are quoted."""
    if not isinstance(x, str):
        return x
    return F.col(f"`{x}`" if "." in x and "`" not in x else x)


def div(a: str | Column, b: str | Column) -> Column:
    """a / b as double, NULL when b is zero or either side is NULL."""
    return F.try_divide(c(a).cast("double"), c(b).cast("double"))


def ln(x: str | Column) -> Column:
    """Natural log, NULL for x <= 0."""
    return F.when(c(x) > 0, F.log(c(x)))


def clean(x: str | Column) -> Column:
    """Turn NaN and infinities into NULL (used where data enters)."""
    v = c(x).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))), v)


def rounded(x: str | Column, digits: int = 6) -> Column:
    """Round and drop the sign of zero, for comparable output."""
    return F.round(c(x).cast("double"), digits) + F.lit(0.0)


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound x, keeping NULL (greatest and least alone would skip it)."""
    v = c(x)
    out = v
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(v.isNotNull(), out)


def corr_agg(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows where both are present, NULL when flat.

    All five parts are partial aggregates, so a hot group is combined on the
    map side before anything is shuffled.
    """
    x, y = c(x), c(y)
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_samp(a) * F.stddev_samp(b)
    return F.when(spread > 0, F.covar_samp(a, b) / F.nullif(spread, F.lit(0.0)))


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols)


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols)


OPERATORS = {
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
}
# Spelled-out comparison names used by conditional factors.
WORD_OPERATORS = {"gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def compare(x: str | Column, op: str, value) -> Column:
    """x op value, with a missing x counted as false."""
    symbol = WORD_OPERATORS.get(op, op)
    if symbol not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    return F.coalesce(OPERATORS[symbol](c(x), F.lit(value)), F.lit(False))
