"""Alignment of tables on dates and symbols."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import Bars, running, windowed
from ..functions.scalar import c
from .panel import calendar, small


def as_of(bars: Bars, columns: Sequence[str], dates: DataFrame | None = None) -> DataFrame:
    """The latest known values on every asked date from a symbol's first bar on.

    Each bar answers for the asked dates from its own to the next bar's, so a bar
    is unfolded into just these and no symbol x date grid is built; dates nobody
    asks for cost nothing. Missing values are carried forward first. Long symbols
    run in chunks: the next bar is one row ahead."""
    asked = calendar(bars.df if dates is None else dates)
    # How many asked dates lie before each bar date: a walk over the calendar.
    steps = bars.df.select("date").distinct().withColumn("__c", F.lit(0)).unionByName(asked.select("date", F.lit(1).alias("__c")))
    before = F.sum("__c").over(W.orderBy("date").rangeBetween(W.unboundedPreceding, 0)) - F.max("__c").over(W.partitionBy("date"))
    places = steps.withColumn("__t", before).filter("__c = 0").select("date", "__t")
    known = running(bars, {f"__k_{x}": ("last", F.col(x)) for x in columns})
    known = known.select("symbol", "date", *[F.col(f"__k_{x}").alias(x) for x in columns]).join(small(places, bars.dates), "date")
    count = asked.agg(F.count(F.lit(1)).alias("__n"))

    def build(df: DataFrame, w) -> DataFrame:
        return df.withColumn("__next", F.lead("__t", 1).over(w))

    rows = windowed(bars.with_df(known), 0, 1, build).join(F.broadcast(count), F.lit(True))
    end = F.coalesce("__next", "__n")
    rows = rows.filter(end > F.col("__t")).withColumn("t", F.explode(F.sequence(F.col("__t"), end - 1)))
    return rows.drop("date").join(F.broadcast(asked), "t").select("symbol", "date", *columns)


def next_bar(df: DataFrame, dates: DataFrame, column: str = "date", out: str = "execution_date") -> DataFrame:
    """The calendar date after a signal date."""
    cal = calendar(dates)
    steps = cal.select(F.col("date").alias(column), F.lead("date").over(W.orderBy("t")).alias(out))
    return df.join(steps, column)


def lookup(
    df: DataFrame, dim: DataFrame, key: str, defaults: dict[str, object], dim_rows: int
) -> DataFrame:
    """Left join with a dimension; broadcast only when its checked size allows."""
    return df.join(small(dim, dim_rows), key, "left").fillna(defaults)


def name_cells(df: DataFrame, names: DataFrame, column: str, out: str) -> DataFrame:
    """Replace symbols inside an array cell by their names, order kept.

    names: (symbol, name). Cells are exploded and joined, so the name list may
    be of any size; unknown symbols stay as they are.
    """
    rows = df.withColumn("__row", F.monotonically_increasing_id())
    parts = rows.select("__row", F.posexplode(column).alias("__i", "symbol")).join(names, "symbol", "left")
    packed = parts.groupBy("__row").agg(
        F.sort_array(F.collect_list(F.struct("__i", F.coalesce("name", "symbol").alias("n")))).alias("__p")
    )
    named = F.transform("__p", lambda s: s["n"])
    return rows.join(packed, "__row", "left").withColumn(out, named).drop("__row", "__p")


def held(df: DataFrame, holdings: DataFrame) -> DataFrame:
    return df.join(holdings.select("symbol").distinct(), "symbol", "left_semi")


def not_held(df: DataFrame, holdings: DataFrame) -> DataFrame:
    return df.join(holdings.select("symbol").distinct(), "symbol", "left_anti")


def with_grid(df: DataFrame, spark_rows: Sequence[dict]) -> DataFrame:
    """Attach every parameter set of a small list to every row, as columns."""
    structs = [F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in spark_rows]
    return df.withColumn("__g", F.explode(F.array(*structs))).select(*df.columns, "__g.*")


def aligned_to_calendar(bars: Bars, dates: DataFrame, last_n: int, columns: Sequence[str]) -> DataFrame:
    """The last n trading days for every symbol, gaps filled forward then
    backward."""
    cal = dates.select("date").distinct().orderBy(F.col("date").desc()).limit(last_n)
    days = cal.agg(F.sort_array(F.collect_list("date")).alias("__days"))
    symbols = bars.df.groupBy("symbol").agg(F.lit(1).alias("__o")).drop("__o")
    grid = symbols.join(F.broadcast(days), F.lit(True)).select("symbol", F.explode("__days").alias("date"))
    rows = grid.join(bars.df.select("symbol", "date", *columns), ["symbol", "date"], "left")
    w = W.partitionBy("symbol").orderBy("date")  # at most last_n rows per symbol
    before, after = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    fill = lambda x: F.coalesce(
        F.last(x, ignorenulls=True).over(before), F.first(x, ignorenulls=True).over(after)
    )
    return rows.withColumns({x: fill(x) for x in columns})


def last_days(dates: DataFrame, n: int, before=None) -> DataFrame:
    """The last n calendar days, optionally strictly before a date."""
    days = dates.select("date").distinct()
    if before is not None:
        days = days.filter(F.col("date") < F.lit(before))
    return days.orderBy(F.col("date").desc()).limit(n)


def trading_days_only(df: DataFrame, dates: DataFrame) -> DataFrame:
    return df.join(dates.select("date").distinct(), "date", "left_semi")


def active_on(df: DataFrame, listings: DataFrame, day: str | Column = "date") -> DataFrame:
    """Rows whose symbol has no delist date or a later one."""
    both = df.join(listings.select("symbol", "delist_date"), "symbol")
    alive = F.col("delist_date").isNull() | (c(day) < F.col("delist_date"))
    return both.filter(alive).drop("delist_date")


def keep_symbols(bars: Bars, min_rows: int = 1, column: str | None = None) -> Bars:
    """Symbols with at least min_rows rows (or non-missing values of a column)."""
    count = F.count(c(column)) if column else F.count(F.lit(1))
    kept = bars.df.groupBy("symbol").agg(count.alias("__n")).filter(F.col("__n") >= min_rows).select("symbol")
    return bars.with_df(bars.df.join(kept, "symbol", "left_semi"))


def keep_where_any(bars: Bars, condition: Column, errors_as_false: bool = True) -> Bars:
    """Symbols for which a per-row condition holds at least once."""
    kept = bars.df.groupBy("symbol").agg(F.max(F.coalesce(condition, F.lit(False)).cast("int")).alias("__k"))
    return bars.with_df(bars.df.join(kept.filter("__k = 1").select("symbol"), "symbol", "left_semi"))


def filter_symbols(bars: Bars, predicate, columns: Sequence[str]) -> DataFrame:
    """(symbol, keep, error) for an opaque Python predicate on one symbol's
    history. Needs every symbol to fit one task; use a column condition with
    keep_where_any otherwise."""
    if not bars.symbol_fits:
        raise ValueError("a Python predicate needs whole symbols; express it as a column condition")
    import pandas as pd

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        symbol = pdf["symbol"].iloc[0]
        try:
            keep, error = bool(predicate(pdf.sort_values("date", ignore_index=True))), None
        except Exception as e:  # recorded per symbol
            keep, error = False, f"{type(e).__name__}: {e}"
        return pd.DataFrame({"symbol": [symbol], "keep": [keep], "error": [error]})

    rows = bars.df.select("symbol", "date", *columns)
    return rows.groupBy("symbol").applyInPandas(check, "symbol string, keep boolean, error string")
