"""Factor panel: one row per date and symbol with factor, close and amount."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.factor import Factor, with_factors
from ..functions.frames import Bars, windowed
from ..functions.scalar import c, div

# Largest table that is sent to every executor.
BROADCAST_ROWS = 1_000_000


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """Broadcast a table whose row count was checked; otherwise a plain join."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def calendar(dates: DataFrame) -> DataFrame:
    """(date, t): distinct dates numbered from 0. Bounded by the calendar."""
    days = dates.select("date").distinct()
    return days.withColumn("t", F.row_number().over(W.orderBy("date")) - 1)


def between(df: DataFrame, start=None, end=None, column: str = "date") -> DataFrame:
    """Rows in [start, end]; apply after the windows, or their warm-up is lost."""
    if start is not None and end is not None and str(start) > str(end):
        raise ValueError("start is after end")
    if start is not None:
        df = df.filter(F.col(column) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(column) <= F.lit(end))
    return df


def build_panel(
    bars: Bars, factor: Factor, min_bars: int = 252, start=None, end=None
) -> Bars:
    """Compute, drop symbols with fewer than min_bars values, then slice."""
    computed = with_factors(bars, [factor])
    count = F.count(c(factor.name))
    if bars.symbol_fits:
        df = computed.df.withColumn("bar_count", count.over(W.partitionBy("symbol")))
    else:
        counts = computed.df.groupBy("symbol").agg(count.alias("bar_count"))
        df = computed.df.join(counts, "symbol")
    df = df.filter(F.col("bar_count") >= min_bars).select(
        "date",
        "symbol",
        c(factor.name).alias("factor"),
        "close",
        F.when(F.col("value") > 0, F.col("value")).alias("volume"),
        "bar_count",
    )
    return bars.with_df(between(df, start, end))


def symbol_meta(panel: Bars) -> DataFrame:
    """bar_count and first date with a value, per symbol."""
    return panel.df.groupBy("symbol").agg(
        F.max("bar_count").alias("bar_count"),
        F.min(F.when(F.col("factor").isNotNull(), F.col("date"))).alias("first_valid_date"),
    )


def panel_summary(panel: Bars) -> DataFrame:
    per_date = panel.df.groupBy("date").agg(F.count("factor").alias("n"))
    dates = per_date.agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.min("date").alias("start_date"),
        F.max("date").alias("end_date"),
        F.avg("n").alias("n_mean"),
    )
    # Distinct by grouping: partial counts, no set of symbols in one task.
    symbols = panel.df.groupBy("symbol").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n_symbols"))
    return dates.join(F.broadcast(symbols), F.lit(True)).select(
        "n_symbols", "n_dates", "start_date", "end_date", div("n_mean", "n_symbols").alias("coverage_mean")
    )


def forward_returns(
    panel: Bars, periods: Sequence[int], dates: DataFrame | None = None, column: str = "fwd_{p}"
) -> Bars:
    """close[t + p] / close[t] - 1 where t counts the dates of the whole panel.

    A range frame of exactly p calendar steps finds the later row without
    building the dense date x symbol grid.
    """
    cal = calendar(panel.df if dates is None else dates)
    df = panel.df.join(small(cal, panel.dates), "date")
    back = max(periods)

    def build(d, w):
        by_t = W.partitionBy(*_partition_of(d)).orderBy("t")
        new = {
            column.format(p=p): div(F.first("close").over(by_t.rangeBetween(p, p)), "close") - 1
            for p in periods
        }
        return d.withColumns(new)

    return panel.with_df(windowed(panel.with_df(df), 0, back, build).drop("t"))


def _partition_of(df: DataFrame) -> list[str]:
    return ["symbol"] + (["__chunk"] if "__chunk" in df.columns else [])


def by_period(panel: Bars, periods: Sequence[int], column: str = "fwd_{p}") -> Bars:
    """One row per period: columns fwd_p become rows (period, fwd)."""
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(p).alias("period"), F.col(column.format(p=p)).alias("fwd"))
                for p in periods
            ]
        )
    ).alias("__x")
    names = [n for n in panel.df.columns if n not in {column.format(p=p) for p in periods}]
    return panel.with_df(panel.df.select(*names, pairs).select(*names, "__x.period", "__x.fwd"))


def long_factors(bars: Bars, names: Sequence[str], keep: Sequence[str] = ()) -> Bars:
    """Columns of several factors as rows (date, symbol, factor_name, factor)."""
    items = F.explode(
        F.array(*[F.struct(F.lit(n).alias("factor_name"), c(n).alias("factor")) for n in names])
    ).alias("__x")
    return bars.with_df(
        bars.df.select("date", "symbol", *keep, items).select(
            "date", "symbol", *keep, "__x.factor_name", "__x.factor"
        )
    )
