"""Return series to risk and return figures.

A return series has one row per date (and key), so every window here is bounded
by the calendar.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import Bars, running, windowed
from ..functions.scalar import div

YEAR = 252  # bars per year


def _series(keys: Sequence[str]):
    return W.partitionBy(*keys).orderBy("date")


def equity_curve(returns: DataFrame, keys: Sequence[str] = (), start: float = 1.0) -> DataFrame:
    w = _series(keys).rowsBetween(W.unboundedPreceding, 0)
    return returns.withColumn("equity", F.lit(start) * F.product(1 + F.col("ret")).over(w))


def drawdowns(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds equity, its running peak and the drawdown from it."""
    w = _series(keys).rowsBetween(W.unboundedPreceding, 0)
    df = equity_curve(returns, keys).withColumn("peak", F.max("equity").over(w))
    return df.withColumn("drawdown", div("equity", "peak") - 1)


def _metrics(rf: float) -> dict[str, Column]:
    n = F.count("ret")
    growth = F.product(1 + F.col("ret"))
    ann = F.pow(growth, div(F.lit(float(YEAR)), n)) - 1
    vol = F.when(n >= 2, F.stddev_samp("ret") * math.sqrt(YEAR))
    return {
        "n": n,
        "cumulative_return": growth - 1,
        "annualised_return": ann,
        "annualised_volatility": vol,
        "sharpe": F.when(vol > 0, div(ann - rf, vol)),
        "max_drawdown": F.abs(F.min("drawdown")),
        "win_rate": F.avg((F.col("ret") > 0).cast("double")),
    }


def return_metrics(returns: DataFrame, keys: Sequence[str] = (), rf: float = 0.0) -> DataFrame:
    """One row per key: cumulative, annualised, volatility, Sharpe, drawdown."""
    df = drawdowns(returns, keys)
    return df.groupBy(*keys).agg(*[x.alias(k) for k, x in _metrics(rf).items()])


def information_ratio(strategy: DataFrame, benchmark: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Annual excess over tracking error on the dates both have."""
    both = strategy.join(benchmark.withColumnRenamed("ret", "__b"), "date", "inner")
    excess = both.withColumn("ret", F.col("ret") - F.col("__b"))
    n = F.count("ret")
    te = F.stddev_samp("ret") * math.sqrt(YEAR)
    ann = F.pow(F.product(1 + F.col("ret")), div(F.lit(float(YEAR)), n)) - 1
    return excess.groupBy(*keys).agg(
        F.when((n >= 2) & (te > 0), div(ann, te)).alias("information_ratio")
    )


_FREQ = {"YE": "year", "QE": "quarter", "ME": "month", "W": "week"}


def periodic_metrics(
    returns: DataFrame, freq: str = "YE", keys: Sequence[str] = (), rf: float = 0.0
) -> DataFrame:
    """Metrics per calendar period; periods with fewer than two returns drop."""
    unit = _FREQ.get(freq, freq)
    df = returns.withColumn("period_start", F.to_date(F.date_trunc(unit, "date")))
    return _period_rows(df, [*keys, "period_start"], rf)


def range_metrics(
    returns: DataFrame, periods: DataFrame, keys: Sequence[str] = (), rf: float = 0.0
) -> DataFrame:
    """Metrics per row of a small table (period, start, end); ends included."""
    inside = (F.col("date") >= F.col("start")) & (F.col("date") <= F.col("end"))
    df = returns.join(F.broadcast(periods), inside, "inner").drop("start", "end")
    return _period_rows(df, [*keys, "period"], rf)


def _period_rows(df: DataFrame, keys: list[str], rf: float) -> DataFrame:
    spans = F.min("date").alias("first_date"), F.max("date").alias("last_date")
    cols = [x.alias(k) for k, x in _metrics(rf).items()]
    rows = drawdowns(df.filter(F.col("ret").isNotNull()), keys).groupBy(*keys).agg(*spans, *cols)
    calmar = F.when(F.col("max_drawdown") > 0, div("annualised_return", "max_drawdown"))
    return rows.filter(F.col("n") >= 2).withColumn("calmar", calmar)


def drawdown_details(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Depth of the worst drawdown, its trough and the peak before it."""
    df = drawdowns(returns, keys)
    w = _series(keys).rowsBetween(W.unboundedPreceding, 0)
    at_peak = F.when(F.col("equity") == F.col("peak"), F.col("date"))
    # The first date that reached the peak level still in force.
    new_peak = F.col("equity") > F.coalesce(F.lag("peak", 1).over(_series(keys)), F.lit(float("-inf")))
    df = df.withColumn("__p", F.when(new_peak, F.col("date")))
    df = df.withColumn("peak_date", F.last("__p", ignorenulls=True).over(w))
    worst = F.struct(F.col("drawdown"), F.col("date"))
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct("drawdown", "date", "peak_date"), worst).alias("x"))
        .select(
            *keys,
            F.abs("x.drawdown").alias("max_drawdown"),
            F.col("x.peak_date").alias("peak_date"),
            F.col("x.date").alias("trough_date"),
        )
    )


def annual_returns(returns: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    df = returns.withColumn("year", F.year("date"))
    return df.groupBy(*keys, "year").agg((F.product(1 + F.col("ret")) - 1).alias("annual_return"))


def buy_and_hold(bars: Bars, start=None) -> Bars:
    """Change of positive closes per symbol and date."""
    priced = bars.with_df(bars.df.filter(F.col("close") > 0).select("symbol", "date", "close"))

    def build(d, w):
        return d.withColumn("ret", div("close", F.lag("close", 1).over(w)) - 1)

    df = windowed(priced, 1, 0, build).filter(F.col("ret").isNotNull())
    if start is not None:
        df = df.filter(F.col("date") >= F.lit(start))
    return bars.with_df(df.select("symbol", "date", "ret"))


def normalized_weights(symbols: DataFrame, weights: DataFrame | None = None) -> DataFrame:
    """Non-negative weights that sum to one; equal when none is positive."""
    if weights is None:
        df = symbols.select("symbol").distinct().withColumn("raw", F.lit(0.0))
    else:
        raw = weights.select("symbol", F.greatest(F.col("weight"), F.lit(0.0)).alias("raw"))
        df = symbols.select("symbol").distinct().join(raw, "symbol", "left").fillna(0.0, ["raw"])
    total = df.agg(F.sum("raw").alias("__t"), F.count(F.lit(1)).alias("__n"))
    df = df.join(F.broadcast(total), F.lit(True))
    weight = F.when(F.col("__t") > 0, div("raw", "__t")).otherwise(div(F.lit(1.0), "__n"))
    return df.select("symbol", weight.alias("weight"))


def weighted_benchmark(returns: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight x return per date; a symbol without a return adds 0."""
    joined = returns.join(weights, "symbol")
    return joined.groupBy("date").agg(F.sum(F.col("weight") * F.coalesce("ret", F.lit(0.0))).alias("ret"))


def strategy_vs_benchmark(strategy: DataFrame, benchmark: DataFrame, rf: float = 0.0) -> DataFrame:
    """One row of figures for both, benchmark clipped to the strategy's dates."""
    span = strategy.agg(F.min("date").alias("__a"), F.max("date").alias("__b"))
    clipped = benchmark.join(
        F.broadcast(span), (F.col("date") >= F.col("__a")) & (F.col("date") <= F.col("__b"))
    ).drop("__a", "__b")
    s, b = return_metrics(strategy, rf=rf), return_metrics(clipped)
    b = b.select(
        F.col("cumulative_return").alias("benchmark_cumulative_return"),
        F.col("annualised_return").alias("benchmark_annualised_return"),
    )
    row = s.join(b, F.lit(True)).join(information_ratio(strategy, clipped), F.lit(True))
    excess = div(F.col("cumulative_return") + 1, F.col("benchmark_cumulative_return") + 1) - 1
    return row.withColumn("excess_cumulative_return", excess)


def equity_curves(strategy: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Strategy and benchmark levels by date, outer-joined."""
    span = strategy.agg(F.min("date").alias("__a"), F.max("date").alias("__b"))
    clipped = benchmark.join(
        F.broadcast(span), (F.col("date") >= F.col("__a")) & (F.col("date") <= F.col("__b"))
    )
    a = equity_curve(strategy).select("date", F.col("equity").alias("strategy"))
    b = equity_curve(clipped).select("date", F.col("equity").alias("benchmark"))
    return a.join(b, "date", "full_outer")


def position_from_signals(bars: Bars, entry: Column, exit: Column) -> Bars:
    """Long (1) or flat (0) per bar: enter when flat and entry, leave when long
    and exit.

    Each bar maps the two states: entry alone sets 1, exit alone sets 0, both
    toggle, none keeps. The state is the last set value plus the parity of the
    toggles after it, so only running scans are needed.
    """

    e, x = F.coalesce(entry, F.lit(False)), F.coalesce(exit, F.lit(False))
    df = bars.df.withColumns(
        {
            "__set": F.when(e & ~x, 1.0).when(x & ~e, 0.0),
            "__tog": (e & x).cast("double"),
        }
    )
    df = running(bars.with_df(df), {"__togs": ("sum", F.col("__tog"))})
    marks = {
        "__last": ("last", F.col("__set")),
        "__at": ("last", F.when(F.col("__set").isNotNull(), F.col("__togs"))),
    }
    df = running(bars.with_df(df), marks)
    flips = F.col("__togs") - F.coalesce("__at", F.lit(0.0))
    state = (F.coalesce("__last", F.lit(0.0)) + flips) % 2
    return bars.with_df(
        df.withColumn("position", state.cast("int")).drop("__set", "__tog", "__togs", "__last", "__at")
    )


def drawdown_exit(lookback: int = 60, multiple: float = 3.0, atr: str = "atr"):
    """Window column for the rule: leave when the close is more than a multiple
    of the ATR below the highest close of the last bars. Needs no memory, so it
    is a window column; a short history uses the bars there are."""

    def column(w):
        high = F.max("close").over(w.rowsBetween(-(lookback - 1), 0))
        return high - F.col("close") > multiple * F.coalesce(F.col(atr), F.lit(0.0))

    return column


def lookback_positions(
    bars: Bars, entry: Column, lookback: int = 60, multiple: float = 3.0, atr: str = "atr"
) -> Bars:
    """Enter on the entry signal, leave on a fall of `multiple` ATRs from the
    highest close of the last `lookback` bars."""
    rule = drawdown_exit(lookback, multiple, atr)
    marked = windowed(bars, lookback - 1, 0, lambda d, w: d.withColumn("__x", rule(w)))
    out = position_from_signals(bars.with_df(marked), entry, F.col("__x"))
    return out.with_df(out.df.drop("__x"))


def peak_positions(bars: Bars, entry: str, multiple: float = 3.0, atr: str = "atr") -> Bars:
    """The same with the highest close since the entry. Whether a bar matters
    depends on the state before it, so each symbol is walked in order."""
    if not bars.symbol_fits:
        raise ValueError("the peak rule walks a symbol in order; use lookback_positions for longer ones")
    fields = bars.df.schema.fields + [T.StructField("position", T.IntegerType())]

    def walk(pdf):
        pdf = pdf.sort_values("date", ignore_index=True)
        held, peak, out = 0, 0.0, []
        rows = zip(pdf["close"], pdf[entry].fillna(False).astype(bool), pdf[atr].fillna(0.0))
        for close, enter, gap in rows:
            if not held:
                if enter:
                    held, peak = 1, close
            else:
                peak = max(peak, close)
                if peak - close > multiple * gap:
                    held = 0
            out.append(held)
        return pdf.assign(position=out)

    return bars.with_df(bars.df.groupBy("symbol").applyInPandas(walk, T.StructType(fields)))


def strategy_returns(bars: Bars, warmup: int = 0) -> Bars:
    """Position of the previous bar times the bar's return, warm-up trimmed."""

    def build(d, w):
        ret = div("close", F.lag("close", 1).over(w)) - 1
        held = F.lag("position", 1).over(w)
        return d.withColumns({"__held": held, "__ret": ret})

    df = windowed(bars, 1, 0, build).withColumn("ret", F.col("__held") * F.col("__ret"))
    if warmup:

        df = running(bars.with_df(df), {"__n": ("sum", F.lit(1.0))}).filter(F.col("__n") > warmup)
        df = df.drop("__n")
    return bars.with_df(df.filter(F.col("ret").isNotNull()).drop("__held", "__ret"))


def trade_table(bars: Bars) -> DataFrame:
    """One row per completed long spell: entry, exit, profit.

    A position taken on a bar's signal is filled at that bar's close and closed
    at the close of the bar that turns flat.
    """

    def build(d, w):
        before = F.coalesce(F.lag("position", 1).over(w), F.lit(0))
        return d.withColumn("__d", F.col("position") - before)

    df = windowed(bars, 1, 0, build)
    df = running(
        bars.with_df(df),
        {
            "__entry_date": ("last", F.when(F.col("__d") == 1, F.col("date"))),
            "__entry_close": ("last", F.when(F.col("__d") == 1, F.col("close"))),
        },
    )
    return df.filter(F.col("__d") == -1).select(
        "symbol",
        F.col("__entry_date").alias("entry_date"),
        F.col("date").alias("exit_date"),
        F.col("__entry_close").alias("entry_price"),
        F.col("close").alias("exit_price"),
        (div("close", "__entry_close") - 1).alias("pnl"),
    )


def trade_counts(trades: DataFrame, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    won, lost = (F.col("pnl") > 0).cast("long"), (F.col("pnl") <= 0).cast("long")
    return trades.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades_total"),
        F.sum(won).alias("trades_won"),
        F.sum(lost).alias("trades_lost"),
        F.avg(won.cast("double")).alias("win_rate"),
    )
