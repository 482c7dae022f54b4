"""First layer: is the factor there, and how is it distributed?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Bars, windowed
from ..functions.scalar import corr_agg, div
from .crosssection import avg_rank, quantile_group, quantiles

# Published percentiles.
DISTRIBUTION_POINTS = {"p01": 1, "p05": 5, "p25": 25, "p50": 50, "p75": 75, "p95": 95, "p99": 99}
DAILY_POINTS = (5, 25, 50, 75, 95)
LAGS = (1, 5, 10, 20)


def coverage(panel: Bars) -> DataFrame:
    """Share of the panel's symbols with a value, per date."""
    symbols = panel.df.groupBy("symbol").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n_symbols"))
    per_date = panel.df.groupBy("date").agg(F.count("factor").alias("n"))
    return per_date.join(F.broadcast(symbols), F.lit(True)).select(
        "date", div("n", "n_symbols").alias("coverage")
    )


def distribution_stats(panel: Bars) -> DataFrame:
    """One row over the whole panel; skew and excess kurtosis are population."""
    x = F.col("factor")
    moments = panel.df.agg(
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        F.skewness(x).alias("skewness"),
        F.kurtosis(x).alias("kurtosis"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
    )
    probs = [p / 100 for p in DISTRIBUTION_POINTS.values()]
    marks = quantiles(panel.df, [], "factor", probs, "q", panel.total_fits)
    points = [F.col("q")[i].alias(n) for i, n in enumerate(DISTRIBUTION_POINTS)]
    return moments.join(F.broadcast(marks), F.lit(True)).select(*moments.columns, *points)


def daily_percentiles(panel: Bars, points: Sequence[int] = DAILY_POINTS) -> DataFrame:
    marks = quantiles(panel.df, ["date"], "factor", [p / 100 for p in points], "q", panel.date_fits)
    return marks.select("date", *[F.col("q")[i].alias(f"P{p}") for i, p in enumerate(points)])


def percentile_summary(panel: Bars, points: Sequence[int] = DAILY_POINTS) -> DataFrame:
    """Mean over dates of each daily percentile."""
    daily = daily_percentiles(panel, points)
    return daily.agg(*[F.avg(f"P{p}").alias(f"P{p}_mean") for p in points])


def _tercile(per_symbol: DataFrame, measure: str, n: int, fits: bool) -> DataFrame:
    """Quantile group per symbol; equal-width bins when edges coincide."""
    usable = per_symbol.filter(F.col(measure) > 0).withColumn("__all", F.lit(1))
    keyed = quantile_group(usable, ["__all"], measure, n, "q_group", fits)
    span = keyed.agg(
        F.min(measure).alias("__lo"), F.max(measure).alias("__hi"),
        F.max("q_group").alias("__top"), F.count(F.lit(1)).alias("__n"),
    )
    keyed = keyed.join(F.broadcast(span), F.lit(True))
    width = (F.col("__hi") - F.col("__lo")) / F.lit(float(n))
    even = F.greatest(F.ceil(div(F.col(measure) - F.col("__lo"), width)), F.lit(1))
    group = F.when(F.col("__top") == n, F.col("q_group")).otherwise(even).cast("int")
    return keyed.filter(F.col("__n") >= n).withColumn("group", group).drop(
        "__all", "__lo", "__hi", "__top", "__n", "q_group"
    )


def _missing_rate(panel: Bars, groups: DataFrame) -> DataFrame:
    """Missing cells of the date x symbol grid per group of symbols."""
    dates = panel.df.groupBy("date").agg(F.lit(1).alias("one")).agg(F.count("one").alias("n_dates"))
    return (
        groups.groupBy("group")
        .agg(F.sum("n_values").alias("n"), F.count(F.lit(1)).alias("k"))
        .join(F.broadcast(dates), F.lit(True))
        .select("group", (1 - div("n", F.col("k") * F.col("n_dates"))).alias("missing_rate"))
    )


def missing_by_volume(panel: Bars, n_groups: int = 3) -> DataFrame:
    per_symbol = panel.df.groupBy("symbol").agg(
        F.avg("volume").alias("measure"), F.count("factor").alias("n_values")
    )
    return _missing_rate(panel, _tercile(per_symbol, "measure", n_groups, panel.symbols_fit))


def missing_by_bar_count(panel: Bars, n_groups: int = 3) -> DataFrame:
    per_symbol = panel.df.groupBy("symbol").agg(
        F.max("bar_count").cast("double").alias("measure"), F.count("factor").alias("n_values")
    )
    return _missing_rate(panel, _tercile(per_symbol, "measure", n_groups, panel.symbols_fit))


def rank_autocorrelation(panel: Bars, lags: Sequence[int] = LAGS) -> DataFrame:
    """Spearman of each symbol's values with its own earlier values.

    Symbols need more than lag + 10 values and 20 pairs; the result is the mean,
    median and sample deviation over symbols.
    """
    values = panel.with_df(
        panel.df.filter(F.col("factor").isNotNull()).select("symbol", "date", "factor")
    )

    def build(d, w):
        helpers = [n for n in d.columns if n.startswith("__")]
        return d.withColumns({f"__lag{k}": F.lag("factor", k).over(w) for k in lags}).select(
            "symbol",
            "date",
            "factor",
            *helpers,
            F.explode(
                F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"__lag{k}").alias("x0")) for k in lags])
            ).alias("__x"),
        )

    pairs = windowed(values, max(lags), 0, build)
    pairs = pairs.select("symbol", F.col("__x.lag").alias("lag"), F.col("__x.x0").alias("x0"), "factor")
    pairs = pairs.filter(F.col("x0").isNotNull())
    ranked = avg_rank(pairs, ["symbol", "lag"], "factor", "r1", panel.symbol_fits)
    ranked = avg_rank(ranked, ["symbol", "lag"], "x0", "r0", panel.symbol_fits)
    per_symbol = (
        ranked.groupBy("lag", "symbol")
        .agg(corr_agg("r0", "r1").alias("r"), F.count(F.lit(1)).alias("n"))
        .filter((F.col("n") >= 20) & (F.col("n") > 10))
    )
    middle = quantiles(per_symbol, ["lag"], "r", [0.5], "q", panel.symbols_fit)
    stats = per_symbol.groupBy("lag").agg(
        F.avg("r").alias("mean_autocorr"), F.stddev_samp("r").alias("std_autocorr")
    )
    return stats.join(middle, "lag").select(
        "lag", "mean_autocorr", F.col("q")[0].alias("median_autocorr"), "std_autocorr"
    )
