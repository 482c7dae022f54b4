"""Trend r squared against later returns for every formation and holding span."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.factor import with_factors
from ..functions.frames import Bars, windowed
from ..functions.scalar import c, corr_agg, div
from ..functions.trend import trend_r2
from ..operators.crosssection import position, quantiles

KEYS = ["formation_window", "holding_window", "symbol"]


def scan_pairs(bars: Bars, formation: Sequence[int], holding: Sequence[int]) -> DataFrame:
    """Long rows (formation_window, holding_window, symbol, date, r2, fwd)."""
    factors = {n: trend_r2(n) for n in formation}
    computed = with_factors(bars, list(factors.values()))

    def ahead(d, w):
        return d.withColumns(
            {
                f"__f{h}": div(F.lead("close", h).over(w) - F.col("close"), "close") * 100.0
                for h in holding
            }
        )

    df = windowed(computed, 0, max(holding), ahead)
    grid = [
        F.struct(
            F.lit(n).alias("formation_window"),
            F.lit(h).alias("holding_window"),
            c(factors[n].name).alias("r2"),
            F.col(f"__f{h}").alias("fwd"),
        )
        for n in formation
        for h in holding
    ]
    long = df.select("symbol", "date", F.explode(F.array(*grid)).alias("g")).select("symbol", "date", "g.*")
    return long.filter(F.col("r2").isNotNull() & F.col("fwd").isNotNull())


def symbol_rows(
    bars: Bars,
    formation: Sequence[int],
    holding: Sequence[int],
    min_valid_samples: int = 100,
    top_fraction: float = 0.2,
) -> tuple[DataFrame, DataFrame]:
    """Per symbol: correlation, mean return of the best fitting share, hit rate
    of the median split. Also returns the eligible pairs for the daily IC."""
    pairs = scan_pairs(bars, formation, holding)
    fits = bars.symbol_fits
    order = [F.col("r2").desc(), F.col("date")]
    placed = position(pairs, KEYS, order, "p", fits)
    if fits:
        group = W.partitionBy(*KEYS)
        placed = placed.withColumns(
            {"n": F.count(F.lit(1)).over(group), "middle": F.percentile("r2", F.lit(0.5)).over(group)}
        )
    else:
        sizes = pairs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
        marks = quantiles(pairs, KEYS, "r2", [0.5], "q", fits=False)
        placed = placed.join(sizes, KEYS).join(
            marks.select(*KEYS, F.col("q")[0].alias("middle")), KEYS
        )
    top = F.col("p") <= F.greatest(F.ceil(F.col("n") * F.lit(top_fraction)), F.lit(1))
    hit = ((F.col("r2") > F.col("middle")) & (F.col("fwd") > 0)) | (
        (F.col("r2") < F.col("middle")) & (F.col("fwd") < 0)
    )
    enough = F.count(F.lit(1)) >= min_valid_samples
    rows = placed.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("valid_pair_count"),
        enough.alias("eligible"),
        F.when(enough, corr_agg("r2", "fwd")).alias("symbol_corr"),
        F.when(enough, F.avg(F.when(top, F.col("fwd")))).alias("top_buy_return_pct"),
        F.when(enough, F.avg(hit.cast("double"))).alias("hit_rate"),
    )
    eligible = placed.filter(F.col("n") >= min_valid_samples).select(*KEYS, "date", "r2", "fwd")
    return rows, eligible


def summarize(rows: DataFrame) -> DataFrame:
    """Means over the eligible symbols for every formation and holding span."""
    ok = F.col("eligible")
    return rows.groupBy("formation_window", "holding_window").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.sum(ok.cast("long")).alias("eligible_count"),
        F.sum((~ok).cast("long")).alias("skipped_count"),
        F.count("symbol_corr").alias("valid_corr_count"),
        F.sum(F.when(ok, F.col("valid_pair_count")).otherwise(0)).alias("valid_pair_count"),
        F.avg("symbol_corr").alias("mean_symbol_corr"),
        F.avg((F.col("symbol_corr") > 0).cast("double")).alias("positive_symbol_share"),
        F.avg("top_buy_return_pct").alias("mean_top_buy_return_pct"),
        F.avg("hit_rate").alias("mean_hit_rate"),
    )


def cross_section_ic(eligible: DataFrame, min_symbols: int = 3) -> DataFrame:
    """Mean daily Pearson correlation over symbols, dates with enough symbols."""
    span = ["formation_window", "holding_window"]
    daily = (
        eligible.groupBy(*span, "date")
        .agg(F.count(F.lit(1)).alias("n"), corr_agg("r2", "fwd").alias("ic"))
        .filter(F.col("n") >= min_symbols)
    )
    return daily.groupBy(*span).agg(
        F.avg("ic").alias("mean_daily_xs_ic"),
        F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"),
        F.count("ic").alias("valid_dates"),
        F.count(F.lit(1)).alias("eligible_dates"),
    )


def with_cross_section(summary: DataFrame, ic: DataFrame) -> DataFrame:
    """Summary rows with the daily IC of the same spans beside them."""
    return summary.join(ic, ["formation_window", "holding_window"], "left")
