"""Second layer: does the factor order later returns?"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.factor import Factor, with_factors
from ..functions.frames import Bars
from ..functions.scalar import corr_agg, div
from .crosssection import avg_rank, min_periods, position, top_count
from .panel import by_period, forward_returns, long_factors

MIN_PAIRS = 5


def _both(df: DataFrame, x: str, y: str) -> DataFrame:
    """Blank both sides where one is missing, keeping every date."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    return df.withColumns(
        {"__x": F.when(both, F.col(x)), "__y": F.when(both, F.col(y))}
    )


def daily_ic(
    panel: Bars,
    fwd: str = "fwd",
    method: str = "spearman",
    keys: Sequence[str] = (),
    factor: str = "factor",
    min_pairs: int = MIN_PAIRS,
) -> DataFrame:
    """Correlation across symbols per date (and per extra key)."""
    by = [*keys, "date"]
    df = _both(panel.df, factor, fwd).select(*by, "__x", "__y")
    if method == "spearman":
        df = avg_rank(df, by, "__x", "__rx", panel.date_fits)
        df = avg_rank(df, by, "__y", "__ry", panel.date_fits)
        x, y = "__rx", "__ry"
    elif method == "pearson":
        x, y = "__x", "__y"
    else:
        raise ValueError(f"unknown method {method!r}")
    daily = df.groupBy(*by).agg(F.count("__x").alias("n"), corr_agg(x, y).alias("r"))
    # Digits beyond the twelfth are rounding noise of the sums; without them an
    # uncorrelated day is exactly 0.
    return daily.select(*by, "n", F.when(F.col("n") >= min_pairs, F.round("r", 12)).alias("ic"))


def daily_top_ic(
    panel: Bars,
    fwd: str = "fwd",
    top_pct: float = 0.1,
    method: str = "spearman",
    keys: Sequence[str] = (),
    factor: str = "factor",
) -> DataFrame:
    """The same within the highest share of the factor, at least five symbols."""
    by = [*keys, "date"]
    df = _both(panel.df, factor, fwd)
    sizes = df.groupBy(*by).agg(F.count("__x").alias("__n"))
    valid = df.filter(F.col("__x").isNotNull()).select(*by, "symbol", "__x", "__y")
    order = [F.col("__x").desc(), F.col("symbol")]
    placed = position(valid, by, order, "__p", panel.date_fits)
    if panel.date_fits:
        placed = placed.withColumn("__n", F.count("__x").over(W.partitionBy(*by)))
    else:
        placed = placed.join(sizes, by)
    top = placed.filter(F.col("__p") <= top_count("__n", top_pct, MIN_PAIRS))
    top = panel.with_df(top.drop("__n", "__p"))
    ic = daily_ic(top, "__y", method, keys, "__x").drop("n")
    # Dates without pairs stay in the series with a missing value.
    return sizes.join(ic, by, "left").select(*by, F.col("__n").alias("n"), "ic")


def ic_summary(ic: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    n = F.count("ic")
    stats = ic.groupBy(*keys).agg(
        F.avg("ic").alias("m"),
        F.stddev_samp("ic").alias("s"),
        F.sum((F.col("ic") > 0).cast("double")).alias("up"),
        n.alias("n_days"),
    )
    enough = F.col("n_days") >= 2
    s = F.when(F.col("s") > 0, F.col("s"))
    return stats.select(
        *keys,
        F.when(enough, F.col("m")).alias("mean"),
        F.when(enough, F.col("s")).alias("std"),
        F.when(enough, div("m", s)).alias("ir"),
        F.when(enough, div("m", s) * F.sqrt("n_days")).alias("t_stat"),
        F.when(enough, div("up", "n_days")).alias("pos_ratio"),
        "n_days",
    )


def ic_decay(panel: Bars, periods: Sequence[int], top_pct: float | None = None) -> DataFrame:
    """IC summary per forward period, all periods in one job."""
    long = by_period(panel, periods)
    if top_pct is None:
        ic = daily_ic(long, keys=["period"])
    else:
        ic = daily_top_ic(long, top_pct=top_pct, keys=["period"])
    return ic_summary(ic, ["period"]).select(
        "period",
        F.col("mean").alias("ic_mean"),
        F.col("std").alias("ic_std"),
        F.col("ir").alias("ic_ir"),
    )


def rolling_ic(ic: DataFrame, window: int = 120, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the last dates' IC; one row per date, so the series is small."""
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(-(window - 1), 0)
    mean = F.when(F.count("ic").over(w) >= min_periods(window), F.avg("ic").over(w))
    return ic.select(*keys, "date", F.col("ic").alias("ic_raw"), mean.alias("ic_rolling_mean"))


def icir_series(
    ic: DataFrame, window: int, min_count: int | None = None, keys: Sequence[str] = ()
) -> DataFrame:
    """Rolling mean, deviation and their ratio."""
    need = window if min_count is None else min_count
    w = W.partitionBy(*keys).orderBy("date").rowsBetween(-(window - 1), 0)
    ready = F.count("ic").over(w) >= need
    mean = F.when(ready, F.avg("ic").over(w))
    sd = F.when(ready, F.stddev_samp("ic").over(w))
    return ic.select(
        *keys,
        "date",
        mean.alias("ic_mean"),
        F.when(sd > 0, div(mean, sd)).alias("icir"),
    )


def parameter_grid_ic(
    bars: Bars,
    variants: Sequence[tuple[Mapping, Factor]],
    periods: Sequence[int],
    min_bars: int = 252,
    dates: DataFrame | None = None,
) -> DataFrame:
    """Mean rank IC for every parameter set and period, in one job."""
    labels = {f.name: ", ".join(f"{k}={v}" for k, v in p.items()) for p, f in variants}
    computed = with_factors(bars, [f for _, f in variants])
    computed = forward_returns(computed, periods, dates)
    keep = [f"fwd_{p}" for p in periods]
    long = long_factors(computed, list(labels), keep)
    if min_bars:
        # Partial counts, so that no symbol's history meets in one task.
        counts = long.df.groupBy("factor_name", "symbol").agg(F.count("factor").alias("__n"))
        enough = counts.filter(F.col("__n") >= min_bars).select("factor_name", "symbol")
        long = long.with_df(long.df.join(enough, ["factor_name", "symbol"], "left_semi"))
    long = by_period(long, periods)
    ic = daily_ic(long, keys=["factor_name", "period"])
    label = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return ic_summary(ic, ["factor_name", "period"]).select(
        label[F.col("factor_name")].alias("param_label"), "period", F.col("mean").alias("ic_mean")
    )


def grid_matrix(records: DataFrame, periods: Sequence[int]) -> DataFrame:
    """Parameter sets as rows, periods as columns."""
    return records.groupBy("param_label").pivot("period", list(periods)).agg(F.first("ic_mean"))


def best_params(records: DataFrame) -> DataFrame:
    return records.filter(F.col("ic_mean").isNotNull()).agg(
        # Of equally good sets the last name and period.
        F.max_by(F.struct("param_label", "period", "ic_mean"), F.struct("ic_mean", "param_label", "period")).alias("b")
    ).select("b.*")
