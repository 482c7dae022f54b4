"""All three evaluation layers of one factor from one shared panel."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.factor import Factor
from ..functions.frames import Bars
from ..functions.scalar import c
from ..operators import grouping, panel as P, predictive, quality
from ..sources.bars import write_report
from ..sources.session import cut_lineage


@dataclass
class FactorReport:
    panel: Bars
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def write(self, folder: str) -> None:
        """One JSON folder per table."""
        for name, df in self.tables.items():
            write_report(df, f"{folder}/{name}")


def run_factor_analysis(
    bars: Bars,
    factor: Factor,
    periods: Sequence[int] = (1, 5, 10, 20),
    main_period: int = 5,
    n_quantiles: int = 5,
    top_pct: float = 0.1,
    rolling_window: int = 120,
    min_bars: int = 252,
    start=None,
    end=None,
    dates: DataFrame | None = None,
) -> FactorReport:
    """Build the panel once, write it out, and derive every table from it.

    Tables are lazy; each is a small aggregate over dates, groups or periods.
    """
    if main_period not in periods:
        raise ValueError("main_period must be one of the periods")
    panel = P.build_panel(bars, factor, min_bars, start, end)
    panel = P.forward_returns(panel, periods, dates)
    panel = panel.with_df(cut_lineage(panel.df))
    main = panel.with_df(panel.df.withColumn("fwd", F.col(f"fwd_{main_period}")))
    daily = predictive.daily_ic(main)
    top = predictive.daily_top_ic(main, top_pct=top_pct)
    groups = grouping.quantile_returns(main, n=n_quantiles)
    tables = {
        "panel_summary": P.panel_summary(panel),
        "symbol_meta": P.symbol_meta(panel),
        "coverage": quality.coverage(panel),
        "distribution": quality.distribution_stats(panel),
        "daily_percentiles": quality.daily_percentiles(panel),
        "missing_by_volume": quality.missing_by_volume(panel),
        "missing_by_bar_count": quality.missing_by_bar_count(panel),
        "autocorrelation": quality.rank_autocorrelation(panel),
        "rank_ic": daily,
        "rank_ic_summary": predictive.ic_summary(daily),
        "pearson_ic_summary": predictive.ic_summary(predictive.daily_ic(main, method="pearson")),
        "top_ic_summary": predictive.ic_summary(top),
        "ic_decay": predictive.ic_decay(panel, periods),
        "top_ic_decay": predictive.ic_decay(panel, periods, top_pct),
        "rolling_ic": predictive.rolling_ic(daily, rolling_window),
        "top_rolling_ic": predictive.rolling_ic(top, rolling_window),
        "quantile_returns": grouping.quantile_wide(groups, n_quantiles),
        "quantile_summary": grouping.quantile_summary(groups),
        "long_short": grouping.long_short(groups, n_quantiles),
        "long_short_metrics": grouping.long_short_metrics(groups, n_quantiles),
        "cumulative": grouping.cumulative_curves(groups),
        "monotonicity": grouping.monotonicity(groups),
    }
    return FactorReport(panel, tables)


def headline(report: FactorReport) -> DataFrame:
    """The figures a reader looks at first, as (section, key, value)."""
    parts = []
    for name in ("panel_summary", "rank_ic_summary", "pearson_ic_summary", "top_ic_summary", "monotonicity"):
        df = report.tables[name]
        numbers = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "long", "integer")]
        items = F.explode(
            F.array(*[F.struct(F.lit(x).alias("key"), c(x).cast("double").alias("value")) for x in numbers])
        )
        parts.append(df.select(F.lit(name).alias("section"), items.alias("x")).select("section", "x.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
