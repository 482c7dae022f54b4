"""The end-to-end question: does past return order later return?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.factor import with_factors
from ..functions.library import make
from ..functions.scalar import c, rounded
from ..operators.panel import forward_returns
from ..operators.predictive import daily_ic, ic_summary
from ..sources.demo import load_bars


def rank_ic_weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = load_bars(spark, sf_dir, period="week")
    factor = make("PriceReturn", window=20)
    panel = with_factors(bars, [factor])
    panel = panel.with_df(panel.df.select("symbol", "date", "close", c(factor.name).alias("factor")))
    panel = forward_returns(panel, [5], dates=bars.df, column="fwd")
    summary = ic_summary(daily_ic(panel))
    return summary.select("n_days", *[rounded(x).alias(x) for x in ("mean", "std", "ir", "t_stat", "pos_ratio")])
