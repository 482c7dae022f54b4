"""Price momentum, return and reversal factors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .building_blocks import daily_return, mean_of, need, span_return, std_of
from .factor import Factor, helper, window_list
from .scalar import div


def price_return(window: int = 60, skip_recent: int = 0) -> Factor:
    name = f"PriceReturn_{window}" + (f"_skip{skip_recent}" if skip_recent else "")

    def build(w):
        now = F.lag("close", skip_recent).over(w) if skip_recent else F.col("close")
        past = F.lag("close", skip_recent + window).over(w)
        return div(now - past, past)

    return Factor(name, build, lookback=window + skip_recent)


def risk_adjusted_return(window: int = 20) -> Factor:
    need(window >= 2, "window must be at least 2")
    vol = std_of("_ret", window, daily_return())

    def build(w):
        spread = F.col(vol.name) * math.sqrt(window)
        return F.when(spread >= 1e-8, div(F.col(f"_ret_{window}"), spread))

    return Factor(f"RiskAdjustedReturn_{window}", build, (vol, span_return(window)))


def intraday_momentum() -> Factor:
    return Factor(
        "IntradayMomentum",
        lambda w: F.when(F.abs("open") >= 1e-12, div(F.col("close") - F.col("open"), "open")),
    )


def overnight_return() -> Factor:
    def build(w):
        prev = F.lag("close", 1).over(w)
        return F.when(F.abs(prev) >= 1e-12, div(F.col("open") - prev, prev))

    return Factor("OvernightReturn", build, lookback=1)


def _point_position(name: str, col: str, pick, window: int) -> Factor:
    need(window >= 2, "window must be at least 2")
    values = helper(f"list_{col}_{window}", lambda w: window_list(w, col, window), lookback=window - 1)
    build = lambda w: (F.array_position(values.name, pick(values.name)) - 1) / F.lit(window - 1.0)
    return Factor(f"{name}_{window}", build, (values,))


def high_point_position(window: int = 20) -> Factor:
    """Where in the window the (first) highest high sits, 0 to 1."""
    return _point_position("HighPointPosition", "high", F.array_max, window)


def low_point_position(window: int = 20) -> Factor:
    return _point_position("LowPointPosition", "low", F.array_min, window)


def time_series_momentum(window: int = 252) -> Factor:
    need(window >= 1, "window must be at least 1")
    ret = F.col(f"_ret_{window}")
    return Factor(
        f"TimeSeriesMomentum_{window}",
        lambda w: F.when(ret > 0, 1.0).when(ret.isNotNull(), 0.0),
        (span_return(window),),
    )


def short_term_reversal(window: int = 1) -> Factor:
    need(window >= 1, "window must be at least 1")
    return Factor(
        f"ShortTermReversal_{window}", lambda w: -F.col(f"_ret_{window}"), (span_return(window),)
    )


def extreme_reversal(window: int = 20, tail_pct: float = 0.1) -> Factor:
    """Contrarian sign when the span return is in a tail of its own window."""
    need(window >= 1, "window must be at least 1")
    need(0 < tail_pct < 0.5, "tail_pct must be in (0, 0.5)")
    label = f"{tail_pct:.2f}".replace("0.", "").rstrip("0") or "0"
    ret = span_return(window)
    values = helper(
        f"list_ret_{window}", lambda w: window_list(w, ret.name, window), ret, lookback=window - 1
    )

    def rank(w):
        xs, x = F.col(values.name), F.col(ret.name)
        less = F.size(F.filter(xs, lambda v: v < x))
        same = F.size(F.filter(xs, lambda v: v == x))
        return F.when(xs.isNotNull(), (less + (same + 1) / F.lit(2.0)) / F.lit(float(window)))

    share = helper(f"xr_rank_{window}", rank, values)
    r = F.col(share.name)
    build = lambda w: (
        F.when(r <= tail_pct, 1.0).when(r >= 1.0 - tail_pct, -1.0).when(r.isNotNull(), 0.0)
    )
    return Factor(f"ExtremeReversal_{window}_p{label}", build, (share,))


def volume_reversal(ret_window: int = 5, vol_window: int = 20) -> Factor:
    need(ret_window >= 1 and vol_window >= 1, "windows must be at least 1")
    ma = mean_of("volume", vol_window)
    return Factor(
        f"VolumeReversal_{ret_window}_{vol_window}",
        lambda w: -F.col(f"_ret_{ret_window}") * div("volume", ma.name),
        (span_return(ret_window), ma),
    )


def daily_rebound() -> Factor:
    return Factor(
        "DailyRebound",
        lambda w: div(F.col("close") - F.col("low"), F.col("high") - F.col("low")),
    )
