"""Volatility, drawdown and range factors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .building_blocks import daily_return, mean_of, need, std_of, true_range
from .factor import Factor, full, helper
from .scalar import clip, div, ln

YEAR = 252  # bars per year


def volatility(window: int = 20, annualize: bool = False) -> Factor:
    need(window >= 2, "window must be at least 2")
    sd = std_of("_ret", window, daily_return())
    scale = math.sqrt(YEAR) if annualize else 1.0
    suffix = "_ann" if annualize else ""
    return Factor(f"Volatility_{window}{suffix}", lambda w: F.col(sd.name) * scale, (sd,))


def downside_volatility(window: int = 20) -> Factor:
    need(window >= 2, "window must be at least 2")
    down = helper("down", lambda w: clip("_ret", hi=0.0), daily_return())
    return Factor(
        f"DownsideVolatility_{window}",
        lambda w: full(w, "_down", window, F.stddev_samp),
        (down,),
        lookback=window - 1,
    )


def _log_range() -> Factor:
    return helper("ln_hl", lambda w: ln(div("high", "low")))


def parkinson_volatility(window: int = 20, annualize: bool = False) -> Factor:
    need(window >= 1, "window must be at least 1")
    sq = helper("ln_hl_sq", lambda w: F.col("_ln_hl") * F.col("_ln_hl"), _log_range())
    scale = math.sqrt(YEAR) if annualize else 1.0
    suffix = "_ann" if annualize else ""
    build = lambda w: F.sqrt(full(w, "_ln_hl_sq", window, F.avg) / (4.0 * math.log(2.0))) * scale
    return Factor(f"ParkinsonVolatility_{window}{suffix}", build, (sq,), lookback=window - 1)


def garman_klass_volatility(window: int = 20, annualize: bool = False) -> Factor:
    need(window >= 1, "window must be at least 1")

    def daily(w):
        hl, co = F.col("_ln_hl"), ln(div("close", "open"))
        return clip(0.5 * hl * hl - (2.0 * math.log(2.0) - 1.0) * co * co, lo=0.0)

    var = helper("gk_var", daily, _log_range())
    scale = math.sqrt(YEAR) if annualize else 1.0
    suffix = "_ann" if annualize else ""
    return Factor(
        f"GarmanKlassVolatility_{window}{suffix}",
        lambda w: F.sqrt(full(w, "_gk_var", window, F.avg)) * scale,
        (var,),
        lookback=window - 1,
    )


def vol_of_vol(vol_window: int = 20, std_window: int = 60) -> Factor:
    need(vol_window >= 2 and std_window >= 2, "windows must be at least 2")
    sd = std_of("_ret", vol_window, daily_return())
    return Factor(
        f"VolOfVol_{vol_window}_{std_window}",
        lambda w: full(w, sd.name, std_window, F.stddev_samp),
        (sd,),
        lookback=std_window - 1,
    )


def _drawdown(window: int) -> Factor:
    need(window >= 1, "window must be at least 1")
    return helper(
        f"dd_{window}",
        lambda w: div("close", full(w, "close", window, F.max)) - 1,
        lookback=window - 1,
    )


def max_drawdown(window: int = 60) -> Factor:
    dd = _drawdown(window)
    return Factor(f"MaxDrawdown_{window}", lambda w: F.col(dd.name), (dd,))


def avg_drawdown(window: int = 60) -> Factor:
    dd = _drawdown(window)
    return Factor(
        f"AvgDrawdown_{window}",
        lambda w: full(w, dd.name, window, F.avg),
        (dd,),
        lookback=window - 1,
    )


def average_true_range(
    window: int = 25, normalize_by_close: bool = False, normalize_first: bool = False
) -> Factor:
    need(window >= 1, "window must be at least 1")
    if normalize_by_close and normalize_first:
        share = helper("tr_pct", lambda w: div("_tr", "close"), true_range())
        ma = mean_of("_tr_pct", window, share)
        return Factor(f"ATR_{window}_tr_pct", lambda w: F.col(ma.name), (ma,))
    ma = mean_of("_tr", window, true_range())
    if normalize_by_close:
        return Factor(f"ATR_{window}_pct", lambda w: div(ma.name, "close"), (ma,))
    return Factor(f"ATR_{window}", lambda w: F.col(ma.name), (ma,))
