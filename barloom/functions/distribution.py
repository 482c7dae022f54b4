"""Return-distribution factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .building_blocks import centred, daily_return, kurtosis_over, need, over_windows, skew_over
from .factor import Factor, full, helper
from .scalar import div


def _label(q: float) -> str:
    return f"{q:.2f}".replace("0.", "").rstrip("0") or "0"


def return_skew(window: int = 60) -> Factor:
    need(window >= 3, "window must be at least 3")
    return Factor(
        f"ReturnSkew_{window}",
        lambda w: skew_over(w, "_ctr_ret", window),
        (centred("_ret", daily_return()),),
        lookback=window - 1,
    )


def return_kurtosis(window: int = 60) -> Factor:
    need(window >= 4, "window must be at least 4")
    return Factor(
        f"ReturnKurtosis_{window}",
        lambda w: kurtosis_over(w, "_ctr_ret", window),
        (centred("_ret", daily_return()),),
        lookback=window - 1,
    )


def _tail_of(name: str, window: int, q: float, pick) -> Factor:
    """A statistic of each window's sorted returns, one Arrow pass."""
    need(window >= 1, "window must be at least 1")
    need(0 < q < 1, "q must be in (0, 1)")
    value = helper(
        f"{name}_{window}_{_label(q)}",
        lambda pdf: over_windows(pdf["_ret"], window, lambda x: pick(np.sort(x, axis=1), q)),
        daily_return(),
        lookback=window - 1,
        kind="grouped",
    )
    return Factor(f"{name}_{window}_q{_label(q)}", lambda w: F.col(value.name), (value,))


def _interpolated(ordered: np.ndarray, q: float) -> np.ndarray:
    at = q * (ordered.shape[1] - 1)
    low = int(at)
    high = min(low + 1, ordered.shape[1] - 1)
    return ordered[:, low] + (ordered[:, high] - ordered[:, low]) * (at - low)


def _tail_mean(ordered: np.ndarray, q: float) -> np.ndarray:
    tail = ordered <= _interpolated(ordered, q)[:, None]
    return (ordered * tail).sum(axis=1) / tail.sum(axis=1)


def historical_var(window: int = 252, q: float = 0.05) -> Factor:
    """Linear-interpolated quantile of the window's returns."""
    return _tail_of("HistoricalVaR", window, q, _interpolated)


def cvar(window: int = 252, q: float = 0.05) -> Factor:
    """Mean of the returns at or below the quantile."""
    return _tail_of("CVaR", window, q, _tail_mean)


def _excursion(name: str, agg, window: int) -> Factor:
    need(window >= 1, "window must be at least 1")

    def build(w):
        ref = F.lag("close", window).over(w)
        return F.when(F.abs(ref) >= 1e-12, div(full(w, "close", window, agg), ref) - 1)

    return Factor(f"{name}_{window}", build, lookback=window)


def max_favorable_excursion(window: int = 20) -> Factor:
    return _excursion("MFE", F.max, window)


def max_adverse_excursion(window: int = 20) -> Factor:
    return _excursion("MAE", F.min, window)


def information_discreteness(window: int = 20) -> Factor:
    """Share of bars whose return changed sign."""
    need(window >= 1, "window must be at least 1")
    ret = daily_return()
    flip = helper(
        "flip",
        lambda w: (F.signum("_ret") != F.signum(F.lag("_ret", 1).over(w))).cast("double"),
        ret,
        lookback=1,
    )
    return Factor(
        f"ID_{window}",
        lambda w: full(w, "_flip", window, F.sum) / F.lit(float(window)),
        (flip,),
        lookback=window - 1,
    )
