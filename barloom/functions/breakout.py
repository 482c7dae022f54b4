"""Breakout and channel factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .averages import long_ma_filter
from .building_blocks import mean_of, need, true_range
from .factor import Factor, full
from .scalar import div
from .trend import entry_state


def new_high(high_window: int = 50, low_window: int = 25, use_long_filter: bool = True) -> Factor:
    """+1 at a window high (and up trend), -1 at the only low of its window.

    Never missing: bars without a full window give 0. The close is the only low
    when it is under every other close of the window.
    """
    need(high_window >= 1 and low_window >= 1, "windows must be at least 1")
    gate = long_ma_filter()

    def build(w):
        top = full(w, "close", high_window, F.max)
        high = F.col("close") >= top
        if use_long_filter:
            high = high & F.col(gate.name)
        others = w.rowsBetween(-(low_window - 1), -1)
        if low_window == 1:
            low = F.lit(True)
        else:
            low = (F.count("close").over(others) == low_window - 1) & (
                F.col("close") < F.min("close").over(others)
            )
        signal = F.when(high, 1.0).when(low, -1.0)
        return F.coalesce(signal, F.lit(0.0))

    name = "NewHigh" if (high_window, low_window, use_long_filter) == (50, 25, True) else (
        f"NewHigh_{high_window}_{low_window}" + ("" if use_long_filter else "_nofilter")
    )
    deps = (gate,) if use_long_filter else ()
    return Factor(name, build, deps, lookback=max(high_window, low_window) - 1)


def change_since_new_high(
    long_period: int = 50, short_period: int = 25, use_long_filter: bool = False
) -> Factor:
    signal = new_high(long_period, short_period, use_long_filter)
    state, _, price = entry_state(signal.name, signal)
    return Factor(
        "ChangeSinceNewHigh",
        lambda w: F.when(F.col(state.name) == 1, div(F.col("close") - F.col(price.name), price.name)),
        (state, price),
    )


def new_high_continuous(window: int = 50) -> Factor:
    need(window >= 1, "window must be at least 1")

    def build(w):
        top = full(w, "high", window, F.max)
        return div(F.col("close") - top, top)

    return Factor(f"NewHighContinuous_{window}", build, lookback=window - 1)


def new_low_continuous(window: int = 50) -> Factor:
    need(window >= 1, "window must be at least 1")

    def build(w):
        bottom = full(w, "low", window, F.min)
        return div(F.col("close") - bottom, bottom)

    return Factor(f"NewLowContinuous_{window}", build, lookback=window - 1)


def donchian_position(window: int = 20) -> Factor:
    need(window >= 1, "window must be at least 1")

    def build(w):
        top, bottom = full(w, "high", window, F.max), full(w, "low", window, F.min)
        return F.when(top - bottom > 1e-12, div(F.col("close") - bottom, top - bottom)).when(
            top - bottom <= 1e-12, 0.5
        )

    return Factor(f"DonchianPosition_{window}", build, lookback=window - 1)


def atr_ratio(window: int = 25) -> Factor:
    need(window >= 1, "window must be at least 1")
    atr = mean_of("_tr", window, true_range())
    return Factor(f"ATRRatio_{window}", lambda w: div(atr.name, "close"), (atr,))


def chandelier_exit(n: int = 22, atr_window: int = 22) -> Factor:
    need(n >= 1 and atr_window >= 1, "windows must be at least 1")
    atr = mean_of("_tr", atr_window, true_range())
    return Factor(
        f"ChandelierExit_{n}_{atr_window}",
        lambda w: div(F.col("close") - full(w, "high", n, F.max), atr.name),
        (atr,),
        lookback=n - 1,
    )
