"""Trend quality, regression and resistance-support factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .building_blocks import (
    centred,
    decayed,
    line_r2,
    line_slope,
    log_price,
    need,
    over_windows,
    position,
    span_alpha,
    true_range,
)
from .factor import Factor, full, helper
from .frames import last_n
from .scalar import clip, div


def rolling_ols(window: int = 20, value_column: str = "close", output: str = "slope") -> Factor:
    need(window >= 2, "window must be at least 2")
    need(output in ("slope", "r2", "r_squared"), "output must be slope, r2 or r_squared")
    kind = "slope" if output == "slope" else "r2"
    line = line_slope if kind == "slope" else line_r2
    y = centred(value_column)
    return Factor(
        f"RollingOLS_{value_column}_{window}_{kind}",
        lambda w: line(w, y.name, window),
        (position(), y),
        lookback=window - 1,
    )


def trend_r2(window: int = 120, output: str = "r2") -> Factor:
    """Line fit of the cumulative return since the window's first bar.

    Dividing by the first close only scales the line, so r squared is that of
    the close itself.
    """
    need(window >= 2, "window must be at least 2")
    need(output in ("slope", "r2", "r_squared"), "output must be slope, r2 or r_squared")
    kind = "slope" if output == "slope" else "r2"

    def build(w):
        first = F.first("close").over(last_n(w, window))
        if kind == "slope":
            return div(line_slope(w, "_ctr_close", window), first)
        return F.when(first != 0, line_r2(w, "_ctr_close", window))

    deps = (position(), centred("close"))
    return Factor(f"TrendR2_{window}_{kind}", build, deps, lookback=window - 1)


def _rescaled_range(logs: np.ndarray) -> np.ndarray:
    """ln(R/S) / ln(n) per row of stacked log prices.

    The running sum of returns less their mean is the log price less the chord
    between the window's ends.
    """
    n = logs.shape[1] - 1
    steps = np.arange(n + 1) / n
    chord = logs[:, :1] + (logs[:, -1:] - logs[:, :1]) * steps
    dev = logs - chord
    spread = np.diff(logs, axis=1).std(axis=1, ddof=1)
    reach = dev.max(axis=1) - dev.min(axis=1)
    ok = (spread >= 1e-12) & (reach > 0)
    ratio = np.divide(reach, spread, out=np.full(len(logs), np.nan), where=ok)
    return np.log(ratio) / np.log(n)


def hurst_exponent(window: int = 120) -> Factor:
    need(window >= 5, "window must leave at least four returns")
    logs = log_price()
    value = helper(
        f"hurst_{window}",
        lambda pdf: over_windows(pdf["_lnp"], window, _rescaled_range),
        logs,
        lookback=window - 1,
        kind="grouped",
    )
    return Factor(f"HurstExponent_{window}", lambda w: F.col(value.name), (value,))


def _move() -> Factor:
    return helper("move", lambda w: F.abs(F.col("close") - F.lag("close", 1).over(w)), lookback=1)


def kaufman_er(window: int = 20) -> Factor:
    need(window >= 1, "window must be at least 1")

    def build(w):
        net = F.abs(F.col("close") - F.lag("close", window).over(w))
        return clip(div(net, full(w, "_move", window, F.sum)), 0.0, 1.0)

    return Factor(f"KaufmanER_{window}", build, (_move(),), lookback=window)


def up_down_ratio(window: int = 20) -> Factor:
    need(window >= 1, "window must be at least 1")
    up = helper(
        "up", lambda w: (F.col("close") > F.lag("close", 1).over(w)).cast("double"), lookback=1
    )
    return Factor(
        f"UpDownRatio_{window}",
        lambda w: full(w, "_up", window, F.sum) / F.lit(float(window)),
        (up,),
        lookback=window - 1,
    )


def _streak(name: str, tag: str, breaks) -> Factor:
    """Bars since the last break, counted from the first bar on."""
    pos = position()
    cut = helper(
        f"break_{tag}",
        lambda w: F.when(breaks(F.col("close"), F.lag("close", 1).over(w)), F.col("_pos")),
        pos,
        lookback=1,
    )
    last_cut = helper(
        f"last_break_{tag}", lambda: ("last", F.col(cut.name)), cut, kind="running"
    )
    build = lambda w: F.col("_pos") - F.coalesce(F.col(last_cut.name), F.lit(1.0))
    return Factor(name, build, (last_cut, pos))


def consecutive_up_days() -> Factor:
    return _streak("ConsecutiveUpDays", "up", lambda now, prev: now <= prev)


def consecutive_down_days() -> Factor:
    return _streak("ConsecutiveDownDays", "down", lambda now, prev: now >= prev)


def adx(window: int = 14, output: str = "adx") -> Factor:
    """Directional movement smoothed with weight 1/window from the first bar."""
    need(window >= 2, "window must be at least 2")
    need(output in ("adx", "plus_di", "minus_di", "dx"), "unknown output")
    def moved(which: str):
        def build(w):
            up = F.col("high") - F.lag("high", 1).over(w)
            down = F.lag("low", 1).over(w) - F.col("low")
            a, b = (up, down) if which == "plus" else (down, up)
            return F.when((a > b) & (a > 0), a).otherwise(0.0)

        return helper(f"dm_{which}", build, lookback=1)

    tr, plus, minus = true_range(), moved("plus"), moved("minus")
    smooth = lambda x: decayed(f"{x.name.lstrip('_')}_adx_{window}", x, 1.0 / window, window)
    atr, up, down = smooth(tr), smooth(plus), smooth(minus)

    def share(of: Factor):
        return 100.0 * div(of.name, F.nullif(F.col(atr.name), F.lit(0.0)))

    if output in ("plus_di", "minus_di"):
        side = up if output == "plus_di" else down
        return Factor(f"ADX_{window}_{output}", lambda w: share(side), (atr, side))

    def spread(w):
        return div(F.abs(share(up) - share(down)), share(up) + share(down)) * 100.0

    if output == "dx":
        return Factor(f"ADX_{window}_dx", spread, (atr, up, down))
    dx = helper(f"dx_{window}", spread, atr, up, down)
    index = smooth(dx)
    return Factor(f"ADX_{window}_adx", lambda w: F.col(index.name), (index,))


def _label(x: float) -> str:
    return f"{x:g}".replace("-", "m").replace(".", "p")


def rsrs(
    regression_window: int = 18,
    zscore_window: int = 200,
    buy_threshold: float = 0.7,
    sell_threshold: float = -0.7,
    use_r2_adjustment: bool = True,
    output: str = "signal",
) -> Factor:
    """Slope of high on low, scored against its own past values."""
    need(regression_window >= 2 and zscore_window >= 2, "windows must be at least 2")
    need(sell_threshold < buy_threshold, "sell_threshold must be below buy_threshold")
    need(output in ("beta", "r_square", "score", "zscore", "signal"), "unknown output")
    n, b = regression_window, zscore_window
    tag = "adj" if use_r2_adjustment else "raw"

    def over(w, agg):
        return F.when(F.count(F.col("low") + F.col("high")).over(last_n(w, n)) == n, agg.over(last_n(w, n)))

    beta = helper(
        f"rsrs_beta_{n}",
        lambda w: div(over(w, F.covar_samp("low", "high")), over(w, F.var_samp("low"))),
        lookback=n - 1,
    )

    def square(w):
        cov = over(w, F.covar_samp("low", "high"))
        return div(cov * cov, over(w, F.var_samp("low")) * over(w, F.var_samp("high")))

    r2 = helper(f"rsrs_r2_{n}", square, lookback=n - 1)
    score = helper(
        f"rsrs_score_{n}_{tag}",
        lambda w: F.col(beta.name) * F.col(r2.name) if use_r2_adjustment else F.col(beta.name),
        beta,
        r2,
    )

    past_score = centred(score.name, score)

    def standard(w):
        # Mean and spread of the previous scores from sums of centred values.
        past, x = w.rowsBetween(-b, -1), F.col(past_score.name)
        mean = F.sum(x).over(past) / F.lit(float(b))
        var = (F.sum(x * x).over(past) - mean * mean * float(b)) / F.lit(b - 1.0)
        varies = F.max(x).over(past) > F.min(x).over(past)
        ready = (F.count(x).over(past) == b) & varies & (var > 0)
        return F.when(ready, div(x - mean, F.sqrt(var)))

    z = helper(f"rsrs_z_{n}_{b}_{tag}", standard, past_score, lookback=b)
    zc = F.col(z.name)
    builds = {
        "beta": (beta, lambda w: F.col(beta.name)),
        "r_square": (r2, lambda w: F.col(r2.name)),
        "score": (score, lambda w: F.col(score.name)),
        "zscore": (z, lambda w: zc),
        "signal": (
            z,
            lambda w: F.when(zc > buy_threshold, 1.0).when(zc < sell_threshold, -1.0).otherwise(0.0),
        ),
    }
    dep, build = builds[output]
    return Factor(f"RSRS_{output}_reg{n}_z{b}_{tag}", build, (dep,))


def entry_state(tag: str, signal: Factor) -> tuple[Factor, Factor, Factor]:
    """(state, entry bar, entry close) for long spells of a -1/0/+1 signal.

    A spell starts at the first +1 after a -1 (or after the start) and ends at
    the next -1. Only latest-value scans are used, so long symbols can be split.
    """
    s = F.col(signal.name)
    pos = position()
    state = helper(f"state_{tag}", lambda: ("last", F.when(s != 0, s)), signal, kind="running")
    enter = helper(
        f"enter_{tag}",
        lambda w: (s == 1) & (F.coalesce(F.lag(state.name, 1).over(w), F.lit(-1.0)) == -1),
        state,
        lookback=1,
    )
    bar = helper(
        f"entry_bar_{tag}",
        lambda: ("last", F.when(F.col(enter.name), F.col("_pos"))),
        enter,
        pos,
        kind="running",
    )
    price = helper(
        f"entry_close_{tag}",
        lambda: ("last", F.when(F.col(enter.name), F.col("close"))),
        enter,
        kind="running",
    )
    return state, bar, price


def rsrs_derived(
    regression_window: int = 18,
    zscore_window: int = 200,
    buy_threshold: float = 0.7,
    sell_threshold: float = -0.7,
    use_r2_adjustment: bool = True,
    short_ema_span: int = 5,
    long_ema_span: int = 20,
    output: str = "signal_duration",
) -> Factor:
    need(output in ("signal_duration", "zscore_trend", "return_since_buy"), "unknown output")
    need(short_ema_span >= 1 and long_ema_span >= 1, "spans must be at least 1")
    args = (regression_window, zscore_window, buy_threshold, sell_threshold, use_r2_adjustment)
    tag = "adj" if use_r2_adjustment else "raw"
    label = (
        f"reg{regression_window}_z{zscore_window}_buy{_label(buy_threshold)}"
        f"_sell{_label(sell_threshold)}_ema{short_ema_span}_{long_ema_span}_{tag}"
    )
    name = f"RsrsDerived_{output}_{label}"
    if output == "zscore_trend":
        z = rsrs(*args, output="zscore")
        zdep = helper(f"src_{z.name}", lambda w: F.col(z.name), z)

        def ema(span: int) -> Factor:
            return decayed(f"ema{span}_{z.name}", zdep, span_alpha(span))

        short, long = ema(short_ema_span), ema(long_ema_span)
        build = lambda w: F.when(
            F.col(zdep.name).isNotNull(), F.col(short.name) - F.col(long.name)
        )
        return Factor(name, build, (short, long, zdep))
    signal = rsrs(*args, output="signal")
    state, bar, price = entry_state(f"rsrs_{label}", signal)
    held = F.col(state.name) == 1
    if output == "signal_duration":
        return Factor(
            name, lambda w: F.when(held, F.col("_pos") - F.col(bar.name)), (state, bar, position())
        )
    return Factor(name, lambda w: F.when(held, div("close", price.name) - 1), (state, price))

