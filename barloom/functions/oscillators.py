"""Oscillator factors."""

from __future__ import annotations

from pyspark.sql import functions as F

from .building_blocks import (
    decayed,
    mean_of,
    need,
    position,
    typical_price,
)
from .factor import Factor, full, helper, window_list
from .frames import last_n
from .scalar import c, clip, div


def _wilder_seeded(source: Factor, n: int) -> Factor:
    """Missing for n rows, then the mean of the n changes so far, then the
    changes themselves: what weight 1/n for each new change starts from."""

    def build(w):
        at, x = F.col(position().name), F.col(source.name)
        return F.when(at == n + 1, F.avg(x).over(last_n(w, n))).when(at > n + 1, x)

    return helper(f"{source.name.lstrip('_')}_seeded_{n}", build, source, position(), lookback=n - 1)


def rsi(window: int = 14, price_column: str = "close") -> Factor:
    need(window >= 1, "window must be at least 1")
    col = price_column
    ret = helper(f"ret1_{col}", lambda w: div(col, F.lag(col, 1).over(w)) - 1, lookback=1)
    gain = helper(f"gain_{col}", lambda w: clip(ret.name, lo=0.0), ret)
    loss = helper(f"loss_{col}", lambda w: clip(-c(ret.name), lo=0.0), ret)

    def smooth(source: Factor) -> Factor:
        name = f"{source.name.lstrip('_')}_rsi_{window}"
        return decayed(name, _wilder_seeded(source, window), 1.0 / window)

    up, down = smooth(gain), smooth(loss)

    def build(w):
        u, d = F.col(up.name), F.col(down.name)
        return F.when(d < 1e-12, 100.0).when(d > 1e-12, 100.0 - div(F.lit(100.0), 1.0 + div(u, d)))

    return Factor(f"RSI_{window}", build, (up, down))


def _channel(n: int) -> tuple[Factor, Factor]:
    top = helper(f"max_high_{n}", lambda w: full(w, "high", n, F.max), lookback=n - 1)
    bottom = helper(f"min_low_{n}", lambda w: full(w, "low", n, F.min), lookback=n - 1)
    return top, bottom


def stochastic(n: int = 14, m: int = 3, output: str = "K") -> Factor:
    need(n >= 1 and m >= 1, "windows must be at least 1")
    need(output in ("K", "D"), "output must be K or D")
    top, bottom = _channel(n)
    hi, lo = F.col(top.name), F.col(bottom.name)
    k = helper(
        f"stoch_k_{n}",
        lambda w: F.when(hi - lo > 1e-12, div(F.col("close") - lo, hi - lo) * 100.0).when(
            hi - lo <= 1e-12, 50.0
        ),
        top,
        bottom,
    )
    name = f"Stochastic_{n}_{m}_{output}"
    if output == "K":
        return Factor(name, lambda w: F.col(k.name), (k,))
    return Factor(name, lambda w: full(w, k.name, m, F.avg), (k,), lookback=m - 1)


def cci(window: int = 20) -> Factor:
    need(window >= 1, "window must be at least 1")
    tp = typical_price()
    ma = mean_of("_tp", window, tp)
    values = helper(f"list_tp_{window}", lambda w: window_list(w, "_tp", window), tp, lookback=window - 1)

    def build(w):
        mean = F.col(ma.name)
        gaps = F.aggregate(F.col(values.name), F.lit(0.0), lambda acc, x: acc + F.abs(x - mean))
        return div(F.col("_tp") - mean, F.lit(0.015) * gaps / F.lit(float(window)))

    return Factor(f"CCI_{window}", build, (ma, values, tp))


def williams_r(window: int = 14) -> Factor:
    need(window >= 1, "window must be at least 1")
    top, bottom = _channel(window)
    hi, lo = F.col(top.name), F.col(bottom.name)
    return Factor(
        f"WilliamsR_{window}",
        lambda w: F.when(hi - lo > 1e-12, div(hi - F.col("close"), hi - lo) * -100.0).when(
            hi - lo <= 1e-12, -50.0
        ),
        (top, bottom),
    )


def mfi(window: int = 14) -> Factor:
    need(window >= 1, "window must be at least 1")
    tp = typical_price()

    def flow(tag: str, better):
        def build(w):
            money = F.col("_tp") * F.col("volume")
            moved = F.coalesce(better(F.col("_tp"), F.lag("_tp", 1).over(w)), F.lit(False))
            return F.when(moved, money).otherwise(F.lit(0.0))

        return helper(f"flow_{tag}", build, tp, lookback=1)

    pos = flow("up", lambda a, b: a > b)
    neg = flow("down", lambda a, b: a < b)

    def build(w):
        p, n = full(w, pos.name, window, F.sum), full(w, neg.name, window, F.sum)
        return F.when(n < 1e-12, 100.0).when(n > 1e-12, 100.0 - div(F.lit(100.0), 1.0 + div(p, n)))

    return Factor(f"MFI_{window}", build, (pos, neg), lookback=window - 1)


def ultimate_oscillator(short: int = 7, mid: int = 14, long: int = 28) -> Factor:
    need(0 < short < mid < long, "windows must be increasing")

    def bounds(w):
        prev = F.lag("close", 1).over(w)
        low = F.when(prev.isNotNull(), F.least(F.col("low"), prev))
        high = F.when(prev.isNotNull(), F.greatest(F.col("high"), prev))
        return low, high

    bp = helper("buying", lambda w: F.col("close") - bounds(w)[0], lookback=1)
    tr = helper("uo_range", lambda w: F.nullif(bounds(w)[1] - bounds(w)[0], F.lit(0.0)), lookback=1)

    def build(w):
        share = lambda n: div(full(w, bp.name, n, F.sum), full(w, tr.name, n, F.sum))
        return 100.0 * (4.0 * share(short) + 2.0 * share(mid) + share(long)) / 7.0

    return Factor(f"UltimateOscillator_{short}_{mid}_{long}", build, (bp, tr), lookback=long - 1)
