"""Moving-average factors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from .building_blocks import (
    centred,
    decayed,
    line_slope,
    log_price,
    mean_of,
    need,
    position,
    span_alpha,
    std_of,
)
from .factor import Factor, full, helper
from .scalar import div, ln


def _ma(col: str, n: int) -> Factor:
    need(n >= 1, "window must be at least 1")
    return mean_of(col, n)


def moving_average(window: int = 20, price_column: str = "close") -> Factor:
    need(window >= 1, "window must be at least 1")
    return Factor(
        f"MA_{price_column}_{window}",
        lambda w: full(w, price_column, window, F.avg),
        lookback=window - 1,
    )


def ma_position(window: int = 200, price_column: str = "close") -> Factor:
    ma, p = _ma(price_column, window), F.col(price_column)
    return Factor(
        f"MAPosition_{price_column}_{window}", lambda w: div(p - F.col(ma.name), p), (ma,)
    )


def bias(window: int = 20, price_column: str = "close") -> Factor:
    ma, p = _ma(price_column, window), F.col(price_column)
    return Factor(
        f"BIAS_{price_column}_{window}", lambda w: div(p - F.col(ma.name), ma.name), (ma,)
    )


def log_bias(window: int = 20, price_column: str = "close") -> Factor:
    """Distance of the log price from its exponential mean."""
    need(window >= 1, "window must be at least 1")
    alpha = span_alpha(window)
    logs = helper(f"ln_{price_column}", lambda w: ln(price_column))
    ema = decayed(f"ema_ln_{price_column}_{window}", logs, alpha)
    return Factor(
        f"LogBIAS_{price_column}_{window}", lambda w: div(logs.name, ema.name) - 1, (ema, logs)
    )


def bollinger_position(window: int = 20, k: float = 2.0, price_column: str = "close") -> Factor:
    need(window >= 2, "window must be at least 2")
    ma, sd = _ma(price_column, window), std_of(price_column, window)
    return Factor(
        f"BollingerBandPosition_{price_column}_{window}_{float(k)}",
        lambda w: div(F.col(price_column) - F.col(ma.name), F.lit(float(k)) * F.col(sd.name)),
        (ma, sd),
    )


def ma_alignment(windows=(5, 20, 60), price_column: str = "close") -> Factor:
    """(rank of shortest - rank of longest) / 2 among three averages."""
    need(len(windows) == 3, "exactly three windows are needed")
    windows = sorted(windows)
    mas = [_ma(price_column, n) for n in windows]

    def rank_of(me: Factor):
        x = F.col(me.name)
        less = sum((F.coalesce(F.col(m.name) < x, F.lit(False)).cast("int") for m in mas), F.lit(0))
        same = sum((F.coalesce(F.col(m.name) == x, F.lit(False)).cast("int") for m in mas), F.lit(0))
        return F.when(x.isNotNull(), less + (same + 1) / F.lit(2.0))

    label = "_".join(map(str, windows))
    return Factor(
        f"MAAlignment_{price_column}_{label}",
        lambda w: (rank_of(mas[0]) - rank_of(mas[2])) / F.lit(2.0),
        tuple(mas),
    )


def ma_slope(ma_window: int = 20, slope_window: int = 5, price_column: str = "close") -> Factor:
    need(slope_window >= 1, "slope_window must be at least 1")
    ma = _ma(price_column, ma_window)
    return Factor(
        f"MASlope_{price_column}_{ma_window}_{slope_window}",
        lambda w: div(ma.name, F.lag(ma.name, slope_window).over(w)) - 1,
        (ma,),
        lookback=slope_window,
    )


def ma_distance(short_window: int = 5, long_window: int = 60, price_column: str = "close") -> Factor:
    short, long = _ma(price_column, short_window), _ma(price_column, long_window)
    return Factor(
        f"MADistance_{price_column}_{short_window}_{long_window}",
        lambda w: div(F.col(short.name) - F.col(long.name), price_column),
        (short, long),
    )


def ma_dispersion(windows=(5, 10, 20, 60), price_column: str = "close") -> Factor:
    """Sample deviation over mean of the averages that exist (at least two)."""
    need(len(windows) >= 2, "at least two windows are needed")
    mas = [_ma(price_column, n) for n in windows]

    def build(w):
        cols = [F.col(m.name) for m in mas]
        n = reduce(lambda a, b: a + b, [x.isNotNull().cast("double") for x in cols])
        mean = div(reduce(lambda a, b: a + b, [F.coalesce(x, F.lit(0.0)) for x in cols]), n)
        sq = [F.coalesce((x - mean) * (x - mean), F.lit(0.0)) for x in cols]
        var = div(reduce(lambda a, b: a + b, sq), n - 1)
        return F.when((n >= 2) & (mean > 0), div(F.sqrt(var), mean))

    label = "_".join(map(str, windows))
    return Factor(f"MADispersion_{price_column}_{label}", build, tuple(mas))


def long_ma_filter(quick_window: int = 60, slow_window: int = 120) -> Factor:
    """True when the quick average is above the slow one; missing is false."""
    quick, slow = _ma("close", quick_window), _ma("close", slow_window)
    return Factor(
        "long_ma_filter",
        lambda w: F.coalesce(F.col(quick.name) > F.col(slow.name), F.lit(False)),
        (quick, slow),
    )


def slope_risk_ratio(window: int = 20, k: float = 1.0) -> Factor:
    """Trend gain over risk at each bar; the last bar is the published value.

    The slope in percent of the close is divided by the gap to the average plus
    half the annual log volatility. A close at or under its average is an
    unlimited risk, so the ratio is 0.
    """
    ma, logs = _ma("close", window), log_price()
    change = helper("lnret", lambda w: F.col("_lnp") - F.lag("_lnp", 1).over(w), logs, lookback=1)
    vol = std_of("_lnret", window, change)
    slope = helper(
        f"slope_close_{window}",
        lambda w: line_slope(w, "_ctr_close", window),
        position(),
        centred("close"),
        lookback=window - 1,
    )

    def build(w):
        gain = div(slope.name, "close") * 100.0
        gap = div(F.col("close") - F.col(ma.name), "close") * 100.0
        risk = gap + F.col(vol.name) * (252**0.5) * 0.5
        ratio = F.when(gap > 0, div(F.lit(float(k)) * gain, risk)).otherwise(F.lit(0.0))
        return F.when(gain.isNotNull(), ratio)

    return Factor("SlopeRiskRatio", build, (ma, vol, slope))
