"""Volume and liquidity factors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .building_blocks import centred, daily_return, mean_of, need, over_windows, skew_over, std_of
from .factor import Factor, helper
from .scalar import div


def volume_ratio(window: int = 5, volume_column: str = "volume") -> Factor:
    need(window >= 1, "window must be at least 1")
    ma = mean_of(volume_column, window)
    return Factor(f"VolumeRatio_{window}", lambda w: div(volume_column, ma.name), (ma,))


def _average_ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks along each row: mean of first and last sorted position."""
    below = (x[:, None, :] < x[:, :, None]).sum(axis=2)
    same = (x[:, None, :] == x[:, :, None]).sum(axis=2)
    return below + (same + 1) / 2.0


def _rank_correlation(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    a = _average_ranks(x) - (x.shape[1] + 1) / 2.0
    b = _average_ranks(y) - (x.shape[1] + 1) / 2.0
    spread = np.sqrt((a * a).sum(axis=1) * (b * b).sum(axis=1))
    return np.divide((a * b).sum(axis=1), spread, out=np.full(len(x), np.nan), where=spread > 0)


def volume_price_correlation(window: int = 20) -> Factor:
    """Rank correlation of close and volume in the window, average ranks."""
    need(window >= 3, "window must be at least 3")
    block = max(1, 1_000_000 // (window * window))
    return Factor(
        f"VolumePriceCorrelation_{window}",
        lambda pdf: over_windows((pdf["close"], pdf["volume"]), window, _rank_correlation, block),
        lookback=window - 1,
        kind="grouped",
    )


def obv() -> Factor:
    step = helper(
        "obv_step",
        lambda w: F.coalesce(
            F.col("volume") * F.signum(F.col("close") - F.lag("close", 1).over(w)), F.lit(0.0)
        ),
        lookback=1,
    )
    total = helper("obv_sum", lambda: ("sum", F.col("_obv_step")), step, kind="running")
    return Factor("OBV", lambda w: F.col(total.name), (total,))


def vpt() -> Factor:
    step = helper(
        "vpt_step", lambda w: F.coalesce(F.col("volume") * F.col("_ret"), F.lit(0.0)), daily_return()
    )
    total = helper("vpt_sum", lambda: ("sum", F.col("_vpt_step")), step, kind="running")
    return Factor("VPT", lambda w: F.col(total.name), (total,))


def amihud_illiquidity(window: int = 20) -> Factor:
    need(window >= 1, "window must be at least 1")
    daily = helper("illiq", lambda w: div(F.abs("_ret"), "value"), daily_return())
    ma = mean_of("_illiq", window, daily)
    return Factor(f"AmihudIlliquidity_{window}", lambda w: F.col(ma.name), (ma,))


def volume_std(window: int = 20, volume_column: str = "volume") -> Factor:
    need(window >= 2, "window must be at least 2")
    sd = std_of(volume_column, window)
    return Factor(f"VolumeStd_{window}", lambda w: F.col(sd.name), (sd,))


def volume_skew(window: int = 20, volume_column: str = "volume") -> Factor:
    need(window >= 3, "window must be at least 3")
    x = centred(volume_column)
    return Factor(
        f"VolumeSkew_{window}", lambda w: skew_over(w, x.name, window), (x,), lookback=window - 1
    )


def average_amount(window: int = 20) -> Factor:
    need(window >= 1, "window must be at least 1")
    ma = mean_of("value", window)
    return Factor(f"AverageAmount_{window}", lambda w: F.col(ma.name), (ma,))
