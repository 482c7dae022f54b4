"""Intermediate columns shared by many factors."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from .factor import Factor, full, helper
from .frames import last_n
from .scalar import c, clip, div, ln


def need(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def shifted(col: str, n: int) -> Factor:
    return helper(f"{col.lstrip('_')}_lag{n}", lambda w: F.lag(col, n).over(w), lookback=n)


def daily_return() -> Factor:
    return helper("ret", lambda w: div("close", F.lag("close", 1).over(w)) - 1, lookback=1)


def span_return(n: int) -> Factor:
    return helper(f"ret_{n}", lambda w: div("close", F.lag("close", n).over(w)) - 1, lookback=n)


def true_range() -> Factor:
    """Largest of the three ranges; greatest skips the missing previous close."""

    def build(w):
        prev = F.lag("close", 1).over(w)
        return F.greatest(
            F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev)
        )

    return helper("tr", build, lookback=1)


def typical_price() -> Factor:
    return helper("tp", lambda w: (F.col("high") + F.col("low") + F.col("close")) / 3.0)


def log_price() -> Factor:
    return helper("lnp", lambda w: ln("close"))


def mean_of(col: str, n: int, *deps: Factor) -> Factor:
    return helper(
        f"mean_{col.lstrip('_')}_{n}", lambda w: full(w, col, n, F.avg), *deps, lookback=n - 1
    )


def std_of(col: str, n: int, *deps: Factor) -> Factor:
    return helper(
        f"std_{col.lstrip('_')}_{n}", lambda w: full(w, col, n, F.stddev_samp), *deps, lookback=n - 1
    )


def position() -> Factor:
    """1-based row number of the symbol's bars."""
    return helper("pos", lambda: ("sum", F.lit(1.0)), kind="running")


def centred(col: str, *deps: Factor) -> Factor:
    """Values less the symbol's first value. Moments and line fits do not
    change under a shift, and their sums stay well conditioned."""
    base = helper(f"base_{col.lstrip('_')}", lambda: ("first", c(col)), *deps, kind="running")
    return helper(f"ctr_{col.lstrip('_')}", lambda w: c(col) - c(base.name), base, *deps)


def _central_moments(w, x: str, n: int):
    """Second to fourth central moments from plain running-frame sums, which
    cost a fraction of the built-in moment aggregates on sliding frames."""
    wn = last_n(w, n)
    v = c(x)
    s1, s2, s3, s4 = (F.sum(p).over(wn) / F.lit(float(n)) for p in (v, v * v, v * v * v, v * v * v * v))
    m2 = s2 - s1 * s1
    m3 = s3 - 3.0 * s1 * s2 + 2.0 * s1 * s1 * s1
    m4 = s4 - 4.0 * s1 * s3 + 6.0 * s1 * s1 * s2 - 3.0 * s1 * s1 * s1 * s1
    flat = F.max(v).over(wn) == F.min(v).over(wn)
    ready = F.count(v).over(wn) == n
    return ready, flat, m2, m3, m4


def skew_over(w, x: str, n: int):
    """Bias-corrected skewness of a centred column; 0 on constant windows."""
    ready, flat, m2, m3, _ = _central_moments(w, x, n)
    g = div(m3, m2 * F.sqrt(m2)) * F.lit(math.sqrt(n * (n - 1)) / (n - 2))
    return F.when(ready, F.when(flat, 0.0).otherwise(g))


def kurtosis_over(w, x: str, n: int):
    """Bias-corrected excess kurtosis of a centred column; -3 when constant."""
    ready, flat, m2, _, m4 = _central_moments(w, x, n)
    excess = div(m4, m2 * m2) - 3.0
    g = F.lit((n - 1) / ((n - 2) * (n - 3))) * (F.lit(n + 1.0) * excess + 6.0)
    return F.when(ready, F.when(flat, -3.0).otherwise(g))


def _line_sums(w, y: str, n: int, pos: str):
    """Sxx, Sxy and Syy of a centred column against 0..n-1."""
    wn = last_n(w, n)
    v, p = c(y), c(pos)
    total = F.sum(v).over(wn)
    sxy = F.sum(v * p).over(wn) - (p - (n - 1) / 2.0) * total
    syy = F.sum(v * v).over(wn) - total * total / F.lit(float(n))
    return n * (n * n - 1) / 12.0, sxy, syy


def line_slope(w, y: str, n: int, pos: str = "_pos"):
    sxx, sxy, _ = _line_sums(w, y, n, pos)
    return F.when(F.count(c(y)).over(last_n(w, n)) == n, sxy / F.lit(sxx))


def line_r2(w, y: str, n: int, pos: str = "_pos"):
    """r squared against the bar number, NULL when the values are constant."""
    wn = last_n(w, n)
    sxx, sxy, syy = _line_sums(w, y, n, pos)
    ready = F.count(c(y)).over(wn) == n
    varies = F.max(c(y)).over(wn) > F.min(c(y)).over(wn)
    return F.when(ready & varies, clip(div(sxy * sxy, F.lit(sxx) * syy), 0.0, 1.0))


def over_windows(values, n: int, fn, block: int = 4096):
    """fn on stacked windows of the last n values, in bounded blocks of rows.

    `values` is one array or several of equal length; windows holding a missing
    value give NaN.
    """
    many = [np.asarray(v, dtype="float64") for v in (values if isinstance(values, tuple) else (values,))]
    size = len(many[0])
    out = np.full(size, np.nan)
    for start in range(0, size - n + 1, block):
        stop = min(start + block, size - n + 1)
        views = [np.lib.stride_tricks.sliding_window_view(v[start : stop + n - 1], n) for v in many]
        ok = np.logical_and.reduce([np.isfinite(v).all(axis=1) for v in views])
        if ok.any():
            out[n - 1 + start : n - 1 + stop][ok] = fn(*[v[ok] for v in views])
    return out


def decayed(name: str, source: Factor, alpha: float, min_periods: int = 0) -> Factor:
    """Exponential mean of a column, from the first bar on."""
    return helper(name, lambda: (source.name, alpha, min_periods), source, kind="decay")


def span_alpha(span: int) -> float:
    return 2.0 / (span + 1.0)
