"""Small seeded bar tables for tests."""

import numpy as np
import pandas as pd

from barloom.functions.frames import Bars


def bar_frame(symbols=3, rows=420, seed=42):
    """Random-walk bars with ties, a flat stretch and a zero-volume stretch."""
    rng = np.random.default_rng(seed)
    out = []
    for k in range(symbols):
        steps = rng.normal(0.0005, 0.015, rows)
        close = np.round(10 * np.exp(np.cumsum(steps)), 2)
        if k == 1 and rows > 140:
            close[100:140] = close[100]
        open_ = np.round(close * (1 + rng.normal(0, 0.004, rows)), 2)
        high = np.round(np.maximum(open_, close) * (1 + np.abs(rng.normal(0, 0.006, rows))), 2)
        low = np.round(np.minimum(open_, close) * (1 - np.abs(rng.normal(0, 0.006, rows))), 2)
        if k == 1 and rows > 140:
            open_[100:140] = high[100:140] = low[100:140] = close[100]
        volume = rng.integers(1, 40, rows).astype(float)
        if k == 2:
            volume[200:230] = 0.0
        dates = pd.bdate_range("2020-01-01", periods=rows + 30).delete(rng.choice(rows, min(30, rows), replace=False))
        out.append(
            pd.DataFrame(
                {
                    "symbol": f"S{k}",
                    "date": dates[:rows].date,
                    "open": open_,
                    "high": high,
                    "low": low,
                    "close": close,
                    "volume": volume,
                    "value": volume * close,
                }
            )
        )
    return pd.concat(out, ignore_index=True)


def to_bars(spark, pdf, limit=1_000_000):
    df = spark.createDataFrame(pdf)
    per_symbol = int(pdf.groupby("symbol").size().max())
    per_date = int(pdf.groupby("date").size().max())
    return Bars(df, per_symbol, per_date, limit, pdf["symbol"].nunique(), pdf["date"].nunique())


def per_symbol(pdf, fn):
    """fn(one symbol's frame) -> Series, in the row order of pdf."""
    parts = [fn(g.reset_index(drop=True)).to_numpy(dtype=float) for _, g in pdf.groupby("symbol", sort=True)]
    return np.concatenate(parts)


def assert_close(got, want, tol=1e-8):
    got, want = np.asarray(got, dtype=float), np.asarray(want, dtype=float)
    assert got.shape == want.shape
    nan_g, nan_w = np.isnan(got), np.isnan(want)
    assert (nan_g == nan_w).all(), f"{(nan_g != nan_w).sum()} rows differ in being missing"
    assert np.allclose(got[~nan_g], want[~nan_g], rtol=tol, atol=tol)
