"""Every factor against direct pandas, with whole and with split symbols."""

import numpy as np
import pandas as pd
import pytest

from barloom.functions import averages, breakout, momentum, oscillators, trend, volatility
from barloom.functions.factor import Factor, resolve, with_factors
from barloom.functions.library import FACTORS, make
from fixtures import assert_close, bar_frame, per_symbol, to_bars

YEAR = np.sqrt(252)


def roll(s, n):
    return s.rolling(n, min_periods=n)


def ret(d, n=1):
    return d.close / d.close.shift(n) - 1


def tr(d):
    p = d.close.shift()
    return pd.concat([d.high - d.low, (d.high - p).abs(), (d.low - p).abs()], axis=1).max(axis=1)


def nz(s):
    return s.replace(0.0, np.nan)


def fit(y):
    x = np.arange(len(y))
    m, b = np.polyfit(x, y, 1)
    tot = ((y - y.mean()) ** 2).sum()
    return m, (np.nan if tot == 0 or np.ptp(y) == 0 else 1 - ((y - m * x - b) ** 2).sum() / tot)


def spearman(d, n):
    out = np.full(len(d), np.nan)
    for i in range(n - 1, len(d)):
        a, b = d.close[i - n + 1 : i + 1].rank(), d.volume[i - n + 1 : i + 1].rank()
        if a.std() > 0 and b.std() > 0:
            out[i] = np.corrcoef(a, b)[0, 1]
    return pd.Series(out)


def hurst(y):
    r = np.diff(y)
    dev = np.cumsum(r - r.mean())
    s = r.std(ddof=1)
    return np.nan if s < 1e-12 else np.log((dev.max() - dev.min()) / s) / np.log(len(r))


def streak(d, broken):
    return d.close.groupby(broken.cumsum()).cumcount()


def rsrs(d, n=18, b=200):
    beta = roll(d.low, n).cov(d.high) / nz(roll(d.low, n).var())
    score = beta * roll(d.low, n).corr(d.high) ** 2
    past = score.shift()
    return (score - roll(past, b).mean()) / nz(roll(past, b).std())


def since_entry(d, signal):
    seg = (signal == -1).cumsum()
    buy = signal == 1
    first = buy & (buy.groupby(seg).cumsum() == 1)
    pos = pd.Series(np.arange(len(d), dtype=float))
    return pos.where(first).groupby(seg).ffill(), d.close.where(first).groupby(seg).ffill()


def signal_of(z):
    return pd.Series(np.where(z > 0.7, 1, np.where(z < -0.7, -1, 0)))


def new_high(d, hw=50, lw=25, gate=True):
    top, low = roll(d.close, hw).max(), roll(d.close, lw)
    count = low.apply(lambda x: (x == x.min()).sum())
    up = roll(d.close, 60).mean() > roll(d.close, 120).mean()
    hi = (d.close >= top) & (up if gate else True)
    lo = (d.close == low.min()) & (count == 1)
    return pd.Series(np.where(hi, 1, np.where(lo, -1, 0)))


def wilder(s, n):
    out = np.full(len(s), np.nan)
    out[n] = s[1 : n + 1].mean()
    for i in range(n + 1, len(s)):
        out[i] = (out[i - 1] * (n - 1) + s[i]) / n
    return pd.Series(out)


def rsi(d, n=14):
    r = ret(d)
    up, down = wilder(r.clip(lower=0), n), wilder((-r).clip(lower=0), n)
    return (100 - 100 / (1 + up / down.where(down > 1e-12))).mask(down < 1e-12, 100.0)


def adx(d, n=14):
    up, down = d.high.diff(), -d.low.diff()
    pdm = up.where((up > down) & (up > 0), 0.0)
    mdm = down.where((down > up) & (down > 0), 0.0)
    sm = lambda s: s.ewm(alpha=1 / n, adjust=False, min_periods=n).mean()
    atr = nz(sm(tr(d)))
    p, m = 100 * sm(pdm) / atr, 100 * sm(mdm) / atr
    return sm((p - m).abs() / nz(p + m) * 100)


def mfi(d, n=14):
    tp = (d.high + d.low + d.close) / 3
    flow = tp * d.volume
    p = roll(flow.where(tp > tp.shift(), 0.0), n).sum()
    m = flow.where(tp < tp.shift(), 0.0).rolling(n).apply(np.sum, raw=True)
    return (100 - 100 / (1 + p / m.where(m > 1e-12))).mask(m < 1e-12, 100.0)


def ultimate(d):
    p = d.close.shift()
    low, high = np.minimum(d.low, p), np.maximum(d.high, p)
    bp, rng = d.close - low, nz(high - low)
    a = lambda n: roll(bp, n).sum() / roll(rng, n).sum()
    return 100 * (4 * a(7) + 2 * a(14) + a(28)) / 7


def channel(d, n, lo_val, scale, invert=False):
    hi, lo = roll(d.high, n).max(), roll(d.low, n).min()
    gap = hi - lo
    x = ((hi - d.close) if invert else (d.close - lo)) / gap.where(gap > 1e-12) * scale
    return x.mask(gap <= 1e-12, lo_val)


def extreme(d, n=20, t=0.1):
    rank = ret(d, n).rolling(n, min_periods=n).rank(pct=True)
    out = pd.Series(0.0, index=d.index).where(rank.notna())
    out[rank >= 1 - t] = -1
    out[rank <= t] = 1
    return out


def alignment(d):
    mas = pd.DataFrame({n: roll(d.close, n).mean() for n in (5, 20, 60)}).round(10)
    rk = mas.rank(axis=1)
    return (rk[5] - rk[60]) / 2


def dispersion(d):
    m = np.stack([roll(d.close, n).mean() for n in (5, 10, 20, 60)], axis=1)
    return pd.DataFrame(m).apply(lambda r: r.std() / r.mean() if r.count() >= 2 else np.nan, axis=1)


def slope_risk(d, n=20):
    slope = roll(d.close, n).apply(lambda y: fit(y)[0], raw=True) / d.close * 100
    gap = (d.close - roll(d.close, n).mean()) / d.close * 100
    vol = roll(np.log(d.close / d.close.shift()), n).std() * YEAR
    out = slope / (gap.where(gap > 1e-12, np.inf) + vol * 0.5)
    return out.where(slope.notna())


def exact_std(s, n):
    return s.rolling(n, min_periods=n).apply(lambda x: np.std(x, ddof=1), raw=True)


def safe_corr2(d):
    return roll(d.low, 18).corr(d.high) ** 2


ORACLES = {
    "PriceReturn": lambda d: ret(d, 60),
    "RiskAdjustedReturn": lambda d: (
        ret(d, 20) / (exact_std(ret(d), 20) * np.sqrt(20)).where(lambda v: v >= 1e-8)
    ),
    "IntradayMomentum": lambda d: (d.close - d.open) / d.open,
    "OvernightReturn": lambda d: d.open / d.close.shift() - 1,
    "HighPointPosition": lambda d: roll(d.high, 20).apply(np.argmax, raw=True) / 19,
    "LowPointPosition": lambda d: roll(d.low, 20).apply(np.argmin, raw=True) / 19,
    "TimeSeriesMomentum": lambda d: (ret(d, 252) > 0).astype(float).where(ret(d, 252).notna()),
    "ShortTermReversal": lambda d: -ret(d),
    "ExtremeReversal": extreme,
    "VolumeReversal": lambda d: -ret(d, 5) * d.volume / nz(d.volume.rolling(20).apply(np.mean, raw=True)),
    "VolumeRatio": lambda d: d.volume / nz(d.volume.rolling(5).apply(np.mean, raw=True)),
    "VolumePriceCorrelation": lambda d: spearman(d, 20),
    "OBV": lambda d: (d.volume * np.sign(d.close.diff()).fillna(0)).cumsum(),
    "VPT": lambda d: (d.volume * ret(d).fillna(0)).cumsum(),
    "AmihudIlliquidity": lambda d: roll(ret(d).abs() / nz(d.value), 20).mean(),
    "VolumeStd": lambda d: exact_std(d.volume, 20),
    "VolumeSkew": lambda d: d.volume.rolling(20).apply(lambda x: 0.0 if np.ptp(x) == 0 else pd.Series(x).skew(), raw=True),
    "AverageAmount": lambda d: d.value.rolling(20).apply(np.mean, raw=True),
    "Volatility": lambda d: exact_std(ret(d), 20),
    "DownsideVolatility": lambda d: exact_std(ret(d).clip(upper=0), 20),
    "ParkinsonVolatility": lambda d: np.sqrt(
        (np.log(d.high / d.low) ** 2).rolling(20).apply(np.mean, raw=True) / (4 * np.log(2))
    ),
    "GarmanKlassVolatility": lambda d: np.sqrt(
        (0.5 * np.log(d.high / d.low) ** 2 - (2 * np.log(2) - 1) * np.log(d.close / d.open) ** 2)
        .clip(lower=0)
        .rolling(20)
        .apply(np.mean, raw=True)
    ),
    "VolOfVol": lambda d: exact_std(exact_std(ret(d), 20), 60),
    "MaxDrawdown": lambda d: d.close / roll(d.close, 60).max() - 1,
    "AvgDrawdown": lambda d: roll(d.close / roll(d.close, 60).max() - 1, 60).mean(),
    "HurstExponent": lambda d: roll(np.log(d.close), 120).apply(hurst, raw=True),
    "KaufmanER": lambda d: (
        (d.close - d.close.shift(20)).abs()
        / nz(d.close.diff().abs().rolling(20).apply(np.sum, raw=True))
    ).clip(0, 1),
    "UpDownRatio": lambda d: roll((d.close.diff() > 0).astype(float).where(d.close.shift().notna()), 20).mean(),
    "ConsecutiveUpDays": lambda d: streak(d, d.close <= d.close.shift()),
    "ConsecutiveDownDays": lambda d: streak(d, d.close >= d.close.shift()),
    "ADX": adx,
    "RSI": rsi,
    "Stochastic": lambda d: channel(d, 14, 50.0, 100.0),
    "WilliamsR": lambda d: channel(d, 14, -50.0, -100.0, invert=True),
    "DonchianChannelPosition": lambda d: channel(d, 20, 0.5, 1.0),
    "MFI": mfi,
    "UltimateOscillator": ultimate,
    "MAPosition": lambda d: 1 - roll(d.close, 200).mean() / d.close,
    "MA": lambda d: roll(d.close, 20).mean(),
    "BIAS": lambda d: d.close / roll(d.close, 20).mean() - 1,
    "LogBIAS": lambda d: np.log(d.close) / np.log(d.close).ewm(span=20, adjust=False).mean() - 1,
    "MAAlignment": alignment,
    "MASlope": lambda d: roll(d.close, 20).mean().pct_change(5),
    "MADistance": lambda d: (roll(d.close, 5).mean() - roll(d.close, 60).mean()) / d.close,
    "MADispersion": dispersion,
    "RollingOLS": lambda d: roll(d.close, 20).apply(lambda y: fit(y)[0], raw=True),
    "ReturnSkew": lambda d: roll(ret(d), 60).skew(),
    "ReturnKurtosis": lambda d: roll(ret(d), 60).kurt(),
    "HistoricalVaR": lambda d: roll(ret(d), 252).quantile(0.05),
    "CVaR": lambda d: roll(ret(d), 252).apply(lambda x: x[x <= np.quantile(x, 0.05)].mean(), raw=True),
    "MFE": lambda d: roll(d.close, 20).max() / d.close.shift(20) - 1,
    "MAE": lambda d: roll(d.close, 20).min() / d.close.shift(20) - 1,
    "ID": lambda d: roll(
        (np.sign(ret(d)) != np.sign(ret(d).shift())).astype(float).where(ret(d).shift().notna()), 20
    ).mean(),
    "NewHigh": new_high,
    "ChangeSinceNewHigh": lambda d: d.close / since_entry(d, new_high(d, gate=False))[1] - 1,
    "DailyRebound": lambda d: (d.close - d.low) / nz(d.high - d.low),
    "TrendR2": lambda d: roll(d.close, 120).apply(lambda y: fit(y / y[0] - 1)[1], raw=True),
    "TrendR2_slope": lambda d: roll(d.close, 120).apply(lambda y: fit(y / y[0] - 1)[0], raw=True),
    "RSRS": rsrs,
    "RsrsDerived": lambda d: np.arange(len(d)) - since_entry(d, signal_of(rsrs(d)))[0],
    "ATR": lambda d: roll(tr(d), 25).mean(),
    "NewHighContinuous": lambda d: d.close / roll(d.high, 50).max() - 1,
    "NewLowContinuous": lambda d: d.close / roll(d.low, 50).min() - 1,
    "ATRRatio": lambda d: roll(tr(d), 25).mean() / d.close,
    "ChandelierExit": lambda d: (d.close - roll(d.high, 22).max())
    / tr(d).rolling(22).apply(np.mean, raw=True).where(lambda v: v > 0),
    "SlopeRiskRatio": slope_risk,
}
# On the flat stretch these divide rounding noise, so the flat symbol is left out.
NOISY_WHEN_FLAT = {"BollingerBandPosition", "CCI", "RSRS", "RsrsDerived", "SlopeRiskRatio", "MAAlignment"}
ORACLES["BollingerBandPosition"] = lambda d: (d.close - roll(d.close, 20).mean()) / (2 * exact_std(d.close, 20))


def cci(d):
    tp = (d.high + d.low + d.close) / 3
    return (tp - roll(tp, 20).mean()) / (0.015 * roll(tp, 20).apply(lambda x: np.abs(x - x.mean()).mean(), raw=True))


ORACLES["CCI"] = cci


@pytest.fixture(scope="module", params=[1_000_000, 40], ids=["whole", "split"])
def computed(request, spark):
    pdf = bar_frame()
    bars = to_bars(spark, pdf, request.param)
    factors = {n: make(n) for n in FACTORS}
    out = with_factors(bars, list(factors.values())).df.toPandas()
    out = out.sort_values(["symbol", "date"], ignore_index=True)
    assert len(out) == len(pdf)
    return pdf, out, factors


def test_every_factor_has_an_oracle():
    assert set(ORACLES) == set(FACTORS)


@pytest.mark.parametrize("name", sorted(FACTORS))
def test_factor(computed, name):
    pdf, out, factors = computed
    got = out[factors[name].name]
    if name in NOISY_WHEN_FLAT:
        keep = pdf.symbol != "S1"
        pdf, got = pdf[keep].reset_index(drop=True), got[out.symbol != "S1"]
    assert_close(got, per_symbol(pdf, ORACLES[name]), 1e-7)


def test_outputs_of_multi_output_factors(spark):
    pdf = bar_frame(symbols=1)
    fs = [
        trend.adx(output="plus_di"),
        trend.adx(output="dx"),
        oscillators.stochastic(output="D"),
        trend.rsrs_derived(output="return_since_buy"),
        trend.rsrs_derived(output="zscore_trend"),
        volatility.average_true_range(normalize_by_close=True),
        volatility.average_true_range(normalize_by_close=True, normalize_first=True),
        volatility.volatility(annualize=True),
        momentum.price_return(60, 5),
        trend.rsrs(output="signal"),
    ]
    for limit in (1_000_000, 50):
        out = with_factors(to_bars(spark, pdf, limit), fs).df.toPandas().sort_values("date", ignore_index=True)
        z = rsrs(pdf)
        assert_close(out[fs[2].name], roll(channel(pdf, 14, 50.0, 100.0), 3).mean())
        assert_close(out[fs[3].name], pdf.close / since_entry(pdf, signal_of(z))[1] - 1)
        ema = lambda s: z.ewm(span=s, adjust=False).mean()
        assert_close(out[fs[4].name], (ema(5) - ema(20)).where(z.notna()), 1e-7)
        assert_close(out[fs[5].name], roll(tr(pdf), 25).mean() / pdf.close)
        assert_close(out[fs[6].name], roll(tr(pdf) / pdf.close, 25).mean())
        assert_close(out[fs[7].name], roll(ret(pdf), 20).std() * YEAR)
        assert_close(out[fs[8].name], pdf.close.shift(5) / pdf.close.shift(65) - 1)
        assert_close(out[fs[9].name], signal_of(z))


def test_names_and_checks():
    assert momentum.price_return(60, 5).name == "PriceReturn_60_skip5"
    assert momentum.extreme_reversal().name == "ExtremeReversal_20_p1"
    assert averages.bollinger_position().name == "BollingerBandPosition_close_20_2.0"
    assert trend.rsrs_derived().name == (
        "RsrsDerived_signal_duration_reg18_z200_buy0p7_sellm0p7_ema5_20_adj"
    )
    assert breakout.new_high().name == "NewHigh"
    with pytest.raises(ValueError):
        momentum.risk_adjusted_return(1)
    with pytest.raises(ValueError):
        make("NoSuchFactor")


def test_duplicates_and_cycles_are_rejected(spark):
    f = make("MA")
    with pytest.raises(ValueError, match="duplicate"):
        resolve([f, f])
    a = Factor("a", lambda w: None)
    b = Factor("b", lambda w: None, (a,))
    object.__setattr__(a, "deps", (b,))
    with pytest.raises((ValueError, RecursionError)):
        resolve([b])
    with pytest.raises(ValueError, match="already present"):
        with_factors(to_bars(spark, bar_frame(symbols=1, rows=5)), [Factor("close", lambda w: None)])
