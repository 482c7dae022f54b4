"""All factors by public name, and recipes that compose them."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping

from . import averages, breakout, distribution, momentum, oscillators, trend, volatility, volume
from .factor import Factor
from .meta import Condition, combine, conditional, multi_conditional, negate, switch, transform

# Public factor names with their default parameters.
FACTORS: dict[str, tuple] = {
    "PriceReturn": (momentum.price_return, {"window": 60}),
    "RiskAdjustedReturn": (momentum.risk_adjusted_return, {"window": 20}),
    "IntradayMomentum": (momentum.intraday_momentum, {}),
    "OvernightReturn": (momentum.overnight_return, {}),
    "HighPointPosition": (momentum.high_point_position, {"window": 20}),
    "LowPointPosition": (momentum.low_point_position, {"window": 20}),
    "TimeSeriesMomentum": (momentum.time_series_momentum, {"window": 252}),
    "ShortTermReversal": (momentum.short_term_reversal, {"window": 1}),
    "ExtremeReversal": (momentum.extreme_reversal, {"window": 20, "tail_pct": 0.1}),
    "VolumeReversal": (momentum.volume_reversal, {"ret_window": 5, "vol_window": 20}),
    "VolumeRatio": (volume.volume_ratio, {"window": 5}),
    "VolumePriceCorrelation": (volume.volume_price_correlation, {"window": 20}),
    "OBV": (volume.obv, {}),
    "VPT": (volume.vpt, {}),
    "AmihudIlliquidity": (volume.amihud_illiquidity, {"window": 20}),
    "VolumeStd": (volume.volume_std, {"window": 20}),
    "VolumeSkew": (volume.volume_skew, {"window": 20}),
    "AverageAmount": (volume.average_amount, {"window": 20}),
    "Volatility": (volatility.volatility, {"window": 20}),
    "DownsideVolatility": (volatility.downside_volatility, {"window": 20}),
    "ParkinsonVolatility": (volatility.parkinson_volatility, {"window": 20}),
    "GarmanKlassVolatility": (volatility.garman_klass_volatility, {"window": 20}),
    "VolOfVol": (volatility.vol_of_vol, {"vol_window": 20, "std_window": 60}),
    "MaxDrawdown": (volatility.max_drawdown, {"window": 60}),
    "AvgDrawdown": (volatility.avg_drawdown, {"window": 60}),
    "HurstExponent": (trend.hurst_exponent, {"window": 120}),
    "KaufmanER": (trend.kaufman_er, {"window": 20}),
    "UpDownRatio": (trend.up_down_ratio, {"window": 20}),
    "ConsecutiveUpDays": (trend.consecutive_up_days, {}),
    "ConsecutiveDownDays": (trend.consecutive_down_days, {}),
    "ADX": (trend.adx, {"window": 14, "output": "adx"}),
    "RSI": (oscillators.rsi, {"window": 14}),
    "Stochastic": (oscillators.stochastic, {"n": 14, "m": 3, "output": "K"}),
    "CCI": (oscillators.cci, {"window": 20}),
    "WilliamsR": (oscillators.williams_r, {"window": 14}),
    "MFI": (oscillators.mfi, {"window": 14}),
    "UltimateOscillator": (oscillators.ultimate_oscillator, {"short": 7, "mid": 14, "long": 28}),
    "MAPosition": (averages.ma_position, {"window": 200}),
    "MA": (averages.moving_average, {"window": 20}),
    "BIAS": (averages.bias, {"window": 20}),
    "LogBIAS": (averages.log_bias, {"window": 20}),
    "BollingerBandPosition": (averages.bollinger_position, {"window": 20, "k": 2.0}),
    "MAAlignment": (averages.ma_alignment, {"windows": (5, 20, 60)}),
    "MASlope": (averages.ma_slope, {"ma_window": 20, "slope_window": 5}),
    "MADistance": (averages.ma_distance, {"short_window": 5, "long_window": 60}),
    "MADispersion": (averages.ma_dispersion, {"windows": (5, 10, 20, 60)}),
    "SlopeRiskRatio": (averages.slope_risk_ratio, {}),
    "RollingOLS": (trend.rolling_ols, {"window": 20, "output": "slope"}),
    "ReturnSkew": (distribution.return_skew, {"window": 60}),
    "ReturnKurtosis": (distribution.return_kurtosis, {"window": 60}),
    "HistoricalVaR": (distribution.historical_var, {"window": 252, "q": 0.05}),
    "CVaR": (distribution.cvar, {"window": 252, "q": 0.05}),
    "MFE": (distribution.max_favorable_excursion, {"window": 20}),
    "MAE": (distribution.max_adverse_excursion, {"window": 20}),
    "ID": (distribution.information_discreteness, {"window": 20}),
    "NewHigh": (breakout.new_high, {"high_window": 50, "low_window": 25}),
    "ChangeSinceNewHigh": (breakout.change_since_new_high, {}),
    "DailyRebound": (momentum.daily_rebound, {}),
    "TrendR2": (trend.trend_r2, {"window": 120, "output": "r2"}),
    "TrendR2_slope": (trend.trend_r2, {"window": 120, "output": "slope"}),
    "RSRS": (trend.rsrs, {"output": "zscore"}),
    "RsrsDerived": (trend.rsrs_derived, {}),
    "ATR": (volatility.average_true_range, {"window": 25}),
    "NewHighContinuous": (breakout.new_high_continuous, {"window": 50}),
    "NewLowContinuous": (breakout.new_low_continuous, {"window": 50}),
    "DonchianChannelPosition": (breakout.donchian_position, {"window": 20}),
    "ATRRatio": (breakout.atr_ratio, {"window": 25}),
    "ChandelierExit": (breakout.chandelier_exit, {"n": 22, "atr_window": 22}),
}

# Transform windows, win-rate thresholds and excluded pairs used
# when a factor list is expanded.
TRANSFORM_WINDOWS = {
    "rolling_mean": (5, 10),
    "rolling_std": (10,),
    "delta": (5, 10),
    "pct_change": (5, 10),
    "binarize_winrate": (10, 20),
    "zscore": (120,),
}
WINRATE_THRESHOLDS = {
    "KaufmanER": (0.3, 0.4),
    "TrendR2": (0.5,),
    "TrendR2_slope": (0.0,),
    "RSRS": (0.0, 0.7),
    "ADX": (20.0, 25.0),
    "HurstExponent": (0.5,),
    "NewHighContinuous": (10.0, 20.0),
}
EXCLUSIONS = {
    "rolling_std": (
        "PriceReturn", "RiskAdjustedReturn", "IntradayMomentum", "OvernightReturn",
        "TimeSeriesMomentum", "HighPointPosition", "LowPointPosition", "ShortTermReversal",
        "ExtremeReversal", "VolumeReversal",
    ),
    "zscore": (
        "RSRS", "ADX", "BollingerBandPosition", "RSI", "Stochastic", "WilliamsR", "MFI",
        "UltimateOscillator",
    ),
    "pct_change": (
        "OBV", "VPT", "ConsecutiveUpDays", "ConsecutiveDownDays", "NewHigh", "DailyRebound",
        "NewHighContinuous", "NewLowContinuous",
    ),
    "binarize_winrate": (
        "ConsecutiveUpDays", "ConsecutiveDownDays", "NewHigh", "NewLowContinuous",
        "DailyRebound", "ATR", "ATRRatio",
    ),
    "delta": ("OBV", "VPT", "ConsecutiveUpDays", "ConsecutiveDownDays"),
}


def make(name: str, **params) -> Factor:
    """A library factor by public name; params override its defaults."""
    if name not in FACTORS:
        raise ValueError(f"unknown factor {name!r}")
    factory, defaults = FACTORS[name]
    return factory(**{**defaults, **params})


def from_recipe(recipe: Mapping | Factor | str) -> Factor:
    """Build a factor from nested dicts.

    {"factor": "RSI", "params": {...}}
    {"transform": "zscore", "of": recipe, "window": 60, "threshold": 0}
    {"negate": recipe}
    {"combine": "product", "a": recipe, "b": recipe, ...}
    {"signal": recipe, "when": [{"factor": recipe, "op": "gt", "threshold": 0}],
     "logic": "and", "false_value": "nan"}
    {"switch": recipe, "else": recipe, "when": [...], "false_negate": False}
    """
    if isinstance(recipe, Factor):
        return recipe
    if isinstance(recipe, str):
        return make(recipe)
    spec = dict(recipe)

    def conditions() -> list[Condition]:
        return [
            Condition(from_recipe(k["factor"]), k.get("op", "gt"), k.get("threshold", 0.0))
            for k in spec.pop("when")
        ]

    if "transform" in spec:
        kind, inner = spec.pop("transform"), from_recipe(spec.pop("of"))
        return transform(inner, kind, **spec)
    if "negate" in spec:
        return negate(from_recipe(spec["negate"]))
    if "combine" in spec:
        method = spec.pop("combine")
        a, b = from_recipe(spec.pop("a")), from_recipe(spec.pop("b"))
        return combine(a, b, method, **spec)
    if "switch" in spec:
        true, false = from_recipe(spec.pop("switch")), from_recipe(spec.pop("else"))
        return switch(true, false, conditions(), **spec)
    if "signal" in spec:
        signal, when = from_recipe(spec.pop("signal")), conditions()
        if len(when) == 1:
            spec.pop("logic", None)
            return conditional(signal, when[0].factor, when[0].op, when[0].threshold, **spec)
        return multi_conditional(signal, when, **spec)
    if "factor" in spec:
        return make(spec["factor"], **spec.get("params", {}))
    raise ValueError(f"not a factor recipe: {sorted(recipe)}")


def expand_transforms(
    names: Iterable[str],
    transforms: Iterable[str] = tuple(TRANSFORM_WINDOWS),
    windows: Mapping[str, Iterable[int]] = TRANSFORM_WINDOWS,
    thresholds: Mapping[str, Iterable[float]] = WINRATE_THRESHOLDS,
    exclusions: Mapping[str, Iterable[str]] = EXCLUSIONS,
    param_grids: Mapping[str, Mapping[str, Iterable]] | None = None,
) -> list[Factor]:
    """factor x parameters x transform x window x threshold, less exclusions."""
    out: dict[str, Factor] = {}
    transforms = [t for t in transforms if t in windows]
    for name in names:
        defaults = FACTORS[name][1]
        variants = [{}]
        grid = (param_grids or {}).get(name, {})
        if grid:
            combos = itertools.product(*grid.values())
            variants += [
                p for p in (dict(zip(grid, v)) for v in combos) if {**defaults, **p} != defaults
            ]
        for params, kind in itertools.product(variants, transforms):
            if name in exclusions.get(kind, ()):
                continue
            cuts = thresholds.get(name, (0.0,)) if kind == "binarize_winrate" else (0.0,)
            for window, cut in itertools.product(windows[kind], cuts):
                f = transform(make(name, **params), kind, window, cut)
                out[f.name] = f
    return list(out.values())


def param_grid(name: str, grid: Mapping[str, Iterable]) -> list[tuple[dict, Factor]]:
    """Every parameter combination of one factor."""
    combos = itertools.product(*grid.values())
    return [(p, make(name, **p)) for p in (dict(zip(grid, v)) for v in combos)]
