"""One query and one statement per factor, over all bars."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from ..functions import breakout, momentum, oscillators, trend, volatility
from ..functions.factor import Factor, with_factors
from ..functions.library import FACTORS, make
from ..functions.scalar import c, rounded
from ..sources.demo import load_bars
from .sqlbase import factor_sql, full, lag, ov, upto

# Factors whose size calls for fewer decimals in the comparison.
DIGITS = {"VPT": 3, "RSRS": 5, "CCI": 5, "VolumeSkew": 5, "ReturnKurtosis": 5}


def _query(build, digits: int = 6):
    """build makes the factor when the query runs, as columns need a session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        factor = build()
        df = with_factors(load_bars(spark, sf_dir), [factor]).df
        return df.select("symbol", "date", rounded(c(factor.name).cast("double"), digits).alias("value"))

    return run


def _std(x: str, n: int) -> dict[str, str]:
    return {"v": full("stddev_samp", x, n)}


def _ewm(x: str, alpha: float, name: str, first: int = 1, least: int = 0) -> dict[str, str]:
    """Closed form of the exponential mean seeded by the value at row `first`."""
    q = 1.0 - alpha
    term = (
        f"CASE WHEN rn = {first} THEN {x} / {alpha!r} WHEN rn > {first} THEN {x} END"
        f" * pow({q!r}, -(rn - {first}))"
    )
    value = f"{alpha!r} * pow({q!r}, rn - {first}) * {upto(f'sum({term})')}"
    return {name: f"CASE WHEN rn >= {first + max(least - 1, 0)} THEN {value} END"}


def _line(kind: str, y: str, n: int) -> str:
    if kind == "slope":
        return full("regr_slope({x}, rn)", y, n)
    return (
        f"CASE WHEN count({y}) {ov(n)} = {n} AND max({y}) {ov(n)} > min({y}) {ov(n)}"
        f" THEN regr_r2({y}, rn) {ov(n)} END"
    )


def _channel(n: int, value: str, flat: str) -> tuple:
    return (
        f"CASE WHEN hi - lo > 1e-12 THEN {value} WHEN hi - lo <= 1e-12 THEN {flat} END",
        {"hi": full("max", "high", n), "lo": full("min", "low", n)},
    )


def _streak(broken: str) -> tuple:
    return (
        "CAST(rn - 1 AS DOUBLE) - CAST(coalesce(lb - 1, 0) AS DOUBLE)",
        {"br": f"CASE WHEN {broken} THEN rn END"},
        {"lb": upto("max(br)")},
    )


def _since(signal: tuple, result: str) -> tuple:
    """First +1 after the last -1 and what follows from it."""
    return (
        result,
        *signal,
        {"seg": upto("sum(CASE WHEN sig = -1 THEN 1 ELSE 0 END)")},
        {
            "er": "min(CASE WHEN sig = 1 THEN rn END) OVER (PARTITION BY symbol, seg ORDER BY date"
            " ROWS UNBOUNDED PRECEDING)",
            "ec": "arg_min(close, CASE WHEN sig = 1 THEN rn END) OVER (PARTITION BY symbol, seg"
            " ORDER BY date ROWS UNBOUNDED PRECEDING)",
        },
    )


def _new_high(gate: bool) -> tuple:
    up = f"{full('avg', 'close', 60)} > {full('avg', 'close', 120)}" if gate else "TRUE"
    others = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)"
    return (
        {
            "top": full("max", "close", 50),
            "up": f"coalesce({up}, FALSE)",
            "ol": f"CASE WHEN count(close) {others} = 24 THEN min(close) {others} END",
        },
        {"sig": "CASE WHEN close >= top AND up THEN 1.0 WHEN close < ol THEN -1.0 ELSE 0.0 END"},
    )


N = 18
_RSRS = (
    {
        "cov": full("covar_samp({x}, high)", "low", N),
        "vl": full("var_samp", "low", N),
        "vh": full("var_samp", "high", N),
    },
    {"score": "cov / nullif(vl, 0) * (cov * cov / nullif(vl * vh, 0))"},
    {
        "z": "CASE WHEN count(score) OVER p = 200 THEN (score - avg(score) OVER p)"
        " / nullif(stddev_samp(score) OVER p, 0) END".replace(
            "OVER p", "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)"
        )
    },
)
_RSRS_SIGNAL = {"sig": "CASE WHEN z > 0.7 THEN 1.0 WHEN z < -0.7 THEN -1.0 ELSE 0.0 END"}

_DM = {
    "pdm": "CASE WHEN high - ph > pl - low AND high - ph > 0 THEN high - ph ELSE 0.0 END",
    "mdm": "CASE WHEN pl - low > high - ph AND pl - low > 0 THEN pl - low ELSE 0.0 END",
}
A14 = 1.0 / 14
_DI = (
    _DM,
    {**_ewm("tr", A14, "atr", 1, 14), **_ewm("pdm", A14, "sp", 1, 14), **_ewm("mdm", A14, "sm", 1, 14)},
    {"pdi": "100.0 * sp / nullif(atr, 0)", "mdi": "100.0 * sm / nullif(atr, 0)"},
    {"dx": "abs(pdi - mdi) / nullif(pdi + mdi, 0) * 100.0"},
)


def _wilder(x: str, name: str) -> dict[str, str]:
    """Mean of the first 14 changes, then weight 1/14."""
    seed = f"avg({x}) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"
    q = 1.0 - A14
    term = (
        f"CASE WHEN rn = 15 THEN seed_{name} / {A14!r} WHEN rn > 15 THEN {x} END * pow({q!r}, -(rn - 15))"
    )
    return seed, f"CASE WHEN rn >= 15 THEN {A14!r} * pow({q!r}, rn - 15) * {upto(f'sum({term})')} END"


_SEED_UP, _UP = _wilder("gain", "u")
_SEED_DOWN, _DOWN = _wilder("loss", "d")

_RANKS = (
    "list_transform({l}, lambda x: len(list_filter({l}, lambda y: y < x))"
    " + (len(list_filter({l}, lambda y: y = x)) + 1) / 2.0)"
)
_DOT = "(list_sum(list_transform(list_zip({a}, {b}), lambda p: p[1] * p[2])) - 20 * 10.5 * 10.5)"
_MAS = {f"m{n}": full("avg", "close", n) for n in (5, 10, 20, 60, 120)}


def _rank_of(me: str, all_: tuple[str, ...]) -> str:
    less = " + ".join(f"coalesce(CAST({m} < {me} AS INT), 0)" for m in all_)
    same = " + ".join(f"coalesce(CAST({m} = {me} AS INT), 0)" for m in all_)
    return f"CASE WHEN {me} IS NOT NULL THEN ({less}) + (({same}) + 1) / 2.0 END"


_M4 = "[m5, m10, m20, m60]"
_LN2 = math.log(2.0)

# Public name -> (final expression, column stages...).
FACTOR_SQL: dict[str, tuple] = {
    "PriceReturn": (f"(close - p) / nullif(p, 0)", {"p": lag("close", 60)}),
    "RiskAdjustedReturn": (
        "CASE WHEN v * sqrt(20) >= 1e-8 THEN (close / p - 1) / (v * sqrt(20)) END",
        {"p": lag("close", 20), **_std("ret", 20)},
    ),
    "IntradayMomentum": ("(close - open) / nullif(open, 0)",),
    "OvernightReturn": ("(open - pc) / nullif(pc, 0)",),
    "HighPointPosition": (
        "CASE WHEN rn >= 20 THEN (list_position(l, list_max(l)) - 1) / 19.0 END",
        {"l": f"list(high) {ov(20)}"},
    ),
    "LowPointPosition": (
        "CASE WHEN rn >= 20 THEN (list_position(l, list_min(l)) - 1) / 19.0 END",
        {"l": f"list(low) {ov(20)}"},
    ),
    "TimeSeriesMomentum": (
        "CASE WHEN close / p - 1 > 0 THEN 1.0 WHEN p IS NOT NULL THEN 0.0 END",
        {"p": lag("close", 252)},
    ),
    "ShortTermReversal": ("-ret",),
    "ExtremeReversal": (
        "CASE WHEN rk <= 0.1 THEN 1.0 WHEN rk >= 0.9 THEN -1.0 WHEN rk IS NOT NULL THEN 0.0 END",
        {"x": f"close / {lag('close', 20)} - 1"},
        {"l": f"list(x) {ov(20)}", "n": f"count(x) {ov(20)}"},
        {
            "rk": "CASE WHEN n = 20 THEN (len(list_filter(l, lambda v: v < x))"
            " + (len(list_filter(l, lambda v: v = x)) + 1) / 2.0) / 20.0 END"
        },
    ),
    "VolumeReversal": (
        "-(close / p - 1) * volume / nullif(m, 0)",
        {"p": lag("close", 5), "m": full("avg", "volume", 20)},
    ),
    "VolumeRatio": ("volume / nullif(m, 0)", {"m": full("avg", "volume", 5)}),
    "VolumePriceCorrelation": (
        "CASE WHEN rn >= 20 AND aa * bb > 0 THEN ab / sqrt(aa * bb) END",
        {"lc": f"list(close) {ov(20)}", "lv": f"list(volume) {ov(20)}"},
        {"a": _RANKS.format(l="lc"), "b": _RANKS.format(l="lv")},
        {"aa": _DOT.format(a="a", b="a"), "bb": _DOT.format(a="b", b="b"), "ab": _DOT.format(a="a", b="b")},
    ),
    "OBV": (upto("sum(coalesce(volume * sign(close - pc), 0.0))"),),
    "VPT": (upto("sum(coalesce(volume * ret, 0.0))"),),
    "AmihudIlliquidity": ("1e6 * " + f"({full('avg', 'x', 20)})", {"x": "abs(ret) / nullif(value, 0)"}),
    "VolumeStd": ("v", _std("volume", 20)),
    "VolumeSkew": (full("skewness", "volume", 20),),
    "AverageAmount": (full("avg", "value", 20),),
    "Volatility": ("v", _std("ret", 20)),
    "DownsideVolatility": (
        full("stddev_samp", "x", 20),
        {"x": "CASE WHEN ret IS NOT NULL THEN least(ret, 0.0) END"},
    ),
    "ParkinsonVolatility": (f"sqrt(({full('avg', 'x', 20)}) / {4 * _LN2!r})", {"x": "pow(ln(high / low), 2)"}),
    "GarmanKlassVolatility": (
        f"sqrt({full('avg', 'x', 20)})",
        {"x": f"greatest(0.5 * pow(ln(high / low), 2) - {2 * _LN2 - 1!r} * pow(ln(close / open), 2), 0.0)"},
    ),
    "VolOfVol": (full("stddev_samp", "v", 60), _std("ret", 20)),
    "MaxDrawdown": (f"close / ({full('max', 'close', 60)}) - 1",),
    "AvgDrawdown": (full("avg", "x", 60), {"x": f"close / ({full('max', 'close', 60)}) - 1"}),
    "HurstExponent": (
        "CASE WHEN rn >= 120 AND s >= 1e-12 THEN ln((list_max(d) - list_min(d)) / s) / ln(119) END",
        {"x": f"lnp - {lag('lnp', 1)}", "l": f"list(lnp) {ov(120)}"},
        {"s": full("stddev_samp", "x", 119), "d": "list_transform(l, lambda y, i: y - l[1] - (i - 1) * (l[-1] - l[1]) / (len(l) - 1))"},
    ),
    "KaufmanER": (
        "CASE WHEN e IS NOT NULL THEN greatest(least(e, 1.0), 0.0) END",
        {"x": "abs(close - pc)"},
        {"e": f"abs(close - {lag('close', 20)}) / nullif({full('sum', 'x', 20)}, 0)"},
    ),
    "UpDownRatio": (f"({full('sum', 'x', 20)}) / 20.0", {"x": "CAST(close > pc AS DOUBLE)"}),
    "ConsecutiveUpDays": _streak("close <= pc"),
    "ConsecutiveDownDays": _streak("close >= pc"),
    "ADX": ("adx", *_DI, _ewm("dx", A14, "adx", 14, 14)),
    "RSI": (
        "CASE WHEN d < 1e-12 THEN 100.0 WHEN d > 1e-12 THEN 100.0 - 100.0 / (1.0 + u / d) END",
        {
            "gain": "CASE WHEN ret IS NOT NULL THEN greatest(ret, 0.0) END",
            "loss": "CASE WHEN ret IS NOT NULL THEN greatest(-ret, 0.0) END",
        },
        {"seed_u": _SEED_UP, "seed_d": _SEED_DOWN},
        {"u": _UP, "d": _DOWN},
    ),
    "Stochastic": _channel(14, "(close - lo) / (hi - lo) * 100.0", "50.0"),
    "CCI": (
        "CASE WHEN rn >= 20 THEN (tp - m) / nullif(0.015 * list_avg(list_transform(l, lambda x: abs(x - m))), 0) END",
        {"m": full("avg", "tp", 20), "l": f"list(tp) {ov(20)}"},
    ),
    "WilliamsR": _channel(14, "(hi - close) / (hi - lo) * -100.0", "-50.0"),
    "MFI": (
        "CASE WHEN n < 1e-12 THEN 100.0 WHEN n > 1e-12 THEN 100.0 - 100.0 / (1.0 + p / n) END",
        {"tpp": lag("tp", 1)},
        {
            "pf": "CASE WHEN tp > tpp THEN tp * volume ELSE 0.0 END",
            "nf": "CASE WHEN tp < tpp THEN tp * volume ELSE 0.0 END",
        },
        {"p": full("sum", "pf", 14), "n": full("sum", "nf", 14)},
    ),
    "UltimateOscillator": (
        "100.0 * (4.0 * a7 + 2.0 * a14 + a28) / 7.0",
        {
            "bp": "CASE WHEN pc IS NOT NULL THEN close - least(low, pc) END",
            "ur": "CASE WHEN pc IS NOT NULL THEN nullif(greatest(high, pc) - least(low, pc), 0) END",
        },
        {f"a{n}": f"({full('sum', 'bp', n)}) / nullif({full('sum', 'ur', n)}, 0)" for n in (7, 14, 28)},
    ),
    "MAPosition": ("(close - m) / close", {"m": full("avg", "close", 200)}),
    "MA": (full("avg", "close", 20),),
    "BIAS": ("(close - m20) / m20", _MAS),
    "LogBIAS": ("lnp / e - 1", _ewm("lnp", 2.0 / 21, "e")),
    "BollingerBandPosition": (
        "(close - m20) / nullif(2.0 * v, 0)",
        {**_MAS, **_std("close", 20)},
    ),
    "MAAlignment": (
        f"(({_rank_of('m5', ('m5', 'm20', 'm60'))}) - ({_rank_of('m60', ('m5', 'm20', 'm60'))})) / 2.0",
        _MAS,
    ),
    "MASlope": (f"m20 / {lag('m20', 5)} - 1", _MAS),
    "MADistance": ("(m5 - m60) / close", _MAS),
    "MADispersion": (
        f"CASE WHEN len(l) >= 2 AND list_avg(l) > 0 THEN list_stddev_samp(l) / list_avg(l) END",
        _MAS,
        {"l": f"list_filter({_M4}, lambda x: x IS NOT NULL)"},
    ),
    "SlopeRiskRatio": (
        "CASE WHEN sl IS NOT NULL THEN CASE WHEN close > m20"
        " THEN sl / close * 100.0 / ((close - m20) / close * 100.0 + v * sqrt(252) * 0.5) ELSE 0.0 END END",
        {**_MAS, "lr": f"lnp - {lag('lnp', 1)}", "sl": _line("slope", "close", 20)},
        _std("lr", 20),
    ),
    "RollingOLS": (_line("slope", "close", 20),),
    "ReturnSkew": (full("skewness", "ret", 60),),
    "ReturnKurtosis": (full("kurtosis", "ret", 60),),
    "HistoricalVaR": (full("quantile_cont({x}, 0.05)", "ret", 252),),
    "CVaR": (
        "CASE WHEN q IS NOT NULL THEN list_avg(list_filter(l, lambda x: x <= q)) END",
        {"q": full("quantile_cont({x}, 0.05)", "ret", 252), "l": f"list(ret) {ov(252)}"},
    ),
    "MFE": (f"({full('max', 'close', 20)}) / {lag('close', 20)} - 1",),
    "MAE": (f"({full('min', 'close', 20)}) / {lag('close', 20)} - 1",),
    "ID": (f"({full('sum', 'x', 20)}) / 20.0", {"x": f"CAST(sign(ret) <> sign({lag('ret', 1)}) AS DOUBLE)"}),
    "NewHigh": ("sig", *_new_high(True)),
    "ChangeSinceNewHigh": _since(_new_high(False), "(close - ec) / ec"),
    "DailyRebound": ("(close - low) / nullif(high - low, 0)",),
    "TrendR2": (_line("r2", "close", 120),),
    "TrendR2_slope": (f"({_line('slope', 'close', 120)}) / first_value(close) {ov(120)}",),
    "RSRS": ("z", *_RSRS),
    "RsrsDerived": _since((*_RSRS, _RSRS_SIGNAL), "CASE WHEN er IS NOT NULL THEN CAST(rn - er AS DOUBLE) END"),
    "ATR": (full("avg", "tr", 25),),
    "NewHighContinuous": (f"close / ({full('max', 'high', 50)}) - 1",),
    "NewLowContinuous": (f"close / ({full('min', 'low', 50)}) - 1",),
    "DonchianChannelPosition": _channel(20, "(close - lo) / (hi - lo)", "0.5"),
    "ATRRatio": (f"({full('avg', 'tr', 25)}) / close",),
    "ChandelierExit": (f"(close - ({full('max', 'high', 22)})) / nullif({full('avg', 'tr', 22)}, 0)",),
}

# Further outputs of factors that have several.
OUTPUTS: dict[str, tuple] = {
    "PriceReturn_skip": (lambda: momentum.price_return(60, 5), ("p1 / p2 - 1", {"p1": lag("close", 5), "p2": lag("close", 65)})),
    "RollingOLS_r2": (lambda: trend.rolling_ols(20, output="r2"), (_line("r2", "close", 20),)),
    "Stochastic_D": (
        lambda: oscillators.stochastic(output="D"),
        (full("avg", "k", 3), _channel(14, "", "")[1], {"k": _channel(14, "(close - lo) / (hi - lo) * 100.0", "50.0")[0]}),
    ),
    "ADX_plus_di": (lambda: trend.adx(output="plus_di"), ("pdi", *_DI)),
    "ADX_minus_di": (lambda: trend.adx(output="minus_di"), ("mdi", *_DI)),
    "ADX_dx": (lambda: trend.adx(output="dx"), ("dx", *_DI)),
    "RSRS_signal": (lambda: trend.rsrs(output="signal"), ("sig", *_RSRS, _RSRS_SIGNAL)),
    "RSRS_beta": (lambda: trend.rsrs(output="beta"), ("cov / nullif(vl, 0)", *_RSRS)),
    "RSRS_r_square": (lambda: trend.rsrs(output="r_square"), ("cov * cov / nullif(vl * vh, 0)", *_RSRS)),
    "RsrsDerived_return": (
        lambda: trend.rsrs_derived(output="return_since_buy"),
        _since((*_RSRS, _RSRS_SIGNAL), "close / ec - 1"),
    ),
    "RsrsDerived_trend": (
        lambda: trend.rsrs_derived(output="zscore_trend"),
        ("e5 - e20", *_RSRS, {**_ewm("z", 2 / 6, "e5", 218), **_ewm("z", 2 / 21, "e20", 218)}),
    ),
    "ATR_pct": (
        lambda: volatility.average_true_range(normalize_by_close=True),
        (f"({full('avg', 'tr', 25)}) / close",),
    ),
    "ATR_tr_pct": (
        lambda: volatility.average_true_range(normalize_by_close=True, normalize_first=True),
        (full("avg", "x", 25), {"x": "tr / close"}),
    ),
    "Volatility_ann": (lambda: volatility.volatility(annualize=True), (f"({full('stddev_samp', 'ret', 20)}) * sqrt(252)",)),
    "NewHigh_nofilter": (lambda: breakout.new_high(use_long_filter=False), ("sig", *_new_high(False))),
}


def _scaled(factor: Factor) -> Factor:
    """Amihud values are tiny; compare them in millionths."""
    name = factor.name + "_e6"
    return Factor(name, lambda w: c(factor.name) * 1e6, (factor,))


def queries() -> dict:
    out = {}
    for name in FACTORS:
        build = lambda name=name: _scaled(make(name)) if name == "AmihudIlliquidity" else make(name)
        out[f"factor_{name}"] = _query(build, DIGITS.get(name, 6))
    for name, (build, _) in OUTPUTS.items():
        out[f"factor_{name}"] = _query(build, DIGITS.get(name.split("_")[0], 6))
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (value, *stages) in FACTOR_SQL.items():
        out[f"factor_{name}"] = factor_sql(value, *stages, digits=DIGITS.get(name, 6))
    for name, (_, (value, *stages)) in OUTPUTS.items():
        out[f"factor_{name}"] = factor_sql(value, *stages, digits=DIGITS.get(name.split("_")[0], 6))
    return out
