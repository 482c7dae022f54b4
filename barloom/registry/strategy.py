"""Selection, rotation, timing and performance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.factor import with_factors
from ..functions.library import make
from ..functions.scalar import c
from ..operators import joins, panel as P, performance as R, predictive, rotation as RO, selection as S
from ..plans.rotation_run import grid, run_grid, run_variants, variant_targets
from ..sources.demo import load_bars, ship_dates
from .analysis import _round, ic_sql
from .sqlbase import BARS, S0, r

INTERVAL = 20
RANGES = "SELECT 'early' AS period, DATE '1995-06-01' AS start, DATE '1996-12-31' AS end UNION ALL SELECT 'late', DATE '1999-01-01', DATE '2001-06-30'"
FEATURES = ("PriceReturn", "Volatility", "VolumeRatio", "KaufmanER")


def _features(spark, sf):
    bars = load_bars(spark, sf)
    fs = [make("PriceReturn", window=20), make("Volatility"), make("VolumeRatio"), make("KaufmanER")]
    out = with_factors(bars, fs)
    names = dict(zip((f.name for f in fs), ("mom", "vol", "vr", "er")))
    out = out.with_df(out.df.withColumnsRenamed(names))
    return out.with_df(S.eligible(out.df, "mom", 60, fits=out.symbol_fits))


def _clusters(bars):
    number = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    return bars.df.select("symbol").distinct().withColumn("cluster", F.pmod(number, F.lit(6)) - 1)


def _candidates(spark, sf):
    feats = _features(spark, sf)
    reb = S.rebalance_dates(ship_dates(spark, sf), INTERVAL)
    return feats, reb, S.raw_candidates(feats.df, reb, "mom", _clusters(load_bars(spark, sf)))


def _filtered(spark, sf):
    feats, reb, cand = _candidates(spark, sf)
    cand = S.apply_rank_filters(cand, [S.RankFilter("vol", 0.1, 0.1), S.RankFilter("er", 0.2, 0.0)], fits=load_bars(spark, sf).date_fits)
    return feats, reb, S.apply_threshold_filters(cand, [S.ThresholdFilter("vr", ">=", 0.5)])


def _weights(spark, sf, top_n=3, method="equal", **kw):
    feats, reb, cand = _filtered(spark, sf)
    chosen = S.pick_top(cand, top_n, cluster_max=1)
    return feats, reb, S.allocate(chosen, method, **kw)


CLUSTER = "CAST(regexp_extract(symbol, '(\\d+)', 1) AS INT) % 6 - 1"
FEAT = f"""{S0},
ft0 AS (SELECT symbol, date, open, close, ret, (close - lag(close, 20) OVER w) / lag(close, 20) OVER w AS mom,
    CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS vol,
    CASE WHEN count(volume) OVER w5 = 5 THEN volume / avg(volume) OVER w5 END AS vr,
    abs(close - lag(close, 20) OVER w) AS net, abs(close - pc) AS mv, min(date) OVER (PARTITION BY symbol) AS listing
  FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY date),
    w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING)),
ft AS MATERIALIZED (SELECT *, date > listing + 60 AND mom IS NOT NULL AS eligible, {CLUSTER} AS cluster,
    CASE WHEN count(mv) OVER w20 = 20 THEN least(net / nullif(sum(mv) OVER w20, 0), 1.0) END AS er
  FROM ft0 WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)),
cal AS MATERIALIZED (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, lead(date) OVER (ORDER BY date) AS nxt
  FROM (SELECT DISTINCT date FROM bars)),
reb AS MATERIALIZED (SELECT CAST(t // {INTERVAL} AS INT) AS period, date, nxt AS execution_date FROM cal
  WHERE t % {INTERVAL} = 0 AND nxt IS NOT NULL),
cand AS MATERIALIZED (SELECT ft.*, reb.period, reb.execution_date, x.open AS next_open, mom AS score FROM ft JOIN reb USING (date)
  JOIN bars x ON x.symbol = ft.symbol AND x.date = reb.execution_date WHERE eligible AND x.open > 0)"""


def _pct(x: str, src: str, name: str) -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT *, CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST)"
        f" + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END AS pct_{name} FROM {src})"
    )


FILTERED = (
    _pct("vol", "cand", "k1")
    + ",\n"
    + _pct("er", "(SELECT * FROM k1 WHERE pct_k1 > 0.1 AND pct_k1 <= 0.9)", "k2")
    + ",\nflt AS MATERIALIZED (SELECT * FROM k2 WHERE pct_k2 > 0.2 AND pct_k2 <= 1.0 AND vr >= 0.5)"
)


def _pick(n: int, name: str = "sel") -> str:
    return (
        f"{name}0 AS (SELECT *, row_number() OVER (PARTITION BY date, cluster ORDER BY score DESC, symbol) AS seat FROM flt),\n"
        f"{name} AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, symbol) AS rk"
        f" FROM {name}0 WHERE cluster < 0 OR seat <= 1) WHERE rk <= {n})"
    )


def sql(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {BARS},\n{FEAT}" + "".join(",\n" + x for x in ctes) + "\n" + body


_RAW = {
    "equal": "1.0",
    "score": "greatest(score, 1e-8)",
    "factor": "CASE WHEN vol IS NULL THEN 1e-8 ELSE greatest(abs(vol), 1e-8) END",
    "inverse_factor": "CASE WHEN vol IS NULL THEN 1e-8 ELSE 1.0 / greatest(abs(vol), 1e-8) END",
    "tiered": "CASE WHEN rk <= 1 THEN 3.0 WHEN rk <= 3 THEN 2.0 ELSE 1.0 END",
}


def _wsql(method: str = "equal", n: int = 3, name: str = "wt", sel: str = "sel") -> tuple[str, ...]:
    return (
        FILTERED,
        _pick(n, sel),
        f"{name} AS MATERIALIZED (SELECT symbol, date, period, execution_date, rk, {_RAW[method]} / sum({_RAW[method]}) OVER (PARTITION BY date) AS w FROM {sel})",
    )


COST = 0.001


def _rotation_ctes(wt: str = "wt") -> tuple[str, ...]:
    """Holdings with as-of prices, drifted weights, cost scales, levels."""
    return (
        "sp AS MATERIALIZED (SELECT period, execution_date AS s, lead(execution_date) OVER (ORDER BY period) AS e FROM reb)",
        f"hd0 AS (SELECT h.period, h.symbol, h.w, cal.date, sp.s, sp.e, b.open, b.close FROM {wt} h JOIN sp USING (period)"
        " JOIN cal ON cal.date >= sp.s AND (sp.e IS NULL OR cal.date <= sp.e) LEFT JOIN bars b ON b.symbol = h.symbol AND b.date = cal.date)",
        "hd AS MATERIALIZED (SELECT period, symbol, w, date, e, last_value(open IGNORE NULLS) OVER x AS open,"
        " last_value(close IGNORE NULLS) OVER x AS close, first_value(open IGNORE NULLS) OVER x AS eo FROM hd0"
        " WINDOW x AS (PARTITION BY period, symbol ORDER BY date ROWS UNBOUNDED PRECEDING))",
        "gv AS MATERIALIZED (SELECT period, symbol, sum(w * open / eo) OVER (PARTITION BY period) AS gross,"
        " w * open / eo / sum(w * open / eo) OVER (PARTITION BY period) AS dr FROM hd WHERE date = e)",
        "gr AS MATERIALIZED (SELECT period, max(gross) AS gross FROM gv GROUP BY period)",
        f"pw AS MATERIALIZED (SELECT coalesce(a.period, b.period + 1) AS period, coalesce(a.w, 0) AS w, coalesce(b.dr, 0) AS d"
        f" FROM {wt} a FULL JOIN gv b ON a.symbol = b.symbol AND a.period = b.period + 1)",
        "pa AS MATERIALIZED (SELECT period, list({'w': w, 'd': d}) AS pr, sum(w) AS sw, sum(d) AS sd FROM pw GROUP BY period)",
        "bis AS (SELECT period, pr, CAST(0.0 AS DOUBLE) AS lo, CAST(1.0 AS DOUBLE) AS hi, 0 AS it FROM pa UNION ALL"
        " SELECT period, pr, CASE WHEN okk THEN (lo + hi) / 2 ELSE lo END, CASE WHEN okk THEN hi ELSE (lo + hi) / 2 END, it + 1 FROM"
        f" (SELECT *, 1 - (lo + hi) / 2 - {COST} * list_sum(list_transform(pr, lambda p: abs((lo + hi) / 2 * p.w - p.d))) >= 0 AS okk FROM bis WHERE it < 60))",
        f"sc AS MATERIALIZED (SELECT r.period, CASE WHEN pa.period IS NULL THEN 1.0 WHEN sw > 0 THEN lo ELSE 1 - {COST} * sd END AS scale, gr.gross"
        " FROM reb r LEFT JOIN pa USING (period) LEFT JOIN (SELECT * FROM bis WHERE it = 60) b USING (period) LEFT JOIN gr USING (period))",
        "ch AS MATERIALIZED (SELECT period, sum(ln(scale)) OVER (ORDER BY period ROWS UNBOUNDED PRECEDING) + coalesce(sum(ln(coalesce(gross, 1)))"
        " OVER (ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb FROM sc)",
        "vd AS (SELECT period, date, sum(w * close / eo) AS ratio FROM hd WHERE e IS NULL OR date < e GROUP BY period, date)",
        "eq AS MATERIALIZED (SELECT cal.date, lb + ln(coalesce(ratio, 1)) AS le FROM ch JOIN sp USING (period) JOIN cal"
        " ON cal.date >= sp.s AND (sp.e IS NULL OR cal.date < sp.e) LEFT JOIN vd ON vd.period = ch.period AND vd.date = cal.date)",
    )


_TOPS = {"top1": ("1.0", 1, "FALSE"), "top3": ("greatest(sc, 1e-8)", 3, "seat > 1"), "top4": ("sqrt(vol) + rk * 0.1", 4, "FALSE")}
_GROUP_ROWS = {
    "strong": "SELECT *, mom AS sc FROM cb WHERE vr >= 0.5 AND mom > vol * 0.1 AND mom > bm",
    "steady": "SELECT * EXCLUDE (pct), er AS sc FROM (SELECT *, CASE WHEN vol IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY vol NULLS LAST)"
    " + (count(*) OVER (PARTITION BY date, vol) - 1) / 2.0) / count(vol) OVER (PARTITION BY date) END AS pct FROM cb WHERE vr >= 0.5 AND er IS NOT NULL) WHERE pct > 0.1 AND pct <= 0.9",
}
GRID_SQL = (
    "cb AS MATERIALIZED (SELECT cand.*, b.bm FROM cand ASOF LEFT JOIN (SELECT date AS bd, mom AS bm FROM ft WHERE symbol = 'Brand#1' AND mom IS NOT NULL) b ON cand.date >= b.bd)",
    "gw AS MATERIALIZED ("
    + " UNION ALL ".join(
        f"SELECT '{g}/{t}' AS v, period, date, symbol, ({w}) / sum({w}) OVER (PARTITION BY date) AS w FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY sc DESC, symbol) AS rk"
        f" FROM (SELECT *, row_number() OVER (PARTITION BY date, cluster ORDER BY sc DESC, symbol) AS seat FROM ({rows})) WHERE cluster < 0 OR NOT ({out})) WHERE rk <= {n}"
        for g, rows in _GROUP_ROWS.items()
        for t, (w, n, out) in _TOPS.items()
    )
    + ")",
)
GRID_EQUITY_SQL = (
    "sp AS MATERIALIZED (SELECT period, execution_date AS s, lead(execution_date) OVER (ORDER BY period) AS e FROM reb)",
    "gh0 AS (SELECT h.v, h.period, h.symbol, h.w, cal.date, sp.e, b.open, b.close FROM gw h JOIN sp USING (period)"
    " JOIN cal ON cal.date >= sp.s AND (sp.e IS NULL OR cal.date <= sp.e) LEFT JOIN bars b ON b.symbol = h.symbol AND b.date = cal.date)",
    "gh AS MATERIALIZED (SELECT v, period, symbol, w, date, e, last_value(open IGNORE NULLS) OVER x AS open, last_value(close IGNORE NULLS) OVER x AS close, first_value(open IGNORE NULLS) OVER x AS eo"
    " FROM gh0 WINDOW x AS (PARTITION BY v, period, symbol ORDER BY date ROWS UNBOUNDED PRECEDING))",
    "gp AS MATERIALIZED (SELECT v, period, sum(w * open / eo) AS g FROM gh WHERE date = e GROUP BY v, period)",
    "gb AS (SELECT v, r.period, coalesce(sum(ln(coalesce(g, 1))) OVER (PARTITION BY v ORDER BY r.period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lb"
    " FROM (SELECT DISTINCT v FROM gw) CROSS JOIN reb r LEFT JOIN gp USING (v, period))",
    "ge AS (SELECT gb.v, cal.date, lb + ln(coalesce(x, 1)) AS le FROM gb JOIN sp USING (period) JOIN cal ON cal.date >= sp.s AND (sp.e IS NULL OR cal.date < sp.e)"
    " LEFT JOIN (SELECT v, period, date, sum(w * close / eo) AS x FROM gh WHERE e IS NULL OR date < e GROUP BY v, period, date) vd ON vd.v = gb.v AND vd.period = gb.period AND vd.date = cal.date)",
    "gr0 AS MATERIALIZED (SELECT v, date, exp(le - lag(le) OVER (PARTITION BY v ORDER BY date)) - 1 AS ret FROM ge)",
    "gr1 AS (SELECT gr0.*, p.period, exp(sum(ln(1 + ret)) OVER (PARTITION BY v, p.period ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq FROM gr0"
    f" JOIN ({RANGES}) p ON date BETWEEN p.start AND p.\"end\" WHERE ret IS NOT NULL)",
    "gd AS (SELECT *, eq / max(eq) OVER (PARTITION BY v, period ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM gr1)",
)


def _equity(spark, sf):
    feats, reb, w = _weights(spark, sf)
    return RO.equity_levels(RO.execute(w, reb, ship_dates(spark, sf), feats.df, COST))


def _log(spark, sf):
    feats, reb, w = _weights(spark, sf)
    return RO.rebalance_log(RO.execute(w, reb, ship_dates(spark, sf), feats.df, COST))


RULES = (
    RO.StopRule("loss", 0.5),
    RO.StopRule("profit", 1.5, ratio=0.5),
    RO.StopRule("trailing_pct", 0.6),
    RO.StopRule("trailing_atr", 3.0, field="atr"),
    RO.StopRule("factor", 3.0, field="vr", op=">", ratio=0.25),
)


def _stops(spark, sf):
    feats, reb, w = _weights(spark, sf)
    atr = make("ATR", window=14)
    bars = with_factors(feats, [atr]).df.withColumnRenamed(atr.name, "atr")
    spells = RO.holding_spells(w, reb)
    return feats, RO.stop_triggers(spells, bars, RULES, ["atr", "vr"])


STOP_SQL = (
    "isl AS (SELECT symbol, min(period) AS spell, max(period) AS lp FROM (SELECT symbol, period, period - row_number() OVER (PARTITION BY symbol ORDER BY period) AS i FROM wt) GROUP BY symbol, i)",
    "spl AS MATERIALIZED (SELECT isl.symbol, spell, a.execution_date AS s, b.execution_date AS e FROM isl JOIN reb a ON a.period = spell LEFT JOIN reb b ON b.period = lp + 1)",
    "atr AS (SELECT s0.symbol, s0.date, CASE WHEN count(tr) OVER x = 14 THEN avg(tr) OVER x END AS atr FROM s0 WINDOW x AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING))",
    "sd AS (SELECT spl.symbol, spell, ft.date, ft.close, ft.vr, a.atr, first_value(ft.open) OVER x AS ep, greatest(max(ft.close) OVER x, first_value(ft.open) OVER x) AS hs"
    " FROM spl JOIN ft ON ft.symbol = spl.symbol AND ft.date >= spl.s AND (spl.e IS NULL OR ft.date < spl.e) JOIN atr a ON a.symbol = ft.symbol AND a.date = ft.date"
    " WINDOW x AS (PARTITION BY spl.symbol, spell ORDER BY ft.date ROWS UNBOUNDED PRECEDING))",
    "tg AS (SELECT *, greatest(CASE WHEN close <= ep * 0.5 THEN 1.0 ELSE 0.0 END, CASE WHEN close >= ep * 2.5 THEN 0.5 ELSE 0.0 END, CASE WHEN close <= hs * 0.4 THEN 1.0 ELSE 0.0 END,"
    " CASE WHEN hs - 3.0 * atr > close THEN 1.0 ELSE 0.0 END, CASE WHEN vr > 3.0 THEN 0.25 ELSE 0.0 END) AS ratio FROM sd)",
    "ff AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, spell ORDER BY date) AS n FROM tg WHERE ratio > 0) WHERE n = 1)",
)


def _timing(spark, sf):
    bars = load_bars(spark, sf)
    ma, vr = make("MA"), make("VolumeRatio")
    feats = with_factors(bars, [ma, vr])
    return R.position_from_signals(feats, F.col("close") > c(ma.name), c(vr.name) > 1.2)


def _breakout(spark, sf):
    high, atr = make("NewHigh", use_long_filter=False), make("ATR", window=14)
    out = with_factors(load_bars(spark, sf), [high, atr])
    return out.with_df(out.df.withColumnsRenamed({high.name: "nh", atr.name: "atr"}).withColumn("enter", F.col("nh") == 1))


def _lookback(spark, sf):
    return R.lookback_positions(_breakout(spark, sf), F.col("enter"), 60, 1.5)


def _peak(spark, sf):
    return R.peak_positions(_breakout(spark, sf), "enter", 1.5)


_TOP = "CASE WHEN count(close) OVER w50 = 50 THEN close >= max(close) OVER w50 END"
BREAKOUT_SQL = (
    f"bk AS MATERIALIZED (SELECT symbol, date, rn, close, coalesce({_TOP}, FALSE) AS e, max(close) OVER w60 AS h60,"
    " coalesce(CASE WHEN count(tr) OVER w14 = 14 THEN avg(tr) OVER w14 END, 0) AS atr FROM s0"
    " WINDOW w50 AS (PARTITION BY symbol ORDER BY date ROWS 49 PRECEDING), w60 AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING))",
    "lk AS (SELECT symbol, date, rn, CASE WHEN e THEN 1 ELSE 0 END AS position FROM bk WHERE rn = 1 UNION ALL SELECT t.symbol, t.date, t.rn,"
    " CASE WHEN p.position = 0 AND t.e THEN 1 WHEN p.position = 1 AND t.h60 - t.close > 1.5 * t.atr THEN 0 ELSE p.position END FROM lk p JOIN bk t ON t.symbol = p.symbol AND t.rn = p.rn + 1)",
    "pk AS (SELECT symbol, date, rn, CASE WHEN e THEN 1 ELSE 0 END AS position, CASE WHEN e THEN close ELSE 0 END AS peak FROM bk WHERE rn = 1 UNION ALL SELECT t.symbol, t.date, t.rn,"
    " CASE WHEN p.position = 0 THEN CASE WHEN t.e THEN 1 ELSE 0 END WHEN greatest(p.peak, t.close) - t.close > 1.5 * t.atr THEN 0 ELSE 1 END,"
    " CASE WHEN p.position = 0 THEN CASE WHEN t.e THEN t.close ELSE 0 END ELSE greatest(p.peak, t.close) END FROM pk p JOIN bk t ON t.symbol = p.symbol AND t.rn = p.rn + 1)",
)


TIMING_SQL = (
    "tm AS MATERIALIZED (SELECT symbol, date, rn, close, ret, coalesce(CASE WHEN count(close) OVER w20 = 20 THEN close > avg(close) OVER w20 END, FALSE) AS e,"
    " coalesce(CASE WHEN count(volume) OVER w5 = 5 THEN volume / avg(volume) OVER w5 > 1.2 END, FALSE) AS x FROM s0"
    " WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING))",
    "ps AS (SELECT symbol, date, rn, close, ret, CASE WHEN e THEN 1 ELSE 0 END AS position FROM tm WHERE rn = 1 UNION ALL"
    " SELECT t.symbol, t.date, t.rn, t.close, t.ret, CASE WHEN p.position = 0 AND t.e THEN 1 WHEN p.position = 1 AND t.x THEN 0 ELSE p.position END"
    " FROM ps p JOIN tm t ON t.symbol = p.symbol AND t.rn = p.rn + 1)",
    "pm AS MATERIALIZED (SELECT *, lag(position) OVER (PARTITION BY symbol ORDER BY date) AS lp FROM ps)",
    "sr AS MATERIALIZED (SELECT symbol, date, lp * ret AS ret FROM pm WHERE rn > 20 AND lp * ret IS NOT NULL)",
)


def timing_sql(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {BARS},\n{S0}" + "".join(",\n" + x for x in (*TIMING_SQL, *ctes)) + "\n" + body


def _timing_returns(spark, sf):
    return R.strategy_returns(_timing(spark, sf), warmup=20).df.select("symbol", "date", "ret")


METRIC_SQL = (
    "count(*) AS n, {} AS log_growth, {} AS annualised_volatility, {} AS win_rate".format(
        r("sum(ln(1 + ret))"),
        r("stddev_samp(ret) * sqrt(252)"),
        r("avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)"),
    )
)


def _metric_cols(df, *keys):
    """Growth is compared on the log scale, where noisy prices stay in range."""
    return _round(
        df.select(*keys, "n", F.log1p("cumulative_return").alias("log_growth"), "annualised_volatility", "win_rate")
    )


def _benchmark(spark, sf):
    bars = load_bars(spark, sf)
    bh = R.buy_and_hold(bars)
    weights = bars.df.groupBy("symbol").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return R.weighted_benchmark(bh.df, R.normalized_weights(bars.df, weights))


BENCH = (
    "nw AS (SELECT symbol, count(*) * 1.0 / (SELECT count(*) FROM bars) AS wgt FROM bars GROUP BY symbol)",
    "bm AS MATERIALIZED (SELECT date, sum(wgt * ret) AS ret FROM s0 JOIN nw USING (symbol) WHERE ret IS NOT NULL GROUP BY date)",
)


def bars_sql(body: str, *ctes: str) -> str:
    return f"WITH {BARS},\n{S0}" + "".join(",\n" + x for x in ctes) + "\n" + body


def _scaled_benchmark(spark, sf):
    """A small exposure keeps the level of these noisy series printable."""
    return _benchmark(spark, sf).withColumn("ret", F.col("ret") * 0.001)


SCALED = (*BENCH, "b1 AS MATERIALIZED (SELECT date, ret * 0.001 AS ret FROM bm)",
          "bq AS MATERIALIZED (SELECT date, ret, exp(sum(ln(1 + ret)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq FROM b1)",
          "bd AS MATERIALIZED (SELECT *, eq / max(eq) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM bq)")


def _summary(spark, sf):
    feats, reb, w = _weights(spark, sf)
    return run_grid(RO.execute(w, reb, ship_dates(spark, sf), feats.df, COST))


BENCHMARK = S.Other("Brand#1", "mom")
CONDITIONS = (
    S.ThresholdFilter("vr", ">=", 0.5),
    S.Condition("calmer_than_its_return", lambda: F.col("mom") > F.col("vol") * 0.1),
    S.Condition("stronger_than_benchmark", lambda: F.col("mom") > BENCHMARK.column, (BENCHMARK,)),
)
GROUPS = {
    "strong": {"score": "mom", "conditions": CONDITIONS},
    "steady": {"score": "er", "conditions": CONDITIONS[:1], "rank_filters": (S.RankFilter("vol", 0.1, 0.1),)},
}
VARIANTS = {
    "top1": {"top_n": 1},
    "top3": {"top_n": 3, "allocator": "score", "cluster_max": 1},
    "top4": {"top_n": 4, "allocator": lambda: F.sqrt(F.col("vol")) + F.col("rank") * 0.1},
}
def _grid_targets(spark, sf):
    feats, reb = _features(spark, sf), S.rebalance_dates(ship_dates(spark, sf), INTERVAL)
    return feats, reb, variant_targets(feats, reb, grid(GROUPS, VARIANTS), _clusters(load_bars(spark, sf)))


def _grid_ranges(spark, sf):
    feats, reb = _features(spark, sf), S.rebalance_dates(ship_dates(spark, sf), INTERVAL)
    return run_variants(feats, reb, grid(GROUPS, VARIANTS), ship_dates(spark, sf), spark.sql(RANGES), _clusters(load_bars(spark, sf)))


def _cells(x):
    """A map of weights as text, in hundredths of a percent."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(x)), lambda e: F.concat(e["key"], F.lit(":"), F.round(e["value"] * 1e4).cast("long"))), ",")


TRIMS = (0.1, 0.25)


def _trimmed(spark, sf):
    """How many candidates each pair of trims leaves, all pairs in one plan."""
    feats, reb = _features(spark, sf), S.rebalance_dates(ship_dates(spark, sf), INTERVAL)
    variants = {f.name: {"score": "mom", "rank_filters": (f,), "top_n": 1_000_000} for f in S.make_rank_filters("vol", TRIMS)}
    return variant_targets(feats, reb, variants).weights.groupBy("variant").agg(F.count(F.lit(1)).alias("n"))


def _full_log(spark, sf):
    feats, reb, made = _grid_targets(spark, sf)
    one = made.weights.filter("variant = 'strong/top4'"), made.counts.filter("variant = 'strong/top4'")
    log = RO.rebalance_log(RO.execute(one[0], reb, ship_dates(spark, sf), feats.df, 0.0), one[1])
    return log.select(
        "period", "signal_date", "execution_date", "candidate_count", "filtered_candidate_count",
        F.array_join(F.transform("counts_after", lambda x: x.cast("string")), ",").alias("counts_after"),
        F.array_join("active_candidate_filters", ",").alias("active_candidate_filters"),
        F.array_join("selected_symbols", ",").alias("selected_symbols"),
        _cells("current_weights").alias("current_weights"), _cells("target_weights").alias("target_weights"),
        _cells("executed_weights").alias("executed_weights"), "turnover", "period_return",
    )


def _dynamic(spark, sf):
    feats = _features(spark, sf)
    feats = P.forward_returns(feats, [INTERVAL], ship_dates(spark, sf), column="fwd")
    long = P.long_factors(feats, ["mom", "vol", "er"], ["fwd"])
    ic = predictive.daily_ic(long, keys=["factor_name"])
    metric = predictive.icir_series(ic, 120, 60, keys=["factor_name"])
    reb = S.rebalance_dates(ship_dates(spark, sf), INTERVAL)
    return S.dynamic_ranking(metric, reb, INTERVAL, "mom")


def queries() -> dict:
    q = {}
    q["select_rebalance_calendar"] = lambda s, d: _round(S.rebalance_dates(ship_dates(s, d), INTERVAL))
    q["select_eligible"] = lambda s, d: _features(s, d).df.select("symbol", "date", "listing_date", "eligible")
    q["select_candidates"] = lambda s, d: _round(_candidates(s, d)[2].select("symbol", "date", "execution_date", "score"))
    q["select_rank_filters"] = lambda s, d: _round(
        S.apply_rank_filters(_candidates(s, d)[2], [S.RankFilter("vol", 0.1, 0.1), S.RankFilter("er", 0.2, 0.0)], fits=load_bars(s, d).date_fits).select("symbol", "date", "score")
    )
    q["select_threshold_filter"] = lambda s, d: _round(
        S.apply_threshold_filters(_candidates(s, d)[2], [S.ThresholdFilter("vr", ">=", 0.5), S.ThresholdFilter("vol", "<", 2.0)]).select("symbol", "date", "score")
    )
    q["select_min_momentum"] = lambda s, d: _round(S.min_momentum(_candidates(s, d)[2], 0.1).select("symbol", "date", "score"))
    q["select_exclude_clusters"] = lambda s, d: _round(
        S.raw_candidates(_features(s, d).df, S.rebalance_dates(ship_dates(s, d), INTERVAL), "mom", _clusters(load_bars(s, d)), (0, 2)).select("symbol", "date", "cluster")
    )
    q["select_top_with_cluster_cap"] = lambda s, d: _round(
        S.pick_top(_filtered(s, d)[2], 3, cluster_max=1).select("symbol", "date", "rank", "score")
    )
    for m in _RAW:
        kw = {"field": "vol"} if "factor" in m else ({"tiers": ((1, 3.0), (2, 2.0), (1, 1.0))} if m == "tiered" else {})
        q[f"allocate_{m}"] = lambda s, d, m=m, kw=kw: _round(_weights(s, d, 4, m, **kw)[2].select("symbol", "date", "weight"))
    q["allocate_exposure_caps"] = lambda s, d: _round(
        S.exposure_caps(_weights(s, d, 4, "inverse_factor", field="vol")[2], 0.1, 0.4, 0.9).select("symbol", "date", "weight")
    )
    q["select_set_changes"] = lambda s, d: _round(S.set_changes(_weights(s, d)[2]).drop("variant"))
    q["select_dynamic_ranking"] = lambda s, d: _dynamic(s, d)
    q["select_monthly_pool"] = lambda s, d: _round(
        S.monthly_pool(_features(s, d).df, _clusters(load_bars(s, d)), 12)
    )
    q["select_recent_complete_date"] = lambda s, d: S.recent_complete_date(load_bars(s, d).df)
    q["select_exclusion_reasons"] = lambda s, d: S.exclusion_reasons(_features(s, d).df)
    q["rank_composite_pct"] = lambda s, d: _round(
        S.composite_rank(_features(s, d).df, [("mom", 1.0), ("vol", -0.5)], "score", fits=load_bars(s, d).date_fits).select("symbol", "date", "score")
    )
    q["rank_composite_minmax"] = lambda s, d: _round(
        S.composite_rank(_features(s, d).df, [("mom", 1.0), ("er", 2.0)], "score", "minmax", fits=load_bars(s, d).date_fits).select("symbol", "date", "score")
    )
    q["signal_rotation"] = lambda s, d: _round(
        S.rotation_signal(_features(s, d).df, [("mom", 1.0), ("er", 0.5)], 3, "vr", 0.8, "score", 0.2, fits=load_bars(s, d).date_fits).select("symbol", "date", "score", "weight")
    )
    q["signal_momentum"] = lambda s, d: _round(
        S.momentum_signal(_features(s, d).df, "mom", 0.05, 4).select("symbol", "date", "score", "weight")
    )
    q["rotation_holdings"] = lambda s, d: _round(
        RO.holding_days(_weights(s, d)[2], S.rebalance_dates(ship_dates(s, d), INTERVAL), ship_dates(s, d), load_bars(s, d).df).select(
            "period", "symbol", "date", (F.col("close") / F.col("entry_open")).alias("ratio")
        )
    )
    q["rotation_cost_scales"] = lambda s, d: _round(_log(s, d).select("period", "cost_share", "period_return"), 5)
    q["rotation_equity"] = lambda s, d: _round(_equity(s, d).select("date", F.log("equity").alias("log_equity")), 5)
    q["rotation_log"] = lambda s, d: _round(
        _log(s, d).select("period", "signal_date", "execution_date", "n_targets", "turnover"), 5
    )
    q["select_conditions"] = lambda s, d: _round(
        S.screen(_candidates(s, d)[2], CONDITIONS, _features(s, d)).select("symbol", "date", "score", F.col("failed_at").cast("long").alias("failed_at"))
    )
    q["select_rank_filter_grid"] = _trimmed
    q["rotation_grid_weights"] = lambda s, d: _round(_grid_targets(s, d)[2].weights.select("variant", "period", "symbol", "weight"))
    q["rotation_grid_ranges"] = lambda s, d: _round(
        _grid_ranges(s, d).select("group", "variant", "period", "n", F.log1p("cumulative_return").alias("log_growth"), "annualised_volatility", "max_drawdown"), 4
    )
    q["rotation_log_full"] = lambda s, d: _round(_full_log(s, d), 4)
    q["rotation_hold_overlap"] = lambda s, d: _round(
        RO.hold_overlap_weights(_weights(s, d)[2], S.rebalance_dates(ship_dates(s, d), INTERVAL), load_bars(s, d).df, COST)
    )
    q["rotation_stop_triggers"] = lambda s, d: _round(_stops(s, d)[1].select("symbol", "spell", "trigger_date", "ratio"))
    q["rotation_stop_fills"] = lambda s, d: _round(
        RO.stop_fills(_stops(s, d)[1], ship_dates(s, d), load_bars(s, d).df).select("symbol", "spell", "execution_date", "ratio", "pnl_pct"), 4
    )
    q["rotation_grid_summary"] = lambda s, d: _round(
        _summary(s, d).select("variant", "n", F.log1p("cumulative_return").alias("log_growth"), "annualised_volatility", "rebalance_win_rate", "avg_turnover", "rebalance_count"), 5
    )
    q["timing_positions"] = lambda s, d: _timing(s, d).df.select("symbol", "date", F.col("position").cast("long").alias("position"))
    q["timing_returns"] = lambda s, d: _round(_timing_returns(s, d))
    q["timing_metrics"] = lambda s, d: _metric_cols(R.return_metrics(_timing_returns(s, d).withColumn("ret", F.col("ret") * 0.1), ["symbol"]), "symbol")
    q["timing_trades"] = lambda s, d: _round(R.trade_table(_timing(s, d)).drop("entry_price", "exit_price"))
    q["timing_trade_counts"] = lambda s, d: _round(R.trade_counts(R.trade_table(_timing(s, d))))
    q["timing_lookback_exit"] = lambda s, d: _lookback(s, d).df.select("symbol", "date", F.col("position").cast("long").alias("position"))
    q["timing_peak_exit"] = lambda s, d: _peak(s, d).df.select("symbol", "date", F.col("position").cast("long").alias("position"))
    q["perf_buy_and_hold"] = lambda s, d: _round(R.buy_and_hold(load_bars(s, d)).df)
    q["perf_weighted_benchmark"] = lambda s, d: _round(_benchmark(s, d))
    q["perf_metrics"] = lambda s, d: _metric_cols(R.return_metrics(_scaled_benchmark(s, d)))
    q["perf_equity_curve"] = lambda s, d: _round(R.equity_curve(_scaled_benchmark(s, d)).select("date", F.log("equity").alias("log_equity")))
    q["perf_drawdowns"] = lambda s, d: _round(R.drawdowns(_scaled_benchmark(s, d)).select("date", "drawdown"))
    q["perf_drawdown_details"] = lambda s, d: _round(R.drawdown_details(_scaled_benchmark(s, d)))
    q["perf_annual_returns"] = lambda s, d: _round(R.annual_returns(_scaled_benchmark(s, d)), 5)
    q["perf_periodic_quarter"] = lambda s, d: _round(
        R.periodic_metrics(_scaled_benchmark(s, d), "QE").select(
            "period_start", "first_date", "last_date", "n", "cumulative_return", "annualised_volatility", "sharpe", "max_drawdown", "calmar"
        ), 4
    )
    q["perf_custom_ranges"] = lambda s, d: _round(
        R.range_metrics(
            _scaled_benchmark(s, d),
            s.sql("SELECT 'early' AS period, DATE '1995-06-01' AS start, DATE '1996-12-31' AS end UNION ALL SELECT 'late', DATE '1999-01-01', DATE '2001-06-30'"),
        ).select("period", "n", "cumulative_return", "annualised_volatility", "max_drawdown"), 4
    )
    q["perf_information_ratio"] = lambda s, d: _round(
        R.information_ratio(_timing_returns(s, d).withColumn("ret", F.col("ret") * 0.001), _scaled_benchmark(s, d), ["symbol"]), 5
    )
    q["perf_strategy_vs_benchmark"] = lambda s, d: _round(
        R.strategy_vs_benchmark(
            _timing_returns(s, d).groupBy("date").agg((F.avg("ret") * 0.001).alias("ret")), _scaled_benchmark(s, d)
        ).select("n", "cumulative_return", "benchmark_cumulative_return", "excess_cumulative_return"), 5
    )
    q["perf_equity_curves"] = lambda s, d: _round(
        R.equity_curves(_timing_returns(s, d).groupBy("date").agg((F.avg("ret") * 0.001).alias("ret")), _scaled_benchmark(s, d)), 4
    )
    q["join_as_of"] = lambda s, d: joins.as_of(load_bars(s, d), ["close"], ship_dates(s, d))
    q["join_next_bar"] = lambda s, d: joins.next_bar(load_bars(s, d).df.select("symbol", "date"), ship_dates(s, d))
    return q


def oracle_sql() -> dict[str, str]:
    o = {}
    o["select_rebalance_calendar"] = sql("SELECT CAST(period AS BIGINT) AS period, date, execution_date FROM reb")
    o["select_eligible"] = sql("SELECT symbol, date, listing AS listing_date, eligible FROM ft")
    o["select_candidates"] = sql(f"SELECT symbol, date, execution_date, {r('score')} AS score FROM cand")
    o["select_rank_filters"] = sql(f"SELECT symbol, date, {r('score')} AS score FROM k2 WHERE pct_k2 > 0.2 AND pct_k2 <= 1.0", FILTERED)
    o["select_threshold_filter"] = sql(f"SELECT symbol, date, {r('score')} AS score FROM cand WHERE vr >= 0.5 AND vol < 2.0")
    o["select_min_momentum"] = sql(f"SELECT symbol, date, {r('score')} AS score FROM cand WHERE score >= 0.1")
    o["select_exclude_clusters"] = sql("SELECT symbol, date, CAST(cluster AS BIGINT) AS cluster FROM cand WHERE cluster NOT IN (0, 2)")
    o["select_top_with_cluster_cap"] = sql(
        f"SELECT symbol, date, rk AS rank, {r('score')} AS score FROM sel", FILTERED, _pick(3)
    )
    for m in _RAW:
        o[f"allocate_{m}"] = sql(f"SELECT symbol, date, {r('w')} AS weight FROM wt", *_wsql(m, 4))
    o["allocate_exposure_caps"] = sql(
        f"SELECT symbol, date, {r('x * CASE WHEN g > 0.9 THEN 0.9 / g ELSE 1.0 END')} AS weight FROM (SELECT *, sum(abs(x)) OVER (PARTITION BY date) AS g"
        " FROM (SELECT *, least(greatest(w, 0.1), 0.4) AS x FROM wt))",
        *_wsql("inverse_factor", 4),
    )
    o["select_set_changes"] = sql(
        "SELECT CAST(coalesce(a.period, b.period + 1) AS BIGINT) AS period, coalesce(a.symbol, b.symbol) AS symbol,"
        " CASE WHEN a.symbol IS NOT NULL AND b.symbol IS NOT NULL THEN 'kept' WHEN a.symbol IS NOT NULL THEN 'bought' ELSE 'sold' END AS change"
        " FROM wt a FULL JOIN wt b ON a.symbol = b.symbol AND a.period = b.period + 1"
        " WHERE coalesce(a.period, b.period + 1) <= (SELECT max(period) FROM wt)",
        *_wsql(),
    )
    o["select_dynamic_ranking"] = sql(
        "SELECT reb.date, coalesce(best.factor_name, 'mom') AS ranking_factor FROM reb LEFT JOIN best USING (date)",
        "fx AS MATERIALIZED (SELECT a.symbol, a.date, a.mom, a.vol, a.er, b.close / a.close - 1 AS fwd FROM ft a JOIN cal ca ON ca.date = a.date"
        f" LEFT JOIN (ft JOIN cal USING (date)) b ON b.symbol = a.symbol AND b.t = ca.t + {INTERVAL})",
        "fl AS MATERIALIZED (SELECT symbol, date, fwd, 'mom' AS factor_name, mom AS factor FROM fx UNION ALL SELECT symbol, date, fwd, 'vol', vol FROM fx"
        " UNION ALL SELECT symbol, date, fwd, 'er', er FROM fx)",
        ic_sql("fl", "factor_name, date", "ic"),
        "ir AS (SELECT factor_name, date, CASE WHEN count(ic) OVER w >= 60 AND stddev_samp(ic) OVER w > 0 THEN avg(ic) OVER w / stddev_samp(ic) OVER w END AS icir"
        " FROM ic WINDOW w AS (PARTITION BY factor_name ORDER BY date ROWS 119 PRECEDING))",
        f"lg AS (SELECT factor_name, date, lag(icir, {INTERVAL}) OVER (PARTITION BY factor_name ORDER BY date) AS m FROM ir)",
        "kn AS (SELECT factor_name, date, last_value(m IGNORE NULLS) OVER (PARTITION BY factor_name ORDER BY date ROWS UNBOUNDED PRECEDING) AS m FROM lg)",
        "best AS (SELECT date, arg_max(factor_name, m) AS factor_name FROM kn WHERE m IS NOT NULL GROUP BY date)",
    )
    o["select_monthly_pool"] = sql(
        "SELECT strftime(d, '%Y-%m') AS month, d AS month_end_date, n AS eligible_symbol_count, k AS covered_cluster_count, u AS unassigned_cluster_symbol_count,"
        " n >= 12 AS is_pool_stable, coalesce(d = min(CASE WHEN n >= 12 THEN d END) OVER (), FALSE) AS is_stable_start FROM"
        " (SELECT me.d, count(ft.symbol) AS n, count(DISTINCT CASE WHEN cluster >= 0 THEN cluster END) AS k, count(CASE WHEN cluster < 0 THEN 1 END) AS u"
        " FROM (SELECT max(date) AS d FROM cal GROUP BY date_trunc('month', date)) me LEFT JOIN ft ON ft.date = me.d AND ft.eligible GROUP BY me.d)"
    )
    last = "ls AS (SELECT symbol, max(date) AS last_date, max(CAST(eligible AS INT)) AS ever FROM ft GROUP BY symbol)"
    recent = "rc AS (SELECT last_date AS recent_complete_date FROM (SELECT last_date, count(*) AS n FROM ls GROUP BY last_date) ORDER BY n DESC, last_date DESC LIMIT 1)"
    o["select_recent_complete_date"] = sql("SELECT recent_complete_date FROM rc", last, recent)
    o["select_exclusion_reasons"] = sql(
        "SELECT symbol, last_date, CASE WHEN last_date < recent_complete_date THEN 'stale_before_recent_complete_date' WHEN ever = 0 THEN 'never_eligible_in_window' END AS reason FROM ls CROSS JOIN rc",
        last,
        recent,
    )
    pct = lambda x: (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY date) END"
    )
    o["rank_composite_pct"] = sql(f"SELECT symbol, date, {r('(a - 0.5 * b) / 1.5')} AS score FROM (SELECT symbol, date, {pct('mom')} AS a, {pct('vol')} AS b FROM ft)")
    mm = lambda x: (
        f"CASE WHEN count({x}) OVER d >= 2 AND {x} IS NOT NULL THEN CASE WHEN max({x}) OVER d = min({x}) OVER d THEN 0.5 ELSE ({x} - min({x}) OVER d) / (max({x}) OVER d - min({x}) OVER d) END END"
    )
    o["rank_composite_minmax"] = sql(f"SELECT symbol, date, {r('(a + 2.0 * b) / 3.0')} AS score FROM (SELECT symbol, date, {mm('mom')} AS a, {mm('er')} AS b FROM ft WINDOW d AS (PARTITION BY date))")
    bottom = lambda x: (
        f"(rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) + (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count(*) OVER (PARTITION BY date)"
    )
    o["signal_rotation"] = sql(
        f"SELECT symbol, date, {r('sc')} AS score, {r('sc / sum(sc) OVER (PARTITION BY date)')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY sc DESC, symbol) AS n FROM"
        " (SELECT symbol, date, vr, (CASE WHEN na >= 2 THEN a ELSE 0 END + CASE WHEN nb >= 2 THEN 0.5 * b ELSE 0 END) / nullif(CASE WHEN na >= 2 THEN 1.0 ELSE 0 END + CASE WHEN nb >= 2 THEN 0.5 ELSE 0 END, 0) AS sc FROM"
        f" (SELECT symbol, date, vr, {bottom('mom')} AS a, {bottom('er')} AS b, count(mom) OVER (PARTITION BY date) AS na, count(er) OVER (PARTITION BY date) AS nb FROM ft))"
        " WHERE sc IS NOT NULL AND vr > 0.8 AND sc >= 0.2) WHERE n <= 3"
    )
    o["signal_momentum"] = sql(
        f"SELECT symbol, date, {r('mom')} AS score, {r('1.0 / count(*) OVER (PARTITION BY date)')} AS weight FROM"
        " (SELECT *, row_number() OVER (PARTITION BY date ORDER BY mom DESC, symbol) AS n FROM ft WHERE mom >= 0.05) WHERE n <= 4"
    )
    rot = (*_wsql(), *_rotation_ctes())
    o["rotation_holdings"] = sql(f"SELECT CAST(period AS BIGINT) AS period, symbol, date, {r('close / eo')} AS ratio FROM hd", *rot)
    o["rotation_cost_scales"] = sql(
        f"SELECT CAST(period AS BIGINT) AS period, {r('1 - scale', 5)} AS cost_share, {r('gross - 1', 5)} AS period_return FROM sc", *rot
    )
    o["rotation_equity"] = sql(f"SELECT date, {r('le', 5)} AS log_equity FROM eq", *rot)
    o["rotation_log"] = sql(
        f"SELECT CAST(r.period AS BIGINT) AS period, r.date AS signal_date, r.execution_date, coalesce(n, 0) AS n_targets,"
        f" {r('CASE WHEN r.period > 0 THEN coalesce(tv, 0) END', 5)} AS turnover FROM reb r"
        " LEFT JOIN (SELECT period, count(*) AS n FROM wt GROUP BY period) c USING (period) LEFT JOIN (SELECT coalesce(a.period, b.period + 1) AS period,"
        " sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS tv FROM wt a FULL JOIN wt b ON a.symbol = b.symbol AND a.period = b.period + 1 GROUP BY 1) t USING (period)",
        *_wsql(),
    )
    o["select_conditions"] = sql(f"SELECT symbol, date, {r('score')} AS score, CAST(CASE WHEN NOT coalesce(vr >= 0.5, FALSE) THEN 0 WHEN NOT coalesce(mom > vol * 0.1, FALSE) THEN 1 WHEN NOT coalesce(mom > bm, FALSE) THEN 2 END AS BIGINT) AS failed_at FROM cb", *GRID_SQL[:1])
    sides = (0.0, *TRIMS)
    o["select_rank_filter_grid"] = sql(
        " UNION ALL ".join(f"SELECT 'rank_vol_trim_b{lo}_a{hi}' AS variant, count(*) AS n FROM k1 WHERE pct_k1 > {lo} AND pct_k1 <= {1 - hi}" for lo in sides for hi in sides if lo + hi > 0),
        _pct("vol", "cand", "k1"),
    )
    o["rotation_grid_weights"] = sql(f"SELECT v AS variant, CAST(period AS BIGINT) AS period, symbol, {r('w')} AS weight FROM gw", *GRID_SQL)
    o["rotation_grid_ranges"] = sql(
        f"SELECT split_part(v, '/', 1) AS \"group\", v AS variant, period, count(*) AS n, {r('sum(ln(1 + ret))', 4)} AS log_growth, {r('stddev_samp(ret) * sqrt(252)', 4)} AS annualised_volatility,"
        f" {r('abs(min(dd))', 4)} AS max_drawdown FROM gd GROUP BY v, period",
        *GRID_SQL, *GRID_EQUITY_SQL,
    )
    cells = lambda x: f"string_agg(symbol || ':' || CAST(round({x} * 1e4) AS BIGINT), ',' ORDER BY symbol)"
    o["rotation_log_full"] = sql(
        "SELECT CAST(r.period AS BIGINT) AS period, r.date AS signal_date, r.execution_date, coalesce(n, 0) AS candidate_count, coalesce(n3, 0) AS filtered_candidate_count,"
        " n1 || ',' || n2 || ',' || n3 AS counts_after, CASE WHEN n IS NOT NULL THEN 'vr>=0.5,calmer_than_its_return,stronger_than_benchmark' END AS active_candidate_filters, names AS selected_symbols,"
        f" cells AS current_weights, tw AS target_weights, tw AS executed_weights, {r('CASE WHEN r.period > 0 THEN coalesce(tv, 0) END', 4)} AS turnover, {r('g - 1', 4)} AS period_return FROM reb r"
        " LEFT JOIN (SELECT date, count(*) AS n, sum(CAST(f1 AS INT)) AS n1, sum(CAST(f1 AND f2 AS INT)) AS n2, sum(CAST(f1 AND f2 AND f3 AS INT)) AS n3 FROM (SELECT date, coalesce(vr >= 0.5, FALSE) AS f1,"
        " coalesce(mom > vol * 0.1, FALSE) AS f2, coalesce(mom > bm, FALSE) AS f3 FROM cb) GROUP BY date) c USING (date)"
        f" LEFT JOIN (SELECT period, string_agg(symbol, ',' ORDER BY symbol) AS names, {cells('w')} AS tw FROM g4 GROUP BY period) t USING (period)"
        f" LEFT JOIN (SELECT date, {cells('x')} AS cells FROM (SELECT h.date, h.symbol, h.v / sum(h.v) OVER (PARTITION BY h.date) AS x FROM (SELECT date, symbol, w * close / eo AS v FROM gh WHERE v = 'strong/top4' AND (e IS NULL OR date < e)) h SEMI JOIN reb USING (date)) GROUP BY date) k USING (date)"
        " LEFT JOIN (SELECT coalesce(a.period, b.period + 1) AS period, sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS tv FROM g4 a FULL JOIN g4 b ON a.symbol = b.symbol AND a.period = b.period + 1 GROUP BY 1) u USING (period)"
        " LEFT JOIN (SELECT period, g FROM gp WHERE v = 'strong/top4') z USING (period)",
        *GRID_SQL, "g4 AS MATERIALIZED (SELECT * FROM gw WHERE v = 'strong/top4')", *GRID_EQUITY_SQL,
    )
    stops = (*_wsql(), *STOP_SQL)
    o["rotation_stop_triggers"] = sql(f"SELECT symbol, CAST(spell AS BIGINT) AS spell, date AS trigger_date, {r('ratio')} AS ratio FROM ff", *stops)
    o["rotation_stop_fills"] = sql(
        f"SELECT ff.symbol, CAST(spell AS BIGINT) AS spell, cal.nxt AS execution_date, {r('ratio', 4)} AS ratio, {r('(b.open / ep - 1) * 100', 4)} AS pnl_pct"
        " FROM ff JOIN cal ON cal.date = ff.date JOIN bars b ON b.symbol = ff.symbol AND b.date = cal.nxt",
        *stops,
    )
    o["rotation_grid_summary"] = sql(
        f"SELECT 'base' AS variant, count(ret) AS n, {r('sum(ln(1 + ret))', 5)} AS log_growth, {r('stddev_samp(ret) * sqrt(252)', 5)} AS annualised_volatility,"
        f" any_value({r('(SELECT avg(CASE WHEN gross > 1 THEN 1.0 ELSE 0.0 END) FROM sc WHERE gross IS NOT NULL)', 5)}) AS rebalance_win_rate,"
        f" any_value({r('(SELECT avg(tv) FROM tvs)', 5)}) AS avg_turnover, any_value((SELECT count(*) FROM reb)) AS rebalance_count"
        " FROM (SELECT exp(le - lag(le) OVER (ORDER BY date)) - 1 AS ret FROM eq) WHERE ret IS NOT NULL",
        *rot,
        "tvs AS (SELECT r.period, coalesce(tv, 0) AS tv FROM reb r LEFT JOIN (SELECT coalesce(a.period, b.period + 1) AS period,"
        " sum(abs(coalesce(a.w, 0) - coalesce(b.w, 0))) / 2 AS tv FROM wt a FULL JOIN wt b ON a.symbol = b.symbol AND a.period = b.period + 1 GROUP BY 1) t USING (period) WHERE r.period > 0)",
    )
    o["timing_positions"] = timing_sql("SELECT symbol, date, CAST(position AS BIGINT) AS position FROM pm")
    o["timing_returns"] = timing_sql(f"SELECT symbol, date, {r('ret')} AS ret FROM sr")
    o["timing_metrics"] = timing_sql(f"SELECT symbol, {METRIC_SQL} FROM (SELECT symbol, ret * 0.1 AS ret FROM sr) GROUP BY symbol")
    trades = (
        "td AS (SELECT *, position - coalesce(lp, 0) AS d FROM pm)",
        "tr2 AS (SELECT symbol, date, close, d, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS ed, lag(close) OVER (PARTITION BY symbol ORDER BY date) AS ec FROM td WHERE d <> 0)",
        "tt AS MATERIALIZED (SELECT symbol, ed AS entry_date, date AS exit_date, close / ec - 1 AS pnl FROM tr2 WHERE d = -1)",
    )
    o["timing_trades"] = timing_sql(f"SELECT symbol, entry_date, exit_date, {r('pnl')} AS pnl FROM tt", *trades)
    o["timing_trade_counts"] = timing_sql(
        "SELECT symbol, count(*) AS trades_total, count(CASE WHEN pnl > 0 THEN 1 END) AS trades_won, count(CASE WHEN pnl <= 0 THEN 1 END) AS trades_lost,"
        f" {r('count(CASE WHEN pnl > 0 THEN 1 END) * 1.0 / count(*)')} AS win_rate FROM tt GROUP BY symbol",
        *trades,
    )
    brk = f"WITH RECURSIVE {BARS},\n{S0}" + "".join(",\n" + x for x in BREAKOUT_SQL)
    o["timing_lookback_exit"] = brk + "\nSELECT symbol, date, CAST(position AS BIGINT) AS position FROM lk"
    o["timing_peak_exit"] = brk + "\nSELECT symbol, date, CAST(position AS BIGINT) AS position FROM pk"
    o["perf_buy_and_hold"] = bars_sql(f"SELECT symbol, date, {r('ret')} AS ret FROM s0 WHERE ret IS NOT NULL")
    o["perf_weighted_benchmark"] = bars_sql(f"SELECT date, {r('ret')} AS ret FROM bm", *BENCH)
    o["perf_metrics"] = bars_sql(f"SELECT {METRIC_SQL} FROM b1", *SCALED)
    o["perf_equity_curve"] = bars_sql(f"SELECT date, {r('ln(eq)')} AS log_equity FROM bq", *SCALED)
    o["perf_drawdowns"] = bars_sql(f"SELECT date, {r('dd')} AS drawdown FROM bd", *SCALED)
    o["perf_drawdown_details"] = bars_sql(
        f"SELECT {r('-dd')} AS max_drawdown, date AS trough_date, (SELECT q.date FROM bd q WHERE q.date <= t.date ORDER BY q.eq DESC, q.date LIMIT 1) AS peak_date"
        " FROM (SELECT * FROM bd ORDER BY dd, date LIMIT 1) t",
        *SCALED,
    )
    o["perf_annual_returns"] = bars_sql(f"SELECT year(date) AS year, {r('product(1 + ret) - 1', 5)} AS annual_return FROM b1 GROUP BY 1", *SCALED)
    per = (
        "SELECT {keys}, {span} count(*) AS n, {cum} AS cumulative_return, {vol} AS annualised_volatility, {extra}{dd} AS max_drawdown{cal} FROM"
        " (SELECT *, eq / max(eq) OVER (PARTITION BY {part} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM"
        " (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY {part} ORDER BY date ROWS UNBOUNDED PRECEDING)) AS eq FROM {src})) GROUP BY {part} HAVING count(*) >= 2"
    )
    ann = "(pow(product(1 + ret), 252.0 / count(*)) - 1)"
    vol = "(stddev_samp(ret) * sqrt(252))"
    o["perf_periodic_quarter"] = bars_sql(
        per.format(
            keys="period_start", part="period_start", span="min(date) AS first_date, max(date) AS last_date,",
            cum=r("product(1 + ret) - 1", 4), vol=r(vol, 4), dd=r("abs(min(dd))", 4),
            extra=f"{r(f'CASE WHEN {vol} > 0 THEN {ann} / {vol} END', 4)} AS sharpe, ",
            cal=f", {r(f'CASE WHEN abs(min(dd)) > 0 THEN {ann} / abs(min(dd)) END', 4)} AS calmar",
            src="(SELECT *, CAST(date_trunc('quarter', date) AS DATE) AS period_start FROM b1)",
        ),
        *SCALED,
    )
    o["perf_custom_ranges"] = bars_sql(
        per.format(
            keys="period", part="period", span="", cum=r("product(1 + ret) - 1", 4), vol=r(vol, 4), dd=r("abs(min(dd))", 4), extra="", cal="",
            src="(SELECT b1.*, p.period FROM b1 JOIN (VALUES ('early', DATE '1995-06-01', DATE '1996-12-31'), ('late', DATE '1999-01-01', DATE '2001-06-30')) p(period, a, z) ON date BETWEEN a AND z)",
        ),
        *SCALED,
    )
    o["perf_information_ratio"] = timing_sql(
        f"SELECT symbol, {r('CASE WHEN count(*) >= 2 AND stddev_samp(x) > 0 THEN (pow(product(1 + x), 252.0 / count(*)) - 1) / (stddev_samp(x) * sqrt(252)) END', 5)} AS information_ratio"
        " FROM (SELECT sr.symbol, sr.ret * 0.001 - b1.ret AS x FROM sr JOIN b1 USING (date)) GROUP BY symbol",
        *SCALED,
    )
    avgs = (*SCALED, "ar AS MATERIALIZED (SELECT date, avg(ret) * 0.001 AS ret FROM sr GROUP BY date)",
            "cb AS MATERIALIZED (SELECT * FROM b1 WHERE date >= (SELECT min(date) FROM ar) AND date <= (SELECT max(date) FROM ar))")
    o["perf_strategy_vs_benchmark"] = timing_sql(
        f"SELECT (SELECT count(*) FROM ar) AS n, {r('a', 5)} AS cumulative_return, {r('b', 5)} AS benchmark_cumulative_return, {r('(a + 1) / (b + 1) - 1', 5)} AS excess_cumulative_return"
        " FROM (SELECT (SELECT product(1 + ret) - 1 FROM ar) AS a, (SELECT product(1 + ret) - 1 FROM cb) AS b)",
        *avgs,
    )
    o["perf_equity_curves"] = timing_sql(
        f"SELECT coalesce(x.date, y.date) AS date, {r('x.e', 4)} AS strategy, {r('y.e', 4)} AS benchmark FROM"
        " (SELECT date, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM ar) x FULL JOIN"
        " (SELECT date, product(1 + ret) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS e FROM cb) y ON x.date = y.date",
        *avgs,
    )
    o["join_as_of"] = sql(
        "SELECT f.symbol, cal.date, b.close FROM (SELECT symbol, min(date) AS f FROM bars GROUP BY symbol) f JOIN cal ON cal.date >= f.f"
        " ASOF JOIN bars b ON b.symbol = f.symbol AND b.date <= cal.date"
    )
    o["join_next_bar"] = sql("SELECT symbol, date, nxt AS execution_date FROM bars JOIN cal USING (date)")
    return o
