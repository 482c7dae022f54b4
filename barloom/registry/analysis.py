"""Factor evaluation queries: panel, quality, information coefficient, groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.factor import with_factors
from ..functions.library import make, param_grid
from ..functions.scalar import c, rounded
from ..operators import grouping, panel as P, predictive, quality
from ..operators.crosscorr import pair_correlations
from ..plans.trend_scan import cross_section_ic, summarize, symbol_rows, with_cross_section
from ..sources.demo import load_bars, ship_dates
from .flagship import rank_ic_weekly
from .sqlbase import BARS, S0, r

PERIODS = (1, 5, 10)
FACTOR = ("PriceReturn", {"window": 20})


def _panel(spark, sf, min_bars=252):
    return P.build_panel(load_bars(spark, sf), make(FACTOR[0], **FACTOR[1]), min_bars)


def _with_fwd(spark, sf, p=5):
    return P.forward_returns(_panel(spark, sf), [p], ship_dates(spark, sf), column="fwd")


def _with_periods(spark, sf):
    return P.forward_returns(_panel(spark, sf), PERIODS, ship_dates(spark, sf))


def _round(df, digits=6, skip=()):
    out = []
    for f in df.schema.fields:
        if f.dataType.typeName() == "double" and f.name not in skip:
            out.append(rounded(c(f.name), digits).alias(f.name))
        elif f.dataType.typeName() in ("integer", "long", "short"):
            out.append(c(f.name).cast("long").alias(f.name))
        else:
            out.append(c(f.name))
    return df.select(*out)


PANEL = """panel0 AS (SELECT symbol, date, close, open, volume AS vol, CASE WHEN value > 0 THEN value END AS volume,
    (close - lag(close, 20) OVER (PARTITION BY symbol ORDER BY date))
      / lag(close, 20) OVER (PARTITION BY symbol ORDER BY date) AS factor FROM bars),
panel AS MATERIALIZED (SELECT * FROM (SELECT *, count(factor) OVER (PARTITION BY symbol) AS bar_count FROM panel0)
    WHERE bar_count >= 252),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM bars)),
pt AS (SELECT panel.*, cal.t FROM panel JOIN cal USING (date))"""


def _fwd(p: int, name: str = "fp") -> str:
    return (
        f"{name} AS MATERIALIZED (SELECT a.*, b.close / a.close - 1 AS fwd, {p} AS period FROM pt a"
        f" LEFT JOIN pt b ON a.symbol = b.symbol AND b.t = a.t + {p})"
    )


def rank_sql(x: str, keys: str, order: str = "") -> str:
    return (
        f"(rank() OVER (PARTITION BY {keys} ORDER BY {x} {order})"
        f" + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2.0)"
    )


CORR = "CASE WHEN stddev_samp({x}) * stddev_samp({y}) > 0 THEN corr({x}, {y}) END"


def ic_sql(src: str, keys: str, name: str, method: str = "spearman", x="factor", y="fwd") -> str:
    if method == "spearman":
        inner = f"SELECT *, {rank_sql(x, keys)} AS rx, {rank_sql(y, keys)} AS ry"
        corr = CORR.format(x="rx", y="ry")
    else:
        inner = f"SELECT *, {x} AS rx, {y} AS ry"
        corr = CORR.format(x="rx", y="ry")
    return (
        f"{name} AS MATERIALIZED (SELECT {', '.join('k.' + k.strip() for k in keys.split(','))}, coalesce(n, 0) AS n,"
        f" CASE WHEN n >= 5 THEN r END AS ic FROM (SELECT DISTINCT {keys} FROM {src}) k LEFT JOIN"
        f" (SELECT {keys}, count(*) AS n, {corr} AS r FROM ({inner} FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"
        f" GROUP BY {keys}) USING ({keys}))"
    )


TOP = (
    "tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY factor DESC, symbol) AS p,"
    " count(*) OVER (PARTITION BY {keys}) AS nn FROM {src} WHERE factor IS NOT NULL AND fwd IS NOT NULL)"
    " WHERE p <= least(greatest(ceil(nn * {pct}), 5), nn))"
)

SUMMARY = (
    "CASE WHEN count(ic) >= 2 THEN avg(ic) END AS mean, stddev_samp(ic) AS std,"
    " CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) END AS ir,"
    " CASE WHEN stddev_samp(ic) > 0 THEN avg(ic) / stddev_samp(ic) * sqrt(count(ic)) END AS t_stat,"
    " CASE WHEN count(ic) >= 2 THEN sum(CASE WHEN round(ic, 12) > 0 THEN 1.0 ELSE 0.0 END) / count(ic) END AS pos_ratio,"
    " count(ic) AS n_days"
)


def rounds(*names: str) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


def panel_sql(body: str, *ctes: str) -> str:
    return f"WITH {BARS},\n{PANEL}" + "".join(",\n" + x for x in ctes) + "\n" + body


LONG = (
    _fwd(1, "f1"),
    _fwd(5, "f5"),
    _fwd(10, "f10"),
    "fl AS MATERIALIZED (SELECT * FROM f1 UNION ALL SELECT * FROM f5 UNION ALL SELECT * FROM f10)",
)

# Right-closed quantile bucket from interpolated edges.
def groups_sql(src: str, n: int, keys: str = "date") -> str:
    probs = "[" + ", ".join(str(i / n) for i in range(n + 1)) + "]"
    return (
        f"ed AS (SELECT {keys}, list_sort(list_distinct(quantile_cont(factor, {probs}))) AS e, count(factor) AS nn"
        f" FROM {src} GROUP BY {keys}),\n"
        f"gr AS MATERIALIZED (SELECT {src}.*, CASE WHEN factor IS NOT NULL AND nn >= {n} AND len(e) > 1"
        f" THEN greatest(len(list_filter(e, lambda x: x < factor)), 1) END AS grp FROM {src} JOIN ed USING ({keys})),\n"
        f"qr AS MATERIALIZED (SELECT date, grp, avg(fwd) AS ret FROM gr WHERE grp IS NOT NULL GROUP BY date, grp)"
    )


def _grid(spark, sf):
    variants = param_grid("PriceReturn", {"window": [10, 20, 40]})
    return predictive.parameter_grid_ic(load_bars(spark, sf), variants, (1, 5), 252, ship_dates(spark, sf))


def _grid_sql(body: str) -> str:
    ctes, unions = [], []
    for n in (10, 20, 40):
        ctes.append(
            f"g{n} AS (SELECT * FROM (SELECT *, count(factor) OVER (PARTITION BY symbol) AS bc FROM (SELECT symbol, date, close,"
            f" (close - lag(close, {n}) OVER w) / lag(close, {n}) OVER w AS factor, 'window={n}' AS param_label FROM bars"
            f" WINDOW w AS (PARTITION BY symbol ORDER BY date))) WHERE bc >= 252)"
        )
        unions.append(f"SELECT * FROM g{n}")
    ctes.append("ga AS (SELECT ga0.*, t FROM (" + " UNION ALL ".join(unions) + ") ga0 JOIN cal USING (date))")
    ctes.append(
        "bt AS (SELECT bars.symbol, cal.t, bars.close FROM bars JOIN cal USING (date))"
    )
    ctes.append(
        "gf AS MATERIALIZED (SELECT a.symbol, a.date, a.param_label, a.factor, p.period, b.close / a.close - 1 AS fwd FROM ga a"
        " CROSS JOIN (VALUES (1), (5)) p(period) LEFT JOIN bt b ON a.symbol = b.symbol AND b.t = a.t + p.period)"
    )
    ctes.append(ic_sql("gf", "param_label, period, date", "gic"))
    ctes.append(
        f"rec AS MATERIALIZED (SELECT param_label, CAST(period AS BIGINT) AS period, avg(ic) AS ic_mean FROM gic GROUP BY ALL)"
    )
    return panel_sql(body, *ctes)


CORR_FACTORS = ("PriceReturn", "Volatility", "VolumeRatio", "KaufmanER")


def _corr_pairs(spark, sf, pairs_only=None):
    bars = load_bars(spark, sf)
    fs = [make("PriceReturn", window=20), make("Volatility"), make("VolumeRatio"), make("KaufmanER")]
    return pair_correlations(
        with_factors(bars, fs), [f.name for f in fs], 5, 5, dates=ship_dates(spark, sf), only=pairs_only
    )


def _corr_sql(body: str) -> str:
    names = {"PriceReturn_20": "f1", "Volatility_20": "f2", "VolumeRatio_5": "f3", "KaufmanER_20": "f4"}
    ctes = [
        S0,
        """cf0 AS (SELECT symbol, date, (close - lag(close, 20) OVER w) / lag(close, 20) OVER w AS f1,
             CASE WHEN count(ret) OVER w20 = 20 THEN stddev_samp(ret) OVER w20 END AS f2,
             CASE WHEN count(volume) OVER w5 = 5 THEN volume / avg(volume) OVER w5 END AS f3,
             abs(close - lag(close, 20) OVER w) AS net, abs(close - pc) AS mv
           FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY date),
             w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING), w5 AS (PARTITION BY symbol ORDER BY date ROWS 4 PRECEDING))""",
        """cf AS (SELECT *, CASE WHEN count(mv) OVER w20 = 20 THEN least(net / nullif(sum(mv) OVER w20, 0), 1.0) END AS f4
           FROM cf0 WINDOW w20 AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))""",
        "sampled AS (SELECT cf.* FROM cf JOIN cal USING (date) WHERE t % 5 = 0)",
    ]
    parts, keys = [], list(names)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            parts.append(
                f"SELECT '{a}' AS a, '{b}' AS b, date, {names[a]} AS x, {names[b]} AS y FROM sampled"
                f" WHERE {names[a]} IS NOT NULL AND {names[b]} IS NOT NULL"
            )
    ctes.append("pr AS (" + " UNION ALL ".join(parts) + ")")
    ctes.append(
        f"rk AS (SELECT *, {rank_sql('x', 'a, b, date')} AS rx, {rank_sql('y', 'a, b, date')} AS ry FROM pr)"
    )
    ctes.append(
        f"dc AS (SELECT a, b, date, {CORR.format(x='rx', y='ry')} AS rho FROM rk GROUP BY a, b, date HAVING count(*) >= 5)"
    )
    ctes.append(
        "pc AS MATERIALIZED (SELECT a, b, avg(rho) AS mean_corr, CASE WHEN count(rho) > 1 THEN stddev_pop(rho) END AS std_corr,"
        " count(rho) AS n_dates FROM dc GROUP BY a, b)"
    )
    return panel_sql(body, *ctes)


SCAN = ((60, 120), (5, 20))


def _scan(spark, sf):
    return symbol_rows(load_bars(spark, sf), *SCAN, min_valid_samples=100)


def _summary_with_ic(spark, sf):
    rows, eligible = _scan(spark, sf)
    return with_cross_section(summarize(rows), cross_section_ic(eligible, 3))


def _scan_sql(body: str) -> str:
    parts = []
    for n in SCAN[0]:
        for h in SCAN[1]:
            parts.append(
                f"SELECT symbol, date, {n} AS formation_window, {h} AS holding_window, r2_{n} AS r2,"
                f" (lead(close, {h}) OVER w - close) / nullif(close, 0) * 100.0 AS fwd FROM sc WINDOW w AS (PARTITION BY symbol ORDER BY date)"
            )
    cols = ", ".join(
        f"CASE WHEN count(close) OVER w{n} = {n} AND max(close) OVER w{n} > min(close) OVER w{n} THEN regr_r2(close, rn) OVER w{n} END AS r2_{n}"
        for n in SCAN[0]
    )
    wins = ", ".join(f"w{n} AS (PARTITION BY symbol ORDER BY date ROWS {n - 1} PRECEDING)" for n in SCAN[0])
    ctes = [
        S0,
        f"sc AS (SELECT symbol, date, close, {cols} FROM s0 WINDOW {wins})",
        "sl AS MATERIALIZED (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE r2 IS NOT NULL AND fwd IS NOT NULL)",
        """sr0 AS (SELECT *, row_number() OVER (PARTITION BY symbol, formation_window, holding_window ORDER BY r2 DESC, date) AS p,
             count(*) OVER (PARTITION BY symbol, formation_window, holding_window) AS n,
             quantile_cont(r2, 0.5) OVER (PARTITION BY symbol, formation_window, holding_window) AS md FROM sl)""",
        """sr AS MATERIALIZED (SELECT symbol, formation_window, holding_window, count(*) AS valid_pair_count, count(*) >= 100 AS eligible,
             CASE WHEN count(*) >= 100 AND stddev_samp(r2) * stddev_samp(fwd) > 0 THEN corr(r2, fwd) END AS symbol_corr,
             CASE WHEN count(*) >= 100 THEN avg(CASE WHEN p <= greatest(1, ceil(n * 0.2)) THEN fwd END) END AS top_buy_return_pct,
             CASE WHEN count(*) >= 100 THEN avg(CASE WHEN (r2 > md AND fwd > 0) OR (r2 < md AND fwd < 0) THEN 1.0 ELSE 0.0 END) END AS hit_rate
           FROM sr0 GROUP BY symbol, formation_window, holding_window)""",
    ]
    return panel_sql(body, *ctes)


WEEKLY = """WITH trades AS (
  SELECT p_brand AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date, l_extendedprice / l_quantity AS price,
         (l_orderkey, l_linenumber, l_extendedprice, l_quantity) AS k, CAST(l_shipdate AS DATE) AS day
  FROM lineitem JOIN part ON l_partkey = p_partkey),
wk AS MATERIALIZED (SELECT symbol, date, arg_max(price, k) AS close FROM trades GROUP BY symbol, date),
cal AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t FROM (SELECT DISTINCT date FROM wk)),
pt AS MATERIALIZED (SELECT symbol, date, t, close, (close - lag(close, 20) OVER w) / lag(close, 20) OVER w AS factor
  FROM wk JOIN cal USING (date) WINDOW w AS (PARTITION BY symbol ORDER BY date)),
fp AS MATERIALIZED (SELECT a.*, b.close / a.close - 1 AS fwd FROM pt a LEFT JOIN pt b ON a.symbol = b.symbol AND b.t = a.t + 5),
"""


def queries() -> dict:
    q = {}
    q["flagship_rank_ic_weekly"] = rank_ic_weekly
    q["panel_build"] = lambda s, d: _round(_panel(s, d).df.select("symbol", "date", "factor", "volume", "bar_count"))
    q["panel_symbol_meta"] = lambda s, d: _round(P.symbol_meta(_panel(s, d)))
    q["panel_summary"] = lambda s, d: _round(P.panel_summary(_panel(s, d)))
    q["panel_date_slice"] = lambda s, d: _round(
        P.build_panel(load_bars(s, d), make(FACTOR[0], **FACTOR[1]), 252, "1997-01-01", "1998-12-31").df.select(
            "symbol", "date", "factor", "volume", "bar_count"
        )
    )
    q["panel_forward_returns"] = lambda s, d: _round(
        _with_periods(s, d).df.select("symbol", "date", *[f"fwd_{p}" for p in PERIODS])
    )
    q["quality_coverage"] = lambda s, d: _round(quality.coverage(_panel(s, d)))
    q["quality_distribution"] = lambda s, d: _round(quality.distribution_stats(_panel(s, d)), 5)
    q["quality_daily_percentiles"] = lambda s, d: _round(quality.daily_percentiles(_panel(s, d)))
    q["quality_percentile_summary"] = lambda s, d: _round(quality.percentile_summary(_panel(s, d)))
    q["quality_missing_by_volume"] = lambda s, d: _round(quality.missing_by_volume(_panel(s, d)))
    q["quality_missing_by_bar_count"] = lambda s, d: _round(quality.missing_by_bar_count(_panel(s, d)))
    q["quality_autocorrelation"] = lambda s, d: _round(quality.rank_autocorrelation(_panel(s, d)))
    q["ic_rank_daily"] = lambda s, d: _round(predictive.daily_ic(_with_fwd(s, d)))
    q["ic_pearson_daily"] = lambda s, d: _round(predictive.daily_ic(_with_fwd(s, d), method="pearson"))
    q["ic_top_daily"] = lambda s, d: _round(predictive.daily_top_ic(_with_fwd(s, d), top_pct=0.5))
    q["ic_summary"] = lambda s, d: _round(predictive.ic_summary(predictive.daily_ic(_with_fwd(s, d))))
    q["ic_top_summary"] = lambda s, d: _round(
        predictive.ic_summary(predictive.daily_top_ic(_with_fwd(s, d), top_pct=0.5))
    )
    q["ic_decay"] = lambda s, d: _round(predictive.ic_decay(_with_periods(s, d), PERIODS))
    q["ic_top_decay"] = lambda s, d: _round(predictive.ic_decay(_with_periods(s, d), PERIODS, 0.5))
    q["ic_rolling"] = lambda s, d: _round(predictive.rolling_ic(predictive.daily_ic(_with_fwd(s, d)), 120))
    q["ic_top_rolling"] = lambda s, d: _round(
        predictive.rolling_ic(predictive.daily_top_ic(_with_fwd(s, d), top_pct=0.5), 120)
    )
    q["ic_icir_series"] = lambda s, d: _round(predictive.icir_series(predictive.daily_ic(_with_fwd(s, d)), 60, 30))
    q["ic_parameter_grid"] = lambda s, d: _round(_grid(s, d))
    q["ic_parameter_matrix"] = lambda s, d: _round(
        predictive.grid_matrix(_grid(s, d), (1, 5)).withColumnsRenamed({"1": "p1", "5": "p5"})
    )
    q["ic_best_params"] = lambda s, d: _round(predictive.best_params(_grid(s, d)))
    q["group_assign"] = lambda s, d: _round(
        grouping.assign_groups(_with_fwd(s, d)).df.select("symbol", "date", F.col("group").alias("grp"))
    )
    q["group_returns"] = lambda s, d: _round(grouping.quantile_returns(_with_fwd(s, d)).withColumnRenamed("group", "grp"))
    q["group_returns_wide"] = lambda s, d: _round(grouping.quantile_wide(grouping.quantile_returns(_with_fwd(s, d))))
    q["group_summary"] = lambda s, d: _round(
        grouping.quantile_summary(grouping.quantile_returns(_with_fwd(s, d))).withColumnRenamed("group", "grp")
    )
    q["group_long_short"] = lambda s, d: _round(grouping.long_short(grouping.quantile_returns(_with_fwd(s, d))))
    q["group_long_short_metrics"] = lambda s, d: _round(
        grouping.long_short_metrics(grouping.quantile_returns(_with_fwd(s, d, 1))).select(
            "n", F.log1p("cumulative_return").alias("log_growth"), "annualised_volatility", "win_rate"
        )
    )
    q["group_cumulative"] = lambda s, d: _round(
        grouping.cumulative_curves(
            grouping.quantile_returns(_with_fwd(s, d, 1)).withColumn("ret", F.col("ret") * 0.01)
        ).select(
            "date", F.col("group").alias("grp"), F.log("cum").alias("log_cum")
        )
    )
    q["group_monotonicity"] = lambda s, d: _round(grouping.monotonicity(grouping.quantile_returns(_with_fwd(s, d))))
    q["group_trend_test"] = lambda s, d: _round(
        grouping.trend_test(grouping.quantile_returns(_with_fwd(s, d)).withColumn("ret", F.round("ret", 7))), 4
    )
    q["corr_factor_pairs"] = lambda s, d: _round(_corr_pairs(s, d))
    q["scan_symbol_rows"] = lambda s, d: _round(_scan(s, d)[0], 5)
    q["scan_summary"] = lambda s, d: _round(summarize(_scan(s, d)[0]), 5)
    q["scan_summary_with_ic"] = lambda s, d: _round(_summary_with_ic(s, d), 5)
    q["scan_cross_section_ic"] = lambda s, d: _round(cross_section_ic(_scan(s, d)[1], 3))
    return q


def oracle_sql() -> dict[str, str]:
    f5, f1 = _fwd(5), _fwd(1)
    o = {}
    o["flagship_rank_ic_weekly"] = (
        WEEKLY + ic_sql("fp", "date", "ic")
        + f" SELECT {rounds('mean', 'std', 'ir', 't_stat', 'pos_ratio')}, n_days FROM (SELECT {SUMMARY} FROM ic)"
    )
    o["panel_build"] = panel_sql(f"SELECT date, symbol, {rounds('factor', 'volume')}, bar_count FROM panel")
    o["panel_symbol_meta"] = panel_sql(
        "SELECT symbol, max(bar_count) AS bar_count, min(CASE WHEN factor IS NOT NULL THEN date END) AS first_valid_date FROM panel GROUP BY symbol"
    )
    o["panel_summary"] = panel_sql(
        "SELECT count(DISTINCT symbol) AS n_symbols, count(DISTINCT date) AS n_dates, min(date) AS start_date, max(date) AS end_date,"
        f" {r('count(factor) * 1.0 / count(DISTINCT date) / count(DISTINCT symbol)')} AS coverage_mean FROM panel"
    )
    o["panel_date_slice"] = panel_sql(
        f"SELECT date, symbol, {rounds('factor', 'volume')}, bar_count FROM panel WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"
    )
    joins = " ".join(
        f"LEFT JOIN pt b{p} ON b{p}.symbol = a.symbol AND b{p}.t = a.t + {p}" for p in PERIODS
    )
    cols = ", ".join(f"{r(f'b{p}.close / a.close - 1')} AS fwd_{p}" for p in PERIODS)
    o["panel_forward_returns"] = panel_sql(f"SELECT a.symbol, a.date, {cols} FROM pt a {joins}")
    o["quality_coverage"] = panel_sql(
        f"SELECT date, {r('count(factor) * 1.0 / (SELECT count(DISTINCT symbol) FROM panel)')} AS coverage FROM panel GROUP BY date"
    )
    pts = ", ".join(f"{r(f'quantile_cont(factor, {p / 100})', 5)} AS {n}" for n, p in quality.DISTRIBUTION_POINTS.items())
    o["quality_distribution"] = panel_sql(
        "SELECT {} FROM (SELECT factor, avg(factor) OVER () AS m FROM panel WHERE factor IS NOT NULL)".format(
            ", ".join(
                [
                    f"{r('avg(factor)', 5)} AS mean",
                    f"{r('stddev_samp(factor)', 5)} AS std",
                    f"{r('avg(pow(factor - m, 3)) / pow(avg(pow(factor - m, 2)), 1.5)', 5)} AS skewness",
                    f"{r('avg(pow(factor - m, 4)) / pow(avg(pow(factor - m, 2)), 2) - 3', 5)} AS kurtosis",
                    f"{r('min(factor)', 5)} AS min",
                    f"{r('max(factor)', 5)} AS max",
                    pts,
                ]
            )
        )
    )
    daily = ", ".join(f"quantile_cont(factor, {p / 100}) AS P{p}" for p in quality.DAILY_POINTS)
    dp = f"dp AS (SELECT date, {daily} FROM panel GROUP BY date)"
    names = [f"P{p}" for p in quality.DAILY_POINTS]
    o["quality_daily_percentiles"] = panel_sql(f"SELECT date, {rounds(*names)} FROM dp", dp)
    o["quality_percentile_summary"] = panel_sql(
        "SELECT " + ", ".join(f"{r(f'avg({n})')} AS {n}_mean" for n in names) + " FROM dp", dp
    )

    def missing(measure: str) -> str:
        return panel_sql(
            f"SELECT grp AS \"group\", {r('1 - sum(nv) * 1.0 / (count(*) * (SELECT count(DISTINCT date) FROM panel))')} AS missing_rate FROM g2 GROUP BY grp",
            f"ps AS (SELECT symbol, {measure} AS m, count(factor) AS nv FROM panel GROUP BY symbol)",
            "ed AS (SELECT list_sort(list_distinct(quantile_cont(m, [0.0, 1/3, 2/3, 1.0]))) AS e FROM ps)",
            "g2 AS (SELECT ps.*, greatest(len(list_filter(e, lambda x: x < m)), 1) AS grp FROM ps CROSS JOIN ed)",
        )

    o["quality_missing_by_volume"] = missing("avg(volume)")
    o["quality_missing_by_bar_count"] = missing("CAST(max(bar_count) AS DOUBLE)")
    lags = " UNION ALL ".join(
        f"SELECT symbol, {k} AS lag, factor, lag(factor, {k}) OVER (PARTITION BY symbol ORDER BY date) AS x0 FROM pv"
        for k in quality.LAGS
    )
    o["quality_autocorrelation"] = panel_sql(
        "SELECT CAST(lag AS BIGINT) AS lag, " + ", ".join(
            [f"{r('avg(rr)')} AS mean_autocorr", f"{r('quantile_cont(rr, 0.5)')} AS median_autocorr", f"{r('stddev_samp(rr)')} AS std_autocorr"]
        ) + " FROM ac GROUP BY lag",
        "pv AS (SELECT symbol, date, factor FROM panel WHERE factor IS NOT NULL)",
        f"lg AS (SELECT * FROM ({lags}) WHERE x0 IS NOT NULL)",
        f"rk AS (SELECT symbol, lag, {rank_sql('factor', 'symbol, lag')} AS r1, {rank_sql('x0', 'symbol, lag')} AS r0 FROM lg)",
        "ac AS (SELECT symbol, lag, corr(r0, r1) AS rr FROM rk GROUP BY symbol, lag HAVING count(*) >= 20)",
    )
    ic = ic_sql("fp", "date", "ic")
    o["ic_rank_daily"] = panel_sql(f"SELECT date, n, {rounds('ic')} FROM ic", f5, ic)
    o["ic_pearson_daily"] = panel_sql(f"SELECT date, n, {rounds('ic')} FROM ic", f5, ic_sql("fp", "date", "ic", "pearson"))
    top = (
        TOP.format(keys="date", src="fp", pct=0.5),
        ic_sql("tops", "date", "ti"),
        "nall AS (SELECT date, count(CASE WHEN factor IS NOT NULL AND fwd IS NOT NULL THEN 1 END) AS n FROM fp GROUP BY date)",
        "tic AS MATERIALIZED (SELECT nall.date, nall.n, ti.ic FROM nall LEFT JOIN ti USING (date))",
    )
    o["ic_top_daily"] = panel_sql(f"SELECT date, n, {rounds('ic')} FROM tic", f5, *top)
    summary = f"SELECT {rounds('mean', 'std', 'ir', 't_stat', 'pos_ratio')}, n_days FROM (SELECT {SUMMARY} FROM {{src}})"
    o["ic_summary"] = panel_sql(summary.format(src="ic"), f5, ic)
    o["ic_top_summary"] = panel_sql(summary.format(src="tic"), f5, *top)
    decay = "SELECT CAST(period AS BIGINT) AS period, {} FROM (SELECT period, {} FROM {{src}} GROUP BY period)".format(
        f"{r('mean')} AS ic_mean, {r('std')} AS ic_std, {r('ir')} AS ic_ir", SUMMARY
    )
    o["ic_decay"] = panel_sql(decay.format(src="ic"), *LONG, ic_sql("fl", "period, date", "ic"))
    o["ic_top_decay"] = panel_sql(
        decay.format(src="ti"), *LONG, TOP.format(keys="period, date", src="fl", pct=0.5), ic_sql("tops", "period, date", "ti")
    )
    rolling = (
        "SELECT date, {} AS ic_raw, {} AS ic_rolling_mean FROM (SELECT *, CASE WHEN count(ic) OVER w >= 60 THEN avg(ic) OVER w END AS rm"
        " FROM {{src}} WINDOW w AS (ORDER BY date ROWS 119 PRECEDING))"
    ).format(r("ic"), r("rm"))
    o["ic_rolling"] = panel_sql(rolling.format(src="ic"), f5, ic)
    o["ic_top_rolling"] = panel_sql(rolling.format(src="tic"), f5, *top)
    o["ic_icir_series"] = panel_sql(
        f"SELECT date, {r('m')} AS ic_mean, {r('CASE WHEN s > 0 THEN m / s END')} AS icir FROM (SELECT date,"
        " CASE WHEN count(ic) OVER w >= 30 THEN avg(ic) OVER w END AS m, CASE WHEN count(ic) OVER w >= 30 THEN stddev_samp(ic) OVER w END AS s"
        " FROM ic WINDOW w AS (ORDER BY date ROWS 59 PRECEDING))",
        f5,
        ic,
    )
    o["ic_parameter_grid"] = _grid_sql(f"SELECT param_label, period, {rounds('ic_mean')} FROM rec")
    o["ic_parameter_matrix"] = _grid_sql(
        f"SELECT param_label, {r('max(CASE WHEN period = 1 THEN ic_mean END)')} AS p1,"
        f" {r('max(CASE WHEN period = 5 THEN ic_mean END)')} AS p5 FROM rec GROUP BY param_label"
    )
    o["ic_best_params"] = _grid_sql(
        f"SELECT param_label, period, {rounds('ic_mean')} FROM rec ORDER BY rec.ic_mean DESC LIMIT 1"
    )
    g5, g1 = (f5, groups_sql("fp", 5)), (f1, groups_sql("fp", 5))
    o["group_assign"] = panel_sql("SELECT symbol, date, grp FROM gr", *g5)
    o["group_returns"] = panel_sql(f"SELECT date, grp, {rounds('ret')} FROM qr", *g5)
    o["group_returns_wide"] = panel_sql(
        "SELECT date, " + ", ".join(f"{r(f'max(CASE WHEN grp = {i} THEN ret END)')} AS Q{i}" for i in range(1, 6)) + " FROM qr GROUP BY date", *g5
    )
    o["group_summary"] = panel_sql(
        f"SELECT grp, {r('avg(ret)')} AS mean_return, {r('stddev_samp(ret)')} AS std_return,"
        f" {r('sum(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) / count(ret)')} AS win_rate FROM qr GROUP BY grp",
        *g5,
    )
    ls = (
        "ls AS (SELECT * FROM (SELECT date, max(CASE WHEN grp = 5 THEN ret END) - max(CASE WHEN grp = 1 THEN ret END) AS ret FROM qr GROUP BY date)"
        " WHERE ret IS NOT NULL)"
    )
    o["group_long_short"] = panel_sql(f"SELECT date, {rounds('ret')} FROM ls", *g5, ls)
    o["group_long_short_metrics"] = panel_sql(
        f"SELECT count(*) AS n, {r('ln(product(1 + ret))')} AS log_growth, {r('stddev_samp(ret) * sqrt(252)')} AS annualised_volatility,"
        f" {r('avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END)')} AS win_rate FROM ls",
        *g1,
        ls,
    )
    o["group_cumulative"] = panel_sql(
        f"SELECT date, grp, {r('CASE WHEN ret IS NOT NULL THEN lc END')} AS log_cum FROM (SELECT date, grp, ret,"
        " sum(ln(1 + coalesce(ret * 0.01, 0))) OVER (PARTITION BY grp ORDER BY date ROWS UNBOUNDED PRECEDING) AS lc FROM qr)",
        *g1,
    )
    o["group_monotonicity"] = panel_sql(
        f"SELECT {r('sum(CAST(st AS INT)) * 1.0 / count(*)')} AS strict_monotonic_ratio, {r('sum(CAST(lo AS INT)) * 1.0 / count(*)')} AS loose_monotonic_ratio,"
        " CASE WHEN sum(CAST(v[1] < v[-1] AS INT)) > sum(CAST(v[1] > v[-1] AS INT)) THEN 'increasing'"
        " WHEN sum(CAST(v[1] > v[-1] AS INT)) > sum(CAST(v[1] < v[-1] AS INT)) THEN 'decreasing' ELSE 'none' END AS monotonic_direction"
        " FROM (SELECT v, len(v) >= 2 AND len(list_filter(list_zip(v[1:len(v) - 1], v[2:]), lambda p: p[1] <= p[2])) = 0 AS st,"
        " len(v) >= 2 AND len(list_filter(list_zip(v[1:len(v) - 1], v[2:]), lambda p: p[1] < p[2])) = 0 AS lo FROM md)",
        *g5,
        "md AS (SELECT date, list(ret ORDER BY grp) FILTER (ret IS NOT NULL) AS v FROM qr GROUP BY date)",
    )
    o["group_trend_test"] = panel_sql(
        f"SELECT {r('j', 4)} AS jt_statistic, {r('z', 4)} AS jt_z, {r('(((((1.061405429 * t - 1.453152027) * t) + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t * exp(-z * z / 2)', 4)} AS jt_pvalue"
        " FROM (SELECT j, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM (SELECT j, (j - (m * m - sq) / 4) / sqrt((m * (m - 1) * (2 * m + 5) - n0 - t0) / 72 + n1 * t1 / (36 * m * (m - 1) * (m - 2)) + n2 * t2 / (8 * m * (m - 1))) AS z"
        " FROM (SELECT sum(CASE WHEN a.x < b.x THEN 1.0 WHEN a.x = b.x THEN 0.5 ELSE 0.0 END) AS j FROM rd a JOIN rd b ON a.grp < b.grp)"
        " CROSS JOIN (SELECT sum(n) AS m, sum(n * n) AS sq, sum(n * (n - 1) * (2 * n + 5)) AS n0, sum(n * (n - 1) * (n - 2)) AS n1, sum(n * (n - 1)) AS n2 FROM (SELECT count(*)::DOUBLE AS n FROM rd GROUP BY grp))"
        " CROSS JOIN (SELECT sum(n * (n - 1) * (2 * n + 5)) AS t0, sum(n * (n - 1) * (n - 2)) AS t1, sum(n * (n - 1)) AS t2 FROM (SELECT count(*)::DOUBLE AS n FROM rd GROUP BY x))))",
        *g5,
        "rd AS MATERIALIZED (SELECT grp, round(ret, 7) AS x FROM qr WHERE ret IS NOT NULL)",
    )
    o["corr_factor_pairs"] = _corr_sql(f"SELECT a, b, {rounds('mean_corr', 'std_corr')}, n_dates FROM pc")
    o["scan_symbol_rows"] = _scan_sql(
        "SELECT symbol, CAST(formation_window AS BIGINT) AS formation_window, CAST(holding_window AS BIGINT) AS holding_window, valid_pair_count, eligible,"
        f" {r('symbol_corr', 5)} AS symbol_corr, {r('top_buy_return_pct', 5)} AS top_buy_return_pct, {r('hit_rate', 5)} AS hit_rate FROM sr"
    )
    o["scan_summary"] = _scan_sql(
        "SELECT CAST(formation_window AS BIGINT) AS formation_window, CAST(holding_window AS BIGINT) AS holding_window, count(*) AS candidate_count,"
        " sum(CAST(eligible AS INT))::BIGINT AS eligible_count, sum(CAST(NOT eligible AS INT))::BIGINT AS skipped_count, count(symbol_corr) AS valid_corr_count,"
        f" sum(CASE WHEN eligible THEN valid_pair_count ELSE 0 END)::BIGINT AS valid_pair_count, {r('avg(symbol_corr)', 5)} AS mean_symbol_corr,"
        f" {r('avg(CASE WHEN symbol_corr > 0 THEN 1.0 WHEN symbol_corr IS NOT NULL THEN 0.0 END)', 5)} AS positive_symbol_share,"
        f" {r('avg(top_buy_return_pct)', 5)} AS mean_top_buy_return_pct, {r('avg(hit_rate)', 5)} AS mean_hit_rate FROM sr GROUP BY ALL"
    )
    o["scan_cross_section_ic"] = _scan_sql(
        f"SELECT CAST(formation_window AS BIGINT) AS formation_window, CAST(holding_window AS BIGINT) AS holding_window, {r('avg(ic)')} AS mean_daily_xs_ic,"
        f" {r('avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END)')} AS positive_share, count(ic) AS valid_dates, count(*) AS eligible_dates FROM"
        " (SELECT formation_window, holding_window, date, CASE WHEN stddev_samp(r2) * stddev_samp(fwd) > 0 THEN corr(r2, fwd) END AS ic FROM sl"
        " JOIN sr USING (symbol, formation_window, holding_window) WHERE eligible GROUP BY ALL HAVING count(*) >= 3) GROUP BY ALL"
    )
    o["scan_summary_with_ic"] = (
        "SELECT s.*, " + ", ".join(f"{r(x, 5)} AS {x}" for x in ("mean_daily_xs_ic", "positive_share")) + ", valid_dates, eligible_dates"
        f" FROM ({o['scan_summary']}) s LEFT JOIN ({o['scan_cross_section_ic']}) x USING (formation_window, holding_window)"
    )
    return o
