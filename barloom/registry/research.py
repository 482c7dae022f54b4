"""Meta-factor, universe, text, table and report queries."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import expansion
from ..functions.factor import with_factors
from ..functions.library import expand_transforms, from_recipe, make
from ..functions.frames import Bars
from ..functions.scalar import c, div, rounded
from ..operators import corrstore, crosscorr as X, joins, pairs as PR, panel as P, performance as R, predictive, reports, text as T
from ..operators import universe as U
from ..plans.factor_report import headline, run_factor_analysis
from ..sources import bars as B, demo
from ..sources.demo import load_bars, ship_dates, table, with_daily_change
from ..sources.session import shared_path
from ..sources.store import BarStore
from ..streaming import bars as ST
from ..streaming.bars import bars_from_ticks, dedupe_ticks, latest_signal, ticks_from_events
from .analysis import _corr_pairs, _corr_sql, _round, rounds
from .factors import _line
from .sqlbase import BARS, S0, factor_sql, full, lag, r, staged

PR20 = {"factor": "PriceReturn", "params": {"window": 20}}
ER = {"factor": "KaufmanER"}
VOL = {"factor": "Volatility"}

RECIPES = {
    **{
        f"transform_{k}": {"transform": k, "of": PR20, **({"window": 60} if k == "zscore" else {})}
        for k in (
            "rolling_mean", "rolling_std", "rolling_skew", "delta", "pct_change", "binarize_winrate", "zscore",
            "rolling_slope", "rolling_r2",
        )
    },
    "negate": {"negate": PR20},
    "combine_product": {"combine": "product", "a": PR20, "b": ER},
    "combine_ratio": {"combine": "ratio", "a": PR20, "b": VOL},
    "combine_diff": {"combine": "diff", "a": PR20, "b": {"factor": "PriceReturn", "params": {"window": 60}}},
    "combine_weighted": {"combine": "weighted_sum", "a": PR20, "b": ER, "weight_a": 0.7, "weight_b": 0.3, "normalize_window": 60},
    "conditional": {"signal": PR20, "when": [{"factor": ER, "op": "gt", "threshold": 0.1}]},
    "conditional_zero": {"signal": PR20, "when": [{"factor": PR20, "op": "lte", "threshold": 0.5}], "false_value": "zero"},
    "multi_conditional": {
        "signal": PR20,
        "when": [{"factor": ER, "op": "gt", "threshold": 0.05}, {"factor": VOL, "op": "lt", "threshold": 1.5}],
        "logic": "or",
    },
    "switch": {"switch": PR20, "else": VOL, "when": [{"factor": ER, "op": "gte", "threshold": 0.1}], "false_negate": True},
    "nested": {
        "transform": "rolling_mean",
        "window": 5,
        "of": {"combine": "product", "a": {"negate": PR20}, "b": {"transform": "delta", "of": ER}},
    },
}

_M = {
    "x": f"(close - {lag('close', 20)}) / {lag('close', 20)}",
    "x60": f"(close - {lag('close', 60)}) / {lag('close', 60)}",
    "mv": "abs(close - pc)",
    "vol": full("stddev_samp", "ret", 20),
}
_PATH = f"nullif({full('sum', 'mv', 20)}, 0)"
_M2 = {"er": f"CASE WHEN {_PATH} IS NOT NULL THEN least(abs(close - {lag('close', 20)}) / {_PATH}, 1.0) END"}


def _z(x: str, n: int) -> str:
    return f"({x} - ({full('avg', x, n)})) / nullif({full('stddev_samp', x, n)}, 0)"


META_SQL = {
    "transform_rolling_mean": (full("avg", "x", 10), _M),
    "transform_rolling_std": (full("stddev_samp", "x", 20), _M),
    "transform_rolling_skew": (full("skewness", "x", 20), _M),
    "transform_delta": (f"x - {lag('x', 5)}", _M),
    "transform_pct_change": (f"x / nullif({lag('x', 5)}, 0) - 1", _M),
    "transform_binarize_winrate": (full("avg", "b", 20), _M, {"b": "coalesce(CAST(x > 0 AS DOUBLE), 0.0)"}),
    "transform_zscore": (_z("x", 60), _M),
    "transform_rolling_slope": (_line("slope", "x", 20), _M),
    "transform_rolling_r2": (_line("r2", "x", 20), _M),
    "negate": ("-x", _M),
    "combine_product": ("x * er", _M, _M2),
    "combine_ratio": ("x / nullif(vol, 0)", _M),
    "combine_diff": ("x - x60", _M),
    "combine_weighted": (f"0.7 * ({_z('x', 60)}) + 0.3 * ({_z('er', 60)})", _M, _M2),
    "conditional": ("CASE WHEN er > 0.1 THEN x END", _M, _M2),
    "conditional_zero": ("CASE WHEN x <= 0.5 THEN x ELSE 0.0 END", _M),
    "multi_conditional": ("CASE WHEN coalesce(er > 0.05, FALSE) OR coalesce(vol < 1.5, FALSE) THEN x END", _M, _M2),
    "switch": ("CASE WHEN er >= 0.1 THEN x ELSE -vol END", _M, _M2),
    "nested": (full("avg", "y", 5), _M, _M2, {"y": f"(-x) * (er - {lag('er', 5)})"}),
}


def _meta(recipe):
    def run(s, d):
        f = from_recipe(recipe)
        df = with_factors(load_bars(s, d), [f]).df
        return df.select("symbol", "date", rounded(c(f.name), 5).alias("value"))

    return run


GRID_NAMES = ("PriceReturn", "KaufmanER", "RSI", "ATR")


#: Combinations, conditions and switches over grids of windows and thresholds.
COMBOS = {
    "efficient": {"combine": "product", "a": {"factor": "PriceReturn", "params": {"window": {"any": [20, 60]}}}, "b": ER},
    "spread": {"combine": "diff", "a": PR20, "b": {"factor": "PriceReturn", "params": {"window": 60}}},
}
CONDITIONALS = (
    {"signal": {"any": [PR20, VOL]}, "when": [{"factor": ER, "op": {"any": ["gt", "lte"]}, "threshold": {"any": [0.05, 0.1]}}], "false_value": {"any": ["nan"]}},
    {"signal": {"ref": "spread"}, "when": [{"factor": ER, "op": "gt", "threshold": 0.05}, {"factor": VOL, "op": "lt", "threshold": 1.5}], "logic": "or"},
    {"switch": {"ref": "efficient"}, "else": VOL, "when": [{"factor": ER, "op": "gte", "threshold": 0.1}], "false_negate": True},
)


def _expansion(s, d):
    fs = expansion.expand_all((), COMBOS, CONDITIONALS)
    long = expansion.evaluate(load_bars(s, d), fs, most=12)
    return _round(long.groupBy("factor_name").agg(F.count("factor").alias("n"), F.avg("factor").alias("mean")), 4)


def _expansion_sql() -> str:
    pr, er, vol = "PriceReturn_20", "KaufmanER_20", "Volatility_20"
    wide = {"20": "x", "60": "x60"}
    cols = {f"PriceReturn_{n}__product_{er}": f"{x} * er" for n, x in wide.items()}
    spread = f"{pr}__diff_PriceReturn_60"
    cols[spread] = "x - x60"
    for name, x in ((pr, "x"), (vol, "vol")):
        for op, sign in (("gt", ">"), ("lte", "<=")):
            for cut in (0.05, 0.1):
                cols[f"{name}__if_{er}_{op}_{cut}"] = f"CASE WHEN er {sign} {cut} THEN {x} END"
    cols[f"{spread}__if_{er}_gt_0.05_or_{vol}_lt_1.5"] = "CASE WHEN coalesce(er > 0.05, FALSE) OR coalesce(vol < 1.5, FALSE) THEN x - x60 END"
    for n, x in wide.items():
        cols[f"PriceReturn_{n}__product_{er}__if_{er}_gte_0.1__else_{vol}_neg"] = f"CASE WHEN er >= 0.1 THEN {x} * er ELSE -vol END"
    ctes, last = staged(_M, _M2)
    rows = " UNION ALL ".join(f"SELECT '{n}' AS factor_name, count({e}) AS n, {r(f'avg({e})', 4)} AS mean FROM z" for n, e in cols.items())
    return f"WITH {BARS},\n{S0}{ctes},\nz AS MATERIALIZED (SELECT x, x60, vol, er FROM {last})\n{rows}"


def _expanded(s, d):
    """The whole expansion as one job: wide in the pass, long at the end."""
    fs = expand_transforms(GRID_NAMES, param_grids={"PriceReturn": {"window": [20, 60]}})
    out = with_factors(load_bars(s, d), fs)
    long = P.long_factors(out, [f.name for f in fs]).df
    stats = long.groupBy("factor_name").agg(F.count("factor").alias("n"), F.avg("factor").alias("mean"))
    return _round(stats, 4)


# --- universe -----------------------------------------------------------------

THRESHOLD = 0.03


def _returns(s, d):
    return PR.daily_returns(load_bars(s, d))


def _pairs(s, d, **bounds):
    return PR.correlation_pairs(_returns(s, d), min_rows=100, **bounds)


def _groups(s, d):
    return PR.group_correlations(_returns(s, d), _labels(s, d), min_rows=100)


def _cluster_summary(s, d):
    names = table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_name").alias("name"))
    families = names.select("symbol", T.family("name", FAMILIES).alias("family"))
    per = PR.symbol_correlations(_returns(s, d), _labels(s, d), min_rows=100)
    return U.summary_of_clusters(per, _labels(s, d), families, fits=load_bars(s, d).symbols_fit)


def _combos(s, d, outside):
    """Only the pairs inside the sets are asked for again."""
    sets = U.cut_lineage(U.largest_compatible_sets(_pairs(s, d, max_corr=-0.01), outside, -0.01))
    fixed = ["Brand#1", "Brand#2"]
    members = sets.select(F.explode(F.concat("members", F.array(*map(F.lit, fixed)))).alias("symbol")).distinct()
    return U.combo_summary(sets, _pairs(s, d, sides=(members, members)), fixed, _profile(s, d).select("symbol", "avg_value"), None).drop("symbols")


def _symbols(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("symbol")).distinct()


def _labels(s, d):
    number = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    return _symbols(s, d).withColumn("cluster", F.pmod(number, F.lit(4)).cast("long"))


def _index_map(s, d):
    return table(s, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_type").alias("index_name")).distinct()


def _one_index(s, d):
    return table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_type").alias("index_name"))


def _first_dates(s, d):
    return load_bars(s, d).df.groupBy("symbol").agg(F.min("date").alias("first_date"))


def _dist(s, d, **bounds):
    return _pairs(s, d, **bounds).select("a", "b", U.distance().alias("dist"))


CORR = (
    "cp AS MATERIALIZED (SELECT a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS corr, count(*) AS n FROM s0 a JOIN s0 b ON a.date = b.date AND a.symbol < b.symbol"
    " WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100)"
)
BOTH = "cb AS MATERIALIZED (SELECT a, b, corr FROM cp UNION ALL SELECT b, a, corr FROM cp)"
SYMS = "sy AS MATERIALIZED (SELECT DISTINCT p_brand AS symbol FROM part)"
LABELS = "lb AS MATERIALIZED (SELECT symbol, CAST(regexp_extract(symbol, '(\\d+)', 1) AS INT) % 4 AS cluster FROM sy)"
COMPONENTS = (
    "ed AS MATERIALIZED (SELECT a, b FROM {src} UNION SELECT b, a FROM {src})",
    "rch AS (SELECT a AS symbol, a AS other FROM ed UNION SELECT rch.symbol, ed.b FROM rch JOIN ed ON ed.a = rch.other)",
    "cm AS MATERIALIZED (SELECT symbol, min(other) AS component FROM rch GROUP BY symbol)",
)


def usql(body: str, *ctes: str) -> str:
    return f"WITH RECURSIVE {BARS},\n{S0}" + "".join(",\n" + x for x in ctes) + "\n" + body


def _components(condition: str) -> tuple[str, ...]:
    return (f"ce AS MATERIALIZED (SELECT a, b FROM cp WHERE {condition})", *[x.format(src="ce") for x in COMPONENTS])


EPS = 0.985
K = 5


def _kdist(s, d):
    near = PR.nearest_partners(_returns(s, d), K - 1, min_rows=100)
    return near.filter(F.col("place") == K - 1).select(F.col("a").alias("symbol"), U.distance().alias("k_dist"))


KD = (
    "ds AS (SELECT a, b, sqrt(greatest(1 - corr, 0)) AS dist FROM cb)",
    f"kd AS MATERIALIZED (SELECT a AS symbol, dist AS k_dist FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY dist, b) AS n FROM ds) WHERE n = {K - 1})",
)


# --- text ---------------------------------------------------------------------

WORDS = ("red", "blue", "small", "ring", "widget", "gear")
FAMILIES = (("round", ("ring", "gear")), ("coloured", ("red", "blue")), ("little", ("small",)))
ISSUERS = ("ECONOMY", "ECONOMY LINE", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD", "Brand#1")


def _funds(s, d):
    """Fund-like names from part type, name and brand."""
    return table(s, d, "part").select(
        F.col("p_partkey").alias("id"),
        "p_name",
        "p_brand",
        F.concat(F.col("p_type"), F.lit(" "), F.col("p_name"), F.lit("（A-B/C） ETF "), F.col("p_brand")).alias("name"),
    )


FUNDS = "fu AS (SELECT p_partkey AS id, p_name, p_brand, p_type || ' ' || p_name || '（A-B/C） ETF ' || p_brand AS name FROM part)"
NORM = "regexp_replace(replace(replace(trim({x}), '（', '('), '）', ')'), '[()\\-_/·\\s]+', '', 'g')"


def _profile(s, d):
    names = table(s, d, "part").groupBy(F.col("p_brand").alias("symbol")).agg(F.min("p_name").alias("name"))
    return T.symbol_profile(load_bars(s, d).df, names, WORDS)


PROFILE = (
    "pf AS MATERIALIZED (SELECT b.*, n.name, list_filter(['red', 'blue', 'small', 'ring', 'widget', 'gear'], lambda k: contains(replace(n.name, ' ', ''), k)) AS kw FROM"
    " (SELECT symbol, count(*) AS bar_count, avg(value) AS avg_value, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY symbol) b"
    " JOIN (SELECT p_brand AS symbol, min(p_name) AS name FROM part GROUP BY 1) n USING (symbol))"
)


# --- tables -------------------------------------------------------------------


def _raw_trades(s, d):
    return demo._trades(s, d)


def _old_new(s, d):
    """A stored table with gaps and an update that corrects part of it."""
    bars = load_bars(s, d).df
    month = F.month("date")
    old = bars.filter(month <= 9).withColumn("close", F.when(month % 3 != 0, F.col("close")))
    new = bars.filter(month >= 6).select(
        "symbol", "date", F.when(month % 2 == 0, F.col("open") + 1).alias("open"), "close"
    )
    return old, new


def _listings(s, d):
    """Every third symbol leaves the list in the middle of the period."""
    number = F.regexp_extract("symbol", r"(\d+)", 1).cast("int")
    gone = F.when(number % 3 == 0, F.to_date(F.lit("1998-06-30")))
    return _symbols(s, d).select("symbol", F.col("symbol").alias("name"), F.lit(None).cast("date").alias("list_date"), gone.alias("delist_date"))


def _catalogue(s, d):
    bars = load_bars(s, d)
    fs = [make("PriceReturn", window=20), make("Volatility"), make("VolumeRatio"), make("KaufmanER")]
    out = P.forward_returns(with_factors(bars, fs), [5], ship_dates(s, d), column="fwd")
    long = P.long_factors(out, [f.name for f in fs], ["fwd"])
    ic = predictive.ic_summary(predictive.daily_ic(long, keys=["factor_name"]), ["factor_name"])
    return ic.select("factor_name", F.col("mean").alias("ic_mean"), F.col("ir").alias("ic_ir"))


def _strategies(s, d):
    """Three exposures of the same timing rule, one row per symbol each."""
    from .strategy import _scaled_benchmark, _timing_returns

    ret = _timing_returns(s, d)
    parts = []
    for name, scale in (("full", 0.01), ("half", 0.005), ("inverse", -0.01)):
        parts.append(ret.withColumns({"strategy": F.lit(name), "ret": F.col("ret") * scale}))
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    keys = ["strategy", "symbol"]
    bench = _scaled_benchmark(s, d)
    m = R.return_metrics(rows, keys).join(R.information_ratio(rows, bench, keys), keys)
    same = rows.select(*keys, "date").join(bench, "date").groupBy(*keys).agg((F.product(1 + F.col("ret")) - 1).alias("b"))
    excess = div(F.col("cumulative_return") + 1, F.col("b") + 1) - 1
    return m.join(same, keys).select(
        *keys, "information_ratio", excess.alias("excess_cumulative_return"),
        (F.col("max_drawdown") * 100).alias("max_drawdown_pct"), "win_rate",
    )


def _ticks(s, d):
    return ticks_from_events(table(s, d, "events"))


def _tick_bars(s, d):
    """Daily bars of the ticks, dated by their day."""
    bars = bars_from_ticks(dedupe_ticks(_ticks(s, d)))
    return Bars.measure(bars.withColumn("date", F.to_date("start")).drop("start"))


def _store(s, d):
    """The update of `_old_new` as two batches into a bar store; the second leaves
    the months before June alone."""
    old, new = _old_new(s, d)
    store = BarStore(s, shared_path(s, "bar-store"))
    store.upsert(old)
    store.upsert(new)
    return store.read().select("symbol", "date", "open", "close", "volume")


def _tick_stream(s, d):
    # A pattern, as a stream's path may not be a single file.
    events = table(s, d, "events")
    return ticks_from_events(s.readStream.schema(events.schema).parquet(f"{d.rstrip('/')}/event[s].parquet"))


def _stream_store(s, d):
    """Ticks as a stream, each delivered twice, into a bar store."""
    path, ticks = shared_path(s, "tick-store"), _tick_stream(s, d)
    bars = bars_from_ticks(dedupe_ticks(ticks.unionByName(ticks), "60 days"), lateness=None)
    ST.run_to_end(bars, ST.upsert_sink(s, path), shared_path(s, "stream"), mode="update")
    return ST.read_version(s, path)


def _stream_signals(s, d):
    """From ticks to closed bars to the signal of each, as streams."""
    folder, out = shared_path(s, "closed-bars"), shared_path(s, "signals")
    ST.write_closed_bars(bars_from_ticks(_tick_stream(s, d)), folder, shared_path(s, "stream"))
    stream, signals = ST.signal_stream(ST.read_closed_bars(s, folder), make("PriceReturn", window=5), "60 days")
    ST.run_to_end(stream, lambda batch, i: signals(batch).write.mode("overwrite").parquet(f"{out}/batch={i}"), shared_path(s, "stream"))
    return s.read.parquet(out).select("symbol", F.to_date("date").alias("date"), "signal")


def queries() -> dict:
    q = {f"meta_{k}": _meta(v) for k, v in RECIPES.items()}
    q["meta_expanded_grid"] = _expanded
    q["meta_expansion"] = _expansion
    q["universe_return_correlation"] = lambda s, d: _round(_pairs(s, d))
    q["universe_common_window_correlation"] = lambda s, d: _round(
        PR.correlation_pairs(PR.log_returns(PR.common_dates(demo.weekly(s, d)))), 5
    )
    q["universe_duplicate_pairs"] = lambda s, d: _round(PR.duplicate_pairs(load_bars(s, d), THRESHOLD, 100), 5)
    q["universe_components"] = lambda s, d: U.connected_components(_pairs(s, d, min_corr=THRESHOLD))
    q["universe_merged_clusters"] = lambda s, d: _round(
        U.merged_clusters(_pairs(s, d, min_corr=0.045), _first_dates(s, d), _one_index(s, d)).select(
            "component", "representative", F.array_join("members", ",").alias("members"),
            F.array_join("merged_indices", ",").alias("merged_indices"), "max_corr",
        )
    )
    q["universe_matrix_report"] = lambda s, d: _round(
        U.matrix_report(
            PR.both_ways(_pairs(s, d).select("a", "b", "corr")).unionByName(
                _symbols(s, d).select(F.col("symbol").alias("a"), F.col("symbol").alias("b"), F.lit(1.0).alias("corr"))
            )
        )
    )
    q["universe_concentration"] = lambda s, d: _round(U.concentration(_pairs(s, d), load_bars(s, d).symbols))
    q["universe_concentration_score"] = lambda s, d: _round(U.concentration_score(_pairs(s, d), load_bars(s, d).symbols))
    q["universe_dominant_share"] = lambda s, d: _round(U.dominant_share(_pairs(s, d), load_bars(s, d).symbols))
    q["universe_threshold_clusters"] = lambda s, d: U.threshold_clusters(_pairs(s, d, min_corr=1 - 0.98**2), _symbols(s, d), 0.98)
    q["universe_neighbour_distances"] = lambda s, d: _round(_kdist(s, d))
    q["universe_estimate_eps"] = lambda s, d: _round(U.estimate_eps(_kdist(s, d), fits=load_bars(s, d).symbols_fit))
    q["universe_density_clusters"] = lambda s, d: U.density_clusters(_dist(s, d, min_corr=U.least_correlation(EPS)), _symbols(s, d), EPS, 4)
    q["universe_feature_clusters"] = lambda s, d: U.feature_clusters(
        reports.latest_values(
            with_factors(load_bars(s, d), [make("Volatility"), make("KaufmanER"), make("VolumeRatio")]).df,
            ["Volatility_20", "KaufmanER_20", "VolumeRatio_5"],
        ), ["Volatility_20", "KaufmanER_20", "VolumeRatio_5"], 3, 2,
    )[0]
    q["universe_cluster_correlation"] = lambda s, d: _round(_groups(s, d))
    q["universe_cluster_medians"] = lambda s, d: _round(U.cluster_correlation_medians(_pairs(s, d), _labels(s, d), fits=load_bars(s, d).symbols ** 2 <= load_bars(s, d).limit))
    q["universe_cluster_stats"] = lambda s, d: _round(U.cluster_stats(_groups(s, d), _labels(s, d), _one_index(s, d)))
    q["universe_cluster_summary"] = lambda s, d: _round(_cluster_summary(s, d))
    q["universe_greedy_selection"] = lambda s, d: s.createDataFrame(
        list(enumerate(U.greedy_low_correlation(_pairs(s, d), U.cluster_summary(_pairs(s, d), _labels(s, d)), 6, 2), 1)),
        "selection_order long, symbol string",
    )
    base = lambda s, d: _symbols(s, d).filter(F.col("symbol").isin("Brand#1", "Brand#2"))
    ext = lambda s, d: _symbols(s, d).filter(~F.col("symbol").isin("Brand#1", "Brand#2"))
    q["universe_pair_table"] = lambda s, d: _round(U.pair_table(_pairs(s, d), _symbols(s, d), 0.02, -0.05))
    q["universe_base_conflicts"] = lambda s, d: _round(
        U.base_conflicts(_pairs(s, d, sides=(base(s, d), ext(s, d))), base(s, d), ext(s, d), 0.02).withColumn("conflicts", F.array_join("conflicts", ","))
    )
    q["universe_compatible_sets"] = lambda s, d: U.largest_compatible_sets(_pairs(s, d, max_corr=-0.01), _symbols(s, d), -0.01).select(
        F.array_join("members", ",").alias("members")
    )
    q["universe_combo_summary"] = lambda s, d: _round(_combos(s, d, ext(s, d)), 4)
    q["text_normalize"] = lambda s, d: _funds(s, d).select("id", T.normalize_name("name").alias("normal"))
    q["text_tracked_index"] = lambda s, d: _funds(s, d).select("id", T.tracked_index_name("name", ISSUERS).alias("index_name"))
    q["text_tokens"] = lambda s, d: _funds(s, d).select(
        "id", F.array_join(F.sort_array(T.name_tokens("name", WORDS)), "|").alias("tokens")
    )
    q["text_keywords"] = lambda s, d: _funds(s, d).select(
        "id", F.array_join(T.match_keywords("name", WORDS), "|").alias("keywords")
    )
    q["text_similarity"] = lambda s, d: _round(
        _funds(s, d).select("id", T.name_similarity("p_name", "name", WORDS).alias("similarity"))
    )
    q["text_family"] = lambda s, d: _funds(s, d).select("id", T.family("p_name", FAMILIES).alias("family"))
    q["text_market"] = lambda s, d: table(s, d, "orders").select(
        "o_orderkey", T.pad_code(F.col("o_orderkey") * 37).alias("code"), T.market_of(F.col("o_orderkey") * 37).alias("market"),
        T.is_a_share(F.col("o_orderkey") * 37).alias("a_share"),
    )
    q["text_dedupe_names"] = lambda s, d: T.dedupe_names(
        table(s, d, "part").select(F.col("p_brand").alias("symbol"), F.col("p_name").alias("name")), "widget"
    )
    q["text_merge_listings"] = lambda s, d: T.merge_listings(
        _listings(s, d).withColumn("delist_date", F.lit(None).cast("date")).withColumn("list_date", F.to_date(F.lit("1990-01-02"))),
        _listings(s, d).filter(F.col("delist_date").isNotNull()).withColumn("name", F.lit(None).cast("string")),
    )
    q["text_symbol_profile"] = lambda s, d: _round(
        _profile(s, d).withColumn("matched_keywords", F.array_join("matched_keywords", "|")), 3
    )
    q["text_keyword_representatives"] = lambda s, d: _round(T.keyword_representatives(_profile(s, d), 600), 4)
    q["text_representative_symbols"] = lambda s, d: _round(
        T.representative_symbols(T.keyword_representatives(_profile(s, d), 600)).withColumn(
            "source_keywords", F.array_join("source_keywords", "|")
        ), 4
    )
    q["text_best_per_index"] = lambda s, d: _round(T.best_per_index(load_bars(s, d).df, _index_map(s, d)))
    q["text_tracked_indices"] = lambda s, d: T.tracked_indices(_index_map(s, d))
    q["bars_daily"] = lambda s, d: _cents(load_bars(s, d).df)
    q["bars_daily_change"] = lambda s, d: _round(with_daily_change(load_bars(s, d)).df.select("symbol", "date", "gain", "range", "turnOver"))
    q["bars_normalize"] = lambda s, d: _cents(B.normalize_bars(
        load_bars(s, d).df.withColumns({"date": F.col("date").cast("string"), "close": F.when(F.month("date") == 2, "n/a").otherwise(F.col("close").cast("string"))})
    ))
    q["bars_normalize_price"] = lambda s, d: B.normalize_price(
        load_bars(s, d).df.withColumn("open", F.when(F.month("date") != 3, F.col("open")).otherwise(-1.0)), ["volume"]
    )
    q["bars_keep_last"] = lambda s, d: B.keep_last(
        _raw_trades(s, d).select("symbol", "date", "price", "key"), [F.col("key")]
    ).select("symbol", "date", "price")
    q["bars_upsert"] = lambda s, d: B.upsert(*_old_new(s, d)).select("symbol", "date", "open", "close", "volume")
    q["bars_concat_history"] = lambda s, d: B.concat_history(
        [x.select("symbol", "date", "open", "close") for x in _old_new(s, d)]
    )
    q["bars_vendor_units"] = lambda s, d: _round(
        B.vendor_units(B.rename_vendor(load_bars(s, d).df.withColumnsRenamed({"volume": "成交量", "value": "成交额", "close": "收盘"})))
        .select("symbol", "date", "volume", "value", "turnOver"), -3
    )
    q["bars_feed_frame"] = lambda s, d: _round(
        B.feed_frame(with_factors(load_bars(s, d).with_df(load_bars(s, d).df.drop("value")), [make("Volatility")]).df.withColumn("empty", F.lit(None).cast("double")))
        .select("symbol", "date", "Volatility_20")
    )
    q["bars_date_slices"] = lambda s, d: B.date_slices(
        table(s, d, "orders").groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("start"), F.to_date(F.max("o_orderdate")).alias("end")), 365
    )
    q["bars_freshness"] = lambda s, d: B.freshness(
        _symbols(s, d).unionByName(table(s, d, "nation").select(F.col("n_name").alias("symbol"))), load_bars(s, d).df, "2001-10-30"
    )
    q["bars_newest_file"] = lambda s, d: B.newest_file_per_code(
        table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("p_brand").alias("code"), F.concat_ws("/", "p_type", "p_brand").alias("path"), F.to_date("l_shipdate").alias("date")
        )
    )
    q["join_common_dates"] = lambda s, d: PR.common_dates(demo.weekly(s, d)).df.select("symbol", "date")
    q["join_aligned_calendar"] = lambda s, d: joins.aligned_to_calendar(load_bars(s, d), ship_dates(s, d), 60, ["close"])
    q["join_active_on"] = lambda s, d: joins.active_on(load_bars(s, d).df.select("symbol", "date"), _listings(s, d))
    q["join_last_days"] = lambda s, d: joins.last_days(ship_dates(s, d), 30, "2000-01-01")
    q["join_trading_days_only"] = lambda s, d: joins.trading_days_only(
        table(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), ship_dates(s, d)
    ).select("o_orderkey", "date")
    q["join_lookup_names"] = lambda s, d: joins.lookup(
        load_bars(s, d).df.select("symbol", "date"), _labels(s, d).filter("cluster > 0"), "symbol", {"cluster": -1}, load_bars(s, d).symbols
    )
    q["join_name_cells"] = lambda s, d: joins.name_cells(
        _index_map(s, d).groupBy("index_name").agg(F.sort_array(F.collect_list("symbol")).alias("symbols")),
        _profile(s, d).select("symbol", "name"), "symbols", "names",
    ).select("index_name", F.array_join("names", ",").alias("names"))
    q["join_held"] = lambda s, d: joins.held(load_bars(s, d).df.select("symbol", "date"), _labels(s, d).filter("cluster = 1"))
    q["join_not_held"] = lambda s, d: joins.not_held(load_bars(s, d).df.select("symbol", "date"), _labels(s, d).filter("cluster = 1"))
    q["join_keep_symbols"] = lambda s, d: joins.keep_symbols(load_bars(s, d), 1550).df.select("symbol", "date")
    q["join_keep_where_any"] = lambda s, d: joins.keep_where_any(load_bars(s, d), F.col("volume") > 150).df.select("symbol", "date")
    q["join_symbol_predicate"] = lambda s, d: joins.filter_symbols(
        load_bars(s, d), lambda p: len(p) > 1550 and p["volume"].max() > 150, ["volume"]
    )
    q["join_parameter_grid"] = lambda s, d: _round(
        joins.with_grid(load_bars(s, d).df.select("symbol", "close"), [{"k": 1, "w": 0.5}, {"k": 2, "w": 1.5}])
        .groupBy("symbol", "k").agg(F.avg(F.col("close") * F.col("w")).alias("m")), 4
    )
    q["corr_high_pairs"] = lambda s, d: _round(X.high_pairs(_corr_pairs(s, d), 0.05))
    q["corr_low_pairs"] = lambda s, d: _round(X.low_pairs(_corr_pairs(s, d), 0.05))
    q["corr_lookup"] = lambda s, d: _round(X.correlated_with(_corr_pairs(s, d), "VolumeRatio_5", 0.01))
    q["corr_store_changed_factor"] = lambda s, d: _round(_store_changed_factor(s, d))
    q["corr_store_changed_bars"] = lambda s, d: _round(_store_changed_bars(s, d))
    q["corr_incremental_update"] = lambda s, d: _round(_incremental(s, d))
    q["bars_written"] = lambda s, d: _round(_bars_on_disk(s, d))
    q["bars_dimension"] = _dimension
    q["report_files"] = _report_files
    q["report_tagged_logs"] = _tagged_logs
    q["report_index"] = lambda s, d: _round(_report_index(s, d))
    q["report_catalogue"] = lambda s, d: _round(reports.query_catalogue(_catalogue(s, d), search="vol", page_size=3))
    q["report_factor_run"] = lambda s, d: _round(headline(run_factor_analysis(
        load_bars(s, d), make("PriceReturn", window=20), (1, 5), 5, top_pct=0.5, dates=ship_dates(s, d)
    )))
    q["report_trend"] = lambda s, d: _round(reports.factor_trend(load_bars(s, d), make("Volatility"), "Brand#7", 365))
    q["report_trend_stats"] = lambda s, d: _round(reports.trend_stats(reports.factor_trend(load_bars(s, d), make("Volatility"), "Brand#7", 365)))
    q["report_recent_signals"] = lambda s, d: reports.recent_signals(
        with_factors(load_bars(s, d), [make("RSRS", output="signal")]), "RSRS_signal_reg18_z200_adj", _labels(s, d).filter("cluster < 2")
    )
    q["report_volatility_snapshot"] = lambda s, d: _round(reports.volatility_snapshot(load_bars(s, d), make("Volatility", window=252, annualize=True)))
    q["report_quarterly_groups"] = lambda s, d: _round(_quarterly(s, d))
    q["report_quarterly_wide"] = lambda s, d: reports.quarterly_groups_wide(_quarterly(s, d), ["1996-07-01", "1999-01-01"]).withColumnsRenamed(
        {"1996-07-01": "q1", "1999-01-01": "q2"}
    )
    q["report_compare_strategies"] = lambda s, d: _round(
        reports.compare_strategies(_strategies(s, d)), 4
    )
    q["report_holdings_by_cluster"] = lambda s, d: _round(reports.holdings_by_cluster(_holdings(s, d)), 4)
    q["report_add_list"] = lambda s, d: _round(_add_list(s, d))
    q["report_latest_values"] = lambda s, d: reports.latest_values(load_bars(s, d).df, ["close", "volume"])
    q["ticks_to_bars"] = lambda s, d: _round(bars_from_ticks(dedupe_ticks(_ticks(s, d))).withColumn("start", F.to_date("start")), 4)
    q["bars_store_upsert"] = _store
    q["ticks_stream_store"] = lambda s, d: _round(_stream_store(s, d).withColumn("start", F.to_date("start")), 4)
    q["ticks_signal_stream"] = lambda s, d: _round(_stream_signals(s, d))
    q["ticks_latest_signal"] = lambda s, d: _round(
        latest_signal(_tick_bars(s, d), make("PriceReturn", window=5))
    )
    return q


def _cents(df):
    """Sums of cents in cents; their last bits depend on the adding order."""
    return df.withColumn("value", rounded("value", 2))


STORED = {
    "PriceReturn_20": {"factor": "PriceReturn", "params": {"window": 20}},
    "Volatility_20": {"factor": "Volatility"},
    "VolumeRatio_5": {"factor": "VolumeRatio"},
    "KaufmanER_20": {"factor": "KaufmanER"},
}


def _store_run(s, d, path, bars=None, recipes=STORED):
    bars = load_bars(s, d) if bars is None else bars
    return corrstore.update(bars, recipes, path, interval=5, min_assets=5, dates=ship_dates(s, d))


def _store_changed_factor(s, d):
    """The store knows another parameter of a factor; its pairs are computed anew,
    the others come from the store."""
    path = shared_path(s, "correlations")
    _store_run(s, d, path, recipes={**STORED, "PriceReturn_20": {"factor": "PriceReturn", "params": {"window": 60}}})
    return _store_run(s, d, path).pairs


def _store_changed_bars(s, d):
    """The store was made before one symbol's bars of two months were corrected and
    before the last year's bars came."""
    path, bars = shared_path(s, "correlations"), load_bars(s, d)
    wrong = (F.col("symbol") == "Brand#1") & F.trunc("date", "month").isin([dt.date(1997, 3, 1), dt.date(1999, 8, 1)])
    old = bars.df.withColumn("close", F.when(wrong, F.col("close") * 2).otherwise(F.col("close"))).filter(F.col("date") < F.lit("2001-01-01"))
    corrstore.update(bars.with_df(old), STORED, path, interval=5, min_assets=5)
    return _store_run(s, d, path).pairs


def _written_reports(s, d):
    """Two reports per factor in two layouts, as text files of one JSON object. The
    newer one of the factors whose names end in _20 keys its percentiles by date, the
    other ones' lists them; an older report with other figures lies beside it."""
    path = shared_path(s, "reports")
    ic = _catalogue(s, d).select("factor_name", "ic_mean", "ic_ir")
    share = (0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95)
    days = load_bars(s, d).df.groupBy(F.year("date").cast("string").alias("day")).agg(F.expr(f"percentile(close, array({', '.join(map(str, share))}))").alias("q"))
    at = {f"p{int(x * 100)}": F.col("q")[i] for i, x in enumerate(share)}
    upper = F.struct(*[at[p].alias(p.upper()) for p in ("p5", "p25", "p50", "p75", "p95")])
    lower = F.create_map(*[v for p in ("p10", "p25", "p50", "p75", "p90") for v in (F.lit(p), at[p])])
    found = days.agg(F.collect_list(upper).alias("listed"), F.map_from_entries(F.collect_list(F.struct("day", lower))).alias("keyed"))

    def report(rows, day, scale, layer1):
        stats = F.create_map(F.lit("5"), F.struct((F.col("ic_mean") * scale).alias("mean"), F.col("ic_ir").alias("ir")))
        body = F.struct(
            F.struct("factor_name", F.lit(day).alias("analysis_date")).alias("meta"),
            F.struct(stats.alias("rank_ic")).alias("layer2_predictive"), F.struct(layer1.alias("daily_percentiles")).alias("layer1_quality"),
        )
        out = rows.join(F.broadcast(found), F.lit(True)).select(F.col("factor_name").alias("folder"), F.to_json(body).alias("value"))
        out.write.mode("append").partitionBy("folder").text(path)

    ends = F.col("factor_name").endswith("_20")
    report(ic.filter(ends), "2021-01-02", 1, F.col("keyed"))
    report(ic.filter(ends), "2020-01-02", 7, F.col("listed"))
    report(ic.filter(~ends), "2021-01-02", 1, F.col("listed"))
    report(ic.filter(~ends), "2020-01-02", 7, F.col("keyed"))
    return path


def _report_index(s, d):
    rows = reports.report_index(reports.read_report_documents(s, _written_reports(s, d)), (5,))
    return rows.select("factor_name", "analysis_date", "ic_rank_5_mean", "ic_rank_5_ir", *reports.PERCENTILES)


def _bars_on_disk(s, d):
    """Bars with a factor, a folder per symbol, read again."""
    path, f = shared_path(s, "bars-by-symbol"), make("Volatility")
    B.write_bars(with_factors(load_bars(s, d), [f]).df, path, min_rows=1550)
    return s.read.parquet(path).select("symbol", "date", "volume", c(f.name).alias("value"))


def _dimension(s, d):
    path = shared_path(s, "nations")
    rows = table(s, d, "nation").select(F.col("n_nationkey").alias("symbol"), "n_name", F.when(F.col("n_regionkey") < 2, " Yes ").otherwise("no").alias("enabled"))
    rows.write.option("header", True).csv(path)
    return B.read_dimension(s, path, enabled="enabled").select("symbol", "n_name")


def _report_files(s, d):
    """Nested rows as JSON reports and read again."""
    path = shared_path(s, "symbol-reports")
    rows = load_bars(s, d).df.groupBy("symbol").agg(F.struct(F.count(F.lit(1)).alias("n"), F.max("date").cast("string").alias("last")).alias("figures"), F.max(F.when(F.col("volume") > 150, F.col("volume"))).alias("peak"))
    B.write_report(rows, path)
    return B.read_reports(s, path).select("symbol", F.col("figures.n").alias("n"), "figures.last", F.col("peak").cast("double").alias("peak"))


def _tagged_logs(s, d):
    """Logs of runs in folders named by group and grid."""
    path = shared_path(s, "logs")
    number = F.regexp_extract("symbol", r"(\d+)", 1)
    rows = load_bars(s, d).df.groupBy(number.alias("brand"), F.year("date").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    rows.write.option("header", True).partitionBy("brand", "y").csv(path)
    return B.read_tagged_logs(s, path, r"brand=([^/]+)/y=(\d+)/", ["group", "grid"]).select("group", "grid", F.col("n").cast("long").alias("n"))


def _incremental(s, d):
    first = _corr_pairs(s, d, [("PriceReturn_20", "Volatility_20"), ("PriceReturn_20", "VolumeRatio_5"), ("Volatility_20", "VolumeRatio_5")])
    fs = [make("PriceReturn", window=20), make("Volatility"), make("VolumeRatio"), make("KaufmanER")]
    bars = with_factors(load_bars(s, d), fs)
    return X.update_pairs(bars, [f.name for f in fs], first, True, interval=5, min_assets=5, dates=ship_dates(s, d))


def _quarterly(s, d):
    """The noisy volatilities are scaled into the range of the bands."""
    f = make("Volatility")
    rows = with_factors(load_bars(s, d), [f]).df.select("symbol", "date", (c(f.name) * 0.15).alias("v"))
    return reports.quarterly_groups(rows, "v")


def _holdings(s, d):
    last = reports.latest_values(load_bars(s, d).df, ["value"])
    return last.join(_labels(s, d), "symbol").select("symbol", F.col("symbol").alias("name"), "cluster", "value")


def _add_list(s, d):
    bars = with_factors(load_bars(s, d), [make("ATR", window=14)])
    latest = reports.latest_values(bars.df, ["ATR_14"]).select("symbol", "ATR_14")
    labels = _labels(s, d)
    return reports.add_list(
        labels.filter("cluster <> 1"), labels.filter("cluster = 1"),
        _pairs(s, d, sides=(labels.filter("cluster <> 1"), labels.filter("cluster = 1"))), latest, labels, 100000.0, 0.01, "ATR_14", 2.0
    )


def oracle_sql() -> dict[str, str]:
    o = {f"meta_{k}": factor_sql(v, *st, digits=5) for k, (v, *st) in META_SQL.items()}
    cp = (CORR, BOTH, SYMS, LABELS)
    week = (
        "wk AS MATERIALIZED (SELECT symbol, CAST(date_trunc('week', date) AS DATE) AS date, arg_max(price, k) AS close FROM trades GROUP BY 1, 2)",
        "cw AS MATERIALIZED (SELECT * FROM wk WHERE date IN (SELECT date FROM wk GROUP BY date HAVING count(*) = (SELECT count(DISTINCT symbol) FROM wk)))",
    )
    o["universe_return_correlation"] = usql(f"SELECT a, b, {r('corr')} AS corr, n FROM cp", *cp)
    o["universe_common_window_correlation"] = usql(
        f"SELECT a.symbol AS a, b.symbol AS b, {r('corr(a.x, b.x)', 5)} AS corr, count(*) AS n FROM cx a JOIN cx b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2",
        *week,
        "cx AS (SELECT * FROM (SELECT symbol, date, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date) AS x FROM cw) WHERE x IS NOT NULL)",
    )
    o["universe_duplicate_pairs"] = usql(
        f"SELECT cp.a, cp.b, {r('any_value(corr)', 5)} AS corr, count(*) AS rows, {r('stddev_samp(y.close / x.close)', 5)} AS ratio_std FROM cp JOIN bars x ON x.symbol = cp.a"
        f" JOIN bars y ON y.symbol = cp.b AND y.date = x.date WHERE corr >= {THRESHOLD} GROUP BY cp.a, cp.b HAVING count(*) >= 100",
        *cp,
    )
    o["universe_components"] = usql("SELECT symbol, component FROM cm", *cp, *_components(f"corr >= {THRESHOLD}"))
    o["universe_merged_clusters"] = usql(
        f"SELECT component, representative, members, merged_indices, {r('mc')} AS max_corr FROM (SELECT component, arg_min(symbol, (f, symbol)) AS representative, string_agg(symbol, ',' ORDER BY symbol) AS members,"
        " array_to_string(list_sort(list(DISTINCT ix)), ',') AS merged_indices FROM cm JOIN (SELECT symbol, min(date) AS f FROM bars GROUP BY 1) USING (symbol)"
        " JOIN (SELECT p_brand AS symbol, min(p_type) AS ix FROM part GROUP BY 1) USING (symbol) GROUP BY component)"
        " JOIN (SELECT component, max(corr) AS mc FROM cp JOIN cm ON cm.symbol = cp.a WHERE corr >= 0.045 GROUP BY 1) USING (component)",
        *cp,
        *_components("corr >= 0.045"),
    )
    o["universe_matrix_report"] = usql(
        f"SELECT count(DISTINCT x.a) AS asset_count, {r('max(abs(x.corr - y.corr))')} AS symmetry_error, {r('max(CASE WHEN x.a = x.b THEN abs(x.corr - 1) END)')} AS diagonal_error,"
        f" {r('min(x.corr)')} AS min_correlation, {r('max(x.corr)')} AS max_correlation,"
        " count(y.a) = count(DISTINCT x.a) * count(DISTINCT x.a) AND max(abs(x.corr - y.corr)) <= 1e-8 AND max(CASE WHEN x.a = x.b THEN abs(x.corr - 1) END) <= 1e-8 AS is_valid"
        " FROM mt x LEFT JOIN mt y ON y.a = x.b AND y.b = x.a", *cp, "mt AS MATERIALIZED (SELECT a, b, corr FROM cb UNION ALL SELECT symbol, symbol, 1.0::DOUBLE FROM sy)"
    )
    o["universe_concentration"] = usql(
        f"SELECT {r('avg(corr)')} AS average_pairwise_correlation, {r('max(corr)')} AS max_pairwise_correlation, {r('min(corr)')} AS min_pairwise_correlation,"
        f" {r('(SELECT count(*) FROM sy) * (SELECT count(*) FROM sy) / ((SELECT count(*) FROM sy) + 2 * sum(corr * corr))')} AS effective_diversification_number FROM cp", *cp
    )
    powers = (
        "mr AS (SELECT x.symbol AS s, list(CASE WHEN x.symbol = y.symbol THEN 1.0 ELSE coalesce(cb.corr, 0.0) END ORDER BY y.symbol) AS r FROM sy x CROSS JOIN sy y LEFT JOIN cb ON cb.a = x.symbol AND cb.b = y.symbol GROUP BY 1)",
        "mx AS MATERIALIZED (SELECT list(r ORDER BY s) AS m, count(*) AS n FROM mr)",
        "pw AS (SELECT 0 AS k, list_transform(range(n), lambda i: 1.0::DOUBLE + i * 0.01) AS v, 0.0::DOUBLE AS top FROM mx UNION ALL"
        " SELECT k + 1, list_transform(y, lambda x: x / sqrt(list_dot_product(y, y))), sqrt(list_dot_product(y, y))"
        " FROM (SELECT k, list_transform(m, lambda r: list_dot_product(r, v)) AS y FROM pw CROSS JOIN mx WHERE k < 4000))",
        "tp AS (SELECT top / n AS share FROM pw CROSS JOIN mx WHERE k = 4000)",
    )
    o["universe_dominant_share"] = usql(f"SELECT {r('share')} AS dominant_eigenvalue_ratio FROM tp", *cp, *powers)
    o["universe_concentration_score"] = usql(
        f"SELECT {r('share')} AS dominant_eigenvalue_ratio, {r('share * (SELECT avg(corr) FROM cp)')} AS portfolio_concentration_score FROM tp", *cp, *powers
    )
    o["universe_threshold_clusters"] = usql(
        "SELECT sy.symbol, coalesce(component, sy.symbol) AS cluster FROM sy LEFT JOIN cm USING (symbol)", *cp, *_components("sqrt(greatest(1 - corr, 0)) < 0.98")
    )
    o["universe_neighbour_distances"] = usql(f"SELECT symbol, {r('k_dist')} AS k_dist FROM kd", *cp, *KD)
    o["universe_estimate_eps"] = usql(
        f"SELECT {r('d1')} AS eps FROM (SELECT p, lead(k_dist, 1) OVER w AS d1, lead(k_dist, 2) OVER w - 2 * lead(k_dist, 1) OVER w + k_dist AS bend FROM (SELECT *, row_number() OVER (ORDER BY k_dist, symbol) AS p FROM kd) WINDOW w AS (ORDER BY p)) WHERE bend IS NOT NULL ORDER BY bend DESC, p LIMIT 1",
        *cp, *KD,
    )
    o["universe_density_clusters"] = usql(
        "SELECT sy.symbol, coalesce(lc.cluster, bd.cluster) AS cluster, lc.symbol IS NOT NULL AS is_core FROM sy LEFT JOIN lc USING (symbol) LEFT JOIN bd USING (symbol)",
        *cp,
        f"nr AS MATERIALIZED (SELECT a, b FROM cb WHERE sqrt(greatest(1 - corr, 0)) <= {EPS})",
        "co AS MATERIALIZED (SELECT a AS symbol FROM nr GROUP BY a HAVING count(*) + 1 >= 4)",
        "ce AS MATERIALIZED (SELECT a, b FROM nr WHERE a IN (SELECT symbol FROM co) AND b IN (SELECT symbol FROM co))",
        *[x.format(src="ce") for x in COMPONENTS],
        "lc AS MATERIALIZED (SELECT co.symbol, coalesce(component, co.symbol) AS cluster FROM co LEFT JOIN cm USING (symbol))",
        "bd AS (SELECT nr.a AS symbol, min(lc.cluster) AS cluster FROM nr JOIN lc ON lc.symbol = nr.b WHERE nr.a NOT IN (SELECT symbol FROM co) GROUP BY nr.a)",
    )
    pairs_l = "pl AS MATERIALIZED (SELECT cb.*, x.cluster AS ga, y.cluster AS gb FROM cb JOIN lb x ON x.symbol = cb.a JOIN lb y ON y.symbol = cb.b)"
    o["universe_cluster_correlation"] = usql(
        f"SELECT CAST(ga AS BIGINT) AS ga, CAST(gb AS BIGINT) AS gb, {r('avg(corr)')} AS corr_mean, count(*) AS n_pairs FROM pl GROUP BY 1, 2", *cp, pairs_l
    )
    o["universe_cluster_medians"] = usql(
        f"SELECT CAST(ga AS BIGINT) AS ga, CAST(gb AS BIGINT) AS gb, {r('quantile_cont(corr, 0.5)')} AS corr_median FROM pl GROUP BY 1, 2", *cp, pairs_l
    )
    o["universe_cluster_stats"] = usql(
        f"SELECT CAST(c.cluster AS BIGINT) AS cluster, c.n AS n_symbols, {r('ia')} AS intra_corr_mean, {r('ie')} AS inter_corr_mean, {r('ia - ie')} AS corr_diff, u AS unique_index_count, di AS dominant_index,"
        f" {r('dn * 1.0 / c.n')} AS dominant_index_ratio, {r('sm * 1.0 / (c.n * (c.n - 1) / 2)')} AS same_index_pair_ratio FROM (SELECT cluster, count(*) AS n FROM lb GROUP BY 1) c"
        " JOIN (SELECT ga AS cluster, avg(corr) AS ia FROM pl WHERE ga = gb GROUP BY 1) USING (cluster)"
        " JOIN (SELECT cluster, avg(m) AS ie FROM (SELECT ga AS cluster, gb, avg(corr) AS m FROM pl WHERE ga <> gb GROUP BY 1, 2) GROUP BY 1) USING (cluster)"
        " JOIN (SELECT cluster, count(*) AS u, arg_max(ix, (n, ix)) AS di, max(n) AS dn, sum(n * (n - 1) / 2) AS sm FROM (SELECT cluster, ix, count(*) AS n FROM lb"
        " JOIN (SELECT p_brand AS symbol, min(p_type) AS ix FROM part GROUP BY 1) USING (symbol) GROUP BY 1, 2) GROUP BY 1) USING (cluster)",
        *cp, pairs_l,
    )
    summary = (
        pairs_l,
        "cs AS MATERIALIZED (SELECT *, 0.65 * i + 0.35 * u AS sc FROM (SELECT a AS symbol, any_value(ga) AS cluster, (sum(corr) + 1) / (count(*) + 1) AS u, avg(CASE WHEN ga = gb THEN corr END) AS i FROM pl GROUP BY a))",
    )
    o["universe_cluster_summary"] = usql(
        f"SELECT symbol, CAST(cluster AS BIGINT) AS cluster, {r('u')} AS avg_corr_to_universe, {r('i')} AS avg_corr_in_cluster, count(*) OVER (PARTITION BY cluster) AS cluster_size, {r('sc')} AS selection_score,"
        " row_number() OVER (PARTITION BY cluster ORDER BY sc, u, symbol) AS cluster_rank,"
        " CASE WHEN regexp_matches(name, 'ring|gear') THEN 'round' WHEN regexp_matches(name, 'red|blue') THEN 'coloured' WHEN contains(name, 'small') THEN 'little' ELSE 'diversified' END AS family"
        " FROM cs JOIN (SELECT p_brand AS symbol, min(p_name) AS name FROM part GROUP BY 1) USING (symbol)", *cp, *summary
    )
    o["universe_pair_table"] = usql(
        f"SELECT a AS left_symbol, b AS right_symbol, {r('corr')} AS correlation, corr < 0.02 AND corr > -0.05 AS passes_threshold FROM cp", *cp
    )
    o["universe_base_conflicts"] = usql(
        f"SELECT a AS symbol, coalesce(string_agg(CASE WHEN corr >= 0.02 THEN b END, ',' ORDER BY b), '') AS conflicts, {r('max(corr)')} AS max_base_corr, {r('min(corr)')} AS min_base_corr, count(CASE WHEN corr >= 0.02 THEN 1 END) = 0 AS compatible_with_base"
        " FROM cb WHERE b IN ('Brand#1', 'Brand#2') AND a NOT IN ('Brand#1', 'Brand#2') GROUP BY a", *cp
    )
    cliques = (
        "ok AS MATERIALIZED (SELECT a, b FROM cp WHERE corr < -0.01{extra})",
        "adj AS MATERIALIZED (SELECT b, list(a) AS bl FROM ok GROUP BY b)",
        "cl AS (SELECT [symbol] AS m, symbol AS z, 1 AS k FROM sy{where} UNION ALL SELECT list_append(cl.m, ok.b), ok.b, cl.k + 1 FROM cl JOIN ok ON ok.a = cl.z"
        " JOIN adj ON adj.b = ok.b WHERE len(list_intersect(cl.m, adj.bl)) = cl.k)",
        "best AS MATERIALIZED (SELECT m, array_to_string(m, ', ') AS id FROM cl WHERE k = (SELECT max(k) FROM cl))",
    )
    o["universe_compatible_sets"] = usql(
        "SELECT array_to_string(m, ',') AS members FROM best", *cp, *[x.format(extra="", where="") for x in cliques]
    )
    free = " NOT IN ('Brand#1', 'Brand#2')"
    o["universe_combo_summary"] = usql(
        f"SELECT len(m) + 2 AS symbol_count, {r('av', 4)} AS avg_pairwise_correlation, {r('mx', 4)} AS max_pairwise_correlation, {r('mn', 4)} AS min_pairwise_correlation,"
        f" {r('ev', 4)} AS extension_avg_value, {r('et', 4)} AS extension_total_avg_value, 'Brand#1, Brand#2, ' || id AS symbols_text FROM best"
        " JOIN (SELECT x.id, avg(corr) AS av, max(corr) AS mx, min(corr) AS mn FROM em x JOIN em y ON x.id = y.id JOIN cp ON cp.a = x.e AND cp.b = y.e GROUP BY 1) USING (id)"
        " JOIN (SELECT id, avg(avg_value) AS ev, sum(avg_value) AS et FROM (SELECT id, unnest(m) AS symbol FROM best) JOIN pf USING (symbol) GROUP BY 1) USING (id)",
        *cp, PROFILE, *[x.format(extra=f" AND a{free} AND b{free}", where=f" WHERE symbol{free}") for x in cliques],
        "em AS MATERIALIZED (SELECT id, unnest(list_concat(['Brand#1', 'Brand#2'], m)) AS e FROM best)",
    )
    o["text_normalize"] = f"WITH {FUNDS} SELECT id, {NORM.format(x='name')} AS normal FROM fu"
    o["text_tracked_index"] = (
        f"WITH {FUNDS}, lf AS (SELECT id, trim(split_part(replace(replace(trim(name), '（', '('), '）', ')'), 'ETF', 1)) AS l FROM fu)"
        " SELECT id, trim(regexp_replace(l, '^(?:ECONOMY LINE|STANDARD|ECONOMY|Brand#1|MEDIUM|LARGE|PROMO|SMALL)', '')) AS index_name FROM lf"
    )
    o["text_tokens"] = (
        f"WITH {FUNDS}, nm AS (SELECT id, {NORM.format(x='name')} AS n FROM fu)"
        " SELECT id, array_to_string(list_sort(list_distinct(list_concat(list_concat(list_filter(['red', 'blue', 'small', 'ring', 'widget', 'gear'], lambda k: contains(n, k)),"
        " regexp_extract_all(upper(n), '[A-Za-z]+\\d*|\\d+[A-Za-z]*')), regexp_extract_all(n, '\\d+')))), '|') AS tokens FROM nm"
    )
    o["text_keywords"] = (
        f"WITH {FUNDS}, nm AS (SELECT id, {NORM.format(x='name')} AS n FROM fu)"
        " SELECT id, array_to_string(list_filter(['red', 'blue', 'small', 'ring', 'widget', 'gear'], lambda k: contains(n, k)), '|') AS keywords FROM nm"
    )
    o["text_family"] = (
        "SELECT p_partkey AS id, CASE WHEN regexp_matches(p_name, 'ring|gear') THEN 'round' WHEN regexp_matches(p_name, 'red|blue') THEN 'coloured'"
        " WHEN contains(p_name, 'small') THEN 'little' ELSE 'diversified' END AS family FROM part"
    )
    code = "CASE WHEN length(CAST(o_orderkey * 37 AS VARCHAR)) < 6 THEN lpad(CAST(o_orderkey * 37 AS VARCHAR), 6, '0') ELSE CAST(o_orderkey * 37 AS VARCHAR) END"
    o["text_market"] = (
        f"SELECT o_orderkey, code, CASE WHEN code LIKE '6%' THEN 'SH' ELSE 'SZ' END AS market, left(code, 1) NOT IN ('2', '4', '8', '9') AS a_share FROM (SELECT o_orderkey, {code} AS code FROM orders)"
    )
    o["text_dedupe_names"] = (
        "SELECT symbol, name FROM (SELECT p_brand AS symbol, p_name AS name, row_number() OVER (PARTITION BY p_brand ORDER BY contains(p_name, 'widget') DESC, length(p_name) DESC, p_name DESC) AS n FROM part) WHERE n = 1"
    )
    o["text_merge_listings"] = (
        "SELECT DISTINCT p_brand AS symbol, p_brand AS name, DATE '1990-01-02' AS list_date, CASE WHEN CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 3 = 0 THEN DATE '1998-06-30' END AS delist_date FROM part"
    )
    o["text_symbol_profile"] = usql(
        f"SELECT symbol, bar_count, {r('avg_value', 3)} AS avg_value, first_date, last_date, name, array_to_string(kw, '|') AS matched_keywords FROM pf", PROFILE
    )
    reps = (
        PROFILE,
        "ek AS (SELECT unnest(kw) AS keyword, symbol, bar_count, avg_value FROM pf WHERE bar_count > 600)",
        "kr AS MATERIALIZED (SELECT keyword, count(*) AS candidate_count, arg_min(symbol, (-avg_value, -bar_count, symbol)) AS selected_symbol, arg_min(bar_count, (-avg_value, -bar_count, symbol)) AS bar_count,"
        " arg_min(avg_value, (-avg_value, -bar_count, symbol)) AS avg_value FROM ek GROUP BY keyword)",
    )
    o["text_keyword_representatives"] = usql(
        f"SELECT keyword, candidate_count, selected_symbol, bar_count, {r('avg_value', 4)} AS avg_value FROM kr", *reps
    )
    o["text_representative_symbols"] = usql(
        f"SELECT selected_symbol AS symbol, {r('max(avg_value)', 4)} AS avg_value, max(bar_count) AS bar_count, string_agg(keyword, '|' ORDER BY keyword) AS source_keywords, count(*) AS source_keyword_count FROM kr GROUP BY 1", *reps
    )
    o["text_best_per_index"] = usql(
        "SELECT ix AS index_name, arg_min(symbol, (f, -v, symbol)) AS symbol, min(f) AS first_date, string_agg(symbol, ',' ORDER BY symbol) AS candidates, count(*) AS candidate_count FROM"
        " (SELECT DISTINCT p_brand AS symbol, p_type AS ix FROM part) JOIN (SELECT symbol, min(date) AS f FROM bars GROUP BY 1) USING (symbol)"
        " JOIN (SELECT symbol, avg(value) AS v FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM bars) WHERE n <= 20 GROUP BY 1) USING (symbol) GROUP BY ix"
    )
    o["text_tracked_indices"] = (
        "SELECT symbol, string_agg(ix, ',' ORDER BY ix) AS tracked_indices FROM (SELECT DISTINCT p_brand AS symbol, p_type AS ix FROM part) GROUP BY symbol"
    )
    o["bars_daily"] = usql(f"SELECT symbol, date, open, high, low, close, volume, {r('value', 2)} AS value FROM bars")
    o["bars_daily_change"] = usql(
        f"SELECT symbol, date, {r('(close / pc - 1) * 100')} AS gain, {r('(high - low) / pc * 100')} AS range, {r('volume / sum(volume) OVER (PARTITION BY symbol)')} AS \"turnOver\" FROM s0"
    )
    o["bars_normalize"] = usql(f"SELECT symbol, date, open, high, low, close, volume, {r('value', 2)} AS value FROM bars WHERE month(date) <> 2")
    o["bars_normalize_price"] = usql("SELECT symbol, date, open, close, volume FROM bars WHERE month(date) <> 3")
    o["bars_keep_last"] = usql("SELECT symbol, date, close AS price FROM bars")
    o["bars_upsert"] = usql(
        "SELECT symbol, date, CASE WHEN month(date) >= 6 AND month(date) % 2 = 0 THEN open + 1 WHEN month(date) <= 9 THEN open END AS open,"
        " CASE WHEN month(date) >= 6 THEN close WHEN month(date) % 3 <> 0 THEN close END AS close, CASE WHEN month(date) <= 9 THEN volume END AS volume FROM bars"
    )
    o["bars_concat_history"] = usql(
        "SELECT symbol, date, CASE WHEN month(date) >= 6 THEN CASE WHEN month(date) % 2 = 0 THEN open + 1 END ELSE open END AS open,"
        " CASE WHEN month(date) >= 6 THEN close WHEN month(date) % 3 <> 0 THEN close END AS close FROM bars"
    )
    o["bars_vendor_units"] = usql(
        f"SELECT symbol, date, {r('volume * 1e4', -3)} AS volume, {r('value * 1e8', -3)} AS value, CAST(NULL AS DOUBLE) AS \"turnOver\" FROM bars"
    )
    o["bars_feed_frame"] = usql(f"SELECT symbol, date, {r('coalesce(' + full('stddev_samp', 'ret', 20) + ', 0)')} AS \"Volatility_20\" FROM s0")
    o["bars_date_slices"] = (
        "SELECT o_custkey, s AS start, e AS \"end\", CAST(x AS DATE) AS slice_start, least(CAST(x AS DATE) + 364, e) AS slice_end FROM (SELECT *, unnest(generate_series(s, e, INTERVAL 365 DAY)) AS x FROM"
        " (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS s, CAST(max(o_orderdate) AS DATE) AS e FROM orders GROUP BY 1))"
    )
    o["bars_freshness"] = usql(
        "SELECT y.symbol, l IS NOT NULL AS exists, l AS last_date, coalesce(l >= DATE '2001-10-30', FALSE) AS is_updated FROM (SELECT DISTINCT p_brand AS symbol FROM part UNION SELECT n_name FROM nation) y"
        " LEFT JOIN (SELECT symbol, max(date) AS l FROM bars GROUP BY 1) USING (symbol)"
    )
    o["bars_newest_file"] = (
        "SELECT code, path, last_date FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY last_date DESC, path DESC) AS n FROM (SELECT p_brand AS code, p_type || '/' || p_brand AS path, max(CAST(l_shipdate AS DATE)) AS last_date"
        " FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)) WHERE n = 1"
    )
    days = "cal AS (SELECT DISTINCT date FROM bars)"
    o["join_common_dates"] = usql("SELECT symbol, date FROM cw", *week)
    o["join_aligned_calendar"] = usql(
        "SELECT symbol, date, coalesce(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING),"
        " first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close"
        " FROM sy CROSS JOIN (SELECT date FROM cal ORDER BY date DESC LIMIT 60) d LEFT JOIN bars USING (symbol, date)",
        SYMS, days,
    )
    o["join_active_on"] = usql("SELECT symbol, date FROM bars WHERE CAST(regexp_extract(symbol, '(\\d+)', 1) AS INT) % 3 <> 0 OR date < DATE '1998-06-30'")
    o["join_last_days"] = usql("SELECT date FROM cal WHERE date < DATE '2000-01-01' ORDER BY date DESC LIMIT 30", days)
    o["join_trading_days_only"] = usql("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT date FROM cal)", days)
    o["join_lookup_names"] = usql(
        "SELECT symbol, date, CASE WHEN cluster > 0 THEN CAST(cluster AS BIGINT) ELSE -1 END AS cluster FROM bars JOIN lb USING (symbol)", SYMS, LABELS
    )
    o["join_name_cells"] = usql(
        "SELECT ix AS index_name, string_agg(name, ',' ORDER BY symbol) AS names FROM (SELECT DISTINCT p_brand AS symbol, p_type AS ix FROM part) JOIN pf USING (symbol) GROUP BY ix", PROFILE
    )
    o["join_held"] = usql("SELECT symbol, date FROM bars JOIN lb USING (symbol) WHERE cluster = 1", SYMS, LABELS)
    o["join_not_held"] = usql("SELECT symbol, date FROM bars JOIN lb USING (symbol) WHERE cluster <> 1", SYMS, LABELS)
    o["join_keep_symbols"] = usql("SELECT symbol, date FROM bars WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 1550)")
    o["join_keep_where_any"] = (
        "WITH t AS MATERIALIZED (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"
        " SELECT symbol, date FROM t WHERE symbol IN (SELECT symbol FROM t WHERE v > 150)"
    )
    o["join_symbol_predicate"] = usql("SELECT symbol, count(*) > 1550 AND max(volume) > 150 AS keep, CAST(NULL AS VARCHAR) AS error FROM bars GROUP BY symbol")
    o["join_parameter_grid"] = usql(
        f"SELECT symbol, CAST(k AS BIGINT) AS k, {r('avg(close * w)', 4)} AS m FROM bars CROSS JOIN (VALUES (1, 0.5::DOUBLE), (2, 1.5::DOUBLE)) g(k, w) GROUP BY 1, 2"
    )
    pc = f"a, b, {rounds('mean_corr', 'std_corr')}, n_dates FROM"
    o["corr_high_pairs"] = _corr_sql(f"SELECT {pc} pc WHERE abs(pc.mean_corr) >= 0.05")
    o["corr_low_pairs"] = _corr_sql(f"SELECT {pc} pc WHERE abs(pc.mean_corr) < 0.05")
    o["corr_lookup"] = _corr_sql(
        f"SELECT {pc} (SELECT * FROM pc UNION ALL SELECT b, a, mean_corr, std_corr, n_dates FROM pc) x WHERE a = 'VolumeRatio_5' AND abs(x.mean_corr) >= 0.01"
    )
    o["corr_store_changed_factor"] = o["corr_store_changed_bars"] = _corr_sql(f"SELECT {pc} pc")
    o["corr_incremental_update"] = _corr_sql(f"SELECT {pc} pc")
    fnames = {"PriceReturn_20": "f1", "Volatility_20": "f2", "VolumeRatio_5": "f3", "KaufmanER_20": "f4"}
    stacked = " UNION ALL ".join(f"SELECT symbol, date, t, '{n}' AS factor_name, {x} AS x, close FROM z" for n, x in fnames.items())
    o["report_catalogue"] = _corr_sql(
        f"SELECT factor_name, {r('avg(ic)')} AS ic_mean, {r('avg(ic) / stddev_samp(ic)')} AS ic_ir FROM (SELECT factor_name, date, CASE WHEN count(*) >= 5 THEN corr(rx, ry) END AS ic FROM"
        " (SELECT *, rank() OVER (PARTITION BY factor_name, date ORDER BY x) + (count(*) OVER (PARTITION BY factor_name, date, x) - 1) / 2.0 AS rx,"
        " rank() OVER (PARTITION BY factor_name, date ORDER BY y) + (count(*) OVER (PARTITION BY factor_name, date, y) - 1) / 2.0 AS ry FROM"
        f" (WITH z AS (SELECT cf.*, t, bars.close FROM cf JOIN cal USING (date) JOIN bars USING (symbol, date)), st AS ({stacked})"
        " SELECT st.factor_name, st.date, st.x, n.close / st.close - 1 AS y FROM st JOIN z n ON n.symbol = st.symbol AND n.t = st.t + 5 WHERE st.x IS NOT NULL)) GROUP BY 1, 2)"
        " WHERE contains(lower(factor_name), 'vol') GROUP BY 1"
    )
    o["bars_written"] = usql(f"SELECT symbol, date, volume, {r(full('stddev_samp', 'ret', 20))} AS value FROM s0 WHERE symbol IN (SELECT symbol FROM bars GROUP BY 1 HAVING count(*) >= 1550)")
    o["bars_dimension"] = "SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS symbol, n_name FROM nation WHERE n_regionkey < 2"
    o["report_files"] = usql("SELECT symbol, count(*) AS n, CAST(max(date) AS VARCHAR) AS last, CAST(max(CASE WHEN volume > 150 THEN volume END) AS DOUBLE) AS peak FROM bars GROUP BY symbol")
    o["report_tagged_logs"] = usql("SELECT regexp_extract(symbol, '(\\d+)', 1) AS \"group\", CAST(year(date) AS VARCHAR) AS grid, count(*) AS n FROM bars GROUP BY 1, 2")
    marks = {"p5": 0.05, "p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95}
    both = {p: p if p in ("p25", "p50", "p75") else f"CASE WHEN {'NOT ' if p in ('p5', 'p95') else ''}ends_with(factor_name, '_20') THEN {p} END" for p in marks}
    o["report_index"] = (
        f"WITH {BARS},\npy AS (SELECT {', '.join(f'quantile_cont(close, {x}) AS {p}' for p, x in marks.items())} FROM bars GROUP BY year(date)),\n"
        f"pm AS (SELECT {', '.join(f'avg({p}) AS {p}' for p in marks)} FROM py)\n"
        f"SELECT factor_name, '2021-01-02' AS analysis_date, ic_mean AS ic_rank_5_mean, ic_ir AS ic_rank_5_ir, {', '.join(f'{r(x)} AS {p}' for p, x in both.items())} FROM ("
        + o["report_catalogue"].replace(" WHERE contains(lower(factor_name), 'vol') GROUP BY 1", " GROUP BY 1")
        + ") CROSS JOIN pm"
    )
    from .strategy import SCALED, timing_sql

    o["report_compare_strategies"] = timing_sql(
        "SELECT strategy, n AS symbols_total, n AS symbols_valid, 1.0::DOUBLE AS coverage,"
        f" {r('i', 4)} AS information_ratio_mean, {r('im', 4)} AS information_ratio_median, {r('e', 4)} AS excess_cumulative_return_mean, {r('em', 4)} AS excess_cumulative_return_median,"
        f" {r('m', 4)} AS max_drawdown_pct_mean, {r('mm', 4)} AS max_drawdown_pct_median, {r('w', 4)} AS win_rate_mean,"
        f" {r('0.5 * zi + 0.35 * ze - 0.1 * zm + 0.05 * zw', 4)} AS composite_score, {r('wm', 4)} AS win_rate_median, row_number() OVER (ORDER BY 0.5 * zi + 0.35 * ze - 0.1 * zm + 0.05 * zw DESC, strategy) AS rank FROM (SELECT *,"
        " (i - avg(i) OVER ()) / stddev_pop(i) OVER () AS zi, (e - avg(e) OVER ()) / stddev_pop(e) OVER () AS ze, (m - avg(m) OVER ()) / stddev_pop(m) OVER () AS zm, (w - avg(w) OVER ()) / stddev_pop(w) OVER () AS zw FROM"
        " (SELECT strategy, avg(ir) AS i, avg(ex) AS e, avg(dd) AS m, avg(wr) AS w, quantile_cont(wr, 0.5) AS wm, quantile_cont(ir, 0.5) AS im, quantile_cont(ex, 0.5) AS em, quantile_cont(dd, 0.5) AS mm, count(*) AS n FROM (SELECT strategy, symbol, product(1 + ret) AS grown,"
        " avg(CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END) AS wr, abs(min(eq / pk - 1)) * 100 AS dd FROM (SELECT *, max(eq) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS pk FROM"
        " (SELECT *, product(1 + ret) OVER (PARTITION BY strategy, symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS eq FROM xs)) GROUP BY 1, 2) JOIN (SELECT strategy, symbol, (pow(product(1 + xs.ret - b1.ret), 252.0 / count(*)) - 1) / (stddev_samp(xs.ret - b1.ret) * sqrt(252)) AS ir, product(1 + b1.ret) AS bg FROM xs JOIN b1 USING (date) GROUP BY 1, 2) USING (strategy, symbol)"
        " CROSS JOIN LATERAL (SELECT grown / bg - 1 AS ex) GROUP BY 1))",
        *SCALED,
        "xs AS (SELECT symbol, date, 'full' AS strategy, ret * 0.01 AS ret FROM sr UNION ALL SELECT symbol, date, 'half', ret * 0.005 FROM sr UNION ALL SELECT symbol, date, 'inverse', ret * -0.01 FROM sr)",
    )
    trend = (
        "tv AS (SELECT symbol, date, CASE WHEN count(ret) OVER w = 20 THEN stddev_samp(ret) OVER w END AS value FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING))",
        "tb AS (SELECT * FROM tv WHERE symbol = 'Brand#7' AND date >= (SELECT max(date) FROM tv WHERE symbol = 'Brand#7') - 365)",
    )
    o["report_trend"] = usql(f"SELECT symbol, date, {r('value')} AS value FROM tb", *trend)
    o["report_trend_stats"] = usql(
        f"SELECT symbol, count(value) AS n, {r('avg(value)')} AS mean, {r('stddev_pop(value)')} AS std, {r('min(value)')} AS min, {r('max(value)')} AS max, {r('arg_max(value, date)')} AS latest FROM tb GROUP BY symbol", *trend
    )
    o["report_volatility_snapshot"] = usql(
        f"SELECT symbol, f AS first_date, l AS last_date, n AS bar_count, {r('v')} AS volatility, CASE WHEN v IS NULL THEN 'insufficient_history' ELSE 'ok' END AS status, {r('rank() OVER (ORDER BY v) * 1.0 / count(v) OVER ()')} AS vol_pct_rank FROM"
        " (SELECT symbol, min(date) AS f, max(date) AS l, count(*) AS n, arg_max(v, date) FILTER (v IS NOT NULL) AS v FROM (SELECT symbol, date, CASE WHEN count(ret) OVER w = 252 THEN stddev_samp(ret) OVER w * sqrt(252) END AS v"
        " FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)) GROUP BY symbol)"
    )
    quarters = (
        trend[0],
        "qe AS (SELECT max(date) AS date FROM tv GROUP BY date_trunc('quarter', date))",
        "qg AS (SELECT * FROM (SELECT symbol, date AS as_of, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH AS DATE) AS applies_from, value * 0.15 AS v, CASE WHEN value * 0.15 >= 0 AND value * 0.15 < 0.06 THEN 'bond' WHEN value * 0.15 < 0.2 THEN 'low'"
        " WHEN value * 0.15 < 0.36 THEN 'mid' WHEN value * 0.15 < 1 THEN 'high' END AS g FROM tv JOIN qe USING (date)) WHERE g IS NOT NULL)",
    )
    o["report_quarterly_groups"] = usql(f"SELECT symbol, as_of, applies_from, {r('v')} AS value, g AS \"group\" FROM qg", *quarters)
    o["report_quarterly_wide"] = usql(
        "SELECT symbol, max(CASE WHEN applies_from = DATE '1996-07-01' THEN g END) AS q1, max(CASE WHEN applies_from = DATE '1999-01-01' THEN g END) AS q2 FROM qg GROUP BY symbol", *quarters
    )
    o["report_holdings_by_cluster"] = usql(
        f"SELECT CAST(cluster AS BIGINT) AS cluster, {r('sum(v)', 4)} AS value, {r('sum(v) / sum(sum(v)) OVER ()', 4)} AS share, count(*) AS n, string_agg(symbol, ',' ORDER BY symbol) AS names FROM lb JOIN (SELECT symbol, arg_max(value, date) AS v FROM bars GROUP BY 1) USING (symbol) GROUP BY cluster",
        SYMS, LABELS,
    )
    o["report_add_list"] = usql(
        f"SELECT CAST(x.cluster AS BIGINT) AS cluster, x.symbol, {r('avg(corr)')} AS mean_corr, {r('max(corr)')} AS max_corr, {r('any_value(v)')} AS \"ATR_14\", {r('any_value(1000.0 / (v * 2))')} AS size, TRUE AS new_cluster FROM lb x"
        " JOIN cb ON cb.a = x.symbol JOIN lb y ON y.symbol = cb.b AND y.cluster = 1"
        " JOIN (SELECT symbol, arg_max(v, date) AS v FROM (SELECT symbol, date, CASE WHEN count(tr) OVER w = 14 THEN avg(tr) OVER w END AS v FROM s0 WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 13 PRECEDING)) GROUP BY 1) t ON t.symbol = x.symbol"
        " WHERE x.cluster <> 1 GROUP BY x.cluster, x.symbol",
        *cp,
    )
    o["report_latest_values"] = usql("SELECT symbol, max(date) AS date, arg_max(close, date) AS close, arg_max(volume, date) AS volume FROM bars GROUP BY symbol")
    o["report_recent_signals"] = _recent_sql()
    o["ticks_to_bars"] = (
        f"SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS start, {r('arg_min(value, (ts, event_id))', 4)} AS open, {r('max(value)', 4)} AS high, {r('min(value)', 4)} AS low, {r('arg_max(value, (ts, event_id))', 4)} AS close,"
        f" {r('count(*)', 4)} AS volume, {r('sum(value)', 4)} AS value FROM events WHERE value > 0 GROUP BY user_id, CAST(ts AS DATE)"
    )
    o["meta_expansion"] = _expansion_sql()
    o["bars_store_upsert"], o["ticks_stream_store"] = o["bars_upsert"], o["ticks_to_bars"]
    o["ticks_signal_stream"] = (
        f"SELECT symbol, date, {r('(close - lag(close, 5) OVER w) / lag(close, 5) OVER w')} AS signal FROM (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close"
        " FROM events WHERE value > 0 GROUP BY 1, 2) WHERE date + INTERVAL 1 DAY <= (SELECT max(ts) FROM events WHERE value > 0) - INTERVAL 1 DAY WINDOW w AS (PARTITION BY symbol ORDER BY date)"
    )
    o["ticks_latest_signal"] = (
        f"SELECT symbol, date, {r('x')} AS signal FROM (SELECT symbol, date, (close - lag(close, 5) OVER w) / lag(close, 5) OVER w AS x, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n"
        " FROM (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(ts AS DATE) AS date, arg_max(value, (ts, event_id)) AS close FROM events WHERE value > 0 GROUP BY 1, 2) WINDOW w AS (PARTITION BY symbol ORDER BY date)) WHERE n = 1"
    )
    return o


def _recent_sql() -> str:
    from .factors import _RSRS, _RSRS_SIGNAL

    ctes, name = staged(*_RSRS, _RSRS_SIGNAL)
    return (
        f"WITH {BARS},\n{S0}{ctes},\n{SYMS},\n{LABELS}\nSELECT symbol, l AS last_date, a AS action FROM (SELECT symbol, max(date) AS l, CASE WHEN max(CAST(n = 1 AND sig = -1 AS INT)) = 1 AND max(cluster) < 2 THEN 'sell'"
        f" WHEN max(CAST(sig = 1 AS INT)) = 1 THEN 'add' END AS a FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS n FROM {name}) JOIN lb USING (symbol) WHERE n <= 5 GROUP BY symbol) WHERE a IS NOT NULL"
    )
