"""Queries over factor results: catalogue, trends, snapshots, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.factor import Factor, with_factors
from ..functions.frames import Bars
from ..functions.scalar import c, div
from .crosssection import avg_rank


def query_catalogue(
    catalogue: DataFrame, ic: str = "ic_mean", icir: str = "ic_ir", ic_min=None, ic_max=None,
    icir_min=None, icir_max=None, search: str | None = None, sort_by: str = "ic_ir",
    descending: bool = True, page: int = 1, page_size: int = 50,
) -> DataFrame:
    """Factors by IC range and name, sorted, one page. Missing values sort last."""
    out = catalogue
    for col, lo, hi in ((ic, ic_min, ic_max), (icir, icir_min, icir_max)):
        if lo is not None:
            out = out.filter(c(col) >= lo)
        if hi is not None:
            out = out.filter(c(col) <= hi)
    if search:
        out = out.filter(F.contains(F.lower("factor_name"), F.lit(search.lower())))
    order = c(sort_by).desc_nulls_last() if descending else c(sort_by).asc_nulls_last()
    return out.orderBy(order, "factor_name").offset((page - 1) * page_size).limit(page_size)


def factor_trend(bars: Bars, factor: Factor, symbol: str, days: int = 365, end=None) -> DataFrame:
    """One symbol's factor values over its last days.

    The symbol filter reaches the scan; where the bars lie in a folder per symbol
    (`write_bars`), only that folder is read. The factor needs the days before the
    first one asked for, so the history is not cut.
    """
    one = with_factors(bars.with_df(bars.df.filter(F.col("symbol") == symbol)), [factor]).df
    rows = one.select("symbol", "date", c(factor.name).alias("value"))
    if end is None:
        last = rows.agg(F.max("date").alias("__end"))
        rows = rows.join(F.broadcast(last), F.lit(True))
    else:
        rows = rows.withColumn("__end", F.to_date(F.lit(end)))
    inside = (F.col("date") <= F.col("__end")) & (F.col("date") >= F.date_sub("__end", days))
    return rows.filter(inside).drop("__end")


def trend_stats(trend: DataFrame) -> DataFrame:
    return trend.groupBy("symbol").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date"))).alias("latest"),
    )


def recent_signals(bars: Bars, signal: str, holdings: DataFrame | None = None, last: int = 5) -> DataFrame:
    """add: signal 1 within the last bars; sell: held and signal -1 on the last bar."""
    back = W.partitionBy("symbol").orderBy(F.col("date").desc())
    rows = bars.df.select("symbol", "date", signal).withColumn("__r", F.row_number().over(back))
    rows = rows.filter(F.col("__r") <= last)
    per = rows.groupBy("symbol").agg(
        F.max((c(signal) == 1).cast("int")).alias("__buy"),
        F.max(((F.col("__r") == 1) & (c(signal) == -1)).cast("int")).alias("__sell"),
        F.max("date").alias("last_date"),
    )
    if holdings is not None:
        own = holdings.select("symbol").distinct().withColumn("__own", F.lit(1))
        per = per.join(own, "symbol", "left")
    else:
        per = per.withColumn("__own", F.lit(1))
    action = F.when((F.col("__sell") == 1) & (F.col("__own") == 1), "sell").when(F.col("__buy") == 1, "add")
    return per.select("symbol", "last_date", action.alias("action")).filter(F.col("action").isNotNull())


def volatility_snapshot(bars: Bars, factor: Factor) -> DataFrame:
    """Latest volatility per symbol, its share of rank and a status code."""
    computed = with_factors(bars, [factor]).df
    value = c(factor.name)
    per = computed.groupBy("symbol").agg(
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count(F.lit(1)).alias("bar_count"),
        F.max_by(value, F.when(value.isNotNull(), F.col("date"))).alias("volatility"),
    )
    status = F.when(F.col("volatility").isNull(), "insufficient_history").otherwise("ok")
    per = per.withColumns({"status": status, "__all": F.lit(1)})
    return avg_rank(per, ["__all"], "volatility", "vol_pct_rank", bars.symbols_fit, pct=True).drop("__all")


# Volatility bands, lower bound included.
VOLATILITY_BANDS = ((0.00, 0.06, "bond"), (0.06, 0.20, "low"), (0.20, 0.36, "mid"), (0.36, 1.00, "high"))


def quarterly_groups(values: DataFrame, value: str, bands=VOLATILITY_BANDS) -> DataFrame:
    """Band of each symbol on the last date of a quarter, valid for the next
    quarter; values outside all bands give no row."""
    quarter = F.to_date(F.date_trunc("quarter", "date"))
    dates = values.select("date").distinct().withColumn("quarter", quarter)
    ends = dates.groupBy("quarter").agg(F.max("date").alias("date"))
    label = F.lit(None).cast("string")
    for lo, hi, name in bands:
        label = F.when((c(value) >= lo) & (c(value) < hi), name).otherwise(label)
    rows = values.join(F.broadcast(ends), "date").withColumn("group", label)
    return rows.filter(F.col("group").isNotNull()).select(
        "symbol",
        F.col("date").alias("as_of"),
        F.to_date(F.add_months("quarter", 3)).alias("applies_from"),
        c(value).alias("value"),
        "group",
    )


def quarterly_groups_wide(groups: DataFrame, quarters: Sequence) -> DataFrame:
    """One row per symbol, one column per quarter."""
    return groups.groupBy("symbol").agg(
        *[
            F.max(F.when(F.col("applies_from") == F.to_date(F.lit(str(q))), F.col("group"))).alias(str(q))
            for q in quarters
        ]
    )


# Metric, weight and whether higher is better.
COMPARISON_METRICS = (
    ("information_ratio", 0.50, True),
    ("excess_cumulative_return", 0.35, True),
    ("max_drawdown_pct", 0.10, False),
    ("win_rate", 0.05, True),
)


def compare_strategies(
    rows: DataFrame, metrics: Sequence[tuple[str, float, bool]] = COMPARISON_METRICS
) -> DataFrame:
    """Rank strategies by a weighted sum of z-scores of their mean metrics plus
    0.05 times the z-score of coverage.

    rows: (strategy, symbol, metric columns..., error). Rows with an error count
    as not covered. One row per strategy remains, so the final windows are over
    the list of strategies.
    """
    total = sum(max(w, 0.0) for _, w, _ in metrics)
    if total <= 0:
        raise ValueError("at least one weight must be positive")
    valid = c("error").isNull() if "error" in rows.columns else F.lit(True)
    for m, _, _ in metrics:
        rows = rows.withColumn(m, F.when(valid, c(m)))
    aggs = [F.count(F.lit(1)).alias("symbols_total"), F.sum(valid.cast("long")).alias("symbols_valid")]
    for m, _, _ in metrics:
        aggs += [F.avg(c(m)).alias(f"{m}_mean"), F.percentile(c(m), F.lit(0.5)).alias(f"{m}_median")]
    stats = rows.groupBy("strategy").agg(*aggs)
    stats = stats.withColumn("coverage", F.coalesce(div("symbols_valid", "symbols_total"), F.lit(0.0)))
    every = W.partitionBy()

    def z(x: str):
        sd = F.stddev_pop(x).over(every)
        return F.coalesce(div(F.col(x) - F.avg(x).over(every), sd), F.lit(0.0))

    score = 0.05 * z("coverage")
    for m, weight, higher in metrics:
        score = score + (max(weight, 0.0) / total) * (z(f"{m}_mean") if higher else -z(f"{m}_mean"))
    stats = stats.withColumn("composite_score", score)
    order = [F.col("composite_score").desc(), F.col("coverage").desc(), F.col("symbols_valid").desc(), F.col("strategy")]
    return stats.withColumn("rank", F.row_number().over(W.orderBy(*order)))


def holdings_by_cluster(holdings: DataFrame) -> DataFrame:
    """(symbol, name, cluster, value) to share, count and names per cluster."""
    total = holdings.agg(F.sum("value").alias("__t"))
    per = holdings.groupBy("cluster").agg(
        F.sum("value").alias("value"),
        F.count(F.lit(1)).alias("n"),
        F.concat_ws(",", F.sort_array(F.collect_list("name"))).alias("names"),
    )
    return per.join(F.broadcast(total), F.lit(True)).select(
        "cluster", "value", div("value", "__t").alias("share"), "n", "names"
    )


def add_list(
    candidates: DataFrame, holdings: DataFrame, pairs: DataFrame, latest: DataFrame, clusters: DataFrame,
    money: float, tolerance: float, atr: str, k: float = 1.0,
) -> DataFrame:
    """Candidates with their correlation to the holdings, an ATR-based size,
    the latest factor values and whether their cluster is new."""
    from .pairs import both_ways

    own = holdings.select(F.col("symbol").alias("b")).distinct()
    near = (
        both_ways(pairs.select("a", "b", "corr"))
        .join(own, "b", "left_semi")
        .groupBy(F.col("a").alias("symbol"))
        .agg(F.avg("corr").alias("mean_corr"), F.max("corr").alias("max_corr"))
    )
    taken = holdings.select("symbol").join(clusters, "symbol").select("cluster").distinct().withColumn("__t", F.lit(1))
    out = candidates.select("symbol").distinct().join(near, "symbol", "left").join(latest, "symbol", "left")
    out = out.join(clusters, "symbol", "left").join(taken, "cluster", "left")
    size = div(F.lit(money * tolerance), c(atr) * k)
    return out.withColumns({"size": size, "new_cluster": F.col("__t").isNull()}).drop("__t").orderBy(
        F.col("new_cluster").desc(), "mean_corr", "symbol"
    )


def latest_values(bars: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of each symbol's last bar."""
    last = F.max_by(F.struct("date", *[c(x) for x in columns]), "date")
    return bars.groupBy("symbol").agg(last.alias("x")).select("symbol", "x.*")


#: Figures of the index: column -> path in a report.
INDEX_FIGURES = {
    "factor_type": ("$.meta.factor_type", "string"),
    "analysis_date": ("$.meta.analysis_date", "string"),
    "n_symbols": ("$.panel_summary.n_symbols", "long"),
    "start_date": ("$.panel_summary.start_date", "string"),
    "end_date": ("$.panel_summary.end_date", "string"),
    "coverage_mean": ("$.panel_summary.coverage_mean", "double"),
    "longshort_sharpe_5d": ('$.layer3_grouping["5"].longshort.sharpe', "double"),
}
#: Groups of figures by period: prefix -> path of the periods.
INDEX_PERIODS = {"ic_rank": "rank_ic", "ic_pearson": "pearson_ic", "top_ic": "top_ic"}
PERCENTILES = ("p5", "p10", "p25", "p50", "p75", "p90", "p95")


def read_report_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, factor_name, report) of every JSON report below path, the report as
    a variant: reports of any layout share a column. The factor is the one the
    report names, or else its folder; files that are no JSON objects are left out."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("ignoreMissingFiles", True).text(path)
    docs = files.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("report"))
    docs = docs.filter(F.schema_of_variant("report").startswith("OBJECT"))
    folder = F.url_decode(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    named = F.try_variant_get("report", "$.meta.factor_name", "string")
    return docs.select("path", F.coalesce(named, folder).alias("factor_name"), "report")


def latest_reports(documents: DataFrame) -> DataFrame:
    """The newest report of every factor: by its date, then by its file's name.
    Names and dates are compared first, reports themselves move once."""
    date = F.try_variant_get("report", "$.meta.analysis_date", "string")
    order = F.struct(F.coalesce(date, F.lit("")).alias("d"), "path")
    newest = documents.groupBy("factor_name").agg(F.max(order).alias("o")).select(F.col("o.path").alias("path"))
    return documents.join(newest, "path", "left_semi")


def report_index(documents: DataFrame, periods: Sequence[int] = (5, 10, 20, 60)) -> DataFrame:
    """A row per factor from its newest report: what INDEX_FIGURES names, mean and
    ir of each kind of IC per period, and the mean over dates of the daily
    percentiles. What a layout doesn't hold is missing."""
    latest = latest_reports(documents)
    figures = {k: (p, t) for k, (p, t) in INDEX_FIGURES.items()}
    for prefix, key in INDEX_PERIODS.items():
        for period in periods:
            for x in ("mean", "ir"):
                figures[f"{prefix}_{period}_{x}"] = (f'$.layer2_predictive.{key}["{period}"].{x}', "double")
    rows = latest.select("factor_name", *[F.try_variant_get("report", p, t).alias(k) for k, (p, t) in figures.items()])
    return rows.join(percentile_means(latest), "factor_name", "left")


def percentile_means(documents: DataFrame) -> DataFrame:
    """(factor_name, p5 ... p95): the mean over dates of each daily percentile, from
    reports that list the dates' figures and from those that key them by date."""
    at = "$.layer1_quality.daily_percentiles"
    listed = F.try_variant_get("report", at, "array<map<string,double>>")
    keyed = F.map_values(F.try_variant_get("report", at, "map<string,map<string,double>>"))
    days = documents.select("factor_name", F.explode(F.coalesce(listed, keyed)).alias("day"))
    values = days.select("factor_name", F.explode("day").alias("name", "x")).filter(~F.isnan("x"))
    name = F.lower("name")
    return values.groupBy("factor_name").agg(*[F.avg(F.when(name == p, F.col("x"))).alias(p) for p in PERCENTILES])


def variant_rows(variants: Sequence[Mapping]) -> list[dict]:
    """Driver-side list of parameter sets with a variant_id each."""
    return [{"variant": f"v{i:03d}", **v} for i, v in enumerate(variants)]
