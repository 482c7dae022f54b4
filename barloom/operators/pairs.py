"""Statistics of symbol pairs without joining rows with rows.

Symbols are hashed into blocks. A task gets two blocks of series and multiplies
them as matrices, so what leaves it is one row per pair of the result, never one
row per pair and date. Figures over many pairs (means of groups and symbols, the
nearest partners) are made in the task as well; then no pairs leave it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import Bars, windowed
from ..functions.scalar import c, div

BLOCK_SYMBOLS = 256  # symbols per side of a task
BLOCK_DATES = 16384  # dates per task; longer series are added up over tasks

_SUMS = ["n", "sx", "sy", "sxx", "syy", "sxy"]
_SUMS_SCHEMA = ", ".join(f"{s} double" for s in _SUMS)


def daily_returns(bars: Bars, column: str | None = None) -> Bars:
    """(symbol, date, x): gain / 100 when the table has it, else the change of
    the close."""
    if column:
        return bars.with_df(bars.df.select("symbol", "date", (c(column) / 100.0).alias("x")))

    def build(d, w):
        return d.withColumn("x", div("close", F.lag("close", 1).over(w)) - 1)

    return bars.with_df(windowed(bars, 1, 0, build).select("symbol", "date", "x"))


def common_dates(bars: Bars) -> Bars:
    """Rows of the dates every symbol has."""
    symbols = bars.df.groupBy("symbol").agg(F.lit(1).alias("o")).agg(F.count("o").alias("__all"))
    full = (
        bars.df.groupBy("date")
        .agg(F.count(F.lit(1)).alias("__n"))
        .join(F.broadcast(symbols), F.lit(True))
        .filter(F.col("__n") == F.col("__all"))
        .select("date")
    )
    return bars.with_df(bars.df.join(full, "date", "left_semi"))


def log_returns(bars: Bars) -> Bars:
    """(symbol, date, x): change of the log close; raises on prices <= 0."""

    def build(d, w):
        safe = F.when(F.col("close") > 0, F.col("close")).otherwise(
            F.raise_error(F.lit("close must be positive for log returns")).cast("double")
        )
        return d.withColumn("__l", F.log(safe)).withColumn(
            "x", F.col("__l") - F.lag("__l", 1).over(w)
        )

    df = windowed(bars, 1, 0, build).filter(F.col("x").isNotNull())
    return bars.with_df(df.select("symbol", "date", "x"))


def _pair_sums(left: pd.DataFrame, right: pd.DataFrame) -> dict[str, np.ndarray]:
    """Sums over the dates both sides have, for every left x right symbol."""
    x, y = left.to_numpy(), right.to_numpy()
    mx, my = ~np.isnan(x), ~np.isnan(y)
    x, y = np.where(mx, x, 0.0), np.where(my, y, 0.0)
    mx, my = mx.astype(float), my.astype(float)
    return {
        "n": mx.T @ my,
        "sx": x.T @ my,
        "sy": mx.T @ y,
        "sxx": (x * x).T @ my,
        "syy": mx.T @ (y * y),
        "sxy": x.T @ y,
    }


def correlation_pairs(
    series: Bars,
    min_rows: int = 2,
    min_corr: float | None = None,
    block_symbols: int = BLOCK_SYMBOLS,
    block_dates: int = BLOCK_DATES,
    max_corr: float | None = None,
    sides: tuple[DataFrame, DataFrame] | None = None,
) -> DataFrame:
    """(a, b, corr, n) for a < b over the dates both have.

    series: (symbol, date, x). Values are centred per symbol first, which leaves
    the correlation as it is and keeps the sums accurate. Only wanted pairs leave
    a task: those within min_corr and max_corr (both included) and, with sides,
    those of a symbol of the first side and one of the second.
    """
    tiles, spans = _tiles(series, block_symbols, block_dates, sides)
    finish, floor, ceiling = spans == 1, min_corr, max_corr

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _tile_pairs(pdf)
        if finish:
            r = _correlation(out, min_rows)
            ok = r.notna()
            if floor is not None:
                ok &= r >= floor
            if ceiling is not None:
                ok &= r <= ceiling
            out = out[ok]
        return out[["a", "b", *_SUMS]]

    parts = tiles.groupBy("ti", "tj", "span").applyInPandas(tile, "a string, b string, " + _SUMS_SCHEMA)
    if not finish:
        parts = parts.groupBy("a", "b").agg(*[F.sum(s).alias(s) for s in _SUMS])
    n = F.col("n")
    vx, vy = n * F.col("sxx") - F.col("sx") ** 2, n * F.col("syy") - F.col("sy") ** 2
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    corr = F.when((vx > 0) & (vy > 0), cov / F.sqrt(F.nullif(vx * vy, F.lit(0.0))))
    out = parts.select("a", "b", corr.alias("corr"), n.cast("long").alias("n"))
    out = out.filter((F.col("n") >= min_rows) & F.col("corr").isNotNull())
    out = out if min_corr is None else out.filter(F.col("corr") >= min_corr)
    return out if max_corr is None else out.filter(F.col("corr") <= max_corr)


def _tiles(
    series: Bars, block_symbols: int, block_dates: int, sides: tuple[DataFrame, DataFrame] | None = None,
    labels: DataFrame | None = None,
) -> tuple[DataFrame, int]:
    """The centred values of each tile (ti <= tj) and span of dates, and the number
    of spans. Only labelled symbols take part if there are labels."""
    symbols, dates = series.symbols, series.dates
    if symbols is None:
        symbols = series.df.groupBy("symbol").count().count()
    if dates is None:
        dates = series.df.groupBy("date").count().count()
    blocks = max(1, math.ceil(symbols / block_symbols))
    spans = max(1, math.ceil(dates / block_dates))
    # Two aggregations over the same rows instead of a window per symbol.
    means = _with_sides(series.df.groupBy("symbol").agg(F.avg("x").alias("__m")), sides)
    if labels is None:
        means = means.withColumn("label", F.lit(None).cast("string"))
    else:
        means = means.join(labels.select("symbol", F.col("cluster").cast("string").alias("label")), "symbol")
    df = series.df.select("symbol", "date", "x").filter(F.col("x").isNotNull()).join(means, "symbol")
    df = df.select(
        "symbol",
        F.unix_date("date").alias("day"),
        (F.col("x") - F.col("__m")).alias("x"),
        F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int").alias("block"),
        "in1",
        "in2",
        "label",
    )
    if sides is not None:
        df = df.filter("in1 or in2")
    df = df.withColumn("span", F.pmod(F.col("day"), F.lit(spans)))
    other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other")
    tiles = df.select("*", other).select(
        "symbol", "day", "x", "block", "span", "in1", "in2", "label",
        F.least("block", "other").alias("ti"), F.greatest("block", "other").alias("tj"),
    )
    return tiles, spans


def _tile_pairs(pdf: pd.DataFrame) -> pd.DataFrame:
    """a < b, their labels la and lb, and the sums over their dates, of the pairs of
    a tile that have a common date and lie on the two sides."""
    wide = pdf.pivot(index="day", columns="symbol", values="x")
    per = pdf.groupby("symbol")[["block", "in1", "in2", "label"]].first().reindex(wide.columns)
    home = per["block"].to_numpy()
    ti, tj = int(pdf["ti"].iloc[0]), int(pdf["tj"].iloc[0])
    left, right = wide.loc[:, home == ti], wide.loc[:, home == tj]
    of_l, of_r = per[home == ti], per[home == tj]
    sums = _pair_sums(left, right)
    names_l, names_r = left.columns.to_numpy(), right.columns.to_numpy()
    if ti == tj:
        i, j = np.triu_indices(len(names_l), 1)
    else:
        i, j = (m.ravel() for m in np.indices((len(names_l), len(names_r))))
    out = pd.DataFrame({k: v[i, j] for k, v in sums.items()})
    a, b = names_l[i].astype(str), names_r[j].astype(str)
    swap = a > b
    out["a"], out["b"] = np.where(swap, b, a), np.where(swap, a, b)
    la, lb = of_l["label"].to_numpy(object)[i], of_r["label"].to_numpy(object)[j]
    out["la"], out["lb"] = np.where(swap, lb, la), np.where(swap, la, lb)
    for p, q in (("sx", "sy"), ("sxx", "syy")):
        out[p], out[q] = np.where(swap, out[q], out[p]), np.where(swap, out[p], out[q])
    one_l, two_l, one_r, two_r = (t[f].to_numpy(bool) for t in (of_l, of_r) for f in ("in1", "in2"))
    return out[(out["n"] > 0) & ((one_l[i] & two_r[j]) | (two_l[i] & one_r[j]))]


def _correlation(sums: pd.DataFrame, min_rows: int) -> pd.Series:
    """NaN where a side does not move or there are too few rows."""
    n = sums["n"]
    vx, vy = n * sums["sxx"] - sums["sx"] ** 2, n * sums["syy"] - sums["sy"] ** 2
    return (n * sums["sxy"] - sums["sx"] * sums["sy"]) / np.sqrt((vx * vy).where((vx > 0) & (vy > 0) & (n >= min_rows)))


def _reduced(
    series: Bars, reduce: Callable[[pd.DataFrame], pd.DataFrame], schema: str, min_rows: int,
    block_symbols: int, block_dates: int, labels: DataFrame | None = None,
) -> DataFrame:
    """What reduce makes of the pairs of each tile: every pair twice, as (a, b) and
    (b, a), with corr, la and lb. Series longer than block_dates are added up
    between two steps, tile by tile."""
    tiles, spans = _tiles(series, block_symbols, block_dates, labels=labels)

    def done(pairs: pd.DataFrame) -> pd.DataFrame:
        pairs = pairs.assign(corr=_correlation(pairs, min_rows))
        pairs = pairs.loc[pairs["corr"].notna(), ["a", "b", "la", "lb", "corr"]]
        return reduce(pd.concat([pairs, pairs.rename(columns={"a": "b", "b": "a", "la": "lb", "lb": "la"})], ignore_index=True))

    if spans == 1:
        return tiles.groupBy("ti", "tj").applyInPandas(lambda pdf: done(_tile_pairs(pdf)), schema)

    def part(pdf: pd.DataFrame) -> pd.DataFrame:
        return _tile_pairs(pdf).assign(ti=pdf["ti"].iloc[0], tj=pdf["tj"].iloc[0])[["ti", "tj", "a", "b", "la", "lb", *_SUMS]]

    parts = tiles.groupBy("ti", "tj", "span").applyInPandas(part, "ti int, tj int, a string, b string, la string, lb string, " + _SUMS_SCHEMA)
    whole = lambda pdf: done(pdf.groupby(["a", "b", "la", "lb"], as_index=False, dropna=False)[_SUMS].sum())
    return parts.groupBy("ti", "tj").applyInPandas(whole, schema)


def group_correlations(series: Bars, labels: DataFrame, min_rows: int = 2, block_symbols: int = BLOCK_SYMBOLS, block_dates: int = BLOCK_DATES) -> DataFrame:
    """(ga, gb, corr_mean, n_pairs) between and within groups, both directions.

    labels: (symbol, cluster); other symbols take no part, a null cluster is a group.
    A sum and a count per pair of groups leave a tile. No pairs, no rows."""

    def reduce(p: pd.DataFrame) -> pd.DataFrame:
        sums = p.groupby(["la", "lb"], dropna=False)["corr"].agg(s="sum", n="count").reset_index()
        return sums.rename(columns={"la": "ga", "lb": "gb"})

    parts = _reduced(series, reduce, "ga string, gb string, s double, n long", min_rows, block_symbols, block_dates, labels)
    kind = labels.schema["cluster"].dataType
    sums = parts.groupBy(F.col("ga").cast(kind).alias("ga"), F.col("gb").cast(kind).alias("gb"))
    return sums.agg((F.sum("s") / F.sum("n")).alias("corr_mean"), F.sum("n").alias("n_pairs"))


def symbol_correlations(series: Bars, labels: DataFrame, min_rows: int = 2, block_symbols: int = BLOCK_SYMBOLS, block_dates: int = BLOCK_DATES) -> DataFrame:
    """(symbol, corr_sum, n, corr_in_group) per labelled symbol that has a pair: the
    sum and number of its correlations, and their mean inside its group (NULL
    without a pair there, or without a group). A row per symbol leaves a tile."""

    def reduce(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(own=p["corr"].where((p["la"] == p["lb"]) & p["la"].notna()))
        by = p.groupby("a")
        sums = {"s": by["corr"].sum(), "n": by["corr"].count(), "own": by["own"].sum(), "m": by["own"].count()}
        return pd.DataFrame(sums).rename_axis("symbol").reset_index()

    parts = _reduced(series, reduce, "symbol string, s double, n long, own double, m long", min_rows, block_symbols, block_dates, labels)
    return parts.groupBy("symbol").agg(
        F.sum("s").alias("corr_sum"), F.sum("n").alias("n"),
        (F.sum("own") / F.nullif(F.sum("m"), F.lit(0))).alias("corr_in_group"),
    )


def nearest_partners(series: Bars, k: int, min_rows: int = 2, block_symbols: int = BLOCK_SYMBOLS, block_dates: int = BLOCK_DATES) -> DataFrame:
    """(a, b, corr, place) of the k partners with the highest correlation of every
    symbol, ties by name; place counts from 1. At most k rows per symbol leave a tile."""

    def reduce(p: pd.DataFrame) -> pd.DataFrame:
        return p.sort_values(["a", "corr", "b"], ascending=[True, False, True]).groupby("a").head(k)[["a", "b", "corr"]]

    parts = _reduced(series, reduce, "a string, b string, corr double", min_rows, block_symbols, block_dates)
    order = Window.partitionBy("a").orderBy(F.col("corr").desc(), "b")
    return parts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def _with_sides(symbols: DataFrame, sides: tuple[DataFrame, DataFrame] | None) -> DataFrame:
    """Whether a symbol is on the first and on the second side, beside each symbol.
    The sides are joined, so they may be parts of a universe."""
    if sides is None:
        return symbols.withColumns({"in1": F.lit(True), "in2": F.lit(True)})
    for i, side in enumerate(sides, 1):
        listed = side.select("symbol").distinct().withColumn(f"in{i}", F.lit(True))
        symbols = symbols.join(listed, "symbol", "left")
    return symbols.fillna(False, ["in1", "in2"])


def both_ways(pairs: DataFrame) -> DataFrame:
    rest = [x for x in pairs.columns if x not in ("a", "b")]
    return pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), *rest))


def duplicate_pairs(
    bars: Bars, threshold: float = 0.99, min_rows: int = 100, column: str | None = None
) -> DataFrame:
    """Pairs that move together: correlation, common closes, spread of b / a.

    Only the pairs over the threshold are joined with their closes.
    """
    pairs = correlation_pairs(daily_returns(bars, column), min_corr=threshold)
    close = bars.df.select("symbol", "date", "close").filter(F.col("close").isNotNull())
    a = close.select(F.col("symbol").alias("a"), "date", F.col("close").alias("ca"))
    b = close.select(F.col("symbol").alias("b"), "date", F.col("close").alias("cb"))
    joined = pairs.select("a", "b", "corr").join(a, "a").join(b, ["b", "date"])
    stats = joined.groupBy("a", "b", "corr").agg(
        F.count(F.lit(1)).alias("rows"), F.stddev_samp(div("cb", "ca")).alias("ratio_std")
    )
    return stats.filter(F.col("rows") >= min_rows)
