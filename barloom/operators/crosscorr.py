"""Correlation between factors across symbols, and its incremental update."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import Bars
from ..functions.scalar import c, corr_agg
from .crosssection import avg_rank
from .panel import calendar, small


def pair_correlations(
    bars: Bars,
    factors: Sequence[str],
    interval: int = 5,
    min_assets: int = 30,
    dates: DataFrame | None = None,
    only: Sequence[tuple[str, str]] | None = None,
    start=None,
    end=None,
) -> DataFrame:
    """(a, b, mean_corr, std_corr, n_dates) for a < b in list order.

    Every interval-th date is used. On each, the two factors are ranked over the
    symbols that have both, so a pair's ranks do not depend on other factors.
    The number of pairs comes from the factor list, not from the data.
    """
    cal = calendar(bars.df if dates is None else dates)
    if start is not None:
        cal = calendar(cal.filter(F.col("date") >= F.lit(start)).select("date"))
    if end is not None:
        cal = cal.filter(F.col("date") <= F.lit(end))
    sampled = cal.filter(F.col("t") % interval == 0).select("date")
    df = bars.df.join(small(sampled, bars.dates), "date")
    pairs = list(only) if only is not None else list(itertools.combinations(factors, 2))
    if not pairs:
        raise ValueError("no factor pairs")
    daily = daily_correlations(bars.with_df(df), pairs, min_assets)
    return daily.groupBy("a", "b").agg(
        F.avg("rho").alias("mean_corr"),
        F.when(F.count("rho") > 1, F.stddev_pop("rho")).alias("std_corr"),
        F.count("rho").alias("n_dates"),
    )


def daily_correlations(bars: Bars, pairs: Sequence[tuple[str, str]], min_assets: int) -> DataFrame:
    """(a, b, date, n, rho) of the pairs of columns on every date of the bars with
    at least min_assets symbols that have both."""
    items = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), c(a).alias("x"), c(b).alias("y"))
        for a, b in pairs
    ]
    long = (
        bars.df.select("date", F.explode(F.array(*items)).alias("p"))
        .select("date", "p.*")
        .filter(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    keys = ["a", "b", "date"]
    long = avg_rank(long, keys, "x", "rx", bars.date_fits)
    long = avg_rank(long, keys, "y", "ry", bars.date_fits)
    return (
        long.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n"), corr_agg("rx", "ry").alias("rho"))
        .filter(F.col("n") >= min_assets)
    )


def mirrored(pairs: DataFrame, factors: DataFrame | None = None) -> DataFrame:
    """Both directions, and the diagonal fixed at 1 when factors are given."""
    back = pairs.select(
        F.col("b").alias("a"), F.col("a").alias("b"), *[x for x in pairs.columns if x not in ("a", "b")]
    )
    out = pairs.unionByName(back)
    if factors is not None:
        diagonal = factors.select(
            F.col("factor_name").alias("a"), F.col("factor_name").alias("b"), F.lit(1.0).alias("mean_corr"),
            F.lit(0.0).alias("std_corr"),
        )
        out = out.unionByName(diagonal, allowMissingColumns=True)
    return out


def high_pairs(pairs: DataFrame, threshold: float = 0.7, value: str = "mean_corr") -> DataFrame:
    rows = pairs.filter(F.abs(value) >= threshold)
    return rows.orderBy(F.abs(value).desc(), "a", "b")


def low_pairs(pairs: DataFrame, threshold: float = 0.3, value: str = "mean_corr") -> DataFrame:
    rows = pairs.filter(F.abs(value) < threshold)
    return rows.orderBy(F.abs(value).asc(), "a", "b")


def correlated_with(
    pairs: DataFrame, name: str, threshold: float = 0.7, direction: str = "above", limit: int = 50,
    value: str = "mean_corr",
) -> DataFrame:
    """Other factors by strength of correlation with one factor."""
    if direction not in ("above", "below"):
        raise ValueError("direction must be above or below")
    both = mirrored(pairs).filter(F.col("a") == name)
    keep = F.abs(value) >= threshold if direction == "above" else F.abs(value) <= threshold
    return both.filter(keep).orderBy(F.abs(value).desc(), "b").limit(limit)


def fingerprint(config: dict) -> str:
    """Hash of the settings a stored result depends on."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()


def pairs_to_compute(
    factors: Sequence[str], stored: DataFrame | None, same_config: bool
) -> list[tuple[str, str]]:
    """Pairs not yet stored; all of them when the settings changed or a stored
    factor was removed. The stored table has one row per factor pair."""
    wanted = list(itertools.combinations(factors, 2))
    if stored is None or not same_config:
        return wanted
    done = {tuple(sorted((x["a"], x["b"]))) for x in stored.select("a", "b").toLocalIterator()}
    names = {n for p in done for n in p}
    if not names <= set(factors):
        return wanted
    return [p for p in wanted if tuple(sorted(p)) not in done]


def update_pairs(
    bars: Bars, factors: Sequence[str], stored: DataFrame | None, same_config: bool = True, **options
) -> DataFrame:
    """Stored pairs plus the missing ones; a full run when nothing is reusable."""
    todo = pairs_to_compute(factors, stored, same_config)
    everything = len(todo) == len(factors) * (len(factors) - 1) // 2
    if not todo:
        return stored
    fresh = pair_correlations(bars, factors, only=todo, **options)
    return fresh if everything or stored is None else stored.unionByName(fresh)
