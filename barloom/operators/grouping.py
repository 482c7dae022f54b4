"""Third layer: returns of factor quantiles."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import Bars
from ..functions.scalar import div
from .crosssection import avg_rank, quantile_group
from .performance import return_metrics


def assign_groups(panel: Bars, n: int = 5, keys: Sequence[str] = ()) -> Bars:
    return panel.with_df(
        quantile_group(panel.df, [*keys, "date"], "factor", n, "group", panel.date_fits)
    )


def quantile_returns(panel: Bars, fwd: str = "fwd", n: int = 5, keys: Sequence[str] = ()) -> DataFrame:
    """Mean forward return per date and group (long form)."""
    grouped = assign_groups(panel, n, keys).df.filter(F.col("group").isNotNull())
    return grouped.groupBy(*keys, "date", "group").agg(F.avg(fwd).alias("ret"))


def quantile_wide(long: DataFrame, n: int = 5) -> DataFrame:
    """Q1..Qn as columns, one row per date."""
    return long.groupBy("date").agg(
        *[F.max(F.when(F.col("group") == q, F.col("ret"))).alias(f"Q{q}") for q in range(1, n + 1)]
    )


def quantile_summary(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    stats = long.groupBy(*keys, "group").agg(
        F.avg("ret").alias("m"),
        F.stddev_samp("ret").alias("s"),
        F.sum((F.col("ret") > 0).cast("double")).alias("up"),
        F.count("ret").alias("n"),
    )
    enough = F.col("n") >= 2
    return stats.select(
        *keys,
        "group",
        F.when(enough, F.col("m")).alias("mean_return"),
        F.when(enough, F.col("s")).alias("std_return"),
        F.when(enough, div("up", "n")).alias("win_rate"),
    )


def long_short(long: DataFrame, n: int = 5) -> DataFrame:
    """Top less bottom group per date, dates with both only."""
    wide = long.groupBy("date").agg(
        F.max(F.when(F.col("group") == n, F.col("ret"))).alias("top"),
        F.max(F.when(F.col("group") == 1, F.col("ret"))).alias("bottom"),
    )
    return wide.select("date", (F.col("top") - F.col("bottom")).alias("ret")).filter(
        F.col("ret").isNotNull()
    )


def long_short_metrics(long: DataFrame, n: int = 5) -> DataFrame:
    return return_metrics(long_short(long, n))


def cumulative_curves(long: DataFrame) -> DataFrame:
    """Running product of 1 + ret per group; missing dates keep the level."""
    w = W.partitionBy("group").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    level = F.product(1 + F.coalesce("ret", F.lit(0.0))).over(w)
    return long.select("date", "group", F.when(F.col("ret").isNotNull(), level).alias("cum"))


def monotonicity(long: DataFrame) -> DataFrame:
    """Share of dates on which the groups fall strictly or loosely, and the
    direction most dates agree on."""
    days = long.groupBy("date").agg(
        F.sort_array(F.collect_list(F.when(F.col("ret").isNotNull(), F.struct("group", "ret")))).alias("g")
    )
    days = days.withColumn("v", F.transform("g", lambda s: s["ret"]))
    pairs = F.zip_with(
        F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))),
        F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0))),
        lambda a, b: a - b,
    )
    usable = F.size("v") >= 2
    days = days.withColumn("d", F.when(usable, pairs))
    drop = F.element_at("v", 1) - F.element_at("v", -1)
    days = days.withColumn("drop", F.when(usable, drop))
    flag = lambda cond: F.coalesce(cond, F.lit(False)).cast("double")
    out = days.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(flag(F.forall("d", lambda x: x > 0))).alias("strict"),
        F.sum(flag(F.forall("d", lambda x: x >= 0))).alias("loose"),
        F.sum(flag(F.col("drop") > 0)).alias("down"),
        F.sum(flag(F.col("drop") < 0)).alias("up"),
    )
    return out.select(
        div("strict", "n").alias("strict_monotonic_ratio"),
        div("loose", "n").alias("loose_monotonic_ratio"),
        F.when(F.col("up") > F.col("down"), "increasing")
        .when(F.col("down") > F.col("up"), "decreasing")
        .otherwise("none")
        .alias("monotonic_direction"),
    )


def trend_test(long: DataFrame) -> DataFrame:
    """Rank trend of the returns over the ordered groups: of all pairs of a lower
    and a higher group's returns, how many rise (equal ones count half), its
    standard score with the variance corrected for ties, and the two-sided normal
    probability. A row of nulls where fewer than two groups have returns.

    Pairs are not formed: each group is ranked among itself and those below it, and
    its rank sum gives the number of its rising pairs. A ranking holds a row per
    date and group."""
    rows = long.filter(F.col("ret").isNotNull()).select(F.col("group").cast("int").alias("g"), "ret")
    groups = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    every = groups.agg(F.sort_array(F.collect_list("g")).alias("__all"))
    among = rows.join(F.broadcast(every), F.lit(True)).withColumn("h", F.explode(F.filter("__all", lambda h: h >= F.col("g"))))
    ranked = avg_rank(among.drop("__all"), ["h"], "ret", "__r", True)
    n = F.col("n").cast("double")
    rising = ranked.filter("g = h").groupBy("h").agg(F.sum("__r").alias("__s"), F.count(F.lit(1)).alias("n"))
    rising = rising.agg(F.sum(F.col("__s") - n * (n + 1) / 2).alias("rising"))
    t = F.col("t").cast("double")
    tied = rows.groupBy("ret").agg(F.count(F.lit(1)).alias("t"))

    def sums(x: Column, name: str) -> list[Column]:
        parts = (x * (x - 1) * (2 * x + 5), x * (x - 1) * (x - 2), x * (x - 1))
        return [F.sum(p).alias(f"{name}{i}") for i, p in enumerate(parts)]

    totals = groups.agg(F.sum(n).alias("m"), F.sum(n * n).alias("squares"), F.count(F.lit(1)).alias("k"), *sums(n, "n"))
    row = totals.join(F.broadcast(tied.agg(*sums(t, "t"))), F.lit(True)).join(F.broadcast(rising), F.lit(True))
    m = F.col("m")
    spread = (
        (m * (m - 1) * (2 * m + 5) - F.col("n0") - F.col("t0")) / 72
        + F.coalesce(div(F.col("n1") * F.col("t1"), 36 * m * (m - 1) * (m - 2)), F.lit(0.0))
        + F.coalesce(div(F.col("n2") * F.col("t2"), 8 * m * (m - 1)), F.lit(0.0))
    )
    row = row.withColumn("z", F.when(spread > 0, (F.col("rising") - (m * m - F.col("squares")) / 4) / F.sqrt(spread)))
    usable = F.col("k") >= 2
    return row.select(
        F.when(usable, F.col("rising")).alias("jt_statistic"), F.when(usable, F.col("z")).alias("jt_z"),
        F.when(usable, normal_tails("z")).alias("jt_pvalue"),
    )


def normal_tails(z: str) -> Column:
    """Probability of a standard normal value at least as far out on either side;
    the usual rational approximation of the error function (error below 2e-7)."""
    x = F.abs(F.col(z)) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    # Coefficients of the approximation.
    series = F.lit(0.0)
    for a in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        series = (series + a) * t
    return series * F.exp(-x * x)
