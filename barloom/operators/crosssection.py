"""Ranks, positions and quantiles inside groups of any size.

Each function has two exact forms. While a group is known to fit one task, a
window over the group is used. Otherwise the group is cut by value ranges:
counts per range give offsets, and only ranges are sorted. Equal values are
collapsed before that, so a value held by a third of the rows is one row.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import c, div
from ..sources.session import cut_lineage

# Value ranges per group in the split form.
RANGES = 64


def avg_rank(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    out: str,
    fits: bool,
    pct: bool = False,
    ascending: bool = True,
) -> DataFrame:
    """1-based rank of the non-missing values, ties share their mean rank.

    pct divides by the number of non-missing values of the group.
    """
    if fits:
        v = c(value)
        order = v.asc_nulls_last() if ascending else v.desc_nulls_last()
        w = W.partitionBy(*keys).orderBy(order)
        # rank() is the lowest position of a tie, the running count the highest.
        rank = (F.rank().over(w) + F.count(v).over(w)) / F.lit(2.0)
        if pct:
            rank = div(rank, F.count(v).over(W.partitionBy(*keys)))
        return df.withColumn(out, F.when(v.isNotNull(), rank))
    df = cut_lineage(df)
    dist = _distinct_positions(df, keys, value)
    middle = F.col("__below") + (F.col("__c") + 1) / F.lit(2.0)
    rank = middle if ascending else F.col("__total") + 1 - middle
    if pct:
        rank = div(rank, "__total")
    ranks = dist.select(*keys, "__v", rank.alias(out))
    joined = df.withColumn("__v", c(value)).join(ranks, [*keys, "__v"], "left")
    return joined.drop("__v")


def _distinct_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, __v, __c, __below, __total): each distinct value with its count,
    the number of smaller values and the size of the group."""
    dist = (
        df.filter(c(value).isNotNull())
        .groupBy(*keys, c(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    dist = cut_lineage(dist)
    probs = F.array(*[F.lit(i / RANGES) for i in range(1, RANGES)])
    splits = dist.groupBy(*keys).agg(F.percentile_approx("__v", probs, 1000).alias("__splits"))
    # A range is the number of split points below the value: ordered and exact.
    ranged = dist.join(splits, list(keys)).withColumn(
        "__r", F.size(F.filter("__splits", lambda s: s < F.col("__v")))
    )
    ranged = ranged.drop("__splits")
    group = W.partitionBy(*keys)
    totals = ranged.groupBy(*keys, "__r").agg(F.sum("__c").alias("__rc"))
    totals = totals.withColumns(
        {
            "__before": F.coalesce(
                F.sum("__rc").over(group.orderBy("__r").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
            "__total": F.sum("__rc").over(group),
        }
    ).drop("__rc")
    inside = (
        W.partitionBy(*keys, "__r").orderBy("__v").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        ranged.join(totals, [*keys, "__r"])
        .withColumn("__below", F.col("__before") + F.coalesce(F.sum("__c").over(inside), F.lit(0)))
        .drop("__before", "__r")
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, fits: bool
) -> DataFrame:
    """row_number within the group; the order must be total."""
    if fits:
        return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    # Range partitioning on group and order cuts hot groups; the result is
    # written out because range bounds may differ when a stage is run again.
    cut = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    cut = cut.withColumn("__part", F.spark_partition_id())
    cut = cut_lineage(cut)
    sizes = cut.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__size"))
    before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__size").over(before), F.lit(0)))
    inside = F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order))
    return (
        cut.withColumn("__inside", inside)
        .join(sizes.drop("__size"), [*keys, "__part"])
        .withColumn(out, F.col("__before") + F.col("__inside"))
        .drop("__part", "__before", "__inside")
    )


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str, fits: bool
) -> DataFrame:
    """One row per group with the linear-interpolated quantiles as an array."""
    if fits:
        array = F.percentile(c(value), F.array(*[F.lit(float(p)) for p in probs]))
        return df.groupBy(*keys).agg(array.alias(out))
    whole = not keys
    if whole:
        df, keys = df.withColumn("__all", F.lit(1)), ["__all"]
    df = cut_lineage(df.select(*keys, c(value).alias(value)))
    every = df.groupBy(*keys).agg(F.lit(1).alias("__one")).drop("__one")
    dist = _distinct_positions(df, keys, value)

    def at(index: Column) -> Column:
        hit = (F.col("__below") <= index) & (index < F.col("__below") + F.col("__c"))
        return F.max(F.when(hit, F.col("__v")))

    parts = []
    for p in probs:
        target = (F.col("__total") - 1) * F.lit(float(p))
        parts += [at(F.floor(target)), at(F.ceil(target)), F.max(target - F.floor(target))]
    grouped = dist.groupBy(*keys).agg(*[x.alias(f"__q{i}") for i, x in enumerate(parts)])
    value_of = [
        F.col(f"__q{3 * i}")
        + (F.col(f"__q{3 * i + 1}") - F.col(f"__q{3 * i}")) * F.col(f"__q{3 * i + 2}")
        for i in range(len(probs))
    ]
    # A group without any value keeps its row, as in the form above.
    marks = grouped.select(*keys, F.array(*value_of).alias(out))
    return every.join(marks, list(keys), "left").select(*([] if whole else keys), out)


def quantile_group(
    df: DataFrame, keys: Sequence[str], value: str, n: int, out: str, fits: bool
) -> DataFrame:
    """1-based right-closed quantile bucket; equal edges merge, fewer than n
    values or a single edge give NULL."""
    probs = [i / n for i in range(n + 1)]
    v = c(value)
    if fits:
        group = W.partitionBy(*keys)
        edges = F.percentile(v, F.array(*[F.lit(p) for p in probs])).over(group)
        df = df.withColumns({"__edges": F.array_distinct(edges), "__n": F.count(v).over(group)})
    else:
        df = cut_lineage(df)
        marks = quantiles(df, keys, value, probs, "__edges", fits=False)
        sizes = df.groupBy(*keys).agg(F.count(v).alias("__n"))
        df = df.join(marks, list(keys), "left").join(sizes, list(keys))
        df = df.withColumn("__edges", F.array_distinct("__edges"))
    below = F.size(F.filter("__edges", lambda e: e < v))
    usable = v.isNotNull() & (F.col("__n") >= n) & (F.size("__edges") > 1)
    return df.withColumn(out, F.when(usable, F.greatest(below, F.lit(1)))).drop("__edges", "__n")


def min_max(df: DataFrame, keys: Sequence[str], value: str, out: str, fits: bool) -> DataFrame:
    """(x - min) / (max - min) per group; flat groups give 0.5, fewer than two
    values give NULL."""
    v = c(value)
    aggs = {"__lo": F.min(v), "__hi": F.max(v), "__n": F.count(v)}
    if fits:
        df = df.withColumns({k: a.over(W.partitionBy(*keys)) for k, a in aggs.items()})
    else:
        df = cut_lineage(df)
        marks = df.groupBy(*keys).agg(*[a.alias(k) for k, a in aggs.items()])
        df = df.join(marks, list(keys))
    width = F.col("__hi") - F.col("__lo")
    scaled = F.when(width == 0, 0.5).otherwise(div(v - F.col("__lo"), width))
    return df.withColumn(out, F.when((F.col("__n") >= 2) & v.isNotNull(), scaled)).drop(
        "__lo", "__hi", "__n"
    )


def top_count(n: str | Column, share: float, at_least: int) -> Column:
    """ceil(n * share), at least `at_least`, at most n."""
    n = c(n)
    wanted = F.greatest(F.ceil(n * F.lit(float(share))), F.lit(at_least))
    return F.least(wanted, n)


def min_periods(window: int) -> int:
    return max(20, math.floor(window / 2))
