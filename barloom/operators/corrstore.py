"""A store of factor correlations that is brought up to date month by month.

A daily correlation depends on the two factors, on the settings and on the bars
that the factors look at. The store keeps, per pair and month, the number, mean
and squared deviations of the daily correlations: figures that can be merged. Each
row carries a fingerprint of both factors, of the settings and of the bars behind
the month. A run computes only what no stored row has the fingerprint of: all months
of a new or changed factor's pairs, and of the other pairs the months whose bars,
or whose earlier bars within the factors' reach, have changed.
"""

from __future__ import annotations

import itertools
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.factor import Factor, with_factors
from ..functions.frames import Bars
from ..functions.library import from_recipe
from ..functions.scalar import c
from ..sources.session import cut_lineage
from .crosscorr import daily_correlations, fingerprint
from .panel import calendar, small

KEYS = ("settings", "lo", "hi", "month", "version")
SCHEMA = "settings string, lo string, hi string, month date, version string, n long, mean double, m2 double"
#: Reach of a factor that sees every earlier bar.
UNBOUNDED = -1


@dataclass(frozen=True)
class Update:
    """pairs: (a, b, mean_corr, std_corr, n_dates) of the current factors and
    bars; computed: the (a, b, month) rows that were not in the store."""

    pairs: DataFrame
    computed: DataFrame


def reach(factor: Factor) -> int:
    """Earlier rows of a symbol that decide a value; UNBOUNDED if all do."""

    def unbounded(f: Factor) -> bool:
        return f.kind in ("running", "decay") or any(unbounded(d) for d in f.deps)

    return UNBOUNDED if unbounded(factor) else factor.warmup


def month_versions(bars: Bars, reaches: list[int], sampled: DataFrame) -> DataFrame:
    """(reach, month, version, since): a fingerprint of the sampled dates of the
    month and of every bar that factors of this reach look at for them, and the
    first month of these bars.

    Rows are hashed and combined per symbol and month before anything is ordered,
    so windows hold the months of a symbol, never its bars."""
    columns = sorted(n for n in bars.df.columns if n not in ("symbol", "date"))
    month = F.trunc("date", "month")
    per = bars.df.groupBy("symbol", month.alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor(F.xxhash64("date", *[c(n) for n in columns])).alias("h")
    )
    along = W.partitionBy("symbol").orderBy("month")
    per = per.withColumn("upto", F.sum("rows").over(along))
    # Order by rows so far: months that hold one of the last n rows are a range.
    by_rows = W.partitionBy("symbol").orderBy("upto")
    parts = []
    for n in reaches:
        if n == UNBOUNDED:
            frame = by_rows.rowsBetween(W.unboundedPreceding, 0)
        else:
            frame = by_rows.rangeBetween(-max(n - 1, 0), 0)
        back = F.lit(0).cast("long") if n == 0 else F.bit_xor(F.xxhash64("month", "rows", "h")).over(frame)
        since = F.col("month") if n == 0 else F.min("month").over(frame)
        seen = per.withColumns({"__b": back, "__s": since})
        # What the month before sees is what this one's first row looks back at.
        before = {"__b": F.coalesce(F.lag("__b").over(along), F.lit(0)), "__s": F.coalesce(F.lag("__s").over(along), F.col("month"))}
        before = before if n != 0 else {}
        parts.append(seen.withColumns(before).select(F.lit(n).alias("reach"), "symbol", "month", F.xxhash64("symbol", "month", "rows", "h", "__b").alias("v"), F.col("__s").alias("since")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    both = rows.groupBy("reach", "month").agg(F.count(F.lit(1)).alias("k"), F.bit_xor("v").alias("v"), F.min("since").alias("since"))
    days = sampled.groupBy(month.alias("month")).agg(F.count(F.lit(1)).alias("d"), F.bit_xor(F.xxhash64("date")).alias("dv"))
    out = both.join(days, "month")
    return out.select("reach", "month", F.sha2(F.concat_ws("|", "reach", "month", "k", "v", "d", "dv"), 256).alias("version"), "since")


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the store; none before the first run."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    if not root.getFileSystem(spark._jsc.hadoopConfiguration()).exists(root):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA).parquet(path)
    # Two runs at once may both have added a row.
    return rows.groupBy(*KEYS).agg(*[F.first(x).alias(x) for x in ("n", "mean", "m2")])


def update(
    bars: Bars, recipes: Mapping[str, Mapping], path: str, interval: int = 5, min_assets: int = 30, dates: DataFrame | None = None
) -> Update:
    """Bring the store at path up to date for these factors and bars.

    recipes: output name -> recipe, as `from_recipe` reads them; the recipe, not
    the name, decides whether a factor is known. Pairs are those of the names in
    the order given. Every interval-th date of the calendar counts, so a date added
    in the past moves the sampled dates after it and renews their months. Rows of
    earlier settings, factors or bars stay in the store and serve a return to them.
    """
    spark = bars.df.sparkSession
    if len(recipes) < 2:
        raise ValueError("no factor pairs")
    settings = fingerprint({"interval": interval, "min_assets": min_assets})
    made = {name: from_recipe(r) for name, r in recipes.items()}
    prints = {name: fingerprint({"recipe": r if not isinstance(r, Factor) else r.name}) for name, r in recipes.items()}
    sampled = calendar(bars.df if dates is None else dates).filter(F.col("t") % interval == 0).select("date")
    sampled = cut_lineage(sampled)
    pairs = []
    for a, b in itertools.combinations(recipes, 2):
        reaches = [reach(made[a]), reach(made[b])]
        lo, hi = sorted((prints[a], prints[b]))
        pairs.append((a, b, lo, hi, UNBOUNDED if UNBOUNDED in reaches else max(reaches)))
    versions = month_versions(bars, sorted({p[-1] for p in pairs}), sampled)
    wanted = spark.createDataFrame(pairs, "a string, b string, lo string, hi string, reach int").join(F.broadcast(versions), "reach")
    wanted = cut_lineage(wanted.withColumn("settings", F.lit(settings)))
    missing = cut_lineage(wanted.join(stored(spark, path), list(KEYS), "left_anti").select(*wanted.columns))
    if not missing.isEmpty():
        _compute(bars, made, missing, sampled, min_assets).write.mode("append").parquet(path)
    rows = wanted.join(stored(spark, path), list(KEYS))
    return Update(merged(rows, ["a", "b"]), missing.select("a", "b", "month"))


def _compute(bars: Bars, made: Mapping[str, Factor], missing: DataFrame, sampled: DataFrame, min_assets: int) -> DataFrame:
    """Figures of the missing pairs and months: factors of these pairs only, over
    the bars from the first month they look back at."""
    spark = bars.df.sparkSession
    only = [(r["a"], r["b"]) for r in missing.select("a", "b").distinct().collect()]
    first, last = missing.agg(F.min("since"), F.max("month")).first()
    names = [n for n in made if any(n in p for p in only)]
    span = bars.with_df(bars.df.filter((F.col("date") >= F.lit(first)) & (F.col("date") < F.add_months(F.lit(last), 1))))
    # Under neutral names: one factor may stand under two of them.
    distinct = {made[n].name: made[n] for n in names}
    computed = with_factors(span, list(distinct.values()))
    month = F.trunc("date", "month")
    columns = [c(made[n].name).alias(f"__f{i}") for i, n in enumerate(names)]
    short = {n: f"__f{i}" for i, n in enumerate(names)}
    months = missing.select("month").distinct()
    days = sampled.withColumn("month", month).join(F.broadcast(months), "month", "left_semi").select("date")
    rows = computed.with_df(computed.df.select("symbol", "date", *columns).join(small(days, bars.dates), "date"))
    daily = daily_correlations(rows, [(short[a], short[b]) for a, b in only], min_assets)
    per_month = daily.groupBy("a", "b", month.alias("month")).agg(F.count("rho").alias("n"), F.avg("rho").alias("mean"), F.var_pop("rho").alias("var"))
    back = spark.createDataFrame([(s, n) for n, s in short.items()], "s string, name string")
    for side in ("a", "b"):
        per_month = per_month.join(F.broadcast(back), per_month[side] == F.col("s")).drop("s", side).withColumnRenamed("name", side)
    out = missing.join(per_month, ["a", "b", "month"], "left")
    n = F.coalesce("n", F.lit(0))
    rows = out.select(*KEYS[:3], "month", "version", n.alias("n"), "mean", F.when(n > 0, F.col("var") * n).alias("m2"))
    # Two names of the same recipes give the same row.
    return rows.dropDuplicates(list(KEYS))


def merged(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Mean and population deviation of the daily values behind (n, mean, m2)."""
    total = F.sum("n").over(W.partitionBy(*keys))
    mean = F.sum(F.col("n") * F.col("mean")).over(W.partitionBy(*keys)) / F.nullif(total, F.lit(0))
    both = rows.withColumn("__mean", mean)
    spread: Column = F.sum(F.col("m2") + F.col("n") * F.pow(F.col("mean") - F.col("__mean"), F.lit(2)))
    many = F.sum("n")
    out = both.groupBy(*keys).agg(F.first("__mean").alias("mean_corr"), F.when(many > 1, F.sqrt(spread / many)).alias("std_corr"), many.alias("n_dates"))
    # A pair without a common date has no row, as in a full run.
    return out.filter("n_dates > 0")
