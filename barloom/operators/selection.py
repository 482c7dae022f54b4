"""Choosing and weighting symbols on each signal date.

Tables carry (variant, date, symbol, ...); every step partitions by variant and
date, so a grid of strategies runs as one job. Cuts to the first rows of a group
use row_number with a bound, which Spark applies before the shuffle as well.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import Bars
from ..functions.scalar import c, compare, div
from .crosssection import avg_rank, min_max
from .joins import as_of
from .panel import calendar, small

GROUP = ("variant", "date")


@dataclass(frozen=True)
class ThresholdFilter:
    """Keep rows whose field compares true; a missing value always fails."""

    field: str
    op: str
    value: float

    def column(self) -> Column:
        return compare(self.field, self.op, float(self.value))


@dataclass(frozen=True)
class RankFilter:
    """Keep rows with exclude_below < rank share <= 1 - exclude_above."""

    field: str
    exclude_below_pct: float = 0.0
    exclude_above_pct: float = 0.0

    @property
    def name(self) -> str:
        return f"rank_{self.field}_trim_b{self.exclude_below_pct}_a{self.exclude_above_pct}"


@dataclass(frozen=True)
class Other:
    """A field of another symbol as it was known on the signal date: the latest
    value at or before it. `column` stands for it in a condition."""

    symbol: str
    field: str

    @property
    def name(self) -> str:
        return f"__of_{self.symbol}_{self.field}"

    @property
    def column(self) -> Column:
        return c(self.name)


@dataclass(frozen=True)
class Condition:
    """A named condition on a candidate: a boolean column over its features and
    over the fields of other symbols that it lists, or a function that gives it.
    Missing is false."""

    name: str
    holds: Column | Callable[[], Column]
    others: tuple[Other, ...] = ()

    @property
    def passed(self) -> Column:
        holds = self.holds if isinstance(self.holds, Column) else self.holds()
        return F.coalesce(holds, F.lit(False))

    @classmethod
    def of(cls, f: "ThresholdFilter | Condition") -> "Condition":
        return f if isinstance(f, Condition) else cls(f"{f.field}{f.op}{f.value}", f.column)


def make_rank_filters(field: str, trims: Sequence[float] = (0.1, 0.2, 0.3)) -> list[RankFilter]:
    """Every pair of lower and upper trims, none included."""
    sides = (0.0, *trims)
    return [RankFilter(field, lo, hi) for lo, hi in itertools.product(sides, sides) if lo + hi > 0]


def rebalance_dates(dates: DataFrame, interval: int) -> DataFrame:
    """(period, date, execution_date): every interval-th bar that has a next one."""
    cal = calendar(dates)
    nxt = F.lead("date").over(W.orderBy("t"))
    return (
        cal.withColumn("execution_date", nxt)
        .filter((F.col("t") % interval == 0) & F.col("execution_date").isNotNull())
        .select((F.col("t") / interval).cast("int").alias("period"), "date", "execution_date")
    )


def eligible(
    df: DataFrame, ranking: str, min_listing_days: int = 0, *, fits: bool
) -> DataFrame:
    """Flag bars later than listing + n days that have a ranking value."""
    first = F.min("date")
    if fits:
        df = df.withColumn("listing_date", first.over(W.partitionBy("symbol")))
    else:
        df = df.join(df.groupBy("symbol").agg(first.alias("listing_date")), "symbol")
    ready = F.col("date") > F.date_add("listing_date", min_listing_days)
    return df.withColumn("eligible", ready & c(ranking).isNotNull())


def recent_complete_date(df: DataFrame) -> DataFrame:
    """The most common last date of the symbols, the latest on ties."""
    last = df.groupBy("symbol").agg(F.max("date").alias("last_date"))
    counts = last.groupBy("last_date").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max_by("last_date", F.struct("n", "last_date")).alias("recent_complete_date"))


def exclusion_reasons(df: DataFrame) -> DataFrame:
    """Why a symbol is left out of the universe, NULL when it is kept."""
    recent = recent_complete_date(df)
    per_symbol = df.groupBy("symbol").agg(
        F.max("date").alias("last_date"), F.max(F.col("eligible").cast("int")).alias("ever")
    )
    per_symbol = per_symbol.join(F.broadcast(recent), F.lit(True))
    reason = F.when(
        F.col("last_date") < F.col("recent_complete_date"), "stale_before_recent_complete_date"
    ).when(F.col("ever") == 0, "never_eligible_in_window")
    return per_symbol.select("symbol", "last_date", reason.alias("reason"))


def raw_candidates(
    features: DataFrame,
    rebalances: DataFrame,
    score: str,
    clusters: DataFrame | None = None,
    exclude_clusters: Sequence[int] = (),
    variant: str = "base",
    checked: bool = True,
) -> DataFrame:
    """Eligible symbols with a score and a positive open on the next bar. Not
    checked: without the score, for callers that have several."""
    opens = features.select(
        "symbol", F.col("date").alias("execution_date"), F.col("open").alias("next_open")
    )
    df = features.drop("open").join(F.broadcast(rebalances), "date")
    df = df.join(opens, ["symbol", "execution_date"])
    df = df.filter(F.col("eligible") & (F.col("next_open") > 0))
    if checked:
        df = df.filter(c(score).isNotNull()).withColumns({"score": c(score), "variant": F.lit(variant)})
    if clusters is not None:
        df = df.join(clusters, "symbol", "left").fillna(-1, ["cluster"])
        if exclude_clusters:
            df = df.filter(~F.col("cluster").isin(list(exclude_clusters)))
    return df


def apply_rank_filters(
    df: DataFrame, filters: Sequence[RankFilter], keys: Sequence[str] = GROUP, *, fits: bool
) -> DataFrame:
    """In order, each on what the ones before left; skipped where the field is
    missing for the whole group."""
    for f in filters:
        df = avg_rank(df, keys, f.field, "__pct", fits, pct=True)
        if fits:
            some = F.count(c(f.field)).over(W.partitionBy(*keys))
            df = df.withColumn("__some", some)
        else:
            sizes = df.groupBy(*keys).agg(F.count(c(f.field)).alias("__some"))
            df = df.join(sizes, list(keys))
        inside = (F.col("__pct") > f.exclude_below_pct) & (F.col("__pct") <= 1.0 - f.exclude_above_pct)
        df = df.filter((F.col("__some") == 0) | F.coalesce(inside, F.lit(False))).drop("__pct", "__some")
    return df


def apply_threshold_filters(df: DataFrame, filters: Sequence[ThresholdFilter]) -> DataFrame:
    for f in filters:
        df = df.filter(f.column())
    return df


def with_others(df: DataFrame, features: Bars, others: Sequence[Other]) -> DataFrame:
    """Columns of the other symbols on each date of df: an as-of self join.

    The other symbols' bars alone are read, and only df's dates are answered; the
    result has a row per date, however many candidates there are."""
    wanted = list(dict.fromkeys(others))
    symbols, fields = sorted({o.symbol for o in wanted}), sorted({o.field for o in wanted})
    rows = features.with_df(features.df.filter(F.col("symbol").isin(symbols)).select("symbol", "date", *[c(x) for x in fields]))
    known = as_of(rows, fields, df.select("date"))
    wide = known.groupBy("date").agg(*[F.max(F.when(F.col("symbol") == o.symbol, c(o.field))).alias(o.name) for o in wanted])
    return df.join(small(wide, features.dates), "date", "left")


def screen(df: DataFrame, conditions: Sequence[Condition | ThresholdFilter], features: Bars | None = None, out: str = "failed_at") -> DataFrame:
    """Number of the first condition, from 0, that each candidate fails; missing
    where it passes all. Conditions over other symbols need the features."""
    conditions = [Condition.of(x) for x in conditions]
    others = [o for x in conditions for o in x.others]
    if others:
        df = with_others(df, features, others)
    first = F.lit(None).cast("int")
    for i, x in reversed(list(enumerate(conditions))):
        first = F.when(x.passed, first).otherwise(i)
    return df.withColumn(out, first).drop(*{o.name for o in others})


def screened_counts(screened: DataFrame, conditions: Sequence[Condition | ThresholdFilter], keys: Sequence[str] = GROUP, failed: str = "failed_at") -> DataFrame:
    """candidate_count, the count after each condition (an array in their order)
    and their names, per group: one aggregate over the first failures."""
    after = [F.sum((F.col(failed).isNull() | (F.col(failed) > i)).cast("long")) for i in range(len(conditions))]
    names = [Condition.of(x).name for x in conditions]
    return screened.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.sum(F.col(failed).isNull().cast("long")).alias("filtered_candidate_count"),
        F.array(*after).alias("counts_after") if after else F.array().cast("array<bigint>").alias("counts_after"),
    ).withColumn("active_candidate_filters", F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"))


def min_momentum(df: DataFrame, value: float, score: str = "score") -> DataFrame:
    return apply_threshold_filters(df, [ThresholdFilter(score, ">=", value)])


def pick_top(
    df: DataFrame,
    top_n: int,
    cluster_max: int | None = None,
    keys: Sequence[str] = GROUP,
) -> DataFrame:
    """Highest scores, symbol breaking ties; at most cluster_max per cluster
    (clusters below 0 are not limited). Adds rank 1..top_n."""
    order = [F.col("score").desc(), F.col("symbol")]
    if cluster_max is not None:
        # One pass for both: what is above is computed once.
        seat = F.row_number().over(W.partitionBy(*keys, "cluster").orderBy(*order))
        df = df.withColumn("__seat", seat).filter((F.col("cluster") < 0) | (F.col("__seat") <= cluster_max)).drop("__seat")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).filter(F.col("rank") <= top_n)


def allocate(
    selected: DataFrame,
    method: str | Column | Callable[[], Column] = "equal",
    keys: Sequence[str] = GROUP,
    field: str | None = None,
    tiers: Sequence[tuple[int, float]] = (),
    floor: float = 1e-8,
) -> DataFrame:
    """Weights over the selected rows that sum to one per group.

    equal | score (proportional) | factor | inverse_factor | tiered (by rank), or a
    column of raw weights of one's own, or a function that gives it; missing or
    negative ones count as 0.
    """
    total = F.sum("__raw").over(W.partitionBy(*keys))
    df = selected.withColumn("__raw", raw_weight(method, field, tiers, floor))
    return df.withColumn("weight", div("__raw", total)).drop("__raw")


def raw_weight(method: str | Column | Callable[[], Column] = "equal", field: str | None = None, tiers: Sequence[tuple[int, float]] = (), floor: float = 1e-8) -> Column:
    """The allocator's weight of a selected row before scaling."""
    if callable(method) and not isinstance(method, Column):
        method = method()
    if isinstance(method, Column):
        return F.greatest(F.coalesce(method.cast("double"), F.lit(0.0)), F.lit(0.0))
    if method == "equal":
        return F.lit(1.0)
    if method == "score":
        return F.greatest(F.col("score").cast("double"), F.lit(floor))
    if method in ("factor", "inverse_factor"):
        size = F.greatest(F.abs(c(field)), F.lit(floor))
        return F.when(c(field).isNull(), floor).otherwise(
            div(F.lit(1.0), size) if method == "inverse_factor" else size
        )
    if method == "tiered":
        raw, upto = F.lit(float(tiers[-1][1])), 0
        steps = []
        for count, weight in tiers:
            upto += int(count)
            steps.append((upto, float(weight)))
        for bound, weight in reversed(steps):
            raw = F.when(F.col("rank") <= bound, weight).otherwise(raw)
        return raw
    raise ValueError(f"unknown allocator {method!r}")


def exposure_caps(
    weights: DataFrame, lo: float, hi: float, max_gross: float, keys: Sequence[str] = GROUP
) -> DataFrame:
    """Clip each weight to [lo, hi], then scale down to the gross limit."""
    df = weights.withColumn("weight", F.least(F.greatest("weight", F.lit(lo)), F.lit(hi)))
    gross = F.sum(F.abs("weight")).over(W.partitionBy(*keys))
    scale = F.when(gross > max_gross, div(F.lit(max_gross), gross)).otherwise(F.lit(1.0))
    return df.withColumn("weight", F.col("weight") * scale)


def dynamic_ranking(
    metric: DataFrame, signal_dates: DataFrame, interval: int, default: str, value: str = "icir"
) -> DataFrame:
    """Factor with the highest metric known `interval` dates before each signal.

    metric: (factor_name, date, value) with one row per date, so windows per
    factor are bounded by the calendar.
    """
    w = W.partitionBy("factor_name").orderBy("date")
    known = metric.withColumn("__m", F.lag(value, interval).over(w))
    upto = w.rowsBetween(W.unboundedPreceding, 0)
    known = known.withColumn("__m", F.last("__m", ignorenulls=True).over(upto))
    best = (
        known.filter(F.col("__m").isNotNull())
        .groupBy("date")
        # Of equally good factors the last name.
        .agg(F.max_by(F.struct("factor_name"), F.struct(F.col("__m"), F.col("factor_name"))).alias("b"))
    )
    return signal_dates.select("date").join(best, "date", "left").select(
        "date", F.coalesce(F.col("b.factor_name"), F.lit(default)).alias("ranking_factor")
    )


def composite_rank(
    df: DataFrame,
    parts: Sequence[tuple[str, float]],
    out: str,
    method: str = "pct",
    keys: Sequence[str] = ("date",),
    *,
    fits: bool,
) -> DataFrame:
    """Weighted mean of per-date rank shares (or min-max values); missing when
    any part is missing."""
    if not parts or method not in ("pct", "minmax"):
        raise ValueError("parts are needed and method must be pct or minmax")
    total = sum(abs(w) for _, w in parts)
    names = []
    for i, (field, _) in enumerate(parts):
        names.append(f"__part{i}")
        if method == "pct":
            df = avg_rank(df, keys, field, names[-1], fits, pct=True)
        else:
            df = min_max(df, keys, field, names[-1], fits)
    score = sum((F.col(n) * float(w) for n, (_, w) in zip(names, parts)), F.lit(0.0))
    return df.withColumn(out, score / F.lit(float(total))).drop(*names)


def rotation_signal(
    df: DataFrame,
    score_cols: Sequence[tuple[str, float]],
    top_n: int = 10,
    trend_col: str | None = None,
    trend_threshold: float = 0.0,
    weighting: str = "equal",
    min_score: float | None = None,
    drop_missing: bool = False,
    keys: Sequence[str] = ("date",),
    *,
    fits: bool,
) -> DataFrame:
    """Target weights from a weighted mean of rank shares.

    A missing value ranks highest unless drop_missing is set; a column with
    fewer than two values on a date is left out there.
    """
    parts, weights = [], []
    for i, (field, weight) in enumerate(score_cols):
        x, n, present = c(field), F.col("__n"), F.col("__k")
        df = avg_rank(df, keys, field, "__r", fits)
        counts = {"__n": F.count(F.lit(1)), "__k": F.count(x)}
        if fits:
            df = df.withColumns({k: v.over(W.partitionBy(*keys)) for k, v in counts.items()})
        else:
            sizes = df.groupBy(*keys).agg(*[v.alias(k) for k, v in counts.items()])
            df = df.join(sizes, list(keys))
        if drop_missing:
            share = div("__r", present)
        else:
            # The missing ones share the mean of the ranks after the rest.
            share = div(F.coalesce(F.col("__r"), (n + present + 1) / F.lit(2.0)), n)
        used = (present >= 2).cast("double")
        df = df.withColumns({f"__s{i}": F.when(present >= 2, share), f"__u{i}": used}).drop("__r", "__n", "__k")
        parts.append(F.when(F.col(f"__u{i}") == 1, F.col(f"__s{i}") * weight).otherwise(0.0))
        weights.append(F.col(f"__u{i}") * weight)
    total = sum(weights[1:], weights[0])
    df = df.withColumn("score", div(sum(parts[1:], parts[0]), total))
    df = df.drop(*[f"__{p}{i}" for i in range(len(parts)) for p in "su"])
    keep = F.col("score").isNotNull()
    if trend_col is not None:
        keep = keep & compare(trend_col, ">", trend_threshold)
    if min_score is not None:
        keep = keep & (F.col("score") >= min_score)
    chosen = pick_top(df.filter(keep), top_n, keys=keys)
    return allocate(chosen, "score" if weighting == "score" else "equal", keys)


def momentum_signal(df: DataFrame, score: str, min_score: float, top_n: int, keys=("date",)) -> DataFrame:
    """Scores of at least min_score, the highest top_n, equal weights."""
    kept = df.withColumn("score", c(score)).filter(F.col("score") >= min_score)
    return allocate(pick_top(kept, top_n, keys=keys), "equal", keys)


def set_changes(weights: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """(period, symbol, change): kept, bought or sold against the set before.

    weights needs an integer period per rebalance.
    """
    now = weights.select(*keys, "period", "symbol", F.lit(True).alias("now"))
    before = weights.select(*keys, (F.col("period") + 1).alias("period"), "symbol", F.lit(True).alias("before"))
    last = weights.groupBy(*keys).agg(F.max("period").alias("__last"))
    both = now.join(before, [*keys, "period", "symbol"], "full_outer")
    both = both.join(F.broadcast(last), list(keys)) if keys else both.join(F.broadcast(last), F.lit(True))
    change = F.when(F.col("now") & F.col("before"), "kept").when(F.col("now"), "bought").otherwise("sold")
    return both.filter(F.col("period") <= F.col("__last")).select(*keys, "period", "symbol", change.alias("change"))


def monthly_pool(
    df: DataFrame, clusters: DataFrame | None = None, stable_size: int = 10
) -> DataFrame:
    """Eligible symbols and covered clusters on each month's last date."""
    days = df.select("date").distinct().withColumn("month", F.date_format("date", "yyyy-MM"))
    ends = days.groupBy("month").agg(F.max("date").alias("date"))
    rows = df.filter("eligible").select("date", "symbol")
    if clusters is not None:
        rows = rows.join(clusters, "symbol", "left").fillna(-1, ["cluster"])
    else:
        rows = rows.withColumn("cluster", F.lit(-1))
    # Two steps instead of a distinct count: one row per cluster and date first.
    per_cluster = rows.groupBy("date", "cluster").agg(F.count(F.lit(1)).alias("n"))
    pool = per_cluster.groupBy("date").agg(
        F.sum("n").alias("eligible_symbol_count"),
        F.sum((F.col("cluster") >= 0).cast("long")).alias("covered_cluster_count"),
        F.sum(F.when(F.col("cluster") < 0, F.col("n")).otherwise(0)).alias("unassigned_cluster_symbol_count"),
    )
    out = ends.join(pool, "date", "left").fillna(0)
    out = out.withColumn("is_pool_stable", F.col("eligible_symbol_count") >= stable_size)
    first = F.min(F.when(F.col("is_pool_stable"), F.col("date"))).over(W.partitionBy())
    return out.withColumn("is_stable_start", F.coalesce(F.col("date") == first, F.lit(False))).select(
        "month",
        F.col("date").alias("month_end_date"),
        "eligible_symbol_count",
        "covered_cluster_count",
        "unassigned_cluster_symbol_count",
        "is_pool_stable",
        "is_stable_start",
    )
