"""A rotation strategy, or a grid of them, from features to a summary row."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import Bars
from ..functions.scalar import c, div
from ..operators import performance as R
from ..operators import rotation as RO
from ..operators import selection as S
from ..operators.crosssection import avg_rank


#: A variant's settings that are read here.
SETTINGS = ("score", "conditions", "rank_filters", "top_n", "cluster_max", "allocator", "allocator_options", "exclude_clusters")


@dataclass(frozen=True)
class Targets:
    """weights (variant, period, date, symbol, weight) and counts (variant, date,
    candidate_count, filtered_candidate_count, counts_after, active_candidate_filters)."""

    weights: DataFrame
    counts: DataFrame


def grid(groups: Mapping[str, Mapping], variants: Mapping[str, Mapping]) -> dict[str, dict]:
    """Every group with every variant, named group/variant; a variant's settings
    come on top of its group's."""
    out = {}
    for (g, base), (v, more) in itertools.product(groups.items(), variants.items()):
        unknown = (set(base) | set(more)) - set(SETTINGS)
        if unknown:
            raise ValueError(f"unknown settings {sorted(unknown)}")
        out[f"{g}/{v}"] = {**base, **more}
    return out


def _by_variant(variants: Mapping[str, Mapping], value) -> Column:
    """value(settings) of the row's variant; equal values share a branch."""
    out = F.lit(None)
    for name, v in variants.items():
        found = value(v)
        if found is not None:
            out = F.when(F.col("variant") == name, found).otherwise(out)
    return out


def variant_targets(
    features: Bars, rebalances: DataFrame, variants: Mapping[str, Mapping], clusters: DataFrame | None = None
) -> Targets:
    """Target weights of every variant from one candidate table, in one plan.

    Candidates are joined with their next open once. Conditions are columns of this
    table: each row has, per variant, the number of the first condition it fails.
    Rows are then unfolded into the variants that let them pass, with the variant's
    score, and ranked, cut and weighted by (variant, date). The k-th rank filters of
    all variants are one pass.

    A variant may set score, conditions (over own or other symbols' columns),
    rank_filters, top_n, cluster_max, exclude_clusters, allocator (a name, a column or a function giving one)
    and allocator_options.
    """
    # One condition stands in the table once, however many variants name it.
    rows = S.raw_candidates(features.df, rebalances, "__any", clusters, checked=False)
    named = [[S.Condition.of(x) for x in v.get("conditions", ())] for v in variants.values()]
    others = [o for conditions in named for x in conditions for o in x.others]
    if others:
        rows = S.with_others(rows, features, others)
    items = []
    for (name, v), conditions in zip(variants.items(), named, strict=True):
        failed = F.lit(None).cast("int")
        for i, x in reversed(list(enumerate(conditions))):
            failed = F.when(x.passed, failed).otherwise(i)
        score = c(v.get("score", "score")).cast("double")
        open_ = score.isNotNull()
        if v.get("exclude_clusters"):
            open_ = open_ & ~F.col("cluster").isin(list(v["exclude_clusters"]))
        items.append(F.struct(F.lit(name).alias("variant"), F.when(open_, score).alias("score"), failed.alias("failed_at")))
    rows = rows.withColumn("__v", F.filter(F.array(*items), lambda x: x["score"].isNotNull())).drop(*{o.name for o in others}, "variant", "score")
    # Counts need a flag per variant and row, not the row's columns.
    flags = rows.select("date", F.explode("__v").alias("v")).select("date", "v.variant", "v.failed_at")
    longest = max(len(x) for x in named)
    after = [F.sum((F.col("failed_at").isNull() | (F.col("failed_at") > i)).cast("long")) for i in range(longest)]
    counts = flags.groupBy("variant", "date").agg(
        F.count(F.lit(1)).alias("candidate_count"),
        F.sum(F.col("failed_at").isNull().cast("long")).alias("filtered_candidate_count"),
        (F.array(*after) if after else F.array().cast("array<bigint>")).alias("__after"),
    )
    labels = {n: [x.name for x in conditions] for n, conditions in zip(variants, named, strict=True)}
    label = _by_variant(labels, lambda names: F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>"))
    counts = counts.withColumn("active_candidate_filters", label)
    counts = counts.withColumn("counts_after", F.slice("__after", F.lit(1), F.size("active_candidate_filters"))).drop("__after")

    passed = rows.withColumn("__v", F.explode(F.filter("__v", lambda x: x["failed_at"].isNull())))
    passed = passed.withColumns({"variant": F.col("__v.variant"), "score": F.col("__v.score")}).drop("__v")
    passed = _rank_filtered(passed, variants, features.date_fits)
    chosen = _picked(passed, variants)
    raw = _by_variant(variants, lambda v: S.raw_weight(v.get("allocator", "equal"), **v.get("allocator_options", {})))
    return Targets(S.allocate(chosen, raw).select("variant", "period", "date", "symbol", "weight"), counts)


def _rank_filtered(df: DataFrame, variants: Mapping[str, Mapping], fits: bool) -> DataFrame:
    for k in range(max(len(v.get("rank_filters", ())) for v in variants.values())):
        kth = {n: v["rank_filters"][k] if len(v.get("rank_filters", ())) > k else None for n, v in variants.items()}
        df = df.withColumns(
            {
                "__x": _by_variant(kth, lambda f: None if f is None else c(f.field).cast("double")).cast("double"),
                "__lo": _by_variant(kth, lambda f: None if f is None else F.lit(float(f.exclude_below_pct))).cast("double"),
                "__hi": _by_variant(kth, lambda f: None if f is None else F.lit(1.0 - f.exclude_above_pct)).cast("double"),
            }
        )
        df = avg_rank(df, S.GROUP, "__x", "__pct", fits, pct=True)
        if fits:
            df = df.withColumn("__some", F.count("__x").over(W.partitionBy(*S.GROUP)))
        else:
            df = df.join(df.groupBy(*S.GROUP).agg(F.count("__x").alias("__some")), list(S.GROUP))
        inside = (F.col("__pct") > F.col("__lo")) & (F.col("__pct") <= F.col("__hi"))
        free = F.col("__lo").isNull() | (F.col("__some") == 0)
        df = df.filter(free | F.coalesce(inside, F.lit(False))).drop("__x", "__lo", "__hi", "__pct", "__some")
    return df


def _picked(df: DataFrame, variants: Mapping[str, Mapping]) -> DataFrame:
    """Each variant's own number of rows; the largest is a bound Spark applies
    before the shuffle."""
    order = [F.col("score").desc(), F.col("symbol")]
    if any(v.get("cluster_max") is not None for v in variants.values()):
        most = _by_variant(variants, lambda v: None if v.get("cluster_max") is None else F.lit(int(v["cluster_max"]))).cast("int")
        seat = F.row_number().over(W.partitionBy(*S.GROUP, "cluster").orderBy(*order))
        df = df.withColumn("__seat", seat).filter(most.isNull() | (F.col("cluster") < 0) | (F.col("__seat") <= most)).drop("__seat")
    sizes = {n: int(v.get("top_n", 10)) for n, v in variants.items()}
    df = df.withColumn("rank", F.row_number().over(W.partitionBy(*S.GROUP).orderBy(*order))).filter(F.col("rank") <= max(sizes.values()))
    return df.filter(F.col("rank") <= _by_variant(sizes, F.lit))


def variant_weights(
    features: Bars,
    rebalances: DataFrame,
    variants: Mapping[str, Mapping],
    clusters: DataFrame | None = None,
) -> DataFrame:
    """Target weights of every variant, see `variant_targets`."""
    return variant_targets(features, rebalances, variants, clusters).weights


def run_variants(
    features: Bars,
    rebalances: DataFrame,
    variants: Mapping[str, Mapping],
    dates: DataFrame,
    ranges: DataFrame | None = None,
    clusters: DataFrame | None = None,
    commission: float = 0.0,
) -> DataFrame:
    """A summary row per variant, or per variant and row of ranges (period, start,
    end): all measured on one equity of each variant."""
    run = RO.execute(variant_weights(features, rebalances, variants, clusters), rebalances, dates, features.df, commission)
    out = run_grid(run) if ranges is None else date_range_variants(RO.equity_levels(run), ranges)
    parts = F.split("variant", "/")
    return out.withColumns({"group": F.when(F.size(parts) > 1, parts[0])})


def run_grid(run: RO.Executed, rf: float = 0.0) -> DataFrame:
    """One summary row per variant: growth, risk, drawdown, turnover, win rate."""
    returns = RO.to_returns(RO.equity_levels(run))
    figures = R.return_metrics(returns, ["variant"], rf)
    worst = R.drawdown_details(returns, ["variant"]).drop("max_drawdown")
    grown = run.scales.filter(F.col("gross").isNotNull())
    wins = grown.groupBy("variant").agg(
        F.avg((F.col("gross") > 1).cast("double")).alias("rebalance_win_rate"),
        F.count("gross").alias("completed_period_count"),
    )
    moved = RO.turnover(run.weights, run.rebalances).groupBy("variant").agg(
        F.avg("turnover").alias("avg_turnover"), F.count(F.lit(1)).alias("rebalance_count")
    )
    out = figures.join(worst, "variant").join(wins, "variant").join(moved, "variant")
    calmar = F.when(F.col("max_drawdown") > 0, div("annualised_return", "max_drawdown"))
    return out.withColumn("calmar", calmar)


def date_range_variants(levels: DataFrame, ranges: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    """The same equity measured over each row of a small (period, start, end)
    table."""
    return R.range_metrics(RO.to_returns(levels), ranges, keys)
