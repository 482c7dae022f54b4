"""From target weights to portfolio returns, without a day-by-day simulator.

A rebalance resets exposure to the target weights, so between two executions
the portfolio is a weighted sum of price ratios. Costs need only the weights the
old portfolio drifted to and the new target. Levels are products of both.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import c, compare, div
from ..sources.session import cut_lineage
from .panel import calendar


def holding_days(weights: DataFrame, rebalances: DataFrame, dates: DataFrame, bars: DataFrame) -> DataFrame:
    """One row per holding and date from its execution to the next execution.

    weights: (variant, period, symbol, weight); rebalances: (period, date,
    execution_date). Prices are the latest known ones, starting at the open and
    close of the execution date. A holding has at most one interval of rows.
    """
    days = period_days(rebalances, dates)
    rows = weights.select("variant", "period", "symbol", "weight").join(F.broadcast(days), "period")
    rows = rows.join(bars.select("symbol", "date", "open", "close"), ["symbol", "date"], "left")
    spell = W.partitionBy("variant", "period", "symbol").orderBy("date")
    known = spell.rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumns(
        {
            "open": F.last("open", ignorenulls=True).over(known),
            "close": F.last("close", ignorenulls=True).over(known),
            "entry_open": F.first("open", ignorenulls=True).over(known),
            "is_exit": F.col("date") == F.col("end"),
        }
    )


def period_days(rebalances: DataFrame, dates: DataFrame) -> DataFrame:
    """(period, date, start, end): the calendar dates of each period, the next
    execution included. A running period number over the calendar, which has a row
    per date, and a second row for the executions that end a period."""
    spans = rebalances.select(
        "period",
        F.col("execution_date").alias("start"),
        F.lead("execution_date").over(W.orderBy("period")).alias("end"),
    )
    marks = spans.select(F.col("start").alias("date"), F.struct("period", "start", "end").alias("__s"))
    cal = calendar(dates).select("date").join(F.broadcast(marks), "date", "left")
    now = F.last("__s", ignorenulls=True).over(W.orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    inside = cal.withColumn("__s", now).filter(F.col("__s").isNotNull()).select("__s.period", "date", "__s.start", "__s.end")
    ends = spans.filter(F.col("end").isNotNull()).select("period", F.col("end").alias("date"), "start", "end")
    return inside.unionByName(ends)


def period_gross(holdings: DataFrame) -> DataFrame:
    """Value just before the next execution per unit invested (NULL while open),
    with the symbol weights drifted to that open."""
    last = holdings.filter("is_exit").withColumn("__v", F.col("weight") * div("open", "entry_open"))
    total = F.sum("__v").over(W.partitionBy("variant", "period"))
    return last.select(
        "variant", "period", "symbol", total.alias("gross"), div("__v", total).alias("drifted")
    )


def cost_scale(pairs: Column, commission: float) -> Column:
    """Invested share s with s + c * sum |s * w - e| = 1, by 60 halvings.

    pairs: array of (w, e), target and drifted weights of one rebalance.
    """

    def cash(s: Column) -> Column:
        traded = F.aggregate(
            pairs, F.lit(0.0), lambda acc, p: acc + F.abs(s * p["w"] - p["e"])
        )
        return 1.0 - s - F.lit(float(commission)) * traded

    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2.0
        enough = cash(mid) >= 0
        return F.struct(
            F.when(enough, mid).otherwise(acc["lo"]).alias("lo"),
            F.when(enough, acc["hi"]).otherwise(mid).alias("hi"),
        )

    start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"))
    solved = F.aggregate(F.sequence(F.lit(1), F.lit(60)), start, halve)["lo"]
    # Without a target everything is sold for cash.
    held = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.abs(p["e"]))
    wanted = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + p["w"])
    return F.when(wanted > 0, solved).otherwise(1.0 - F.lit(float(commission)) * held)


def rebalance_scales(
    weights: DataFrame, rebalances: DataFrame, holdings: DataFrame, commission: float
) -> DataFrame:
    """(variant, period, scale, gross): share kept after costs at the period's
    execution and growth until the next one."""
    moved = period_gross(holdings)
    before = moved.select(
        "variant", (F.col("period") + 1).alias("period"), "symbol", F.col("drifted").alias("e")
    )
    target = weights.select("variant", "period", "symbol", F.col("weight").alias("w"))
    pairs = target.join(before, ["variant", "period", "symbol"], "full_outer").fillna(0.0, ["w", "e"])
    # At most the two holding sets of one rebalance, so the array is small.
    packed = pairs.groupBy("variant", "period").agg(F.collect_list(F.struct("w", "e")).alias("pairs"))
    gross = moved.groupBy("variant", "period").agg(F.max("gross").alias("gross"))
    every = weights.select("variant").distinct().join(F.broadcast(rebalances.select("period")), F.lit(True))
    rows = every.join(packed, ["variant", "period"], "left").join(gross, ["variant", "period"], "left")
    scale = F.when(F.col("pairs").isNull(), 1.0).otherwise(cost_scale(F.col("pairs"), commission))
    return rows.select("variant", "period", scale.alias("scale"), "gross")


@dataclass(frozen=True)
class Executed:
    """Target weights carried through every execution."""

    weights: DataFrame
    rebalances: DataFrame
    dates: DataFrame
    holdings: DataFrame
    scales: DataFrame


def execute(
    weights: DataFrame, rebalances: DataFrame, dates: DataFrame, bars: DataFrame, commission: float = 0.0
) -> Executed:
    """Holdings, growth and costs of all variants.

    Calendar, targets and holdings are a small part of the bars and are read by
    several later steps, so each is written out once instead of being rebuilt
    from the bars every time.
    """
    dates = cut_lineage(dates.select("date").distinct())
    rebalances = cut_lineage(rebalances)
    weights = cut_lineage(weights.select("variant", "period", "symbol", "weight"))
    holdings = cut_lineage(holding_days(weights, rebalances, dates, bars))
    scales = cut_lineage(rebalance_scales(weights, rebalances, holdings, commission))
    return Executed(weights, rebalances, dates, holdings, scales)


def equity_levels(run: Executed) -> DataFrame:
    """(variant, date, equity): portfolio level at each close from the first
    execution on, starting at 1 before costs."""
    w = W.partitionBy("variant").orderBy("period")
    chained = run.scales.withColumn(
        "base",
        F.product(F.col("scale")).over(w.rowsBetween(W.unboundedPreceding, 0))
        * F.coalesce(
            F.product(F.coalesce("gross", F.lit(1.0))).over(w.rowsBetween(W.unboundedPreceding, -1)),
            F.lit(1.0),
        ),
    )
    days = period_days(run.rebalances, run.dates).filter("end is null or date < end").select("period", "date")
    value = (
        run.holdings.filter(~F.coalesce("is_exit", F.lit(False)))
        .groupBy("variant", "period", "date")
        .agg(F.sum(F.col("weight") * div("close", "entry_open")).alias("ratio"))
    )
    levels = chained.join(F.broadcast(days), "period").join(value, ["variant", "period", "date"], "left")
    return levels.select(
        "variant", "date", (F.col("base") * F.coalesce("ratio", F.lit(1.0))).alias("equity")
    )


def to_returns(levels: DataFrame, keys: Sequence[str] = ("variant",)) -> DataFrame:
    w = W.partitionBy(*keys).orderBy("date")
    df = levels.withColumn("ret", div("equity", F.lag("equity", 1).over(w)) - 1)
    return df.filter(F.col("ret").isNotNull()).drop("equity")


def turnover(weights: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Half the absolute change of target weights; missing for the first."""
    now = weights.select("variant", "period", "symbol", F.col("weight").alias("w"))
    before = weights.select(
        "variant", (F.col("period") + 1).alias("period"), "symbol", F.col("weight").alias("b")
    )
    change = now.join(before, ["variant", "period", "symbol"], "full_outer").fillna(0.0, ["w", "b"])
    sums = change.groupBy("variant", "period").agg((F.sum(F.abs(F.col("w") - F.col("b"))) / 2.0).alias("__t"))
    every = weights.select("variant").distinct().join(F.broadcast(rebalances.select("period")), F.lit(True))
    first = rebalances.agg(F.min("period").alias("__first"))
    rows = every.join(sums, ["variant", "period"], "left").join(F.broadcast(first), F.lit(True))
    value = F.when(F.col("period") > F.col("__first"), F.coalesce("__t", F.lit(0.0)))
    return rows.select("variant", "period", value.alias("turnover"))


def rebalance_log(run: Executed, counts: DataFrame | None = None) -> DataFrame:
    """One row per variant and rebalance: weights, turnover, costs, growth.

    target_weights; current_weights, what is held at the signal date's close, drifted
    from the targets before; executed_weights, shares of what is left after costs at
    the execution's open. counts (variant, date, ...): what `screened_counts` gives
    for the signal dates. Maps hold the names of one rebalance."""
    weights, rebalances, scales = run.weights, run.rebalances, run.scales
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "weight"))))
    targets = weights.groupBy("variant", "period").agg(entry.alias("target_weights"))
    out = (
        scales.join(F.broadcast(rebalances), "period")
        .join(turnover(weights, rebalances), ["variant", "period"])
        .join(targets, ["variant", "period"], "left")
        .join(current_weights(run), ["variant", "period"], "left")
        .select(
            "variant",
            "period",
            F.col("date").alias("signal_date"),
            "execution_date",
            F.map_keys("target_weights").alias("selected_symbols"),
            "current_weights",
            "target_weights",
            # All is invested, so the shares after costs are those wanted.
            F.when(F.col("scale") > 0, F.col("target_weights")).alias("executed_weights"),
            F.coalesce(F.size("target_weights"), F.lit(0)).alias("n_targets"),
            "turnover",
            (1.0 - F.col("scale")).alias("cost_share"),
            (F.col("gross") - 1.0).alias("period_return"),
        )
    )
    if counts is not None:
        out = out.join(counts.withColumnRenamed("date", "signal_date"), ["variant", "signal_date"], "left")
        out = out.fillna(0, ["candidate_count", "filtered_candidate_count"])
    return out


def current_weights(run: Executed) -> DataFrame:
    """(variant, period, current_weights): shares held at the close of the period's
    signal date, of the holdings that the period before brought."""
    signals = run.rebalances.select(F.col("period").alias("__p"), "date")
    # A period's own signal lies before its execution, so these rows are of the one before.
    rows = run.holdings.filter(~F.coalesce("is_exit", F.lit(False))).join(F.broadcast(signals), "date")
    rows = rows.withColumn("__v", F.col("weight") * div("close", "entry_open"))
    share = div("__v", F.sum("__v").over(W.partitionBy("variant", "__p")))
    entry = F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", F.col("__w").alias("weight")))))
    rows = rows.withColumn("__w", share).groupBy("variant", F.col("__p").alias("period")).agg(entry.alias("current_weights"))
    return rows


def _opens_at_executions(bars: DataFrame, rebalances: DataFrame) -> DataFrame:
    """(symbol, period, open): the last open after the previous execution and
    up to this one; missing when the symbol had no bar in between."""
    runs = rebalances.select("period", F.col("execution_date").alias("date"))
    ahead = W.orderBy("date").rowsBetween(0, W.unboundedFollowing)
    steps = bars.select("date").distinct().join(F.broadcast(runs), "date", "left")
    steps = steps.withColumn("period", F.first("period", ignorenulls=True).over(ahead))
    rows = bars.select("symbol", "date", "open").join(F.broadcast(steps.dropna(subset=["period"])), "date")
    return rows.groupBy("symbol", "period").agg(F.max_by("open", "date").alias("open"))


def _overlap_marks(weights: DataFrame, rebalances: DataFrame, bars: DataFrame) -> DataFrame:
    """(variant, period, symbol, weight, open) for the names in the target of this
    rebalance, and with a missing weight for those only in the target of the one
    before: no other name can be held. open is the latest known one."""
    runs = rebalances.select("period", F.lead("period").over(W.orderBy("period")).alias("next"))
    targets = weights.join(F.broadcast(runs), "period")
    before = targets.dropna(subset=["next"]).select("variant", F.col("next").alias("period"), "symbol", F.lit(None).cast("double").alias("weight"))
    marks = targets.select("variant", "period", "symbol", "weight").unionByName(before)
    marks = marks.groupBy("variant", "period", "symbol").agg(F.max("weight").alias("weight"))
    asked = marks.select("symbol", "period").distinct()
    opens = _opens_at_executions(bars, rebalances).join(asked.select("symbol").distinct(), "symbol", "left_semi")
    known = W.partitionBy("symbol").orderBy("period").rowsBetween(W.unboundedPreceding, 0)
    opens = (
        opens.withColumn("asked", F.lit(False))
        .unionByName(asked.withColumn("open", F.lit(None).cast("double")).withColumn("asked", F.lit(True)))
        .groupBy("symbol", "period")
        .agg(F.max("open").alias("open"), F.max("asked").alias("asked"))
        .withColumn("open", F.last("open", ignorenulls=True).over(known))
        .filter("asked")
    )
    return marks.join(opens.select("symbol", "period", "open"), ["symbol", "period"])


def hold_overlap_weights(
    weights: DataFrame, rebalances: DataFrame, bars: DataFrame, commission: float = 0.0
) -> DataFrame:
    """Executed weights when names in both sets are left untouched and new names
    share the cash the sold ones free.

    Each rebalance depends on the one before, so variants are folded in order
    over the names of each target and of the one before it.
    """
    marks = _overlap_marks(weights, rebalances, bars)
    fee = float(commission)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        held: dict[str, float] = {}
        cash, rows = 1.0, []
        for period, g in pdf.sort_values(["period", "symbol"]).groupby("period"):
            price = dict(zip(g["symbol"], g["open"]))
            target = {s: w for s, w in zip(g["symbol"], g["weight"]) if w == w}
            sold = sum(n * price[s] for s, n in held.items() if s not in target)
            cash += sold * (1.0 - fee)
            fresh = {s: w for s, w in target.items() if s not in held}
            held = {s: n for s, n in held.items() if s in target}
            if fresh and cash > 0:
                spend, total = cash / (1.0 + fee), sum(fresh.values())
                for s, w in fresh.items():
                    share = w / total if total > 0 else 1.0 / len(fresh)
                    held[s] = spend * share / price[s]
                cash -= spend * (1.0 + fee)
            cash = 0.0 if abs(cash) < 1e-10 else cash
            value = cash + sum(n * price[s] for s, n in held.items())
            rows += [(g["variant"].iloc[0], period, s, n * price[s] / value) for s, n in held.items()]
        return pd.DataFrame(rows, columns=["variant", "period", "symbol", "weight"])

    return marks.groupBy("variant").applyInPandas(
        fold, "variant string, period int, symbol string, weight double"
    )


@dataclass(frozen=True)
class StopRule:
    """kind: loss, profit, trailing_pct, trailing_atr or factor.

    value is the percentage, multiple or threshold; field and op name the
    factor; ratio is the share that is sold.
    """

    kind: str
    value: float
    field: str = ""
    op: str = ">="
    ratio: float = 1.0

    def __post_init__(self):
        if self.kind in ("loss", "trailing_pct") and not 0 < self.value < 1:
            raise ValueError("the share must be in (0, 1)")
        if self.kind in ("profit", "trailing_atr") and self.value <= 0:
            raise ValueError("the value must be positive")
        if not 0 < self.ratio <= 1:
            raise ValueError("ratio must be in (0, 1]")

    def triggered(self) -> Column:
        close, entry, high = F.col("close"), F.col("entry_price"), F.col("high_since_entry")
        if self.kind == "loss":
            hit = close <= entry * (1.0 - self.value)
        elif self.kind == "profit":
            hit = close >= entry * (1.0 + self.value)
        elif self.kind == "trailing_pct":
            hit = close <= high * (1.0 - self.value)
        elif self.kind == "trailing_atr":
            hit = high - self.value * c(self.field) > close
        elif self.kind == "factor":
            return compare(self.field, self.op, self.value)
        else:
            raise ValueError(f"unknown stop rule {self.kind!r}")
        return F.coalesce(hit, F.lit(False))


def holding_spells(weights: DataFrame, rebalances: DataFrame) -> DataFrame:
    """Consecutive periods a name is held: (variant, symbol, spell, start, end)."""
    w = W.partitionBy("variant", "symbol").orderBy("period")
    island = F.col("period") - F.row_number().over(w)
    runs = (
        weights.withColumn("__i", island)
        .groupBy("variant", "symbol", "__i")
        .agg(F.min("period").alias("first_period"), F.max("period").alias("last_period"))
    )
    starts = rebalances.select(F.col("period").alias("first_period"), F.col("execution_date").alias("start"))
    nexts = rebalances.select((F.col("period") - 1).alias("last_period"), F.col("execution_date").alias("end"))
    return (
        runs.join(F.broadcast(starts), "first_period")
        .join(F.broadcast(nexts), "last_period", "left")
        .select("variant", "symbol", F.col("first_period").alias("spell"), "start", "end")
    )


def stop_triggers(
    spells: DataFrame, bars: DataFrame, rules: Sequence[StopRule], fields: Sequence[str] = ()
) -> DataFrame:
    """First date on which any rule fires in each spell, with the largest ratio.

    Entry is the open of the spell's first bar; a spell is bounded by the
    calendar, and spells are spread over tasks by variant and symbol.
    """
    days = bars.select("symbol", "date", "open", "close", *fields)
    # A bar belongs to the last spell that began by its date: starts are rows
    # among the bars, ahead of the bar of their day, and are carried forward.
    held = spells.select("variant", "symbol").distinct()
    starts = spells.select("variant", "symbol", F.col("start").alias("date"), F.struct("spell", "start", "end").alias("__s"))
    rows = days.join(held, "symbol").withColumn("__bar", F.lit(True))
    rows = rows.unionByName(starts.withColumn("__bar", F.lit(False)), allowMissingColumns=True)
    so_far = W.partitionBy("variant", "symbol").orderBy("date", "__bar").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__s", F.last("__s", ignorenulls=True).over(so_far)).filter("__bar and __s is not null")
    rows = rows.select("*", "__s.*").drop("__s", "__bar").filter(F.col("end").isNull() | (F.col("date") < F.col("end")))
    w = W.partitionBy("variant", "symbol", "spell").orderBy("date")
    known = w.rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("entry_price", F.first("open").over(known))
    rows = rows.withColumn("high_since_entry", F.greatest(F.max("close").over(known), "entry_price"))
    ratio = F.greatest(*[F.when(r.triggered(), r.ratio).otherwise(0.0) for r in rules], F.lit(0.0))
    fired = rows.withColumn("ratio", ratio).filter(F.col("ratio") > 0)
    first = F.min_by(F.struct("date", "ratio", "entry_price", "close"), "date")
    return (
        fired.groupBy("variant", "symbol", "spell")
        .agg(first.alias("x"))
        .select("variant", "symbol", "spell", F.col("x.date").alias("trigger_date"), "x.ratio", "x.entry_price", "x.close")
    )


def stop_fills(triggers: DataFrame, dates: DataFrame, bars: DataFrame) -> DataFrame:
    """Sales at the next bar's open with the profit against the entry."""
    cal = calendar(dates)
    nexts = cal.select(
        F.col("date").alias("trigger_date"), F.lead("date").over(W.orderBy("t")).alias("execution_date")
    )
    opens = bars.select("symbol", F.col("date").alias("execution_date"), F.col("open").alias("exit_price"))
    return (
        triggers.join(F.broadcast(nexts), "trigger_date")
        .join(opens, ["symbol", "execution_date"])
        .select(
            "variant", "symbol", "spell", "trigger_date", "execution_date", "ratio", "entry_price",
            "exit_price", ((div("exit_price", "entry_price") - 1) * 100.0).alias("pnl_pct"),
        )
    )
