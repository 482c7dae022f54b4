"""Rotation results against a plain day-by-day simulation."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import performance as R
from barloom.operators import rotation as RO
from barloom.operators import selection as S
from fixtures import assert_close, bar_frame, to_bars

FEE = 0.003


@pytest.fixture(scope="module")
def setup(spark):
    pdf = bar_frame(symbols=6, rows=90, seed=21)
    bars = to_bars(spark, pdf)
    reb = S.rebalance_dates(bars.df, 10)
    rows = []
    opens = pdf.set_index(["symbol", "date"])["open"]
    rng = np.random.default_rng(2)
    for r in reb.orderBy("period").collect():
        names = [s for s in sorted(pdf.symbol.unique()) if (s, r["execution_date"]) in opens.index]
        if r["period"] == 3 or not names:
            continue  # one rebalance without targets
        pick = list(rng.permutation(names)[:3])
        w = rng.random(len(pick)) + 0.1
        rows += [("v", r["period"], r["date"], s, float(x)) for s, x in zip(pick, w / w.sum())]
    weights = spark.createDataFrame(rows, "variant string, period int, date date, symbol string, weight double")
    return pdf, bars, reb, weights


def prices(pdf, column):
    return pdf.pivot(index="date", columns="symbol", values=column).sort_index().ffill()


def simulate(pdf, reb, weights, overlap=False):
    opens, closes = prices(pdf, "open"), prices(pdf, "close")
    plan = {r.execution_date: r.period for r in reb.toPandas().itertuples()}
    w = weights.toPandas()
    cash, held, levels, executed = 1.0, {}, {}, []
    for day in opens.index:
        if day in plan:
            p = opens.loc[day]
            target = dict(w[w.period == plan[day]][["symbol", "weight"]].itertuples(index=False))
            current = {s: n * p[s] for s, n in held.items()}
            value = cash + sum(current.values())
            if overlap:
                sold = sum(v for s, v in current.items() if s not in target)
                cash += sold * (1 - FEE)
                fresh = {s: x for s, x in target.items() if s not in held}
                held = {s: n for s, n in held.items() if s in target}
                if fresh and cash > 0:
                    spend = cash / (1 + FEE)
                    for s, x in fresh.items():
                        held[s] = spend * x / sum(fresh.values()) / p[s]
                    cash -= spend * (1 + FEE)
                total = cash + sum(n * p[s] for s, n in held.items())
                executed += [(plan[day], s, n * p[s] / total) for s, n in held.items()]
            elif not target:
                cash = value - FEE * sum(current.values())
                held = {}
            else:
                lo, hi = 0.0, 1.0
                names = set(current) | set(target)
                for _ in range(60):
                    mid = (lo + hi) / 2
                    traded = sum(abs(value * mid * target.get(s, 0) - current.get(s, 0)) for s in names)
                    lo, hi = (mid, hi) if value - value * mid - FEE * traded >= 0 else (lo, mid)
                held = {s: value * lo * x / p[s] for s, x in target.items()}
                cash = 0.0
        if levels or day in plan:
            levels[day] = cash + sum(n * closes.loc[day, s] for s, n in held.items())
    return pd.Series(levels), executed


def test_equity_matches_simulation(setup):
    pdf, bars, reb, weights = setup
    run = RO.execute(weights, reb, bars.df, bars.df, FEE)
    got = RO.equity_levels(run).toPandas().set_index("date")["equity"].sort_index()
    want, _ = simulate(pdf, reb, weights)
    assert list(got.index) == list(want.index)
    assert_close(got, want, 1e-9)
    log = RO.rebalance_log(run).toPandas().sort_values("period")
    assert log["n_targets"].iloc[3] == 0 and np.isnan(log["turnover"].iloc[0])
    assert abs(log["turnover"].iloc[3] - 0.5) < 1e-9


def test_hold_overlap_matches_simulation(setup):
    pdf, bars, reb, weights = setup
    got = RO.hold_overlap_weights(weights, reb, bars.df, FEE).toPandas()
    _, want = simulate(pdf, reb, weights, overlap=True)
    want = {(p, s): x for p, s, x in want}
    assert {(r.period, r.symbol) for r in got.itertuples()} == set(want)
    for r in got.itertuples():
        assert abs(r.weight - want[r.period, r.symbol]) < 1e-9


def test_hold_overlap_reads_only_names_held_or_wanted(setup):
    _, bars, reb, weights = setup
    marks = RO._overlap_marks(weights, reb, bars.df)
    targets = {}
    for r in weights.collect():
        targets.setdefault(r.period, set()).add(r.symbol)
    want = {(p.period, s) for p in reb.collect() for s in targets.get(p.period, set()) | targets.get(p.period - 1, set())}
    rows = marks.collect()
    assert len(rows) == len(want) and {(r.period, r.symbol) for r in rows} == want
    assert len(want) < reb.count() * weights.select("symbol").distinct().count()
    plan = RO.hold_overlap_weights(weights, reb, bars.df)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stop_triggers(setup):
    pdf, bars, reb, weights = setup
    spells = RO.holding_spells(weights, reb)
    rules = [RO.StopRule("loss", 0.03), RO.StopRule("profit", 0.04, ratio=0.5), RO.StopRule("trailing_pct", 0.05)]
    got = {(r["symbol"], r["spell"]): (r["trigger_date"], r["ratio"]) for r in RO.stop_triggers(spells, bars.df, rules).collect()}
    for r in spells.collect():
        d = pdf[(pdf.symbol == r["symbol"]) & (pdf.date >= r["start"])]
        d = d[d.date < r["end"]] if r["end"] else d
        entry, high, hit = d.open.iloc[0], d.open.iloc[0], None
        for row in d.itertuples():
            high = max(high, row.close)
            ratio = max(
                1.0 if row.close <= entry * 0.97 else 0,
                0.5 if row.close >= entry * 1.04 else 0,
                1.0 if row.close <= high * 0.95 else 0,
            )
            if ratio:
                hit = (row.date, ratio)
                break
        assert got.get((r["symbol"], r["spell"])) == hit


@pytest.mark.parametrize("limit", [1_000_000, 12])
def test_positions(spark, limit):
    pdf = bar_frame(symbols=2, rows=120, seed=8)
    bars = to_bars(spark, pdf, limit)
    entry, leave = F.col("volume") > 22, F.col("volume") % 3 == 0
    out = R.position_from_signals(bars, entry, leave)
    got = out.df.toPandas().sort_values(["symbol", "date"])
    want = []
    for _, g in pdf.groupby("symbol"):
        state = 0
        for v in g.volume:
            state = (0 if v % 3 == 0 else 1) if state else (1 if v > 22 else 0)
            want.append(state)
    assert got["position"].tolist() == want
    trades = R.trade_table(out).count()
    assert trades == sum((np.diff(np.r_[0, g]) == -1).sum() for _, g in got.groupby("symbol")["position"])


def test_metrics(spark):
    rng = np.random.default_rng(0)
    dates = pd.bdate_range("2021-01-01", periods=300)
    ret = pd.Series(rng.normal(0.0005, 0.01, 300), index=dates)
    df = spark.createDataFrame(pd.DataFrame({"date": dates.date, "ret": ret.to_numpy()}))
    m = R.return_metrics(df).first()
    cum = (1 + ret).prod()
    level = (1 + ret).cumprod()
    assert m["cumulative_return"] == pytest.approx(cum - 1)
    assert m["annualised_return"] == pytest.approx(cum ** (252 / 300) - 1)
    assert m["annualised_volatility"] == pytest.approx(ret.std() * 252**0.5)
    assert m["max_drawdown"] == pytest.approx(-(level / level.cummax() - 1).min())
    d = R.drawdown_details(df).first()
    trough = (level / level.cummax() - 1).idxmin()
    assert d["trough_date"] == trough.date() and d["peak_date"] == level[:trough].idxmax().date()
    year = R.annual_returns(df).toPandas().set_index("year")["annual_return"]
    assert_close(year.sort_index(), (1 + ret).groupby(ret.index.year).prod() - 1)


def test_filters_and_allocators(spark):
    rows = [("v", "2020-01-01", f"s{i}", float(i), None if i == 0 else float(i)) for i in range(10)]
    df = spark.createDataFrame(rows, "variant string, date string, symbol string, score double, f double")
    kept = S.apply_rank_filters(df, [S.RankFilter("f", 0.2, 0.2)], fits=True)
    assert sorted(r["symbol"] for r in kept.collect()) == ["s2", "s3", "s4", "s5", "s6", "s7"]
    assert S.apply_threshold_filters(df, [S.ThresholdFilter("f", ">=", 0.0)]).count() == 9
    assert len(S.make_rank_filters("f", (0.1, 0.2))) == 8
    top = S.pick_top(df, 3)
    w = {r["symbol"]: r["weight"] for r in S.allocate(top, "tiered", tiers=((1, 2.0), (2, 1.0))).collect()}
    assert w == {"s9": 0.5, "s8": 0.25, "s7": 0.25}
    capped = S.exposure_caps(S.allocate(top, "equal"), 0.0, 0.3, 0.6).collect()
    assert sum(r["weight"] for r in capped) == pytest.approx(0.6)


@pytest.mark.parametrize("fits", [True, False])
def test_rotation_signal(spark, fits):
    pdf = pd.DataFrame({"date": ["d1"] * 6 + ["d2"] * 6, "symbol": list("abcdef") * 2})
    pdf["x"] = [1.0, 2.0, 2.0, np.nan, 5.0, np.nan, 3.0, 1.0, 4.0, 1.0, 5.0, 9.0]
    pdf["y"] = [3.0, np.nan, 1.0, 2.0, 2.0, 7.0] + [np.nan] * 5 + [1.0]
    df = spark.createDataFrame(pdf)
    df = df.select("date", "symbol", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in "xy"])
    out = S.rotation_signal(df, [("x", 1.0), ("y", 0.5)], 3, weighting="score", fits=fits).toPandas()
    for day, g in pdf.groupby("date"):
        cols = [(c, w) for c, w in (("x", 1.0), ("y", 0.5)) if g[c].notna().sum() >= 2]
        score = sum(g[c].rank(pct=True, na_option="bottom") * w for c, w in cols) / sum(w for _, w in cols)
        best = pd.DataFrame({"s": g["symbol"], "v": score}).sort_values(["v", "s"], ascending=[False, True]).head(3)
        got = out[out["date"] == day].set_index("symbol")
        assert set(got.index) == set(best["s"])
        for r in best.itertuples():
            assert abs(got.loc[r.s, "score"] - r.v) < 1e-12
            assert abs(got.loc[r.s, "weight"] - r.v / best["v"].sum()) < 1e-12
