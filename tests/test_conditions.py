"""Conditions, counts and grids of selection; as-of values without a grid."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import joins
from barloom.operators import rotation as RO
from barloom.operators import selection as S
from barloom.plans import rotation_run as P
from fixtures import bar_frame, to_bars


def as_of_frame(pdf, columns, days):
    out = []
    for symbol, g in pdf.groupby("symbol"):
        g = g.sort_values("date")
        for day in sorted(days):
            known = g[g.date <= day]
            if len(known):
                out.append((symbol, day, *[known[c].dropna().iloc[-1] if known[c].notna().any() else None for c in columns]))
    return sorted(out, key=str)


@pytest.mark.parametrize("limit", [1_000_000, 7])
@pytest.mark.parametrize("asked", ["all", "few", "between"])
def test_as_of(spark, limit, asked):
    pdf = bar_frame(symbols=4, rows=40)
    pdf = pdf[~((pdf.symbol == "S1") & pdf.date.isin(sorted(pdf.date.unique())[5:12]))].reset_index(drop=True)
    pdf.loc[pdf.index % 5 == 2, "close"] = None
    days = sorted(pdf.date.unique())
    days = {"all": days, "few": days[3::11], "between": [dt.date(2019, 1, 1), dt.date(2020, 1, 4), dt.date(2020, 2, 2), dt.date(2030, 1, 1)]}[asked]
    bars = to_bars(spark, pdf.assign(close=pdf.close.astype(object).where(pdf.close.notna(), None)), limit)
    dates = spark.createDataFrame([(d,) for d in days], "date date")
    got = joins.as_of(bars, ["close", "volume"], dates)
    assert sorted((tuple(r) for r in got.collect()), key=str) == as_of_frame(pdf, ["close", "volume"], days)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def features(spark):
    pdf = bar_frame(symbols=8, rows=120, seed=5)
    pdf["mom"] = pdf.groupby("symbol").close.pct_change(10)
    pdf["vol"] = pdf.groupby("symbol").close.transform(lambda x: x.pct_change().rolling(10).std())
    pdf = pdf.astype(object).where(pdf.notna(), None)
    bars = to_bars(spark, pdf)
    df = bars.df.withColumns({c: F.col(c).cast("double") for c in ("mom", "vol")})
    return pdf, bars.with_df(S.eligible(df, "mom", 5, fits=True))


BENCH = S.Other("S0", "mom")
CONDITIONS = (S.ThresholdFilter("volume", ">", 3.0), S.Condition("beats", lambda: F.col("mom") > BENCH.column, (BENCH,)))


def plain(pdf, reb, score, conditions):
    """Candidates by date, and what each condition leaves."""
    out = {}
    opens = {(r.symbol, r.date): r.open for r in pdf.itertuples()}
    first = pdf.groupby("symbol").date.min()
    for r in reb:
        bench = pdf[(pdf.symbol == "S0") & (pdf.date <= r.date) & pdf.mom.notna()].mom
        rows, failed = [], []
        for x in pdf[pdf.date == r.date].itertuples():
            if x.mom is None or getattr(x, score) is None or x.date <= first[x.symbol] + dt.timedelta(days=5) or not opens.get((x.symbol, r.execution_date)):
                continue
            checks = [x.volume > 3.0, len(bench) > 0 and x.mom > bench.iloc[-1]][: len(conditions)]
            failed.append(checks.index(False) if False in checks else None)
            rows.append(x)
        out[r.date] = rows, failed
    return out


def test_conditions_and_counts(spark, features):
    pdf, feats = features
    reb = S.rebalance_dates(feats.df, 7)
    candidates = S.raw_candidates(feats.df, reb, "mom")
    screened = S.screen(candidates, CONDITIONS, feats)
    want = plain(pdf, reb.collect(), "mom", CONDITIONS)
    got = {(r.date, r.symbol): r.failed_at for r in screened.collect()}
    assert got == {(d, x.symbol): f for d, (rows, failed) in want.items() for x, f in zip(rows, failed, strict=True)}
    assert {0, 1, None} == set(got.values())
    counts = {r.date: r for r in S.screened_counts(screened, CONDITIONS).collect()}
    for day, (rows, failed) in want.items():
        if not rows:
            continue
        r = counts[day]
        assert (r.candidate_count, r.filtered_candidate_count) == (len(rows), sum(f is None for f in failed))
        assert r.counts_after == [sum(f is None or f > i for f in failed) for i in range(2)]
        assert r.active_candidate_filters == ["volume>3.0", "beats"]


def test_grid_equals_variants_one_by_one(spark, features):
    pdf, feats = features
    reb = S.rebalance_dates(feats.df, 7)
    clusters = spark.createDataFrame([(f"S{i}", i % 3) for i in range(8)], "symbol string, cluster int")
    groups = {"a": {"score": "mom", "conditions": CONDITIONS}, "b": {"score": "vol", "rank_filters": (S.RankFilter("mom", 0.2, 0.1),), "exclude_clusters": (2,)}}
    variants = {
        "one": {"top_n": 1},
        "two": {"top_n": 3, "cluster_max": 1, "allocator": "inverse_factor", "allocator_options": {"field": "vol"}},
        "own": {"top_n": 2, "allocator": lambda: F.when(F.col("rank") == 1, 3.0).otherwise(F.lit(1.0)), "rank_filters": (S.RankFilter("vol", 0.1), S.RankFilter("mom", 0.0, 0.2))},
    }
    every = P.grid(groups, variants)
    assert len(every) == 6
    made = P.variant_targets(feats, reb, every, clusters)
    got = {(r.variant, r.period, r.symbol): r.weight for r in made.weights.collect()}
    want = {}
    for name, v in every.items():
        rows = S.raw_candidates(feats.df, reb, v["score"], clusters, v.get("exclude_clusters", ()), name)
        rows = S.screen(rows, v.get("conditions", ()), feats).filter("failed_at is null")
        rows = S.apply_rank_filters(rows, v.get("rank_filters", ()), fits=True)
        chosen = S.pick_top(rows, v["top_n"], v.get("cluster_max"))
        want.update({(r.variant, r.period, r.symbol): r.weight for r in S.allocate(chosen, v.get("allocator", "equal"), **v.get("allocator_options", {})).collect()})
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    split = P.variant_targets(feats.with_df(feats.df).__class__(feats.df, 5, 5, 2, 8, 200), reb, every, clusters)
    assert {(r.variant, r.period, r.symbol): pytest.approx(r.weight) for r in split.weights.collect()} == got
    counts = {(r.variant, r.date): (r.candidate_count, r.filtered_candidate_count, r.counts_after) for r in made.counts.collect()}
    want_counts = plain(pdf, reb.collect(), "mom", CONDITIONS)
    for (variant, day), (n, left, after) in counts.items():
        if variant.startswith("a/"):
            rows, failed = want_counts[day]
            assert (n, left, after) == (len(rows), sum(f is None for f in failed), [sum(f is None or f > i for f in failed) for i in range(2)])
    with pytest.raises(ValueError):
        P.grid({"a": {"size": 1}}, variants)


def test_log_of_weights(spark, features):
    pdf, feats = features
    reb = S.rebalance_dates(feats.df, 7)
    made = P.variant_targets(feats, reb, {"v": {"score": "mom", "conditions": CONDITIONS, "top_n": 2}})
    run = RO.execute(made.weights, reb, feats.df.select("date"), feats.df, 0.002)
    log = {r.period: r for r in RO.rebalance_log(run, made.counts).collect()}
    prices = pdf.pivot(index="date", columns="symbol", values=["open", "close"]).ffill()
    seen = 0
    for period, r in log.items():
        if r.target_weights:
            assert sum(r.target_weights.values()) == pytest.approx(1) and r.executed_weights == r.target_weights
            assert sorted(r.selected_symbols) == sorted(r.target_weights) and r.n_targets == len(r.target_weights)
            assert r.filtered_candidate_count >= r.n_targets and r.candidate_count >= r.filtered_candidate_count
        before = log.get(period - 1)
        if before is None or not before.target_weights:
            assert r.current_weights is None
            continue
        value = {s: w * prices.loc[r.signal_date, ("close", s)] / prices.loc[before.execution_date, ("open", s)] for s, w in before.target_weights.items()}
        assert r.current_weights == {s: pytest.approx(v / sum(value.values())) for s, v in value.items()}
        seen += 1
    assert seen > 5


def test_ranges_and_groups(spark, features):
    _, feats = features
    reb = S.rebalance_dates(feats.df, 7)
    every = P.grid({"g": {"score": "mom"}, "h": {"score": "vol"}}, {"x": {"top_n": 1}, "y": {"top_n": 3}})
    ranges = spark.createDataFrame([("r1", dt.date(2020, 2, 1), dt.date(2020, 4, 1)), ("r2", dt.date(2020, 4, 2), dt.date(2020, 6, 30))], "period string, start date, end date")
    rows = P.run_variants(feats, reb, every, feats.df.select("date"), ranges, commission=0.001).collect()
    assert {(r.group, r.variant, r.period) for r in rows} == {(v.split("/")[0], v, p) for v in every for p in ("r1", "r2")}
    whole = P.run_variants(feats, reb, every, feats.df.select("date"), commission=0.001).collect()
    assert {(r.group, r.variant) for r in whole} == {(v.split("/")[0], v) for v in every}
    assert pd.notna([r.avg_turnover for r in whole]).all()
