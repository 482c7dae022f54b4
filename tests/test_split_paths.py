"""The split forms of ranks, quantiles, windows and scans against pandas.

One group holds a third of the rows and one value a third of that group.
"""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.frames import number_rows, running, windowed
from barloom.operators import crosssection as X
from barloom.operators import grouping, panel as P, predictive, quality
from barloom.functions.library import make
from fixtures import assert_close, bar_frame, to_bars


@pytest.fixture(scope="module")
def skewed():
    rng = np.random.default_rng(7)
    n = 900
    group = np.where(rng.random(n) < 0.34, 0, rng.integers(1, 12, n))
    value = np.round(rng.normal(0, 1, n), 2)
    value[(group == 0) & (rng.random(n) < 0.34)] = 0.5
    value[rng.random(n) < 0.05] = np.nan
    return pd.DataFrame({"g": group, "id": np.arange(n), "v": value})


@pytest.fixture(scope="module")
def table(spark, skewed):
    df = spark.createDataFrame(skewed).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).repartition(4)
    return df.persist()


def by_id(df, col):
    return df.select("id", col).toPandas().sort_values("id")[col].to_numpy(dtype=float)


@pytest.mark.parametrize("fits", [True, False])
def test_average_rank(table, skewed, fits):
    g = skewed.groupby("g")["v"]
    assert_close(by_id(X.avg_rank(table, ["g"], "v", "r", fits), "r"), g.rank())
    assert_close(by_id(X.avg_rank(table, ["g"], "v", "r", fits, pct=True), "r"), g.rank(pct=True))
    assert_close(by_id(X.avg_rank(table, ["g"], "v", "r", fits, ascending=False), "r"), g.rank(ascending=False))


@pytest.mark.parametrize("fits", [True, False])
def test_position(table, skewed, fits):
    got = by_id(X.position(table, ["g"], [F.col("v").desc_nulls_last(), F.col("id")], "p", fits), "p")
    want = skewed.sort_values(["v", "id"], ascending=[False, True]).groupby("g").cumcount().sort_index() + 1
    assert_close(got, want)


@pytest.mark.parametrize("fits", [True, False])
def test_quantiles(table, skewed, fits):
    probs = [0.0, 0.05, 0.33, 0.5, 0.99, 1.0]
    got = X.quantiles(table, ["g"], "v", probs, "q", fits).toPandas().set_index("g")["q"].sort_index()
    want = skewed.groupby("g")["v"].quantile(probs).unstack()
    assert_close(np.stack(got.to_numpy()).ravel(), want.to_numpy().ravel())
    whole = X.quantiles(table, [], "v", probs, "q", fits).first()["q"]
    assert_close(whole, skewed["v"].quantile(probs))


@pytest.mark.parametrize("fits", [True, False])
def test_quantile_groups(table, skewed, fits):
    got = by_id(X.quantile_group(table, ["g"], "v", 5, "q", fits), "q")
    want = skewed.groupby("g")["v"].transform(lambda x: pd.qcut(x, 5, labels=False, duplicates="drop") + 1)
    assert_close(got, want)


@pytest.mark.parametrize("fits", [True, False])
def test_min_max(table, skewed, fits):
    g = skewed.groupby("g")["v"]
    want = (skewed["v"] - g.transform("min")) / (g.transform("max") - g.transform("min"))
    assert_close(by_id(X.min_max(table, ["g"], "v", "m", fits), "m"), want)


def test_row_numbers_and_scans(spark):
    pdf = bar_frame(symbols=2, rows=200)
    whole, split = to_bars(spark, pdf), to_bars(spark, pdf, 16)
    idx = number_rows(split.df).toPandas().sort_values(["symbol", "date"])
    assert (idx.groupby("symbol").cumcount() == idx["__idx"]).all()
    cols = {
        "s": ("sum", F.col("volume")),
        "m": ("max", F.col("close")),
        "f": ("first", F.when(F.col("volume") > 20, F.col("volume"))),
        "l": ("last", F.when(F.col("volume") > 35, F.col("volume"))),
    }
    a, b = (running(x, cols).toPandas().sort_values(["symbol", "date"], ignore_index=True) for x in (whole, split))
    pd.testing.assert_frame_equal(a[b.columns], b, check_exact=False)
    step = lambda d, w: d.withColumn("x", F.lead("close", 3).over(w) - F.lag("close", 2).over(w))
    a, b = (windowed(x, 2, 3, step).toPandas().sort_values(["symbol", "date"], ignore_index=True) for x in (whole, split))
    assert_close(b["x"], a["x"])


def test_analysis_is_the_same_when_split(spark):
    """Every layer with limits so small that all groups are cut."""
    pdf = bar_frame(symbols=12, rows=120, seed=3)
    results = []
    for limit in (1_000_000, 5):
        bars = to_bars(spark, pdf, limit)
        panel = P.forward_returns(P.build_panel(bars, make("PriceReturn", window=5), 20), [2], column="fwd")
        panel = panel.with_df(panel.df.persist())
        groups = grouping.quantile_returns(panel, n=3)
        tables = [
            predictive.daily_ic(panel),
            predictive.daily_top_ic(panel, top_pct=0.6),
            groups,
            quality.distribution_stats(panel),
            quality.daily_percentiles(panel),
            quality.rank_autocorrelation(panel, [1, 5]),
        ]
        results.append([t.toPandas().sort_values([c for c in t.columns if c in ("date", "group", "lag")] or t.columns, ignore_index=True) for t in tables])
    for a, b in zip(*results):
        pd.testing.assert_frame_equal(a, b[a.columns], check_exact=False, check_dtype=False)


def test_panel_against_pandas(spark):
    pdf = bar_frame(symbols=8, rows=100, seed=5)
    panel = P.build_panel(to_bars(spark, pdf), make("PriceReturn", window=5), 20)
    panel = P.forward_returns(panel, [3], column="fwd")
    got = panel.df.toPandas().sort_values(["date", "symbol"], ignore_index=True)
    close = pdf.pivot(index="date", columns="symbol", values="close")
    fwd = (close.shift(-3) / close - 1).stack(future_stack=True)
    want = fwd.reindex(pd.MultiIndex.from_frame(got[["date", "symbol"]]))
    assert_close(got["fwd"], want)
    daily = predictive.daily_ic(panel).toPandas().set_index("date")["ic"]
    for day, g in got.dropna(subset=["factor", "fwd"]).groupby("date"):
        want = g["factor"].rank().corr(g["fwd"].rank()) if len(g) >= 5 else np.nan
        assert (np.isnan(want) and np.isnan(daily[day])) or abs(daily[day] - want) < 1e-9
