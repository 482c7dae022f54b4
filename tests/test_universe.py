"""Pair statistics and universe building against brute force."""

import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import pairs as PR
from barloom.operators import universe as U
from fixtures import bar_frame, to_bars


@pytest.fixture(scope="module")
def data(spark):
    pdf = bar_frame(symbols=11, rows=150, seed=9)
    close = pdf.pivot(index="date", columns="symbol", values="close")
    rets = pd.concat(
        [g.set_index("date")["close"].pct_change().rename(s) for s, g in pdf.groupby("symbol")], axis=1
    )
    return pdf, to_bars(spark, pdf), close, rets


@pytest.mark.parametrize("block_symbols,block_dates", [(256, 16384), (3, 16384), (3, 40)])
def test_correlation_tiles(data, block_symbols, block_dates):
    _, bars, _, rets = data
    got = PR.correlation_pairs(PR.daily_returns(bars), 2, None, block_symbols, block_dates).toPandas()
    want = rets.corr()
    assert len(got) == 55
    for r in got.itertuples():
        assert r.a < r.b
        assert abs(r.corr - want.loc[r.a, r.b]) < 1e-9
        assert r.n == (rets[r.a].notna() & rets[r.b].notna()).sum()


@pytest.mark.parametrize("block_symbols", [256, 3])
def test_only_wanted_pairs(spark, data, block_symbols):
    _, bars, _, rets = data
    corr, names = rets.corr(), sorted(rets.columns)
    one, two = (spark.createDataFrame([(n,) for n in part], "symbol string") for part in (names[:2], names[1:6]))
    got = PR.correlation_pairs(PR.daily_returns(bars), min_corr=-0.05, block_symbols=block_symbols, max_corr=0.05, sides=(one, two)).toPandas()
    sides = {tuple(sorted((a, b))) for a in names[:2] for b in names[1:6] if a != b}
    assert set(zip(got.a, got.b)) == {(a, b) for a, b in sides if -0.05 <= corr.loc[a, b] <= 0.05}


@pytest.mark.parametrize("block_symbols,block_dates", [(256, 16384), (3, 16384), (3, 40)])
def test_figures_of_tiles_equal_those_of_pairs(spark, data, block_symbols, block_dates):
    """Groups, symbols and nearest partners, made without a table of pairs."""
    _, bars, _, rets = data
    size = {"block_symbols": block_symbols, "block_dates": block_dates}
    series, names = PR.daily_returns(bars), sorted(rets.columns)
    # One symbol has no label row, two have a null label.
    label = {n: None if i < 2 else i % 3 for i, n in enumerate(names[:-1])}
    labels = spark.createDataFrame([(n, g, "x") for n, g in label.items()], "symbol string, cluster long, label string")
    pairs = PR.correlation_pairs(series).select("a", "b", "corr")
    got = {(r.ga, r.gb): (r.corr_mean, r.n_pairs) for r in PR.group_correlations(series, labels, **size).collect()}
    want = {(r.ga, r.gb): (r.corr_mean, r.n_pairs) for r in U.cluster_correlations(pairs, labels).collect()}
    assert set(got) == set(want) and (None, None) in got
    for key, (mean, n) in want.items():
        assert got[key][1] == n and abs(got[key][0] - mean) < 1e-9
    corr = rets.corr()
    for r in PR.symbol_correlations(series, labels, **size).collect():
        others = [n for n in label if n != r.symbol]
        own = [corr.loc[r.symbol, n] for n in others if label[n] == label[r.symbol] and label[n] is not None]
        assert r.n == len(others) and abs(r.corr_sum - corr.loc[r.symbol, others].sum()) < 1e-9
        assert r.corr_in_group is None if not own else abs(r.corr_in_group - np.mean(own)) < 1e-9
    near = PR.nearest_partners(series, 4, **size).collect()
    assert len(near) == 4 * len(names)
    for r in near:
        best = corr.loc[r.a].drop(r.a).sort_values(ascending=False)
        assert best.index[r.place - 1] == r.b and abs(best.iloc[r.place - 1] - r.corr) < 1e-9
    known = labels.filter("cluster is not null")
    per = PR.symbol_correlations(series, known, **size)
    order = lambda df: [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*sorted(df.columns)).orderBy("symbol").collect()]
    whole = order(U.cluster_summary(pairs, known))
    assert whole == order(U.summary_of_clusters(per, known, fits=True)) == order(U.summary_of_clusters(per, known, fits=False))


def test_tiles_without_pairs(spark):
    bars = to_bars(spark, bar_frame(symbols=1, rows=9, seed=1))
    series = PR.daily_returns(bars)
    labels = bars.df.select("symbol", F.lit(1).alias("cluster")).distinct()
    assert PR.group_correlations(series, labels).collect() == []
    assert PR.symbol_correlations(series, labels).collect() == PR.nearest_partners(series, 3).collect() == []
    summary = U.summary_of_clusters(PR.symbol_correlations(series, labels), labels, fits=True).collect()
    assert [(r.cluster_size, r.avg_corr_to_universe, r.cluster_rank) for r in summary] == [(1, 1.0, 1)]


def test_duplicate_pairs(data):
    _, bars, close, rets = data
    got = PR.duplicate_pairs(bars, 0.05, 50).toPandas()
    corr = rets.corr()
    want = {(a, b) for a, b in itertools.combinations(corr.columns, 2) if corr.loc[a, b] >= 0.05}
    assert {(r.a, r.b) for r in got.itertuples()} == want
    for r in got.itertuples():
        both = close[[r.a, r.b]].dropna()
        assert r.rows == len(both)
        assert abs(r.ratio_std - (both[r.b] / both[r.a]).std()) < 1e-9


def union_find(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "star"])
def test_components(spark, kind):
    rng = np.random.default_rng(1)
    name = lambda i: f"n{i:03d}"
    if kind == "random":
        edges = [(name(a), name(b)) for a, b in rng.integers(0, 60, (45, 2)) if a != b]
    elif kind == "chain":
        order = rng.permutation(40)
        edges = [(name(a), name(b)) for a, b in zip(order[:-1], order[1:])]
    else:
        edges = [(name(20), name(i)) for i in range(40) if i != 20]
    got = U.connected_components(spark.createDataFrame(edges, "a string, b string")).toPandas()
    assert dict(zip(got["symbol"], got["component"])) == union_find(edges)
    assert got["symbol"].is_unique


def test_merged_clusters(spark):
    pairs = spark.createDataFrame([("A", "B", 0.99), ("B", "C", 0.98), ("X", "Y", 0.97)], "a string, b string, corr double")
    first = spark.createDataFrame([("A", "2020-01-02"), ("B", "2019-05-01"), ("X", None), ("Y", "2021-01-01")], "symbol string, first_date string")
    got = {r["component"]: r for r in U.merged_clusters(pairs, first).collect()}
    assert got["A"]["representative"] == "B" and got["A"]["members"] == ["A", "B", "C"] and got["A"]["max_corr"] == 0.99
    assert got["X"]["representative"] == "Y"


def test_eigenvalue_share(spark, data):
    _, bars, _, rets = data
    pairs = PR.correlation_pairs(PR.daily_returns(bars)).persist()
    want = np.linalg.eigvalsh(rets.corr().to_numpy())[-1] / 11
    assert abs(U.dominant_share(pairs, 11).first()[0] - want) < 1e-9
    even = [(a, b, -0.3) for a, b in ("ab", "ac", "ad", "bc", "bd", "cd")]
    even = spark.createDataFrame(even, "a string, b string, corr double")
    assert abs(U.dominant_share(even, 4).first()[0] - 1.3 / 4) < 1e-9
    # Symbols in no pair count in the trace.
    assert abs(U.dominant_share(even, 6).first()[0] - 1.3 / 6) < 1e-9
    assert U.dominant_share(even.limit(0), 5).first()[0] == 0.2


def test_compatible_sets(data):
    _, bars, _, rets = data
    pairs = PR.correlation_pairs(PR.daily_returns(bars)).persist()
    symbols = bars.df.select("symbol").distinct()
    got = {tuple(r["members"]) for r in U.largest_compatible_sets(pairs, symbols, 0.02).collect()}
    corr = rets.corr()
    best = set()
    for k in range(11, 0, -1):
        best = {
            s for s in itertools.combinations(sorted(corr.columns), k)
            if all(corr.loc[a, b] < 0.02 for a, b in itertools.combinations(s, 2))
        }
        if best:
            break
    assert got == best


def test_greedy_selection(data):
    _, bars, _, rets = data
    corr = rets.corr()
    pairs = PR.correlation_pairs(PR.daily_returns(bars)).persist()
    labels = bars.df.select("symbol").distinct().withColumn("cluster", F.length("symbol") + F.ascii(F.substring("symbol", -1, 1)) % 3)
    lab = dict(labels.toPandas().itertuples(index=False))
    got = U.greedy_low_correlation(pairs, U.cluster_summary(pairs, labels), 6, 2)
    rows = {}
    for s in corr.columns:
        mates = [m for m in corr.columns if lab[m] == lab[s] and m != s]
        intra = corr.loc[s, mates].mean() if mates else 0.0
        rows[s] = (0.65 * intra + 0.35 * corr.loc[s].mean(), corr.loc[s].mean())
    rank = {}
    for cl in set(lab.values()):
        for i, s in enumerate(sorted((s for s in lab if lab[s] == cl), key=lambda s: (*rows[s], s)), 1):
            rank[s] = i
    chosen = [min((s for s in lab if rank[s] == 1), key=lambda s: (*rows[s], s))]
    while len(chosen) < 6:
        count = lambda cl: sum(lab[x] == cl for x in chosen)
        free = [s for s in lab if s not in chosen and count(lab[s]) < 2]
        if len({lab[x] for x in chosen}) < len(set(lab.values())):
            free = [s for s in free if count(lab[s]) > 0 or rank[s] == 1] or free
        chosen.append(min(free, key=lambda s: (corr.loc[s, chosen].mean(), *rows[s], s)))
    assert got == chosen


def test_density_clusters(spark):
    rng = np.random.default_rng(4)
    pts = np.concatenate([rng.normal(0, 0.1, 8), rng.normal(3, 0.1, 8), [1.5, 9.0]])
    names = [f"p{i:02d}" for i in range(len(pts))]
    rows = [(names[i], names[j], float(abs(pts[i] - pts[j]))) for i in range(len(pts)) for j in range(i + 1, len(pts))]
    dists = spark.createDataFrame(rows, "a string, b string, dist double")
    symbols = spark.createDataFrame([(n,) for n in names], "symbol string")
    got = {r["symbol"]: r["cluster"] for r in U.density_clusters(dists, symbols, 0.4, 4).collect()}
    assert {got[n] for n in names[:8]} == {"p00"} and {got[n] for n in names[8:16]} == {"p08"}
    assert got["p16"] is None and got["p17"] is None
    near = U.neighbour_distances(dists, 3).toPandas().set_index("symbol")["k_dist"]
    d = np.abs(pts[:, None] - pts[None, :])
    assert np.allclose(near[names].to_numpy(), np.sort(d, axis=1)[:, 2])
    assert U.estimate_eps(U.neighbour_distances(dists, 3), fits=True).first()["eps"] > 0


def test_matrix_report(spark):
    full = [("A", "A", 1.0), ("B", "B", 1.0), ("A", "B", 0.5), ("B", "A", 0.5)]
    schema = "a string, b string, corr double"
    assert U.matrix_report(spark.createDataFrame(full, schema)).first()["is_valid"]
    assert not U.matrix_report(spark.createDataFrame(full[:3], schema)).first()["is_valid"]
    assert not U.matrix_report(spark.createDataFrame(full[:3] + [("B", "A", 0.4)], schema)).first()["is_valid"]
