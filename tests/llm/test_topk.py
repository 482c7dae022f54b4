import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, query_id string"


def brute(rows, every, k, scale=64):
    good = []
    for vec_id, v in rows:
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, [math.floor(scale * float(x)) for x in v]))
    width = max((len(v) for _, v in good), default=0)
    good = [(i, v + [0] * (width - len(v))) for i, v in good]
    near = lambda s: min(max(s, -(2**63)), 2**63 - 1)
    out = []
    for at, (q, x) in enumerate(good):
        if q is None or q % every:
            continue
        scores = sorted((-near(sum(a * b for a, b in zip(x, y, strict=True))), c is None, c or 0) for j, (c, y) in enumerate(good) if j != at)
        out += [(q, r + 1, None if none else c, -s) for r, (s, none, c) in enumerate(scores[:k])]
    return sorted(out, key=str)


def run(spark, rows, k=5, every=4):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA)
    vectors = topk.quantised(df, "vec_id", "embedding", 64)
    return sorted(map(tuple, topk.top_k(vectors, F.col("vec_id") % every == 0, k).collect()), key=str)


def vectors(n, dims=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, dims))
    return [(i, [float(np.float32(x)) for x in centres[i % 5] + 0.1 * rng.normal(size=dims)]) for i in range(n)]


def test_equals_brute_force_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 40)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 16)
    monkeypatch.setattr(topk, "STEP", 8)
    rows = vectors(230)
    assert run(spark, rows) == brute(rows, 4, 5)


def test_nulls_ties_repeats_and_few(spark):
    rows = vectors(9) + [(0, [1.0] * 6), (0, [1.0] * 6), (4, None), (8, [1.0, None]), (12, [float("nan")] * 6), (16, [float("inf")]), (20, [0.0] * 6), (24, [2.0])]
    rows += [(None, [1.0] * 6)]
    assert run(spark, rows, k=30) == brute(rows, 4, 30)


def test_large_values_and_empty(spark):
    rows = [(0, [1e9, -1e9]), (1, [1e9, 5.0]), (2, [-1e9, 3.0])]
    assert run(spark, rows) == brute(rows, 4, 5)
    assert run(spark, []) == []
    assert run(spark, [(1, [1.0])]) == []


def test_bounds_save_work():
    rng = np.random.default_rng(3)
    data = np.concatenate([rng.normal(0, 2, (400, 8)) + 60 * c for c in range(5)]).astype(np.int64)
    pivots = topk.spread_pivots(data.astype(float), 16)
    block = {"ids": np.arange(2000), "uids": np.arange(2000), "data": data, "pivots": topk._to_pivots(data, pivots)}
    query = {k: v[1900:1910] for k, v in block.items()}
    found = topk.search_block(query, block, 10)
    exact = data @ data[1900:1910].T
    for q, best, score, done in found:
        others = np.delete(exact[:, q], 1900 + q)
        assert sorted(others)[-10:] == sorted(score.tolist())
        assert done < 1000


@pytest.mark.parametrize("n", [0, 1, 3])
def test_pivots_of_few(n):
    assert len(topk.spread_pivots(np.eye(3)[:n], 8)) == n


def test_pages_cells_and_one_hot_cluster(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 16)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 8)
    monkeypatch.setattr(topk, "PAGE", 3)
    rows = vectors(90) + [(100 + i, [3.0 + i % 3 / 64] * 6) for i in range(60)]
    assert run(spark, rows, k=7) == brute(rows, 4, 7)


def test_floor_rules_out_blocks():
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.normal(0, 2, (300, 8)) + 60 * c for c in range(5)]).astype(np.int64)
    pivots = topk.spread_pivots(data.astype(float), 16)
    far = topk._to_pivots(data, pivots)
    parts = [slice(300 * c, 300 * c + 300) for c in range(5)]
    page = [{"block": c, "n": 300, "low": far[p].min(0), "high": far[p].max(0), "longest": float((data[p] ** 2).sum(1).max())} for c, p in enumerate(parts)]
    asked = np.arange(0, 1500, 50)
    exact = np.sort(data[asked] @ data.T, 1)[:, ::-1]
    queries = {"uids": asked, "data": data[asked], "pivots": far[asked], "floors": exact[:, 20]}
    first, then = topk.routes(queries, page, 20)
    assert (first.sum(1) == 1).all() and not (first & then).any()
    # No block that holds one of the 20 best is left out.
    for q in range(len(asked)):
        needed = {int(i) // 300 for i in np.flatnonzero(data @ data[asked[q]] >= exact[q, 19])}
        assert needed <= set(np.flatnonzero(first[q] | then[q]).tolist())
    assert (first | then).mean() < 0.9


@pytest.mark.parametrize("sign", [1, -1])
def test_scores_beyond_a_long_tie_at_its_end(spark, sign):
    rows = [(i, [sign * (-1.0) ** i * 1e12 * (1 + i % 5), 1e9 * i]) for i in range(40)]
    assert run(spark, rows, k=6) == brute(rows, 4, 6)


def test_narrowest_integers():
    assert topk._narrowest(-128, 127) is np.int8 and topk._narrowest(0, 128) is np.int16
    assert topk._narrowest(-(2**31), 0) is np.int32 and topk._narrowest(0, 2**31) is np.int64
