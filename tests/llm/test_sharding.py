from collections import Counter

import numpy as np

from barloom.llm import sharding


def test_matrix_meets_both_sums():
    rng = np.random.default_rng(1)
    matrix = np.array(sharding.draw_matrix(rng, [5, 0, 17, 30], [13, 13, 13, 13]))
    assert matrix.sum(0).tolist() == [13] * 4 and matrix.sum(1).tolist() == [5, 0, 17, 30]


def test_draws_follow_the_law():
    rng = np.random.default_rng(2)
    drawn = Counter(sharding.hypergeometric(rng, 3, 5, 4) for _ in range(20_000))
    expected = {0: 5 / 70, 1: 30 / 70, 2: 30 / 70, 3: 5 / 70}
    assert all(abs(drawn[k] / 20_000 - p) < 0.02 for k, p in expected.items())
    # Beyond what the library draws: mean and deviation of a large draw.
    big = np.array([sharding.hypergeometric(rng, 2 * 10**9, 3 * 10**9, 10**6) for _ in range(400)], float)
    assert abs(big.mean() - 400_000) < 150 and 350 < big.std() < 650


def placed(spark, n, shards, monkeypatch=None, seed=1):
    df = spark.range(n).selectExpr("id", "if(id % 3 = 0, null, cast(id % 5 as string)) as text", "7 as shard", "id as slot").repartition(5)
    return sharding.shuffle_into_shards(df, shards, seed).collect()


def test_sizes_slots_and_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CHUNK_ROWS", 16)
    monkeypatch.setattr(sharding, "GROUP_CHUNKS", 4)
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 10)
    rows = placed(spark, 503, 7)
    assert sorted(r.id for r in rows) == list(range(503))
    for s, size in enumerate(sharding.shard_sizes(503, 7)):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(size))
    assert set(rows[0].asDict()) == {"id", "text", "shard", "slot"}


def test_places_are_uniform(spark):
    hits = Counter((r.id < 4000, r.shard, r.slot < 2000) for r in placed(spark, 8000, 2))
    assert len(hits) == 8 and all(abs(n - 1000) < 130 for n in hits.values())


def test_empty_and_few(spark):
    assert placed(spark, 0, 3) == []
    assert sorted((r.shard, r.slot) for r in placed(spark, 2, 5)) == [(0, 0), (1, 0)]
