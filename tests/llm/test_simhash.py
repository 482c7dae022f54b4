import hashlib
import random
import re
import struct
from collections import Counter

import pytest
import xxhash

from barloom.llm import queries, simhash

SCHEMA = "doc_id long, text string, fingerprint string"
SEED = 42


def chain(values, seed=SEED):
    for v in values:
        seed = xxhash.xxh64_intdigest(v, seed)
    return seed


def brute(text):
    words = re.split(r"[ \t-\r]+", re.sub(r"^[ \t-\r]+|[ \t-\r]+$", "", text))
    votes, n = [0] * 128, max(1, len(words) - 4)
    for i in range(n):
        t0 = chain(w.encode() for w in words[i : i + 5])
        t1 = chain([struct.pack("<Q", t0), struct.pack("<i", 1)])
        for b in range(64):
            votes[b] += t0 >> b & 1
            votes[64 + b] += t1 >> b & 1
    bits = [int(2 * v > n) for v in votes]
    half = lambda part: sum(b << i for i, b in enumerate(part))
    return f"{half(bits[:64]):016x}{half(bits[64:]):016x}"


def make(n, seed=1):
    rnd = random.Random(seed)
    return [(i * 3, " ".join(rnd.choice(["a", "be", "cé", "d\n"]) + rnd.choice("xyz") for _ in range(rnd.randrange(40)))) for i in range(n)]


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(4)
    return simhash.edited_fingerprints(df).collect()


def check(rows, found):
    docs = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r.doc_id: r for r in found}
    for (d, t), (e, nxt) in zip(docs, docs[1:] + docs[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (brute(t), brute(edited))
        like = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 128
        assert abs(r.near_edited - like(brute(t), brute(edited))) < 1e-12
        assert abs(r.near_next - like(brute(t), brute(nxt))) < 1e-12


def test_equals_votes_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 9)
    rows = make(60) + [(None, "x y"), (2, None), (4, ""), (5, " \n "), (7, "😀 é" * 9)]
    found = run(spark, rows)
    assert len(found) == len(rows)
    check(rows, found)


def test_repeated_ids_rows_and_chunks(spark):
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "w" + " w" * 40_000)]
    found = run(spark, rows)
    assert len(found) == 3 and {r.fingerprint for r in found} == {brute(t) for _, t in rows}
    one = run(spark, [(5, "lone text here")])
    assert one[0].near_next == 1.0
    assert run(spark, []) == []


def test_all_neighbours_within_the_radius(spark):
    rnd = random.Random(4)
    prints = [rnd.getrandbits(128) for _ in range(40)]
    for p in list(prints):
        for k in (1, 2, 3, 4):
            prints.append(p ^ sum(1 << b for b in rnd.sample(range(128), k)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p & (2**64 - 1)), signed(p >> 64)) for p in prints] + [(0, 0), (0, 0)]
    df = spark.createDataFrame(rows, "f0 long, f1 long")
    every = {(a & (2**64 - 1)) | ((b & (2**64 - 1)) << 64) for a, b in rows}
    for radius, blocks in ((3, 5), (3, 4), (2, 6), (0, 1)):
        found = simhash.near_pairs(df, radius, blocks).collect()
        join = lambda a, b: (a & (2**64 - 1)) | ((b & (2**64 - 1)) << 64)
        pairs = sorted(tuple(sorted((join(r.a0, r.a1), join(r.b0, r.b1)))) for r in found)
        assert pairs == sorted((a, b) for a in every for b in every if a < b and (a ^ b).bit_count() <= radius)


def test_links_count_other_fingerprints(spark):
    rows = [(1, 0), (1, 0), (1, 1), (1, 3), (-1, -1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "f0 long, f1 long, links string").drop("links")
    found = sorted((r.f0, r.f1, r.links) for r in simhash.with_links(df, 1, 3).collect())
    assert found == [(-1, -1, 0), (1, 0, 1), (1, 0, 1), (1, 1, 2), (1, 3, 1)]


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a", "x")], SCHEMA)
    plan = simhash.edited_fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_links_beyond_the_radius_that_all_tables_cover(spark):
    rnd = random.Random(8)
    prints = [rnd.getrandbits(128) for _ in range(30)]
    for p in list(prints):
        prints += [p ^ sum(1 << b for b in rnd.sample(range(128), k)) for k in (1, 4, 9, 12, 18, 22, 23)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p & (2**64 - 1)), signed(p >> 64)) for p in prints]
    edges = [128 * i // 14 for i in range(15)]
    masks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    meet = lambda d: 0 < d.bit_count() <= 22 and sum(not d & m for m in masks) >= 2
    every = set(prints)
    want = {p: sum(meet(p ^ q) for q in every) for p in every}
    assert all(want[p] >= sum(0 < (p ^ q).bit_count() <= 12 for q in every) for p in every)
    assert queries.RADIUS == 22
    found = simhash.with_links(spark.createDataFrame(rows, "f0 long, f1 long"), 22, 14, 2).collect()
    assert {(r.f0 & (2**64 - 1)) | ((r.f1 & (2**64 - 1)) << 64): r.links for r in found} == want


def test_edited_texts_are_linked(spark):
    """Near copies of texts, not of fingerprints: 1 or 4 of 300 words are others."""
    rnd = random.Random(5)
    rows = []
    for i in range(40):
        words = [f"w{rnd.randrange(5000)}" for _ in range(300)]
        rows.append((i, " ".join(words)))
        for at in rnd.sample(range(300), 1 if i < 20 else 4):
            words[at] = "changed"
        rows.append((100 + i, " ".join(words)))
    prints = simhash.written(simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")), "prints")
    linked = {r.doc_id: r.links for r in simhash.with_links(prints, queries.RADIUS, queries.BLOCKS, queries.EQUAL_BLOCKS).collect()}
    assert sum(linked[i] > 0 for i in range(20)) == 20
    assert sum(linked[i] > 0 for i in range(20, 40)) >= 15
    assert sum(linked.values()) <= 80


def near_group(size, seed, bits=4):
    """Fingerprints a few random bits from a common one, as signed halves."""
    rnd = random.Random(seed)
    centre = rnd.getrandbits(128)
    made = {centre ^ sum(1 << b for b in rnd.sample(range(128), bits)) for _ in range(size)}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return made, [(signed(p & (2**64 - 1)), signed(p >> 64)) for p in made]


@pytest.mark.parametrize("array", [1, 7, 512])
def test_a_group_dealt_into_parts(spark, monkeypatch, array):
    monkeypatch.setattr(simhash, "ARRAY", array)
    made, rows = near_group(60, 3)
    lone = [(5, 5), (-5, 1 << 40)]
    found = simhash.with_links(spark.createDataFrame(rows + lone, "f0 long, f1 long"), 22, 14, 2).collect()
    # Eight bits apart at most, so at least six blocks are equal: all are linked.
    assert sorted((r.f0, r.f1, r.links) for r in found) == sorted([(a, b, len(made) - 1) for a, b in rows] + [(a, b, 0) for a, b in lone])


@pytest.mark.parametrize(("radius", "common"), [(22, 12), (3, 64)])
def test_all_links_within_the_radius(spark, monkeypatch, radius, common):
    """Also those whose differing bits leave no two of 14 blocks alone."""
    monkeypatch.setattr(simhash, "COMMON", common)
    monkeypatch.setattr(simhash, "CELL", 5)
    rnd = random.Random(11)
    prints = [rnd.getrandbits(128) for _ in range(6)]
    for p in list(prints):
        prints += [p ^ sum(1 << b for b in rnd.sample(range(128), k)) for k in (1, 2, 3, 4, 9, 12, 18, 21, 22, 22, 23)]
        # Two bits in every sixth, spread over all blocks.
        prints += [p ^ sum(1 << b for b in range(start, 128, 6)) for start in range(6)]
    prints += [p for p in prints[:3]]
    unsigned = lambda r: (r.f0 & (2**64 - 1)) | ((r.f1 & (2**64 - 1)) << 64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p & (2**64 - 1)), signed(p >> 64)) for p in prints]
    every = set(prints)
    want = sorted((p, sum(0 < (p ^ q).bit_count() <= radius for q in every)) for p in prints)
    found = simhash.with_all_links(spark.createDataFrame(rows, "f0 long, f1 long").repartition(3), radius).collect()
    assert sorted((unsigned(r), r.links) for r in found) == want


def test_op3_counts_every_neighbour(spark, tmp_path):
    rnd = random.Random(6)
    rows = []
    for i in range(60):
        words = [f"w{rnd.randrange(5000)}" for _ in range(120)]
        rows.append((i, " ".join(words)))
        for k in range(1, 5):
            words[rnd.randrange(120)] = "changed"
            rows.append((100 * k + i, " ".join(words)))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.op3_simhash(spark, str(tmp_path)).collect()
    prints = {int(r.fingerprint, 16) for r in found}
    near = lambda p: sum(0 < (p ^ q).bit_count() <= queries.RADIUS for q in prints)
    assert [(r.doc_id, r.links) for r in found] == [(r.doc_id, near(int(r.fingerprint, 16))) for r in found]


def executions(spark):
    """Spark's status store, its executions, and what makes Python lists of Scala's."""
    listed = spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava
    store = spark._jsparkSession.sharedState().statusStore()
    return store, list(listed(store.executionsList())), listed


def joined_rows(spark, known):
    """The most rows that the broadcast joins of one plan line made, without known
    executions. Left joins with unique keys make no rows, they keep what they are given;
    keys of few rows are joined by merging."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, found, listed = executions(spark)
    made = Counter()
    for job in found:
        if job.executionId() in known:
            continue
        values = {k: v for k, v in listed(store.executionMetrics(job.executionId())).items()}
        for node in listed(store.planGraph(job.executionId()).allNodes()):
            for metric in listed(node.metrics()):
                if "BroadcastHashJoin" in node.name() and "LeftOuter" not in node.desc() and metric.name() == "number of output rows" and metric.accumulatorId() in values:
                    made[re.sub(r"#\d+L?|\d+", "", node.desc())] += int(values[metric.accumulatorId()].replace(",", ""))
    return max(made.values())


def test_rows_of_hot_keys(spark):
    """Fingerprints of a group of near copies move in lists: a row for each of
    them and block, not for each of its keys."""
    made, rows = near_group(1_000, 4)
    prints = simhash.written(spark.createDataFrame(rows, "f0 long, f1 long"), "prints")
    known = {x.executionId() for x in executions(spark)[1]}
    found = simhash.with_all_links(prints, queries.RADIUS).collect()
    assert {(r.f0, r.f1): r.links for r in found} == {x: len(made) - 1 for x in rows}
    assert joined_rows(spark, known) <= 18 * len(rows)
