import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import mixing


def test_targets():
    assert mixing.targets([100, 100], [3, 1], 200, 3) == [150.0, 50.0]
    # The first may take 30 only; the rest goes to the others by weight.
    assert mixing.targets([10, 100, 100], [8, 1, 1], 210, 3) == [30.0, 90.0, 90.0]
    assert mixing.targets([0, 50], [5, 2], 50, 3) == [0.0, 50.0]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, "a" if i % 3 else "b", (i * 7) % 41) for i in range(300)]
    rows += [(1000, None, 50), (1001, None, 0), (1002, "é", None), (None, "a", 9), (1, "a", 7), (1, "a", 7), (1003, "c", 5000)]
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, size long, start int, slot string")


def rows_of(docs):
    return sorted(mixing.taken_words(mixing.mix(docs, (5, 2, 1))).collect(), key=str)


def test_words_meet_targets_and_bounds(docs):
    rows = rows_of(docs)
    assert len(rows) == docs.count()
    assert rows == rows_of(docs.repartition(7))
    assert all(0 <= r.taken <= 3 * r["size"] for r in rows)
    taken, target = Counter(), {}
    for r in rows:
        taken[r.sid] += r.taken
        target[r.sid] = r.target
    assert all(abs(taken[s] - target[s]) <= 8 for s in target)


def test_schedule_and_pieces(docs):
    made = mixing.mix(docs, (5, 2, 1))
    schedule = made.schedule.collect()
    assert sorted(r.slot for r in schedule) == list(range(len(schedule)))
    ranks = {}
    for r in sorted(schedule, key=lambda r: r.slot):
        assert r["rank"] == ranks.get(r.sid, 0)
        ranks[r.sid] = r["rank"] + 1
    # Any stretch of the schedule holds a source about as often as its share.
    target = {r.sid: r.target for r in made.documents.collect()}
    share = {s: t / sum(target.values()) for s, t in target.items()}
    first = Counter(r.sid for r in schedule if r.slot < 500)
    assert all(abs(first[s] - 500 * p) < 6 for s, p in share.items())
    # A slot holds its words once, and a document's words come in order.
    words = Counter()
    for p in made.pieces.collect():
        assert 0 <= p.from_word < p.to_word <= p["size"]
        words[p.slot] += p.to_word - p.from_word
    assert max(words.values()) <= max(1, sum(r["size"] for r in made.documents.collect()) // mixing.LEAST_BLOCKS)


def test_long_blocks_and_epochs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", 4)
    docs = spark.createDataFrame([(i, "x" if i < 2 else "y", 100) for i in range(50)], "doc_id long, source string, size long")
    rows = mixing.taken_words(mixing.mix(docs, (50, 1))).collect()
    assert sum(r.taken for r in rows if r.doc_id < 2) == 600
    assert all(r.taken <= 300 for r in rows)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.taken_words(mixing.mix(none, (5, 2, 1))).collect() == []
    zero = spark.createDataFrame([(1, "a", 0)], "doc_id long, source string, size long")
    assert [r.taken for r in mixing.taken_words(mixing.mix(zero, (5, 2, 1))).collect()] == [0]


def test_small_sources_meet_their_targets_in_long_blocks(spark):
    """Blocks of 1,024 words: a hot source and a tail of 100 to 3,000 words."""
    tail = [100, 300, 1000, 3000] * 5
    words = 1 << 27
    rows = [(i, "hot", words // 64) for i in range(64)]
    rows += [(1000 * (s + 1) + i, f"t{s:02d}", 50) for s, n in enumerate(tail) for i in range(n // 50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    made = mixing.mix(docs, (1, 10), epochs=1)
    taken, target, sid = Counter(), {}, {}
    for r in mixing.taken_words(made).collect():
        taken[r.sid] += r.taken
        target[r.sid] = r.target
        assert 0 <= r.taken <= r["size"]
    assert len(target) == 21 and all(target[s + 1] == n for s, n in enumerate(tail))
    assert all(taken[s + 1] == n for s, n in enumerate(tail))
    assert abs(taken[0] - target[0]) <= 8 * 1024
    # The same with weights that cut the tail's targets.
    made = mixing.mix(docs.withColumn("size", F.when(F.col("source") == "hot", F.col("size")).otherwise(F.col("size") * 20)), (1e6, 1), epochs=1)
    taken, target = Counter(), {}
    for r in mixing.taken_words(made).collect():
        taken[r.sid] += r.taken
        target[r.sid] = r.target
    small = [s for s in target if s % 2]
    assert small and all(0 <= taken[s] - target[s] < 1 for s in small)
    slots = sorted((r.slot, r.sid, r["rank"]) for r in made.schedule.collect())
    assert [s for s, _, _ in slots] == list(range(len(slots)))
    last = {}
    for _, s, rank in slots:
        assert rank == last.get(s, -1) + 1
        last[s] = rank


def test_every_place_is_taken_once_and_evenly():
    for slots in (*range(1, 40), 1000, 65_536, 99_991, 131_072):
        step = mixing.golden_step(slots)
        places = mixing._places(np.arange(slots), step, slots)
        assert len(set(places.tolist())) == slots
    # Stretches of the schedule hold any part of the ring about as often as its share.
    for end in (10, 1000, 50_000, 131_072):
        first = np.sort(places[:end]) / slots
        assert np.abs(first - np.arange(end) / end).max() * end < 12
    slots = 10_000_000_019
    step = mixing.golden_step(slots)
    some = [0, 1, (1 << 33) + 5, slots - 1]
    assert mixing._places(np.array(some), step, slots).tolist() == [j * step % slots for j in some]


def test_targets_of_many_sources():
    began = time.monotonic()
    sizes = [(i * 7919) % 1000 for i in range(1_000_000)]
    out = mixing.targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], sum(sizes), 3)
    assert time.monotonic() - began < 20
    assert abs(sum(out) - sum(sizes)) < 1 and all(0 <= t <= 3 * n for t, n in zip(out, sizes))


def test_one_law_for_all_sources(docs):
    """Large or small, a source's words are those of its stream up to its target."""
    rows = rows_of(docs)
    want = Counter()
    for r in rows:
        cut = int(-(-r.target // 1))
        want[r] += sum(max(0, min(e * r.source_size + r.start + r["size"], cut) - e * r.source_size - r.start) for e in range(3))
    assert all(r.taken * n == want[r] for r, n in Counter(rows).items())
