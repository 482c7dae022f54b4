import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from barloom.llm import queries, runs


def brute(words, least=12):
    found = {}
    for p in range(1, len(words) // 2 + 1):
        x = p
        while x < len(words):
            first = x
            while x < len(words) and words[x] == words[x - p]:
                x += 1
            if x - first + p >= max(least, 2 * p):
                key = (first - p, x)
                found[key] = min(p, found.get(key, p))
            x += 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples(rnd, count):
    for _ in range(count):
        n = rnd.randrange(0, 150)
        root = [rnd.randrange(4) for _ in range(rnd.randrange(1, 20))]
        yield [rnd.randrange(2) for _ in range(n)]
        yield [bin(i).count("1") & 1 for i in range(n)]
        yield fibonacci(n)
        yield root * rnd.randrange(1, 6) + [9] * rnd.randrange(15) + root * 3
        once = [rnd.randrange(30) for _ in range(n)]
        yield once + once + once[: rnd.randrange(n + 1)]


def test_runs_of_every_prefix_are_known_online():
    rnd = random.Random(1)
    for words in samples(rnd, 25):
        catchers, n = runs.Catchers(), 0
        while n < len(words):
            step = rnd.choice([1, 2, 9, 60, 500])
            catchers.append(np.array(words[n : n + step]))
            n += step
            assert catchers.runs() == brute(words[:n])


def test_runs_do_not_depend_on_steps(monkeypatch):
    rnd = random.Random(2)
    cases = [*samples(rnd, 60), [0] * 700, [1, 0] * 300 + [0] * 40 + [1, 0] * 50]
    whole = [runs.runs_of([b"%d" % w for w in words]) for words in cases]
    assert whole == [brute(words) if len(words) >= 12 else [] for words in cases]
    monkeypatch.setattr(runs, "STEP", 7)
    assert whole == [runs.runs_of([b"%d" % w for w in words]) for words in cases]


def test_fingerprints_that_all_agree_change_nothing(monkeypatch):
    monkeypatch.setattr(runs.Catchers, "_prints", lambda self, at, size: np.zeros(len(at), np.uint64))
    for words in samples(random.Random(3), 8):
        assert runs.runs_of([b"%d" % w for w in words]) == brute(words)


@pytest.mark.parametrize("words", [[0] * 400_000, fibonacci(100_000), list(range(50_000)) * 6], ids=["one word", "fibonacci", "long period"])
def test_long_texts_in_bounded_time(words):
    before = time.process_time()
    catchers = runs.Catchers()
    catchers.append(np.array(words))
    assert catchers.runs()
    assert time.process_time() - before < 30


def test_collapsed_words():
    words = [b"%d" % i for i in [1, 2, 3, *([7, 8] * 8), 4, *([5] * 12)]]
    found = runs.runs_of(words)
    assert found == [(3, 16, 2), (20, 12, 1)]
    assert b" ".join(runs.collapsed(words, found)) == b"1 2 3 7 8 4 5"


def test_table_cases(spark):
    loop = "a b c " * 9
    rows = [(1, loop), (1, loop), (2, None), (3, ""), (4, " \n "), (5, "x y   z"), (None, "t " * 40 + "\x1cend"), (6, "long " * 200_000)]
    docs = spark.createDataFrame([(i, t, 1, 2, "c", 3) for i, t in rows], "doc_id long, text string, runs int, start int, collapsed string, _text int")
    got = runs.find_runs(docs.drop("_text")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by[1].runs] == [(0, 27, 3)] and by[1].collapsed == "a b c" and by[1].start == 2
    assert all(by[i].runs == [] and by[i].collapsed == "" for i in (2, 3, 4))
    # Blanks are ASCII blanks only.
    assert by[5].collapsed == "x y   z" and by[None].collapsed == "t \x1cend"
    assert [tuple(x) for x in by[6].runs] == [(0, 200_000, 1)] and by[6].collapsed == "long"
    assert runs.find_runs(docs.drop("_text").limit(0)).count() == 0


def test_query_columns(spark, tmp_path):
    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 3) for _ in range(rnd.randrange(0, 90)))) for i in range(120)]
    rows += [(200, None), (None, "q " * 30), (rows[5][0], rows[5][1])]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_runs int").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for doc_id, text in rows:
        words = (text or "").encode().split()
        n = len(words)
        h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = brute(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        kept = b" ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in found))
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in found).encode()
        milli = 1000 * best[1] // best[2] if found else None
        want.append((doc_id, len(found), *best, milli, hashlib.sha256(lines).hexdigest(), hashlib.sha256(kept).hexdigest()))
    got = queries.op13_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
