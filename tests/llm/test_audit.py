from itertools import permutations

import pytest
from pyspark.sql import functions as F

from barloom.llm import audit

SCHEMA = "doc_id long, text string, lang string, mask int, good int, n long"
LABELS = "doc_id long, quality int, toxic int, n int"
LONG = " ".join(f"w{i}" for i in range(150))


def brute(docs, labels):
    fails = []
    for doc_id, text, lang, *_ in docs:
        t = text or ""
        words = [w for w in t.replace("\n", " ").split(" ") if w]
        copy = any(d is not None and doc_id is not None and d < doc_id and (x or "") == t for d, x, *_ in docs)
        checks = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t), any(c in "#$%&*|" for c in t), copy)
        marks = [x for x in labels if x[0] is not None and x[0] == doc_id]
        fails.append((lang or "", {f for f, c in zip("ABCDE", checks, strict=True) if c}, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = []
    for part in {f[0] for f in fails}:
        rows, shapley = [], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            stay = [f for f in fails if f[0] == part]
            gone = []
            for step, letter in enumerate(order, 1):
                here = [f for f in stay if letter in f[1]]
                redundant = sum(letter in f[1] for f in gone)
                stay, gone = [f for f in stay if letter not in f[1]], gone + here
                shapley[letter] += len(here)
                only = sum(f[0] == part and f[1] == {letter} for f in fails)
                rows.append([part, "".join(order), step, len(stay), len(here), redundant, only, sum(f[2] for f in here), sum(f[3] for f in here)])
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


DOCS = [
    (1, LONG, "en"), (2, LONG, "de"), (3, LONG, None), (3, LONG, "en"), (3, LONG, "en"), (None, LONG, "en"), (None, None, ""),
    (4, None, "en"), (5, "", "en"), (6, "a b\nc", "en"), (7, LONG.upper(), "en"), (8, LONG + " #", "de"), (9, "x " * 500, "de"),
    (10, "É" * 9 + "Z", "fr"), (11, "É" * 8 + "Z", "fr"), (12, LONG + " | \U0001f600", "fr"), (13, LONG, "zz"), (14, "A" * 200000 + " & b", "zz"),
    (15, " ".join(["a"] * 20 + [f"w{i}" for i in range(79)]), "en"), (16, " ".join(["a"] * 21 + [f"w{i}" for i in range(79)]), "en"),
]
MARKS = [(1, 1, 0), (3, 1, None), (3, 0, 1), (7, 1, 1), (8, 0, 0), (9, None, 1), (None, 1, 1), (99, 1, 1)]


def test_totals_equal_every_order_applied(spark):
    docs = spark.createDataFrame([(*d, 7, 8, 9) for d in DOCS], SCHEMA).repartition(5)
    labels = spark.createDataFrame([(*m, 3) for m in MARKS], LABELS)
    got = audit.audit(docs, labels)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == brute(DOCS, MARKS)


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, LONG, "en", 1, 1, 1)], SCHEMA)
    rows = audit.audit(one, labels).collect()
    assert len(rows) == 600 and all(r.kept == 1 and not r.removed and not r.shapley for r in rows)


def test_many_copies_meet_as_few_rows(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(LONG).alias("text"), F.when(F.col("id") % 2 == 0, "en").alias("lang"))
    counts = {(r.part, r["mask"]): r.n for r in audit.mask_counts(audit.failures(docs), spark.createDataFrame([], LABELS)).collect()}
    assert counts == {("en", 0): 1, ("en", 16): 1499, ("", 16): 1500}


@pytest.mark.parametrize("size", [1, 2, 4, 5])
def test_ranks_are_lexicographic(size):
    assert [audit.lehmer_rank(p, size) for p in permutations(range(size))] == list(range(len(list(permutations(range(size))))))
