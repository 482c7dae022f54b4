import random

import numpy as np

from barloom.llm import quality


def test_tables_learn_steps_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.uniform(size=(6000, 4))
    y = (((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)).astype(float)
    model = quality.train(x[:4000], y[:4000])
    assert (0, 1) in [tuple(sorted(p)) for p in model.pairs]
    assert ((model.scores(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.95
    # A score is the sum of the tables' entries.
    z = model.bias + sum(t[np.searchsorted(q, x[0, f], "right")] for f, (q, t) in enumerate(zip(model.limits, model.tables, strict=True)))
    z += sum(t[tuple(np.searchsorted(model.pair_limits[f], x[0, f], "right") for f in p)] for p, t in zip(model.pairs, model.pair_tables, strict=True))
    assert abs(model.scores(x[:1])[0] - 1 / (1 + np.exp(-z))) < 1e-9


def test_few_labels():
    assert quality.train(np.zeros((0, 3)), np.zeros(0)).scores(np.zeros((1, 3)))[0] == 0.5
    assert quality.train(np.zeros((2, 3)), np.ones(2)).scores(np.zeros((1, 3)))[0] > 0.9


def test_features_of_sections_add_up(monkeypatch):
    text = " ".join(random.Random(1).choice(["ab", "Cd,", "e9", "##", "é"]) for _ in range(3000))
    whole = quality.features(text)
    monkeypatch.setattr(quality, "SECTION", 500)
    parts = quality.features(text)
    repeated = quality.FEATURES.index("repeated_word_share")
    assert all(abs(a - b) < 1e-9 for i, (a, b) in enumerate(zip(whole, parts, strict=True)) if i != repeated)
    assert abs(whole[repeated] - parts[repeated]) < 0.01
    assert quality.features(None) == quality.features("") and all(np.isfinite(quality.features("")))


def test_rows(spark):
    rnd = random.Random(2)
    good = lambda: " ".join("".join(rnd.choice("aeioutn") for _ in range(5)) for _ in range(40)) + "."
    bad = lambda: " ".join("".join(rnd.choice("AEIOU") for _ in range(5)) + "###" for _ in range(40))
    rows = [(i, good() if i % 3 else bad()) for i in range(600)] + [(700, None), (701, ""), (None, "x"), (1, good()), (702, "y " * 200_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string")
    labels = [(i, int(i % 3 > 0)) for i in range(0, 600, 2)] + [(1, None), (None, 1), (2, 1), (700, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in found if r.doc_id is not None and r.doc_id < 600) > 590
    assert quality.score(docs.limit(0), model).collect() == []
    same = quality.fit(docs.repartition(7), labels.repartition(3))
    assert [t.tolist() for t in same.tables] == [t.tolist() for t in model.tables]
