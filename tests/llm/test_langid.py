import itertools
import random

import numpy as np
import pytest

from barloom.llm import langid

PARTS = {"aa": ["the", "and", "ing", "tion", "wh"], "bb": ["sch", "und", "ung", "keit", "zu"], "cc": ["привет", "мир", "дом", "снег"]}


def text(lang, n, rnd):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randrange(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    rnd = random.Random(1)
    rows = [(i, text(lang, 60, rnd), lang, "x") for i, lang in enumerate(list(PARTS) * 30)]
    rows += [(900, None, "aa", "x"), (901, "no label", None, "x"), (902, "", "bb", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


@pytest.fixture(scope="module")
def model(labelled):
    return langid.fit(labelled)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    scores = [rng.normal(0, 2, (n, 3)).astype(np.float32) for n in (5, 0, 1, 6, 3)]
    prior = np.array([0.1, 0.0, -0.1], np.float32)
    for s, labels in zip(scores, langid.viterbi(scores, prior, 1.5), strict=True):
        def value(path):
            return (prior[path[0]] if len(path) else 0) + sum(s[i, p] for i, p in enumerate(path)) - 1.5 * sum(a != b for a, b in itertools.pairwise(path))
        best = max(map(value, itertools.product(range(3), repeat=len(s))))
        assert value(labels) == pytest.approx(best, abs=1e-4)


def test_words_and_grams(model):
    words = langid.read_words(["Äb c1d", "", "e"], model.lower, model.script)
    assert [(int(t), int(a), int(b)) for t, a, b in zip(words.text, words.first, words.last, strict=True)] == [(0, 0, 2), (0, 3, 4), (0, 5, 6), (2, 0, 1)]
    assert words.begin.tolist() == [0, 6, 10, 14] and len(words.grams) == 18
    same = langid.read_words(["äB"], model.lower, model.script)
    assert same.grams.tolist() == words.grams[:6].tolist()


def test_languages_spans_and_odd_rows(spark, model):
    rnd = random.Random(2)
    mixed = text("aa", 30, rnd) + ". " + text("bb", 40, rnd) + " " + text("cc", 20, rnd)
    rows = [(1, text("aa", 20, rnd)), (2, text("bb", 20, rnd)), (3, text("cc", 20, rnd)), (4, mixed), (5, None), (6, ""), (7, "12 -- !"), (8, "数据"), (1, "x" * 300_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang_pred string")
    found = langid.identify(df, model, spans=True).collect()
    by = {r.doc_id: r for r in found if r.text is None or len(r.text) < 100_000}
    assert [by[i].lang_pred for i in range(1, 8)] == ["aa", "bb", "cc", "bb", "und", "und", "und"]
    assert [s.lang for s in by[4].spans] == ["aa", "bb", "cc"] and 0.3 < by[4].score < 0.8
    cut = by[4].spans[0]
    assert abs(cut["last"] - mixed.index(".")) < 12
    assert by[8].lang_pred in PARTS and by[5].score == 0.0
    assert len(found) == 9 and langid.identify(df.limit(0), model).collect() == []


def test_scripts_narrow(model):
    words = langid.read_words(["дом dom"], model.lower, model.script)
    scores = langid.word_scores(words, model)
    assert scores[0].tolist() == [-langid.WORD_LIMIT, -langid.WORD_LIMIT, 0.0] and scores[1, 2] == -langid.WORD_LIMIT


def test_groups_do_not_matter(model, monkeypatch):
    rnd = random.Random(3)
    texts = [text(rnd.choice(list(PARTS)), rnd.randrange(30), rnd) for _ in range(60)]
    whole = list(langid.label_texts(texts, model))
    monkeypatch.setattr(langid, "CHARS", 50)
    monkeypatch.setattr(langid, "SCORES", 70)
    assert list(langid.label_texts(texts, model)) == whole


def test_no_labels(spark):
    none = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(none, langid.fit(none)).collect()] == ["und"]


def test_scripts_of_no_language_count_against_the_score(spark, model):
    rnd = random.Random(6)
    known = text("aa", 10, rnd)
    n = sum(c.isalpha() for c in known)
    rows = [(1, "数据" * 40), (2, known), (3, known + " " + "数" * n), (4, known + " " + "数" * 3 * n)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [found[i].score for i in (1, 2, 3, 4)] == pytest.approx([0.0, 1.0, 0.5, 0.25])
    assert [found[i].lang_pred for i in (2, 3, 4)] == ["aa"] * 3
