import random

import corpus_pipeline as cp
import public_tokenizers
import pytest
import tiktoken
from test_bpe import RANKS
from test_jaccard import expected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _row int"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "score", "_row"]


def prose(rnd, lang, n):
    parts = {"en": ["the", "and", "ing", "tion"], "de": ["sch", "und", "ung", "keit"]}[lang]
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(1)
    rows = []
    for i in range(200):
        lang = "en" if i % 3 else "de"
        text = prose(rnd, lang, rnd.randrange(20, 60))
        if i % 5 == 0:
            text = " ".join(w.upper() + "##" for w in text.split())
        rows.append((i, text, lang if i % 7 else None, f"s{i % 4}" if i % 11 else None, len(text), "x", 1))
    rows += [(300, None, "en", "s0", 0, "x", 1), (301, "", "en", "s0", 0, "x", 1), (302, "12 34", "en", "s0", 5, "x", 1)]
    rows += [(310 + i, rows[1][1], "en", "s1", rows[1][4], "x", 1) for i in range(5)] + [rows[2], rows[2], (None, rows[4][1] + " more", "en", "s2", 9, "x", 1)]
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = docs.collect()
    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["language ID", "quality classifier", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE"]

    first = cp.written(steps["language ID"](spark, docs, folder), "t")
    rows = first.collect()
    assert first.columns == COLUMNS
    assert sorted(rows, key=str) == sorted((r for r in before if r.text and any(c.isalpha() for c in r.text)), key=str)

    second = cp.written(steps["quality classifier"](spark, first, folder), "t")
    rows2 = second.collect()
    assert second.columns == COLUMNS
    assert {r.doc_id for r in rows if "##" not in r.text} <= {r.doc_id for r in rows2}
    assert not any("##" in r.text for r in rows2)

    third = cp.written(steps["n-gram Jaccard join"](spark, second, folder), "t")
    rows3 = third.collect()
    assert third.columns == COLUMNS
    groups = expected([(r.doc_id, r.text) for r in rows2])
    assert sorted(r.doc_id for r in rows3) == sorted({c for _, _, c in groups})

    fourth = cp.written(steps["mixing sources to target weights"](spark, third, folder), "t")
    rows4 = fourth.collect()
    assert fourth.columns == COLUMNS
    size = {r.doc_id: len(r.text.split()) for r in rows3}
    words: dict = {}
    for r in rows4:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    made = cp.mixing.mix(cp.q.sized(third), cp.q.WEIGHTS, cp.q.EPOCHS, cp.q.MIX_SEED)
    assert all(w <= 3 * size[d] for d, w in words.items())
    taken = {r.sid: (r.taken, r.target) for r in cp.mixing.taken_words(made).groupBy("sid").agg({"taken": "sum", "target": "max"}).toDF("sid", "taken", "target").collect()}
    assert all(abs(a - b) < 8 for a, b in taken.values()) and abs(sum(words.values()) - sum(size.values())) < 20

    fifth = steps["byte-level BPE"](spark, fourth, folder).collect()
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    assert sorted(r.n_tokens for r in fifth) == sorted(len(library.encode_ordinary(r.text)) for r in rows4)


def test_whole_run_and_empty_table(spark, folder, tmp_path):
    assert cp.run(spark, folder).count() > 100
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_texts_in_unlearned_scripts_go(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    strange = spark.createDataFrame([(700, "Καλημέρα κόσμε " * 20, None, "s0", 300, "x", 1), (701, "数据处理 " * 9 + "the and", None, "s0", 52, "x", 1)], SCHEMA)
    stage = dict(cp.STAGES)["language ID"]
    kept = {r.doc_id for r in stage(spark, docs.unionByName(strange), folder).collect()}
    assert not kept & {700, 701} and {1, 2, 3, 4} <= kept


@pytest.mark.parametrize("stage", ["n-gram Jaccard join", "mixing sources to target weights", "language ID"])
def test_columns_of_any_name_and_long_texts(spark, folder, stage):
    rnd = random.Random(3)
    names = ["_th", "_d", "_h", "_key", "_size", "_from", "_to", "_taken", "th", "d", "h", "node", "size", "first", "last", "sid", "start", "of", "epoch"]
    rows = [(i, prose(rnd, "en", 30), "en", f"s{i % 3}", 1, *[f"{n}{i}" for n in names]) for i in range(40)]
    long = prose(rnd, "en", 300_000)
    rows += [(100, long, "en", "s1", len(long), *names), (101, rows[3][1], "en", "s0", 1, *names), (102, None, "en", None, 0, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    got = dict(cp.STAGES)[stage](spark, docs, folder)
    assert got.columns == docs.columns
    known = {r.doc_id: r for r in docs.collect()}
    kept = got.collect()
    assert all(r[n] == known[r.doc_id][n] for r in kept for n in names)
    ids = {r.doc_id for r in kept}
    if stage == "n-gram Jaccard join":
        assert ids == set(known) - {101} and {r.doc_id: r.text for r in kept}[100] == long
    elif stage == "language ID":
        assert ids == set(known) - {102}
    else:
        assert 100 in ids and 102 not in ids
