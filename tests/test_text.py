"""Name handling against direct Python."""

import re
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import text as T

KEYS = ["沪深300", "红利", "红利低波", "医药", "A50"]
NAMES = [
    "华夏沪深300ETF", "红利低波ETF易方达", "华泰柏瑞红利ETF", "医药（创新）ETF", "中证A50ETF大成", "黄金", "TMT50 ETF", "",
    "景顺长城红利低波100ETF", "南方南方ETF",
]


def normal(x):
    return re.sub(r"[()\-_/·\s]+", "", x.strip().replace("（", "(").replace("）", ")"))


def tokens(x):
    n = normal(x)
    out = {k for k in KEYS if k in n} | set(re.findall(r"[A-Za-z]+\d*|\d+[A-Za-z]*", n.upper())) | set(re.findall(r"\d+", n))
    return (out or {n}) if n else set()


def similarity(a, b):
    na, nb = normal(a), normal(b)
    if not na or not nb:
        return 0.0
    if na == nb:
        return 1.0
    ta, tb = tokens(a), tokens(b)
    inside = min(len(na), len(nb)) / max(len(na), len(nb)) if na in nb or nb in na else 0.0
    return max(len(ta & tb) / len(ta | tb), 0.9 * inside, 0.6 * SequenceMatcher(None, na, nb).ratio())


def test_tokens_and_similarity(spark):
    rows = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in NAMES for b in NAMES)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    out = df.select("a", "b", T.name_tokens("a", KEYS).alias("t"), T.name_similarity("a", "b", KEYS).alias("s"), T.normalize_name("a").alias("n"))
    for r in out.collect():
        assert r["n"] == normal(r["a"])
        assert set(r["t"]) == tokens(r["a"])
        assert r["s"] == pytest.approx(similarity(r["a"], r["b"]), abs=1e-12)


def test_tracked_index(spark):
    want = {
        "华夏沪深300ETF": "沪深300", "红利低波ETF易方达": "红利低波", "华泰柏瑞红利ETF": "红利", "景顺长城红利ETF": "红利",
        "黄金": "黄金", "南方南方ETF": "南方南方", "沪深300华夏ETF联接": "沪深300",
    }
    df = spark.createDataFrame([(k,) for k in want], "name string")
    got = {r["name"]: r["x"] for r in df.select("name", T.tracked_index_name("name").alias("x")).collect()}
    assert got == want


def test_keywords_family_codes(spark):
    df = spark.createDataFrame([("红利低波ETF", "600001"), ("国债ETF", "000002"), ("医药消费", "430001")], "name string, code string")
    rows = df.select(
        T.match_keywords("name", KEYS).alias("k"), T.family("name").alias("f"), T.market_of("code").alias("m"), T.is_a_share("code").alias("a"),
        T.pad_code(F.lit(" 42 ")).alias("p"),
    ).collect()
    assert [r["k"] for r in rows] == [["红利", "红利低波"], [], ["医药"]]
    assert [r["f"] for r in rows] == ["diversified", "bond", "healthcare"]
    assert [r["m"] for r in rows] == ["SH", "SZ", "SZ"] and [r["a"] for r in rows] == [True, True, False]
    assert rows[0]["p"] == "000042"


def test_dedupe_prefers_marker_then_length(spark):
    df = spark.createDataFrame([("1", "long plain name"), ("1", "x ETF"), ("1", "xy ETF"), ("2", "a")], "symbol string, name string")
    assert {r["symbol"]: r["name"] for r in T.dedupe_names(df).collect()} == {"1": "xy ETF", "2": "a"}


def test_keywords_normalise_a_name_once(spark):
    """Not once per keyword and use: the work of a row must not grow with them."""
    keys = ["red", "A-B", "", "()", "red", "ring 5", "x1"]
    names = ["red（A-B）ring5", "RING 5 ab", " x-1 ", "", "（）", None, "a/b·x1"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, name string")
    out = df.select("id", T.match_keywords("name", keys).alias("k"), T.name_tokens("name", keys).alias("t"))
    want = [["red", "A-B", "ring 5"], ["A-B"], ["x1"], [], [], [], ["x1"]]
    assert [r["k"] for r in sorted(out.collect())] == want
    plan = df.select(T.match_keywords("name", keys).alias("k"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 2


def test_ratios_are_remembered_over_batches(monkeypatch):
    made = []
    monkeypatch.setattr(T, "SequenceMatcher", lambda *x: made.append(x) or SequenceMatcher(*x))
    batches = [(pd.Series(["ab", "cd", None]), pd.Series(["abc", "cx", "q"]))] * 3
    found = [list(x.fillna(-1)) for x in T._sequence_ratio.func(iter(batches))]
    assert found == [[0.8, 0.5, -1.0]] * 3 and len(made) == 2
