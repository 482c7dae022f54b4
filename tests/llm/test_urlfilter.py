import random

from barloom.llm import queries, urlfilter
from barloom.llm.urlfilter import Rule

RULES = [Rule("org/", "allow"), Rule("example.org/es/", "block"), Rule("a.org/", "block"), Rule("org/ab", "allow"), Rule("com/de/", "block")]


def judged(spark, urls, model=None):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    model = model or urlfilter.train([])
    rows = urlfilter.judge(df, RULES, model).collect()
    return [(r.host, r.path, r.rule, r.verdict) for r in sorted(rows, key=lambda r: r.page_id)]


def test_parts_and_rules(spark):
    assert judged(
        spark,
        [
            "http://Example.ORG/es/1?x", "https://sub.example.org/es", "http://notorg/x", "http://b.com/de/#", "http://b.com/DE/",
            None, "", "org/es", "x://y", "http://a.org/abc", "http://É.org/?q", "http://q.org#/x", "a://b://c/d", "http://a.org/x\ny?z",
        ],
    ) == [
        ("example.org", "/es/1", "example.org/es/", "block"),
        ("sub.example.org", "/es", "org/", "allow"),
        ("notorg", "/x", None, "allow"),
        ("b.com", "/de/", "com/de/", "block"),
        ("b.com", "/DE/", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("", "", None, "allow"),
        ("y", "", None, "allow"),
        ("a.org", "/abc", "a.org/", "block"),
        ("É.org", "/", "org/", "allow"),
        ("q.org", "", None, "allow"),
        ("b:", "//c/d", None, "allow"),
        ("a.org", "/x\ny", "a.org/", "block"),
    ]


def test_model_learns_host_and_path():
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(6))
    rows = [(f"{word()}.{d}", f"/{p}/{word()}", int(p == "news")) for d in ("net", "io") for p in ("news", "casino") for _ in range(60)]
    model = urlfilter.train(rows)
    tests = [(f"{word()}.net", f"/{p}/{word()}", int(p == "news")) for p in ("news", "casino") for _ in range(40)]
    assert sum((model.score(h, p) >= 0.5) == bool(y) for h, p, y in tests) >= 76
    assert urlfilter.train([]).score("a", "/b") == 0.5
    assert urlfilter.train([("a", "/b", 0)]).score("c", "/d") < 0.5


def test_labelled_table_is_bounded_and_repeatable(spark):
    df = spark.createDataFrame([(i, f"http://x{i % 50}.org/{i}") for i in range(400)] + [(900, None), (901, "http://z.net/a")], "page_id long, url string")
    rows = urlfilter.labelled_by_rules(df, RULES, rows=100)
    assert 50 < len(rows) < 200 and rows == urlfilter.labelled_by_rules(df.repartition(9), RULES, rows=100)
    assert all(y == 1 for _, _, y in rows)
    assert urlfilter.labelled_by_rules(df.limit(0), RULES) == []
    assert urlfilter.judge(df.limit(0), RULES, urlfilter.train(rows)).collect() == []


def test_clean_unruled_urls_stay_and_junk_goes(spark, tmp_path):
    """Whatever the domain's end and the language, as op6 runs."""
    ordinary = ["blog.tionsh", "ththan", "m.ththha", "www.riverbank", "old-bridge", "thering"]
    junk = ["m.casino-win", "free-bets", "www.cheap-pills", "ads-track", "adult-x", "royalpoker"]
    urls = [
        (h, f"http://{h}.example.{end}/{language}/{n}")
        for h in ordinary + junk for end in ("com", "net", "info") for language in ("en", "es", "de", "fr") for n in (17, 4470)
    ]
    spark.createDataFrame([(i, u) for i, (_, u) in enumerate(urls)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in queries.op6_url_filter(spark, str(tmp_path)).collect()}
    unruled = [(h, rows[i].verdict) for i, (h, _) in enumerate(urls) if rows[i].rule is None]
    clean = [v for h, v in unruled if h in ordinary]
    gone = [v for h, v in unruled if h in junk]
    assert clean.count("allow") >= 0.98 * len(clean) and gone.count("block") >= 0.95 * len(gone)


def test_made_table_is_balanced():
    table = urlfilter.labelled_table()
    assert len(table) == urlfilter.TABLE_ROWS and table == urlfilter.labelled_table()
    for end in ("com", "org", "net"):
        assert len({sum(h.endswith("." + end) and y == label for h, _, y in table) for label in (0, 1)}) == 1
    for language in ("en", "de", "fr", "es"):
        assert len({sum(p.startswith(f"/{language}/") and y == label for _, p, y in table) for label in (0, 1)}) == 1


def test_rule_labels_are_drawn_from_what_rules_decide(spark):
    """Rules decide 300 of 6,300 URLs; the table has them all, of both labels."""
    urls = [f"http://x{i}.net/{i}" for i in range(6000)] + [f"http://y.org/{i}" for i in range(200)] + [f"http://y.com/de/{i}" for i in range(100)]
    df = spark.createDataFrame(list(enumerate(urls + urls[-5:])), "page_id long, url string")
    labels = [y for _, _, y in urlfilter.labelled_by_rules(df, RULES, rows=400)]
    assert (labels.count(1), labels.count(0)) == (200, 100)
    labels = [y for _, _, y in urlfilter.labelled_by_rules(df, RULES, rows=100)]
    assert 25 < labels.count(1) < 80 and 25 < labels.count(0) < 80


def test_op6_rules_are_the_contracts(spark, tmp_path):
    """Each rule's verdict by a URL that it decides, as the contract lists them."""
    want = {
        "http://a.org/x": ("org/", "allow"), "http://example.org/es/2": ("example.org/es/", "block"), "http://www.example.org/en/17": ("example.org/en/1", "block"),
        "http://b.com/fr/": ("com/fr/", "allow"), "http://b.com/de/1": ("com/de/", "block"), "http://example.org/en/2": ("org/", "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = queries.op6_url_filter(spark, str(tmp_path)).collect()
    assert {(r.rule, r.verdict) for r in rows} == set(want.values()) and len(rows) == len(want)
