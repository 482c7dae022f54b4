"""URL filter: rules first, then a logistic regression on hashed character
n-grams of host and path."""

from __future__ import annotations

import random
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Characters of an n-gram, weights of the model, passes over the table.
NGRAMS, BITS, PASSES = (2, 3, 4, 5), 16, 300
#: The labelled table holds so many URLs, about.
TABLE_ROWS = 4_000

# The words of the labelled table.
_JUNK = (
    "casino", "poker", "bets", "betting", "jackpot", "slots", "roulette", "pills", "viagra", "cialis", "pharma", "adult", "porn", "xxx",
    "escort", "spam", "ads", "adserver", "clickbait", "tracker", "loans", "payday", "replica", "warez", "cracked", "malware", "phishing", "lottery",
)
_ORDINARY = (
    "library", "garden", "weather", "school", "museum", "music", "recipes", "science", "history", "travel", "health", "sports", "cinema", "books",
    "kitchen", "physics", "village", "council", "theatre", "railway", "forest", "hospital", "journal", "letters", "animals", "winter", "harbour", "addresses",
    "gardening", "cooking", "painting", "building",
)
_EITHER = ("free", "cheap", "best", "online", "win", "big", "new", "farm", "track", "world", "shop", "x", "24", "my")
_SYLLABLES = tuple(c + v for c in "bcdfghjklmnprstvwz" for v in "aeiou") + ("st", "nd", "ing", "er", "ck", "sh", "th")
_ENDS = ("com", "org", "net", "info", "io", "example.com", "example.org", "example.net")
_FIRSTS, _LANGUAGES = ("", "www.", "m.", "blog."), ("en", "de", "fr", "es", "it", "pt")


def parts(url: str):
    """Host and path as columns: the host stands after the first :// up to /, ?,
    # or the end, A to Z in lower case; the path then up to ?, # or the end. Both
    are empty without a URL or without ://."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.expr(f"substring(coalesce(`{url}`, ''), locate('://', coalesce(`{url}`, '')) + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


@dataclass(frozen=True)
class Rule:
    """A host with all its subdomains, and the start of a path."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


class Rules:
    """The longest fitting rule of a URL, the one with the longer host among
    equally long ones, found by the suffixes of its host."""

    def __init__(self, rules: Iterable[Rule]) -> None:
        self.by_host: dict[str, list[Rule]] = {}
        for rule in sorted(rules, key=lambda r: (-len(r.text), -len(r.host))):
            self.by_host.setdefault(rule.host, []).append(rule)

    def find(self, host: str, path: str) -> Rule | None:
        labels, best = host.split("."), None
        for i in range(len(labels)):
            for rule in self.by_host.get(".".join(labels[i:]), ()):
                if path.startswith(rule.path):
                    if best is None or len(rule.text) > len(best.text):
                        best = rule
                    break
        return best


def features(host: str, path: str) -> np.ndarray:
    """The numbers of the distinct n-grams; host and path have their own."""
    found = set()
    for kind, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode()
        for n in NGRAMS:
            seed = zlib.crc32(f"{kind}{n}".encode())
            found.update(zlib.crc32(raw[i : i + n], seed) & ((1 << BITS) - 1) for i in range(len(raw) - n + 1))
    return np.fromiter(sorted(found), np.int64, len(found))


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def score(self, host: str, path: str) -> float:
        """How likely the URL is allowed, 0 to 1."""
        x = features(host, path)
        z = self.bias + (self.weights[x].sum() / np.sqrt(len(x)) if len(x) else 0.0)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(table: Sequence[tuple[str, str, int]], l2: float = 1e-4, rate: float = 4.0) -> Model:
    """Logistic regression by full-batch descent with momentum over the table's
    (host, path, allowed) rows, both labels weighing the same. With only one
    label, or no row, the model gives that label's score, or 0.5."""
    labels = np.array([y for *_, y in table], np.float64)
    model = Model(np.zeros(1 << BITS), 0.0)
    if not len(labels) or labels.min() == labels.max():
        model.bias = 0.0 if not len(labels) else float(8 * (2 * labels[0] - 1))
        return model
    rows = [features(host, path) for host, path, _ in table]
    at = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    cols = np.concatenate(rows)
    size = 1 / np.sqrt(np.maximum(1, [len(x) for x in rows]))
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (len(labels) - labels.sum()))
    speed, bias_speed = np.zeros_like(model.weights), 0.0
    for _ in range(PASSES):
        z = model.bias + np.bincount(at, model.weights[cols], len(rows)) * size
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) * share
        speed = 0.9 * speed + np.bincount(cols, (error * size)[at], len(speed)) + l2 * model.weights
        bias_speed = 0.9 * bias_speed + error.sum()
        model.weights -= rate * speed
        model.bias -= rate * bias_speed
    return model


def labelled_table(rows: int = TABLE_ROWS) -> list[tuple[str, str, int]]:
    """A made labelled table of about `rows` rows: host, path and whether the URL
    is ordinary (1) or junk (0), the same in every run.

    A junk URL has a word for gambling, pills, adult pages, spam or the like in
    its host or its path. Ordinary URLs have ordinary or made-up words there. All
    else goes with both labels equally often: each pair has its domain's end,
    first label, language, page number and further words in common. So neither the
    rules nor a domain's end or a language decide."""
    rnd = random.Random(20)
    made = lambda: "".join(rnd.choice(_SYLLABLES) for _ in range(rnd.randint(2, 4)))
    out = []
    for i in range(rows // 2):
        # Both layouts with every end, language and first label.
        end, language, first = _ENDS[i % 8], _LANGUAGES[i // 8 % 6], _FIRSTS[i // 48 % 4]
        more = rnd.choice((rnd.choice(_EITHER), made(), ""))
        glue, in_front, in_path = rnd.choice(("-", "-", "")), rnd.random() < 0.5, rnd.random() < 0.3
        number, other, tail = rnd.randrange(10_000), rnd.choice((made(), rnd.choice(_ORDINARY))), rnd.choice(("", "", "/", ".html"))
        for word, allowed in ((rnd.choice(_JUNK), 0), (rnd.choice((made(), made(), rnd.choice(_ORDINARY))), 1)):
            name = glue.join(x for x in ((more, word) if in_front else (word, more)) if x)
            host, path = (other, f"/{name}/{number}{tail}") if in_path else (name, f"/{number}{tail}")
            out.append((f"{first}{host}.{end}", f"/{language}{path}", allowed))
    return out


def judge(pages: DataFrame, rules: Iterable[Rule], model: Model, key: str = "page_id", url: str = "url") -> DataFrame:
    """key, host, path, rule (null without one), verdict and score.

    The rule decides; where none fits, the model allows from 0.5 on. A null URL
    or one without :// has an empty host and path, which no rule fits; the model
    judges it like any other. Repeated rows are judged alike; further columns are
    left out. Rules and model are parameters of fixed size."""
    host, path = parts(url)
    known = Rules(rules)

    def decide(batches):
        for pdf in batches:
            hit = [known.find(h, p) for h, p in zip(pdf.host, pdf.path, strict=True)]
            score = [model.score(h, p) for h, p in zip(pdf.host, pdf.path, strict=True)]
            pdf["rule"] = [r.text if r else None for r in hit]
            pdf["verdict"] = [r.verdict if r else ("allow" if s >= 0.5 else "block") for r, s in zip(hit, score, strict=True)]
            pdf["score"] = score
            yield pdf

    urls = pages.select(F.col(f"`{key}`"), host.alias("host"), path.alias("path"))
    kind = dict(urls.dtypes)[key]
    return urls.mapInPandas(decide, f"`{key}` {kind}, host string, path string, rule string, verdict string, score double")


def labelled_by_rules(pages: DataFrame, rules: Iterable[Rule], url: str = "url", rows: int = TABLE_ROWS) -> list[tuple[str, str, int]]:
    """A small labelled table from the URLs that rules decide: host, path and
    whether the verdict is to allow. Distinct URLs that a rule fits, about `rows`
    of them, half of each label where there are as many, chosen by hash, the same
    in every run; at most twice as many reach the driver."""
    host, path = parts(url)
    known = Rules(rules)

    def label(batches):
        for pdf in batches:
            hit = [known.find(h, p) for h, p in zip(pdf.host, pdf.path, strict=True)]
            yield pd.DataFrame({"host": pdf.host, "path": pdf.path, "allowed": [int(r.verdict == "allow") if r else None for r in hit]}).dropna()

    urls = pages.select(host.alias("host"), path.alias("path"))
    labelled = written(urls.mapInPandas(label, "host string, path string, allowed int").distinct(), "labelled-urls")
    totals = {r.allowed: r.n for r in labelled.groupBy("allowed").agg(F.count("*").alias("n")).collect()}
    # What one label has less than half, the other has more.
    wanted = {y: max(rows // 2, rows - totals.get(1 - y, 0)) for y in totals}
    picked = F.lit(False)
    for y, n in totals.items():
        limit = int(min(1.0, wanted[y] / n) * (1 << 30))
        picked = picked | ((F.col("allowed") == y) & (F.pmod(F.xxhash64("host", "path"), F.lit(1 << 30)) < limit))
    found = labelled.filter(picked).orderBy("host", "path").limit(2 * rows).collect()
    return [(r.host, r.path, r.allowed) for r in found]
