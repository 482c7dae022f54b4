"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins, and so has each chosen pair of
features. Shallow trees over one feature's bins are boosted in turn, feature
after feature, and each tree is added into that feature's table; then the same
for pairs on what is left. A score is a sum of table entries.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations, islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sample_below, slices, tidy, with_text

#: Labelled rows that a model is fitted on, about.
SAMPLE_ROWS = 24_000
#: Bins of a feature, and of a feature within a pair.
BINS, PAIR_BINS = 64, 12
#: Rounds over all features and over all pairs, pairs, leaves of a tree.
ROUNDS, PAIR_ROUNDS, PAIRS, LEAVES = 150, 60, 8, 4
#: Step length, penalty on leaves, least second derivatives in a leaf.
RATE, PENALTY, LEAST = 0.1, 1.0, 3.0
#: Characters of a text that are counted at once.
SECTION = 1 << 20

FEATURES = (
    "log_chars", "log_words", "mean_word", "longest_word", "upper_share", "digit_share", "mark_share", "odd_mark_share",
    "blank_share", "line_share", "high_byte_share", "distinct_words", "top_word_share", "repeated_word_share",
    "distinct_lines", "long_line_share", "bare_word_share", "short_word_share", "end_share", "byte_entropy",
)

_KIND = np.zeros(256, np.uint8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = 1
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 2
_KIND[list(b"0123456789")] = 3
_KIND[list(b" \t\r\x0b\x0c")] = 4
_KIND[list(b"\n")] = 5
_KIND[list(b".,;:?!'\"()-")] = 6
_KIND[list(b"#$%&*+/<=>@[\\]^_`{|}~")] = 7
_KIND[128:] = 8


def _sections(text: str):
    """The text in pieces of bounded length that end at blanks where they can."""
    at = 0
    while len(text) - at > SECTION:
        cut = max(text.rfind(" ", at, at + SECTION), text.rfind("\n", at, at + SECTION)) + 1
        cut = cut if cut > at else at + SECTION
        yield text[at:cut]
        at = cut
    yield text[at:]


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES for a whole text; an empty or null one has zeros."""
    text = text or ""
    histogram = np.zeros(256, np.int64)
    words: Counter[str] = Counter()
    n_words = repeats = letters_only = 0
    for part in _sections(text):
        histogram += np.bincount(np.frombuffer(part.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
        own = part.split()
        n_words += len(own)
        words.update(own)
        repeats += sum(map(eq, own, islice(own, 1, None)))
        letters_only += sum(map(str.isalpha, own))
    lines = text.split("\n")
    kinds = np.bincount(_KIND, histogram, 9)
    total, n, chars = max(1, int(histogram.sum())), max(1, n_words), len(text)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    counts = np.fromiter(words.values(), np.int64, len(words))
    share = histogram[histogram > 0] / total
    ends = histogram[ord(".")] + histogram[ord("!")] + histogram[ord("?")]
    filled = [line for line in lines if line]
    return [
        np.log1p(chars), np.log1p(n_words), float((lengths * counts).sum()) / n, float(lengths.max(initial=0)),
        kinds[2] / max(1, kinds[1] + kinds[2]), kinds[3] / total, kinds[6] / total, kinds[7] / total,
        kinds[4] / total, len(lines) / n, kinds[8] / total, len(words) / n, counts.max(initial=0) / n, repeats / n,
        len(set(filled)) / max(1, len(filled)), max(map(len, lines)) / max(1, chars), 1 - letters_only / n,
        float(counts[lengths <= 3].sum()) / n, ends / n, float(-(share * np.log2(share)).sum()),
    ]


@dataclass
class Model:
    """Bin limits and tables of features and pairs; a score is their sum."""

    bias: float = 0.0
    limits: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_limits: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for f, (limits, table) in enumerate(zip(self.limits, self.tables, strict=True)):
            z += table[np.searchsorted(limits, x[:, f], "right")]
        if self.pairs:
            coarse = [np.searchsorted(limits, x[:, f], "right") for f, limits in enumerate(self.pair_limits)]
            for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
                z += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _limits(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best place to cut a run of bins in two, and what it gains."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - g.sum() ** 2 / (h.sum() + PENALTY)
    gain = np.where((left_h >= LEAST) & (right_h >= LEAST), gain, -1.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (-1.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of up to LEAVES leaves over one feature's bins: the step per bin."""
    leaves = [(0, len(g))]
    while len(leaves) < LEAVES:
        found = [(_cut(g[a:b], h[a:b]), a, b) for a, b in leaves]
        (gain, at), a, b = max(found)
        if gain <= 0:
            break
        leaves.remove((a, b))
        leaves += [(a, a + at), (a + at, b)]
    step = np.zeros(len(g))
    for a, b in leaves:
        step[a:b] = -g[a:b].sum() / (h[a:b].sum() + PENALTY)
    return step


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut across one axis with the best cuts across the other on both
    sides of it: what it gains, and the step per cell."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for turned in (False, True):
        gg, hh = (g.T, h.T) if turned else (g, h)
        up_g, up_h = np.cumsum(gg, 0), np.cumsum(hh, 0)
        for at in range(1, len(gg)):
            sides = ((up_g[at - 1], up_h[at - 1]), (up_g[-1] - up_g[at - 1], up_h[-1] - up_h[at - 1]))
            cuts = [_cut(*side) for side in sides]
            leaves, gain = [], 0.0
            for rows, (won, across), (g1, h1) in zip((slice(0, at), slice(at, len(gg))), cuts, sides, strict=True):
                for cols in (slice(0, across), slice(across, len(g1))) if won > 0 else (slice(0, len(g1)),):
                    a, b = g1[cols].sum(), h1[cols].sum()
                    gain += a * a / (b + PENALTY)
                    leaves.append((rows, cols, -a / (b + PENALTY)))
            if gain > best[0]:
                step = np.zeros_like(gg)
                for rows, cols, value in leaves:
                    step[rows, cols] = value
                best = (gain, step.T if turned else step)
    return best


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boosting in turns. Without rows of both labels the model is a constant."""
    model = Model()
    if not len(y) or y.min() == y.max():
        model.bias = 0.0 if not len(y) else float(6 * (2 * y[0] - 1))
        return model
    rate = y.mean()
    model.bias = float(np.log(rate / (1 - rate)))
    model.limits = [_limits(c, BINS) for c in x.T]
    model.tables = [np.zeros(len(q) + 1) for q in model.limits]
    bins = [np.searchsorted(q, c, "right") for q, c in zip(model.limits, x.T, strict=True)]
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return p - y, p * (1 - p)

    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables, strict=True):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            z += step[b]
    model.pair_limits = [_limits(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(q, c, "right") for q, c in zip(model.pair_limits, x.T, strict=True)]
    sizes = [len(q) + 1 for q in model.pair_limits]

    def grid(i: int, j: int, weights: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[i] * sizes[j] + coarse[j], weights, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    g, h = slopes()
    gains = sorted(((_pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j) for i, j in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(i, j) for gain, i, j in gains[:PAIRS] if gain > 0]
    model.pair_tables = [np.zeros((sizes[i], sizes[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = slopes()
            step = RATE * _pair_tree(grid(i, j, g), grid(i, j, h))[1]
            table += step
            z += step[coarse[i], coarse[j]]
    return model


def _featured(docs: DataFrame, rest: list[str], text: str, made) -> tuple[DataFrame, object]:
    base, at = with_text(docs, rest, text)

    def run(batches):
        for batch in slices(batches):
            values = batch.column(at)
            x = [features(v.as_py()) for v in values]
            new = made(np.array(x, np.float64).reshape(len(x), len(FEATURES)))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *new.values()], names=[*rest, *new])

    return base, run


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """A model of labels (key, label 0 or 1) from the texts of docs.

    About `rows` labelled documents are used, chosen by the hash of their key;
    all if there are fewer. Null labels and keys are left; a key with several
    labels counts once for each. The driver receives one row of features for each."""
    known = labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")).filter(F.col("_key").isNotNull() & F.col("_label").isin(0, 1))
    total = known.count()
    known = known.filter(sample_below(known, F.col("_key").cast("string"), rows, total, "quality"))
    # At most about `rows` rows, by the sample: small enough for every task.
    chosen = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(known), "_key")
    base, run = _featured(chosen, ["_label"], "text", lambda x: {"x": pa.array(list(x), pa.list_(pa.float64()))})
    found = base.mapInArrow(tidy(run), "_label int, x array<double>").collect()
    found.sort(key=lambda r: (r._label, r.x))
    x = np.array([r.x for r in found], np.float64).reshape(len(found), len(FEATURES))
    return train(x, np.array([r._label for r in found], np.float64))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs plus score (0 to 1, higher: label 1 likelier) and predicted (1 from
    0.5 on). Null and empty texts are scored by the features of an empty text,
    repeated rows alike, long texts whole; columns of the new names are replaced."""
    rest = [c for c in dict.fromkeys(docs.columns) if c not in ("score", "predicted")]

    def made(x: np.ndarray) -> dict:
        p = model.scores(x)
        return {"score": pa.array(p, pa.float64()), "predicted": pa.array((p >= 0.5).astype(np.int32), pa.int32())}

    base, run = _featured(docs, rest, text, made)
    return base.mapInArrow(tidy(run), base.select(*[F.col(f"`{c}`") for c in rest]).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)
