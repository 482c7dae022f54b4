"""Language identification of mixed-language text.

Each word has a score per language: the log-probability of its character bigrams
and trigrams. The script of its first letter leaves only the languages that were
seen to use that script. The Viterbi algorithm then labels the words of a text so
that scores are best when each change of language costs a fixed penalty.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import on_workers, sample_below, slices, tidy, with_text

# First and last code point of the ranges of scripts.
SCRIPT_RANGES = (
    ("Latin", 0x0041, 0x024F),
    ("Greek", 0x0370, 0x03FF),
    ("Cyrillic", 0x0400, 0x052F),
    ("Armenian", 0x0530, 0x058F),
    ("Hebrew", 0x0590, 0x05FF),
    ("Arabic", 0x0600, 0x077F),
    ("Devanagari", 0x0900, 0x097F),
    ("Bengali", 0x0980, 0x09FF),
    ("Gurmukhi", 0x0A00, 0x0A7F),
    ("Gujarati", 0x0A80, 0x0AFF),
    ("Tamil", 0x0B80, 0x0BFF),
    ("Telugu", 0x0C00, 0x0C7F),
    ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F),
    ("Thai", 0x0E00, 0x0E7F),
    ("Georgian", 0x10A0, 0x10FF),
    ("Hangul", 0x1100, 0x11FF),
    ("Ethiopic", 0x1200, 0x137F),
    ("Khmer", 0x1780, 0x17FF),
    ("Latin", 0x1E00, 0x1EFF),
    ("Greek", 0x1F00, 0x1FFF),
    ("Kana", 0x3040, 0x30FF),
    ("Han", 0x3400, 0x4DBF),
    ("Han", 0x4E00, 0x9FFF),
    ("Hangul", 0xAC00, 0xD7AF),
    ("Han", 0xF900, 0xFAFF),
    ("Han", 0x20000, 0x323AF),
)
SCRIPTS = ("other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))

#: Documents per language that a model is fitted on, about.
SAMPLE_DOCUMENTS = 2_500
#: Hash buckets of the n-grams; pseudo-count of each.
BUCKETS, SMOOTHING = 1 << 16, 0.1
#: A language is a candidate for a script with so large a share of its letters.
SCRIPT_SHARE = 0.005
#: The most a word may speak against a language, and the cost of a change.
WORD_LIMIT, SWITCH = 12.0, 16.0
#: Characters handled at once, and scores (words times languages) kept at once.
CHARS, SCORES = 1 << 18, 1 << 21


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: the lower-case letter (0 for what is no letter), and the
    number of its script."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            small = chr(c).lower()
            lower[c] = ord(small) if len(small) == 1 else c
    script = np.zeros(0x110000, np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return lower, script


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages: log-probabilities
    allowed: np.ndarray  # scripts x languages
    prior: np.ndarray
    lower: np.ndarray
    script: np.ndarray


@dataclass
class Words:
    """The words of consecutive texts."""

    first: np.ndarray  # code point positions within the text
    last: np.ndarray  # not included
    text: np.ndarray
    script: np.ndarray
    grams: np.ndarray  # bucket numbers of all words, one after the other
    begin: np.ndarray  # of each word in grams


def read_words(texts: list[str], lower: np.ndarray, script: np.ndarray) -> Words:
    """Maximal runs of letters, with their n-grams: every pair and triple of
    letters with the blank before the word, and the last pair with the blank
    after it."""
    codes = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    gap = np.zeros(2, np.uint32)
    flat = np.concatenate([x for c in codes for x in (c, gap)]) if codes else gap
    sizes = np.array([len(c) + 2 for c in codes], np.int64)
    starts = np.cumsum(sizes) - sizes
    here = lower[flat].astype(np.uint64)
    before = np.concatenate([[0], here[:-1]]).astype(np.uint64)
    earlier = np.where(before == 0, np.uint64(0), np.concatenate([[0, 0], here[:-2]]).astype(np.uint64))
    letter = here > 0
    used = letter | (before > 0)
    at = np.flatnonzero(used)
    pair = (before[at] * np.uint64(0x9E3779B97F4A7C15)) ^ (here[at] * np.uint64(0xC2B2AE3D27D4EB4F))
    triple = (earlier[at] * np.uint64(0xD6E8FEB86659FD93)) + pair * np.uint64(0xA0761D6478BD642F)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    mixed = lambda x: ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> shift
    grams = np.stack([mixed(pair), mixed(triple)], 1).ravel().astype(np.int64)
    first = np.flatnonzero(letter & (before == 0))
    last = np.flatnonzero(~letter & (before > 0))
    text = np.searchsorted(starts, first, "right") - 1
    begin = 2 * np.searchsorted(at, first)
    return Words(first - starts[text], last - starts[text], text, script[flat[first]], grams, begin)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Per word and language, 0 for the best candidate and less for others."""
    if not len(words.first):
        return np.zeros((0, len(model.languages)), np.float32)
    sums = np.add.reduceat(model.table[words.grams], words.begin, axis=0)
    allowed = model.allowed[words.script]
    none = ~allowed.any(1)
    sums = np.where(allowed | none[:, None], sums, -np.inf)
    sums = np.maximum(sums - sums.max(1, keepdims=True), -WORD_LIMIT)
    sums[none] = 0
    return sums.astype(np.float32)


def viterbi(scores: list[np.ndarray], prior: np.ndarray, switch: float = SWITCH) -> list[np.ndarray]:
    """The best label of every word of every text, all texts step by step
    together; the longest come first, so that those still running lie in front."""
    order = sorted(range(len(scores)), key=lambda i: -len(scores[i]))
    sizes = np.array([len(scores[i]) for i in order])
    steps, width = (int(sizes[0]) if len(sizes) else 0), len(prior)
    if not steps:
        return [np.zeros(0, np.int16) for _ in scores]
    running = np.searchsorted(-sizes, -np.arange(1, steps + 1), "right")
    ends = np.cumsum(running)
    # Step by step: the t-th word of every text that has one.
    flat = np.empty((int(ends[-1]), width), np.float32)
    for row, i in enumerate(order):
        n = int(sizes[row])
        flat[(ends[:n] - running[:n]) + row] = scores[i]
    stay, best_before = np.ones(flat.shape, bool), np.zeros(len(flat), np.int16)
    value = flat[: running[0]] + prior
    final = np.zeros(len(order), np.int16)
    for t in range(1, steps):
        n, begin = int(running[t]), int(ends[t] - running[t])
        if n < len(value):
            final[n : len(value)] = value[n:].argmax(1)
            value = value[:n]
        top = value.argmax(1)
        change = value[np.arange(n), top][:, None] - switch
        keep = value >= change
        stay[begin : begin + n] = keep
        best_before[begin : begin + n] = top
        value = np.where(keep, value, change) + flat[begin : begin + n]
    final[: len(value)] = value.argmax(1)
    labels = np.empty(len(flat), np.int16)
    label = final
    for t in range(steps - 1, -1, -1):
        n, begin = int(running[t]), int(ends[t] - running[t])
        labels[begin : begin + n] = label[:n]
        held = stay[np.arange(begin, begin + n), label[:n]]
        label[:n] = np.where(held, label[:n], best_before[begin : begin + n])
    out: list[np.ndarray] = [np.zeros(0, np.int16)] * len(scores)
    for row, i in enumerate(order):
        out[i] = labels[(ends[: sizes[row]] - running[: sizes[row]]) + row]
    return out


def label_texts(texts: list[str | None], model: Model):
    """(language, score, spans) per text, in groups of bounded size."""
    if not model.languages:
        yield from (("und", 0.0, []) for _ in texts)
        return
    at = 0
    while at < len(texts):
        stop, words, held = at, [], 0
        while stop < len(texts) and (stop == at or held < SCORES):
            # Short texts are read together, CHARS characters at a time.
            upto, chars = stop, 0
            while upto < len(texts) and (upto == stop or chars + len(texts[upto] or "") <= CHARS):
                chars += len(texts[upto] or "")
                upto += 1
            read = read_words([t or "" for t in texts[stop:upto]], model.lower, model.script)
            words.append((read, word_scores(read, model), stop, upto))
            held += len(read.first) * len(model.languages)
            stop = upto
        parts = [p for w, s, a, b in words for p in np.split(s, np.searchsorted(w.text, np.arange(1, b - a)))]
        firsts = [p for w, _, a, b in words for p in np.split(w.first, np.searchsorted(w.text, np.arange(1, b - a)))]
        lasts = [p for w, _, a, b in words for p in np.split(w.last, np.searchsorted(w.text, np.arange(1, b - a)))]
        # Words in a script that no language uses.
        strange = [p for w, _, a, b in words for p in np.split(~model.allowed[w.script].any(1), np.searchsorted(w.text, np.arange(1, b - a)))]
        for labels, first, last, none in zip(viterbi(parts, model.prior), firsts, lasts, strange, strict=True):
            yield _summary(labels, first, last, none, model.languages)
        at = stop


def _summary(labels: np.ndarray, first: np.ndarray, last: np.ndarray, none: np.ndarray, languages: list[str]):
    """Letters of words without a language count for no language, but in the whole."""
    if not len(labels):
        return "und", 0.0, []
    letters = np.bincount(labels, np.where(none, 0, last - first), len(languages))
    best = int(letters.argmax()) if letters.any() else int(np.bincount(labels, last - first).argmax())
    edges = np.concatenate([[0], np.flatnonzero(np.diff(labels)) + 1, [len(labels)]])
    spans = [{"first": int(first[a]), "last": int(last[b - 1]), "lang": languages[labels[a]]} for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return languages[best], float(letters[best] / (last - first).sum()), spans


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", documents: int = SAMPLE_DOCUMENTS) -> Model:
    """A model from the texts of known language; rows without either are left.

    Of each language about `documents` documents are read, chosen by the hash of
    their key and whole; all documents where there are fewer. The driver receives
    counts: a number per language and bucket."""
    known = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    totals = {r.lang: r.n for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals)
    lower, script = _character_tables()
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((len(SCRIPTS), 0), bool), np.zeros(0), lower, script)
    chosen = F.lit(False)
    for name in languages:
        chosen = chosen | ((F.col("lang") == name) & sample_below(known, F.col("key").cast("string"), documents, totals[name], "langid"))
    tables = on_workers(labelled.sparkSession, (lower, script))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches):
            for text_, lang_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = read_words([text_], *tables())
                add = sums.setdefault(lang_, np.zeros(BUCKETS + len(SCRIPTS), np.int64))
                add[:BUCKETS] += np.bincount(words.grams, minlength=BUCKETS)
                add[BUCKETS:] += np.bincount(words.script, words.last - words.first, len(SCRIPTS)).astype(np.int64)
        for name, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "bucket", "n"])

    counted = known.filter(chosen).select("text", "lang").mapInArrow(tidy(count), "lang string, bucket int, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    column = {name: i for i, name in enumerate(languages)}
    dense = np.zeros((BUCKETS + len(SCRIPTS), len(languages)))
    dense[sums.bucket.to_numpy(), sums.lang.map(column).to_numpy(int)] = sums.n.to_numpy()
    grams = dense[:BUCKETS] + SMOOTHING
    letters = dense[BUCKETS:]
    prior = np.array([totals[name] for name in languages], np.float64)
    return Model(
        languages,
        np.log(grams / grams.sum(0)).astype(np.float32),
        letters >= SCRIPT_SHARE * np.maximum(letters.sum(0), 1),
        (1e-3 * np.log(prior / prior.sum())).astype(np.float32),
        lower,
        script,
    )


def identify(docs: DataFrame, model: Model, text: str = "text", spans: bool = False) -> DataFrame:
    """docs plus lang_pred, score and n_spans, and spans (array of first, last,
    lang in code points) if asked for.

    lang_pred is the language of most letters, score its share of all letters.
    Letters of words in a script that no learned language uses are among all but
    of no language; a text of such words only has score 0 and any learned language.
    A text that is null or has no letter, and every text under a model without
    languages, is `und` with score 0. Texts of any length are labelled whole;
    repeated rows alike; columns of the new names are replaced."""
    shared = on_workers(docs.sparkSession, model)
    new = ["lang_pred", "score", "n_spans", *(["spans"] if spans else [])]
    rest = [c for c in dict.fromkeys(docs.columns) if c not in new]
    base, at = with_text(docs, rest, text)
    span = "array<struct<first:int,last:int,lang:string>>"
    schema = base.select(*[F.col(f"`{c}`") for c in rest]).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "n_spans": F.lit(0)} | ({"spans": F.lit(None).cast(span)} if spans else {})).schema
    span_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("lang", pa.string())]))

    def run(batches):
        for batch in slices(batches):
            found = list(label_texts(batch.column(at).to_pylist(), shared()))
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([len(f[2]) for f in found], pa.int32())]
            made += [pa.array([f[2] for f in found], span_type)] if spans else []
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(rest))), *made], names=[*rest, *new])

    return base.mapInArrow(tidy(run), schema)
