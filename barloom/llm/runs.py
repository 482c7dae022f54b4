"""Periodic runs of words, found online by dyadic square catchers.

A run is a stretch of words with smallest period q, at least twice as long as q,
that no neighbouring word extends. Words are appended. Each completed block of a
power of two words, B, is a catcher for the periods 2B - 1 to 4B - 2: a square of
such a period holds an aligned block whose copy lies one period later. For each
appended word the suffix of length B is compared with the two blocks it may be the
copy of, at every level. Equal fingerprints open a comparison, which is checked
word by word, extended to the left, and advanced by each appended word until one
differs. Squares of the same period and stretch thereby merge into one run.

All words handed over at once are compared at once, as arrays; the runs known
after a call are those of all words so far, however they were handed over.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .shared import slices

#: Words of the shortest run that counts.
LEAST_LENGTH = 12
#: Words compared at once.
STEP = 1 << 16
#: Base of the fingerprints, modulo 2^64, and its inverse.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPANS = ArrayType(StructType([StructField(n, LongType(), False) for n in ("start", "length", "period")]), False)


class _Powers:
    """Powers of the base and of its inverse, as far as asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64)))) for b in (_BASE, _INVERSE))


_POWERS = _Powers()


def _grown(array: np.ndarray, size: int) -> np.ndarray:
    if len(array) >= size:
        return array
    out = np.zeros(max(size, 2 * len(array)), array.dtype)
    out[: len(array)] = array
    return out


class Catchers:
    """Runs of a growing sequence of word numbers (equal words, equal numbers)."""

    def __init__(self, least: int = LEAST_LENGTH):
        # Below 12 a run of period 1 to 6 need not hold an aligned pair twice.
        if least < LEAST_LENGTH:
            raise ValueError(f"runs of {LEAST_LENGTH} words or more")
        self.least, self.n = least, 0
        self.words, self.sums = np.zeros(64, np.int64), np.zeros(64, np.uint64)
        # Per word: the end and the period of the known run that reaches farthest.
        self.cover, self.by = np.zeros(64, np.int64), np.ones(64, np.int64)
        #: Comparisons that reach the last word: period -> first word.
        self.open: dict[int, int] = {}
        #: Period -> end of the last stretch compared.
        self._reach: dict[int, int] = {}
        self._closed: dict[tuple[int, int], int] = {}

    def append(self, words: np.ndarray) -> None:
        for first in range(0, len(words), STEP):
            self._append(np.asarray(words[first : first + STEP], np.int64))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of the runs of all words so far, in order."""
        found = dict(self._closed)
        for p, start in self.open.items():
            if self.n - start >= max(self.least, 2 * p):
                key = (start, self.n)
                found[key] = min(p, found.get(key, p))
        return sorted((s, e - s, p) for (s, e), p in found.items())

    def _append(self, new: np.ndarray) -> None:
        old, n = self.n, self.n + len(new)
        self.words, self.cover = _grown(self.words, n), _grown(self.cover, n)
        self.by, self.sums = _grown(self.by, n), _grown(self.sums, n + 1)
        _POWERS.reach(n + 1)
        self.words[old:n], self.by[old:n] = new, 1
        mixed = (new.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(29)
        self.sums[old + 1 : n + 1] = self.sums[old] + np.cumsum(mixed * _POWERS.up[old:n])
        self.n = n
        self._advance(old)
        size, low, high = 2, 1, 6
        while low < n:
            self._catch(size, low, high, max(0, old - size + 1), n - size)
            size *= 2
            low, high = 2 * size - 1, 4 * size - 2

    def _advance(self, old: int) -> None:
        for p, start in list(self.open.items()):
            end = self._right(p, old)
            if end < self.n:
                del self.open[p]
            self._keep(p, start, end)

    def _catch(self, size: int, low: int, high: int, first: int, last: int) -> None:
        """Suffixes of the level's length that begin at first to last."""
        at = np.arange(max(first, low), last + 1)
        if not len(at):
            return
        prints = self._prints(at, size)
        places, periods = [], []
        nearest = (at - low) // size * size
        for back in range(0, high - low + 1, size):
            block = nearest - back
            ok = np.flatnonzero((block >= 0) & (at - block <= high))
            ok = ok[self._prints(block[ok], size) == prints[ok]]
            # A known run over both copies whose period divides theirs is all of it.
            b, p = block[ok], at[ok] - block[ok]
            ok = ok[(self.cover[b] < at[ok] + size) | (p % self.by[b] != 0)]
            places.append(at[ok])
            periods.append(at[ok] - block[ok])
        places, periods = np.concatenate(places), np.concatenate(periods)
        order = np.lexsort((places, periods))
        places, periods = places[order].tolist(), periods[order].tolist()
        for u, p in zip(places, periods, strict=True):
            if u + size <= self._reach.get(p, 0):
                continue
            b = u - p
            if self.cover[b] >= u + size and p % self.by[b] == 0:
                continue
            if not np.array_equal(self.words[b : b + size], self.words[u : u + size]):
                continue
            start, end = self._left(p, u) - p, self._right(p, u + size)
            self._reach[p] = end
            if end == self.n:
                self.open[p] = start
            self._keep(p, start, end)

    def _keep(self, p: int, start: int, end: int) -> None:
        self._reach[p] = max(end, self._reach.get(p, 0))
        if end - start < max(self.least, 2 * p):
            return
        if end < self.n:
            self._closed[start, end] = min(p, self._closed.get((start, end), p))
        farther = self.cover[start:end] < end
        self.cover[start:end][farther] = end
        self.by[start:end][farther] = p

    def _prints(self, at: np.ndarray, size: int) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * _POWERS.down[at]

    def _right(self, p: int, x: int) -> int:
        """The first word from x on that differs from the one p before, or n."""
        step = 16
        while x < self.n:
            stop = min(self.n, x + step)
            differ = self.words[x:stop] != self.words[x - p : stop - p]
            if differ.any():
                return x + int(differ.argmax())
            x, step = stop, 2 * step
        return x

    def _left(self, p: int, x: int) -> int:
        """The first word of the stretch before x whose words equal those p before."""
        step = 16
        while x > p:
            stop = max(p, x - step)
            differ = (self.words[stop:x] != self.words[stop - p : x - p])[::-1]
            if differ.any():
                return x - int(differ.argmax())
            x, step = stop, 2 * step
        return x


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words, equal numbers."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def runs_of(words: list[bytes], least: int = LEAST_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of the words, by start, then period."""
    if len(words) < least:
        return []
    catchers = Catchers(least)
    catchers.append(numbered(words))
    return catchers.runs()


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    edges = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edges[start + period] += 1
        edges[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0)]


def find_runs(df: DataFrame, text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """df plus runs (start, length and period in words, by start, then period) and
    collapsed (the text's words that no run holds after its first period, joined by
    a blank).

    Words lie between blanks (space, tab to carriage return). Null and empty texts
    have no runs and collapse to an empty text. Texts of any length are read whole,
    one at a time, in time n log n for n words that repeat little. Repeated rows
    are alike; columns named runs or collapsed are replaced, others carried along;
    an empty table stays empty."""
    rest = [c for c in dict.fromkeys(df.columns) if c not in ("runs", "collapsed")]
    base = df.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = StructType([*base.select(*[F.col(f"`{c}`") for c in rest]).schema.fields, StructField("runs", _SPANS, False), StructField("collapsed", StringType(), False)])
    span = pa.struct([pa.field(n, pa.int64(), False) for n in ("start", "length", "period")])
    kind = pa.list_(pa.field("element", span, False))

    def work(batches):
        for batch in slices(batches, 256):
            found, left = [], []
            for value in batch.column(len(rest)).cast(pa.binary()).to_pylist():
                words = (value or b"").split()
                runs = runs_of(words, least)
                found.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
                left.append(b" ".join(collapsed(words, runs)))
            columns = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind), pa.array(left, pa.binary()).cast(pa.string())], names=[*rest, "runs", "collapsed"])

    return base.mapInArrow(work, schema)
