"""Sets of word shingles as sorted arrays of 64-bit hashes, many texts at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

WORDS = 5
#: Bytes of text hashed at once.
SECTION = 1 << 20

_RANDOM = np.random.default_rng(20240501)
_BYTES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTES[65:91] = _BYTES[97:123]  # A-Z count as a-z
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STEP = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_STEP, -1, 1 << 64)
_FOLD = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the step and of its inverse, modulo 2 to the 64."""
    size = 1 << max(12, (length - 1).bit_length())
    if size not in _powers:
        if len(_powers) > 4:
            _powers.clear()
        out = []
        for base in (_STEP, _BACK):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            out.append(np.cumprod(table, dtype=np.uint64))
        _powers[size] = (out[0], out[1])
    return _powers[size]


def _hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a run of bytes, and where they start. A word also
    ends at each cut."""
    blank = _BLANK[data]
    start = ~blank
    start[1:] &= blank[:-1]
    inside = cuts[(cuts > 0) & (cuts < len(data))]
    start[inside] = ~blank[inside]
    end = ~blank
    end[:-1] &= blank[1:]
    end[inside - 1] = ~blank[inside - 1]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + 1
    up, down = _tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[: len(data)], out=sums[1:])
    return mix((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)), first


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every word of consecutive texts: runs of other
    bytes than blanks, A to Z as a to z. The bytes are read in sections that end
    at blanks or between texts, so that working memory doesn't grow with texts."""
    hashes, texts, at, stop = [], [], 0, int(offsets[-1])
    while at < stop:
        to = min(stop, at + SECTION)
        while to < stop and not _BLANK[data[to]]:
            ahead = np.flatnonzero(_BLANK[data[to : to + SECTION]])
            to = to + int(ahead[0]) if len(ahead) else min(stop, to + SECTION)
        h, first = _hashes(data[at:to], offsets - at)
        hashes.append(h)
        texts.append(np.searchsorted(offsets, first + at, "right") - 1)
        at = to
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(texts)


def _folded(words: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    out = np.full(len(starts), length, np.uint64)
    for i in range(length):
        out = out * _FOLD + words[starts + i]
    return mix(out)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text its set of shingles: every WORDS words in a row, or all words if
    there are fewer; sorted. Empty without words."""
    words, text = word_hashes(data, offsets)
    n = len(offsets) - 1
    counts = np.bincount(text, minlength=n)
    begin = np.cumsum(counts) - counts
    full = np.flatnonzero(text[WORDS - 1 :] == text[: len(text) - WORDS + 1]) if len(text) >= WORDS else np.zeros(0, np.int64)
    long_hash = _folded(words, full, WORDS)
    ends = np.cumsum(np.maximum(counts - WORDS + 1, 0))
    out = [np.unique(part) for part in np.split(long_hash, ends[:-1])] if n else []
    for length in range(1, WORDS):
        few = np.flatnonzero(counts == length)
        for i, h in zip(few.tolist(), _folded(words, begin[few], length), strict=True):
            out[i] = np.array([h], np.uint64)
    return out


def set_id(shingles: np.ndarray) -> int:
    """A number that equal sets share, as a signed long."""
    total = mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64) + np.uint64(len(shingles))
    return int(mix(np.array([total]))[0].astype(np.int64))


def batches_of(texts: Sequence, most_bytes: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Consecutive texts (an Arrow string array) as bytes and offsets, a bounded
    number of bytes at a time: first text, bytes, offsets. Nulls are empty."""
    at = 0
    encoded: list[bytes] = []
    size = 0
    for i, value in enumerate(texts):
        encoded.append((value.as_py() or "").encode("utf-8", "surrogatepass"))
        size += len(encoded[-1])
        if size >= most_bytes:
            yield at, *_joined(encoded)
            at, encoded, size = i + 1, [], 0
    if encoded:
        yield at, *_joined(encoded)


def _joined(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.frombuffer(b"".join(parts), np.uint8), offsets
