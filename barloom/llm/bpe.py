"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can end the prefix's
encoding. That token is the one whose neighbour, the last token of the prefix
before it, would stay apart from it if the two were encoded alone. The table of
last tokens therefore grows byte by byte: appending never changes what is there,
and after an edit only the entries behind it are made anew, until they agree
with the old ones over the length of the longest token.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import on_workers, slices, tidy, with_text

#: Pieces and token pairs remembered by one worker; full memories start anew.
MEMORY = 300_000
#: Characters of text whose new pieces are encoded in one go.
TOGETHER = 1 << 21
#: Pieces above so many bytes get a table of their own.
LONG_PIECE = 64
#: Texts above so many characters are split piece by piece instead of at once.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Lookup:
    """A fixed map from non-negative integers to integers, asked for many keys at
    once: open addressing in two arrays, at most a quarter full."""

    def __init__(self, pairs: dict[int, int]) -> None:
        self.bits = max(4, (4 * len(pairs)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        keys = np.fromiter(pairs.keys(), np.int64, len(pairs))
        values = np.fromiter(pairs.values(), np.int32, len(pairs))
        slots = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slots] < 0)
            at, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[at], self.values[at] = keys[put], values[put]
            rest = np.ones(len(keys), bool)
            rest[put] = False
            keys, values, slots = keys[rest], values[rest], (slots[rest] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values, -1 where there is none."""
        slots = self._slot(keys)
        out = self.values[slots]
        met = self.keys[slots]
        out[met != keys] = -1
        on = np.flatnonzero((met != keys) & (met >= 0))
        while len(on):
            slots[on] = (slots[on] + 1) & (len(self.keys) - 1)
            met = self.keys[slots[on]]
            hit = met == keys[on]
            out[on[hit]] = self.values[slots[on[hit]]]
            on = on[~hit & (met >= 0)]
        return out


class Memory(dict):
    """Values by key, made when first asked for; cleared when full."""

    def __init__(self, make) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.clear()
        self[key] = value = self.make(key)
        return value


class Encoder:
    """Token ids of texts by the ranks, each match of the pattern for itself."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        #: The two tokens whose merge makes a token; single bytes have none.
        self.split: dict[int, tuple[int, int]] = {}
        #: Tokens that merging never builds; they occur as whole pieces only.
        self.unbuilt = frozenset(r for t, r in ranks.items() if len(t) > 1 and not self._built(t, r))
        self._tables()
        self._memories()

    def _tables(self) -> None:
        """What the encoding of many pieces at once looks up: the edges of the
        tree of tokens, the token at each node, the halves of each token, and the
        token that two adjacent ones would join to."""
        edges: dict[int, int] = {}
        ends, joins, size = [-1], {}, max(self.tokens, default=0) + 1
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                below = edges.setdefault(node * 256 + byte, len(ends))
                if below == len(ends):
                    ends.append(-1)
                node = below
            ends[node] = -1 if rank in self.unbuilt else rank
            for i in range(1, len(token)):
                if (left := self.ranks.get(token[:i])) is not None and (right := self.ranks.get(token[i:])) is not None:
                    joins[left * size + right] = rank
        self.size, self.edges, self.joins, self.ends = size, Lookup(edges), Lookup(joins), np.array(ends, np.int32)
        self.lengths, self.halves = np.zeros(size, np.int64), np.full((size, 2), -1, np.int32)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)
            self.halves[rank] = self.split.get(rank, (-1, -1))

    def _memories(self) -> None:
        self.apart = Memory(self._apart)
        self.piece_ids: dict[str, bytes] = {}
        self.splitter = None

    def __getstate__(self):
        memories = ("apart", "piece_ids", "splitter")
        return {k: v for k, v in self.__dict__.items() if k not in memories}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._memories()

    def forget(self) -> None:
        """Free what was memorised; a worker keeps the encoder between tasks."""
        self.apart.clear()
        self.piece_ids.clear()

    def merged(self, data: bytes, parts_left: int = 1) -> list[int]:
        """The definition: join the adjacent pair of lowest rank, leftmost
        first, until none is a token or so many parts are left."""
        parts, find = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        while len(parts) > parts_left:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = find(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _built(self, token: bytes, rank: int) -> bool:
        halves = self.merged(token, parts_left=2)
        if len(halves) == 2:
            self.split[rank] = (halves[0], halves[1])
        return len(halves) == 2

    def _apart(self, pair: tuple[int, int]) -> bool:
        """Do the two tokens, encoded as one string, stay these two?

        Undo the merges at the boundary, latest first: the parts that meet there
        at any time must not form a token that would have been merged before
        either of them was used up."""
        tokens, find, split = self.tokens, self.ranks.get, self.split
        left, right = pair
        left_used = right_used = float("inf")
        while True:
            joined = find(tokens[left] + tokens[right])
            if joined is not None and joined < left_used and joined <= right_used:
                return False
            made_left, made_right = (left if left in split else -1), (right if right in split else -1)
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left_used, left = left, split[left][1]
            else:
                right_used, right = right, split[right][0]

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The token that ends the encoding of data[:end]; last holds those of
        all shorter prefixes."""
        find, apart, unbuilt = self.ranks.get, self.apart, self.unbuilt
        for start in range(max(0, end - self.longest), end):
            token = find(data[start:end])
            if token is not None and token not in unbuilt and (start == 0 or apart[last[start], token]):
                return token
        raise ValueError(f"byte {data[end - 1 : end]!r} is no token")

    def table(self, data: bytes) -> Prefixes:
        return Prefixes(self, data)

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.table(data).ids()

    def _all_apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """`_apart` for many pairs at once."""
        out = np.ones(len(left), bool)
        on = np.arange(len(left))
        never = np.iinfo(np.int32).max
        left, right = left.copy(), right.copy()
        left_used, right_used = np.full(len(left), never), np.full(len(left), never)
        while len(on):
            joined = self.joins.get(left.astype(np.int64) * self.size + right)
            meets = (joined >= 0) & (joined < left_used) & (joined <= right_used)
            out[on[meets]] = False
            made_left = np.where(self.halves[left, 0] >= 0, left, -1)
            made_right = np.where(self.halves[right, 0] >= 0, right, -1)
            go = np.flatnonzero(~meets & ((made_left >= 0) | (made_right >= 0)))
            on, by_left = on[go], (made_left > made_right)[go]
            left, right, left_used, right_used = left[go], right[go], left_used[go], right_used[go]
            left_used = np.where(by_left, left, left_used)
            right_used = np.where(by_left, right_used, right)
            left, right = np.where(by_left, self.halves[left, 1], left), np.where(by_left, right, self.halves[right, 0])
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pieces, their prefix tables filled side by side: at
        each start all tokens that begin there, walked down the token tree."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for i, piece in enumerate(pieces):
            if piece in self.ranks or len(piece) > LONG_PIECE:
                ids = self.encode_piece(piece)
                out[i] = struct.pack(f"<{len(ids)}I", *ids)
            elif piece:
                short.append(i)
        if not short:
            return out
        short.sort(key=lambda i: -len(pieces[i]))
        sizes = np.array([len(pieces[i]) for i in short])
        width = int(sizes[0])
        data = np.zeros((width, len(short)), np.uint8)
        flat = np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)
        row = np.repeat(np.arange(len(short)), sizes)
        data[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), row] = flat
        last = np.full((width + 1, len(short)), -1, np.int32)
        for start in range(width):
            rows = np.arange(int(np.searchsorted(-sizes, -start, "left")))
            node = np.zeros(len(rows), np.int64)
            for end in range(start + 1, min(width, start + self.longest) + 1):
                inside = int(np.searchsorted(rows, int(np.searchsorted(-sizes, -end, "right"))))
                rows, node = rows[:inside], node[:inside]
                node = self.edges.get(node * 256 + data[end - 1, rows]).astype(np.int64)
                rows, node = rows[node >= 0], node[node >= 0]
                if not len(rows):
                    break
                token = self.ends[node]
                new = np.flatnonzero((token >= 0) & (last[end, rows] < 0))
                if start and len(new):
                    new = new[self._all_apart(last[start, rows[new]], token[new])]
                last[end, rows[new]] = token[new]
        end, each = sizes.copy(), np.arange(len(short))
        taken = []
        while True:
            on = end[each] > 0
            each = each[on]
            if not len(each):
                break
            token = last[end[each], each]
            taken.append((each, token))
            end[each] -= self.lengths[token]
        rows = np.concatenate([r for r, _ in taken[::-1]])
        ids = np.concatenate([t for _, t in taken[::-1]])
        order = np.argsort(rows, kind="stable")
        packed = ids[order].astype("<u4").tobytes()
        stops = (np.cumsum(np.bincount(rows, minlength=len(short))) * 4).tolist()
        begin = 0
        for i, stop in zip(short, stops, strict=True):
            out[i] = packed[begin:stop]
            begin = stop
        return out

    def remember(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids by piece, of these pieces and others met before."""
        known = self.piece_ids
        new = [p for p in pieces if p not in known]
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = list(pieces)
        known.update(zip(new, self.encode_pieces([p.encode() for p in new]), strict=True))
        return known

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of the pattern, in lists of bounded length."""
        if self.splitter is None:
            import regex

            # White space as Unicode defines it, without the separators that
            # Python counts besides.
            exact = self.pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
            self.splitter = regex.compile(exact, regex.V1)
        if len(text) <= LONG_TEXT:
            yield self.splitter.findall(text)
        else:
            yield from ([m.group() for m in part] for part in batched(self.splitter.finditer(text), 1 << 16))

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.pieces(text or ""):
            known = self.remember(set(part))
            out.append(b"".join([known[p] for p in part]))
        return b"".join(out)

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """`encode` of each text; short texts share the work on new pieces."""
        group: list[list[str]] = []
        chars = 0

        def done() -> Iterator[bytes]:
            known = self.remember(set().union(*group))
            for part in group:
                yield b"".join([known[p] for p in part])
            group.clear()

        for text in texts:
            text = text or ""
            if len(text) > LONG_TEXT:
                yield from done()
                chars = 0
                yield self.encode(text)
                continue
            group += self.pieces(text)
            chars += len(text)
            if chars >= TOGETHER:
                yield from done()
                chars = 0
        yield from done()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Prefixes:
    """The last token of every byte prefix of one piece."""

    def __init__(self, encoder: Encoder, data: bytes = b"") -> None:
        self.encoder, self.data, self.last = encoder, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        for end in range(len(self.last), len(self.data) + 1):
            self.last.append(self.encoder.last_token(self.data, end, self.last))

    def edit(self, start: int, stop: int, put: bytes) -> int:
        """Replace data[start:stop]; returns how many entries were made anew."""
        data = self.data[:start] + put + self.data[stop:]
        old, shift = self.last, len(put) - (stop - start)
        last, agreed, end = old[: start + 1], 0, start + 1
        while end <= len(data):
            last.append(self.encoder.last_token(data, end, last))
            same = end > start + len(put) and last[end] == old[end - shift]
            agreed = agreed + 1 if same else 0
            end += 1
            if agreed >= self.encoder.longest:
                last += old[end - shift :]
                break
        self.data, self.last = data, last
        return end - start - 1

    def ids(self) -> list[int]:
        out, end, tokens = [], len(self.data), self.encoder.tokens
        while end:
            out.append(self.last[end])
            end -= len(tokens[out[-1]])
        return out[::-1]


def _mapped(df: DataFrame, column: str, make, types: dict[str, str], after=lambda: None) -> DataFrame:
    """df without columns of the new names, plus the new ones: make gives a
    dictionary for each of a list of values; after ends each partition."""
    rest = [c for c in dict.fromkeys(df.columns) if c not in types]
    base, at = with_text(df, rest, column)
    schema = base.select(*[F.col(f"`{c}`") for c in rest])
    for name, kind in types.items():
        schema = schema.withColumn(name, F.lit(None).cast(kind))
    arrow = {"binary": pa.binary(), "string": pa.string(), "bigint": pa.int64()}

    def run(batches):
        for batch in slices(batches):
            out = {name: [] for name in types}
            for made in make(batch.column(at).to_pylist()):
                for name, value in made.items():
                    out[name].append(value)
            keep = [batch.column(i) for i in range(len(rest))]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(out[n], arrow[t]) for n, t in types.items())], names=[*rest, *types])
        after()

    return base.mapInArrow(tidy(run), schema.schema)


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """df plus n_tokens and ids (little-endian unsigned 32-bit integers).

    A null or empty text has no tokens. Repeated rows are encoded alike; columns
    named n_tokens or ids are replaced. Any length of text is encoded whole in
    time proportional to its length. An empty table stays empty."""
    encoder = on_workers(df.sparkSession, Encoder(ranks, pattern))

    def make(values):
        for ids in encoder().encode_all(values):
            yield {"n_tokens": len(ids) // 4, "ids": ids}

    return _mapped(df, text, make, {"n_tokens": "bigint", "ids": "binary"}, lambda: encoder().forget())


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids") -> DataFrame:
    """df plus decoded: the bytes of the ids. Null ids decode to no bytes."""
    encoder = on_workers(df.sparkSession, Encoder(ranks, pattern))

    def make(values):
        return ({"decoded": encoder().decode(v or b"")} for v in values)

    return _mapped(df, ids, make, {"decoded": "binary"})


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text") -> DataFrame:
    """df plus n_tokens, ids_sha256 and decoded_sha256: encode and decode in one
    pass, for uses that need the digests and not the ids. Nulls, empty texts and
    clashing names as in `encode`."""
    encoder = on_workers(df.sparkSession, Encoder(ranks, pattern))

    def make(values):
        for ids in encoder().encode_all(values):
            yield {
                "n_tokens": len(ids) // 4,
                "ids_sha256": hashlib.sha256(ids).hexdigest(),
                "decoded_sha256": hashlib.sha256(encoder().decode(ids)).hexdigest(),
            }

    return _mapped(df, text, make, {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"}, lambda: encoder().forget())
