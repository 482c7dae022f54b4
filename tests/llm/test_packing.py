import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from test_bpe import texts
from tokenizers import Tokenizer

from barloom.llm import bpe, packing, queries

RANKS = bpe.read_ranks(public_tokenizers.path(queries.PACKING_RANKS))
SCHEMA = "doc_id long, text string, source string, start int, ids string, queue int, n long, chunk int"


@pytest.fixture(scope="module")
def tokens():
    return packing.Tokens(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def read(ids, width):
    return [int.from_bytes(ids[i : i + width], "little") for i in range(0, len(ids), width)]


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(1)
    words = ["the", "and", "tion ", "über", "x", "12", "\n", "!?"]
    out = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else f"s{i % 7}" if i % 11 else None
        out.append((i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(0, 120))), source))
    return [*out, (700, None, "hot"), (701, "", "tiny"), (5, out[5][1], out[5][2]), (None, "no id", "s1"), (702, "a very long text " * 3000, "s2"), (703, "é" * 9000, None)]


def checked(pieces, rows, library, window):
    """Every id in exactly one piece, sequences without gaps; tokens per sequence
    and source, in order."""
    whole, parts = defaultdict(list), defaultdict(list)
    for doc_id, text, _ in rows:
        whole[doc_id].append(tuple(library(text)))
    for p in pieces:
        parts[p.doc_id].append((p.start, p.length, tuple(read(p.ids, 4)), p.doc_tokens))
    assert set(parts) == set(whole)
    for doc_id, copies in whole.items():
        covered = Counter()
        for start, length, ids, all_ in parts[doc_id]:
            assert length == len(ids) > 0 and any(ids == c[start : start + length] and all_ == len(c) for c in copies)
            covered.update((all_, i) for i in range(start, start + length))
        assert covered == Counter((len(c), i) for c in copies for i in range(len(c)))
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length, p.source))
    assert sorted(sequences) == list(range(len(sequences)))
    for n, held in sequences.items():
        at = 0
        for offset, length, _ in sorted(held, key=lambda x: x[:2]):
            assert offset == at
            at += length
        assert at == window or n == len(sequences) - 1 and 0 < at <= window
    return [Counter({s: sum(x[1] for x in held if x[2] == s) for s in {x[2] for x in held}}) for _, held in sorted(sequences.items(), key=lambda x: x[0])]


def test_ids_are_those_of_the_tokenizer(tokens, library, monkeypatch):
    cases = [*texts(2000), "", None, " " * 300, "a" * 5000, "<|endoftext|>", "aé ü b " * 300]
    assert [read(tokens.ids(t), 2) for t in cases] == [library(t) for t in cases]
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    long = " ".join(["don't", *texts(100, seed=3), "plain words here"] * 3)
    assert read(tokens.ids(long), 2) == library(long)


@pytest.mark.parametrize("chunk_tokens", [700, 1 << 19])
def test_windows_hold_the_sources_shares(spark, rows, tokens, library, chunk_tokens):
    pieces = packing.pack(table(spark, rows).repartition(4), tokens, window=256, quantum=16, chunk_tokens=chunk_tokens).collect()
    held = checked(pieces, rows, library, 256)
    total = Counter()
    for _, text, source in rows:
        total[source] += len(library(text))
    every, done = sum(total.values()), Counter()
    for n, h in enumerate(held, 1):
        done += h
        packed = min(n * 256, every)
        # Deficits stay below a few quanta from window to window and chunk to chunk.
        assert all(abs(done[s] - total[s] * packed / every) <= 3 * 16 for s in total)


def test_weights_until_a_queue_is_dry(spark, rows, tokens, library):
    pieces = packing.pack(table(spark, rows), tokens, {"hot": 3.0, "s2": 1.0, None: 2.0}, window=256, quantum=16, chunk_tokens=2000).collect()
    held = checked(pieces, rows, library, 256)
    total = Counter()
    for _, text, source in rows:
        total[source if source in ("hot", "s2") else None] += len(library(text))
    points = packing.clock(total, {"hot": 3.0, "s2": 1.0, None: 2.0})
    assert abs(points[-1][1] - sum(total.values())) < 1
    done, full = Counter(), int(points[1][1]) // 256
    for n, h in enumerate(held[:full], 1):
        done += h
        assert all(abs(done[s] - n * 256 * w / 6) <= 3 * 16 for s, w in (("hot", 3), ("s2", 1), (None, 2)))


def test_splits_joined_by_a_shuffle(spark, rows, tokens, library, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    checked(packing.pack(table(spark, rows).repartition(3), tokens, window=256, chunk_tokens=900).collect(), rows, library, 256)


def test_turns_serve_everything_once():
    rnd = random.Random(2)
    for _ in range(200):
        queues = [(n, rnd.random() - 0.5, n + rnd.random() - 0.5) for n in (rnd.randrange(0, 400) for _ in range(rnd.randrange(1, 9)))]
        room, served, free = 50, Counter(), rnd.randrange(1, 51)
        left = free
        for q, tokens in packing.turns(queues, free, room, 8):
            assert 0 < tokens <= left
            served[q] += tokens
            left = left - tokens or room
        assert [served[i] for i in range(len(queues))] == [q[0] for q in queues]


def test_empty_table_and_query(spark, rows, tokens, library, tmp_path):
    assert packing.pack(table(spark, rows).limit(0), tokens).count() == 0
    table(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op12_mixed_packing(spark, str(tmp_path)).collect()
    text = {d: library(t) for d, t, _ in rows}
    for r in got:
        ids = text[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)) and r.doc_tokens == len(text[r.doc_id])
        assert r.offset + r.length <= 2048
