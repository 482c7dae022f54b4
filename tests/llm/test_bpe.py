import hashlib
import random
import struct

import public_tokenizers
import pytest
import tiktoken

from barloom.llm import bpe

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(RANKS, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts(n, seed=1):
    rnd = random.Random(seed)
    odd = [chr(c) for c in (0x1C, 0x85, 0xA0, 0x200B, 0x3000, 0xE9, 0x1F600, 0x4E2D, 0xAC00, 0x661, 0x300)]
    for _ in range(n):
        yield "".join(rnd.choice(odd) if rnd.random() < 0.3 else rnd.choice("  \n\tabcdeTHE're'll012...#$") for _ in range(rnd.randrange(40)))


def as_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_ids_equal_the_library(encoder, library):
    cases = [*texts(3000), "", " " * 300, "a" * 5000, "thé" * 200, "<|endoftext|>"]
    assert list(encoder.encode_all(cases)) == [as_bytes(library.encode_ordinary(t)) for t in cases]
    assert all(encoder.decode(x) == t.encode() for t, x in zip(cases, encoder.encode_all(cases), strict=True))


def test_long_texts_in_parts(encoder, library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 100)
    text = " ".join(texts(50, seed=2))
    assert next(encoder.encode_all([text])) == as_bytes(library.encode_ordinary(text))


def test_appends_and_edits_keep_the_table_exact(encoder):
    rnd = random.Random(3)
    for _ in range(200):
        data = bytes(rnd.choice(b"abcdefghij tion") for _ in range(rnd.randrange(1, 120)))
        table = encoder.table(b"")
        for at in range(0, len(data), 7):
            table.append(data[at : at + 7])
        assert table.ids() == encoder.merged(data)
        start = rnd.randrange(len(data))
        stop = min(len(data), start + rnd.randrange(4))
        put = bytes(rnd.choice(b"xyzaei") for _ in range(rnd.randrange(4)))
        table.edit(start, stop, put)
        assert table.data == data[:start] + put + data[stop:]
        assert table.last == encoder.table(table.data).last


def test_edit_near_the_start_stops_early(encoder):
    table = encoder.table(b"inthereading " * 200)
    assert table.edit(20, 21, b"q") < 200


def test_whole_rows(spark):
    rows = [(1, "Hello there", 5), (2, None, 6), (3, "", 7), (1, "Hello there", 5), (None, "x" * 100_000, 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    encoded = bpe.encode(df, RANKS, public_tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "n_tokens", "ids"]
    back = bpe.decode(encoded, RANKS, public_tokenizers.PATTERN).collect()
    assert sorted((r.text or "", bytes(r.decoded).decode()) for r in back) == sorted((r[1] or "", r[1] or "") for r in rows)
    trip = bpe.round_trip(df, RANKS, public_tokenizers.PATTERN).collect()
    assert len(trip) == 5
    assert {r.decoded_sha256 for r in trip if not r.text} == {hashlib.sha256(b"").hexdigest()}
    assert all(r.n_tokens == 0 for r in trip if not r.text)
    assert bpe.round_trip(df.limit(0), RANKS, public_tokenizers.PATTERN).collect() == []
