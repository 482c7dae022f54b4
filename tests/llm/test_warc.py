import numpy as np
import pytest

from barloom.llm import warc
from barloom.llm.shared import shared_path

SCHEMA = "page_id long, url string, html string, record_type string"


def trap(tail=""):
    """A payload with whole records in it, one of which ends where it ends."""
    inner = warc.record(77, "http://fake/", b"inside", False, None).decode()
    return f"before {inner} between WARC/1.1\r\nWARC-Type: x\r\nContent-Length: {len(tail)}\r\n\r\n{tail}"


def round_trip(spark, rows, least=0, payloads=True):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    folder = shared_path(spark, "warc-test")
    warc.write(df, folder, least)
    return sorted(warc.read(spark, folder, payloads).collect(), key=lambda r: (r.page_id is None, r.page_id or 0, r.record_type))


ROWS = [
    (1, "http://a/", trap()), (2, "http://b/", trap("tail")), (3, "u", "same"), (9, "u", "same"), (5, None, "same"), (6, "x\r\ny", "é" * 50),
    (7, "u", None), (8, "u", ""), (10, "u", "WARC/1.1\r\n" * 40), (None, "n", "lone"), (11, "u", "z" * 5000),
]


@pytest.mark.parametrize("block", [64, 1 << 20])
def test_records_come_back(spark, monkeypatch, block):
    monkeypatch.setattr(warc, "BLOCK", block)
    rows = round_trip(spark, ROWS)
    assert len(rows) == len(ROWS)
    by = {r.page_id: r for r in rows}
    for page_id, _, html in ROWS:
        body = (html or "").encode()
        r = by[page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(body), warc.digest(body))
        if r.record_type == "response":
            assert bytes(r.payload) == body and r.refers_to is None
    assert {k: r.refers_to for k, r in by.items() if r.record_type == "revisit"} == {3: 9, 5: 9, 7: 8}


def test_small_payloads_are_all_responses(spark):
    rows = round_trip(spark, ROWS, least=1)
    assert {r.page_id for r in rows if r.record_type == "revisit"} == {3, 5}


def test_a_hot_payload_and_repeats(spark):
    rows = [(i, "u", "hot" if i % 3 == 0 else f"p{i}") for i in range(300)] + [(297, "u", "hot"), (4, "u", "p4")]
    found = round_trip(spark, rows, payloads=False)
    assert len(found) == 302
    assert [r.page_id for r in found if r.record_type == "response" and r.page_id % 3 == 0] == [297, 297]
    assert {r.refers_to for r in found if r.record_type == "revisit"} == {297}


def test_revisits_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    assert {r.page_id for r in round_trip(spark, ROWS) if r.record_type == "revisit"} == {3, 5, 7}


def test_empty(spark):
    assert round_trip(spark, []) == []


def test_pointer_jumping_equals_walking():
    rng = np.random.default_rng(1)
    for _ in range(50):
        at = np.unique(rng.integers(0, 500, 60))
        following = np.array([rng.choice(np.append(at[at > a], [a + 600])) if rng.random() < 0.8 else a + 3 for a in at])
        nexts = dict(zip(at.tolist(), following.tolist(), strict=True))
        last, walk = [], []
        for a in at.tolist():
            while nexts[a] in nexts:
                a = nexts[a]
            last.append(a)
        a = int(at[0])
        while a in nexts:
            walk.append(a)
            a = nexts[a]
        assert at[warc.chained(at, following)].tolist() == last
        assert at[warc.reached(at, following, int(at[0]))].tolist() == walk


def test_archives_are_rolled_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3_000)
    rows = [(i, "u", f"{i} " + "x" * (7_000 if i % 10 == 0 else 900)) for i in range(60)]
    folder = shared_path(spark, "warc-test")
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).coalesce(1)
    warc.write(df, folder)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).collect()
    unpacked = [warc.inflated(f.content) for f in files]
    counts = [raw.count(warc.MAGIC) for raw in unpacked]
    assert sum(counts) == 60 and len(files) > 10
    assert all(len(raw) <= 3_000 or n == 1 for raw, n in zip(unpacked, counts, strict=True))
    found = warc.read(spark, folder, True).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in found) == [(i, html) for i, _, html in rows]
