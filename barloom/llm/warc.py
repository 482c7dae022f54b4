"""WARC archives: written as record files, read back by boundary chains.

Reading. An archive is cut into blocks. In each block every place that looks like
the start of a record is a candidate, and each candidate names its successor: the
place its header and length lead to. Payloads may hold such places too. Only a
candidate that the chain from the file's start reaches is a record. Within a
block the chain is followed by pointer jumping in the task; between blocks by
pointer jumping over joins, in as many rounds as the logarithm of the blocks.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_path, written

MAGIC = b"WARC/1.1\r\n"
#: Bytes of a block.
BLOCK = 1 << 20
#: Records and unpacked bytes of an archive, at most; a longer record is alone.
ARCHIVE_RECORDS, ARCHIVE_BYTES = 1_000, 64 << 20
#: A table of revisits above so many rows meets the pages by a shuffle.
BROADCAST_ROWS = 10_000
#: Copies of a group's winner, so that no group's rows meet in one task.
SALTS = 32
_RECORD = "urn:page:"
_FIELDS = re.compile(rb"WARC/1\.1\r\n((?:[A-Za-z0-9-]+:[^\r\n]*\r\n)+)\r\n")
_HTTP = re.compile(rb"HTTP/1\.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: (\d+)\r\n\r\n")
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(key: int | None, url: str | None, payload: bytes, revisit: bool, of: int | None) -> bytes:
    """One record: the HTTP header with the payload's length, and the payload
    unless the record is a revisit."""
    name = lambda k: f"<{_RECORD}{'' if k is None else k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {name(key)}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha1:{digest(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if revisit:
        fields += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(of)}"]
    return MAGIC + "".join(f"{x}\r\n" for x in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write(pages: DataFrame, folder: str, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """One record per row into gzip archives below folder.

    Of rows whose payloads are equal and of least_bytes or more, the one with the
    largest key is the response, the others are revisits of it; smaller payloads
    are all responses. A null payload is an empty one, a null key comes before all
    others. Among rows with the largest key the largest URL wins; rows equal in
    all three are all responses. Further columns are left out, an empty table
    makes archives without records."""
    rows = pages.select(
        F.col(f"`{key}`").cast("long").alias("key"),
        F.col(f"`{url}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{payload}`").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    narrow = written(rows.select("key", "url", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("bytes")), "warc-payloads")
    # The winner of each group by partial maxima: no group is gathered anywhere.
    won = narrow.filter(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.max(F.struct("key", "url")).alias("won"), F.count("*").alias("n"))
    won = won.filter("n > 1").select("sha", "won", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    again = (
        narrow.withColumn("salt", F.pmod(F.xxhash64("key", "url"), F.lit(SALTS)).cast("int")).join(won, ["sha", "salt"])
        .filter(~F.struct("key", "url").eqNullSafe(F.col("won")))
        .select("key", "url", "sha", F.col("won.key").alias("of")).distinct()
    )
    again = written(again, "warc-revisits").select(F.col("key").alias("k"), F.col("url").alias("u"), F.col("sha").alias("s"), "of")
    revisits = again.count()
    if revisits:
        # A revisit is found by its key, its URL and its payload together.
        known = F.broadcast(again) if revisits <= BROADCAST_ROWS else again
        same = F.col("key").eqNullSafe(F.col("k")) & F.col("url").eqNullSafe(F.col("u")) & (F.col("sha") == F.col("s"))
        rows = rows.withColumn("sha", F.sha1("payload")).join(known, same, "left").withColumn("revisit", F.col("s").isNotNull())
    else:
        rows = rows.withColumn("revisit", F.lit(False)).withColumn("of", F.lit(None).cast("long"))

    most, bytes_most = ARCHIVE_RECORDS, ARCHIVE_BYTES

    def records(batches):
        archive, held, size = 0, 0, 0
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            # The text writer ends each row with the record's last byte.
            made = [record(k, u, p, r, o)[:-1] for k, u, p, r, o in zip(*columns, strict=True)]
            archives = []
            for raw in made:
                if held and (held == most or size + len(raw) > bytes_most):
                    archive, held, size = archive + 1, 0, 0
                held, size = held + 1, size + len(raw) + 1
                archives.append(archive)
            yield _batch({"value": made, "archive": archives}, {"value": "binary", "archive": "int"})

    # Archives are numbered within a task; each of its numbers is a file.
    lines = rows.select("key", "url", "payload", "revisit", "of").mapInArrow(records, "value binary, archive int")
    lines = lines.select(F.col("value").cast("string"), "archive")
    lines.write.partitionBy("archive").option("lineSep", "\n").option("compression", "gzip").text(folder)


def _batch(columns: dict[str, list], types: dict[str, str]):
    import pyarrow as pa

    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    return pa.RecordBatch.from_arrays([pa.array(columns[n], kinds[t]) for n, t in types.items()], names=list(types))


def inflated(content: bytes) -> bytes:
    """The bytes of an archive; gzip members one after the other are joined."""
    if content[:2] != b"\x1f\x8b":
        return content
    out = []
    while content:
        member = zlib.decompressobj(31)
        out.append(member.decompress(content))
        content = member.unused_data
    return b"".join(out)


def successor(raw: bytes, at: int) -> tuple[int, dict[str, str], int, int] | None:
    """Where the record that seems to start here ends, its fields, and where its
    block starts and ends; None if no record can start here."""
    found = _FIELDS.match(raw, at)
    if found is None:
        return None
    lines = found[1].decode("utf-8", "replace").split("\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines if line)}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    end = found.end() + int(length)
    if raw[end : end + 4] != b"\r\n\r\n":
        return None
    return end + 4, fields, found.end(), end


def chained(offsets: np.ndarray, following: np.ndarray) -> np.ndarray:
    """For each candidate of a block the last one its chain reaches in the block,
    by pointer jumping: each round doubles every pointer's reach."""
    here = np.searchsorted(offsets, following)
    inside = (here < len(offsets)) & (offsets[np.minimum(here, len(offsets) - 1)] == following)
    jump = np.where(inside, here, np.arange(len(offsets)))
    while not np.array_equal(jump, further := jump[jump]):
        jump = further
    return jump


def reached(offsets: np.ndarray, following: np.ndarray, entry: int) -> np.ndarray:
    """Which candidates of a block the chain from entry meets."""
    here = np.searchsorted(offsets, following)
    inside = (here < len(offsets)) & (offsets[np.minimum(here, len(offsets) - 1)] == following)
    jump = np.where(inside, here, np.arange(len(offsets)))
    met = offsets == entry
    for _ in range(len(offsets).bit_length()):
        met[jump[met]] = True
        jump = jump[jump]
    return met


_CANDIDATE = {
    "path": "string", "block": "long", "at": "long", "following": "long", "exit": "long", "type": "string", "key": "long",
    "refers_to": "long", "payload_bytes": "long", "stated": "string", "found": "string", "url": "string", "payload": "binary",
}


def candidates(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """Every place of every archive that looks like the start of a record."""

    def number(name: str) -> int | None:
        digits = name.strip("<>").removeprefix(_RECORD)
        return int(digits) if re.fullmatch(r"-?\d+", digits) else None

    def scan(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, raw = batch.column(0)[i].as_py(), inflated(batch.column(1)[i].as_py())
                for first in range(0, len(raw), BLOCK):
                    out: dict[str, list] = {name: [] for name in _CANDIDATE}
                    at = raw.find(MAGIC, first, first + BLOCK + len(MAGIC) - 1)
                    while at >= 0:
                        if (hit := successor(raw, at)) is not None:
                            end, fields, start, stop = hit
                            http = _HTTP.match(raw, start, stop)
                            body = raw[http.end() if http else start : stop]
                            revisit = fields.get("warc-type") == "revisit"
                            stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                            row = (
                                path, first // BLOCK, at, end, 0, fields.get("warc-type"), number(fields.get("warc-record-id", "")),
                                number(fields.get("warc-refers-to", "")) if revisit else None, int(http[1]) if http else len(body),
                                stated, stated if revisit else digest(body), fields.get("warc-target-uri"), body if payloads else None,
                            )
                            for name, value in zip(_CANDIDATE, row, strict=True):
                                out[name].append(value)
                        at = raw.find(MAGIC, at + 1, first + BLOCK + len(MAGIC) - 1)
                    if out["at"]:
                        following = np.array(out["following"])
                        out["exit"] = following[chained(np.array(out["at"]), following)].tolist()
                        yield _batch(out, _CANDIDATE)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select("path", "content")
    return files.mapInArrow(scan, ", ".join(f"{n} {t}" for n, t in _CANDIDATE.items()))


def read(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records below folder: page_id, payload_bytes, payload_digest,
    record_type, refers_to, url, path, at (their offset in the unpacked archive),
    and payload if asked for. Lengths and digests are those of the full payload,
    for revisits as the record states them. What only looks like a record inside
    a payload is not returned; archives of any number of blocks are followed whole.
    """
    found = written(candidates(spark, folder, payloads), "warc-candidates")
    blocks = found.agg(F.max("block")).first()[0]
    # Pointer jumping between blocks: a candidate points to where its chain leaves
    # its block; only starts and such places matter.
    jumps = found.select("path", F.col("at").alias("node"), F.col("exit").alias("to"))
    met = jumps.filter("node = 0").select("path", "node")
    if blocks:
        jumps = written(jumps.join(jumps.select("path", F.col("to").alias("node")).union(met).distinct(), ["path", "node"], "left_semi"), "warc-jumps")
        for _ in range(int(blocks).bit_length()):
            ahead = jumps.join(met, ["path", "node"], "left_semi").select("path", F.col("to").alias("node"))
            met = written(met.union(ahead).distinct(), "warc-met")
            onward = jumps.select("path", F.col("node").alias("to"), F.col("to").alias("then"))
            jumps = written(jumps.join(onward, ["path", "to"], "left").select("path", "node", F.coalesce("then", "to").alias("to")), "warc-jumps")
    # A chain enters a block once, at its smallest place there.
    entries = found.join(met.withColumnRenamed("node", "at"), ["path", "at"], "left_semi").groupBy("path", "block").agg(F.min("at").alias("entry"))

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pdf[reached(pdf["at"].to_numpy(), pdf["following"].to_numpy(), int(pdf["entry"].iloc[0]))][["path", "at"]]

    places = found.select("path", "block", "at", "following").join(entries, ["path", "block"])
    kept = places.groupBy("path", "block").applyInPandas(follow, "path string, at long")
    columns = [
        F.col("key").alias("page_id"), "payload_bytes", F.col("found").alias("payload_digest"), F.col("type").alias("record_type"),
        "refers_to", "url", "path", "at", *(["payload"] if payloads else []),
    ]
    return found.join(kept, ["path", "at"], "left_semi").select(*columns)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records of pages (page_id, url, html), written to the shared folder
    and read back; cases as in `write`."""
    folder = shared_path(pages.sparkSession, "warc")
    write(pages, folder, least_bytes)
    return read(pages.sparkSession, folder)
