"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equally many words. A source with a target of t
blocks, rounded up, has t of the slots, and its last block ends at the target. The
sources' shares lie one after the other on a ring of all slots. Slot j takes the
place j * step on it, which names its source; step is coprime to the number of
slots and as close to the golden ratio of it as makes no long stretch uneven. So
the points frac(j * golden ratio) are rounded to the ring, every place is taken
once, and any stretch of the schedule holds a source about as often as its share.
The r-th slot of a source takes the r-th block of that source's shuffled word
stream, which goes round up to `epochs` times.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

#: The fractional part of the golden ratio.
GOLDEN = 0.6180339887498949
#: Blocks have so many words at most, and a corpus so many blocks at least.
BLOCK_WORDS, LEAST_BLOCKS = 1024, 1 << 17
#: Steps near the golden ratio that are looked at.
STEPS = 64
#: Documents that one task brings into order, and slots that one task ranks.
STREAM_ROWS, SLOT_ROWS = 1 << 11, 1 << 14
#: A source table above so many rows is joined by a shuffle.
BROADCAST_SOURCES = 10_000


@dataclass
class Mix:
    """documents: one row each, with the place in its source's stream.
    schedule: slot, source number, rank. pieces: the words (first to last, from
    0, last not included) of a document that a slot takes in an epoch."""

    documents: DataFrame
    schedule: DataFrame
    pieces: DataFrame


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, epochs: int) -> list[float]:
    """Shares of total by weight; nobody gets more than epochs times its size,
    and what is cut is shared again among the others. Who is cut first has the
    smallest size for its weight, so one sorted pass finds all."""
    out, order = [0.0] * len(sizes), sorted(range(len(sizes)), key=lambda i: (sizes[i] / weights[i], i))
    # Weights of a place and all after it, added from the end.
    open_ = np.cumsum(np.array([weights[i] for i in reversed(order)], dtype=np.float64))[::-1]
    left = total
    for at, i in enumerate(order):
        if left / open_[at] * weights[i] <= epochs * sizes[i]:
            each = left / open_[at]
            for k in order[at:]:
                out[k] = float(each * weights[k])
            break
        out[i] = float(epochs * sizes[i])
        left -= epochs * sizes[i]
    return out


def golden_step(slots: int) -> int:
    """A number coprime to slots, near slots times the golden ratio: of those
    nearest the one whose ratio to slots has the smallest quotients as a continued
    fraction, for these bound how uneven a stretch of its multiples is."""

    def largest(step: int) -> int:
        a, b, out = slots, step, 0
        while b:
            out, a, b = max(out, a // b), b, a % b
        return out

    middle = round(slots * GOLDEN)
    near = sorted(range(max(1, middle - STEPS), min(slots, middle + STEPS) + 1), key=lambda m: (abs(m - middle), m))
    return min((m for m in near if gcd(m, slots) == 1), key=largest)


def _places(slot: np.ndarray, step: int, slots: int) -> np.ndarray:
    # In two parts, so that products stay within 64 bits for large slot numbers.
    high, low = slot >> 20, slot & ((1 << 20) - 1)
    return (high * ((step << 20) % slots) + low * step) % slots


def _prefix(df: DataFrame, part: str, value, keys: list[str]) -> DataFrame:
    """Sum of value over the parts of the same keys before each part."""
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(*keys, part).agg(value.alias("n"))
    return sums.select(*keys, part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def mix(docs: DataFrame, weights: Sequence[float], epochs: int = 3, seed: int = 0, doc_id: str = "doc_id", source: str = "source", size: str = "size") -> Mix:
    """The mix of docs (doc_id, source, size in words; further columns are left).

    Sources in code point order, null last, take the weights in turn. Null sizes
    count as 0; such documents are placed and never taken. Rows with the same
    id, source and size are documents of their own. Nothing but ids, sizes and
    the seed decides, so reruns agree. An empty table gives an empty mix. The
    driver holds a row per source."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("size"))
    # Sizes come from texts, which are read once.
    docs = written(docs, "mix-sizes")
    per_source = docs.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n")).collect()
    per_source.sort(key=lambda r: (r.source is None, r.source))
    sizes, rows, total = [r.s for r in per_source], sum(r.n for r in per_source), sum(r.s for r in per_source)
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], total, epochs) if total else [0.0] * len(sizes)
    block = max(1, min(BLOCK_WORDS, total // LEAST_BLOCKS))
    # Where a source's part of the mix ends, and the slots up to there.
    cuts = np.array([ceil(t) for t in wanted], dtype=np.int64)
    ends = np.cumsum(-(-cuts // block))
    slots = int(ends[-1]) if len(ends) else 0

    table = spark.createDataFrame(
        pa.table({"name": pa.array([r.source for r in per_source], pa.string()), "sid": pa.array(range(len(sizes)), pa.int32()),
                  "source_size": pa.array(sizes, pa.int64()), "target": pa.array(wanted, pa.float64()), "cut": pa.array(cuts, pa.int64())})
    )
    if len(per_source) <= BROADCAST_SOURCES:
        table = F.broadcast(table)
    placed = docs.join(table, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # The shuffled stream of each source: parts of the key range, one after the other.
    bits = max(1, (rows // STREAM_ROWS).bit_length())
    placed = placed.withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), "size")))
    placed = placed.withColumn("part", F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long"), 32 - bits))
    inside = Window.partitionBy("sid", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        placed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(_prefix(placed, "part", F.sum("size"), ["sid"]), ["sid", "part"])
        .select("doc_id", "source", "size", "sid", "source_size", "target", "cut", (F.col("before") + F.col("inside")).alias("start"))
    )
    # The schedule, and each slot's rank within its source.
    step = golden_step(slots) if slots else 0

    def named(batches):
        for batch in batches:
            sid = np.searchsorted(ends, _places(batch.column(0).to_numpy(), step, slots), "right")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sid.astype(np.int32))], names=["slot", "sid"])

    schedule = spark.range(slots).toDF("slot").mapInArrow(named, "slot long, sid int").withColumn("part", F.expr(f"slot div {SLOT_ROWS}"))
    ranked = Window.partitionBy("sid", "part").orderBy("slot")
    schedule = (
        schedule.withColumn("inside", F.row_number().over(ranked) - 1)
        .join(_prefix(schedule, "part", F.count("*"), ["sid"]), ["sid", "part"])
        .select("slot", "sid", (F.col("before") + F.col("inside")).alias("rank"))
    )
    last = F.least(F.col("first") + F.col("size"), (F.col("rank") + 1) * block, "cut")
    # Documents meet the blocks of their source's stream, epoch after epoch.
    epoch = F.sequence(F.lit(0), F.least(F.lit(epochs - 1), F.ceil(F.col("target") / F.col("source_size")).cast("int")))
    pieces = (
        placed.filter("size > 0")
        .withColumn("epoch", F.explode(epoch))
        .withColumn("first", F.col("epoch") * F.col("source_size") + F.col("start"))
        .filter("first < cut")
        .withColumn("rank", F.explode(F.sequence(F.expr(f"first div {block}"), F.expr(f"(least(first + size, cut) - 1) div {block}"))))
        .join(schedule, ["sid", "rank"])
        .select(
            "slot", "doc_id", "source", "size", "sid", "start", "epoch",
            (F.greatest("first", F.col("rank") * block) - F.col("first")).alias("from_word"),
            (last - F.col("first")).alias("to_word"),
        )
    )
    return Mix(placed.drop("cut"), schedule, pieces)


def taken_words(made: Mix) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, and sid and start,
    which tell repeated rows apart."""
    words = made.pieces.groupBy("sid", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    return (
        made.documents.filter("size > 0").join(words, ["sid", "start"], "left")
        .unionByName(made.documents.filter("size = 0").withColumn("taken", F.lit(0).cast("long")))
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "sid", "start")
    )
