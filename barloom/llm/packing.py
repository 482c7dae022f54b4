"""Packing of tokenised documents into sequences, mixed by source.

Every source is a queue of tokens. A clock says how many tokens of each queue are
due after any number of packed ones: queues are served in proportion to their
weights, and one that runs dry leaves its share to the others. What is due and not
yet packed is a queue's deficit. Deficit round robin: the queue whose deficit
turned positive first has its turn, of a quantum of tokens or of its deficit if
that is more; then its deficit has to grow again. A window's end interrupts a turn,
deficits go on into the next window.

The tokens are packed in chunks of equally many, side by side. The clock gives
each chunk the stretch of every queue, and the fraction of a token that the chunks
before it left due; sequences run on across chunks.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import on_workers, slices, written

#: Tokens of a sequence, of a turn, and of a chunk.
WINDOW, QUANTUM, CHUNK_TOKENS = 2048, 128, 1 << 19
#: The id that ends a document.
END = 1
#: A table of queues and input splits above so many rows is joined by a shuffle.
BROADCAST_ROWS = 100_000
#: Longer texts are encoded in parts, cut where the pattern always cuts.
LONG_TEXT = 1 << 20
_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


class Tokens:
    """Encodes by the ranks of a vocabulary; ids are little-endian unsigned
    integers of `width` bytes."""

    def __init__(self, ranks: Mapping[bytes, int], pattern: str, end: int = END):
        self.ranks, self.pattern, self.end = dict(ranks), pattern, end
        self.width = 2 if max(max(self.ranks.values(), default=0), end) < 1 << 16 else 4
        self._encoding = None

    def __getstate__(self):
        return {**self.__dict__, "_encoding": None}

    def ids(self, text: str | None) -> bytes:
        """The ids of the whole text, and the end."""
        import tiktoken

        if self._encoding is None:
            self._encoding = tiktoken.Encoding("packing", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})
        kind = f"<u{self.width}"
        parts = [np.array(self._encoding.encode_ordinary(part), kind).tobytes() for part in _parts(text or "")]
        return b"".join([*parts, np.array([self.end], kind).tobytes()])


def _parts(text: str) -> Iterator[str]:
    first = 0
    while len(text) - first > LONG_TEXT:
        cut = _CUT.search(text, first + LONG_TEXT)
        if cut is None:
            break
        yield text[first : cut.start()]
        first = cut.start()
    yield text[first:]


def _queued(docs: DataFrame, tokens: Tokens) -> DataFrame:
    """doc_id, queue, ids, n, pid, inside: each row's tokens, its input split and
    the tokens of its queue before it in that split. The order of a queue is that
    of the splits; no row moves for it."""
    spark, held, width = docs.sparkSession, on_workers(docs.sparkSession, tokens), tokens.width
    schema = docs.select("doc_id", "queue").withColumns({"ids": F.lit(b""), "n": F.lit(0).cast("long"), "pid": F.lit(0).cast("long"), "inside": F.lit(0).cast("long")}).schema

    def work(batches):
        pid, before = TaskContext.get().partitionId(), {}
        for batch in slices(batches, 256):
            ids = [held().ids(t) for t in batch.column(2).to_pylist()]
            n = [len(x) // width for x in ids]
            inside = []
            for queue, m in zip(batch.column(1).to_pylist(), n, strict=True):
                inside.append(before.get(queue, 0))
                before[queue] = inside[-1] + m
            columns = [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array([pid] * len(n), pa.int64()), pa.array(inside, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "queue", "ids", "n", "pid", "inside"])

    rows = written(docs.select("doc_id", "queue", "text").mapInArrow(work, schema), "packing-tokens")
    splits = rows.groupBy("queue", "pid").agg(F.sum("n").alias("tokens"))
    along = Window.partitionBy("queue").orderBy("pid")
    splits = splits.select(
        F.col("queue").alias("q"), F.col("pid").alias("s"), (F.sum("tokens").over(along) - F.col("tokens")).alias("before"),
        F.sum("tokens").over(Window.partitionBy("queue")).alias("total"),
    )
    splits = written(splits, "packing-queues")
    small = splits.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(splits) if small else splits, F.col("queue").eqNullSafe(F.col("q")) & (F.col("pid") == F.col("s")))
    return rows.select("doc_id", "queue", "ids", "n", (F.col("before") + F.col("inside")).alias("start"), "total")


def clock(totals: Mapping[str | None, int], weights: Mapping[str | None, float]) -> list[tuple[float, float]]:
    """Points (time, tokens served) of the piecewise linear clock: in a unit of
    time a queue is served its weight until it has run dry."""
    ends = sorted((totals[q] / weights[q], weights[q]) for q in totals if totals[q])
    rate, time, served, points = sum(w for _, w in ends), 0.0, 0.0, [(0.0, 0.0)]
    for end, weight in ends:
        served += rate * (end - time)
        rate, time = rate - weight, end
        points.append((time, served))
    return points


def _along(x: Column, points: list) -> Column:
    """The piecewise linear function through the points, flat beyond them."""
    out = F.lit(float(points[-1][1]))
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        if x1 > x0:
            out = F.when(x < x1, F.lit(float(y0)) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def pack(
    docs: DataFrame,
    tokens: Tokens,
    weights: Mapping[str | None, float] | None = None,
    window: int = WINDOW,
    quantum: int = QUANTUM,
    chunk_tokens: int = CHUNK_TOKENS,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """The pieces: doc_id, source, start, length, ids, doc_tokens, sequence_id, offset.

    Every document's ids and the end id lie in one piece each. Sequences hold
    `window` tokens, only the last may hold fewer. Without weights every source is
    due its share of all tokens, so all run out together. Weights name the sources
    to be queues; all others together are one (source null), with the weight of
    None or 1. At every window's end each queue has been packed what it is due up to
    a few quanta.

    Null texts are empty and have the end id alone; a null source is a queue like
    others. Repeated rows are documents of their own. Texts of any length are read
    whole. Further columns are left; an empty table gives no pieces. Queues have
    the order of the input splits, so another split of the input packs otherwise."""
    queue = F.col(f"`{source}`").cast("string")
    if weights is not None:
        queue = F.when(queue.isin([w for w in weights if w is not None]), queue)
    rows = _queued(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), queue.alias("queue"), F.col(f"`{text}`").cast("string").alias("text")), tokens)
    out = "doc_id {}, source string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long".format(rows.schema["doc_id"].dataType.simpleString())
    total = rows.agg(F.sum("n")).first()[0]
    if not total:
        return rows.sparkSession.createDataFrame([], out)
    if weights is None:
        # In the unit of time all tokens, and all of each queue.
        points, weight = [(0.0, 0.0), (1.0, float(total))], F.col("total").cast("double")
    else:
        totals = {r.queue: r.total for r in rows.select("queue", "total").distinct().collect()}
        per_queue = {q: float(weights.get(q, 1.0)) for q in totals}
        points, weight = clock(totals, per_queue), F.lit(per_queue.get(None, 1.0))
        for q, w in per_queue.items():
            weight = weight if q is None else F.when(F.col("queue") == q, F.lit(w)).otherwise(weight)
    # Chunks by time; none holds a point where the shares change.
    numbers = [0]
    for (_, before), (_, after) in zip(points, points[1:], strict=False):
        numbers.append(numbers[-1] + math.ceil((after - before) / chunk_tokens))
    chunks, times = numbers[-1], [x for x, _ in points]

    def due(chunk: Column) -> Column:
        """Tokens of the row's queue that are due when the chunk begins."""
        time = _along(chunk, list(zip(numbers, times, strict=True)))
        return F.when(chunk >= chunks, F.col("total").cast("double")).otherwise(F.least(F.col("total").cast("double"), F.col("weight") * time))

    def near(position: Column) -> Column:
        return _along(position / F.col("weight"), list(zip(times, numbers, strict=True)))

    rows = rows.withColumn("weight", weight)
    end = F.col("start") + F.col("n")
    first = F.greatest(F.lit(0), F.floor(near(F.col("start") - 1)) - 1).cast("long")
    last = F.least(F.lit(chunks - 1), F.floor(near(end + 1)) + 1).cast("long")
    rows = rows.withColumn("chunk", F.explode(F.sequence(first, F.greatest(first, last))))
    rows = rows.withColumns({"due": due(F.col("chunk")), "due_next": due(F.col("chunk") + 1)})
    rows = rows.withColumns({"low": F.round("due").cast("long"), "high": F.round("due_next").cast("long")})
    rows = rows.withColumns({"from": F.greatest("start", "low"), "to": F.least(end, "high")}).filter("`to` > `from`")
    # Where each chunk begins: narrow columns only, one row a chunk. Two windows,
    # so that no task orders all chunks.
    sizes = rows.groupBy("chunk").agg(F.sum(F.col("to") - F.col("from")).alias("tokens")).withColumn("block", F.expr("chunk div 4096"))
    inside = F.sum("tokens").over(Window.partitionBy("block").orderBy("chunk")) - F.col("tokens")
    blocks = sizes.groupBy("block").agg(F.sum("tokens").alias("m")).withColumn("at", F.sum("m").over(Window.orderBy("block")) - F.col("m"))
    begins = sizes.select("chunk", "block", inside.alias("inside")).join(F.broadcast(blocks), "block").select("chunk", (F.col("at") + F.col("inside")).alias("begin"))
    width = tokens.width
    part = F.substring(F.col("ids"), ((F.col("from") - F.col("start")) * width + 1).cast("int"), ((F.col("to") - F.col("from")) * width).cast("int"))
    parts = rows.select(
        "chunk", "queue", "from", F.col("due").alias("due") - F.col("low"), (F.col("due_next") - F.col("due")).alias("gain"),
        "doc_id", (F.col("from") - F.col("start")).alias("start"), F.col("n").alias("doc_tokens"), part.alias("ids"),
    ).toDF("chunk", "queue", "from", "deficit", "gain", "doc_id", "start", "doc_tokens", "ids")
    parts = parts.join(F.broadcast(begins) if chunks <= BROADCAST_ROWS else begins, "chunk")

    def work(table: pa.Table) -> pa.Table:
        return _packed(table, width, window, quantum)

    return parts.groupBy("chunk").applyInArrow(work, out)


def turns(queues: list[tuple[int, float, float]], room: int, window: int, quantum: int) -> Iterator[tuple[int, int]]:
    """(queue, tokens) by deficit round robin until all is served. Queues are
    (tokens, deficit, gain): gain is what falls due while all tokens are served;
    room is what the first window still holds."""
    whole = sum(g for _, _, g in queues) or 1.0
    left = [t for t, _, _ in queues]
    # When the queue's deficit turns positive: a time in tokens served.
    ready = [(-d * whole / g if g > 0 else math.inf, i) for i, (t, d, g) in enumerate(queues) if t]
    heapq.heapify(ready)
    served, done = 0, [0] * len(queues)
    while ready:
        _, i = ready[0]
        tokens, deficit, gain = queues[i]
        owed = deficit + gain * served / whole - done[i]
        take = min(left[i], room, max(quantum, math.ceil(owed)))
        yield i, take
        left[i] -= take
        done[i] += take
        served += take
        room = room - take or window
        if left[i]:
            heapq.heapreplace(ready, ((done[i] - deficit) * whole / gain if gain > 0 else math.inf, i))
        else:
            heapq.heappop(ready)


def _packed(table: pa.Table, width: int, window: int, quantum: int) -> pa.Table:
    """The pieces of one chunk."""
    begin = table.column("begin")[0].as_py()
    names, sources = table.column("queue").to_pylist(), {}
    for i, (name, at) in enumerate(zip(names, table.column("from").to_pylist(), strict=True)):
        sources.setdefault(name, []).append((at, i))
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    rows = [[i for _, i in sorted(sources[s])] for s in order]
    ids = [np.frombuffer(x, f"<u{width}").astype("<u4").tobytes() for x in table.column("ids").to_pylist()]
    starts, deficit, gain = (table.column(c).to_pylist() for c in ("start", "deficit", "gain"))
    queues = [(sum(len(ids[i]) // 4 for i in r), deficit[r[0]], gain[r[0]]) for r in rows]
    heads = [[0, 0] for _ in rows]
    picked: list[int] = []
    start: list[int] = []
    place: list[int] = []
    content: list[bytes] = []
    at = begin
    for q, tokens in turns(queues, window - begin % window, window, quantum):
        head = heads[q]
        while tokens:
            i = rows[q][head[0]]
            whole, used = len(ids[i]) // 4, head[1]
            take = min(tokens, whole - used)
            picked.append(i)
            start.append(starts[i] + used)
            place.append(at)
            content.append(ids[i][4 * used : 4 * (used + take)])
            at += take
            tokens -= take
            head[1] += take
            if head[1] == whole:
                head[0], head[1] = head[0] + 1, 0
    picks, places = pa.array(picked, pa.int64()), np.array(place, np.int64)
    return pa.table(
        {
            "doc_id": table.column("doc_id").take(picks),
            "source": table.column("queue").take(picks).cast(pa.string()),
            "start": pa.array(start, pa.int64()),
            "length": pa.array([len(c) // 4 for c in content], pa.int64()),
            "ids": pa.array(content, pa.binary()),
            "doc_tokens": table.column("doc_tokens").take(picks),
            "sequence_id": pa.array(places // window),
            "offset": pa.array(places % window),
        }
    )
