"""Bars from a tick stream, late corrections, and signals on new bars."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.factor import Factor, with_factors
from ..functions.frames import Bars
from ..functions.scalar import c
from ..operators.corrstore import UNBOUNDED, reach
from ..sources.store import BarStore

BAR_COLUMNS = ("open", "high", "low", "close", "volume", "value")


def ticks_from_events(events: DataFrame) -> DataFrame:
    """(tick_id, ts, symbol, price): events with a positive value."""
    return events.filter(F.col("value") > 0).select(
        F.col("event_id").alias("tick_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").cast("string").alias("symbol"),
        F.col("value").alias("price"),
    )


def bars_from_ticks(ticks: DataFrame, width: str = "1 day", lateness: str | None = "1 day", time: str = "start") -> DataFrame:
    """Tumbling-window bars; `time` names the column of the window's start. The
    same plan serves streams (with a watermark, append mode) and batch tables."""
    if ticks.isStreaming and lateness:
        ticks = ticks.withWatermark("ts", lateness)
    order = F.struct("ts", "tick_id")
    bars = ticks.groupBy(F.window("ts", width).alias("w"), "symbol").agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.count(F.lit(1)).cast("double").alias("volume"),
        F.sum("price").alias("value"),
    )
    return bars.select("symbol", F.col("w.start").alias(time), *BAR_COLUMNS)


def write_closed_bars(bars: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append the bars whose window the watermark has closed to a folder, each
    once, until the input is used up. Later stages read it as a stream: Spark runs
    no keyed Python state behind an aggregation of the same query. The bars of a
    symbol that close together share a file, so readers that take few files at once
    still meet them in order."""
    query = bars.repartition("symbol").writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def read_closed_bars(spark: SparkSession, folder: str, time: str = "start", files_per_batch: int | None = None) -> DataFrame:
    """The folder of closed bars as a stream."""
    numbers = [T.StructField(n, T.DoubleType()) for n in BAR_COLUMNS]
    schema = T.StructType([T.StructField("symbol", T.StringType()), T.StructField(time, T.TimestampType()), *numbers])
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def dedupe_ticks(ticks: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Each tick once, also when it is delivered again within the lateness."""
    if ticks.isStreaming:
        return ticks.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["tick_id"])
    return ticks.dropDuplicates(["tick_id"])


def upsert_sink(
    spark: SparkSession, path: str, keys: Sequence[str] = ("symbol", "start")
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function that merges each batch into a bar store: a batch
    rewrites the date partitions it touches, and counts once however often it is
    delivered. keys: what identifies a row; those of `bars_from_ticks` by default.
    """
    store = BarStore(spark, path, tuple(keys))

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.upsert(batch, batch_id)

    return merge


def read_version(spark: SparkSession, path: str, before: int | None = None, keys: Sequence[str] = ("symbol", "start")) -> DataFrame | None:
    """Latest version of the stored table, or the one written before a batch."""
    store = BarStore(spark, path, tuple(keys))
    known = store.versions(before)
    return store.read(known[-1]) if known else None


def signal_sink(
    spark: SparkSession, history: str, factor: Factor, emit: Callable[[DataFrame, int], None],
    keys: Sequence[str] = ("symbol", "start"),
) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the latest factor value of the symbols a batch
    touched, computed from the stored bars plus the batch. For factors that see
    every earlier bar and for batches that correct the past; `signal_stream` keeps
    only what a bounded factor needs."""
    merge = upsert_sink(spark, history, keys)

    def run(batch: DataFrame, batch_id: int) -> None:
        merge(batch, batch_id)
        touched = batch.select("symbol").distinct()
        bars = read_version(spark, history, batch_id + 1, keys).join(touched, "symbol", "left_semi")
        emit(latest_signal(Bars.measure(bars.withColumnRenamed(keys[-1], "date")), factor), batch_id)

    return run


def latest_signal(bars: Bars, factor: Factor) -> DataFrame:
    """(symbol, date, signal) of each symbol's last bar."""
    computed = with_factors(bars, [factor]).df
    last = F.max_by(F.struct("date", c(factor.name).alias("signal")), "date")
    return computed.groupBy("symbol").agg(last.alias("x")).select("symbol", "x.*")


def with_history(bars: DataFrame, rows: int, expiry: str | None = None, time: str = "start") -> DataFrame:
    """A stream of closed bars, each batch of a symbol led by the `rows` bars before it.

    Output: symbol, the time, the bar columns and is_new, false for the bars that
    are repeated from the state. The state of a symbol is its last `rows` bars and
    nothing else. A bar that is not later than the last known one corrects the
    state if it is still there, and is not new. With an expiry a symbol's state goes
    when the newest bar of all is so much later than its last one; bars that are
    older than that are late and left out."""
    numbers = [T.StructField(n, T.DoubleType()) for n in BAR_COLUMNS]
    out = T.StructType([T.StructField("symbol", T.StringType()), T.StructField(time, T.TimestampType()), *numbers, T.StructField("is_new", T.BooleanType())])
    state = T.StructType([T.StructField("times", T.ArrayType(T.LongType())), *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in BAR_COLUMNS]])
    names, keep, expires = list(BAR_COLUMNS), rows, expiry is not None

    def step(key, frames, held):
        if held.hasTimedOut:
            held.remove()
            return
        # Plain values: a symbol has few bars, and a frame costs more than they do.
        rows: dict[int, tuple] = {}
        for f in frames:
            times = f[time].to_numpy().astype("datetime64[us]").astype("int64").tolist()
            rows.update(zip(times, zip(*[f[n].tolist() for n in names]), strict=True))
        new = set(rows)
        if held.exists:
            times, *columns = held.get
            known = dict(zip(times, zip(*columns), strict=True))
            last = max(known)
            new = {t for t in new if t > last}
            # Of the earlier bars only those count that the state still holds.
            rows = known | {t: r for t, r in rows.items() if t in known or t in new}
        order = sorted(rows)
        values = np.array([rows[t] for t in order], dtype=float)
        held.update((order[-keep:], *values[-keep:].T.tolist()))
        if expires:
            held.setTimeoutTimestamp(max(order[-1] // 1000, held.getCurrentWatermarkMs()) + 1)
        if new:
            at = np.array(order, dtype="datetime64[us]").astype("datetime64[ns]")
            yield pd.DataFrame({"symbol": key[0], time: at, **dict(zip(names, values.T, strict=True)), "is_new": [t in new for t in order]})

    if expires:
        bars = bars.withWatermark(time, expiry)
    timeout = "EventTimeTimeout" if expires else "NoTimeout"
    return bars.groupBy("symbol").applyInPandasWithState(step, out, state, "append", timeout)


def signal_stream(bars: DataFrame, factor: Factor, expiry: str | None = None, time: str = "start") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The stream of closed bars with the history the factor needs, and the
    function that turns a batch of it into (symbol, date, signal) of its new bars.

    Only factors of bounded reach: others have no last `reach` bars to keep; they
    raise here and take `signal_sink`."""
    rows = reach(factor)
    if rows == UNBOUNDED:
        raise ValueError(f"{factor.name} sees every earlier bar; use signal_sink")

    def signals(batch: DataFrame) -> DataFrame:
        computed = with_factors(Bars.measure(batch.withColumnRenamed(time, "date")), [factor]).df
        return computed.filter("is_new").select("symbol", "date", c(factor.name).alias("signal"))

    return with_history(bars, max(rows, 1), expiry, time), signals


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process what is available, then stop; state lives in the checkpoint."""
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(sink)
        .start()
    )
    query.awaitTermination()
    return query
