"""Helpers the operators share: tables in the shared folder, columns, seeds."""

from __future__ import annotations

import ctypes
import gc
import pickle
import uuid
import weakref
from contextlib import contextmanager

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; a session
    without that setting uses its warehouse, which executors share as well."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir") + "/barloom-work"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, computed once and read from a Parquet table that outlives
    the executors which made it."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def chosen(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further ones cannot clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def held_out(doc_id: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id as text, modulo 3, is 1.
    A null id has no checksum; it is never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_below(df: DataFrame, key, rows: int, total: int, seed: str):
    """A condition true for about `rows` of `total` rows, decided by the key's
    hash alone: the same rows in every run and on every cluster."""
    if total <= rows:
        return F.lit(True)
    limit = int((rows / total) * 2**32)
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2**32)) < limit


def release(spark: SparkSession) -> None:
    """Delete shuffle files nobody needs any more. Spark does so once the driver's
    JVM has collected what refers to them; after a step with large ones that is
    better done now than when memory runs short."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def tidy(work):
    """The task function, which hands its memory back to the system when it ends:
    workers live on, and what they once needed would count against the executor.
    It does so before it begins as well, when Spark has just taken the objects of
    earlier steps from the worker."""

    def trim():
        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    def run(batches):
        trim()
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def slices(batches, rows: int = 1024):
    """Arrow batches in pieces of so many rows: of what a worker receives at once,
    it unpacks a part at a time."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def with_text(df: DataFrame, rest: list[str], text: str) -> tuple[DataFrame, int]:
    """The columns of rest, the text among them or behind them, and its place."""
    columns = [F.col(f"`{c}`") for c in rest]
    if text in rest:
        return df.select(*columns), rest.index(text)
    return df.select(*columns, F.col(f"`{text}`").alias("_text")), len(rest)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Jobs started inside hand Python workers so many rows at a time, at most:
    for rows of several texts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


_broadcasts: weakref.WeakSet = weakref.WeakSet()


def relieve() -> None:
    """Take the objects of earlier steps from the executors; who still needs one
    fetches it again."""
    for held in list(_broadcasts):
        held.unpersist()


def on_workers(spark: SparkSession, made: object):
    """A function that gives the object inside tasks. It is broadcast with its
    class, so workers need not have this package, and a worker keeps it, and what
    it has memorised, from task to task. For objects of bounded size."""
    held = spark.sparkContext.broadcast({"pickled": cloudpickle.dumps(made)})
    _broadcasts.add(held)

    def get():
        value = held.value
        if "object" not in value:
            value["object"] = pickle.loads(value.pop("pickled"))
        return value["object"]

    return get
