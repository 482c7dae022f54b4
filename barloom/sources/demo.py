"""Bars derived from order lines: one symbol per brand, one bar per ship day."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import Bars, windowed
from ..functions.scalar import div
from .session import written

_tables: dict[tuple, Bars] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _order_key() -> Column:
    """(order, line, amount, quantity) as one number that sorts the same way.

    A struct would sort as well, but a number of fixed width lets Spark keep the
    first and last price in a hash aggregate instead of sorting all rows. Lines
    stay below 1e3, amounts below 1e8 in cents and quantities below 1e4 in
    hundredths; a larger one would overflow its digits, so it raises.
    """
    line, cents, hundredths = (
        F.rint(x).cast("long")
        for x in (F.col("l_linenumber").cast("double"), F.col("l_extendedprice") * 100, F.col("l_quantity") * 100)
    )
    fits = line.between(0, 999) & cents.between(0, 10**10 - 1) & hundredths.between(0, 10**6 - 1)
    low = F.when(fits, cents * F.lit(10**6) + hundredths).otherwise(
        F.raise_error(F.lit("value out of range for the bar key")).cast("long")
    )
    high = F.col("l_orderkey") * F.lit(1000) + line
    return high.cast("decimal(20,0)") * F.lit(Decimal(10**16)) + low.cast("decimal(20,0)")


def _trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return lines.join(parts, "l_partkey").select(
        F.col("p_brand").alias("symbol"),
        F.to_date("l_shipdate").alias("date"),
        div("l_extendedprice", "l_quantity").alias("price"),
        _order_key().alias("key"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("amount"),
    )


def ohlcv(trades: DataFrame, period: str | None = None) -> DataFrame:
    """Partial aggregates only, so a hot symbol is combined before the shuffle."""
    if period:
        trades = trades.withColumn("date", F.to_date(F.date_trunc(period, "date")))
    return trades.groupBy("symbol", "date").agg(
        F.min_by("price", "key").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "key").alias("close"),
        F.sum("quantity").alias("volume"),
        F.sum("amount").alias("value"),
    )


def load_bars(spark: SparkSession, sf_dir: str, period: str | None = None) -> Bars:
    """The bar table of a data folder, built and measured once per session.

    It is written in date order, so a date range reads few files and row groups.
    """
    key = (spark.sparkContext.applicationId, sf_dir, period)
    if key not in _tables:
        bars = ohlcv(_trades(spark, sf_dir), period)
        ordered = bars.repartitionByRange("date").sortWithinPartitions("date", "symbol")
        _tables[key] = Bars.measure(written(ordered, f"bars-{period or 'day'}"))
    return _tables[key]


def with_daily_change(bars: Bars) -> Bars:
    """Add the vendor columns gain, change, range and turnOver."""
    totals = bars.df.groupBy("symbol").agg(F.sum("volume").alias("_total"))

    def build(df: DataFrame, w) -> DataFrame:
        prev = F.lag("close", 1).over(w)
        return df.withColumns(
            {
                "change": F.col("close") - prev,
                "gain": (div("close", prev) - 1) * 100.0,
                "range": div(F.col("high") - F.col("low"), prev) * 100.0,
            }
        )

    df = windowed(bars, 1, 0, build)
    df = df.join(totals, "symbol").withColumn("turnOver", div("volume", "_total")).drop("_total")
    return bars.with_df(df)


def ship_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All bar dates: one column of the bar table."""
    return load_bars(spark, sf_dir).df.select("date").distinct()


def weekly(spark: SparkSession, sf_dir: str) -> Bars:
    return load_bars(spark, sf_dir, period="week")
