"""Reading, cleaning, merging and writing bar tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import c, clean

PRICES = ("open", "high", "low", "close")
NUMBERS = (*PRICES, "volume", "value", "range", "gain", "change", "turnOver")

# Vendor column names.
VENDOR_COLUMNS = {
    "日期": "date",
    "开盘": "open",
    "收盘": "close",
    "最高": "high",
    "最低": "low",
    "成交量": "volume",
    "成交额": "value",
    "振幅": "range",
    "涨跌幅": "gain",
    "涨跌额": "change",
    "换手率": "turnOver",
}


def symbol_from_path(path: str | Column | None = None) -> Column:
    """File name without folder and extension."""
    source = F.input_file_name() if path is None else c(path)
    return F.regexp_extract(F.url_decode(source), r"([^/\\]+?)(?:\.[A-Za-z]+)*$", 1)


def csv_layouts(spark: SparkSession, path: str, recursive: bool = False) -> dict[tuple[str, ...], list[str]]:
    """Files below path by the column names in their header, a line one of whose
    names is the date's. Files without such a line are left out. The driver holds
    a name per file, as Spark's own listing does."""
    names = [n for n, to in VENDOR_COLUMNS.items() if to == "date"] + ["date"]
    lines = (
        spark.read.option("recursiveFileLookup", recursive)
        .option("ignoreMissingFiles", True)
        .text(path)
        .select(F.col("_metadata.file_path").alias("file"), F.split(F.regexp_replace("value", "[\\uFEFF\\s\"]", ""), ",").alias("names"))
    )
    headers = lines.filter(F.exists("names", lambda x: F.lower(x).isin(names)))
    first = headers.groupBy("file").agg(F.min_by("names", F.array_join("names", ",")).alias("names"))
    layouts: dict[tuple[str, ...], list[str]] = {}
    for row in first.orderBy("file").toLocalIterator():
        layouts.setdefault(tuple(row.names), []).append(row.file)
    return layouts


def read_csv_bars(
    spark: SparkSession, path: str, symbols: Sequence[str] | None = None, recursive: bool = False
) -> DataFrame:
    """One CSV per symbol, one scan per layout of columns.

    Columns are matched by name in any order, vendor names too; further columns
    are kept as text. Columns a file lacks are missing; files without a header and
    files that vanish do not stop the read, lines without a date or without any
    number are left out. Text comes first: a bad number becomes missing instead of
    failing the read."""
    parts = []
    for names, files in csv_layouts(spark, path, recursive).items():
        seen: list[str] = []
        for name in names:
            name = VENDOR_COLUMNS.get(name, name) or "unnamed"
            name = "date" if name.lower() == "date" else name
            while name.lower() in (x.lower() for x in seen):
                name += "_"
            seen.append(name)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*seen, "_corrupt_record"]])
        df = (
            spark.read.schema(schema)
            .option("header", True)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .option("ignoreMissingFiles", True)
            .csv(files)
            .withColumn("symbol", symbol_from_path())
        )
        parts.append(df.filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record"))
    if not parts:
        empty = T.StructType([T.StructField(n, T.StringType()) for n in ("date", *NUMBERS, "symbol")])
        parts = [spark.createDataFrame([], empty)]
    df = parts[0]
    for part in parts[1:]:
        df = df.unionByName(part, allowMissingColumns=True)
    df = df.withColumns({n: F.lit(None).cast("string") for n in NUMBERS if n not in df.columns})
    if symbols is not None:
        df = df.filter(F.col("symbol").isin(list(symbols)))
    df = typed(df)
    # Lines that are no bars: no date, or not a single number.
    return df.filter(F.col("date").isNotNull() & F.coalesce(*[F.col(n) for n in NUMBERS]).isNotNull())


def read_parquet_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def typed(df: DataFrame) -> DataFrame:
    """Dates and doubles; what cannot be read is missing."""
    new = {"date": F.try_to_date("date") if dict(df.dtypes)["date"] == "string" else F.to_date("date")}
    for n in NUMBERS:
        if n in df.columns:
            new[n] = clean(F.expr(f"try_cast({n} AS DOUBLE)"))
    return df.withColumns(new)


def rename_vendor(df: DataFrame, names: Mapping[str, str] = VENDOR_COLUMNS) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def vendor_units(df: DataFrame, volume_unit: float = 1e4, value_unit: float = 1e8) -> DataFrame:
    """Scaled volume and value to plain units; columns not delivered are added
    as missing."""
    df = typed(df)
    new = {}
    for n in NUMBERS:
        if n not in df.columns:
            new[n] = F.lit(None).cast("double")
        elif n == "volume":
            new[n] = F.col(n) * volume_unit
        elif n == "value":
            new[n] = F.col(n) * value_unit
    return df.withColumns(new)


def normalize_bars(df: DataFrame) -> DataFrame:
    """Typed bars without rows that lack a price or the volume."""
    return typed(df).dropna(subset=["date", *PRICES, "volume"])


def normalize_price(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Positive open and close plus any factor columns."""
    keep = ["symbol", "date", "open", "close", *extra]
    return df.select(*[c(x) for x in keep]).filter((F.col("open") > 0) & (F.col("close") > 0))


def feed_frame(df: DataFrame) -> DataFrame:
    """Extra numeric columns filled with 0; columns without any value dropped.

    The one look at the data is a single row of counts.
    """
    base = {"symbol", "date", *PRICES, "volume"}
    extra = [f.name for f in df.schema.fields if f.name not in base and isinstance(f.dataType, T.NumericType)]
    if not extra:
        return df
    counts = df.agg(*[F.count(c(x)).alias(f"n{i}") for i, x in enumerate(extra)]).first()
    empty = [x for i, x in enumerate(extra) if counts[i] == 0]
    return df.drop(*empty).fillna(0.0, [x for x in extra if x not in empty])


def keep_last(df: DataFrame, order: Sequence[Column], keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """One row per key: the last in the given order.

    max_by is a partial aggregate, so copies of a hot key collapse early.
    """
    row = F.struct(*[c(x) for x in df.columns])
    rank = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)])
    return df.groupBy(*keys).agg(F.max_by(row, rank).alias("__x")).select("__x.*")


def concat_history(slices: Sequence[DataFrame]) -> DataFrame:
    """Slices stacked; of rows with the same symbol and date the later slice wins."""
    parts = [s.withColumn("__s", F.lit(i)) for i, s in enumerate(slices)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_last(out, [F.col("__s")]).drop("__s")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """New values win, their gaps are filled from the old row."""
    columns = list(dict.fromkeys([*old.columns, *new.columns]))
    rest = [x for x in columns if x not in keys]
    a = old.select(*keys, *[c(x).alias(f"o_{x}") for x in rest if x in old.columns])
    b = new.select(*keys, *[c(x).alias(f"n_{x}") for x in rest if x in new.columns])
    joined = a.join(b, list(keys), "full_outer")

    def merged(x: str) -> Column:
        sides = [F.col(p + x) for p, t in (("n_", new), ("o_", old)) if x in t.columns]
        return F.coalesce(*sides).alias(x)

    return joined.select(*keys, *[merged(x) for x in rest])


def date_slices(ranges: DataFrame, days: int) -> DataFrame:
    """(start, end) ranges cut into pieces of at most `days` days."""
    starts = F.explode(F.sequence("start", "end", F.make_dt_interval(F.lit(days)))).alias("slice_start")
    return ranges.select("*", starts).withColumn(
        "slice_end", F.least(F.date_add("slice_start", days - 1), F.col("end"))
    )


def freshness(symbols: DataFrame, bars: DataFrame, target) -> DataFrame:
    """Per listed symbol: present, last date, up to date; stale ones first."""
    last = bars.groupBy("symbol").agg(F.max("date").alias("last_date"))
    out = symbols.select("symbol").distinct().join(last, "symbol", "left")
    fresh = F.coalesce(F.col("last_date") >= F.to_date(F.lit(target)), F.lit(False))
    return out.select(
        "symbol", F.col("last_date").isNotNull().alias("exists"), "last_date", fresh.alias("is_updated")
    ).orderBy("is_updated", F.col("last_date").asc_nulls_first(), "symbol")


def newest_file_per_code(files: DataFrame) -> DataFrame:
    """Of several files for one code the one whose data ends last.

    files: (path, code, date) rows as read.
    """
    ends = files.groupBy("code", "path").agg(F.max("date").alias("last_date"))
    return ends.groupBy("code").agg(
        F.max_by(F.struct("path", "last_date"), F.struct("last_date", "path")).alias("x")
    ).select("code", "x.path", "x.last_date")


def truthy(column: str | Column) -> Column:
    return F.lower(F.trim(c(column).cast("string"))).isin("1", "true", "yes", "y")


def read_dimension(spark: SparkSession, path: str, code: str = "symbol", enabled: str | None = None) -> DataFrame:
    """A list file: text columns, byte-order mark removed, codes padded."""
    from ..operators.text import pad_code

    df = spark.read.option("header", True).csv(path)
    df = df.toDF(*[x.lstrip("﻿").strip() for x in df.columns])
    df = df.withColumn(code, pad_code(code))
    return df.filter(truthy(enabled)) if enabled else df


def write_bars(df: DataFrame, path: str, fmt: str = "parquet", min_rows: int = 0, mode: str = "overwrite") -> None:
    """Bars with factor columns, one folder per symbol."""
    if min_rows:
        kept = df.groupBy("symbol").count().filter(F.col("count") >= min_rows).select("symbol")
        df = df.join(kept, "symbol", "left_semi")
    # Clustered first: a folder gets files from few tasks, not from all, and a hot
    # symbol's history is written by a task for every few years.
    writer = df.repartition("symbol", F.floor(F.year("date") / 8)).write.mode(mode).partitionBy("symbol")
    (writer.option("header", True).csv if fmt == "csv" else writer.parquet)(path)


def write_report(df: DataFrame, path: str, fmt: str = "json", mode: str = "overwrite") -> None:
    """Report rows; for CSV, nested cells become JSON text."""
    if fmt == "json":
        df.write.mode(mode).option("ignoreNullFields", False).json(path)
        return
    flat = [
        F.to_json(c(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
        else c(f.name)
        for f in df.schema.fields
    ]
    df.select(*flat).write.mode(mode).option("header", True).csv(path)


def read_reports(spark: SparkSession, path: str, schema: T.StructType | None = None, whole_files: bool = False) -> DataFrame:
    """Reports as `write_report` leaves them, a row per line; or, with whole_files,
    files of one object over many lines each."""
    reader = spark.read.option("multiLine", whole_files).option("recursiveFileLookup", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("path", F.input_file_name())


def read_tagged_logs(spark: SparkSession, path: str, pattern: str, tags: Sequence[str]) -> DataFrame:
    """CSV logs of many run folders with tags taken from the path."""
    df = spark.read.option("header", True).option("recursiveFileLookup", True).csv(path)
    source = F.url_decode(F.input_file_name())
    return df.withColumns({t: F.regexp_extract(source, pattern, i + 1) for i, t in enumerate(tags)})
