"""Files in, files out, merging, and the tick stream."""

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.library import make
from barloom.operators import joins
from barloom.sources import bars as B
from barloom.sources.demo import table
from barloom.streaming.bars import (
    bars_from_ticks, dedupe_ticks, read_version, run_to_end, signal_sink, ticks_from_events, upsert_sink,
)
from fixtures import bar_frame, to_bars

SF = "/root/testdata/sf0.001"


def test_csv_bars(spark, tmp_path):
    good = "date,open,high,low,close,volume,value,range,gain,change,turnOver\n2020-01-02,1,2,0.5,1.5,10,15,0,0,0,0\n2020-01-03,x,2,0.5,1.6,10,15,0,0,0,0\n"
    (tmp_path / "000001.csv").write_text(good)
    (tmp_path / "基金2.csv").write_text(good.replace("1.6", "2.6") + "2020-01-06,1,2\n")
    rows = B.read_csv_bars(spark, str(tmp_path)).orderBy("symbol", "date").collect()
    assert {r["symbol"] for r in rows} == {"000001", "基金2"}
    assert rows[1]["open"] is None and rows[1]["close"] == 1.6 and rows[0]["date"] == dt.date(2020, 1, 2)
    assert B.read_csv_bars(spark, str(tmp_path), ["000001"]).count() == 2
    assert B.normalize_bars(B.read_csv_bars(spark, str(tmp_path))).count() == 2


def test_csv_lines_that_are_no_bars(spark, tmp_path):
    head = "date,open,high,low,close,volume,value\n"
    (tmp_path / "a.csv").write_text(head + "2020-01-02,1,2,0.5,1.5,10,15\nrubbish\n2020-01-03\n,1,1,1,1,1,1\n")
    (tmp_path / "b.csv").write_text("# made by a vendor\n" + head + "2020-01-02,3,4,2,3.5,10,15\n")
    rows = {(r["symbol"], r["date"], r["close"]) for r in B.read_csv_bars(spark, str(tmp_path)).collect()}
    assert rows == {("a", dt.date(2020, 1, 2), 1.5), ("b", dt.date(2020, 1, 2), 3.5)}


def test_csv_layouts_in_one_folder(spark, tmp_path):
    """Columns in another order, vendor names, further columns and bad files."""
    (tmp_path / "a.csv").write_text("date,open,close,high,low,volume,value,turnOver,gain,change\n2020-01-02,1,1.5,2,0.5,10,15,1,2,3\n")
    (tmp_path / "b.csv").write_text("\ufeff日期,股票代码,开盘,收盘,最高,最低,成交量\n2020-01-02,b,3,4,5,2,7\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("open,date,note,close\n8,2020-01-03,fine,9\n")
    (tmp_path / "bad.csv").write_text("no header here\n1,2\n")
    (tmp_path / "empty.csv").write_text("")
    rows = {r["symbol"]: r.asDict() for r in B.read_csv_bars(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert [rows["a"][x] for x in ("open", "close", "high", "low", "turnOver")] == [1.0, 1.5, 2.0, 0.5, 1.0]
    assert [rows["b"][x] for x in ("open", "close", "high", "low", "volume", "value", "股票代码")] == [3.0, 4.0, 5.0, 2.0, 7.0, None, "b"]
    assert (rows["c"]["open"], rows["c"]["close"], rows["c"]["high"], rows["c"]["note"]) == (8.0, 9.0, None, "fine")
    assert B.read_csv_bars(spark, str(tmp_path / "bad.csv")).count() == 0


def test_dimension_reader(spark, tmp_path):
    (tmp_path / "list.csv").write_text("﻿symbol,name,enabled\n7,a,TRUE\n000008,b,no\n9,c, y \n", encoding="utf-8")
    got = B.read_dimension(spark, str(tmp_path / "list.csv"), enabled="enabled").orderBy("symbol").collect()
    assert [r["symbol"] for r in got] == ["000007", "000009"]


def test_upsert_is_combine_first(spark):
    old = pd.DataFrame({"symbol": "a", "date": pd.date_range("2020-01-01", periods=4).date, "close": [1.0, None, 3.0, 4.0], "volume": 5.0})
    new = pd.DataFrame({"symbol": "a", "date": pd.date_range("2020-01-03", periods=4).date, "close": [None, 40.0, 50.0, 60.0]})
    clean = lambda p: spark.createDataFrame(p).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    got = B.upsert(clean(old), clean(new)).toPandas().sort_values("date", ignore_index=True)
    want = new.set_index(["symbol", "date"]).combine_first(old.set_index(["symbol", "date"])).reset_index()
    pd.testing.assert_frame_equal(got[["symbol", "date", "close", "volume"]], want[["symbol", "date", "close", "volume"]], check_dtype=False)


def test_write_and_reports(spark, tmp_path):
    bars = to_bars(spark, bar_frame(symbols=3, rows=30)).df
    B.write_bars(bars, str(tmp_path / "bars"), min_rows=30)
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 90
    nested = bars.groupBy("symbol").agg(F.map_from_arrays(F.array(F.lit("n")), F.array(F.count("*"))).alias("m"))
    B.write_report(nested, str(tmp_path / "csv"), "csv")
    assert json.loads(spark.read.option("header", True).csv(str(tmp_path / "csv")).first()["m"]) == {"n": 30}
    B.write_report(nested.withColumn("x", F.lit(None).cast("double")), str(tmp_path / "json"))
    assert B.read_reports(spark, str(tmp_path / "json")).filter("x is null").count() == 3
    for group in ("g1", "g2"):
        folder = tmp_path / "logs" / group / "top5"
        folder.mkdir(parents=True)
        (folder / "log.csv").write_text("a\n1\n")
    tagged = B.read_tagged_logs(spark, str(tmp_path / "logs"), r"logs/([^/]+)/([^/]+)/", ["group", "grid"])
    assert {(r["group"], r["grid"]) for r in tagged.collect()} == {("g1", "top5"), ("g2", "top5")}


def test_keep_last_and_vendor(spark):
    df = spark.createDataFrame([("a", "2020-01-01", 1, 1.0), ("a", "2020-01-01", 2, 2.0)], "symbol string, date string, seq int, close double")
    assert B.keep_last(df, [F.col("seq")]).first()["close"] == 2.0
    raw = spark.createDataFrame([("a", "2020-01-01", "12", "bad")], "symbol string, `日期` string, `成交量` string, `成交额` string")
    row = B.vendor_units(B.rename_vendor(raw)).first()
    assert row["volume"] == 120000.0 and row["value"] is None and row["close"] is None


def test_predicate_errors_are_recorded(spark):
    bars = to_bars(spark, bar_frame(symbols=3, rows=10))

    def rule(pdf):
        if pdf["symbol"].iloc[0] == "S1":
            raise KeyError("no data")
        return pdf["symbol"].iloc[0] == "S2"

    got = {r["symbol"]: (r["keep"], r["error"]) for r in joins.filter_symbols(bars, rule, ["close"]).collect()}
    assert got["S0"] == (False, None) and got["S2"] == (True, None) and "KeyError" in got["S1"][1]


def _replay(spark, tmp_path, ticks, files=3):
    source = tmp_path / "in"
    ticks.repartition(files).write.parquet(str(source))
    return spark.readStream.schema(ticks.schema).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_stream_equals_batch(spark, tmp_path):
    ticks = ticks_from_events(table(spark, SF, "events"))
    doubled = ticks.unionByName(ticks.filter("tick_id % 5 = 0"))
    stream = _replay(spark, tmp_path, doubled)
    store = str(tmp_path / "store")
    streamed = bars_from_ticks(dedupe_ticks(stream, "60 days"), lateness=None)
    run_to_end(streamed, upsert_sink(spark, store), str(tmp_path / "cp"), mode="update")
    got = read_version(spark, store).toPandas().sort_values(["symbol", "start"], ignore_index=True)
    want = bars_from_ticks(ticks).toPandas().sort_values(["symbol", "start"], ignore_index=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_exact=False)


def test_unfinished_versions_are_not_read(spark, tmp_path):
    store = tmp_path / "store"
    bars = bars_from_ticks(ticks_from_events(table(spark, SF, "events")))
    upsert_sink(spark, str(store))(bars, 0)
    (store / "manifest" / "v=0000000001").mkdir()
    assert read_version(spark, str(store)).count() == bars.count()


def test_append_bars_close_after_the_watermark(spark, tmp_path):
    ticks = ticks_from_events(table(spark, SF, "events"))
    stream = _replay(spark, tmp_path, ticks, files=1)
    seen = []
    run_to_end(bars_from_ticks(stream), lambda df, i: seen.extend(df.collect()), str(tmp_path / "cp"))
    every = bars_from_ticks(ticks).count()
    assert 0 < len(seen) < every


def test_signal_on_touched_symbols(spark, tmp_path):
    pdf = bar_frame(symbols=3, rows=40)
    bars = spark.createDataFrame(pdf)
    out = {}
    sink = signal_sink(spark, str(tmp_path / "h"), make("PriceReturn", window=5), lambda df, i: out.update({i: {r["symbol"]: r["signal"] for r in df.collect()}}), ("symbol", "date"))
    days = sorted(pdf.date.unique())
    sink(bars.filter(F.col("date") < F.lit(days[-2])), 0)
    sink(bars.filter((F.col("date") >= F.lit(days[-2])) & (F.col("symbol") == "S1")), 1)
    assert set(out[0]) == {"S0", "S1", "S2"} and set(out[1]) == {"S1"}
    close = pdf[pdf.symbol == "S1"].close.to_numpy()
    assert out[1]["S1"] == pytest.approx(close[-1] / close[-6] - 1)
    upsert_sink(spark, str(tmp_path / "h"))
