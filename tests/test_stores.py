"""Stores that are brought up to date in parts: bars, correlations, stream state."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.factor import with_factors
from barloom.functions.frames import Bars
from barloom.functions.library import make
from barloom.operators import corrstore
from barloom.operators.crosscorr import pair_correlations
from barloom.sources.demo import table
from barloom.sources.store import BarStore
from barloom.streaming import bars as ST
from fixtures import bar_frame, to_bars

SF = "/root/testdata/sf0.001"
RECIPES = {
    "mom": {"factor": "PriceReturn", "params": {"window": 20}},
    "vol": {"factor": "Volatility"},
    "rsi": {"factor": "RSI"},
}
OPTIONS = {"interval": 3, "min_assets": 3}


def full_run(bars, recipes):
    made = {n: corrstore.from_recipe(r) for n, r in recipes.items()}
    computed = with_factors(bars, list({f.name: f for f in made.values()}.values()))
    columns = [F.col(f"`{f.name}`").alias(n) for n, f in made.items()]
    rows = computed.with_df(computed.df.select("symbol", "date", *columns))
    return pair_correlations(rows, list(recipes), 3, 3)


def frame(df):
    return df.toPandas().sort_values(["a", "b"], ignore_index=True)[["a", "b", "mean_corr", "std_corr", "n_dates"]]


def months(update):
    rows = update.computed.collect()
    return {(r.a, r.b) for r in rows}, {r.month for r in rows}


def test_correlation_store(spark, tmp_path):
    path = str(tmp_path / "store")
    pdf = bar_frame(symbols=7, rows=260)
    cut = dt.date(2020, 9, 1)
    early = to_bars(spark, pdf[pdf.date < cut])
    bars = to_bars(spark, pdf)
    first = corrstore.update(early, RECIPES, path, **OPTIONS)
    pd.testing.assert_frame_equal(frame(first.pairs), frame(full_run(early, RECIPES)))
    assert len(months(first)[0]) == 3

    # The same again computes nothing, under other names and in another order too.
    again = corrstore.update(early, {"x": RECIPES["rsi"], "y": RECIPES["mom"]}, path, **OPTIONS)
    assert again.computed.isEmpty()
    assert frame(again.pairs).n_dates[0] == frame(first.pairs).set_index(["a", "b"]).loc[("mom", "rsi")].n_dates

    # New bars: only their months, but the month they begin in is complete in both.
    grown = corrstore.update(bars, RECIPES, path, **OPTIONS)
    assert min(months(grown)[1]) == cut
    pd.testing.assert_frame_equal(frame(grown.pairs), frame(full_run(bars, RECIPES)))

    # Another parameter under the same name: only this factor's pairs.
    changed = {**RECIPES, "mom": {"factor": "PriceReturn", "params": {"window": 5}}}
    update = corrstore.update(bars, changed, path, **OPTIONS)
    assert months(update)[0] == {("mom", "vol"), ("mom", "rsi")}
    pd.testing.assert_frame_equal(frame(update.pairs), frame(full_run(bars, changed)))
    assert corrstore.update(bars, RECIPES, path, **OPTIONS).computed.isEmpty()
    assert not corrstore.update(bars, RECIPES, path, interval=3, min_assets=4).computed.isEmpty()


def test_corrected_bars_renew_what_looks_at_them(spark, tmp_path):
    path = str(tmp_path / "store")
    pdf = bar_frame(symbols=6, rows=260)
    corrstore.update(to_bars(spark, pdf), RECIPES, path, **OPTIONS)
    wrong = (pdf.symbol == "S3") & (pdf.date >= dt.date(2020, 6, 1)) & (pdf.date < dt.date(2020, 7, 1))
    pdf.loc[wrong, "close"] *= 1.2
    bars = to_bars(spark, pdf)
    update = corrstore.update(bars, RECIPES, path, **OPTIONS)
    rows = {(r.a, r.b): set() for r in update.computed.collect()}
    for r in update.computed.collect():
        rows[r.a, r.b].add(r.month)
    # Windows of 20 bars reach into July, perhaps August; RSI sees all bars before.
    assert dt.date(2020, 6, 1) in rows["mom", "vol"] and dt.date(2020, 7, 1) in rows["mom", "vol"]
    assert max(rows["mom", "vol"]) <= dt.date(2020, 8, 1) and min(rows["mom", "vol"]) == dt.date(2020, 6, 1)
    assert max(rows["mom", "rsi"]) > dt.date(2020, 10, 1) and min(rows["mom", "rsi"]) == dt.date(2020, 6, 1)
    pd.testing.assert_frame_equal(frame(update.pairs), frame(full_run(bars, RECIPES)))
    assert corrstore.update(bars, RECIPES, path, **OPTIONS).computed.isEmpty()


def test_reach_of_factors():
    assert corrstore.reach(make("PriceReturn", window=20)) == 20
    assert corrstore.reach(make("OBV")) == corrstore.UNBOUNDED or corrstore.reach(make("OBV")) > 0
    assert corrstore.reach(make("RSI")) == corrstore.UNBOUNDED


def files(folder):
    return {p: p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_untouched_partitions_keep_their_files(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"))
    assert store.read() is None and store.versions() == []
    pdf = bar_frame(symbols=3, rows=120)
    days = spark.createDataFrame(pdf)
    assert store.upsert(days) == 0
    before, folders = files(tmp_path / "store" / "data"), store.folders()
    march = days.filter(F.month("date") == 3).select("symbol", "date", (F.col("close") + 1).alias("close"), F.lit("x").alias("note"))
    assert store.upsert(march.unionByName(march)) == 1
    after = files(tmp_path / "store" / "data")
    assert all(after[p] == t for p, t in before.items())
    changed = {p for p in folders if folders[p] != store.folders()[p]}
    assert len(changed) == 1 and all("v=0000000001" in store.folders()[p] for p in changed)

    got = store.read().toPandas().sort_values(["symbol", "date"], ignore_index=True)
    want = pdf.copy()
    in_march = pd.to_datetime(want.date).dt.month == 3
    want.loc[in_march, "close"] += 1
    want["note"] = None
    want.loc[in_march, "note"] = "x"
    want = want.sort_values(["symbol", "date"], ignore_index=True)
    pd.testing.assert_frame_equal(got[pdf.columns.tolist()], want[pdf.columns.tolist()])
    assert got.note.notna().equals(want.note.notna())

    # An earlier version is still there; a bounded read lists few partitions.
    assert store.read(0).count() == len(pdf) and "note" not in store.read(0).columns
    some = store.read(start=dt.date(2020, 3, 5), end=dt.date(2020, 4, 2))
    assert some.count() == ((want.date >= dt.date(2020, 3, 5)) & (want.date <= dt.date(2020, 4, 2))).sum()
    assert {f.split("__part=")[1][:8] for f in some.inputFiles()} == {"20200301", "20200401"}


def test_a_batch_counts_once_and_only_when_committed(spark, tmp_path):
    store = BarStore(spark, str(tmp_path / "store"), ("symbol", "start"), "day")
    row = lambda v: spark.createDataFrame([("a", dt.datetime(2020, 1, 1), v), ("a", None, 9.0)], "symbol string, start timestamp, close double")
    store.upsert(row(1.0), 3)
    store.upsert(row(2.0), 3)
    assert [r.close for r in store.read().collect()] == [1.0]
    (tmp_path / "store" / "manifest" / "v=0000000004").mkdir()
    assert store.versions() == [3]
    store.upsert(row(None), 5)
    store.upsert(row(4.0), 6)
    assert [r.close for r in store.read().collect()] == [4.0] and store.read(5).first().close == 1.0


def by_days(spark, folder, events, per_file=4):
    days = [r.d for r in events.select(F.to_date("ts").alias("d")).distinct().orderBy("d").collect()]
    for i in range(0, len(days), per_file):
        events.filter(F.to_date("ts").isin(days[i : i + per_file])).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_signals_of_closed_bars(spark, tmp_path):
    """Ticks to bars to signals in many small batches equal the batch form."""
    events, factor = table(spark, SF, "events"), make("PriceReturn", window=3)
    stream = ST.ticks_from_events(by_days(spark, str(tmp_path / "in"), events))
    ST.write_closed_bars(ST.bars_from_ticks(stream), str(tmp_path / "bars"), str(tmp_path / "cp1"))
    closed = ST.read_closed_bars(spark, str(tmp_path / "bars"), files_per_batch=6)
    found, signals = ST.signal_stream(closed, factor, expiry="90 days")
    seen = []
    ST.run_to_end(found, lambda df, i: seen.append(signals(df).toPandas()), str(tmp_path / "cp2"))
    got = pd.concat(x for x in seen if len(x)).sort_values(["symbol", "date"], ignore_index=True)
    assert sum(len(x) > 0 for x in seen) > 2

    ticks = ST.ticks_from_events(events)
    last = ticks.agg(F.max("ts")).first()[0] - dt.timedelta(days=1)
    bars = ST.bars_from_ticks(ticks, time="date").filter(F.expr("date + interval 1 day") <= F.lit(last))
    want = with_factors(Bars.measure(bars), [factor]).df.select("symbol", "date", F.col(factor.name).alias("signal"))
    pd.testing.assert_frame_equal(got, want.toPandas().sort_values(["symbol", "date"], ignore_index=True))


def test_state_holds_the_last_bars_and_expires(spark, tmp_path):
    start = dt.datetime(2020, 1, 1)
    rows = [("a", start + dt.timedelta(days=i), *[float(i)] * 6) for i in range(6)]
    # The fourth day again with another price, and the symbol's return after its state has gone.
    batches = [rows[:3], rows[3:5], [("a", rows[3][1], *[9.0] * 6), rows[5]], [("b", start + dt.timedelta(days=40), *[1.0] * 6)], [("c", start + dt.timedelta(days=80), *[1.0] * 6)], [("a", start + dt.timedelta(days=90), *[7.0] * 6)]]
    schema = "symbol string, start timestamp, open double, high double, low double, close double, volume double, value double"
    folder, seen = str(tmp_path / "in"), []
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = ST.with_history(ST.read_closed_bars(spark, folder, files_per_batch=1), 2, "10 days")
        ST.run_to_end(stream, lambda df, i: seen.extend((r.symbol, (r.start - start).days, r.close, r.is_new) for r in df.collect()), str(tmp_path / "cp"))
    a = [r[1:] for r in seen if r[0] == "a"]
    assert a[:3] == [(0, 0.0, True), (1, 1.0, True), (2, 2.0, True)]
    assert a[3:7] == [(1, 1.0, False), (2, 2.0, False), (3, 3.0, True), (4, 4.0, True)]
    assert a[7:10] == [(3, 9.0, False), (4, 4.0, False), (5, 5.0, True)]
    assert a[10:] == [(90, 7.0, True)]


def test_factors_without_bound_take_the_store(spark, tmp_path):
    with pytest.raises(ValueError):
        ST.signal_stream(None, make("RSI"))
    events, factor = table(spark, SF, "events"), make("RSI", window=3)
    bars = ST.bars_from_ticks(ST.ticks_from_events(events))
    out = {}
    sink = ST.signal_sink(spark, str(tmp_path / "h"), factor, lambda df, i: out.update({r.symbol: r.signal for r in df.collect()}))
    sink(bars, 0)
    want = ST.latest_signal(Bars.measure(bars.withColumnRenamed("start", "date")), factor)
    assert out == {r.symbol: r.signal for r in want.collect()}
