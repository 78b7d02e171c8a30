"""Streaming forms against their batch twins, and the late-data policy."""

import tempfile
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barlume.operators import resample as rs, risk as rk
from barlume.streaming import live

SCHEMA = "event_id bigint, instrument string, ts timestamp_ntz, bid double, ask double, price double, volume bigint"


def ticks(spark, minutes, start=0):
    t0 = pd.Timestamp("2024-01-01")
    rows = [(start + i, "x", (t0 + pd.Timedelta(minutes=float(m))).to_pydatetime(), 1.0 + i, 1.1 + i, 1.05 + i, 1) for i, m in enumerate(minutes)]
    return spark.createDataFrame(rows, SCHEMA)


def test_late_ticks_are_dropped_and_counted(spark):
    src = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    ticks(spark, [1, 5, 20, 61]).coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    first = live.candles(stream(), "15 minutes")
    base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")

    def go():
        q = first.writeStream.outputMode("append").format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/ck").trigger(availableNow=True).start()
        q.awaitTermination()
        return q

    go()
    ticks(spark, [2, 62, 200], start=10).coalesce(1).write.mode("append").parquet(src)
    q = go()
    assert live.late_rows(q) == 1
    got = spark.read.parquet(f"{base}/out").orderBy("ts").collect()
    assert [r["volume"] for r in got] == [2, 1, 2]


def test_stream_candles_equal_batch(spark):
    src = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    d = ticks(spark, [1, 5, 17, 31, 44, 46, 600])
    d.write.mode("append").parquet(src)
    c = live.candles(spark.readStream.schema(SCHEMA).parquet(src), "15 minutes")
    path, _ = live.run_available(c)
    got = live.read_output(spark, path, c.schema)
    want = rs.ticks_to_bars(d, "15 minutes").where("ts < timestamp_ntz'2024-01-01 09:00:00'")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


BARS = "instrument string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint"


def hourly(spark, closes, start=0, name="x"):
    t0 = pd.Timestamp("2024-01-01")
    return spark.createDataFrame([(name, (t0 + pd.Timedelta(hours=start + i)).to_pydatetime(), c, c, c, c, 1) for i, c in enumerate(closes)], BARS)


def signals_by_rule(closes, lookback):
    """Direction changes told bar by bar; None counts as no limit."""
    out, last = [], 0
    for i in range(lookback, len(closes)):
        past = [c for c in closes[i - lookback : i] if c is not None]
        c = closes[i]
        if c is None:
            continue
        side = 1 if c > max(past, default=-np.inf) * 1.0002 else (-1 if c < min(past, default=np.inf) * 0.9998 else 0)
        if side and side != last:
            out.append((i, side))
            last = side
    return out


def test_bar_signals_over_many_triggers_equal_the_rule(spark):
    src = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rng = np.random.default_rng(5)
    closes = (10 + rng.normal(size=60).cumsum() / 5).tolist()
    closes[17] = closes[41] = None
    at = 0
    for n in (1, 2, 20, 3, 34):
        hourly(spark, closes[at : at + n], at).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
        at += n
    d = live.closed_bar_signals(spark.readStream.schema(BARS).option("maxFilesPerTrigger", 1).parquet(src), 6)
    path, _ = live.run_available(d, store=live.ROCKS)
    t0 = pd.Timestamp("2024-01-01")
    got = sorted((int((pd.Timestamp(r["ts"]) - t0).total_seconds() // 3600), r["direction"]) for r in live.read_output(spark, path, d.schema).collect())
    assert got == signals_by_rule(closes, 6) and len(got) > 3


def test_bar_signals_start_from_stored_bars(spark):
    src = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    hourly(spark, [10.0, 12.0, 13.0, 5.0]).coalesce(1).write.mode("append").parquet(src)
    stored = hourly(spark, [50.0, 11.0, 9.0, 11.0], -4).union(hourly(spark, [1.0, 2.0], -2, "only stored"))
    warm = live.last_bars(stored, 3)
    assert warm.where("instrument = 'x'").count() == 3
    d = live.closed_bar_signals(spark.readStream.schema(BARS).parquet(src), 3, warm)
    path, _ = live.run_available(d, store=live.ROCKS)
    got = live.read_output(spark, path, d.schema).orderBy("ts").collect()
    assert [(r["direction"], r["entry_price"]) for r in got] == [(1, 12.0), (-1, 5.0)]
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_backlog_and_staleness(spark):
    s = spark.createDataFrame([("a", 5000, 10), ("b", 900, 0)], "stream string, produced bigint, acknowledged bigint")
    assert [r["stream"] for r in rk.backlog_alerts(s).collect()] == ["a"]
    t = ticks(spark, [0, 1])
    now = F.lit("2024-01-01 00:01:20").cast("timestamp_ntz")
    assert rk.feed_staleness(t, now).first()["status"] == "warning"


def test_listener_counts_rows_and_late_ticks(spark):
    src, base, ear = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), live.new_folder(spark), live.BacklogListener()
    spark.streams.addListener(ear)
    try:
        for minutes, start in (([1, 5, 20, 61], 0), ([2, 50.9, 62, 200], 10)):
            ticks(spark, minutes, start).write.mode("append").parquet(src)
            d = live.punctual(spark.readStream.schema(SCHEMA).parquet(src))
            path, q = live.run_available(d, base=base, name="few")
            ear.wait(q)
    finally:
        spark.streams.removeListener(ear)
    written = spark.createDataFrame([("few", 2000)], "stream string, produced bigint")
    assert ear.stats(spark, written).collect() == [("few", 2000, 8, 2)]
    assert [(r["stream"], r["lag"]) for r in rk.backlog_alerts(ear.stats(spark, written)).collect()] == [("few", 1992)]
    assert ear.stats(spark).first()["produced"] == 8
    assert spark.read.parquet(path).count() == 6
