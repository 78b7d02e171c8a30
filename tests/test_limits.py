"""Results at exact limits, and steps that must stay bounded on larger tables."""

import hashlib
import os
import tempfile
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from barlume.operators import align, features as fe, indicators as ind, risk as rk, series as sr, splits as sp, trades as tr
from barlume.streaming import live


def test_share_of_a_count_is_exact(spark):
    """0.7 of 720 is 504; doubles give 503.99."""
    w = sp.expanding_windows(spark.createDataFrame([("x", 720)], "instrument string, n bigint"), 0.7)
    assert [(r["train_to"], r["test_from"], r["test_to"]) for r in w.orderBy("fold").collect()] == [(503, 504, 575), (575, 576, 647), (647, 648, 719)]


def test_ordered_split_share_is_exact(spark):
    t0 = pd.Timestamp("2024-01-01")
    bars = spark.createDataFrame([("x", (t0 + pd.Timedelta(hours=i)).to_pydatetime()) for i in range(720)], "instrument string, ts timestamp_ntz")
    assert fe.ordered_split(bars, 0.7).where("split = 'train'").count() == 504


def test_order_value_of_its_own_decides_at_the_limit(spark):
    """price * lots * 100 may exceed price * (lots * 100) by the last bit."""
    px, n = next((p / 100, n) for p in range(100, 9999) for n in range(1, 100) if p / 100 * n * 100 > p / 100 * (n * 100))
    row = spark.createDataFrame([("BUY", n * 100.0, px, px, 0.0, 1e9, 0.0, 0.0, False, float(n))], "side string, quantity double, entry_price double, stop double, position double, balance double, exposure double, daily_pnl double, breaker_active boolean, lots double")
    limits = {**rk.LIMITS, "max_order_size": 1e9, "max_position_size": 1e9, "max_exposure": px * (n * 100)}
    assert rk.pre_trade(row, limits).first()["reasons"] == []
    assert rk.pre_trade(row, limits, F.col("entry_price") * F.col("lots") * 100).first()["reasons"] == ["total_exposure"]


def test_no_level_is_near_zero(spark):
    """A low of zero is a level of its own, as in the SQL, where a share of zero is infinite."""
    lows = [5.0] * 6 + [0.0] + [5.0] * 6 + [0.01] + [5.0] * 6
    t0 = pd.Timestamp("2024-01-01")
    bars = spark.createDataFrame([("x", (t0 + pd.Timedelta(hours=i)).to_pydatetime(), 6.0, x) for i, x in enumerate(lows)], "instrument string, ts timestamp_ntz, high double, low double")
    got = ind.swing_levels(bars).where("kind = 'support'").orderBy("level_no").collect()
    assert [(r["level_no"], r["level"], r["touches"]) for r in got] == [(1, 0.0, 1), (2, 0.01, 1)]


def test_first_touch_is_a_walk():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 64, 77):
        low = rng.integers(0, 40, n).astype(float)
        high = low + rng.integers(0, 5, n)
        low[rng.random(n) < 0.1] = np.nan
        start, down, up = rng.integers(0, n + 2, 200), rng.integers(-5, 6, 200).astype(float), rng.integers(36, 50, 200).astype(float)
        up[::7] = np.nan
        want = [next((i for i in range(s, n) if low[i] <= d or high[i] >= u), -1) for s, d, u in zip(start, down, up)]
        assert align.first_touch(low, high, start, down, up).tolist() == want


def test_first_crossing_makes_no_pairs(spark):
    """Dense quotes of one hour, small chunks: joins of positions with rows made a pair per row of the hour."""
    rng = np.random.default_rng(7)
    n = 3000
    t0, big = pd.Timestamp("2024-01-01"), 2**53
    px = 100 + np.cumsum(rng.normal(0, 1, n)).round(2)
    pdf = pd.DataFrame({"instrument": "x", "ts": [t0 + pd.Timedelta(seconds=int(i)) for i in np.sort(rng.integers(0, 3600, n))], "event_id": big + np.arange(n), "px": px})
    d = spark.createDataFrame(pdf, "instrument string, ts timestamp_ntz, event_id bigint, px double")
    path = d.select("instrument", "ts", "event_id", *[F.col("px").alias(c) for c in ("buy_lo", "buy_hi", "sell_lo", "sell_hi")])
    pos = d.select(F.col("event_id").alias("position_id"), "instrument", F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("ts").alias("start_ts"),
                   (F.col("px") - F.when(F.col("event_id") % 2 == 0, 9).otherwise(-9)).alias("stop"), (F.col("px") + F.when(F.col("event_id") % 2 == 0, 9).otherwise(-9)).alias("target"))
    for strict in (True, False):
        crossed = align.first_crossing(pos, path, strict, chunk_rows=500)
        got = {r["position_id"]: (r["exit_ts"], r["exit_reason"]) for r in crossed.collect()}
        ts = pdf["ts"].to_numpy()
        for i in range(0, n, 7):
            after = np.flatnonzero((ts > ts[i]) if strict else (ts >= ts[i]))
            hit = after[np.abs(px[after] - px[i]) >= 9 - 1e-12]
            sign = 1 if (big + i) % 2 == 0 else -1
            want = (pdf["ts"][hit[0]].to_pydatetime(), "stop_loss" if (px[hit[0]] - px[i]) * sign < 0 else "take_profit") if len(hit) else (None, None)
            assert got[big + i] == want, i


QUOTES = "event_id bigint, instrument string, ts timestamp_ntz, bid double, ask double"


def _quotes(spark, rows):
    t0 = pd.Timestamp("2024-01-01")
    return spark.createDataFrame([(i, "x", (t0 + pd.Timedelta(minutes=m)).to_pydatetime(), px, px + 0.001) for i, m, px in rows], QUOTES)


def _in_batches(spark, parts, schema, each):
    """Each part is a file and a trigger of its own."""
    src = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    base = live.new_folder(spark)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(src)
        path, _ = live.run_available(spark.readStream.schema(schema).parquet(src), each=each, base=base)
    return path


def test_tick_quality_goes_on_over_batches(spark):
    """The last tick of a batch is the previous one of the next batch, whatever its number; no step holds an instrument."""
    parts = [_quotes(spark, [(7, 0, 10.0), (9, 1, 10.01), (8, 2, 10.0)]), _quotes(spark, [(20, 3, 11.0), (21, 2, 11.0)]), _quotes(spark, [(30, 9, 11.0), (31, 10, 12.0)])]
    path = _in_batches(spark, parts, QUOTES, live.tick_quality)
    got = live.read_batches(spark, path, live.ISSUES)
    assert sorted((r["event_id"], r["issues"]) for r in got.collect()) == [(9, "out_of_order"), (20, "price_jump"), (21, "out_of_order"), (31, "price_jump")]


def test_open_positions_wait_for_later_batches(spark):
    schema = "quote boolean, instrument string, ts timestamp_ntz, position_id bigint, side string, stop double, target double, bid double, ask double"
    at = lambda m: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m)).to_pydatetime()
    pos = lambda i, m, side, stop, target: (False, "x", at(m), i, side, stop, target, None, None)
    tick = lambda m, px: (True, "x", at(m), None, None, None, None, px, px + 0.1)
    parts = [
        [pos(1, 0, "BUY", 9.0, 11.0), pos(2, 0, "SELL", 13.0, 8.0), tick(1, 10.0)], [pos(3, 2, "BUY", 9.5, 99.0), tick(2, 9.0), tick(3, 10.5)], [tick(4, 9.2)], [tick(5, 7.0)],
    ]
    path = _in_batches(spark, [spark.createDataFrame(p, schema) for p in parts], schema, live.close_positions)
    got = {r["position_id"]: (r["exit_ts"], r["exit_reason"]) for r in live.read_batches(spark, path, live.HITS).collect()}
    assert got == {1: (at(2), "stop_loss"), 2: (at(5), "take_profit"), 3: (at(4), "stop_loss")}


def test_an_order_is_walked_in_one_integer_sort():
    """Same places, order and walk as by division and a stable sort, ties among the places included."""
    rng = np.random.default_rng(11)
    h = np.concatenate([rng.integers(0, 2**31 - 1, 40_000), [0, 1, 2**31 - 2] * 3])
    pnl = rng.normal(0, 60, len(h)).round(0)
    for sim in (0, 7, 9_999):
        z = tr._place(h, sim, 42)
        assert (tr._places(h, sim, 42) == z).all()
        for initial in (1e6, -5.0):
            equity = np.cumsum(pnl[np.argsort(z, kind="stable")]) + initial
            peak = np.maximum(np.maximum.accumulate(equity), initial)
            fall = np.divide(peak - equity, peak, out=np.zeros_like(peak), where=peak > 0)
            assert tr.walk_order(pnl, h, sim, initial, 42) == (fall.max(), equity[-1])


def test_hourly_loss_moves_one_row_per_time(spark):
    """4,000 trades of three times make three rows of the as-of step."""
    t0 = pd.Timestamp("2024-01-01")
    rows = [((t0 + pd.Timedelta(minutes=40 * (i // 1500))).to_pydatetime(), float(i), i + 1) for i in range(4000)]
    d = spark.createDataFrame(rows, "ts timestamp_ntz, _loss double, _rn bigint")
    got = rk._loss_before(d, sr.Series(keys=(), order=("ts",), slice_seconds=86400), 3600).orderBy("ts").collect()
    assert [r["_before"] for r in got] == [None, None, 1499.0]


def test_scans_send_packed_ranges_of_places(spark, monkeypatch):
    """No row per trade and simulation: eight ranges an order, several jobs, the same walks; equity may be negative, pnl null."""
    rng = np.random.default_rng(5)
    names, pnl = [f"t{i % 3990}" for i in range(4000)], rng.normal(0, 60, 4000).round(1)
    pnl[7] = np.nan
    d = spark.createDataFrame([(k, None if np.isnan(p) else float(p)) for k, p in zip(names, pnl)], "name string, pnl double")
    listed = pd.DataFrame({"k": [hashlib.md5(k.encode()).hexdigest() for k in names], "p": np.nan_to_num(pnl)}).sort_values(["k", "p"])
    h = np.array([int(k[:12], 16) % (2**31 - 1) for k in listed["k"]])
    for initial in (1e4, 100.0, -50.0):
        want = {sim: tr.walk_order(listed["p"].to_numpy(), h, sim, initial, 42) for sim in range(12)}
        with monkeypatch.context() as m:
            m.setattr(tr, "equity_curve", lambda *_: 1 / 0)
            m.setattr(tr, "_PLACES_A_JOB", 20_000)
            got = {r["sim"]: (r["max_drawdown"], r["final_equity"]) for r in tr.permute_by_scans(d, F.col("name"), initial, 12, rows=500).collect()}
        assert got.keys() == want.keys()
        assert np.allclose([got[s] for s in want], list(want.values()), rtol=1e-9, atol=1e-9)


def test_scans_cut_places_of_one_key(spark):
    """A key of more trades than a range holds goes by the series engine, with the same orders."""
    rows = [("same" if i % 2 else f"t{i}", float(i % 11 - 5)) for i in range(120)]
    d = spark.createDataFrame(rows, "name string, pnl double")
    one, many = ({r["sim"]: (round(r["max_drawdown"], 9), r["final_equity"]) for r in tr.permute_by_scans(d, F.col("name"), 50.0, 5, rows=n).collect()} for n in (500, 50))
    assert len(one) == 5 and one == many
    assert tr.permute_by_scans(d.limit(0), F.col("name"), 50.0, 5).count() == 0


def test_trade_orders_of_a_million_stay_in_tasks(spark, monkeypatch):
    """Over 2**20 trades: the list goes to the tasks, no place is shuffled; places that trades share keep the order of keys."""
    n, initial = 1_100_000, 1e6
    pnl = (np.arange(n) * 7919 % 2001 - 1000.0)
    d = spark.range(n).select(F.concat(F.lit("t"), "id").alias("name"), (F.col("id") * 7919 % 2001 - 1000).cast("double").alias("pnl"))
    keys = [hashlib.md5(b"t%d" % i).digest() for i in range(n)]
    order = sorted(range(n), key=keys.__getitem__)
    h = np.array([int.from_bytes(keys[i][:6], "big") % (2**31 - 1) for i in order])
    monkeypatch.setattr(tr, "permute_by_scans", lambda *_: 1 / 0)
    got = {r["sim"]: (r["max_drawdown"], r["final_equity"]) for r in tr.permute_trades(d, F.col("name"), initial, 3, block=2).collect()}
    assert got == {sim: tr.walk_order(pnl[order], h, sim, initial, 42) for sim in range(3)}


def test_scans_leave_no_places_on_disk(spark, monkeypatch):
    """Eight jobs of 8,000 places, 96 KB each: their shuffle files go with them."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f for f in manager.getAllFiles().mkString("|").split("|") if "shuffle_" in f}
    monkeypatch.setattr(tr, "_PLACES_A_JOB", 8_000)
    d = spark.range(4000).select(F.col("id").cast("string").alias("name"), (F.col("id") * 7919 % 2001 - 1000.5).alias("pnl"))
    before = files()
    walks = tr.permute_by_scans(d, F.col("name"), 1e5, 16, rows=500)
    for _ in range(50):  # files go in the background
        left = sum(os.path.getsize(f) for f in files() - before if os.path.exists(f))
        if left < 96_000:
            break
        time.sleep(0.1)
    assert left < 96_000 and walks.count() == 16


def test_ranges_keep_only_falls_that_may_be_deepest():
    pnl = np.array([5.0, -3, 8, -2, 1, -1, 9, -12, 20, -1])
    found = pa.table({"no": [0], "places": [np.arange(10, dtype=np.int32).tobytes()], "pnl": [pnl.tobytes()]})
    got = [tr._walk_range(p)([pa.scalar(0), pa.scalar(0)], found)["falls"][0].as_py() for p in (False, True)]
    assert [(f["peak"], f["low"]) for f in got[1]] == [(5, 2), (17, 5)] and len(got[0]) == 4
