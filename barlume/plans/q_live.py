"""Source, sink, risk and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barlume.operators import evaluate as ev, risk as rk, rules as ru, series as sr, trades as tr
from barlume.plans import sqltext as q
from barlume.plans.q_eval import RANKING, SUMMARIES, summaries
from barlume.plans.registry import query
from barlume.sources import files, messages, store
from barlume.streaming import live

OVER, lag = q.OVER, q.lag
OHLCV = "instrument ts open:r high:r low:r close:r volume:i"


def folder(t, name: str) -> str:
    return f"{sr.shared_folder(t.spark).rstrip('/')}/barlume-{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------------ sources and sinks


@query("s01_s02_warehouse_roundtrip", OHLCV, "SELECT * FROM bars_h1 WHERE instrument = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05 06:00:00' AND TIMESTAMP '2024-01-20'")
def _(t):
    path = folder(t, "warehouse")
    store.save_bars(t.bars_h1, path, "H1")
    return store.load_bars(t.spark, path, "click", "H1", "2024-01-05 06:00:00", "2024-01-20 00:00:00")


@query("s03_csv_import", OHLCV, "SELECT instrument, ts, open, high, low, close, CASE WHEN volume % 5 = 0 THEN 0 ELSE volume END AS volume FROM bars_h1")
def _(t):
    """Candles written with loose headers, text gaps and repeated rows, then imported."""
    path = folder(t, "csv")
    raw = t.bars_h1.select(F.col("instrument"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss+00:00").alias(" Time"), F.col("open").alias("Open"), F.col("high").alias("HIGH "), F.col("low").alias("Low"), F.col("close").alias("close"),
                           F.when(F.col("volume") % 5 == 0, "n/a").otherwise(F.col("volume").cast("string")).alias("Vol"))
    raw.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n").write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return files.import_csv(t.spark, path)


@query("s04_ohlc_loader_problems", "issue instrument n:i", f"""SELECT 'cadence' AS issue, instrument, count(*) AS n FROM (SELECT *, epoch(ts) - epoch({lag('ts')}) AS g FROM faulty WHERE hour(ts) <> 11) WHERE g <> 3600 GROUP BY 2
  UNION ALL SELECT 'duplicate_timestamp', instrument, count(*) FROM bars_h1 WHERE hour(ts) = 7 GROUP BY 2 UNION ALL SELECT 'missing_timestamp', instrument, count(*) FROM bars_h1 WHERE hour(ts) = 11 GROUP BY 2
  UNION ALL SELECT 'non_numeric_price', instrument, count(*) FROM bars_h1 WHERE hour(ts) = 9 GROUP BY 2""", faulty="SELECT * FROM bars_h1 UNION ALL SELECT * FROM bars_h1 WHERE hour(ts) = 7")
def _(t):
    path, b, at = folder(t, "ohlc"), t.bars_h1, F.hour("ts")
    faulty = b.union(b.where(at == 7)).withColumn("high", F.when(at == 9, "n/a").otherwise(F.col("high").cast("string")))
    faulty.withColumn("Timestamp", F.when(at != 11, F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))).drop("ts").repartitionByRange(4, "instrument", "Timestamp").sortWithinPartitions("instrument", "Timestamp").write.option("header", True).csv(path)
    return files.load_ohlc(t.spark, path, 3600)[1].groupBy("issue", "instrument").agg(F.count(F.lit(1)).alias("n"))


@query("s04_ohlc_loader_violations", "instrument ts", f"SELECT instrument, ts FROM (SELECT *, epoch(ts) - epoch({lag('ts')}) AS g FROM bars_h1) WHERE g <> 3600")
def _(t):
    path = folder(t, "ohlc") + ".parquet"
    t.bars_h1.withColumnRenamed("ts", "Timestamp").write.parquet(path)
    return files.load_ohlc(t.spark, path, 3600)[1].where("issue = 'cadence'").select("instrument", "ts")


@query("s05_htf_loader", "instrument ts close:r", "SELECT * FROM bars_h4")
def _(t):
    path = folder(t, "htf")
    t.bars_h4.withColumn("Timestamp", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).drop("ts").write.option("header", True).csv(path)
    return files.load_ohlc(t.spark, path, None)[0].select("instrument", "ts", "close")


@query("s06_range_fill", "instrument ts close:r", """SELECT instrument, ts, CASE WHEN ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' THEN close WHEN ts < TIMESTAMP '2024-01-12' THEN close + 1 ELSE close + 2 END AS close FROM bars_h1""")
def _(t):
    b = t.bars_h1.select("instrument", "ts", "close")
    cut = lambda a, z: store.time_slice(b, a, z)
    cached = cut("2024-01-10 00:00:00", "2024-01-19 23:00:00")
    older, newer = cut(None, "2024-01-11 23:00:00"), cut("2024-01-12 00:00:00", None)
    return store.fill_range(cached, older.withColumn("close", F.col("close") + 1), newer.withColumn("close", F.col("close") + 2))


@query("s07_ohlc_normaliser", "event_id open:r high:r low:r close:r spread_c:r", """SELECT event_id, CASE WHEN volume % 3 = 0 THEN (bid + ask) / 2 ELSE price END AS open, (bid + ask) / 2 AS high, (bid + ask) / 2 AS low, (bid + ask) / 2 AS close, ask - bid AS spread_c FROM ticks WHERE volume % 11 > 0""")
def _(t):
    b, a = F.col("bid"), F.when(F.col("volume") % 11 > 0, F.col("ask"))
    d = t.ticks.select("event_id", F.when(F.col("volume") % 3 != 0, F.col("price")).alias("mid_o"), *[x.alias(f"{n}_{i}") for i in "ohlc" for n, x in (("bid", b), ("ask", a))])
    return files.normalise_ohlc(d).where("spread_c IS NOT NULL")


@query("s08_s09_message_stream", "event_id instrument price:r", "SELECT event_id, instrument, price FROM ticks")
def _(t):
    """Ticks as JSON messages through a file stream and back."""
    src, ck, out = folder(t, "messages"), folder(t, "ck"), folder(t, "decoded")
    messages.encode(t.ticks.select("event_id", "instrument", "price")).write.text(src)
    d = messages.decode(messages.read_stream(t.spark, src), "event_id bigint, instrument string, price double, timestamp timestamp_ntz")
    qy = messages.write_stream(d, out, ck, fmt="parquet")
    qy.awaitTermination()
    return t.spark.read.parquet(out)


@query("s12_state_snapshots", "instrument bar_no:i close:r", f"SELECT * FROM (SELECT *, row_number() OVER ({OVER}) AS bar_no FROM bars_h1) WHERE bar_no % 50 = 0")
def _(t):
    path = folder(t, "state")
    files.state_snapshots(ru.bar_numbers(t.bars_h1).select("instrument", "bar_no", "close"), path, 50)
    return t.spark.read.schema("instrument string, bar_no bigint, close double").json(path)


@query("s13_sample_cache", "instrument ts n:i first:r", f"SELECT instrument, ts, 8 AS n, lag(close, 7) OVER ({OVER}) AS first FROM bars_h1 QUALIFY row_number() OVER ({OVER}) >= 8")
def _(t):
    from barlume.operators.features import pack_sequences

    path = folder(t, "samples")
    d = t.bars_h1.withColumn("close", F.col("close").cast("double"))
    files.save_samples(pack_sequences(d, ("close", "volume"), 8), path)
    s = t.spark.read.parquet(path)
    exact = sr.windowed(d, sr.BARS, lambda x, w: x.withColumn("first", F.lag("close", 7).over(w)), back=7).select("instrument", "ts", "first")
    return s.select("instrument", "ts", F.size("sequence").alias("n")).join(exact, ["instrument", "ts"])


@query("s14_event_calendar", "event_ts", "SELECT DISTINCT date_trunc('second', event_ts) AS event_ts FROM calendar")
def _(t):
    path = folder(t, "calendar")
    c = t.calendar
    c.unionByName(c).select(F.lit("release").alias("event"), F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Timestamp_UTC")).write.option("header", True).csv(path)
    return files.event_calendar(t.spark, path)


@query("s15_scorecard_scan", "review_week strategy_name trades:i", "SELECT review_week, strategy_name, trades FROM scorecard WHERE review_week = '1998-03'")
def _(t):
    path = folder(t, "scorecards")
    t.scorecard.withColumn("wk", F.col("review_week")).write.partitionBy("wk").option("header", True).csv(path)
    return files.scan_scorecards(t.spark, path, "1998-03")


@query("s16_report_table", "rank:i line", f"""SELECT rank, '| ' || rank || ' | ' || instrument || ' | ' || strategy || ' | ' || windows_run || ' | ' || coalesce(printf('%.6f', CAST(stability_score AS DOUBLE)), '-') || ' |' AS line
   FROM (SELECT *, row_number() OVER (ORDER BY {RANKING}) AS rank FROM ss) WHERE rank <= 15""", **SUMMARIES)
def _(t):
    top = ev.ranked(summaries(t), 15, ["instrument", "strategy"])
    order = [F.col(c).desc() for c in ev.RANK] + ["test_max_drawdown_mean", "instrument", "strategy"]
    d = top.withColumn("rank", F.row_number().over(sr.Window.orderBy(*order)))
    files.save_report(d, folder(t, "report"))
    return files.report_lines(d, ["instrument", "strategy", "windows_run", "stability_score"])


@query("s17_execution_responses", "order_id:i side filled_quantity:i fill_price:r reason", """SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_custkey % 2 = 0 THEN 'BUY' ELSE 'SELL' END END AS side, CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS filled_quantity,
   CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS fill_price, CASE o_orderstatus WHEN 'O' THEN 'pending orders are not supported' WHEN 'P' THEN 'rejected: MARKET_HALTED' END AS reason FROM orders""")
def _(t):
    st, c = F.col("o_orderstatus"), F.col("o_custkey")
    units = files.signed_units(F.when(c % 2 == 0, "BUY").otherwise("SELL"), c)
    fill = F.struct(F.col("o_orderkey").cast("string").alias("id"), units.cast("string").alias("units"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("price"))
    body = F.to_json(F.struct(
        F.when(st == "F", fill).alias("orderFillTransaction"), F.when(st == "O", F.struct(F.lit("1").alias("id"))).alias("orderCreateTransaction"), F.when(st == "P", F.struct(F.lit("MARKET_HALTED").alias("rejectReason"))).alias("orderRejectTransaction")))
    ex, rej = files.parse_execution_responses(t.orders.select(F.col("o_orderkey").alias("order_id"), body.alias("payload")))
    return ex.unionByName(rej, allowMissingColumns=True)


# ------------------------------------------------------------------ risk screens


@query("k01_pre_trade_checks", "signal_id approved reasons", """SELECT signal_id, len(r) = 0 AS approved, array_to_string(r, ',') AS reasons FROM (SELECT o_orderkey AS signal_id, list_filter([CASE WHEN q > 5000 THEN 'order_size' END, CASE WHEN abs(pos + CASE WHEN s = 'BUY' THEN q ELSE -q END) > 10000 THEN 'position_size' END,
   CASE WHEN stop IS NULL OR abs(px - stop) > 0.005 THEN 'stop_loss' END, CASE WHEN q * px / nullif(bal, 0) > 10 THEN 'leverage' END, CASE WHEN bal < 5000 THEN 'account_balance' END, CASE WHEN ex + q * px > 50000 THEN 'total_exposure' END, CASE WHEN pnl <= -1000 THEN 'daily_loss' END, CASE WHEN br THEN 'circuit_breaker' END, CASE WHEN q IS NULL OR bal IS NULL THEN 'missing_input' END], lambda e: e IS NOT NULL) AS r
   FROM (SELECT o_orderkey, CASE WHEN o_custkey % 40 <> 3 THEN o_custkey % 6000 * 1.0 END AS q, o_custkey % 12000 - 6000.0 AS pos, CASE WHEN o_orderstatus = 'O' THEN 'BUY' ELSE 'SELL' END AS s, 1.0 + o_custkey % 10 AS px, CASE WHEN o_custkey % 8 > 0 THEN 1.0 + o_custkey % 10 - (o_custkey % 3) * 0.004 END AS stop, CASE WHEN o_custkey % 30 <> 4 THEN o_totalprice / 10 END AS bal, o_totalprice / 8 AS ex, o_custkey % 2000 - 1100.0 AS pnl, o_custkey % 50 = 0 AS br FROM orders))""")
def _(t):
    c = F.col("o_custkey")
    px = F.lit(1.0) + c % 10
    d = t.orders.select(
        F.col("o_orderkey").alias("signal_id"), F.when(F.col("o_orderstatus") == "O", "BUY").otherwise("SELL").alias("side"), F.when(c % 40 != 3, (c % 6000).cast("double")).alias("quantity"), px.alias("entry_price"),
        F.when(c % 8 > 0, px - (c % 3) * 0.004).alias("stop"), (c % 12000 - 6000).cast("double").alias("position"), F.when(c % 30 != 4, F.col("o_totalprice") / 10).alias("balance"), (F.col("o_totalprice") / 8).alias("exposure"), (c % 2000 - 1100).cast("double").alias("daily_pnl"), (c % 50 == 0).alias("breaker_active"))
    return rk.pre_trade(d).withColumn("reasons", F.array_join("reasons", ","))


_KW = "ORDER BY ts, instrument, exit_seq, entry_seq"
_LIM = {**rk.LIMITS, "loss_streak": 9, "loss_velocity_1h": 900000.0, "max_daily_loss": 700000.0, "max_drawdown_pct": 0.9}


@query("k02_circuit_breaker", "instrument exit_seq:i entry_seq:i loss_streak:i loss_1h:r2 daily_pnl:r2 drawdown:r reasons halted", f"""SELECT *, array_to_string(r, ',') AS reasons, max(CASE WHEN len(r) > 0 THEN 1 ELSE 0 END) OVER ({_KW} ROWS UNBOUNDED PRECEDING) = 1 AS halted FROM (SELECT *, list_filter([CASE WHEN loss_streak >= 9 THEN 'consecutive_losses' END, CASE WHEN loss_1h > 900000 THEN 'loss_velocity' END, CASE WHEN daily_pnl <= -700000 THEN 'daily_loss' END, CASE WHEN drawdown > 0.9 THEN 'drawdown' END], lambda e: e IS NOT NULL) AS r FROM kb2)""",
       kb0=f"SELECT *, row_number() OVER ({_KW}) AS rn, sum(pnl) OVER ({_KW} ROWS UNBOUNDED PRECEDING) AS cum FROM trades",
       kb1=f"SELECT *, max(CASE WHEN pnl >= 0 THEN rn END) OVER ({_KW} ROWS UNBOUNDED PRECEDING) AS ok, greatest(5000000, max(5000000 + cum) OVER ({_KW} ROWS UNBOUNDED PRECEDING)) AS pk FROM kb0",
       kb2=f"SELECT *, rn - coalesce(ok, 0) AS loss_streak, sum(greatest(-pnl, 0)) OVER (PARTITION BY ts {_KW} ROWS UNBOUNDED PRECEDING) AS loss_1h, sum(pnl) OVER (PARTITION BY CAST(ts AS DATE) {_KW} ROWS UNBOUNDED PRECEDING) AS daily_pnl, (pk - 5000000 - cum) / pk AS drawdown FROM kb1")
def _(t):
    s = sr.Series(keys=(), order=("ts", "instrument", "exit_seq", "entry_seq"), slice_seconds=86400)
    trades = sr.materialise(tr.fifo_trades(t.fills_table).select("ts", "instrument", "exit_seq", "entry_seq", "pnl"))
    d = rk.circuit_breaker(trades, 5000000.0, s, _LIM)
    return d.withColumn("reasons", F.array_join("reasons", ","))


@query("k03_first_per_signal", "user_id event_id:i ts", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS event_id, min(ts) AS ts FROM ticks GROUP BY user_id")
def _(t):
    return rk.first_per_signal(t.ticks.select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"])


_CONTROL = """SELECT o.event_id, o.ts, coalesce(k.v, false) AS kill_switch, coalesce(s.v, false) AS shadow_mode FROM (SELECT * FROM ticks WHERE instrument = 'purchase') o
   ASOF LEFT JOIN (SELECT ts, volume % 4 = 0 AS v FROM ticks WHERE instrument = 'error' AND volume % 4 < 2) k ON o.ts >= k.ts ASOF LEFT JOIN (SELECT ts, volume % 4 = 2 AS v FROM ticks WHERE instrument = 'error' AND volume % 4 >= 2) s ON o.ts >= s.ts"""


@query("k04_control_state", "event_id ts kill_switch shadow_mode", _CONTROL)
def _(t):
    names = F.array(*[F.lit(x) for x in ("kill_switch_on", "kill_switch_off", "shadow_mode_on", "shadow_mode_off")])
    cmd = t.ticks.where("instrument = 'error'").select("ts", F.get(names, (F.col("volume") % 4).cast("int")).alias("action"))
    return rk.control_state(t.ticks.where("instrument = 'purchase'").select("event_id", "ts"), cmd, "event_id")


@query("t08_feed_staleness", "instrument last_ts staleness:i status", """SELECT instrument, m AS last_ts, n AS staleness, CASE WHEN n > 30 THEN 'critical' WHEN n > 10 THEN 'warning' ELSE 'healthy' END AS status FROM (
   SELECT instrument, max(ts) AS m, date_diff('second', date_trunc('second', max(ts)), (SELECT date_trunc('second', max(ts)) FROM ticks)) AS n FROM ticks GROUP BY 1)""")
def _(t):
    return rk.feed_staleness(t.ticks)


_ALERTS = dict(
       al0="SELECT event_id, instrument, volume % 2 AS message, ts FROM ticks", al1="SELECT *, row_number() OVER (PARTITION BY instrument, message ORDER BY ts, event_id) AS rn FROM al0",
       al2="""SELECT instrument, message, CAST(0 AS BIGINT) AS rn, TIMESTAMP '1970-01-01' AS sent, false AS kept FROM (SELECT DISTINCT instrument, message FROM al1) UNION ALL
         SELECT a.instrument, a.message, a.rn, CASE WHEN a.ts >= s.sent + INTERVAL '20 minutes' THEN a.ts ELSE s.sent END, a.ts >= s.sent + INTERVAL '20 minutes' FROM al2 s JOIN al1 a ON a.instrument = s.instrument AND a.message = s.message AND a.rn = s.rn + 1""")


@query("t09_alert_deduplication", "event_id instrument message:i ts", """SELECT a.event_id, a.instrument, a.message, a.ts FROM al1 a JOIN al2 s ON s.instrument = a.instrument AND s.message = a.message AND s.rn = a.rn WHERE s.kept""",
       **_ALERTS)
def _(t):
    d = t.ticks.select("event_id", "instrument", (F.col("volume") % 2).alias("message"), "ts")
    return rk.thin_by_time(d, ["instrument", "message"], 1200, sr.TICKS)


@query("t10_alert_routing", "event_id severity channel", """SELECT event_id, severity, unnest(CASE severity WHEN 'critical' THEN ['log', 'email'] ELSE ['log'] END) AS channel FROM (SELECT event_id, CASE WHEN volume % 10 = 0 THEN 'critical' WHEN volume % 10 < 4 THEN 'warning' ELSE 'info' END AS severity FROM ticks)""")
def _(t):
    v = F.col("volume") % 10
    return rk.route_alerts(t.ticks.select("event_id", F.when(v == 0, "critical").when(v < 4, "warning").otherwise("info").alias("severity")))


# ------------------------------------------------------------------ streaming


def tick_stream(t):
    """The events file as a stream, shaped like the ticks view."""
    e = t.spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.directory)
    return e.select(
        "event_id", F.col("event_type").alias("instrument"), "ts", "user_id", (F.col("value") - 0.01).alias("bid"), (F.col("value") + 0.01).alias("ask"), F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"))


@query("t01_t02_stream_candles", OHLCV, "SELECT * FROM bars_m15 WHERE ts + INTERVAL '15 minutes' <= (SELECT max(ts) FROM ticks) - INTERVAL '10 minutes'")
def _(t):
    d = live.candles(tick_stream(t), "15 minutes")
    path, _ = live.run_available(d)
    return live.read_output(t.spark, path, d.schema)


def deliver(t, name, parts, runs):
    """Ticks written to one folder part by part; the stream ``punctual`` runs after each of the first ``runs``."""
    src, base, ear = live.new_folder(t.spark), live.new_folder(t.spark), live.BacklogListener()
    t.spark.streams.addListener(ear)
    try:
        for no, part in enumerate(parts):
            t.ticks.where(part).write.mode("append").parquet(src)
            if no < runs:
                d = live.punctual(t.spark.readStream.schema(t.ticks.schema).parquet(src))
                ear.wait(live.run_available(d, base=base, name=name)[1])
    finally:
        t.spark.streams.removeListener(ear)
    written = t.spark.read.parquet(src).agg(F.lit(name).alias("stream"), F.count(F.lit(1)).alias("produced"))
    return ear.stats(t.spark, written)


_PARTS = ("volume < 50", "volume >= 50 OR volume IS NULL")


@query("t02_late_ticks", "stream late:i acknowledged:i", f"""SELECT 'ticks' AS stream, count(*) AS acknowledged, count(*) FILTER (({_PARTS[1]}) AND epoch_us(ts) <= (SELECT (epoch_ms(max(ts)) - 600000) * 1000 FROM ticks WHERE {_PARTS[0]})) AS late FROM ticks""")
def _(t):
    """The second delivery meets the watermark of the first."""
    return deliver(t, "ticks", _PARTS, 2)


@query("t11_backlog_alerts", "stream lag:i", f"SELECT 'ticks' AS stream, count(*) AS lag FROM ticks WHERE {_PARTS[1]} HAVING count(*) > 1000")
def _(t):
    """The second delivery has not been read; the listener tells what has."""
    return rk.backlog_alerts(deliver(t, "ticks", _PARTS, 1))


_FROM = "(SELECT date_trunc('day', make_timestamp((epoch_us(min(ts)) + epoch_us(max(ts))) // 2)) FROM ticks)"


@query("t03_stream_bar_signals", "instrument ts direction:i entry_price:r", f"""SELECT instrument, ts, direction, close AS entry_price FROM (SELECT *, lag(direction) OVER ({OVER}) AS before FROM cbs WHERE direction IS NOT NULL AND ts >= {_FROM}) WHERE before IS NULL OR before <> direction""",
       cbs=f"""SELECT *, CASE WHEN n > 20 AND close > hi * 1.0002 THEN 1 WHEN n > 20 AND close < lo * 0.9998 THEN -1 END AS direction FROM (SELECT *, row_number() OVER ({OVER}) AS n, max(high) OVER ({OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hi,
         min(low) OVER ({OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS lo FROM bars_h1 WHERE ts + INTERVAL '1 hour' <= (SELECT max(ts) FROM ticks) - INTERVAL '10 minutes')""")
def _(t):
    """Closed hourly bars from the stream sink feed the stateful signal step, which starts
    from the bars stored before the middle day of the ticks."""
    us = lambda f: F.unix_micros(f("ts").cast("timestamp"))
    middle = t.ticks.agg(F.date_trunc("day", F.timestamp_micros(F.floor((us(F.min) + us(F.max)) / 2))).cast("timestamp_ntz").alias("_from"))
    bars = live.candles(tick_stream(t), "1 hour")
    path, _ = live.run_available(bars)
    stored = t.bars_h1.crossJoin(F.broadcast(middle)).where("ts < _from").drop("_from")
    closed = t.spark.readStream.schema(bars.schema).parquet(path).crossJoin(F.broadcast(middle)).where("ts >= _from").drop("_from")
    d = live.closed_bar_signals(closed, warm=live.last_bars(stored))
    out, _ = live.run_available(d, store=live.ROCKS)
    return live.read_output(t.spark, out, d.schema)


@query("t04_stream_risk_screen", "event_id approved reasons", """SELECT event_id, len(r) = 0 AS approved, array_to_string(r, ',') AS reasons FROM (SELECT event_id, list_filter([CASE WHEN volume * 100 > 5000 THEN 'order_size' END, CASE WHEN price * volume * 100 / 20000 > 10 THEN 'leverage' END, CASE WHEN 1000 + price * volume * 100 > 50000 THEN 'total_exposure' END], lambda e: e IS NOT NULL) AS r FROM ticks)""")
def _(t):
    acc = t.ticks.select("instrument").distinct().select("instrument", F.lit(0.0).alias("position"), F.lit(20000.0).alias("balance"), F.lit(1000.0).alias("exposure"), F.lit(0.0).alias("daily_pnl"), F.lit(False).alias("breaker_active"))
    sig = tick_stream(t).select("event_id", "instrument", F.lit("BUY").alias("side"), (F.col("volume") * 100).alias("quantity"), F.col("price").alias("entry_price"), F.col("price").alias("stop"), (F.col("price") * F.col("volume") * 100).alias("value"))
    d = live.screen(sig, sr.materialise(acc), value=F.col("value")).select("event_id", "approved", F.array_join("reasons", ",").alias("reasons"))
    path, _ = live.run_available(d)
    return live.read_output(t.spark, path, d.schema)


@query("t05_stream_position_watch", "position_id exit_ts exit_reason", """SELECT position_id, min(k.ts) AS exit_ts, arg_min(CASE WHEN (side = 'BUY' AND bid <= stop) OR (side = 'SELL' AND ask >= stop) THEN 'stop_loss' ELSE 'take_profit' END, k.ts) AS exit_reason FROM positions p JOIN ticks k ON k.instrument = p.instrument AND k.ts > p.opened_at
   AND CASE WHEN side = 'BUY' THEN bid <= stop OR bid >= target ELSE ask >= stop OR ask <= target END GROUP BY position_id""")
def _(t):
    ticks = tick_stream(t)
    long = F.col("event_id") % 2 == 0
    pos = ticks.select(F.col("event_id").alias("position_id"), "instrument", F.when(long, "BUY").otherwise("SELL").alias("side"), F.when(long, F.col("price") * 0.8).otherwise(F.col("price") * 1.2).alias("stop"),
                       F.when(long, F.col("price") * 1.2).otherwise(F.col("price") * 0.8).alias("target"), F.col("ts").alias("opened_at"))
    path, _ = live.run_available(live.position_watch(pos, tick_stream(t)), each=live.close_positions)
    hits = live.read_batches(t.spark, path, live.HITS)
    return hits.groupBy("position_id").agg(F.min("exit_ts").alias("exit_ts"), F.min_by("exit_reason", "exit_ts").alias("exit_reason"))


@query("t06_stream_journal", "day instrument executions:i quantity:i notional:r2", "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, instrument, count(*) AS executions, sum(volume) AS quantity, sum(volume * price) AS notional FROM ticks GROUP BY 1, 2")
def _(t):
    d = live.journal_totals(tick_stream(t).withColumnRenamed("volume", "quantity"))
    path, _ = live.run_available(d, "update", each=live.upsert_batch)
    return live.latest_totals(t.spark, path, ["day", "instrument"])


@query("t07_stream_tick_quality", "event_id instrument issues", """SELECT event_id, instrument, issues FROM (SELECT event_id, instrument, array_to_string(list_filter([CASE WHEN bid >= ask THEN 'bid_not_below_ask' END, CASE WHEN (ask - bid) / nullif(bid, 0) > 0.005 THEN 'wide_spread' END, CASE WHEN abs((mid - pm) / nullif(pm, 0)) > 0.02 THEN 'price_jump' END, CASE WHEN ts < pt THEN 'out_of_order' END], lambda e: e IS NOT NULL), ',') AS issues
  FROM (SELECT *, lag(mid) OVER (PARTITION BY instrument ORDER BY event_id) AS pm, lag(ts) OVER (PARTITION BY instrument ORDER BY event_id) AS pt FROM (SELECT *, (bid + ask) / 2 AS mid FROM ticks))) WHERE issues <> ''""")
def _(t):
    path, _ = live.run_available(tick_stream(t), each=live.tick_quality)
    return live.read_batches(t.spark, path, live.ISSUES)


@query("t09_stream_alert_deduplication", "event_id instrument message:i ts", """SELECT a.event_id, a.instrument, a.message, a.ts FROM al1 a JOIN al2 s ON s.instrument = a.instrument AND s.message = a.message AND s.rn = a.rn WHERE s.kept""", **_ALERTS)
def _(t):
    d = live.spaced_alerts(tick_stream(t).select("event_id", "instrument", (F.col("volume") % 2).alias("message"), "ts"), ["instrument", "message"], 1200)
    path, _ = live.run_available(d)
    return live.read_output(t.spark, path, d.schema)


@query("k04_stream_control_state", "event_id ts kill_switch shadow_mode", _CONTROL)
def _(t):
    names = F.array(*[F.lit(x) for x in ("kill_switch_on", "kill_switch_off", "shadow_mode_on", "shadow_mode_off")])
    cmd = tick_stream(t).where("instrument = 'error'").select("ts", F.get(names, (F.col("volume") % 4).cast("int")).alias("action"))
    d = live.control_state(tick_stream(t).where("instrument = 'purchase'").select("event_id", "ts"), cmd)
    path, _ = live.run_available(d)
    return live.read_output(t.spark, path, d.schema)


@query("t08_stream_feed_staleness", "instrument last_ts status", "SELECT instrument, ts AS last_ts, CASE WHEN epoch(after) - epoch(ts) > 900 THEN 'critical' ELSE 'warning' END AS status FROM (SELECT *, lead(ts) OVER (PARTITION BY instrument ORDER BY ts) AS after FROM ticks) WHERE epoch(after) - epoch(ts) > 300")
def _(t):
    """Silences of over five and fifteen minutes; the delay keeps the timer from closing the last one."""
    d = live.feed_staleness(tick_stream(t).select("instrument", "ts"), 300, 900, "10 days")
    path, _ = live.run_available(d)
    return live.read_output(t.spark, path, d.schema)


@query("k03_stream_unique_signals", "user_id", "SELECT DISTINCT user_id FROM ticks")
def _(t):
    d = live.unique_signals(tick_stream(t).select("user_id", "ts"), key="user_id").select("user_id")
    path, _ = live.run_available(d)
    return live.read_output(t.spark, path, d.schema)
