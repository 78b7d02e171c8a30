"""Cleaning, validation, selection, sessions and alignment queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barlume.operators import align, quality, series as sr, sessions as se
from barlume.plans import sqltext as q
from barlume.plans.registry import query, view

# The configured instruments, in column order of wide frames.
INSTRUMENTS = ("click", "error", "purchase", "signup", "view")


@query("d01_dedupe_keep_first", "instrument ts seq:i price:r", "SELECT instrument, ts, min(seq) AS seq, arg_min(price, seq) AS price FROM fills GROUP BY instrument, ts")
def _(t):
    return quality.dedupe(t.fills.select("instrument", "ts", "seq", "price"), ["instrument", "ts"], ["seq"])


@query("d01_dedupe_keep_last", "instrument ts seq:i price:r", "SELECT instrument, ts, max(seq) AS seq, arg_max(price, seq) AS price FROM fills GROUP BY instrument, ts")
def _(t):
    return quality.dedupe(t.fills.select("instrument", "ts", "seq", "price"), ["instrument", "ts"], ["seq"], keep="last")


@query("v01_cadence_violations", "instrument ts gap_seconds:i", f"""SELECT instrument, ts, gap_seconds FROM (SELECT instrument, ts,
  epoch(ts) - epoch({q.lag('ts')}) AS gap_seconds FROM bars_m15) WHERE gap_seconds <> 900""")
def _(t):
    return quality.cadence_violations(t.bars_m15, 900)


@query("v02_load_checks", "issue n:i", """SELECT 'missing_timestamp' AS issue, count(*) FILTER (ts IS NULL) AS n FROM events
  UNION ALL SELECT 'not_increasing', count(*) FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events) WHERE ts < p
  UNION ALL SELECT 'non_numeric_price', count(*) FILTER (props IS NOT NULL AND try_cast(props AS DOUBLE) IS NULL) FROM events
  UNION ALL SELECT 'duplicate_timestamp', coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM events GROUP BY event_type, ts)""")
def _(t):
    rows = t.events.select("event_id", F.col("event_type").alias("instrument"), "ts", "props")
    s = sr.Series(keys=(), order=("event_id",), slice_by=F.floor(F.col("event_id") / 4096))
    return quality.load_checks(rows, "event_id", "props", s)


_RAW_BARS = """SELECT l_orderkey, nullif(l_tax, 0) * 500 AS open, l_quantity AS high, l_discount * 300 AS low, l_quantity - 1 AS close,
  l_linenumber - 2 AS volume FROM lineitem"""


@query("v03_bar_sanity", "issues n:i", """SELECT array_to_string(list_filter([CASE WHEN high < low THEN 'high_below_low' END,
  CASE WHEN high < open THEN 'high_below_open' END, CASE WHEN high < close THEN 'high_below_close' END, CASE WHEN low > open THEN 'low_above_open' END,
  CASE WHEN low > close THEN 'low_above_close' END, CASE WHEN volume < 0 THEN 'negative_volume' END,
  CASE WHEN open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL THEN 'missing_value' END], lambda e: e IS NOT NULL), ',') AS issues, count(*) AS n
  FROM raw_bars GROUP BY 1""", raw_bars=_RAW_BARS)
def _(t):
    bars = t.lineitem.select(
        (F.nullif(F.col("l_tax"), F.lit(0.0)) * 500).alias("open"), F.col("l_quantity").alias("high"), (F.col("l_discount") * 300).alias("low"),
        (F.col("l_quantity") - 1).alias("close"), (F.col("l_linenumber") - 2).alias("volume"),
    )
    return quality.bar_issues(bars).groupBy(F.array_join("issues", ",").alias("issues")).agg(F.count(F.lit(1)).alias("n"))


_OPEN = """(isodow({0}) <= 4 OR (isodow({0}) = 5 AND hour({0}) < 22) OR (isodow({0}) = 7 AND hour({0}) >= 21))"""


@query("v04_tick_quality", "event_id instrument issues", f"""SELECT event_id, instrument, array_to_string(list_filter([
  CASE WHEN bid >= ask THEN 'bid_not_below_ask' END, CASE WHEN (ask - bid) / nullif(bid, 0) > 0.005 THEN 'wide_spread' END,
  CASE WHEN abs((mid - pm) / nullif(pm, 0)) > 0.02 THEN 'price_jump' END, CASE WHEN ts < pt THEN 'out_of_order' END,
  CASE WHEN {_OPEN.format('arrival')} AND date_diff('second', date_trunc('second', ts), date_trunc('second', arrival)) > 10 THEN 'stale' END], lambda e: e IS NOT NULL), ',') AS issues
  FROM (SELECT *, lag(mid) OVER (PARTITION BY instrument ORDER BY ts, event_id) AS pm, lag(ts) OVER (PARTITION BY instrument ORDER BY ts, event_id) AS pt
    FROM (SELECT *, (bid + ask) / 2 AS mid, ts + to_seconds(user_id % 20) AS arrival FROM ticks))""")
def _(t):
    ticks = t.ticks.withColumn("arrival", align.plus_seconds(F.col("ts"), F.col("user_id") % 20))
    return quality.tick_issues(ticks, arrival="arrival").withColumn("issues", F.array_join("issues", ","))


@query("v05_market_open", "event_id open", f"SELECT event_id, {_OPEN.format('ts')} AS open FROM ticks")
def _(t):
    return t.ticks.select("event_id", quality.market_open(F.col("ts")).alias("open"))


@query("v06_normalise_raw_ticks", "instrument ts bid:r ask:r spread:r bid_volume:i", "SELECT instrument, ts, round(bid, 4) AS bid, round(ask, 4) AS ask, 0.02 AS spread, volume AS bid_volume FROM ticks")
def _(t):
    price = lambda c: F.round(c, 4).cast("decimal(18,4)").cast("string")
    level = lambda c: F.array(F.struct(price(c).alias("price"), F.col("volume").alias("liquidity")))
    micros = F.expr("date_format(ts, 'SSSSSS')")
    raw = t.ticks.select(F.to_json(F.struct(
        F.concat(sr.epoch_seconds("ts").cast("string"), F.lit("."), micros).alias("time"), "instrument",
        level("bid").alias("bids"), level("ask").alias("asks"),
    )).alias("payload"))
    return quality.normalise_raw_ticks(raw)


_SIG = """SELECT o_orderkey AS signal_id, CAST(floor(o_totalprice) AS BIGINT) - 100000 AS quantity, o_totalprice / 400000 AS confidence,
  o_orderpriority AS rationale FROM orders"""


def order_signals(t):
    return t.orders.select(
        F.col("o_orderkey").alias("signal_id"), (F.floor("o_totalprice") - 100000).alias("quantity"),
        (F.col("o_totalprice") / 400000).alias("confidence"), F.col("o_orderpriority").alias("rationale"),
    )


@query("v13_signal_contract", "signal_id violations", """SELECT signal_id, array_to_string(list_filter([CASE WHEN NOT coalesce(quantity > 0, false) THEN 'quantity' END,
  CASE WHEN NOT coalesce(confidence BETWEEN 0 AND 1, false) THEN 'confidence' END, CASE WHEN NOT coalesce(length(rationale) >= 10, false) THEN 'rationale' END], lambda e: e IS NOT NULL), ',') AS violations FROM sig_gaps""",
       sig=_SIG, sig_gaps="SELECT signal_id, CASE WHEN signal_id % 50 <> 7 THEN quantity END AS quantity, CASE WHEN signal_id % 60 <> 11 THEN confidence END AS confidence, CASE WHEN signal_id % 70 <> 13 THEN rationale END AS rationale FROM sig")
def _(t):
    k = F.col("signal_id")
    gaps = order_signals(t).withColumns({"quantity": F.when(k % 50 != 7, F.col("quantity")), "confidence": F.when(k % 60 != 11, F.col("confidence")), "rationale": F.when(k % 70 != 13, F.col("rationale"))})
    return quality.signal_contract(gaps).withColumn("violations", F.array_join("violations", ","))


@query("f01_drop_warmup", "instrument ts close:r", f"SELECT * FROM (SELECT *, row_number() OVER ({q.OVER}) AS rn FROM bars_h1) WHERE rn > 128")
def _(t):
    return quality.drop_warmup(t.bars_h1, 128)


_SHORT = "SELECT o_orderpriority AS name, 'X' AS config FROM orders GROUP BY o_orderpriority HAVING avg(o_totalprice) > (SELECT avg(o_totalprice) FROM orders)"


@query("f02_strategy_shortlist", "name config n:i", """SELECT name, config, count(*) AS n FROM (SELECT o_orderpriority AS name, o_orderstatus AS config FROM orders) c
  WHERE CASE WHEN EXISTS (SELECT 1 FROM orders o JOIN short s ON s.name = o.o_orderpriority AND s.config = o.o_orderstatus) THEN (name, config) IN (SELECT (name, config) FROM short)
  WHEN EXISTS (SELECT 1 FROM orders o JOIN short s ON s.name = o.o_orderpriority) THEN name IN (SELECT name FROM short) ELSE true END GROUP BY ALL""", short=_SHORT)
def _(t):
    cand = t.orders.select(F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("config"))
    mean = t.orders.agg(F.avg("o_totalprice").alias("_m"))
    short = t.orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("_a"))
    short = short.crossJoin(F.broadcast(mean)).where("_a > _m").select("name", F.lit("X").alias("config"))
    return quality.shortlist_filter(cand, short).groupBy("name", "config").agg(F.count(F.lit(1)).alias("n"))


@query("f03_min_history", "instrument ts close:r", "SELECT * FROM bars_h1 WHERE instrument IN (SELECT instrument FROM bars_h1 GROUP BY instrument HAVING count(*) >= 677)")
def _(t):
    return quality.instruments_with_history(t.bars_h1, 677)


_SUBS = "SELECT n_name AS strategy, ['click', 'error', 'purchase', 'signup', 'view'][n_nationkey % 5 + 1] AS instrument FROM nation"


def subscriptions(t):
    return t.nation.select(F.col("n_name").alias("strategy"), F.get(F.array(*[F.lit(i) for i in INSTRUMENTS]), (F.col("n_nationkey") % 5).cast("int")).alias("instrument"))


@query("f04_route_ticks", "strategy event_id", "SELECT strategy, event_id FROM ticks JOIN subs USING (instrument)", subs=_SUBS)
def _(t):
    return quality.route(t.ticks, subscriptions(t))


@query("f05_min_confidence", "signal_id confidence:r", "SELECT * FROM sig WHERE confidence >= 0.55", sig=_SIG)
def _(t):
    return quality.min_confidence(order_signals(t), 0.55)


# ------------------------------------------------------------------ sessions

_BUCKET = "CASE " + " ".join(f"WHEN hour(ts) * 60 + minute(ts) < {end} THEN '{n}'" for n, _, end in se.SESSIONS) + " END"


@view("anchored", f"""SELECT *, dh - dl AS dr, CASE WHEN dh - dl > 0 THEN (close - dl) / (dh - dl) END AS pos FROM (
  SELECT *, first(open) OVER sw AS so, row_number() OVER sw AS elapsed, max(high) OVER sw AS dh, min(low) OVER sw AS dl FROM (
  SELECT *, sum(fresh) OVER ({q.OVER} ROWS UNBOUNDED PRECEDING) AS session_id FROM (
  SELECT *, CASE WHEN session_bucket IS DISTINCT FROM {q.lag('session_bucket')} THEN 1 ELSE 0 END AS fresh FROM (
  SELECT *, {_BUCKET} AS session_bucket, CAST(ts AS DATE) AS trade_day FROM bars_h1)))
  WINDOW sw AS (PARTITION BY instrument, session_id ORDER BY ts ROWS UNBOUNDED PRECEDING))""")
def anchored(t):
    """Hourly bars with session anchors (the test month is in winter: London = UTC)."""
    return sr.materialise(se.session_anchors(t.bars_h1))


@query("w18_w19_session_bucket", "instrument ts session_bucket " + " ".join(f"session_{n}:i" for n in se.SESSION_NAMES),
       f"SELECT *, {', '.join(f'CASE WHEN session_bucket = {n!r} THEN 1 ELSE 0 END AS session_{n}' for n in se.SESSION_NAMES)} FROM (SELECT *, {_BUCKET} AS session_bucket FROM bars_m15)")
def _(t):
    d = t.bars_m15.withColumn("session_bucket", se.session_bucket())
    return d.select("*", *se.session_flags())


@query("w20_session_counts", "session_bucket bar_count:i", f"SELECT {_BUCKET} AS session_bucket, count(*) AS bar_count FROM bars_m15 GROUP BY 1")
def _(t):
    return t.bars_m15.groupBy(se.session_bucket().alias("session_bucket")).agg(F.count(F.lit(1)).alias("bar_count")).orderBy("session_bucket")


@query("w21_session_id", "instrument ts session_bucket session_id:i", "SELECT * FROM anchored")
def _(t):
    return se.with_sessions(t.bars_h1)


@query("w22_developing_state", "instrument ts current_session_open:r current_session_elapsed_bars:i current_session_developing_high:r current_session_developing_low:r current_session_developing_range:r current_close_position_in_session_range:r",
       "SELECT instrument, ts, so AS current_session_open, elapsed AS current_session_elapsed_bars, dh AS current_session_developing_high, dl AS current_session_developing_low, dr AS current_session_developing_range, pos AS current_close_position_in_session_range FROM anchored")
def _(t):
    return se.developing_state(se.with_sessions(t.bars_h1))


@query("v07_future_extreme_leaks", "instrument ts session_id:i leak_type full_extreme:r", """
  SELECT a.instrument, a.ts, a.session_id, 'high' AS leak_type, f.fh AS full_extreme FROM anchored a JOIN f USING (instrument, session_id) WHERE a.ts < f.th
  UNION ALL SELECT a.instrument, a.ts, a.session_id, 'low', f.fl FROM anchored a JOIN f USING (instrument, session_id) WHERE a.ts < f.tl AND a.dl = f.fl""",
       f="""SELECT instrument, session_id, max(high) AS fh, min(low) AS fl, arg_min(ts, (-high, ts)) AS th, arg_min(ts, (low, ts)) AS tl FROM anchored GROUP BY instrument, session_id""")
def _(t):
    # the high side is fed the full-session high on purpose, so leaks must show
    session = Window.partitionBy("instrument", "session_id")
    d = se.developing_state(se.with_sessions(t.bars_h1)).withColumn("leaky_high", F.max("high").over(session))
    return se.future_extreme_leaks(d, "leaky_high", "current_session_developing_low")


@query("v08_prior_session_constant", "instrument session_id:i level_name nunique:i", """SELECT instrument, session_id, 'high' AS level_name, count(DISTINCT high) AS nunique FROM anchored GROUP BY 1, 2 HAVING count(DISTINCT high) > 1""")
def _(t):
    # prior levels are constant; the moving bar high is checked along and must be reported
    return se.not_constant(t.anchored, ["instrument", "session_id"], ["prior_session_high", "prior_session_low", "prior_session_open", "prior_session_close", "high"])


@query("v08_prior_day_constant", "instrument trade_day level_name nunique:i", """SELECT instrument, trade_day, 'low' AS level_name, count(DISTINCT low) AS nunique FROM anchored GROUP BY 1, 2 HAVING count(DISTINCT low) > 1""")
def _(t):
    return se.not_constant(t.anchored, ["instrument", "trade_day"], ["prior_day_high", "prior_day_low", "prior_day_open", "prior_day_close", "low"])


# ------------------------------------------------------------------ alignment


@query("j03_asof_completed_h4", "instrument ts close:r h4_close:r", """SELECT b.instrument, b.ts, b.close, h.close AS h4_close FROM bars_m15 b
  ASOF LEFT JOIN done h ON b.instrument = h.instrument AND b.ts >= h.done""",
       gaps=f"SELECT instrument, epoch(ts) - epoch({q.lag('ts')}) AS g FROM bars_h4",
       done="""SELECT h.*, h.ts + to_seconds(CAST(m.g AS BIGINT)) AS done FROM bars_h4 h JOIN (SELECT instrument, arg_min(g, (-n, g)) AS g FROM
         (SELECT instrument, g, count(*) AS n FROM gaps WHERE g IS NOT NULL GROUP BY ALL) GROUP BY instrument) m USING (instrument)""")
def _(t):
    return align.align_completed(t.bars_m15, t.bars_h4.withColumnRenamed("close", "h4_close"), ["h4_close"])


@query("j04_ffill_completed_h1", "instrument ts h1_close:r h1_volume:i", """SELECT b.instrument, b.ts, h.close AS h1_close, h.volume AS h1_volume FROM bars_m15 b
  ASOF LEFT JOIN (SELECT *, ts + INTERVAL '1 hour' AS done FROM bars_h1) h ON b.instrument = h.instrument AND b.ts >= h.done""")
def _(t):
    h1 = t.bars_h1.select("instrument", "ts", F.col("close").alias("h1_close"), F.col("volume").alias("h1_volume"))
    return align.align_completed(t.bars_m15, h1, ["h1_close", "h1_volume"], step_seconds=3600)


@query("j05_previous_calendar_day", "instrument ts prev_day_high:r prev_day_low:r", """SELECT b.instrument, b.ts, d.h AS prev_day_high, d.l AS prev_day_low FROM bars_h1 b LEFT JOIN
  (SELECT instrument, CAST(ts AS DATE) + 1 AS day, max(high) AS h, min(low) AS l FROM bars_h1 GROUP BY 1, 2) d ON d.instrument = b.instrument AND d.day = CAST(b.ts AS DATE)""")
def _(t):
    return se.calendar_day_levels(t.bars_h1)


def _prior_sql(period: str, prefix: str) -> str:
    return f"""SELECT a.instrument, a.ts, p.h AS {prefix}_high, p.l AS {prefix}_low, p.o AS {prefix}_open, p.c AS {prefix}_close FROM anchored a JOIN (
      SELECT instrument, k, lag(h) OVER x AS h, lag(l) OVER x AS l, lag(o) OVER x AS o, lag(c) OVER x AS c FROM (SELECT instrument, {period} AS k, max(high) AS h, min(low) AS l,
      first(open ORDER BY ts) AS o, last(close ORDER BY ts) AS c FROM anchored GROUP BY 1, 2) WINDOW x AS (PARTITION BY instrument ORDER BY k)) p
      ON p.instrument = a.instrument AND p.k = a.{period}"""


@query("j06_prior_local_day", "instrument ts prior_day_high:r prior_day_low:r prior_day_open:r prior_day_close:r", _prior_sql("trade_day", "prior_day"))
def _(t):
    return se.prior_day_levels(t.bars_h1)


@query("j07_prior_session", "instrument ts prior_session_high:r prior_session_low:r prior_session_open:r prior_session_close:r", _prior_sql("session_id", "prior_session"))
def _(t):
    return se.prior_session_levels(se.with_sessions(t.bars_h1))


@query("j08_event_window", "instrument ts event_window_flag:i", """SELECT b.instrument, b.ts, CASE WHEN EXISTS (SELECT 1 FROM calendar c
  WHERE b.ts BETWEEN c.event_ts - INTERVAL '30 minutes' AND c.event_ts + INTERVAL '60 minutes') THEN 1 ELSE 0 END AS event_window_flag FROM bars_m15 b""")
def _(t):
    return align.event_window(t.bars_m15, t.calendar, 1800, 3600)


@query("j09_position_exits", "position_id exit_ts exit_reason", """SELECT position_id, arg_min(x.ts, (x.ts, x.event_id)) AS exit_ts, arg_min(x.reason, (x.ts, x.event_id)) AS exit_reason FROM positions p
  LEFT JOIN LATERAL (SELECT k.ts, k.event_id, CASE WHEN (p.side = 'BUY' AND k.bid <= p.stop) OR (p.side = 'SELL' AND k.ask >= p.stop) THEN 'stop_loss' ELSE 'take_profit' END AS reason
    FROM ticks k WHERE k.instrument = p.instrument AND k.ts > p.opened_at AND
    CASE WHEN p.side = 'BUY' THEN k.bid <= p.stop OR k.bid >= p.target ELSE k.ask >= p.stop OR k.ask <= p.target END) x ON true GROUP BY position_id""")
def _(t):
    path = t.ticks.select("instrument", "ts", "event_id", F.col("bid").alias("buy_lo"), F.col("bid").alias("buy_hi"), F.col("ask").alias("sell_lo"), F.col("ask").alias("sell_hi"))
    return align.first_crossing(t.positions.withColumnRenamed("opened_at", "start_ts"), path)


_LATEST = "SELECT instrument, arg_max(bid, (ts, event_id)) AS bid, arg_max(ask, (ts, event_id)) AS ask, max(ts) AS ts FROM ticks WHERE ts >= (SELECT max(ts) FROM ticks) - INTERVAL '1 hour' GROUP BY instrument"


@query("j10_unrealised_pnl", "instrument positions:i long_positions:i short_positions:i unrealised:r", """SELECT instrument, count(*) AS positions, count(*) FILTER (side = 'BUY') AS long_positions,
  count(*) FILTER (side = 'SELL') AS short_positions, round(sum(CASE WHEN side = 'BUY' THEN bid - entry ELSE entry - ask END * 10), 4) AS unrealised FROM positions LEFT JOIN latest USING (instrument) GROUP BY instrument""", latest=_LATEST)
def _(t):
    pnl = align.unrealised_pnl(t.positions.withColumn("quantity", F.lit(10)), align.latest_tick(t.ticks))
    return align.position_summary(pnl).withColumn("unrealised", F.round("unrealised", 4))


@query("s11_latest_tick", "instrument ts bid:r ask:r", "SELECT * FROM latest", latest=_LATEST)
def _(t):
    return align.latest_tick(t.ticks)


RETURNS = f"SELECT instrument, ts, close / nullif({q.lag('close')}, 0) - 1 AS ret FROM bars_h1"


@query("j11_pairwise_alignment", "ts a b ra:r rb:r", "SELECT x.ts, x.instrument AS a, y.instrument AS b, x.ret AS ra, y.ret AS rb FROM r x JOIN r y ON x.ts = y.ts AND x.instrument < y.instrument WHERE x.ret IS NOT NULL AND y.ret IS NOT NULL", r=RETURNS)
def _(t):
    return align.pairwise_aligned(align.wide_by_instrument(align.returns(t.bars_h1), "ret", INSTRUMENTS), INSTRUMENTS)


@query("j14_aligned_outcomes", "event_id prob:r y_true:i pnl:r", """SELECT event_id, prob, y_true, pnl FROM (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN 1 / (1 + price) END AS prob FROM ticks WHERE event_id % 3 <> 0) JOIN (SELECT event_id, CASE WHEN price > 50 THEN 1 ELSE 0 END AS y_true FROM ticks WHERE event_id % 4 <> 1) USING (event_id)
   JOIN (SELECT event_id, CASE WHEN volume % 5 <> 2 THEN price - 50 END AS pnl FROM ticks) USING (event_id) WHERE prob IS NOT NULL AND pnl IS NOT NULL""")
def _(t):
    k, px = F.col("event_id"), F.col("price")
    pred = t.ticks.where(k % 3 != 0).select("event_id", F.when(k % 7 != 0, 1 / (1 + px)).alias("prob"))
    label = t.ticks.where(k % 4 != 1).select("event_id", F.when(px > 50, 1).otherwise(0).alias("y_true"))
    return align.align_outcomes(pred, label, t.ticks.select("event_id", F.when(F.col("volume") % 5 != 2, px - 50).alias("pnl")), ["event_id"])


@query("w41_return_correlation", "a b corr:r", "SELECT x.instrument AS a, y.instrument AS b, corr(x.ret, y.ret) AS corr FROM r x JOIN r y ON x.ts = y.ts AND x.instrument < y.instrument GROUP BY 1, 2", r=RETURNS)
def _(t):
    return align.pair_correlations(align.wide_by_instrument(align.returns(t.bars_h1), "ret", INSTRUMENTS), INSTRUMENTS)


@query("j12_event_order", "n:i ts instrument timeframe close:r", """SELECT row_number() OVER (ORDER BY ts, instrument, s) AS n, * FROM (SELECT ts, instrument, 'H1' AS timeframe, 3600 AS s, close FROM bars_h1
  UNION ALL SELECT ts, instrument, 'H4', 14400, close FROM bars_h4 UNION ALL SELECT ts, instrument, 'D1', 86400, close FROM bars_d1)""")
def _(t):
    merged = align.merge_timeframes({"H1": (t.bars_h1, 3600), "H4": (t.bars_h4, 14400), "D1": (t.bars_d1, 86400)})
    return sr.running(merged, sr.Series(keys=(), order=("ts", "instrument", "tf_seconds")), row_no="n")


@query("s10_tick_range", "event_id instrument ts price:r", "SELECT * FROM ticks WHERE instrument = 'click' AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'")
def _(t):
    from barlume.sources.store import tick_range

    return tick_range(t.ticks, "click", "2024-01-05 00:00:00", "2024-01-12 00:00:00")
