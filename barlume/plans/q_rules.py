"""Rule-signal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import align, indicators as ind, rules as ru, series as sr
from barlume.plans import sqltext as q
from barlume.plans.q_market import adx_simple_ctes
from barlume.plans.q_quality import INSTRUMENTS
from barlume.plans.registry import query

roll, lag, OVER = q.roll, q.lag, q.OVER
SIG = "instrument ts direction:i entry_price:r stop:r target:r"


def prev(agg: str, x: str, n: int) -> str:
    f = f"OVER ({OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({x}) {f} >= {n} THEN {agg}({x}) {f} END"


def bounded(x: str, span: int, rows: int) -> str:
    a = 2 / (span + 1)
    return f"list_reduce(list({x}) OVER ({OVER} ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW), lambda acc, v: v * {a!r} + acc * (1 - {a!r}))"


STR_TR = f"CASE WHEN {lag('close')} IS NOT NULL THEN {q.TR} END"

# candidate direction per rule, brute force
CAND = {
    "Breakout": {"k_Breakout": f"SELECT *, CASE WHEN close > hi * 1.0002 THEN 1 WHEN close < lo * 0.9998 THEN -1 END AS direction FROM (SELECT *, {prev('max', 'high', 20)} AS hi, {prev('min', 'low', 20)} AS lo FROM bars_h1)"},
    "ATRBreakout": {"ab_tr": f"SELECT *, {STR_TR} AS tr FROM bars_h1",
                    "k_ATRBreakout": f"SELECT *, CASE WHEN close > hi + 1.2 * a THEN 1 WHEN close < lo - 1.2 * a THEN -1 END AS direction FROM (SELECT *, {prev('max', 'high', 30)} AS hi, {prev('min', 'low', 30)} AS lo, {roll('avg', 'tr', 14)} AS a FROM ab_tr)"},
    "EMAPullback": {"k_EMAPullback": f"""SELECT *, CASE WHEN n >= 50 THEN CASE WHEN f > s AND close <= f * (1 - 0.0008) THEN 1 WHEN f < s AND close >= f * (1 + 0.0008) THEN -1 END END AS direction FROM (
        SELECT *, {bounded('close', 20, 55)} AS f, {bounded('close', 50, 55)} AS s, row_number() OVER ({OVER}) AS n FROM bars_h1)"""},
    "MeanReversion": {"k_MeanReversion": f"SELECT *, CASE WHEN close < m * (1 - 0.0025) THEN 1 WHEN close > m * (1 + 0.0025) THEN -1 END AS direction FROM (SELECT *, {roll('avg', 'close', 30)} AS m FROM bars_h1)"},
    "RSIBollinger": {"rb0": f"SELECT *, close - {lag('close')} AS dd FROM bars_h1",
                     "rb1": f"SELECT *, {roll('avg', 'greatest(dd, 0) + 0 * dd', 14)} AS g, {roll('avg', 'greatest(-dd, 0) + 0 * dd', 14)} AS l, {roll('avg', 'close', 20)} AS m, {roll('stddev_pop', 'close', 20)} AS sd, row_number() OVER ({OVER}) AS n FROM rb0",
                     "rb2": "SELECT *, CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END AS rsi FROM rb1",
                     "k_RSIBollinger": "SELECT *, CASE WHEN n >= 21 THEN CASE WHEN close <= m - 2 * sd AND rsi <= 30 THEN 1 WHEN close >= m + 2 * sd AND rsi >= 70 THEN -1 END END AS direction FROM rb2"},
    "CompressionBreakout": {"cb_tr": f"SELECT *, {STR_TR} AS tr FROM bars_h1",
                            "k_CompressionBreakout": f"""SELECT *, CASE WHEN a <= 0.75 * b THEN CASE WHEN close > hi THEN 1 WHEN close < lo THEN -1 END END AS direction FROM (SELECT *, {prev('max', 'high', 20)} AS hi, {prev('min', 'low', 20)} AS lo,
                              {roll('avg', 'tr', 14)} AS a, {roll('avg', 'tr', 40)} AS b FROM cb_tr)"""},
}
EXITS = {n: (sl, tp, conf) for n, (_, sl, tp, conf) in ru.components().items()}


def emitted(name: str) -> str:
    """Sequential rule in SQL: keep a candidate when its direction changes."""
    sl, tp, conf = EXITS[name]
    return f"""SELECT instrument, ts, '{name}' AS strategy, direction, close AS entry_price, close * (1 - direction * {sl}) AS stop, close * (1 + direction * {tp}) AS target, {conf} AS confidence
      FROM (SELECT *, lag(direction) OVER ({OVER}) AS before FROM k_{name} WHERE direction IS NOT NULL) WHERE before IS NULL OR before <> direction"""


def _register(i: int, name: str) -> None:
    @query(f"r{i:02d}_{name.lower()}", SIG, emitted(name), **CAND[name])
    def _(t):
        rule, sl, tp, conf = ru.components()[name]
        return ru.signals(t.bars_h1, name, rule, sl, tp, conf)


for _i, _name in enumerate(CAND, 1):
    _register(_i, _name)

ALL = {k: v for c in CAND.values() for k, v in c.items()}
ALL_SIGNALS = " UNION ALL ".join(emitted(n) for n in CAND)


def _trend(src: str, name: str, fast: int, slow: int, rows: int) -> dict[str, str]:
    return {name: f"""SELECT * FROM (SELECT *, {bounded('close', fast, rows)} AS ema_fast, {bounded('close', slow, rows)} AS ema_slow, row_number() OVER ({OVER}) AS n FROM {src}) WHERE n >= {slow}"""}


@query("r07_trend_alignment", SIG, """SELECT b.instrument, b.ts, CASE WHEN b.ema_fast > b.ema_slow THEN 1 ELSE -1 END AS direction, b.close AS entry_price,
  b.ema_fast * (1 - (CASE WHEN b.ema_fast > b.ema_slow THEN 1 ELSE -1 END) * 0.002) AS stop, b.close * (1 + (CASE WHEN b.ema_fast > b.ema_slow THEN 1 ELSE -1 END) * 0.015) AS target
  FROM t_h1 b ASOF JOIN (SELECT *, ts + INTERVAL '4 hours' AS done FROM t_h4) h ON h.instrument = b.instrument AND b.ts >= h.done
  WHERE (b.ema_fast > b.ema_slow AND h.ema_fast > h.ema_slow AND b.close > b.ema_fast) OR (b.ema_fast <= b.ema_slow AND h.ema_fast <= h.ema_slow AND b.close < b.ema_fast)""",
       **_trend("bars_h1", "t_h1", 10, 20, 70), **_trend("bars_h4", "t_h4", 10, 20, 70))
def _(t):
    return ru.trend_alignment(t.bars_h1, [(t.bars_h4, 14400)], 10, 20)


_CF = {
    **_trend("bars_h4", "c_h4", 5, 10, 20),
    "cf0": f"SELECT instrument, ts, close, row_number() OVER ({OVER}) AS bar_no, close / nullif({lag('close', 12)}, 0) - 1 AS r FROM bars_h1",
    "cf1": """SELECT g.ts, g.bar_no, g.close, n.instrument, r.r, sign(h.ema_fast - h.ema_slow) AS d FROM (SELECT * FROM cf0 WHERE instrument = 'click') g CROSS JOIN (SELECT DISTINCT instrument FROM bars_h1) n
      ASOF LEFT JOIN cf0 r ON r.instrument = n.instrument AND g.ts >= r.ts ASOF LEFT JOIN (SELECT *, ts + INTERVAL '4 hours' AS done FROM c_h4) h ON h.instrument = n.instrument AND g.ts >= h.done""",
    "cf2": """SELECT ts, bar_no, close, max(d) FILTER (instrument = 'click') AS own, max(r) FILTER (instrument = 'click') - avg(r) FILTER (instrument <> 'click') AS strength, count(*) FILTER (instrument <> 'click' AND d > 0) AS up, count(*) FILTER (instrument <> 'click' AND d < 0) AS dn FROM cf1 GROUP BY 1, 2, 3""",
    "cf3": "SELECT *, CAST(own AS BIGINT) AS direction, CASE WHEN own > 0 THEN up ELSE dn END / nullif(up + dn, 0) AS alignment FROM cf2 WHERE own <> 0",
    "cf4": "SELECT *, row_number() OVER (ORDER BY bar_no) AS rn FROM cf3 WHERE alignment >= 0.5 AND direction * strength >= 0.0002",
    "cf5": """SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS last, CAST(-1000 AS BIGINT) AS at, false AS kept UNION ALL SELECT e.rn, CASE WHEN e.bar_no - s.at >= 8 AND e.direction <> s.last THEN e.direction ELSE s.last END,
      CASE WHEN e.bar_no - s.at >= 8 AND e.direction <> s.last THEN e.bar_no ELSE s.at END, e.bar_no - s.at >= 8 AND e.direction <> s.last FROM cf5 s JOIN cf4 e ON e.rn = s.rn + 1""",
}


@query("r08_intermarket_confluence", "instrument ts bar_no:i direction:i entry_price:r alignment:r strength:r", "SELECT 'click' AS instrument, ts, bar_no, direction, close AS entry_price, alignment, strength FROM cf4 JOIN cf5 USING (rn) WHERE kept", **_CF)
def _(t):
    return ru.confluence(t.bars_h1, [("H4", t.bars_h4, 14400)], "click", INSTRUMENTS[1:], fast=5, slow=10)


_TOVER = "PARTITION BY instrument ORDER BY ts, event_id"


@query("r09_ma_crossover", "event_id instrument ts direction:i confidence:r entry_price:r stop:r target:r", """SELECT event_id, instrument, ts, direction, least(abs((f - s) / s) * 10, 1) AS confidence, CASE WHEN direction > 0 THEN ask ELSE bid END AS entry_price,
   CASE WHEN direction > 0 THEN ask ELSE bid END - direction * 20 * 0.0001 AS stop, CASE WHEN direction > 0 THEN ask ELSE bid END + direction * 40 * 0.0001 AS target FROM (
   SELECT *, lag(direction) OVER (PARTITION BY instrument ORDER BY ts, event_id) AS before FROM mc2 WHERE direction IS NOT NULL) WHERE (before IS NULL OR before <> direction) AND least(abs((f - s) / s) * 10, 1) >= 0.2""",
       mc0=f"SELECT *, {roll('avg', '(bid + ask) / 2', 5, over=_TOVER)} AS f, {roll('avg', '(bid + ask) / 2', 20, over=_TOVER)} AS s FROM ticks",
       mc1=f"SELECT *, lag(f) OVER ({_TOVER}) AS pf, lag(s) OVER ({_TOVER}) AS ps FROM mc0",
       mc2="SELECT *, CASE WHEN pf <= ps AND f > s THEN 1 WHEN pf >= ps AND f < s THEN -1 END AS direction FROM mc1")
def _(t):
    return ru.price_tick_signal(ru.ma_crossover(t.ticks, 5, 20, 0.2), 20, 40)


@query("r10_rsi_crossing", "event_id instrument ts rsi:r direction:i confidence:r", """SELECT event_id, instrument, ts, rsi, direction, greatest(least((CASE WHEN direction > 0 THEN 30 - rsi ELSE rsi - 70 END) / 30, 1), 0.5) AS confidence FROM (
   SELECT *, CASE WHEN p >= 30 AND rsi < 30 THEN 1 WHEN p <= 70 AND rsi > 70 THEN -1 END AS direction FROM (SELECT *, lag(rsi) OVER (PARTITION BY instrument ORDER BY ts, event_id) AS p FROM rx2)) WHERE direction IS NOT NULL""",
       rx0=f"SELECT *, (bid + ask) / 2 - lag((bid + ask) / 2) OVER ({_TOVER}) AS d FROM ticks",
       rx1=f"SELECT *, {roll('avg', 'greatest(d, 0) + 0 * d', 14, over=_TOVER)} AS g, {roll('avg', 'greatest(-d, 0) + 0 * d', 14, over=_TOVER)} AS l FROM rx0",
       rx2="SELECT *, CASE WHEN l = 0 THEN 100 WHEN l IS NOT NULL THEN 100 - 100 / (1 + g / l) END AS rsi FROM rx1")
def _(t):
    return ru.rsi_crossing(t.ticks)


_SB = {
    **adx_simple_ctes("bars_m15"), **_trend("bars_h1", "b_h1", 20, 50, 300), **_trend("bars_h4", "b_h4", 20, 50, 300),
    "sb0": f"""SELECT *, abs(close - open) AS body, 4 * {roll('stddev_pop', 'close', 20)} / nullif({roll('avg', 'close', 20)}, 0) AS bw, {roll('avg', 'tr', 14)} AS atr, row_number() OVER ({OVER}) AS rn,
      max(CASE WHEN hour(ts) < 6 THEN high END) OVER dw AS rh, min(CASE WHEN hour(ts) < 6 THEN low END) OVER dw AS rl FROM ax5 WINDOW dw AS (PARTITION BY instrument, CAST(ts AS DATE) ORDER BY ts ROWS UNBOUNDED PRECEDING)""",
    "sb1": f"""SELECT *, {lag('atr', 5)} AS a5, {lag('bw', 5)} AS w5, CASE WHEN atr > {lag('atr')} THEN 1 WHEN {lag('atr')} IS NOT NULL THEN 0 END AS upf, count(atr) OVER ({OVER} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS n50,
      quantile_cont(atr, 0.3) OVER ({OVER} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS q30, avg(body) OVER ({OVER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mb, avg(volume) OVER ({OVER} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS mv FROM sb0""",
    "sb2": f"""SELECT *, sum(upf) OVER ({OVER} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ups FROM sb1""",
    "sb3": """SELECT s.*, coalesce(sign(h.ema_fast - h.ema_slow), 0) + coalesce(sign(g.ema_fast - g.ema_slow), 0) AS bias FROM sb2 s ASOF LEFT JOIN (SELECT *, ts + INTERVAL '1 hour' AS done FROM b_h1) h ON h.instrument = s.instrument AND s.ts >= h.done
      ASOF LEFT JOIN (SELECT *, ts + INTERVAL '4 hours' AS done FROM b_h4) g ON g.instrument = s.instrument AND s.ts >= g.done""",
    "sb4": """SELECT *, CASE WHEN close > rh AND bias > 0 THEN 1 WHEN close < rl AND bias < 0 THEN -1 END AS direction FROM sb3 WHERE rn >= 60 AND hour(ts) BETWEEN 6 AND 20 AND adx >= 10 AND atr > a5 AND ups >= 3 AND bw > w5 AND n50 >= 30 AND atr > q30 AND body > mb AND volume > mv""",
    "sb5": "SELECT *, CASE WHEN direction > 0 THEN least(low, close - 1.2 * atr) ELSE greatest(high, close + 1.2 * atr) END AS st FROM sb4 WHERE direction IS NOT NULL",
}


@query("r11_session_breakout", "instrument ts direction:i entry_price:r stop:r target:r adx:r atr:r quantity:i", """SELECT instrument, ts, direction, close AS entry_price, st AS stop, close + direction * abs(close - st) * 2 AS target, adx, atr,
   CASE WHEN abs(close - st) > 0 THEN greatest(1, least(floor(100 / abs(close - st)), 100000)) ELSE 1 END AS quantity FROM sb5""", **_SB)
def _(t):
    d = ru.session_breakout_candidates(t.bars_m15, [(t.bars_h1, 3600), (t.bars_h4, 14400)], adx_min=10.0, warm=60)
    return d.withColumn("quantity", ru.risk_quantity(10000, 0.01, F.abs(F.col("entry_price") - F.col("stop"))))


@query("r15_daily_limits", "instrument ts direction:i entry_price:r exit_ts exit_reason")
def _(t):
    """Candidate breaks, their exits on the bar path, then the daily cap."""
    sig = ru.signals(t.bars_m15, "Breakout", ru.donchian(10), 0.2, 0.4, changes_only=False)
    pos = sr.materialise(sig.select(
        F.concat_ws("|", "instrument", F.col("ts").cast("string")).alias("position_id"), "instrument", "ts", "direction", "entry_price",
        F.when(F.col("direction") > 0, "BUY").otherwise("SELL").alias("side"), "stop", "target",
    ))
    path = t.bars_m15.select("instrument", "ts", F.col("low").alias("buy_lo"), F.col("high").alias("buy_hi"), F.col("low").alias("sell_lo"), F.col("high").alias("sell_hi"))
    exits = align.first_crossing(pos.withColumn("start_ts", F.col("ts")), path, tie="ts")
    return ru.daily_limits(exits.select("instrument", "ts", "direction", "entry_price", "exit_ts", "exit_reason"))


COOL = {
    **ALL, "sigs": ALL_SIGNALS,
    "numbered": f"SELECT *, row_number() OVER ({OVER}) AS bar_no FROM bars_h1",
    "ev0": """SELECT v.instrument, v.ts, long_votes, short_votes, CASE WHEN long_votes >= 2 AND long_votes > short_votes THEN 1 WHEN short_votes >= 2 AND short_votes > long_votes THEN -1 END AS direction, b.bar_no, b.close
      FROM (SELECT instrument, ts, count(*) FILTER (direction = 1) AS long_votes, count(*) FILTER (direction = -1) AS short_votes FROM sigs GROUP BY 1, 2) v JOIN numbered b ON b.instrument = v.instrument AND b.ts = v.ts""",
    "ev1": "SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS rn FROM ev0 WHERE direction IS NOT NULL",
    "ev2": """SELECT instrument, CAST(0 AS BIGINT) AS rn, 0 AS last, CAST(-1000 AS BIGINT) AS kept_at, false AS kept FROM (SELECT DISTINCT instrument FROM ev1)
      UNION ALL SELECT e.instrument, e.rn, CASE WHEN e.bar_no - s.kept_at >= 5 AND e.direction <> s.last THEN e.direction ELSE s.last END,
      CASE WHEN e.bar_no - s.kept_at >= 5 AND e.direction <> s.last THEN e.bar_no ELSE s.kept_at END, e.bar_no - s.kept_at >= 5 AND e.direction <> s.last FROM ev2 s JOIN ev1 e ON e.instrument = s.instrument AND e.rn = s.rn + 1""",
}


@query("r12_r14_ensemble_cooldown", "instrument ts direction:i confidence:r entry_price:r", """SELECT e.instrument, e.ts, e.direction, greatest(e.long_votes, e.short_votes) / 6 AS confidence, e.close AS entry_price FROM ev1 e
  JOIN ev2 s ON s.instrument = e.instrument AND s.rn = e.rn WHERE s.kept""", **COOL)
def _(t):
    bars = sr.materialise(ru.bar_numbers(t.bars_h1))
    votes = ru.ensemble_votes(ru.all_signals(bars), bars, 6)
    return ru.cooldown(votes, 5)


_STYLE = "CASE WHEN regexp_matches(strategy, 'MeanReversion|RSI') THEN 'mean_reversion' WHEN regexp_matches(strategy, 'Breakout|Compression') THEN 'breakout' ELSE 'trend' END"
_MAPPED = "CASE hour(ts) % 3 WHEN 0 THEN 'EMAPullback' WHEN 1 THEN 'MeanReversion' ELSE 'ATRBreakout' END"


def regimes(t):
    mapped = F.when(F.hour("ts") % 3 == 0, "EMAPullback").when(F.hour("ts") % 3 == 1, "MeanReversion").otherwise("ATRBreakout")
    return t.bars_h1.select("instrument", "ts", mapped.alias("regime_strategy"))


@query("r13_regime_decision", "instrument ts direction:i score:r votes:i confidence:r entry_price:r stop:r target:r", f"""SELECT instrument, ts, CASE WHEN score > 0 THEN 1 ELSE -1 END AS direction, score, votes, least(1, abs(score)) AS confidence, entry_price, stop, target FROM (
  SELECT instrument, ts, sum(direction * confidence * CASE WHEN style = fits THEN 1.8 ELSE 0.7 END) AS score, count(*) AS votes, arg_min(entry_price, (-confidence, strategy)) AS entry_price, arg_min(stop, (-confidence, strategy)) AS stop,
  arg_min(target, (-confidence, strategy)) AS target FROM (SELECT *, {_STYLE} AS style, CASE {_MAPPED} WHEN 'EMAPullback' THEN 'trend' WHEN 'MeanReversion' THEN 'mean_reversion' ELSE 'breakout' END AS fits FROM sigs) GROUP BY 1, 2) WHERE abs(score) >= 0.25""",
       **ALL, sigs=ALL_SIGNALS)
def _(t):
    return ru.regime_decision(ru.all_signals(t.bars_h1), regimes(t))


@query("r16_regime_router", "event_id strategy", """SELECT event_id, CASE CAST(event_id % 4 AS BIGINT) WHEN 0 THEN 'EMAPullback' WHEN 1 THEN 'MeanReversion' ELSE 'Breakout' END AS strategy FROM ticks""")
def _(t):
    mapping = t.spark.createDataFrame([(0, "EMAPullback"), (1, "MeanReversion"), (2, "Retired")], "regime bigint, mapped string")
    d = t.ticks.select("event_id", (F.col("event_id") % 4).alias("regime"))
    return ru.route_regime(d, mapping, ["Breakout", "EMAPullback", "MeanReversion"], "Breakout")


_CENT = """SELECT label, list(m ORDER BY i) AS center FROM (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, range(1, 65) r(i) GROUP BY label, i) GROUP BY label"""


def centroids(t):
    """Element-wise mean per label: (label, position) averages, then one row."""
    e = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = m.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda p: p["m"]).alias("center"))
    return c.agg(F.sort_array(F.collect_list(F.struct(F.col("label").alias("regime"), "center"))).alias("centers"))


@query("r17_regime_assignment", "vec_id regime:i distance:r probability:r", """SELECT vec_id, arg_min(label, (d, label)) AS regime, min(d) AS distance, 1 / sum(exp(mn - d)) AS probability FROM (SELECT *, min(d) OVER (PARTITION BY vec_id) AS mn FROM (
  SELECT e.vec_id, c.label, list_sum(list_transform(range(1, 65), lambda i: pow(CAST(e.embedding[i] AS DOUBLE) - c.center[i], 2))) AS d FROM embeddings e CROSS JOIN cent c)) GROUP BY vec_id""", cent=_CENT)
def _(t):
    pts = t.embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return ru.assign_regime(pts, centroids(t))


_AGG = """SELECT instrument, ts, close, volume % 101 / 100.0 AS p_trade, (volume * 7) % 101 / 100.0 AS p_long, (volume * 13) % 101 / 100.0 AS p_short, (volume * 3) % 101 / 100.0 AS trend, (volume * 5) % 101 / 100.0 AS "range",
  (volume * 11) % 101 / 100.0 AS highvol, (volume * 17) % 101 / 100.0 AS lowliq, (volume * 19) % 101 / 100.0 AS p_breakout, (volume * 23) % 101 / 100.0 AS p_meanrev FROM bars_h1"""
_SCORE = """SELECT *, CASE WHEN p_trade >= 0.5 THEN (1 - 0.7 * lowliq) * p_trade * (p_long - p_short) * (1 + 0.5 * (0.6 * trend + 0.6 * highvol) * p_breakout + 0.5 * (0.8 * "range") * p_meanrev) ELSE 0 END AS score FROM ag0"""


def aggregated(t):
    p = lambda k: (F.col("volume") * k) % 101 / 100
    d = t.bars_h1.withColumns({"p_trade": p(1), "p_long": p(7), "p_short": p(13), "trend": p(3), "range": p(5), "highvol": p(11), "lowliq": p(17), "p_breakout": p(19), "p_meanrev": p(23)})
    return ru.aggregator_score(d)


@query("r18_aggregator_score", "instrument ts score:r", "SELECT * FROM ag1", ag0=_AGG, ag1=_SCORE)
def _(t):
    return aggregated(t)


@query("r19_hysteresis_side", "instrument ts score:r side:i", "SELECT x.instrument, x.ts, x.score, s.side FROM ag2 x JOIN ag5 s ON s.instrument = x.instrument AND s.rn = x.rn", ag0=_AGG, ag1=_SCORE,
       ag2=f"SELECT *, row_number() OVER ({OVER}) AS rn, sign(score) AS sg, abs(score) AS sz FROM ag1",
       ag5="""SELECT instrument, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS side, CAST(3 AS BIGINT) AS since FROM (SELECT DISTINCT instrument FROM ag2) UNION ALL
         SELECT instrument, rn, CASE WHEN want <> side AND since1 < 3 AND want <> 0 THEN side ELSE want END, CASE WHEN want <> side AND NOT (since1 < 3 AND want <> 0) THEN 0 ELSE since1 END FROM (
         SELECT x.instrument, x.rn, s.side, least(3, s.since + 1) AS since1, CASE WHEN s.side = 0 THEN CASE WHEN x.sz >= 0.05 THEN CAST(x.sg AS BIGINT) ELSE 0 END WHEN x.sg = s.side THEN s.side WHEN x.sz <= 0.02 THEN 0
           WHEN x.sg <> 0 AND x.sz >= 0.08 THEN CAST(x.sg AS BIGINT) ELSE s.side END AS want FROM ag5 s JOIN ag2 x ON x.instrument = s.instrument AND x.rn = s.rn + 1)""")
def _(t):
    return ru.side_state(aggregated(t).select("instrument", "ts", "score"))


@query("r20_gate_signal", "instrument ts signal:i", "SELECT instrument, ts, CASE WHEN p_trade > 0.6 THEN CASE WHEN p_long > p_short THEN 1 ELSE -1 END ELSE 0 END AS signal FROM ag0", ag0=_AGG)
def _(t):
    return aggregated(t).withColumn("signal", ru.gate_signal(F.col("p_trade"), F.col("p_long"), F.col("p_short"), F.lit(0.6)))


@query("r22_exit_levels", "instrument ts pct_stop:r pct_target:r pip_stop:r pip_target:r atr_stop:r atr_target:r", f"""SELECT instrument, ts, close * (1 - d * 0.004) AS pct_stop, close * (1 + d * 0.008) AS pct_target, close - d * 20 * 0.0001 AS pip_stop, close + d * 40 * 0.0001 AS pip_target,
  st AS atr_stop, close + d * abs(close - st) * 2 AS atr_target FROM (SELECT *, CASE WHEN d > 0 THEN least(low, close - 1.2 * atr) ELSE greatest(high, close + 1.2 * atr) END AS st FROM (SELECT *, CASE WHEN close > open THEN 1 ELSE -1 END AS d, {roll('avg', 'high - low', 14)} AS atr FROM bars_h1)) WHERE atr IS NOT NULL""")
def _(t):
    d = sr.windowed(t.bars_h1.withColumn("_hl", F.col("high") - F.col("low")), sr.BARS, lambda x, w: x.withColumn("atr", ind.rolling(F.avg, "_hl", w, 14)), back=14).where("atr IS NOT NULL")
    side, c = F.when(F.col("close") > F.col("open"), 1).otherwise(-1), F.col("close")
    a = ru.exits_by_pct(side, c, 0.004, 0.008)
    b = ru.exits_by_pips(side, c, 20, 40)
    e = ru.exits_by_atr(side, c, F.col("low"), F.col("high"), F.col("atr"))
    return d.select("instrument", "ts", *[x.alias(n) for x, n in zip((*a, *b, *e), ("pct_stop", "pct_target", "pip_stop", "pip_target", "atr_stop", "atr_target"))])


@query("r23_risk_quantity", "instrument ts quantity:i", "SELECT instrument, ts, CASE WHEN high - low > 0 THEN greatest(1, least(floor(100 / (high - low)), 100000)) ELSE 1 END AS quantity FROM bars_h1")
def _(t):
    return t.bars_h1.select("instrument", "ts", ru.risk_quantity(10000, 0.01, F.col("high") - F.col("low")).alias("quantity"))


@query("r24_entry_refinement", "signal_id status order_type price:r selected_bar:i", """SELECT signal_id, status, CASE WHEN status = 'ok' THEN CASE WHEN mom > 0.15 * a1 THEN 'market' ELSE 'limit' END END AS order_type,
  CASE WHEN status = 'ok' AND NOT mom > 0.15 * a1 THEN px - sg * 0.25 * sp END AS price, CASE WHEN status = 'ok' THEN i END AS selected_bar FROM (
  SELECT *, CASE WHEN i IS NULL THEN 'spread_too_wide' WHEN (px - entry_price) * sg > 0.5 * a1 THEN 'chase_guard' ELSE 'ok' END AS status, (px - frm) * sg AS mom FROM (
  SELECT s.signal_id, any_value(s.entry_price) AS entry_price, any_value(s.sg) AS sg, min(i) FILTER (good) AS i, arg_min(c, i) FILTER (good) AS px, coalesce(arg_min(a, i) FILTER (good), any_value(a0)) AS a1, arg_min(spr, i) FILTER (good) AS sp, arg_min(c, i) AS frm
  FROM (SELECT *, spr <= 0.25 * a0 AS good FROM (SELECT s.*, b.bar_no - s.b0 AS i, b.close AS c, b.atr AS a, b.spread AS spr, first_value(CASE WHEN b.atr > 0 THEN b.atr ELSE greatest(abs(b.close) * 0.001, 1e-6) END) OVER (PARTITION BY s.signal_id ORDER BY b.bar_no) AS a0
    FROM st s JOIN fb b ON b.instrument = s.instrument AND b.bar_no BETWEEN s.b0 AND s.b0 + 3)) s GROUP BY s.signal_id))""",
       fb=f"SELECT *, row_number() OVER ({OVER}) AS bar_no, {roll('avg', 'high - low', 14)} AS atr, CAST(1 + volume % 7 AS DOUBLE) AS spread FROM bars_m15",
       st="""SELECT t.event_id AS signal_id, t.instrument, CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END AS sg, price AS entry_price, min(b.bar_no) AS b0 FROM ticks t JOIN fb b ON b.instrument = t.instrument AND b.ts >= t.ts GROUP BY ALL""")
def _(t):
    bars = sr.windowed(ru.bar_numbers(t.bars_m15).withColumn("_hl", F.col("high") - F.col("low")), sr.BARS, lambda d, w: d.withColumn("atr", ind.rolling(F.avg, "_hl", w, 14)), back=14)
    bars = sr.materialise(bars.select("instrument", "ts", "bar_no", "close", "atr", (1 + F.col("volume") % 7).cast("double").alias("spread")))
    sig = t.ticks.select(F.col("event_id").alias("signal_id"), "instrument", "ts", F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("price").alias("entry_price"))
    return ru.refine_entries(sig, bars)
