"""Resampling and indicator queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import indicators as ind
from barlume.operators import resample as rs
from barlume.operators import series as sr
from barlume.plans import sqltext as q
from barlume.plans.registry import query

OHLCV = "instrument ts open:r high:r low:r close:r volume:i"


@query("j01_resample_h1", OHLCV, "SELECT * FROM bars_h1")
def _(t):
    return rs.ticks_to_bars(t.ticks, "1 hour")


@query("j01_resample_bars_m15_to_h4", OHLCV, """SELECT instrument, time_bucket(INTERVAL '4 hours', ts) AS ts,
  first(open ORDER BY ts) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume
  FROM bars_m15 GROUP BY instrument, time_bucket(INTERVAL '4 hours', ts)""")
def _(t):
    return rs.resample_bars(t.bars_m15, "4 hours")


@query("j02_tick_candles_mid", OHLCV, """SELECT instrument, time_bucket(INTERVAL '15 minutes', ts) AS ts,
  first((bid + ask) / 2 ORDER BY ts, event_id) AS open, max((bid + ask) / 2) AS high, min((bid + ask) / 2) AS low,
  last((bid + ask) / 2 ORDER BY ts, event_id) AS close, sum(volume) AS volume FROM ticks
  GROUP BY instrument, time_bucket(INTERVAL '15 minutes', ts)""")
def _(t):
    return rs.ticks_to_bars(rs.mid_price(t.ticks), "15 minutes")


@query("w01_sma", "instrument ts sma:r", f"SELECT instrument, ts, {q.roll('avg', 'close', 20)} AS sma FROM bars_h1")
def _(t):
    return ind.sma(t.bars_h1, 20)


@query("w02_ema", "instrument ts ema20:r ema50:r",
       q.ewm("bars_h1", {"ema20": ("close", 2 / 21, 1), "ema50": ("close", 2 / 51, 1)}))
def _(t):
    return ind.ema(t.bars_h1, {"ema20": 20, "ema50": 50})


@query("w03_ema_sma_seed", "instrument ts ema:r", q.ewm("seeded", {"ema": ("x", 2 / 13, 1)}),
       seeded=f"""SELECT instrument, ts, CASE WHEN rn = 12 THEN m WHEN rn > 12 THEN close END AS x FROM (
         SELECT *, row_number() OVER ({q.OVER}) AS rn, avg(close) OVER ({q.OVER} ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS m FROM bars_h1)""")
def _(t):
    return ind.ema_sma_seed(t.bars_h1, 12)


@query("w04_ema_bounded_buffer", "instrument ts ema:r",
       f"""SELECT instrument, ts, list_reduce(list(close) OVER ({q.OVER} ROWS BETWEEN 54 PRECEDING AND CURRENT ROW),
       lambda acc, v: v * {2 / 21!r} + acc * (1 - {2 / 21!r})) AS ema FROM bars_h1""")
def _(t):
    return sr.windowed(t.bars_h1, sr.BARS, lambda d, w: d.withColumn("ema", ind.ema_bounded("close", 20, 55, w)), back=54)


@query("w05_true_range", "instrument ts tr:r", f"SELECT instrument, ts, {q.TR} AS tr FROM bars_h1")
def _(t):
    return sr.windowed(t.bars_h1, sr.BARS, lambda d, w: d.withColumn("tr", ind.true_range(w)), back=1)


@query("w06_atr_wilder", "instrument ts atr:r", q.ewm("trs", {"atr": ("tr", 1 / 14, 14)}),
       trs=f"SELECT instrument, ts, {q.TR} AS tr FROM bars_h1")
def _(t):
    return ind.atr_wilder(t.bars_h1)


@query("w07_atr_simple", "instrument ts atr:r", f"SELECT instrument, ts, {q.roll('avg', 'tr', 14)} AS atr FROM trs",
       trs=f"SELECT instrument, ts, {q.TR} AS tr FROM bars_h1")
def _(t):
    return ind.atr_simple(t.bars_h1)


@query("w08_w10_rsi_adx_wilder", "instrument ts atr:r rsi:r adx:r", "SELECT * FROM wl", **q.wilder("bars_h1"))
def _(t):
    return ind.wilder(t.bars_h1)


_DELTA = f"SELECT *, close - {q.lag('close')} AS d FROM bars_h1"


@query("w09_rsi_simple", "instrument ts rsi:r", """SELECT *, CASE WHEN l = 0 THEN 100 WHEN l IS NOT NULL THEN 100 - 100 / (1 + g / l) END AS rsi FROM gl""",
       deltas=_DELTA,
       gl=f"""SELECT instrument, ts, {q.roll('avg', 'CASE WHEN d IS NOT NULL THEN greatest(d, 0) END', 14)} AS g,
       {q.roll('avg', 'CASE WHEN d IS NOT NULL THEN greatest(-d, 0) END', 14)} AS l FROM deltas""")
def _(t):
    return ind.rsi_simple(t.bars_h1)


def adx_simple_ctes(src: str, n: int = 14) -> dict[str, str]:
    return {
        "ax1": f"""SELECT *, {q.TR} AS tr, high - {q.lag('high')} AS up, {q.lag('low')} - low AS dn FROM {src}""",
        "ax2": """SELECT *, CASE WHEN up > dn AND up > 0 THEN up ELSE 0 END AS pdm, CASE WHEN dn > up AND dn > 0 THEN dn ELSE 0 END AS mdm FROM ax1""",
        "ax3": f"""SELECT *, 100 * {q.roll('sum', 'pdm', n)} / nullif({q.roll('avg', 'tr', n)}, 0) AS pdi,
          100 * {q.roll('sum', 'mdm', n)} / nullif({q.roll('avg', 'tr', n)}, 0) AS mdi FROM ax2""",
        "ax4": "SELECT *, coalesce(100 * abs(pdi - mdi) / nullif(pdi + mdi, 0), 0) AS dx FROM ax3",
        "ax5": f"SELECT *, {q.roll('avg', 'dx', n)} AS adx FROM ax4",
    }


@query("w11_adx_simple", "instrument ts adx:r", "SELECT * FROM ax5", **adx_simple_ctes("bars_h1"))
def _(t):
    return ind.adx_simple(t.bars_h1)


@query("w12_bollinger", "instrument ts bb_mid:r bb_upper:r bb_lower:r bb_width:r", """SELECT instrument, ts, m AS bb_mid,
   m + 2 * s AS bb_upper, m - 2 * s AS bb_lower, 4 * s / (abs(m) + 1e-9) AS bb_width FROM ms""",
       ms=f"SELECT instrument, ts, {q.roll('avg', 'close', 20)} AS m, {q.roll('stddev_pop', 'close', 20)} AS s FROM bars_h1")
def _(t):
    return ind.bollinger(t.bars_h1)


@query("w13_rolling_percentile_rank", "instrument ts pct_rank:r",
       f"SELECT instrument, ts, {q.rank_share('volume', 252, 30)} AS pct_rank FROM bars_h1")
def _(t):
    return ind.percentile_rank(t.bars_h1, "volume")


@query("w33_price_zscore", "instrument ts price_zscore:r", """SELECT instrument, ts, (close - m) / (s + 1e-9) AS price_zscore FROM ms""",
       ms=f"SELECT instrument, ts, close, {q.roll('avg', 'close', 20)} AS m, {q.roll('stddev_pop', 'close', 20)} AS s FROM bars_h1")
def _(t):
    return ind.zscore(t.bars_h1)


_EXT = "OVER (PARTITION BY instrument ORDER BY ts ROWS BETWEEN {} AND {})"


@query("w40_support_resistance", "instrument kind level_no:i level:r touches:i",
       """SELECT instrument, kind, level_no, avg(price) AS level, count(*) AS touches FROM (
       SELECT *, sum(f) OVER (PARTITION BY instrument, kind ORDER BY price ROWS UNBOUNDED PRECEDING) AS level_no FROM (
       SELECT *, CASE WHEN lag(price) OVER (PARTITION BY instrument, kind ORDER BY price) IS NULL
         OR NOT ((price - lag(price) OVER (PARTITION BY instrument, kind ORDER BY price)) / lag(price) OVER (PARTITION BY instrument, kind ORDER BY price) < 0.001)
         THEN 1 ELSE 0 END AS f FROM ext)) GROUP BY ALL""",
       tail="""SELECT *, row_number() OVER (PARTITION BY instrument ORDER BY ts) AS p FROM (SELECT * FROM (SELECT *,
         row_number() OVER (PARTITION BY instrument ORDER BY ts DESC) AS back FROM bars_h1) WHERE back <= 100)""",
       ext="""SELECT a.instrument, 'resistance' AS kind, a.high AS price FROM tail a JOIN tail b ON a.instrument = b.instrument AND b.p BETWEEN a.p - 5 AND a.p + 5 AND b.p <> a.p
         GROUP BY a.instrument, a.p, a.ts, a.high HAVING a.p BETWEEN 2 AND (SELECT max(p) - 1 FROM tail z WHERE z.instrument = a.instrument) AND max(b.high) < a.high
         UNION ALL SELECT a.instrument, 'support' AS kind, a.low AS price FROM tail a JOIN tail b ON a.instrument = b.instrument AND b.p BETWEEN a.p - 5 AND a.p + 5 AND b.p <> a.p
         GROUP BY a.instrument, a.p, a.ts, a.low HAVING a.p BETWEEN 2 AND (SELECT max(p) - 1 FROM tail z WHERE z.instrument = a.instrument) AND min(b.low) > a.low""")
def _(t):
    return ind.swing_levels(t.bars_h1)


@query("flagship_breakout_study", "instrument bars:i breakouts:i mean_fwd:r mean_atr:r",
       """SELECT instrument, count(*) AS bars, count(CASE WHEN hit THEN 1 END) AS breakouts, avg(CASE WHEN hit THEN fwd END) AS mean_fwd,
       avg(atr) AS mean_atr FROM study GROUP BY instrument""",
       study=f"""SELECT *, {q.roll('avg', 'tr', 14)} AS atr, close > {q.roll('avg', 'close', 20)} AND
         close > max(high) OVER ({q.OVER} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS hit,
         lead(close, 8) OVER ({q.OVER}) / nullif(close, 0) - 1 AS fwd FROM (SELECT *, {q.TR} AS tr FROM bars_h1)""")
def _(t):
    def build(d, w):
        d = d.withColumn("tr", ind.true_range(w))
        hit = (F.col("close") > ind.rolling(F.avg, "close", w, 20)) & (F.col("close") > F.max("high").over(w.rowsBetween(-20, -1)))
        fwd = F.lead("close", 8).over(w) / F.nullif(F.col("close"), F.lit(0.0)) - 1
        return d.withColumns({"atr": ind.rolling(F.avg, "tr", w, 14), "hit": hit, "fwd": fwd})

    rows = sr.windowed(t.bars_h1, sr.BARS, build, back=20, ahead=8)
    return rows.groupBy("instrument").agg(
        F.count(F.lit(1)).alias("bars"), F.count(F.when(F.col("hit"), 1)).alias("breakouts"),
        F.avg(F.when(F.col("hit"), F.col("fwd"))).alias("mean_fwd"), F.avg("atr").alias("mean_atr"),
    )
