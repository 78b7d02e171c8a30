"""Label queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import indicators as ind, labels as lb, series as sr, sessions as se
from barlume.plans import sqltext as q
from barlume.plans.registry import query

roll, lag, OVER = q.roll, q.lag, q.OVER


def lead(x: str, n: int) -> str:
    return f"lead({x}, {n}) OVER ({OVER})"


_REL = f"SELECT *, {lead('close', 8)} / nullif(close, 0) - 1 AS gross_ret, {lead('close', 8)} / nullif(close, 0) - 1 - 0.002 AS net_ret FROM bars_h1"


def with_cost(t):
    return t.bars_h1.withColumn("cost_est", F.lit(0.002))


@query("l01_forward_return", "instrument ts gross_ret:r net_ret:r y_opportunity:r y_direction:r", """SELECT *, CASE WHEN net_ret IS NOT NULL THEN CASE WHEN abs(net_ret) > 0.5 THEN 1 ELSE 0 END END AS y_opportunity,
  CASE WHEN net_ret > 0.5 THEN 1 WHEN net_ret < -0.5 THEN -1 WHEN net_ret IS NOT NULL THEN 0 END AS y_direction FROM rel""", rel=_REL)
def _(t):
    return lb.forward_return(with_cost(t), 8, 0.5)


@query("l02_forward_move", "instrument ts gross_ret:r net_ret:r y_opportunity:r y_direction:r", """SELECT *, CASE WHEN net_ret IS NOT NULL THEN CASE WHEN abs(net_ret) > 5 THEN 1 ELSE 0 END END AS y_opportunity,
  CASE WHEN abs(net_ret) > 5 THEN CASE WHEN net_ret > 0 THEN 1 ELSE 0 END END AS y_direction FROM mv""", mv=f"SELECT instrument, ts, {lead('close', 8)} - close AS gross_ret, {lead('close', 8)} - close - 0.002 AS net_ret FROM bars_h1")
def _(t):
    return lb.forward_move(with_cost(t), 8, 5.0)


_OPP = {
    "rel": _REL,
    "opp0": f"""SELECT *, {roll('avg', 'high - low', 14)} AS atr, day(ts) // 11 AS fold, CASE WHEN day(ts) % 11 < 7 THEN 'train' WHEN day(ts) % 11 < 9 THEN 'val' ELSE 'test' END AS split FROM rel""",
    "cut": "SELECT fold, quantile_cont(abs(net_ret), 0.7) AS q FROM opp0 WHERE split = 'train' GROUP BY fold",
    "opp1": "SELECT opp0.*, greatest(coalesce(q, 0.01), 0.01, 0.01 * coalesce(atr, 0)) AS threshold FROM opp0 LEFT JOIN cut USING (fold)",
    "opp2": """SELECT *, CASE WHEN abs(net_ret) > threshold THEN 1 ELSE 0 END AS y_opp, CASE WHEN abs(net_ret) > threshold THEN CASE WHEN net_ret > 0 THEN 1 ELSE 0 END ELSE -1 END AS y_dir FROM opp1""",
}


def opportunity(t):
    d = lb.forward_return(with_cost(t), 8, 0.0)
    d = sr.windowed(d.withColumn("_hl", F.col("high") - F.col("low")), sr.BARS, lambda x, w: x.withColumn("atr", ind.rolling(F.avg, "_hl", w, 14)), back=14)
    day = F.dayofmonth("ts")
    d = d.withColumns({"fold": F.floor(day / 11), "split": F.when(day % 11 < 7, "train").when(day % 11 < 9, "val").otherwise("test")})
    return lb.volatility_opportunity(d, "fold", "split", 0.7, 0.01, 0.01)


@query("l03_volatility_opportunity", "instrument ts fold:i split threshold:r y_opp:i y_dir:i", "SELECT * FROM opp2", **_OPP)
def _(t):
    return opportunity(t)


@query("l15_split_balance", "fold:i split opp_pos:r dir_long:r dir_short:r", """SELECT fold, split, avg(y_opp) AS opp_pos, avg(CASE WHEN y_dir <> -1 THEN CASE WHEN y_dir = 1 THEN 1.0 ELSE 0 END END) AS dir_long,
  avg(CASE WHEN y_dir <> -1 THEN CASE WHEN y_dir = 0 THEN 1.0 ELSE 0 END END) AS dir_short FROM opp2 GROUP BY fold, split""", **_OPP)
def _(t):
    return lb.split_balance(opportunity(t), ["fold", "split"])


_BRK = {"ms": f"SELECT *, 4 * {roll('stddev_pop', 'close', 20)} / (abs({roll('avg', 'close', 20)}) + 1e-9) AS bbw, ({'close'} - {roll('avg', 'close', 20)}) / ({roll('stddev_pop', 'close', 20)} + 1e-9) AS z FROM bars_h1",
        "bl": f"SELECT *, {q.rank_share('bbw', 252, 30)} AS bb_width_pct, {lead('close', 8)} / nullif(close, 0) - 1 - 0.002 AS net_ret FROM ms"}


def reversion_inputs(t):
    def build(d, w):
        m, sd = ind.rolling(F.avg, "close", w, 20), ind.rolling(F.stddev_pop, "close", w, 20)
        d = d.withColumns({"_bbw": 4 * sd / (F.abs(m) + 1e-9), "price_zscore": (F.col("close") - m) / (sd + 1e-9)})
        return lb._forward(d.withColumn("bb_width_pct", ind.rolling_rank("_bbw", w, 252, 30)), w, 8, True)

    d = sr.windowed(t.bars_h1, sr.BARS, build, back=280, ahead=8).withColumn("net_ret", F.col("gross_ret") - 0.002)
    return d.withColumn("y_opportunity", F.when(F.col("net_ret").isNotNull(), (F.abs("net_ret") > 0).cast("double")))


@query("l04_breakout_label", "instrument ts y_breakout:r", "SELECT instrument, ts, CASE WHEN net_ret IS NOT NULL THEN CASE WHEN bb_width_pct < 0.2 AND abs(net_ret) > 0.002 THEN 1 ELSE 0 END END AS y_breakout FROM bl", **_BRK)
def _(t):
    return lb.breakout_label(reversion_inputs(t))


@query("l05_reversion_label", "instrument ts y_mean_reversion:r", """SELECT instrument, ts, CASE WHEN net_ret IS NOT NULL THEN CASE WHEN abs(z) >= 1.5 AND ((z > 0 AND net_ret < -0.0015) OR (z < 0 AND net_ret > 0.0015))
  AND hour(ts) % 3 < 2 THEN 1 ELSE 0 END END AS y_mean_reversion FROM bl""", **_BRK)
def _(t):
    regime = F.when(F.hour("ts") % 3 < 2, "Range").otherwise("trend")
    return lb.reversion_label(reversion_inputs(t), in_range=lb.range_regime(regime))


_AHEAD = f"OVER ({OVER} ROWS BETWEEN 1 FOLLOWING AND 8 FOLLOWING)"


@query("l06_risk_label", "instrument ts y_vol:r y_atr:r", f"""SELECT instrument, ts, CASE WHEN count(*) {_AHEAD} >= 8 THEN stddev_pop(r) {_AHEAD} END AS y_vol, CASE WHEN count(*) {_AHEAD} >= 8 THEN avg(atr) {_AHEAD} END AS y_atr
  FROM (SELECT *, close / nullif({lag('close')}, 0) - 1 AS r, high - low AS atr FROM bars_h1)""")
def _(t):
    d = lb.risk_label(t.bars_h1).withColumnRenamed("y_risk", "y_vol").withColumn("atr", F.col("high") - F.col("low"))
    return lb.risk_label(d, method="future_atr").withColumnRenamed("y_risk", "y_atr")


@query("l07_regime_target", "instrument ts regime_target:i", f"""SELECT instrument, ts, CASE WHEN sp > 0.8 OR hour(ts) IN (22, 23, 0, 1, 2, 3, 4, 5) THEN 3 WHEN coalesce(vol_pct, 0) > 0.8 THEN 2
  WHEN abs(coalesce(slope, 0)) <= 0.002 AND a <= 0.18 THEN 1 WHEN abs(coalesce(slope, 0)) >= 0.008 AND a >= 0.25 THEN 0 ELSE 1 END AS regime_target FROM (
  SELECT *, coalesce(adx, 0) / CASE WHEN (SELECT max(adx) FROM rt) > 1.5 THEN 100 ELSE 1 END AS a, (rank() OVER (ORDER BY sv) + (count(*) OVER (PARTITION BY sv) - 1) / 2) / count(*) OVER () AS sp FROM rt)""",
       rt=f"""SELECT instrument, ts, (close / nullif({lag('close', 24)}, 0) - 1) / 24 AS slope, volume % 60 AS adx, {q.rank_share('volume', 252, 20)} AS vol_pct, coalesce(high - low, 0) AS sv FROM bars_h1""")
def _(t):
    def build(d, w):
        return d.withColumns({
            "slope": (F.col("close") / F.nullif(F.lag("close", 24).over(w), F.lit(0.0)) - 1) / 24, "adx": F.col("volume") % 60,
            "vol_pct": ind.rolling_rank("volume", w, 252, 20), "spread_est": F.col("high") - F.col("low"),
        })

    limits = {**lb.REGIME_LIMITS, "slope_low": 0.002, "slope_high": 0.008}
    return lb.regime_target(sr.windowed(t.bars_h1, sr.BARS, build, back=252), limits=limits)


# Barrier parameters by session used by the label queries.
BARRIERS = lb.BarrierConfig(
    take={"asia": 1.0, "pre_london": 1.1, "london_open": 1.5, "london_continuation": 1.4, "ny_open": 1.5, "ny_overlap_postdata": 1.3},
    stop={"asia": 1.0, "pre_london": 1.0, "london_open": 1.2, "london_continuation": 1.2, "ny_open": 1.3, "ny_overlap_postdata": 1.2},
    horizon={"asia": 6, "pre_london": 8, "london_open": 10, "london_continuation": 12, "ny_open": 12, "ny_overlap_postdata": 16},
    band={"asia": 0.05, "pre_london": 0.05, "london_open": 0.08, "london_continuation": 0.08, "ny_open": 0.1, "ny_overlap_postdata": 0.1},
    max_spread_for_exec=5.0,
)
_PARAMS = ", ".join(f"('{n}', {BARRIERS.take[n]}, {BARRIERS.stop[n]}, {BARRIERS.horizon[n]}, {BARRIERS.band[n]})" for n in se.SESSION_NAMES)
_BUCKET = "CASE " + " ".join(f"WHEN hour(ts) * 60 + minute(ts) < {end} THEN '{n}'" for n, _, end in se.SESSIONS) + " END"

TB = {
    "tb0": f"""SELECT *, {_BUCKET} AS sb, {roll('avg', 'high - low', 14)} AS v, CAST(1 + volume % 7 AS DOUBLE) AS spread, volume % 10 = 0 AS ev, row_number() OVER ({OVER}) AS rn FROM bars_h1""",
    "tb1": f"SELECT tb0.*, tp, sl, hz, nb FROM tb0 JOIN (VALUES {_PARAMS}) p(sb, tp, sl, hz, nb) USING (sb)",
    "tb2": """SELECT a.instrument, a.ts, min(CASE WHEN b.high >= a.close + a.tp * a.v THEN b.rn - a.rn END) AS up, min(CASE WHEN b.low <= a.close - a.sl * a.v THEN b.rn - a.rn END) AS dn, count(b.rn) AS h,
      arg_max(b.close, b.rn) AS fin, min(b.low) AS lo, max(b.high) AS hi FROM tb1 a LEFT JOIN tb1 b ON b.instrument = a.instrument AND b.rn > a.rn AND b.rn <= a.rn + a.hz GROUP BY a.instrument, a.ts""",
    "tb3": """SELECT a.*, up, dn, h, fin, lo, hi, v IS NULL OR v <= 0 AS bad, (fin - close) / (abs(close) + 1e-9) AS ret FROM tb1 a JOIN tb2 b ON a.instrument = b.instrument AND a.ts = b.ts""",
    "tb4": """SELECT *, CASE WHEN ev OR bad OR h = 0 THEN 0 WHEN up IS NOT NULL AND dn IS NOT NULL THEN CASE WHEN up < dn THEN 1 WHEN dn < up THEN -1 ELSE 0 END WHEN up IS NOT NULL THEN 1 WHEN dn IS NOT NULL THEN -1
      WHEN abs(ret) <= nb THEN 0 WHEN ret > 0 THEN 1 ELSE -1 END AS y, CASE WHEN ev THEN 0 WHEN bad THEN hz WHEN h = 0 THEN 0 ELSE coalesce(least(up, dn), h) END AS t FROM tb3""",
    "tb5": """SELECT *, CASE WHEN y > 0 THEN greatest(0, close - lo) WHEN y < 0 THEN greatest(0, hi - close) END / greatest(abs(v), 1e-9) AS mae_mult,
      CASE WHEN y > 0 THEN fin - close WHEN y < 0 THEN close - fin END - abs(close) * spread * 1e-4 - abs(close) * 0.5 * 1e-4 AS net_edge FROM tb4""",
    "labels_tb": """SELECT instrument, ts, sb AS session_bucket, mae_mult, net_edge, CASE WHEN NOT ev THEN y END AS y_dir, CASE WHEN NOT ev THEN CASE WHEN y <> 0 AND net_edge > 0 AND mae_mult <= 1.5 AND spread <= 5 THEN 1 ELSE 0 END END AS y_meta_exec,
      CASE WHEN ev THEN 'excluded_event' ELSE 'base' END AS label_state, CASE WHEN ev THEN 'excluded' WHEN t <= 0 THEN 'none' WHEN t <= 4 THEN '<= 4' WHEN t <= 8 THEN '<= 8' WHEN t <= 16 THEN '<= 16' WHEN t <= 32 THEN '<= 32' ELSE '> 32' END AS time_to_resolution_bucket,
      CASE WHEN ev THEN 0 ELSE t END AS label_horizon_bars FROM tb5""",
}


def barrier_labels(t):
    bars = t.bars_h1.withColumns({
        "session_bucket": se.session_bucket(), "spread_proxy_bps": (1 + F.col("volume") % 7).cast("double"),
        "event_window_flag": F.when(F.col("volume") % 10 == 0, 1).otherwise(0), "_hl": F.col("high") - F.col("low"),
    })
    bars = sr.windowed(bars, sr.BARS, lambda d, w: d.withColumn("atr14", ind.rolling(F.avg, "_hl", w, 14)), back=14)
    return lb.triple_barrier(bars, BARRIERS)


@query("l08_l09_triple_barrier", "instrument ts y_dir:i label_state label_horizon_bars:i", "SELECT * FROM labels_tb", **TB)
def _(t):
    return barrier_labels(t)


@query("l10_l11_path_quality_meta", "instrument ts mae_mult:r net_edge:r y_meta_exec:i", "SELECT * FROM labels_tb", **TB)
def _(t):
    return barrier_labels(t)


@query("l12_time_bucket", "time_to_resolution_bucket n:i", "SELECT time_to_resolution_bucket, count(*) AS n FROM labels_tb GROUP BY 1", **TB)
def _(t):
    return barrier_labels(t).groupBy("time_to_resolution_bucket").agg(F.count(F.lit(1)).alias("n"))


@query("l13_class_weights", "session_bucket y_dir:i weight:r", """SELECT s.session_bucket, c.y_dir, coalesce(s.n / (3 * c2.n), 0) AS weight FROM (SELECT session_bucket, count(*) AS n FROM labels_tb WHERE y_dir IS NOT NULL GROUP BY 1) s
  CROSS JOIN (VALUES (-1), (0), (1)) c(y_dir) LEFT JOIN (SELECT session_bucket, y_dir, count(*) AS n FROM labels_tb GROUP BY 1, 2) c2 ON c2.session_bucket = s.session_bucket AND c2.y_dir = c.y_dir""", **TB)
def _(t):
    return lb.class_weights(barrier_labels(t))


@query("l14_label_end", "instrument ts label_end_ts", f"SELECT instrument, ts, {lead('ts', 12)} AS label_end_ts FROM bars_h1")
def _(t):
    return lb.label_end(t.bars_h1, 12)
