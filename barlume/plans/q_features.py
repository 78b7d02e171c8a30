"""Feature-frame queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.functions import costs
from barlume.operators import evaluate, features as fe, indicators as ind, quality, series as sr, sessions as se
from barlume.plans import sqltext as q
from barlume.plans.q_quality import _prior_sql
from barlume.plans.registry import query, sql_view, view

roll, lag, OVER = q.roll, q.lag, q.OVER


sql_view("day_levels", _prior_sql("trade_day", "prior_day"))
sql_view("session_levels", _prior_sql("session_id", "prior_session"))


@view("feature_base", """SELECT a.* EXCLUDE (so, elapsed, dh, dl, dr, pos), so AS current_session_open, elapsed AS current_session_elapsed_bars, dh AS current_session_developing_high,
   dl AS current_session_developing_low, dr AS current_session_developing_range, pos AS current_close_position_in_session_range,
   d.* EXCLUDE (instrument, ts), s.* EXCLUDE (instrument, ts), CAST(1 + volume % 7 AS DOUBLE) AS spread_proxy_bps, CASE WHEN volume % 10 = 0 THEN 1 ELSE 0 END AS event_window_flag
   FROM anchored a JOIN day_levels d ON d.instrument = a.instrument AND d.ts = a.ts JOIN session_levels s ON s.instrument = a.instrument AND s.ts = a.ts""")
def feature_base(t):
    """Anchored hourly bars with a spread proxy and an event flag from the volume."""
    return t.anchored.withColumns({
        "spread_proxy_bps": (1 + F.col("volume") % 7).cast("double"),
        "event_window_flag": F.when(F.col("volume") % 10 == 0, 1).otherwise(0),
    })


def cols(names) -> str:
    return "instrument ts " + " ".join(f"{n}:r" for n in names)


def sdiv(a: str, b: str) -> str:
    return f"({a}) / (abs({b}) + 1e-9)"


def flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 1.0 ELSE 0.0 END"


@query("w43_bar_shape", "instrument ts typical_price:r body:r upper_wick:r lower_wick:r is_bullish bar_range:r", """SELECT instrument, ts, (high + low + close) / 3 AS typical_price, abs(close - open) AS body,
  high - greatest(open, close) AS upper_wick, least(open, close) - low AS lower_wick, close > open AS is_bullish, high - low AS bar_range FROM bars_h1""")
def _(t):
    return fe.bar_shape(t.bars_h1)


BASE_CTES = {
    **q.wilder("bars_h1", prefix="fw"),
    "fw_a": f"""SELECT *, greatest(high - low, 0) AS rng, {roll('stddev_pop', 'close', 20)} AS sd, {roll('avg', 'close', 20)} AS m FROM fw""",
    "fw_b": "SELECT *, 4 * sd / (abs(m) + 1e-9) AS bbw FROM fw_a",
    "base_feats": f"""SELECT instrument, ts, close / nullif({lag('close')}, 0) - 1 AS ret_1, close / nullif({lag('close', 4)}, 0) - 1 AS ret_4, atr AS atr_14, rsi / 100 AS rsi_14, adx / 100 AS adx_14,
      abs(close - open) / (rng + 1e-9) AS body_pct, greatest(high - greatest(open, close), 0) / (rng + 1e-9) AS upper_wick_pct, greatest(least(open, close) - low, 0) / (rng + 1e-9) AS lower_wick_pct,
      (close - low) / (rng + 1e-9) AS close_pos_in_range, sin(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS session_sin, cos(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440) AS session_cos,
      {q.rank_share('bbw', 252, 30)} AS bb_width_pct, {q.rank_share('atr', 252, 30)} AS atr_pct, 0.0 / (abs(close) + 1e-9) AS spread_feat, {q.rank_share('volume', 252, 30)} AS vol_pct FROM fw_b""",
}


@query("w14_base_features", cols(fe.SEQ_COLUMNS), "SELECT * FROM base_feats", **BASE_CTES)
def _(t):
    return fe.base_frame(t.bars_h1)


_CTX = ("dist_prev_high", "dist_prev_low", "asia", "london", "ny")


def _slow_sql(src: str, p: str, k: int) -> dict[str, str]:
    return {**q.wilder(src, prefix=f"w{p}"), f"ctx_{p}": f"""SELECT instrument, ts, (close / ({lag('close', k)} + 1e-9) - 1) / {k} AS {p}_slope, adx / 100 AS {p}_adx, {q.rank_share('volume', 252, 20)} AS {p}_vol_pct FROM w{p}"""}


@query("w15_context_features", cols(fe.CONTEXT + _CTX), """SELECT b.instrument, b.ts, coalesce(h1_slope, 0) AS h1_slope, coalesce(h4_slope, 0) AS h4_slope, coalesce(h1_adx, 0) AS h1_adx, coalesce(h4_adx, 0) AS h4_adx,
   coalesce(h1_vol_pct, 0) AS h1_vol_pct, coalesce(h4_vol_pct, 0) AS h4_vol_pct, coalesce((b.close - d.h) / (b.atr + 1e-9), 0) AS dist_prev_high, coalesce((b.close - d.l) / (b.atr + 1e-9), 0) AS dist_prev_low,
   CASE WHEN hour(b.ts) < 8 THEN 1 ELSE 0 END AS asia, CASE WHEN hour(b.ts) BETWEEN 8 AND 12 THEN 1 ELSE 0 END AS london, CASE WHEN hour(b.ts) BETWEEN 13 AND 21 THEN 1 ELSE 0 END AS ny FROM ab b
   ASOF LEFT JOIN (SELECT *, ts + INTERVAL '1 hour' AS done FROM ctx_h1) x ON x.instrument = b.instrument AND b.ts >= x.done
   ASOF LEFT JOIN (SELECT *, ts + INTERVAL '4 hours' AS done FROM ctx_h4) y ON y.instrument = b.instrument AND b.ts >= y.done
   LEFT JOIN (SELECT instrument, CAST(ts AS DATE) + 1 AS day, max(high) AS h, min(low) AS l FROM bars_m15 GROUP BY 1, 2) d ON d.instrument = b.instrument AND d.day = CAST(b.ts AS DATE)""",
       **_slow_sql("bars_h1", "h1", 24), **_slow_sql("bars_h4", "h4", 12),
       trm=f"SELECT *, {q.TR} AS tr FROM bars_m15", ab=q.ewm("trm", {"atr": ("tr", 1 / 14, 14)}))
def _(t):
    return fe.context_frame(t.bars_m15, t.bars_h1, t.bars_h4)


@query("w16_lag_expansion", cols([f"{c}_lag{k}" for c in ("ret_1", "body_pct", "upper_wick_pct") for k in (1, 2, 3)]),
       "SELECT instrument, ts, " + ", ".join(f"{lag(c, k)} AS {c}_lag{k}" for c in ("ret_1", "body_pct", "upper_wick_pct") for k in (1, 2, 3)) + " FROM sb",
       sb=f"""SELECT instrument, ts, close / nullif({lag('close')}, 0) - 1 AS ret_1, abs(close - open) / (high - low + 1e-9) AS body_pct, (high - greatest(open, close)) / (high - low + 1e-9) AS upper_wick_pct FROM bars_h1""")
def _(t):
    def build(d, w):
        rng = F.col("high") - F.col("low") + 1e-9
        return d.withColumns({"ret_1": ind.pct_change("close", 1, w), "body_pct": F.abs(F.col("close") - F.col("open")) / rng,
                              "upper_wick_pct": (F.col("high") - F.greatest("open", "close")) / rng})

    return fe.lag_expansion(sr.windowed(t.bars_h1, sr.BARS, build, back=1), ("ret_1", "body_pct", "upper_wick_pct"))


@query("w17_sequence_windows", "instrument ts sequence", f"""SELECT instrument, ts, list([CAST(close AS FLOAT), CAST(volume AS FLOAT)]) OVER ({OVER} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) AS sequence FROM bars_h1
  QUALIFY count(*) OVER ({OVER} ROWS BETWEEN 15 PRECEDING AND CURRENT ROW) = 16""")
def _(t):
    return fe.pack_sequences(t.bars_h1, ("close", "volume"), 16)


@query("v10_causality_base_features", "compared:i mismatches:i", "SELECT count(*) AS compared, 0 AS mismatches FROM bars_h1 WHERE ts <= TIMESTAMP '2024-01-15'")
def _(t):
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return quality.causality_check(t.bars_h1, cut, fe.base_frame, fe.SEQ_COLUMNS)


SHARED_CTES = {
    "sh0": f"""SELECT *, {q.TR} AS tr, close - {lag('close')} AS dc, abs(close - {lag('close', 8)}) AS n8, abs(close - {lag('close', 16)}) AS n16, {lag('close')} AS lc, close / nullif({lag('close')}, 0) - 1 AS sf_ret1 FROM feature_base""",
    "sh1": f"""SELECT *, {roll('avg', 'tr', 14)} AS atr, {roll('avg', 'tr', 48)} AS atr48, {roll('avg', 'tr', 96)} AS atr96, {roll('sum', 'abs(dc)', 8)} AS g8, {roll('sum', 'abs(dc)', 16)} AS g16,
      {flag(f"close > {roll('avg', 'lc', 12)}")} AS above, abs(high - low) AS rng, abs(close - open) AS bd, greatest(high - greatest(open, close), 0) AS uw, greatest(least(open, close) - low, 0) AS lw FROM sh0""",
    "sh2": f"SELECT *, {lag('above')} AS above1 FROM sh1",
    "shared": f"""SELECT *, rng AS sf_realized_range, atr AS sf_vol_scale_atr14, bd AS sf_candle_body, uw AS sf_upper_wick, lw AS sf_lower_wick, {sdiv('bd', 'rng')} AS sf_body_to_range_ratio, {sdiv('uw - lw', 'rng')} AS sf_wick_asymmetry,
      {sdiv('atr', 'atr48')} AS sf_compression_ratio_14_48, {sdiv('atr', 'atr96')} AS sf_expansion_ratio_14_96, {sdiv('n8', 'g8')} AS sf_directional_efficiency_8, {sdiv('n16', 'g16')} AS sf_directional_efficiency_16, n8 AS sf_net_move_8,
      g8 AS sf_gross_move_8, {roll('avg', 'above1', 12)} AS sf_short_persistence_above_anchor12, {sdiv('close - prior_day_high', 'atr')} AS sf_dist_prior_day_high_atr, {sdiv('close - prior_day_low', 'atr')} AS sf_dist_prior_day_low_atr,
      {sdiv('close - prior_session_high', 'atr')} AS sf_dist_prior_session_high_atr, {sdiv('close - prior_session_low', 'atr')} AS sf_dist_prior_session_low_atr, spread_proxy_bps AS sf_spread_proxy, {sdiv('spread_proxy_bps', 'rng')} AS sf_spread_range_ratio FROM sh2""",
}


@query("w23_shared_features", cols(fe.SHARED), "SELECT * FROM shared", **SHARED_CTES)
def _(t):
    return fe.shared_features(t.feature_base)


def _short_sql() -> dict[str, str]:
    lags = ", ".join(f"{lag(x, k)} AS sf_ctx_{y}_lag_{k}" for k in (1, 2, 3, 4, 8) for x, y in (("ret_atr", "ret_atr"), ("body_atr", "body_atr"), ("range_atr", "range_atr"), ("sf_ret1", "ret1")))
    prev = lambda agg, x, n: f"CASE WHEN count({x}) OVER ({OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) >= {n} THEN {agg}({x}) OVER ({OVER} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING) END"
    ns = (8, 16, 32, 64)
    s1 = ", ".join(f"{prev('max', 'high', n)} AS ph{n}, {prev('min', 'low', n)} AS pl{n}, close - {lag('close', n)} AS net{n}" for n in ns)
    s2 = ", ".join(f"{flag(f'close > ph{n}')} AS au{n}, {flag(f'close < pl{n}')} AS ad{n}, {flag(f'high > ph{n} AND close < ph{n}')} AS rh{n}, {flag(f'low < pl{n} AND close > pl{n}')} AS rl{n}" for n in ns)
    s3 = ", ".join(f"""{sdiv(f'net{n}', 'atr')} AS sf_ctx_net_move_atr_{n}, abs(net{n}) / ({roll('sum', 'abs(dc)', n)} + 1e-9) AS sf_ctx_eff_ratio_{n}, abs({roll('avg', 'sgn', n)}) AS sf_ctx_momo_persist_{n}, {roll('avg', 'flip', n)} AS sf_ctx_reversal_flip_rate_{n},
      {roll('sum', f'au{n}', n)} AS sf_ctx_break_accept_up_count_{n}, {roll('sum', f'ad{n}', n)} AS sf_ctx_break_accept_dn_count_{n}, {roll('sum', f'rh{n}', n)} AS sf_ctx_sweep_reject_high_count_{n}, {roll('sum', f'rl{n}', n)} AS sf_ctx_sweep_reject_low_count_{n},
      {sdiv(roll('avg', 'tr', max(4, n // 2)), roll('avg', 'tr', n))} AS sf_ctx_comp_exp_ratio_{n}""" for n in ns)
    return {
        "sc0": f"SELECT *, {sdiv('dc', 'atr')} AS ret_atr, {sdiv('close - open', 'atr')} AS body_atr, {sdiv('rng', 'atr')} AS range_atr, sign(dc) AS sgn FROM shared",
        "sc1": f"SELECT *, {lags}, {s1}, CASE WHEN sgn = {lag('sgn')} THEN 0.0 ELSE 1.0 END AS flip FROM sc0",
        "sc2": f"SELECT *, {s2} FROM sc1",
        "sc3": f"SELECT *, {s3} FROM sc2",
    }


@query("w24_short_horizon_context", cols(fe.short_context_names()), "SELECT * FROM sc3", **SHARED_CTES, **_short_sql())
def _(t):
    return fe.short_context(t.feature_base)


def _slow_ctx_sql(per_day: int) -> dict[str, str]:
    a, b = [], []
    for k in (10, 20, 40):
        n = max(k * per_day, 96)
        e, least = max(8, n // 8), max(96, n // 4)
        a.append(f"abs(close - {lag('close', e)}) / ({roll('sum', 'abs(dc)', e)} + 1e-9) AS eff{k}")
        f = f"OVER ({OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        for nm, p in (("lo", 0.25), ("mid", 0.5), ("hi", 0.75)):
            a.append(f"CASE WHEN count(atr) {f} >= {least} THEN quantile_cont(atr, {p}) {f} END AS {nm}{k}")
        b.append(f"""{sdiv('atr', f'mid{k}')} AS sf_regime_vol_med_ratio_{k}d, {sdiv(f'atr - mid{k}', f'hi{k} - lo{k}')} AS sf_regime_vol_iqr_norm_{k}d, {sdiv('sf_spread_proxy', roll('avg', 'tr', n, least))} AS sf_regime_spread_range_ratio_{k}d,
          {roll('avg', f'eff{k}', max(16, n // 8), max(16, n // 16))} AS sf_regime_trend_eff_mean_{k}d, {roll('stddev_pop', 'sf_ret1', n, least)} AS sf_regime_ret_vol_{k}d, {roll('avg', 'event_window_flag', n, least)} AS sf_regime_event_intensity_{k}d""")
    return {"sl0": f"SELECT *, {', '.join(a)} FROM shared", "sl1": f"SELECT *, {', '.join(b)} FROM sl0"}


@query("w25_slow_regime_context", cols(fe.slow_context_names()), "SELECT * FROM sl1", **SHARED_CTES, **_slow_ctx_sql(12))
def _(t):
    return fe.slow_context(t.feature_base, bars_per_day=12)


@query("w26_strided_lag_context", cols(fe.strided_names()), "SELECT instrument, ts, " + ", ".join(f"{lag(x, k)} AS sf_seq_{x}_l{k:03d}" for k in range(1, 129, 8) for x in ("ret_atr", "body_atr", "range_atr")) + " FROM sc0",
       **SHARED_CTES, sc0=_short_sql()["sc0"])
def _(t):
    return fe.strided_context(t.feature_base)


_IN = {"e": "('asia', 'pre_london')", "l": "('london_open', 'london_continuation')", "n": "('ny_open', 'ny_overlap_postdata')"}
_TRANS = (f"{lag('session_bucket')} IN {_IN['e']} AND session_bucket IN {_IN['l']}", f"{lag('session_bucket')} IN {_IN['l']} AND session_bucket IN {_IN['n']}")


def _structure_sql(ns) -> dict[str, str]:
    out = []
    for n in ns:
        m = max(8, n // 4)
        out += [f"{roll(a, x, n, m)} AS ss_ctx_{y}_{n}" for a, x, y in (("sum", "fh", "repeat_fail_high"), ("sum", "fl", "repeat_fail_low"), ("sum", "ch", "repeat_cont_high"),
                ("sum", "cl", "repeat_cont_low"), ("avg", "abs(disp)", "session_open_disp_mean"), ("avg", "current_session_developing_range", "dev_range_mean"))]
    return {
        "st0": f"""SELECT *, close - current_session_open AS disp, {flag('high > prior_session_high AND close <= prior_session_high')} AS fh, {flag('low < prior_session_low AND close >= prior_session_low')} AS fl,
          {flag('high > prior_session_high AND close > prior_session_high')} AS ch, {flag('low < prior_session_low AND close < prior_session_low')} AS cl FROM feature_base""",
        "st1": f"SELECT *, {', '.join(out)}, {flag(_TRANS[0])} * coalesce(sign(disp), 0) AS ss_ctx_asia_to_london_state, {flag(_TRANS[1])} * coalesce(sign(disp), 0) AS ss_ctx_london_to_ny_state FROM st0",
    }


@query("w27_session_structure", cols(fe.session_structure_names((24, 72, 120))), "SELECT * FROM st1", **_structure_sql((24, 72, 120)))
def _(t):
    return fe.session_structure(t.feature_base, (24, 72, 120))


_P8 = lambda agg, x: f"CASE WHEN count({x}) OVER ({OVER} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) >= 8 THEN {agg}({x}) OVER ({OVER} ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) END"
_SW = "OVER (PARTITION BY instrument, session_id ORDER BY ts ROWS UNBOUNDED PRECEDING)"


def _session_sql(src: str) -> dict[str, str]:
    return {
        "sb0": f"SELECT *, {_P8('max', 'high')} AS h8, {_P8('min', 'low')} AS l8 FROM {src}",
        "sb1": f"""SELECT *, abs(close - current_session_open) AS ss_dist_from_session_open, close - current_session_open AS ss_signed_displacement_from_session_open, current_session_developing_range AS ss_current_dev_session_range_width,
          current_close_position_in_session_range AS ss_position_in_dev_session_range, CASE WHEN prior_session_high IS NOT NULL THEN greatest(high - prior_session_high, 0) END AS ss_breakout_depth_above_prior_session_high,
          CASE WHEN prior_session_low IS NOT NULL THEN greatest(prior_session_low - low, 0) END AS ss_breakout_depth_below_prior_session_low, sum({flag('close > prior_session_high')}) {_SW} AS ss_breakout_accept_count_up,
          sum({flag('close < prior_session_low')}) {_SW} AS ss_breakout_accept_count_dn, {flag('high > h8 AND close < h8')} AS ss_sweep_reject_high_8, {flag('low < l8 AND close > l8')} AS ss_sweep_reject_low_8,
          {flag(_TRANS[0])} AS ss_transition_asia_to_london, {flag(_TRANS[1])} AS ss_transition_london_to_ny FROM sb0""",
    }


@query("w28_session_base_features", cols(fe.SESSION_BASE), "SELECT * FROM sb1", **_session_sql("feature_base"))
def _(t):
    return fe.session_base_features(t.feature_base)


_ROUTED = ("ss_dist_from_session_open", "ss_sweep_reject_high_8")


@query("w29_session_routed_blocks", "instrument ts session_bucket " + " ".join(f"{n}__{c}:r" for n in se.SESSION_NAMES for c in _ROUTED),
       "SELECT instrument, ts, session_bucket, " + ", ".join(f"CASE WHEN session_bucket = '{n}' THEN {c} END AS {n}__{c}" for n in se.SESSION_NAMES for c in _ROUTED) + " FROM sb1", **_session_sql("feature_base"))
def _(t):
    return fe.route_by_session(fe.session_base_features(t.feature_base), _ROUTED)


@query("w30_interactions", cols(fe.INTERACTIONS), f"""SELECT instrument, ts, {flag(f"session_bucket IN {_IN['l']}")} * abs(sf_dist_prior_day_high_atr) AS if_session_london_x_struct_dist,
  {flag(f"session_bucket IN {_IN['n']}")} * sf_compression_ratio_14_48 AS if_session_ny_x_compression, event_window_flag * (ss_breakout_accept_count_up + ss_breakout_accept_count_dn) AS if_event_x_breakout_accept,
  sf_spread_proxy * atr AS if_spread_x_barrier_scale_proxy, atr * (ss_sweep_reject_high_8 + ss_sweep_reject_low_8) AS if_vol_x_sweep_proxy,
  sf_directional_efficiency_8 * abs(ss_signed_displacement_from_session_open) AS if_trend_eff_x_session_open_dist, {flag("session_bucket = 'asia'")} * abs(sf_dist_prior_day_low_atr) AS if_session_asia_x_struct_dist_low FROM sb1""",
       **SHARED_CTES, **_session_sql("shared"))
def _(t):
    return fe.full_frame(t.feature_base)


_EMA2 = {"e20": ("close", 2 / 21, 1), "e50": ("close", 2 / 51, 1)}


def _regime_sql(src: str, p: str) -> dict[str, str]:
    f = lambda n: f"OVER ({OVER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return {
        f"{p}_e": q.ewm(src, _EMA2),
        f"{p}_x": f"""SELECT *, row_number() OVER ({OVER}) AS rn, {q.TR} AS tr, {lag('close')} AS p1, {lag('close', 4)} AS p4, (high - low) / nullif(close, 0) AS rp FROM {p}_e""",
        f"{p}_r": f"""SELECT instrument, ts, rn, close, coalesce(close / nullif(p1, 0) - 1, 0) AS ret_1, coalesce(close / nullif(p4, 0) - 1, 0) AS ret_4, stddev_pop((close - p1) / CASE WHEN p1 = 0 THEN 1 ELSE p1 END) {f(20)} AS vol_20, coalesce(rp, 0) AS range_pct, avg(coalesce(rp, 0)) {f(20)} AS range_ma_20,
          coalesce((e20 - e50) / nullif(close, 0), 0) AS trend_strength, coalesce(avg(tr) {f(14)} / nullif(close, 0), 0) AS atr_pct,
          coalesce(4 * stddev_pop(close) {f(20)} / nullif(avg(close) {f(20)}, 0), 0) AS bbw, coalesce((close - open) / nullif(open, 0), 0) AS body_pct,
          coalesce((volume - avg(volume) {f(20)}) / nullif(stddev_pop(volume) {f(20)}, 0), 0) AS vol_z FROM {p}_x""",
    }


@query("w31_regime_features", cols(fe.REGIME_V1), "SELECT * FROM r_r WHERE rn >= 21", **_regime_sql("bars_h1", "r"))
def _(t):
    return fe.regime_features(t.bars_h1)


_MTF = {"m15": "bars_m15", "h1": "bars_h1", "h4": "bars_h4", "d1": "bars_d1"}
_SECONDS = {"h1": 3600, "h4": 14400, "d1": 86400}
_CLOCK = ("sess_asia", "sess_europe", "sess_us", "sess_eu_us_overlap", "hour_sin", "hour_cos", "wday_sin", "wday_cos")
_MAP = {"ret1": "ret_1", "ret4": "ret_4", "atr_pct": "atr_pct", "trend": "trend_strength", "bbw": "bbw", "body_pct": "body_pct", "range_pct": "range_pct", "vol_z": "vol_z"}


@query("w32_multi_timeframe_regime", cols([f"{k}_{c}" for k in _MTF for c in fe.MTF_COLUMNS] + [f"m15_{c}" for c in _CLOCK]),
       "SELECT b.instrument, b.ts, " + ", ".join(f"{k if k != 'm15' else 'b'}.{_MAP[c]} AS {k}_{c}" for k in _MTF for c in fe.MTF_COLUMNS)
       + """, CASE WHEN hour(b.ts) < 7 THEN 1 ELSE 0 END AS m15_sess_asia, CASE WHEN hour(b.ts) BETWEEN 7 AND 12 THEN 1 ELSE 0 END AS m15_sess_europe, CASE WHEN hour(b.ts) BETWEEN 13 AND 21 THEN 1 ELSE 0 END AS m15_sess_us,
       CASE WHEN hour(b.ts) BETWEEN 13 AND 16 THEN 1 ELSE 0 END AS m15_sess_eu_us_overlap, sin(2 * pi() * hour(b.ts) / 24) AS m15_hour_sin, cos(2 * pi() * hour(b.ts) / 24) AS m15_hour_cos,
       sin(2 * pi() * (isodow(b.ts) - 1) / 7) AS m15_wday_sin, cos(2 * pi() * (isodow(b.ts) - 1) / 7) AS m15_wday_cos FROM (SELECT * FROM m15x_r WHERE rn >= 5) b """
       + " ".join(f"ASOF LEFT JOIN (SELECT *, ts + to_seconds({s}) AS done FROM {k}x_r WHERE rn >= 5) {k} ON {k}.instrument = b.instrument AND b.ts >= {k}.done" for k, s in _SECONDS.items()),
       **{n: s for k, src in _MTF.items() for n, s in _regime_sql(src, f"{k}x").items()})
def _(t):
    slower = {k: (getattr(t, _MTF[k]), s) for k, s in _SECONDS.items()}
    return fe.multi_timeframe_regime(t.bars_m15, slower)


# ------------------------------------------------------------- costs and tradability

_TRAD = {
    **SHARED_CTES,
    "td0": f"SELECT *, greatest(abs(close), 1e-9) * abs(spread_proxy_bps) * 1e-4 AS cost, abs(close - {lag('close')}) <= 1e-10 AS stale FROM shared",
    "td1": "SELECT *, cost / (abs(atr) + 1e-9) AS sa, cost / (abs(rng) + 1e-9) AS sr, abs(rng) / (cost + 1e-9) AS rs, rng <= 1e-8 AS flat FROM td0",
    "td2": """SELECT *, greatest(0, least(1, 0.30 * exp(-sa / 0.25) + 0.30 * exp(-sr / 0.35) + 0.25 * (1 - exp(-rs / 5.0)) + 0.10 * (CASE WHEN flat THEN 0 ELSE 1 END) + 0.05 * (CASE WHEN stale THEN 0 ELSE 1 END))) + (0 * sa) AS score FROM td1""",
    "td3": "SELECT *, coalesce(sa <= 0.35 AND sr <= 0.55 AND rs >= 2.5 AND NOT flat AND NOT stale AND score >= 0.25, false) AS tradable FROM td2",
}


def tradability(t):
    """Tradable mask, score and diagnostics on the shared features."""

    def build(d, w):
        d = fe.shared_columns(d, w)
        p = costs.tradability_parts()
        stale = F.abs(F.col("_dc")) <= 1e-10
        d = d.withColumns({**{f"_{k}": v for k, v in p.items()}, "_stale": stale})
        score = costs.tradability_score(F.col("_spread_atr"), F.col("_spread_range"), F.col("_range_spread"), F.col("_flat"), F.col("_stale"))
        d = d.withColumn("tradability_score", score)
        ok = (F.col("_spread_atr") <= 0.35) & (F.col("_spread_range") <= 0.55) & (F.col("_range_spread") >= 2.5) & ~F.col("_flat") & ~F.col("_stale")
        return d.withColumns({
            "tradable_mask": F.coalesce(ok & (F.col("tradability_score") >= 0.25), F.lit(False)), "tradability_spread_atr": F.col("_spread_atr"),
            "tradability_spread_range": F.col("_spread_range"), "tradability_range_spread": F.col("_range_spread"),
            "tradability_flat_bar": F.coalesce(F.col("_flat"), F.lit(True)), "tradability_stale_bar": F.coalesce(F.col("_stale"), F.lit(True)),
        })

    return sr.windowed(t.feature_base, sr.BARS, build, back=110)


@query("w34_tradability_score", "instrument ts tradability_score:r", "SELECT instrument, ts, score AS tradability_score FROM td2", **_TRAD)
def _(t):
    return tradability(t)


@query("w35_tradable_mask", "instrument ts tradable_mask tradability_spread_atr:r tradability_spread_range:r tradability_range_spread:r3 tradability_flat_bar tradability_stale_bar",
       """SELECT instrument, ts, tradable AS tradable_mask, sa AS tradability_spread_atr, sr AS tradability_spread_range, rs AS tradability_range_spread, coalesce(flat, true) AS tradability_flat_bar, coalesce(stale, true) AS tradability_stale_bar FROM td3""", **_TRAD)
def _(t):
    return tradability(t)


@query("v11_tradability_summary", "session_bucket total:i retained:i excluded:i retained_share:r", """SELECT coalesce(session_bucket, 'ALL') AS session_bucket, count(*) AS total, count(*) FILTER (tradable) AS retained, count(*) FILTER (NOT tradable) AS excluded,
  count(*) FILTER (tradable) / count(*) AS retained_share FROM td3 GROUP BY GROUPING SETS ((session_bucket), ())""", **_TRAD)
def _(t):
    return evaluate.retained_share(tradability(t), "session_bucket", "tradable_mask")


_HB = "CASE WHEN hour(ts) BETWEEN 12 AND 15 THEN 'overlap' WHEN hour(ts) BETWEEN 7 AND 15 THEN 'london' WHEN hour(ts) BETWEEN 12 AND 20 THEN 'newyork' WHEN hour(ts) < 9 THEN 'tokyo' ELSE 'offhours' END"


@query("w36_hour_bucket", "instrument ts bucket", f"SELECT instrument, ts, {_HB} AS bucket FROM bars_m15")
def _(t):
    return t.bars_m15.select("instrument", "ts", costs.hour_bucket("ts").alias("bucket"))


_SPREADS = ", ".join(f"('{h}', '{v}', {s})" for h, m in costs.SPREAD_TABLE.items() for v, s in m.items())


@query("w37_cost_columns", "instrument ts spread_est:r slippage_est:r cost_est:r", f"""SELECT c.instrument, c.ts, coalesce(s.spread, 0) AS spread_est, greatest(0, coalesce(0.1 * atr, 0)) AS slippage_est, coalesce(s.spread, 0) + greatest(0, coalesce(0.1 * atr, 0)) AS cost_est
  FROM (SELECT *, {_HB} AS hb, CASE WHEN r < 1/3 THEN 'low' WHEN r < 2/3 THEN 'mid' ELSE 'high' END AS vb FROM (SELECT *, coalesce({q.rank_share('ap', 252, 20)}, 0.5) AS r FROM (SELECT *, atr / (abs(close) + 1e-9) AS ap FROM wa))) c
  LEFT JOIN (VALUES {_SPREADS}) s(hb, vb, spread) USING (hb, vb)""", trs="SELECT *, " + q.TR + " AS tr FROM bars_h1", wa=q.ewm("trs", {"atr": ("tr", 1 / 14, 14)}))
def _(t):
    from barlume.operators.costing import cost_columns

    return cost_columns(t.bars_h1)


@query("w38_fallback_costs", "instrument ts spread_est:r slippage_est:r cost_est:r", """SELECT w.instrument, w.ts, 0.2 AS spread_est, 0.05 * coalesce(atr, med) AS slippage_est, 0.2 + 0.05 * coalesce(atr, med) AS cost_est FROM wa w
  JOIN (SELECT instrument, quantile_cont(atr, 0.5) AS med FROM wa GROUP BY instrument) m USING (instrument)""", trs="SELECT *, " + q.TR + " AS tr FROM bars_h1", wa=q.ewm("trs", {"atr": ("tr", 1 / 14, 14)}))
def _(t):
    from barlume.operators.costing import fallback_costs

    return fallback_costs(t.bars_h1)


@query("w39_spread_state", "instrument ts bps:r usd:r", "SELECT instrument, ts, CASE WHEN volume % 3 = 0 THEN 2.0 ELSE volume % 7 END AS bps, close * (CASE WHEN volume % 3 = 0 THEN 2.0 ELSE volume % 7 END) * 1e-4 AS usd FROM bars_h1")
def _(t):
    proxy = F.when(F.col("volume") % 3 != 0, (F.col("volume") % 7).cast("double"))
    return t.bars_h1.select("instrument", "ts", costs.spread_state(F.col("close"), proxy).alias("bps"), costs.spread_state(F.col("close"), proxy, unit="usd").alias("usd"))


@query("w42_vol_target_quantity", "instrument ts quantity:i", f"""SELECT instrument, ts, CASE WHEN sd > 0 THEN greatest(1, floor(10000 * greatest(0.1, least(3.0, 40.0 / (sd * sqrt(365.25 * 24)))))) ELSE 10000 END AS quantity FROM (
  SELECT instrument, ts, {roll('stddev_pop', 'r', 20)} AS sd FROM (SELECT *, CASE WHEN {lag('close')} > 0 THEN close / {lag('close')} - 1 END AS r FROM bars_h1))""")
def _(t):
    return fe.vol_target_quantity(t.bars_h1, 10000, 40.0, 20, 3600)


@query("w44_ordered_split", "instrument ts split", f"SELECT instrument, ts, CASE WHEN rn <= floor(n * 0.7) THEN 'train' ELSE 'test' END AS split FROM (SELECT *, row_number() OVER ({OVER}) AS rn, count(*) OVER (PARTITION BY instrument) AS n FROM bars_h1)")
def _(t):
    return fe.ordered_split(t.bars_h1, 0.7)
