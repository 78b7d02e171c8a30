"""Backward-only feature frames.

Each builder adds columns to chunked rows (``d``, ``w``); all windows share one
(instrument, chunk) order, so Spark sorts a chunk once for a whole frame.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlume.functions.costs import safe_div
from barlume.operators.align import align_many
from barlume.operators.indicators import (
    EPS, pct_change, rolling, rolling_rank, true_range, wilder_back, wilder_columns,
)
from barlume.operators.series import BARS, Series, ewm_columns, ewm_memory, position, share_of, windowed
from barlume.operators.sessions import SESSION_NAMES, calendar_day_levels

LONDON = ("london_open", "london_continuation")
NEW_YORK = ("ny_open", "ny_overlap_postdata")
EARLY = ("asia", "pre_london")


def _flag(cond: Column) -> Column:
    """0.0 / 1.0 with a missing comparison counted as false."""
    return F.coalesce(cond, F.lit(False)).cast("double")


def bar_shape(bars: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.withColumns({
        "typical_price": (h + l + c) / 3, "body": F.abs(c - o), "upper_wick": h - F.greatest(o, c),
        "lower_wick": F.least(o, c) - l, "is_bullish": c > o, "bar_range": h - l,
    })


SEQ_COLUMNS = (
    "ret_1", "ret_4", "atr_14", "rsi_14", "adx_14", "body_pct", "upper_wick_pct", "lower_wick_pct", "close_pos_in_range",
    "session_sin", "session_cos", "bb_width_pct", "atr_pct", "spread_feat", "vol_pct",
)
LAGGED = ("ret_1", "ret_4", "rsi_14", "adx_14", "body_pct", "upper_wick_pct", "lower_wick_pct", "bb_width_pct", "atr_pct", "spread_feat", "vol_pct")


def base_frame_columns(d: DataFrame, w: WindowSpec, s: Series, spread: str | None = None, n: int = 14, bb: int = 20, ranks: int = 252) -> DataFrame:
    """Fifteen base-bar features."""
    keep = d.columns
    d = wilder_columns(d, w, n, s)
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    rng = F.greatest(h - l, F.lit(0.0))
    angle = 2 * math.pi * (F.hour("ts") * 60 + F.minute("ts")) / 1440
    d = d.withColumns({
        "_rng": rng, "_sd": rolling(F.stddev_pop, "close", w, bb), "_m": rolling(F.avg, "close", w, bb),
        "ret_1": pct_change("close", 1, w), "ret_4": pct_change("close", 4, w),
    })
    d = d.withColumns({
        "_bbw": 4 * F.col("_sd") / (F.abs("_m") + EPS),
        "atr_14": F.col("atr"), "rsi_14": F.col("rsi") / 100, "adx_14": F.col("adx") / 100,
        "body_pct": F.abs(c - o) / (F.col("_rng") + EPS),
        "upper_wick_pct": F.greatest(h - F.greatest(o, c), F.lit(0.0)) / (F.col("_rng") + EPS),
        "lower_wick_pct": F.greatest(F.least(o, c) - l, F.lit(0.0)) / (F.col("_rng") + EPS),
        "close_pos_in_range": (c - l) / (F.col("_rng") + EPS),
        "session_sin": F.sin(angle), "session_cos": F.cos(angle),
        "spread_feat": (F.col(spread) if spread else F.lit(0.0)) / (F.abs(c) + EPS),
    })
    d = d.withColumns({
        "bb_width_pct": rolling_rank("_bbw", w, ranks, 30), "atr_pct": rolling_rank("atr_14", w, ranks, 30),
        "vol_pct": rolling_rank("volume", w, ranks, 30),
    })
    return d.select(*keep, *SEQ_COLUMNS)


def base_frame(bars: DataFrame, s: Series = BARS, spread: str | None = None) -> DataFrame:
    return windowed(bars, s, lambda d, w: base_frame_columns(d, w, s, spread), back=wilder_back(14) + 252)


def lag_expansion(frame: DataFrame, columns=LAGGED, lags=(1, 2, 3), s: Series = BARS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({f"{c}_lag{k}": F.lag(c, k).over(w) for c in columns for k in lags})

    return windowed(frame, s, build, back=max(lags))


def pack_sequences(frame: DataFrame, columns, length: int, s: Series = BARS) -> DataFrame:
    """The last ``length`` rows as a matrix, for rows where every value is present."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        row = F.array(*[F.col(c).cast("float") for c in columns])
        whole = F.lit(True)
        for c in columns:
            whole = whole & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
        d = d.withColumns({"_row": row, "_ok": whole.cast("int")})
        f = w.rowsBetween(-(length - 1), 0)
        return d.withColumns({"sequence": F.collect_list("_row").over(f), "_good": F.sum("_ok").over(f)}).drop("_row", "_ok")

    out = windowed(frame, s, build, back=length - 1)
    return out.where(F.col("_good") == length).select(*s.keys, s.ts, "sequence")


CONTEXT = ("h1_slope", "h4_slope", "h1_adx", "h4_adx", "h1_vol_pct", "h4_vol_pct")


def slower_context(bars: DataFrame, prefix: str, lookback: int, s: Series = BARS) -> DataFrame:
    """Slope, ADX and volume rank of a slower timeframe."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = wilder_columns(d, w, 14, s)
        prev = F.lag("close", lookback).over(w)
        return d.withColumns({
            f"{prefix}_slope": (F.col("close") / (prev + EPS) - 1) / lookback,
            f"{prefix}_adx": F.col("adx") / 100,
            f"{prefix}_vol_pct": rolling_rank("volume", w, 252, 20),
        })

    out = windowed(bars, s, build, back=wilder_back(14) + 252)
    return out.select(*s.keys, s.ts, f"{prefix}_slope", f"{prefix}_adx", f"{prefix}_vol_pct")


def context_frame(base: DataFrame, h1: DataFrame, h4: DataFrame, s: Series = BARS) -> DataFrame:
    """Slower trend, distance to the previous day and session flags at each base
    bar.  Slower bars count only once complete; missing values become 0."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_tr", true_range(w))
        return ewm_columns(d, s, {"atr": (F.col("_tr"), 1 / 14, 14)}).drop("_tr")

    d = windowed(base, s, build, back=ewm_memory(1 / 14) + 1)
    d = align_many(d, [
        (slower_context(h1, "h1", 24, s), ["h1_slope", "h1_adx", "h1_vol_pct"], 3600),
        (slower_context(h4, "h4", 12, s), ["h4_slope", "h4_adx", "h4_vol_pct"], 14400),
    ], s)
    d = calendar_day_levels(d, base)
    hour = F.hour(s.ts)
    zero = F.lit(0.0)
    return d.select(
        *s.keys, s.ts,
        *[F.coalesce(F.col(c), zero).alias(c) for c in CONTEXT],
        F.coalesce((F.col("close") - F.col("prev_day_high")) / (F.col("atr") + EPS), zero).alias("dist_prev_high"),
        F.coalesce((F.col("close") - F.col("prev_day_low")) / (F.col("atr") + EPS), zero).alias("dist_prev_low"),
        (hour < 8).cast("double").alias("asia"),
        ((hour >= 8) & (hour < 13)).cast("double").alias("london"),
        ((hour >= 13) & (hour < 22)).cast("double").alias("ny"),
    )


# ------------------------------------------------------------- session research features

SHARED = (
    "sf_realized_range", "sf_vol_scale_atr14", "sf_candle_body", "sf_upper_wick", "sf_lower_wick", "sf_body_to_range_ratio",
    "sf_wick_asymmetry", "sf_compression_ratio_14_48", "sf_expansion_ratio_14_96", "sf_directional_efficiency_8",
    "sf_directional_efficiency_16", "sf_net_move_8", "sf_gross_move_8", "sf_short_persistence_above_anchor12",
    "sf_dist_prior_day_high_atr", "sf_dist_prior_day_low_atr", "sf_dist_prior_session_high_atr", "sf_dist_prior_session_low_atr",
    "sf_spread_proxy", "sf_spread_range_ratio", "sf_ret1",
)


def shared_columns(d: DataFrame, w: WindowSpec, spread: str = "spread_proxy_bps") -> DataFrame:
    """The 21 shared features plus the working columns _tr, _dc (close change)."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    d = d.withColumns({
        "_tr": true_range(w), "_dc": c - F.lag("close").over(w),
        "_n8": F.abs(c - F.lag("close", 8).over(w)), "_n16": F.abs(c - F.lag("close", 16).over(w)),
        "_lc": F.lag("close").over(w), "sf_ret1": pct_change("close", 1, w),
    })
    anchor = rolling(F.avg, "_lc", w, 12)
    d = d.withColumns({
        "sf_vol_scale_atr14": rolling(F.avg, "_tr", w, 14), "_atr48": rolling(F.avg, "_tr", w, 48), "_atr96": rolling(F.avg, "_tr", w, 96),
        "sf_gross_move_8": rolling(F.sum, F.abs(F.col("_dc")), w, 8), "_g16": rolling(F.sum, F.abs(F.col("_dc")), w, 16),
        "_above": _flag(c > anchor),
    })
    d = d.withColumn("_above", F.lag("_above").over(w))
    atr = F.col("sf_vol_scale_atr14")
    rng, body = F.abs(h - l), F.abs(c - o)
    uw = F.greatest(h - F.greatest(o, c), F.lit(0.0))
    lw = F.greatest(F.least(o, c) - l, F.lit(0.0))
    d = d.withColumns({
        "sf_realized_range": rng, "sf_candle_body": body, "sf_upper_wick": uw, "sf_lower_wick": lw,
        "sf_body_to_range_ratio": safe_div(body, rng), "sf_wick_asymmetry": safe_div(uw - lw, rng),
        "sf_compression_ratio_14_48": safe_div(atr, F.col("_atr48")), "sf_expansion_ratio_14_96": safe_div(atr, F.col("_atr96")),
        "sf_directional_efficiency_8": safe_div(F.col("_n8"), F.col("sf_gross_move_8")),
        "sf_directional_efficiency_16": safe_div(F.col("_n16"), F.col("_g16")), "sf_net_move_8": F.col("_n8"),
        "sf_short_persistence_above_anchor12": rolling(F.avg, "_above", w, 12),
        "sf_dist_prior_day_high_atr": safe_div(c - F.col("prior_day_high"), atr),
        "sf_dist_prior_day_low_atr": safe_div(c - F.col("prior_day_low"), atr),
        "sf_dist_prior_session_high_atr": safe_div(c - F.col("prior_session_high"), atr),
        "sf_dist_prior_session_low_atr": safe_div(c - F.col("prior_session_low"), atr),
        "sf_spread_proxy": F.col(spread), "sf_spread_range_ratio": safe_div(F.col(spread), rng),
    })
    return d.drop("_n8", "_n16", "_lc", "_atr48", "_atr96", "_g16", "_above")


def shared_features(anchored: DataFrame, s: Series = BARS) -> DataFrame:
    return windowed(anchored, s, lambda d, w: shared_columns(d, w).drop("_tr", "_dc"), back=110)


def short_context_columns(d: DataFrame, w: WindowSpec, lookbacks=(8, 16, 32, 64), lags=(1, 2, 3, 4, 8)) -> DataFrame:
    """Lagged ATR-scaled moves and, per look-back, trend and break statistics.
    Needs ``shared_columns``."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    atr = F.col("sf_vol_scale_atr14")
    d = d.withColumns({
        "_ret_atr": safe_div(F.col("_dc"), atr), "_body_atr": safe_div(c - o, atr), "_range_atr": safe_div(F.abs(h - l), atr),
        "_sign": F.signum("_dc"),
    })
    cols = {}
    for k in lags:
        cols[f"sf_ctx_ret_atr_lag_{k}"] = F.lag("_ret_atr", k).over(w)
        cols[f"sf_ctx_body_atr_lag_{k}"] = F.lag("_body_atr", k).over(w)
        cols[f"sf_ctx_range_atr_lag_{k}"] = F.lag("_range_atr", k).over(w)
        cols[f"sf_ctx_ret1_lag_{k}"] = F.lag("sf_ret1", k).over(w)
    cols["_flip"] = F.coalesce(F.col("_sign") != F.lag("_sign").over(w), F.lit(True)).cast("double")
    for n in lookbacks:
        f = w.rowsBetween(-n, -1)
        full = F.count("high").over(f) >= n
        cols[f"_ph{n}"] = F.when(full, F.max("high").over(f))
        cols[f"_pl{n}"] = F.when(full, F.min("low").over(f))
        cols[f"_net{n}"] = c - F.lag("close", n).over(w)
    d = d.withColumns(cols)
    work = {}
    for n in lookbacks:
        ph, pl = F.col(f"_ph{n}"), F.col(f"_pl{n}")
        work[f"_au{n}"], work[f"_ad{n}"] = _flag(c > ph), _flag(c < pl)
        work[f"_rh{n}"], work[f"_rl{n}"] = _flag(h > ph) * _flag(c < ph), _flag(l < pl) * _flag(c > pl)
    d = d.withColumns(work)
    out = {}
    for n in lookbacks:
        net = F.col(f"_net{n}")
        half = max(4, n // 2)
        out[f"sf_ctx_net_move_atr_{n}"] = safe_div(net, atr)
        out[f"sf_ctx_eff_ratio_{n}"] = F.abs(net) / (rolling(F.sum, F.abs(F.col("_dc")), w, n) + EPS)
        out[f"sf_ctx_momo_persist_{n}"] = F.abs(rolling(F.avg, "_sign", w, n))
        out[f"sf_ctx_reversal_flip_rate_{n}"] = rolling(F.avg, "_flip", w, n)
        out[f"sf_ctx_break_accept_up_count_{n}"] = rolling(F.sum, f"_au{n}", w, n)
        out[f"sf_ctx_break_accept_dn_count_{n}"] = rolling(F.sum, f"_ad{n}", w, n)
        out[f"sf_ctx_sweep_reject_high_count_{n}"] = rolling(F.sum, f"_rh{n}", w, n)
        out[f"sf_ctx_sweep_reject_low_count_{n}"] = rolling(F.sum, f"_rl{n}", w, n)
        out[f"sf_ctx_comp_exp_ratio_{n}"] = safe_div(rolling(F.avg, "_tr", w, half), rolling(F.avg, "_tr", w, n))
    return d.withColumns(out)


def short_context_names(lookbacks=(8, 16, 32, 64), lags=(1, 2, 3, 4, 8)) -> list[str]:
    names = [f"sf_ctx_{x}_lag_{k}" for k in lags for x in ("ret_atr", "body_atr", "range_atr", "ret1")]
    per = ("net_move_atr", "eff_ratio", "momo_persist", "reversal_flip_rate", "break_accept_up_count", "break_accept_dn_count",
           "sweep_reject_high_count", "sweep_reject_low_count", "comp_exp_ratio")
    return names + [f"sf_ctx_{x}_{n}" for n in lookbacks for x in per]


def short_context(anchored: DataFrame, s: Series = BARS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = short_context_columns(shared_columns(d, w), w)
        return d.select(*s.keys, s.ts, "_chunk", "_own", "_base", *short_context_names())

    return windowed(anchored, s, build, back=140)


def rolling_quantiles(d: DataFrame, x: str, frames: dict[int, tuple[int, int]], keys=("instrument",), ts: str = "ts") -> DataFrame:
    """Exact rolling quartiles over frames of thousands of rows, added to chunked
    rows as _q25_k, _q50_k, _q75_k.

    A window percentile sorts every frame anew; here each chunk (already in place,
    halo included) goes through an incremental rolling quantile in one Arrow batch.
    """
    names = [f"_q{int(100 * q)}_{k}" for k in frames for q in (0.25, 0.5, 0.75)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.schema) + ", " + ", ".join(f"{n} double" for n in names)

    def run(pdf):
        pdf = pdf.sort_values(ts, kind="stable")
        v = pdf[x].astype("float64")
        for k, (n, least) in frames.items():
            r = v.rolling(n, min_periods=least)
            for q in (0.25, 0.5, 0.75):
                pdf[f"_q{int(100 * q)}_{k}"] = r.quantile(q)
        return pdf

    return d.groupBy(*keys, "_chunk").applyInPandas(run, schema)


def slow_context_columns(d: DataFrame, w: WindowSpec, days=(10, 20, 40), bars_per_day: int = 96) -> DataFrame:
    """Volatility, range and trend regime over weeks, with exact frame quantiles."""
    c = F.col("close")
    atr = F.col("sf_vol_scale_atr14")
    work, out = {}, {}
    for k in days:
        n = max(k * bars_per_day, 96)
        e = max(8, n // 8)
        work[f"_eff{k}"] = F.abs(c - F.lag("close", e).over(w)) / (rolling(F.sum, F.abs(F.col("_dc")), w, e) + EPS)
    d = rolling_quantiles(d.withColumns(work), "sf_vol_scale_atr14", {k: (max(k * bars_per_day, 96), max(96, max(k * bars_per_day, 96) // 4)) for k in days})
    for k in days:
        n = max(k * bars_per_day, 96)
        least = max(96, n // 4)
        lo, mid, hi = F.col(f"_q25_{k}"), F.col(f"_q50_{k}"), F.col(f"_q75_{k}")
        out[f"sf_regime_vol_med_ratio_{k}d"] = safe_div(atr, mid)
        out[f"sf_regime_vol_iqr_norm_{k}d"] = safe_div(atr - mid, hi - lo)
        out[f"sf_regime_spread_range_ratio_{k}d"] = safe_div(F.col("sf_spread_proxy"), rolling(F.avg, "_tr", w, n, least))
        out[f"sf_regime_trend_eff_mean_{k}d"] = rolling(F.avg, f"_eff{k}", w, max(16, n // 8), max(16, n // 16))
        out[f"sf_regime_ret_vol_{k}d"] = rolling(F.stddev_pop, "sf_ret1", w, n, least)
        out[f"sf_regime_event_intensity_{k}d"] = rolling(F.avg, F.coalesce(F.col("event_window_flag").cast("double"), F.lit(0.0)), w, n, least)
    return d.withColumns(out)


def slow_context_names(days=(10, 20, 40)) -> list[str]:
    per = ("vol_med_ratio", "vol_iqr_norm", "spread_range_ratio", "trend_eff_mean", "ret_vol", "event_intensity")
    return [f"sf_regime_{x}_{k}d" for k in days for x in per]


def slow_context(anchored: DataFrame, bars_per_day: int, s: Series = BARS, days=(10, 20, 40)) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = slow_context_columns(shared_columns(d, w), w, days, bars_per_day)
        return d.select(*s.keys, s.ts, "_chunk", "_own", "_base", *slow_context_names(days))

    return windowed(anchored, s, build, back=2 * max(days) * bars_per_day + 110)


def strided_columns(d: DataFrame, w: WindowSpec, length: int = 128, stride: int = 8) -> DataFrame:
    """ATR-scaled move, body and range at lags 1, 1+stride, …"""
    c, atr = F.col("close"), F.col("sf_vol_scale_atr14")
    d = d.withColumns({
        "_ret_atr": safe_div(F.col("_dc"), atr), "_body_atr": safe_div(c - F.col("open"), atr),
        "_range_atr": safe_div(F.abs(F.col("high") - F.col("low")), atr),
    })
    return d.withColumns({
        f"sf_seq_{x}_l{k:03d}": F.lag(f"_{x}", k).over(w) for k in range(1, length + 1, stride) for x in ("ret_atr", "body_atr", "range_atr")
    })


def strided_names(length: int = 128, stride: int = 8) -> list[str]:
    return [f"sf_seq_{x}_l{k:03d}" for k in range(1, length + 1, stride) for x in ("ret_atr", "body_atr", "range_atr")]


def strided_context(anchored: DataFrame, s: Series = BARS) -> DataFrame:
    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = strided_columns(shared_columns(d, w), w)
        return d.select(*s.keys, s.ts, "_chunk", "_own", "_base", *strided_names())

    return windowed(anchored, s, build, back=128 + 16)


SESSION_BASE = (
    "ss_dist_from_session_open", "ss_signed_displacement_from_session_open", "ss_current_dev_session_range_width",
    "ss_position_in_dev_session_range", "ss_breakout_depth_above_prior_session_high", "ss_breakout_depth_below_prior_session_low",
    "ss_breakout_accept_count_up", "ss_breakout_accept_count_dn", "ss_sweep_reject_high_8", "ss_sweep_reject_low_8",
    "ss_transition_asia_to_london", "ss_transition_london_to_ny",
)


def session_base_columns(d: DataFrame, w: WindowSpec) -> DataFrame:
    """Displacement, breakout depth and acceptance, sweeps and session changes."""
    c, h, l = F.col("close"), F.col("high"), F.col("low")
    ph, pl = F.col("prior_session_high"), F.col("prior_session_low")
    disp = c - F.col("current_session_open")
    f8 = w.rowsBetween(-8, -1)
    full = F.count("high").over(f8) >= 8
    prev = F.lag("session_bucket").over(w)
    cur = F.col("session_bucket")
    # a session lies inside one chunk plus halo: it spans hours, the halo more
    sess = Window.partitionBy("instrument", "_chunk", "session_id").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_h8": F.when(full, F.max("high").over(f8)), "_l8": F.when(full, F.min("low").over(f8))})
    return d.withColumns({
        "ss_dist_from_session_open": F.abs(disp), "ss_signed_displacement_from_session_open": disp,
        "ss_current_dev_session_range_width": F.col("current_session_developing_range"),
        "ss_position_in_dev_session_range": F.col("current_close_position_in_session_range"),
        "ss_breakout_depth_above_prior_session_high": F.when(ph.isNotNull(), F.greatest(h - ph, F.lit(0.0))),
        "ss_breakout_depth_below_prior_session_low": F.when(pl.isNotNull(), F.greatest(pl - l, F.lit(0.0))),
        "ss_breakout_accept_count_up": F.sum(_flag(c > ph)).over(sess), "ss_breakout_accept_count_dn": F.sum(_flag(c < pl)).over(sess),
        "ss_sweep_reject_high_8": _flag(h > F.col("_h8")) * _flag(c < F.col("_h8")),
        "ss_sweep_reject_low_8": _flag(l < F.col("_l8")) * _flag(c > F.col("_l8")),
        "ss_transition_asia_to_london": _flag(prev.isin(*EARLY) & cur.isin(*LONDON)),
        "ss_transition_london_to_ny": _flag(prev.isin(*LONDON) & cur.isin(*NEW_YORK)),
    }).drop("_h8", "_l8")


def session_base_features(anchored: DataFrame, s: Series = BARS) -> DataFrame:
    return windowed(anchored, s, session_base_columns, back=1500)


def session_structure_names(lookbacks) -> list[str]:
    per = ("repeat_fail_high", "repeat_fail_low", "repeat_cont_high", "repeat_cont_low", "session_open_disp_mean", "dev_range_mean")
    return [f"ss_ctx_{x}_{n}" for n in lookbacks for x in per] + ["ss_ctx_asia_to_london_state", "ss_ctx_london_to_ny_state"]


def session_structure(anchored: DataFrame, lookbacks=(96, 288, 480), s: Series = BARS) -> DataFrame:
    """Repeated failures and continuations at prior session levels."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        c, h, l = F.col("close"), F.col("high"), F.col("low")
        ph, pl = F.col("prior_session_high"), F.col("prior_session_low")
        bh, bl = _flag(h > ph), _flag(l < pl)
        disp = c - F.col("current_session_open")
        prev, cur = F.lag("session_bucket").over(w), F.col("session_bucket")
        sign = F.coalesce(F.signum(disp), F.lit(0.0))
        d = d.withColumns({
            "_fh": bh * _flag(c <= ph), "_fl": bl * _flag(c >= pl), "_ch": bh * _flag(c > ph), "_cl": bl * _flag(c < pl),
            "_ad": F.abs(disp),
            "ss_ctx_asia_to_london_state": _flag(prev.isin(*EARLY) & cur.isin(*LONDON)) * sign,
            "ss_ctx_london_to_ny_state": _flag(prev.isin(*LONDON) & cur.isin(*NEW_YORK)) * sign,
        })
        out = {}
        for n in lookbacks:
            m = max(8, n // 4)
            out[f"ss_ctx_repeat_fail_high_{n}"] = rolling(F.sum, "_fh", w, n, m)
            out[f"ss_ctx_repeat_fail_low_{n}"] = rolling(F.sum, "_fl", w, n, m)
            out[f"ss_ctx_repeat_cont_high_{n}"] = rolling(F.sum, "_ch", w, n, m)
            out[f"ss_ctx_repeat_cont_low_{n}"] = rolling(F.sum, "_cl", w, n, m)
            out[f"ss_ctx_session_open_disp_mean_{n}"] = rolling(F.avg, "_ad", w, n, m)
            out[f"ss_ctx_dev_range_mean_{n}"] = rolling(F.avg, "current_session_developing_range", w, n, m)
        return d.withColumns(out)

    return windowed(anchored, s, build, back=max(lookbacks)).select(*s.keys, s.ts, *session_structure_names(lookbacks))


def route_by_session(features: DataFrame, columns, bucket: str = "session_bucket") -> DataFrame:
    """One block of columns per session, NULL outside it."""
    return features.select(
        "instrument", "ts", bucket,
        *[F.when(F.col(bucket) == n, F.col(c)).alias(f"{n}__{c}") for n in SESSION_NAMES for c in columns],
    )


INTERACTIONS = (
    "if_session_london_x_struct_dist", "if_session_ny_x_compression", "if_event_x_breakout_accept", "if_spread_x_barrier_scale_proxy",
    "if_vol_x_sweep_proxy", "if_trend_eff_x_session_open_dist", "if_session_asia_x_struct_dist_low",
)


def interaction_columns(d: DataFrame) -> DataFrame:
    s = F.col("session_bucket")
    atr = F.col("sf_vol_scale_atr14")
    event = F.coalesce(F.col("event_window_flag").cast("double"), F.lit(0.0))
    return d.withColumns({
        "if_session_london_x_struct_dist": s.isin(*LONDON).cast("double") * F.abs("sf_dist_prior_day_high_atr"),
        "if_session_ny_x_compression": s.isin(*NEW_YORK).cast("double") * F.col("sf_compression_ratio_14_48"),
        "if_event_x_breakout_accept": event * (F.col("ss_breakout_accept_count_up") + F.col("ss_breakout_accept_count_dn")),
        "if_spread_x_barrier_scale_proxy": F.col("sf_spread_proxy") * atr,
        "if_vol_x_sweep_proxy": atr * (F.col("ss_sweep_reject_high_8") + F.col("ss_sweep_reject_low_8")),
        "if_trend_eff_x_session_open_dist": F.col("sf_directional_efficiency_8") * F.abs("ss_signed_displacement_from_session_open"),
        "if_session_asia_x_struct_dist_low": (s == "asia").cast("double") * F.abs("sf_dist_prior_day_low_atr"),
    })


def full_frame(anchored: DataFrame, s: Series = BARS) -> DataFrame:
    """Shared, session and interaction features in one chunk pass."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return interaction_columns(session_base_columns(shared_columns(d, w).drop("_tr", "_dc"), w))

    return windowed(anchored, s, build, back=1500)


# ------------------------------------------------------------- regime features

REGIME_V1 = ("ret_1", "ret_4", "vol_20", "range_pct", "range_ma_20", "trend_strength", "atr_pct")


def regime_features(bars: DataFrame, s: Series = BARS) -> DataFrame:
    """Seven regime features, present from the 21st bar on."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = ewm_columns(d, s, {"_e20": (F.col("close"), 2 / 21, 1), "_e50": (F.col("close"), 2 / 51, 1)})
        c = F.col("close")
        prev = F.lag("close").over(w)
        div = lambda x: F.when(c != 0, x / c).otherwise(0.0)
        step = F.when(prev.isNotNull(), (c - prev) / F.when(prev == 0, 1.0).otherwise(prev))
        p4 = F.lag("close", 4).over(w)
        d = d.withColumns({
            "_pos": position(w), "_tr": true_range(w), "_step": step, "range_pct": div(F.col("high") - F.col("low")),
            "ret_1": F.when(prev != 0, c / prev - 1).otherwise(0.0), "ret_4": F.when(p4 != 0, c / p4 - 1).otherwise(0.0),
        })
        return d.withColumns({
            "vol_20": F.stddev_pop("_step").over(w.rowsBetween(-19, 0)), "range_ma_20": F.avg("range_pct").over(w.rowsBetween(-19, 0)),
            "trend_strength": div(F.col("_e20") - F.col("_e50")), "atr_pct": div(F.avg("_tr").over(w.rowsBetween(-13, 0))),
        })

    out = windowed(bars, s, build, back=ewm_memory(2 / 51) + 21)
    return out.where(F.col("_pos") >= 20).select(*s.keys, s.ts, *REGIME_V1)


MTF_COLUMNS = ("ret1", "ret4", "atr_pct", "trend", "bbw", "body_pct", "range_pct", "vol_z")


def timeframe_regime(bars: DataFrame, key: str, s: Series = BARS) -> DataFrame:
    """Eight features of one timeframe from the fifth bar on; short windows shrink."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = ewm_columns(d, s, {"_e20": (F.col("close"), 2 / 21, 1), "_e50": (F.col("close"), 2 / 51, 1)})
        c, o = F.col("close"), F.col("open")
        p1, p4 = F.lag("close").over(w), F.lag("close", 4).over(w)
        div = lambda x, y: F.when(y != 0, x / y).otherwise(0.0)
        f20 = w.rowsBetween(-19, 0)
        d = d.withColumns({"_pos": position(w), "_tr": true_range(w)})
        vsd = F.stddev_pop("volume").over(f20)
        return d.withColumns({
            f"{key}_ret1": F.when(p1 != 0, c / p1 - 1).otherwise(0.0), f"{key}_ret4": F.when(p4 != 0, c / p4 - 1).otherwise(0.0),
            f"{key}_atr_pct": div(F.avg("_tr").over(w.rowsBetween(-13, 0)), c), f"{key}_trend": div(F.col("_e20") - F.col("_e50"), c),
            f"{key}_bbw": div(4 * F.stddev_pop("close").over(f20), F.avg("close").over(f20)),
            f"{key}_body_pct": div(c - o, o), f"{key}_range_pct": div(F.col("high") - F.col("low"), c),
            f"{key}_vol_z": F.when(vsd == 0, 0.0).otherwise((F.col("volume") - F.avg("volume").over(f20)) / vsd),
        })

    out = windowed(bars, s, build, back=ewm_memory(2 / 51) + 21)
    return out.where(F.col("_pos") >= 4).select(*s.keys, s.ts, *[f"{key}_{c}" for c in MTF_COLUMNS])


def clock_columns(ts: str, key: str) -> dict[str, Column]:
    hour, day = F.hour(ts).cast("double"), F.weekday(ts).cast("double")
    flag = lambda lo, hi: ((hour >= lo) & (hour < hi)).cast("double")
    return {
        f"{key}_sess_asia": flag(0, 7), f"{key}_sess_europe": flag(7, 13), f"{key}_sess_us": flag(13, 22),
        f"{key}_sess_eu_us_overlap": flag(13, 17), f"{key}_hour_sin": F.sin(2 * math.pi * hour / 24),
        f"{key}_hour_cos": F.cos(2 * math.pi * hour / 24), f"{key}_wday_sin": F.sin(2 * math.pi * day / 7),
        f"{key}_wday_cos": F.cos(2 * math.pi * day / 7),
    }


def multi_timeframe_regime(base: DataFrame, slower: dict[str, tuple[DataFrame, int]], key: str = "m15", s: Series = BARS) -> DataFrame:
    """Regime features of the base bars with those of completed slower bars."""
    d = timeframe_regime(base, key, s).withColumns(clock_columns(s.ts, key))
    sides = [(timeframe_regime(bars, name, s), [f"{name}_{c}" for c in MTF_COLUMNS], sec) for name, (bars, sec) in slower.items()]
    return align_many(d, sides, s)


def vol_target_quantity(bars: DataFrame, base_quantity: int, target: float, lookback: int, bar_seconds: int, s: Series = BARS) -> DataFrame:
    """Quantity scaled to a target annual volatility, scale clipped to [0.1, 3]."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("close").over(w)
        d = d.withColumn("_r", F.when(prev > 0, F.col("close") / prev - 1))
        return d.withColumn("_sd", rolling(F.stddev_pop, "_r", w, lookback))

    per_year = max(1.0, 365.25 * 24 * 3600 / bar_seconds)
    out = windowed(bars, s, build, back=lookback)
    scale = F.greatest(F.lit(0.1), F.least(F.lit(3.0), target / (F.col("_sd") * math.sqrt(per_year))))
    qty = F.when(F.col("_sd") > 0, F.greatest(F.lit(1), F.floor(base_quantity * scale))).otherwise(base_quantity)
    return out.withColumn("quantity", qty.cast("bigint")).drop("_r", "_sd")


def ordered_split(bars: DataFrame, ratio: float, s: Series = BARS) -> DataFrame:
    """First ``ratio`` of each series is train, the rest test."""
    total = bars.groupBy(*s.keys).agg(F.count(F.lit(1)).alias("_n"))
    d = windowed(bars, s, lambda d, w: d.withColumn("_pos", position(w))).join(total, list(s.keys))
    return d.withColumn("split", F.when(F.col("_pos") < share_of(F.col("_n"), ratio), "train").otherwise("test")).drop("_pos", "_n")


