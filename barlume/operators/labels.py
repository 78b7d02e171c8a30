"""Forward-looking labels.  Windows look ahead, never across chunk limits: the
chunk halo holds the rows a label needs."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F


from barlume.operators.series import BARS, Series, average_rank, quantiles, windowed
from barlume.operators.sessions import SESSION_NAMES


def _forward(d: DataFrame, w: WindowSpec, horizon: int, relative: bool) -> DataFrame:
    ahead = F.lead("close", horizon).over(w)
    gross = ahead / F.nullif(F.col("close"), F.lit(0.0)) - 1 if relative else ahead - F.col("close")
    return d.withColumn("gross_ret", gross)


def forward_return(bars: DataFrame, horizon: int = 8, band: float = 0.0, cost: str | None = "cost_est", s: Series = BARS) -> DataFrame:
    """Relative forward return net of cost; direction -1, 0 or 1."""
    d = windowed(bars, s, lambda d, w: _forward(d, w, horizon, True), ahead=horizon)
    net = F.col("gross_ret") - F.col(cost) if cost else F.col("gross_ret")
    d = d.withColumn("net_ret", net)
    n = F.col("net_ret")
    return d.withColumns({
        "y_opportunity": F.when(n.isNotNull(), (F.abs(n) > band).cast("double")),
        "y_direction": F.when(n > band, 1.0).when(n < -band, -1.0).when(n.isNotNull(), 0.0),
    })


def forward_move(bars: DataFrame, horizon: int = 8, band: float = 0.0, cost: str | None = "cost_est", s: Series = BARS) -> DataFrame:
    """Absolute forward move; direction 1 or 0, missing without opportunity."""
    d = windowed(bars, s, lambda d, w: _forward(d, w, horizon, False), ahead=horizon)
    d = d.withColumn("net_ret", F.col("gross_ret") - F.col(cost) if cost else F.col("gross_ret"))
    n = F.col("net_ret")
    opp = F.when(n.isNotNull(), (F.abs(n) > band).cast("double"))
    return d.withColumn("y_opportunity", opp).withColumn("y_direction", F.when(F.col("y_opportunity") == 1, (n > 0).cast("double")))


def volatility_opportunity(rows: DataFrame, fold: str, split: str, q: float = 0.7, atr_k: float = 0.0, band: float = 0.0) -> DataFrame:
    """Opportunity against max(band, train quantile of |net_ret| per fold, k*ATR)."""
    train = rows.where(F.col(split) == "train").withColumn("_abs", F.abs("net_ret"))
    cut = quantiles(train, [fold], "_abs", {"_q": q})
    d = rows.join(cut, fold, "left")
    limit = F.greatest(F.greatest(F.lit(band), F.coalesce("_q", F.lit(band))), atr_k * F.coalesce("atr", F.lit(0.0)))
    d = d.withColumn("threshold", limit).drop("_q")
    opp = F.coalesce(F.abs("net_ret") > F.col("threshold"), F.lit(False)).cast("double")
    d = d.withColumn("y_opp", opp)
    return d.withColumn("y_dir", F.when(F.col("y_opp") == 1, (F.col("net_ret") > 0).cast("int")).otherwise(-1))


def breakout_label(rows: DataFrame, compression: float = 0.20, move: float = 0.002) -> DataFrame:
    """Compressed band, large net move and opportunity; missing without a future."""
    ok = (F.col("bb_width_pct") < compression) & (F.abs("net_ret") > move) & (F.col("y_opportunity") == 1)
    return rows.withColumn("y_breakout", F.when(F.col("gross_ret").isNotNull(), F.coalesce(ok, F.lit(False)).cast("double")))


def range_regime(regime: Column) -> Column:
    return F.lower(regime).isin("range", "ranging", "mean_reversion")


def reversion_label(rows: DataFrame, z_k: float = 1.5, move: float = 0.0015, in_range: Column | None = None) -> DataFrame:
    """Extreme z-score whose net move goes back, inside a range regime."""
    z, n = F.col("price_zscore"), F.col("net_ret")
    back = ((z > 0) & (n < -move)) | ((z < 0) & (n > move))
    ok = (F.abs(z) >= z_k) & back & (F.col("y_opportunity") == 1) & (in_range if in_range is not None else F.lit(True))
    return rows.withColumn("y_mean_reversion", F.when(F.col("gross_ret").isNotNull(), F.coalesce(ok, F.lit(False)).cast("double")))


def risk_label(bars: DataFrame, horizon: int = 8, method: str = "realized_vol", s: Series = BARS) -> DataFrame:
    """Deviation of the next returns, or mean of the next ATR values."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        f = w.rowsBetween(1, horizon)
        full = F.count(F.lit(1)).over(f) >= horizon
        if method == "realized_vol":
            d = d.withColumn("_r", F.col("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1)
            return d.withColumn("y_risk", F.when(full, F.stddev_pop("_r").over(f))).drop("_r")
        return d.withColumn("y_risk", F.when(full, F.avg("atr").over(f)))

    return windowed(bars, s, build, back=1, ahead=horizon)


# Limits of the heuristic regime classes and quiet hours (UTC).
REGIME_LIMITS = {"slope_high": 8e-4, "slope_low": 2e-4, "adx_high": 0.25, "adx_low": 0.18, "vol_high": 0.80, "spread_high": 0.80}
QUIET_HOURS = (22, 23, 0, 1, 2, 3, 4, 5)


def regime_target(rows: DataFrame, rank_spread: bool = True, limits: dict = REGIME_LIMITS, quiet=QUIET_HOURS) -> DataFrame:
    """0 trend, 1 range, 2 high volatility, 3 low liquidity, strongest rule last."""
    top = rows.agg(F.max("adx").alias("_top"))
    d = rows.crossJoin(F.broadcast(top))
    adx = F.coalesce("adx", F.lit(0.0)) / F.when(F.col("_top") > 1.5, 100.0).otherwise(1.0)
    d = d.withColumn("_spread", F.coalesce("spread_est", F.lit(0.0)))
    if rank_spread:
        d = average_rank(d, [], "_spread", "_sp", pct=True)
    else:
        d = d.withColumn("_sp", F.col("_spread"))
    slope = F.abs(F.coalesce("slope", F.lit(0.0)))
    low = (F.col("_sp") > limits["spread_high"]) | F.hour("ts").isin(*quiet)
    y = (
        F.when(low, 3).when(F.coalesce("vol_pct", F.lit(0.0)) > limits["vol_high"], 2)
        .when((slope <= limits["slope_low"]) & (adx <= limits["adx_low"]), 1)
        .when((slope >= limits["slope_high"]) & (adx >= limits["adx_high"]), 0).otherwise(1)
    )
    return d.withColumn("regime_target", y).drop("_top", "_spread", "_sp")


@dataclass(frozen=True)
class BarrierConfig:
    take: dict
    stop: dict
    horizon: dict
    band: dict
    vol_col: str = "atr14"
    event_mode: str = "exclude"
    slippage_bps: float = 0.5
    commission_bps_per_side: float = 0.0
    spread_is_bps: bool = True
    max_spread_for_exec: float | None = None
    min_net_edge: float = 0.0
    max_mae_mult: float = 1.5
    edges: tuple = field(default=(4, 8, 16, 32))


_STATES = {"exclude": "excluded_event", "suspend": "suspended_event", "event_sleeve": "event_sleeve"}


def triple_barrier(bars: DataFrame, cfg: BarrierConfig, s: Series = BARS) -> DataFrame:
    """Session-conditioned triple barrier with event states, path quality and the
    execution label.

    The next bars of a row (at most the longest horizon) form one array; first
    touches are positions in it.  Both barriers on one bar give 0; no touch gives
    the sign of the final return outside the neutral band.
    """
    longest = max(cfg.horizon.values())
    rows = [(n, float(cfg.take[n]), float(cfg.stop[n]), int(cfg.horizon[n]), float(cfg.band[n])) for n in cfg.horizon]
    params = bars.sparkSession.createDataFrame(rows, "session_bucket string, _tp double, _sl double, _hz int, _nb double")

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("_path", F.collect_list(F.struct("high", "low", "close")).over(w.rowsBetween(1, longest)))

    d = windowed(bars, s, build, ahead=longest).join(F.broadcast(params), "session_bucket", "left")
    c, v = F.col("close"), F.col(cfg.vol_col)
    d = d.withColumn("_path", F.slice("_path", F.lit(1), F.coalesce("_hz", F.lit(0))))
    d = d.withColumn("_h", F.size("_path"))
    first = lambda test: F.array_position(F.transform("_path", test), F.lit(True))
    d = d.withColumns({
        "_up": first(lambda e: e["high"] >= F.col("close") + F.col("_tp") * F.col(cfg.vol_col)),
        "_dn": first(lambda e: e["low"] <= F.col("close") - F.col("_sl") * F.col(cfg.vol_col)),
        "_end": F.get("_path", F.col("_h") - 1)["close"],
    })
    up, dn, h = F.col("_up"), F.col("_dn"), F.col("_h")
    ret = (F.col("_end") - c) / (F.abs(c) + 1e-9)
    bad = c.isNull() | v.isNull() | (v <= 0)
    y = (
        F.when(bad | (h == 0), 0).when((up > 0) & (dn > 0), F.when(up < dn, 1).when(dn < up, -1).otherwise(0))
        .when(up > 0, 1).when(dn > 0, -1).when(F.abs(ret) <= F.col("_nb"), 0).when(ret > 0, 1).otherwise(-1)
    )
    t = (
        F.when(bad, F.col("_hz")).when(h == 0, 0).when((up > 0) & (dn > 0), F.least(up, dn))
        .when(up > 0, up).when(dn > 0, dn).otherwise(h)
    )
    event = F.coalesce(F.col("event_window_flag").cast("double"), F.lit(0.0)) > 0
    state = F.when(event, _STATES[cfg.event_mode]).otherwise("base") if cfg.event_mode in _STATES else F.lit("base")
    idle = F.col("label_state").isin("excluded_event", "suspended_event") | F.col("_hz").isNull()
    d = d.withColumn("label_state", state)
    d = d.withColumns({"_y": F.when(idle, 0).otherwise(y), "_t": F.when(idle, 0).otherwise(t).cast("bigint")})
    lo = F.array_min(F.transform("_path", lambda e: e["low"]))
    hi = F.array_max(F.transform("_path", lambda e: e["high"]))
    vol0 = F.greatest(F.abs(v), F.lit(1e-9))
    mae = F.when(F.col("_y") > 0, F.greatest(F.lit(0.0), c - lo)).when(F.col("_y") < 0, F.greatest(F.lit(0.0), hi - c)) / vol0
    gain = F.when(F.col("_y") > 0, F.col("_end") - c).when(F.col("_y") < 0, c - F.col("_end"))
    spread = F.greatest(F.lit(0.0), F.coalesce("spread_proxy_bps", F.lit(0.0)))
    cost = (F.abs(c) * spread * 1e-4 if cfg.spread_is_bps else spread) + F.abs(c) * (
        max(0.0, cfg.slippage_bps) + 2 * max(0.0, cfg.commission_bps_per_side)
    ) * 1e-4
    d = d.withColumns({"mae_mult": mae, "net_edge": gain - cost})
    d = d.withColumn("_meta", execution_label(F.col("_y"), F.col("net_edge"), F.col("mae_mult"), F.col("spread_proxy_bps"), cfg))
    out = F.col("label_state") == "excluded_event"
    return d.withColumns({
        "y_dir": F.when(~out, F.col("_y")), "y_meta_exec": F.when(~out, F.col("_meta")),
        "time_to_resolution_bucket": F.when(out, "excluded").otherwise(time_bucket(F.col("_t"), cfg.edges)),
        "label_horizon_bars": F.when(out, 0).otherwise(F.col("_t")),
    }).drop("_path", "_h", "_up", "_dn", "_end", "_tp", "_sl", "_hz", "_nb", "_y", "_t", "_meta")


def execution_label(y: Column, edge: Column, mae: Column, spread: Column, cfg: BarrierConfig) -> Column:
    """1 when a directional label clears its costs with a bounded adverse move."""
    ok = (y != 0) & F.coalesce(edge > cfg.min_net_edge, F.lit(False)) & F.coalesce(mae <= cfg.max_mae_mult, F.lit(False))
    if cfg.max_spread_for_exec is not None:
        ok = ok & F.coalesce(spread <= cfg.max_spread_for_exec, F.lit(False))
    return F.coalesce(ok, F.lit(False)).cast("int")


def time_bucket(t: Column, edges=(4, 8, 16, 32)) -> Column:
    out = F.when(t <= 0, "none")
    for e in edges:
        out = out.when(t <= e, f"<= {e}")
    return out.otherwise(f"> {edges[-1]}")


def class_weights(labels: DataFrame, sessions=SESSION_NAMES) -> DataFrame:
    """total / (3 * count) per session and class, 0 for an absent class."""
    g = labels.where(F.col("y_dir").isNotNull()).groupBy("session_bucket").agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(F.when(F.col("y_dir") == c, 1)).alias(f"_c{i}") for i, c in enumerate((-1, 0, 1))]
    )
    long = g.selectExpr("session_bucket", "_n", "stack(3, -1, _c0, 0, _c1, 1, _c2) AS (y_dir, _c)")
    return long.select("session_bucket", "y_dir", F.when(F.col("_c") > 0, F.col("_n") / (3 * F.col("_c"))).otherwise(0.0).alias("weight"))


def label_end(bars: DataFrame, horizon: int, s: Series = BARS) -> DataFrame:
    return windowed(bars, s, lambda d, w: d.withColumn("label_end_ts", F.lead(s.ts, horizon).over(w)), ahead=horizon)


def split_balance(rows: DataFrame, keys) -> DataFrame:
    """Opportunity share and long/short share among directional rows."""
    live = F.col("y_dir") != -1
    return rows.groupBy(*keys).agg(
        F.avg("y_opp").alias("opp_pos"), F.avg(F.when(live, (F.col("y_dir") == 1).cast("double"))).alias("dir_long"),
        F.avg(F.when(live, (F.col("y_dir") == 0).cast("double"))).alias("dir_short"),
    )


