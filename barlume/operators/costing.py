"""Execution-cost columns on candles."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import functions as F

from barlume.functions.costs import EPS, hour_bucket, spread_lookup_table, tercile
from barlume.operators.indicators import atr_wilder, rolling_rank, true_range
from barlume.operators.series import BARS, Series, attach, ewm_columns, ewm_memory, quantiles, windowed


def cost_columns(bars: DataFrame, alpha: float = 0.10, min_slip: float = 0.0, fee: float = 0.0, spread: str | None = None, s: Series = BARS, overrides: dict | None = None) -> DataFrame:
    """Spread (given, or looked up by instrument, hour and volatility tercile),
    slippage from ATR, and their total.  The lookup holds a few dozen rows."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_tr", true_range(w))
        d = ewm_columns(d, s, {"atr": (F.col("_tr"), 1 / 14, 14)}).drop("_tr")
        d = d.withColumn("_ap", F.col("atr") / (F.abs("close") + EPS))
        return d.withColumn("_vol", tercile(rolling_rank("_ap", w, 252, 20)))

    d = windowed(bars, s, build, back=ewm_memory(1 / 14) + 253)
    if spread is None:
        table = spread_lookup_table(bars.sparkSession, overrides)
        default = table.where("instrument = '*'").select("hour_bucket", F.col("vol_bucket").alias("_vol"), F.col("spread").alias("_default"))
        own = table.where("instrument <> '*'").select("instrument", "hour_bucket", F.col("vol_bucket").alias("_vol"), F.col("spread").alias("_own_spread"))
        d = d.withColumn("hour_bucket", hour_bucket("ts"))
        d = d.join(F.broadcast(default), ["hour_bucket", "_vol"], "left").join(F.broadcast(own), ["instrument", "hour_bucket", "_vol"], "left")
        est = F.coalesce("_own_spread", "_default", F.lit(0.0))
        d = d.withColumn("spread_est", est).drop("_own_spread", "_default", "hour_bucket")
    else:
        d = d.withColumn("spread_est", F.coalesce(F.col(spread), F.lit(0.0)))
    slip = F.greatest(F.lit(min_slip), F.coalesce(alpha * F.col("atr"), F.lit(min_slip)))
    d = d.withColumn("slippage_est", slip)
    return d.withColumn("cost_est", F.col("spread_est") + F.col("slippage_est") + F.lit(fee)).drop("_ap", "_vol")


def fallback_costs(bars: DataFrame, default_spread: float = 0.20, spread: str | None = None, s: Series = BARS) -> DataFrame:
    """Default spread and 5% of ATR; bars without ATR use the series median."""
    d = atr_wilder(bars, 14, "atr", s)
    d = attach(d, quantiles(d, list(s.keys), "atr", {"_med": 0.5}), s.keys, "left")
    est = F.coalesce(F.col(spread), F.lit(default_spread)) if spread else F.lit(default_spread)
    d = d.withColumns({"spread_est": est, "slippage_est": 0.05 * F.coalesce("atr", "_med"), "commission": F.lit(0.0)}).drop("_med")
    return d.withColumn("cost_est", F.col("spread_est") + F.col("slippage_est") + F.col("commission"))
