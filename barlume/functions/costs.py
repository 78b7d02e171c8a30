"""Column functions for costs, tradability and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPS = 1e-9

# Spread by hour bucket and volatility tercile, for any instrument.
SPREAD_TABLE = {
    "overlap": {"low": 0.00010, "mid": 0.00012, "high": 0.00016},
    "london": {"low": 0.00012, "mid": 0.00015, "high": 0.00020},
    "newyork": {"low": 0.00013, "mid": 0.00016, "high": 0.00022},
    "tokyo": {"low": 0.00016, "mid": 0.00020, "high": 0.00028},
    "offhours": {"low": 0.00018, "mid": 0.00024, "high": 0.00034},
}

# Typical spread in pips.
SPREAD_PIPS = {
    "AUD_USD": 1.4, "EUR_GBP": 1.7, "EUR_JPY": 1.8, "EUR_USD": 1.4, "GBP_JPY": 3.1,
    "GBP_USD": 2.0, "NZD_USD": 1.7, "USD_CAD": 2.2, "USD_CHF": 1.8, "USD_JPY": 1.4,
}
DEFAULT_SPREAD_PIPS = 1.5


def safe_div(num: Column, den: Column) -> Column:
    return num / (F.abs(den) + EPS)


def hour_bucket(ts: str | Column) -> Column:
    h = F.hour(ts)
    return (
        F.when((h >= 12) & (h < 16), "overlap").when((h >= 7) & (h < 16), "london").when((h >= 12) & (h < 21), "newyork")
        .when((h >= 0) & (h < 9), "tokyo").otherwise("offhours")
    )


def spread_lookup_table(spark: SparkSession, overrides: dict | None = None) -> DataFrame:
    """(instrument, hour_bucket, vol_bucket, spread); instrument '*' is the default."""
    rows = [(i, h, v, s) for i, t in {"*": SPREAD_TABLE, **(overrides or {})}.items() for h, vs in t.items() for v, s in vs.items()]
    return spark.createDataFrame(rows, "instrument string, hour_bucket string, vol_bucket string, spread double")


def tercile(rank: Column) -> Column:
    r = F.coalesce(rank, F.lit(0.5))
    return F.when(r < 1 / 3, "low").when(r < 2 / 3, "mid").otherwise("high")


def spread_state(close: Column, spread_bps: Column, default_bps: float = 2.0, unit: str = "bps") -> Column:
    bps = F.coalesce(spread_bps, F.lit(default_bps))
    return F.coalesce(close, F.lit(0.0)) * bps * 1e-4 if unit == "usd" else bps


def tradability_parts(close="close", spread="sf_spread_proxy", atr="sf_vol_scale_atr14", rng="sf_realized_range", default_bps=2.0) -> dict[str, Column]:
    price = F.greatest(F.abs(F.col(close)), F.lit(EPS))
    cost = price * F.coalesce(F.abs(F.col(spread)), F.lit(default_bps)) * 1e-4
    r = F.abs(F.col(rng))
    return {"spread_atr": cost / (F.abs(F.col(atr)) + EPS), "spread_range": cost / (r + EPS), "range_spread": r / (cost + EPS), "flat": r <= 1e-8}


def tradability_score(sa: Column, sr: Column, rs: Column, flat: Column, stale: Column) -> Column:
    """Weighted score in [0, 1] of spread, range, flatness and staleness."""
    f = F.coalesce(flat, F.lit(False)).cast("double")
    t = F.coalesce(stale, F.lit(False)).cast("double")
    raw = 0.30 * F.exp(-sa / 0.25) + 0.30 * F.exp(-sr / 0.35) + 0.25 * (1 - F.exp(-rs / 5.0)) + 0.10 * (1 - f) + 0.05 * (1 - t)
    return F.when(raw.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))


def pip_size(instrument: Column) -> Column:
    return F.when(instrument.endswith("_JPY"), 0.01).otherwise(0.0001)


def fill_price(mid: Column, side: Column, instrument: Column, slippage_pips: float = 0.0) -> Column:
    """Mid plus half the spread and slippage, against the trader."""
    pips = F.lit(DEFAULT_SPREAD_PIPS)
    for name, value in SPREAD_PIPS.items():
        pips = F.when(instrument == name, value).otherwise(pips)
    step = (pips / 2 + slippage_pips) * pip_size(instrument)
    return F.when(side == "BUY", mid + step).otherwise(mid - step)


def commission(quantity: Column, model: str = "core", rate: float = 1.0) -> Column:
    """'spread_only' is free, 'core' charges per 10,000 units, 'fixed' per fill."""
    if model == "spread_only":
        return F.lit(0.0)
    if model == "fixed":
        return F.lit(float(rate))
    return F.abs(quantity) / 10000 * rate
