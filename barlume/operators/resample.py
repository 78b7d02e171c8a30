"""Ticks to candles and candles to slower candles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barlume.operators.series import order_key


def ticks_to_bars(ticks: DataFrame, every: str, tie: str = "event_id", price: str = "price") -> DataFrame:
    """First/max/min/last price and summed volume per instrument and bucket.

    All aggregates combine on the map side, so a hot instrument shuffles one
    partial row per bucket and task.  Empty buckets produce no bar.
    """
    at = order_key(ticks, ("ts", tie))
    return (
        ticks.groupBy("instrument", F.window("ts", every).alias("_w"))
        .agg(
            F.min_by(price, at).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, at).alias("close"),
            F.sum("volume").alias("volume"),
        )
        .select("instrument", F.col("_w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


def mid_price(ticks: DataFrame) -> DataFrame:
    """Ticks priced at the middle of bid and ask."""
    return ticks.withColumn("price", (F.col("bid") + F.col("ask")) / 2)


def resample_bars(bars: DataFrame, every: str, spread: str | None = None) -> DataFrame:
    """Slower candles from candles; a spread column is averaged."""
    extra = [F.avg(spread).alias(spread)] if spread else []
    out = bars.groupBy("instrument", F.window("ts", every).alias("_w")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
        *extra,
    )
    names = ["open", "high", "low", "close", "volume"] + ([spread] if spread else [])
    return out.select("instrument", F.col("_w.start").alias("ts"), *names)
