"""Candle and tick stores on partitioned Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.operators.quality import dedupe

BAR_COLUMNS = ("open", "high", "low", "close", "volume")


def save_bars(bars: DataFrame, path: str, timeframe: str, mode: str = "overwrite") -> None:
    """Writes candles under instrument=…/timeframe=…; rows of one instrument are
    spread over files by month so a hot instrument is not written by one task."""
    out = bars.withColumn("timeframe", F.lit(timeframe))
    out = out.repartition("instrument", F.date_format("ts", "yyyy-MM")).sortWithinPartitions("instrument", "ts")
    (
        out.write.mode(mode).option("compression", "snappy").option("partitionOverwriteMode", "dynamic")
        .partitionBy("instrument", "timeframe").parquet(path)
    )


def load_bars(spark: SparkSession, path: str, instrument: str, timeframe: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive time slice; instrument and timeframe prune directories, the time
    range reaches the Parquet reader."""
    d = spark.read.parquet(path).where((F.col("instrument") == instrument) & (F.col("timeframe") == timeframe))
    return time_slice(d, start, end)


def time_slice(df: DataFrame, start: str | None, end: str | None, ts: str = "ts") -> DataFrame:
    if start is not None:
        df = df.where(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def tick_range(ticks: DataFrame, instrument: str, start: str, end: str) -> DataFrame:
    return time_slice(ticks.where(F.col("instrument") == instrument), start, end)


def fill_range(cached: DataFrame, older: DataFrame, newer: DataFrame, keys=("instrument", "ts")) -> DataFrame:
    """Union of cached history with newly fetched parts; the cached row wins,
    then the older part, then the newer one."""
    parts = [d.withColumn("_part", F.lit(i)) for i, d in enumerate((cached, older, newer))]
    return dedupe(parts[0].unionByName(parts[1]).unionByName(parts[2]), list(keys), ["_part"]).drop("_part")
