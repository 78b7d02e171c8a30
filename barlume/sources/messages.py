"""Message streams: JSON records in, JSON records out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def encode(df: DataFrame, key: str | None = None, timestamp: str = "timestamp") -> DataFrame:
    """One JSON text per row; a missing timestamp is stamped now."""
    if timestamp in df.columns:
        df = df.withColumn(timestamp, F.coalesce(F.col(timestamp), F.localtimestamp()))
    else:
        df = df.withColumn(timestamp, F.localtimestamp())
    cols = [F.to_json(F.struct(*df.columns)).alias("value")]
    if key:
        cols.insert(0, F.col(key).cast("string").alias("key"))
    return df.select(*cols)


def decode(df: DataFrame, schema: StructType | str, value: str = "value") -> DataFrame:
    """Parsed messages; an unreadable one keeps its text in _corrupt_record."""
    body = F.from_json(value, f"{schema}, _corrupt_record string" if isinstance(schema, str) else schema.add("_corrupt_record", "string"), {"columnNameOfCorruptRecord": "_corrupt_record"})
    return df.select(body.alias("_m")).select("_m.*")


def read_stream(spark: SparkSession, path: str, fmt: str = "text", max_files: int | None = None, **options) -> DataFrame:
    """Streaming records from files; any other Spark source by format and options."""
    r = spark.readStream.format(fmt).options(**options)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path) if path else r.load()


def write_stream(df: DataFrame, path: str, checkpoint: str, name: str | None = None, fmt: str = "text") -> StreamingQuery:
    """Appends messages to files exactly once per checkpoint."""
    w = df.writeStream.format(fmt).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (w.queryName(name) if name else w).start()
