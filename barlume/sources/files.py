"""File sources and sinks: CSV imports, calendars, scorecards, samples, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barlume.operators.quality import cadence_violations, dedupe, reasons
from barlume.operators.series import BARS, Series, windowed

# Accepted header names.
ALIASES = {"time": "timestamp", "datetime": "timestamp", "date": "timestamp", "vol": "volume"}
CALENDAR_HEADERS = ("timestamp_utc", "timestamp", "datetime", "time", "date")
PRICES = ("open", "high", "low", "close")


def clean_headers(df: DataFrame, aliases: dict = ALIASES) -> DataFrame:
    """Trimmed lower-case names with aliases resolved; data is not touched."""
    names = [aliases.get(c.strip().lower(), c.strip().lower()) for c in df.columns]
    return df.toDF(*names)


def utc_ntz(name: str) -> Column:
    """Text column, with or without an offset, to UTC without zone (NULL if unreadable)."""
    c = F.col(name)
    zoned = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.try_to_timestamp(c).cast("timestamp_ntz"))
    return F.when(c.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), zoned).otherwise(F.expr(f"try_cast(`{name}` AS timestamp_ntz)"))


def import_csv(spark: SparkSession, path: str, instrument: str | None = None) -> DataFrame:
    """Candles from CSV: header aliases, numeric casts, missing volume 0, first row
    per time."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    d = clean_headers(raw)
    missing = [c for c in ("timestamp", *PRICES) if c not in d.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    inst = F.col("instrument") if "instrument" in d.columns else F.lit(instrument)
    vol = F.coalesce(F.col("volume").try_cast("double").cast("bigint"), F.lit(0)) if "volume" in d.columns else F.lit(0).cast("bigint")
    d = d.select(inst.alias("instrument"), utc_ntz("timestamp").alias("ts"), *[F.col(c).try_cast("double").alias(c) for c in PRICES], vol.alias("volume"), "_file", "_at", "_row")
    d = d.where(F.col("ts").isNotNull() & F.col("open").isNotNull() & F.col("close").isNotNull())
    # file, split offset and row in the split give the file order
    return dedupe(d, ["instrument", "ts"], ["_file", "_at", "_row"]).drop("_file", "_at", "_row")


def load_ohlc(spark: SparkSession, path: str, step_seconds: int | None = 900, s: Series = BARS) -> tuple[DataFrame, DataFrame]:
    """(bars, problems) from CSV or Parquet by suffix; the bars are rows as read.

    problems: instrument, ts, issue.  missing_timestamp (none, or unreadable), non_numeric_price (any price
    that is missing or no number), not_increasing (before the row above it in its file),
    duplicate_timestamp (once per time), cadence (not ``step_seconds`` after the bar before; None skips the rule)."""
    parquet = path.rstrip("/").endswith(".parquet")
    d = spark.read.parquet(path) if parquet else spark.read.option("header", True).csv(path)
    d = d.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_row"))
    d = clean_headers(d, {"timestamp": "ts", **{k: "ts" for k, v in ALIASES.items() if v == "timestamp"}, "vol": "volume"})
    if dict(d.dtypes)["ts"] == "string":
        d = d.withColumn("ts", utc_ntz("ts"))
    missing = [c for c in PRICES if c not in d.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    d = d.withColumns({c: F.col(c).try_cast("double") for c in PRICES})
    bars = d.drop("_file", "_at", "_row")
    # a file's splits in the order of their offsets; a split is one slice
    order = Series(keys=("_file", "instrument"), order=("_at", "_row"), slice_by="_at")
    flow = windowed(d, order, lambda x, w: x.withColumn("_before", F.lag("ts").over(w)), back=1)
    bad = flow.select("instrument", "ts", F.explode(reasons(
        ("missing_timestamp", F.col("ts").isNull()), ("non_numeric_price", F.array_contains(F.array(*[F.col(c).isNull() for c in PRICES]), True)), ("not_increasing", F.col("ts") < F.col("_before")),
    )).alias("issue"))
    timed = bars.where(F.col("ts").isNotNull())
    twice = timed.groupBy("instrument", "ts").count().where("count > 1").select("instrument", "ts", F.lit("duplicate_timestamp").alias("issue"))
    bad = bad.union(twice)
    if step_seconds is not None:
        bad = bad.union(cadence_violations(timed, step_seconds, s).select("instrument", "ts", F.lit("cadence")))
    return bars, bad


def normalise_ohlc(df: DataFrame) -> DataFrame:
    """open/high/low/close from plain, else mid, else the mean of bid and ask
    columns; spread from closes; rows without prices drop out."""
    have = set(df.columns)
    out = {}
    for c in PRICES:
        i = c[0]
        options = []
        if c in have:
            options.append(F.col(c).cast("double"))
        if f"mid_{i}" in have:
            options.append(F.col(f"mid_{i}").cast("double"))
        if {f"bid_{i}", f"ask_{i}"} <= have:
            options.append((F.col(f"bid_{i}") + F.col(f"ask_{i}")) / 2)
        if not options:
            raise ValueError(f"no source for {c}")
        out[c] = F.coalesce(*options)
    if "spread_c" not in have and {"bid_c", "ask_c"} <= have:
        out["spread_c"] = F.col("ask_c") - F.col("bid_c")
    return df.withColumns(out).dropna(subset=list(PRICES))


def event_calendar(spark: SparkSession, path: str) -> DataFrame:
    """Distinct UTC event times; the time column goes by one of five names."""
    d = clean_headers(spark.read.option("header", True).csv(path), {})
    cols = [utc_ntz(c) for c in CALENDAR_HEADERS if c in d.columns]
    if not cols:
        raise ValueError(f"no time column in {d.columns}")
    return d.select(F.coalesce(*cols).alias("event_ts")).where("event_ts IS NOT NULL").distinct().orderBy("event_ts")


def scan_scorecards(spark: SparkSession, path: str, week: str | None = None) -> DataFrame:
    """All scorecard CSVs below a folder, with their file, optionally one week."""
    d = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").csv(path)
    d = d.withColumn("source_file", F.col("_metadata.file_name"))
    return d.where(F.col("review_week") == week) if week else d


def save_samples(samples: DataFrame, path: str) -> None:
    """Training samples with array columns."""
    samples.write.mode("overwrite").parquet(path)


def state_snapshots(rows: DataFrame, path: str, every: int, bar_no: str = "bar_no") -> None:
    """Appends every n-th state as a JSON line."""
    rows.where(F.col(bar_no) % every == 0).write.mode("append").json(path)


def report_lines(ranked: DataFrame, columns: Sequence[str], rank: str = "rank", digits: int = 6) -> DataFrame:
    """Markdown table rows of a ranked report; doubles with ``digits`` places, nulls as a dash."""
    types = dict(ranked.dtypes)
    text = lambda c: F.format_string(f"%.{digits}f", c) if types[c] == "double" else F.col(c).cast("string")
    cells = [F.when(F.col(c).isNull(), "-").otherwise(text(c)) for c in columns]
    return ranked.select(rank, F.concat(F.lit("| "), F.concat_ws(" | ", F.col(rank).cast("string"), *cells), F.lit(" |")).alias("line"))


def save_report(ranked: DataFrame, path: str) -> None:
    """Report table as CSV (a top-k report, so one small file)."""
    ranked.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


_FILL = "struct<id:string,units:string,price:string,financing:string,time:string>"


def parse_execution_responses(rows: DataFrame, key: str = "order_id", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """(executions, rejects) from order responses: filled, pending or rejected."""
    schema = f"orderFillTransaction {_FILL}, orderCreateTransaction struct<id:string>, orderRejectTransaction struct<rejectReason:string>"
    d = rows.withColumn("_b", F.from_json(payload, schema))
    fill, pend, rej = F.col("_b.orderFillTransaction"), F.col("_b.orderCreateTransaction"), F.col("_b.orderRejectTransaction")
    units = F.col("_b.orderFillTransaction.units").cast("bigint")
    ex = d.where(fill.isNotNull()).select(
        key, F.when(units >= 0, "BUY").otherwise("SELL").alias("side"), F.abs(units).alias("filled_quantity"), F.col("_b.orderFillTransaction.price").cast("double").alias("fill_price"),
        F.coalesce(F.col("_b.orderFillTransaction.financing").cast("double"), F.lit(0.0)).alias("commission"), F.col("_b.orderFillTransaction.id").alias("transaction_id"),
    )
    why = F.when(pend.isNotNull(), "pending orders are not supported").when(rej.isNotNull(), F.concat(F.lit("rejected: "), F.coalesce(F.col("_b.orderRejectTransaction.rejectReason"), F.lit("Unknown")))).otherwise("unexpected response")
    return ex, d.where(fill.isNull()).select(key, why.alias("reason"))


def signed_units(side: Column, quantity: Column) -> Column:
    return F.when(side == "BUY", quantity).otherwise(-quantity)
