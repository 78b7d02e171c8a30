"""Trading sessions and structural anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlume.operators.series import BARS, Series, materialise, running, windowed

# Session windows in local minutes, start inclusive, end exclusive.
SESSION_ZONE = "Europe/London"
SESSIONS = (
    ("asia", 0, 360),
    ("pre_london", 360, 480),
    ("london_open", 480, 540),
    ("london_continuation", 540, 780),
    ("ny_open", 780, 900),
    ("ny_overlap_postdata", 900, 1440),
)
SESSION_NAMES = tuple(n for n, _, _ in SESSIONS)


def local_time(ts: Column | str, zone: str = SESSION_ZONE) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col(ts) if isinstance(ts, str) else ts)


def session_bucket(ts: str = "ts", zone: str = SESSION_ZONE, sessions=SESSIONS) -> Column:
    """Session by local minute of day; a window may wrap midnight."""
    local = local_time(ts, zone)
    minute = F.hour(local) * 60 + F.minute(local)
    out = None
    for name, start, end in sessions:
        inside = (minute >= start) & (minute < end) if end > start else (minute >= start) | (minute < end)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def session_flags(bucket: str = "session_bucket") -> list[Column]:
    return [(F.col(bucket) == n).cast("int").alias(f"session_{n}") for n in SESSION_NAMES]


def with_sessions(bars: DataFrame, s: Series = BARS) -> DataFrame:
    """Adds session_bucket and the running session number."""
    d = bars.withColumn("session_bucket", session_bucket(s.ts))

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        prev = F.lag("session_bucket").over(w)
        return d.withColumn("_new", F.when(prev.isNull() | (prev != F.col("session_bucket")), 1).otherwise(0))

    return running(d, s, sums={"session_id": F.col("_new")}, prepare=build, back=1).drop("_new")


def developing_state(bars: DataFrame) -> DataFrame:
    """Session state known at each bar.  A session spans hours, so the window
    (instrument, session) is small by construction."""
    w = Window.partitionBy("instrument", "session_id").orderBy("ts")
    u = w.rowsBetween(Window.unboundedPreceding, 0)
    d = bars.withColumns({
        "current_session_open": F.first("open").over(u),
        "current_session_elapsed_bars": F.row_number().over(w),
        "current_session_developing_high": F.max("high").over(u),
        "current_session_developing_low": F.min("low").over(u),
    })
    rng = F.col("current_session_developing_high") - F.col("current_session_developing_low")
    d = d.withColumn("current_session_developing_range", rng)
    pos = (F.col("close") - F.col("current_session_developing_low")) / F.col("current_session_developing_range")
    return d.withColumn("current_close_position_in_session_range", F.when(F.col("current_session_developing_range") > 0, pos))


def _prior_levels(bars: DataFrame, period: str, prefix: str) -> DataFrame:
    """Adds the OHLC of the observed period before each bar's period.

    Bars fold into one row per session or day (a list of at most that period's
    bars), the row before supplies the levels, and the list unfolds again: two
    shuffles and no self-join.
    """
    rest = [c for c in bars.columns if c not in ("instrument", period)]
    agg = bars.groupBy("instrument", period).agg(
        F.min_by("open", "ts").alias("o"), F.max("high").alias("h"), F.min("low").alias("l"), F.max_by("close", "ts").alias("c"),
        F.min("ts").alias("_t"), F.collect_list(F.struct(*rest)).alias("_rows"),
    )
    names = (("h", "high"), ("l", "low"), ("o", "open"), ("c", "close"))

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({f"{prefix}_{n}": F.lag(x).over(w) for x, n in names})

    periods = Series(ts="_t", order=("_t",), slice_seconds=364 * 86400, chunk_rows=5_000)
    out = windowed(agg, periods, build, back=1)
    return out.select("instrument", period, *[f"{prefix}_{n}" for _, n in names], F.inline("_rows"))


def prior_session_levels(bars: DataFrame) -> DataFrame:
    return _prior_levels(bars, "session_id", "prior_session")


def prior_day_levels(bars: DataFrame, zone: str = SESSION_ZONE) -> DataFrame:
    """Levels of the local day observed before the bar's local day."""
    d = bars.withColumn("trade_day", local_time("ts", zone).cast("date"))
    return _prior_levels(d, "trade_day", "prior_day")


def calendar_day_levels(rows: DataFrame, bars: DataFrame | None = None) -> DataFrame:
    """High and low of the previous calendar day, from ``bars`` (default: the rows
    themselves); NULL when that day is empty."""
    d = rows.withColumn("_day", F.col("ts").cast("date"))
    src = d if bars is None else bars.withColumn("_day", F.col("ts").cast("date"))
    agg = src.groupBy("instrument", "_day").agg(F.max("high").alias("prev_day_high"), F.min("low").alias("prev_day_low"))
    agg = agg.withColumn("_day", F.date_add("_day", 1))
    return d.join(agg, ["instrument", "_day"], "left").drop("_day")


def session_anchors(bars: DataFrame, s: Series = BARS) -> DataFrame:
    """Sessions, developing state and prior session and day levels.  The session
    numbering is written once, as each later step passes over the rows twice."""
    numbered = materialise(with_sessions(bars, s))
    return developing_state(prior_day_levels(materialise(prior_session_levels(numbered))))


def future_extreme_leaks(bars: DataFrame, dev_high: str, dev_low: str) -> DataFrame:
    """Bars whose developing high or low already equals the extreme the session
    reaches only later."""
    w = Window.partitionBy("instrument", "session_id")  # hours of bars
    d = bars.withColumns({"_fh": F.max("high").over(w), "_fl": F.min("low").over(w)})
    d = d.withColumns({
        "_th": F.min(F.when(F.col("high") == F.col("_fh"), F.col("ts"))).over(w),
        "_tl": F.min(F.when(F.col("low") == F.col("_fl"), F.col("ts"))).over(w),
    })
    hit = F.array_compact(F.array(
        F.when((F.col("ts") < F.col("_th")) & (F.col(dev_high) == F.col("_fh")), F.struct(F.lit("high").alias("leak_type"), F.col("_fh").alias("full_extreme"))),
        F.when((F.col("ts") < F.col("_tl")) & (F.col(dev_low) == F.col("_fl")), F.struct(F.lit("low").alias("leak_type"), F.col("_fl").alias("full_extreme"))),
    ))
    return d.select("instrument", "ts", "session_id", F.explode(hit).alias("_h")).select("instrument", "ts", "session_id", "_h.*")


def not_constant(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns holding more than one value (NULL counts as one) inside a key."""
    aggs = []
    for c in columns:
        # two extremes and a NULL flag tell constancy without a distinct set
        varied = F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))
        aggs.append(varied.alias(c))
    g = df.groupBy(*keys).agg(*aggs)
    pairs = ", ".join(f"'{c}', {c}" for c in columns)
    return g.selectExpr(*keys, f"stack({len(columns)}, {pairs}) AS (level_name, nunique)").where("nunique > 1")
