"""Cleaning, validation and selection."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from barlume.operators.series import BARS, TICKS, Series, epoch_seconds, order_key, position, windowed


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: str = "first") -> DataFrame:
    """One row per key: first or last in ``order``.

    An aggregate, not a window: copies of one key fold together on the map side,
    so a key with very many copies does not fill a task.  Numbers and times are
    fetched one by one on a single order key, which hashes instead of sorting.
    """
    pick = F.min_by if keep == "first" else F.max_by
    at = order_key(df, order)
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[pick(c, at).alias(c) for c in rest]).select(*df.columns)


def cadence_violations(bars: DataFrame, step_seconds: int, s: Series = BARS) -> DataFrame:
    """Bars whose distance to the bar before is not the expected step."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        gap = epoch_seconds(s.ts) - F.lag(epoch_seconds(s.ts)).over(w)
        return d.withColumn("gap_seconds", gap)

    return windowed(bars, s, build, back=1).where(F.col("gap_seconds") != step_seconds).select("instrument", "ts", "gap_seconds")


def load_checks(rows: DataFrame, file_order: str, price_text: str, s: Series) -> DataFrame:
    """Counts of load problems: missing time, duplicate key, time going backwards
    in file order, and prices that are not numbers."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumn("_prev", F.lag("ts").over(w))

    flow = windowed(rows, s, build, back=1)
    flow = flow.agg(
        F.count(F.when(F.col("ts").isNull(), 1)).alias("missing_timestamp"),
        F.count(F.when(F.col("ts") < F.col("_prev"), 1)).alias("not_increasing"),
        F.count(F.when(F.col(price_text).isNotNull() & F.col(price_text).try_cast("double").isNull(), 1)).alias("non_numeric_price"),
    )
    dup = rows.groupBy("instrument", "ts").agg((F.count(F.lit(1)) - 1).alias("_d")).agg(
        F.coalesce(F.sum("_d"), F.lit(0)).alias("duplicate_timestamp")
    )
    return flow.crossJoin(dup).selectExpr(
        "stack(4, 'missing_timestamp', missing_timestamp, 'not_increasing', not_increasing, "
        "'non_numeric_price', non_numeric_price, 'duplicate_timestamp', duplicate_timestamp) AS (issue, n)"
    )


def reasons(*pairs: tuple[str, Column]) -> Column:
    """Array of the names whose condition holds."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in pairs]))


def unless(holds: Column) -> Column:
    """True where the condition is false or, for lack of a value, unknown."""
    return ~F.coalesce(holds, F.lit(False))


def missing(*names: str) -> Column:
    return F.array_contains(F.array(*[F.col(c).isNull() for c in names]), True)


def bar_issues(bars: DataFrame) -> DataFrame:
    """Adds the list of broken candle rules; a missing value is one of them."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.withColumn("issues", reasons(
        ("high_below_low", h < l), ("high_below_open", h < o), ("high_below_close", h < c),
        ("low_above_open", l > o), ("low_above_close", l > c), ("negative_volume", F.col("volume") < 0),
        ("missing_value", missing("open", "high", "low", "close", "volume")),
    ))


def market_open(ts: Column) -> Column:
    """Monday to Thursday, Friday before 22:00, Sunday from 21:00 (UTC)."""
    day, hour = F.weekday(ts), F.hour(ts)
    return (day <= 3) | ((day == 4) & (hour < 22)) | ((day == 6) & (hour >= 21))


def tick_issues(
    ticks: DataFrame, max_spread: float = 0.005, max_jump: float = 0.02, max_age: float = 10.0,
    arrival: str | None = None, s: Series = TICKS, by_arrival: bool = False,
) -> DataFrame:
    """Adds the list of quality problems of each tick against the tick before it."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        mid = (F.col("bid") + F.col("ask")) / 2
        d = d.withColumn("_mid", mid)
        d = d.withColumns({"_pm": F.lag("_mid").over(w), "_pt": F.lag("ts").over(w)})
        rules = [
            ("bid_not_below_ask", F.col("bid") >= F.col("ask")),
            ("wide_spread", (F.col("ask") - F.col("bid")) / F.nullif(F.col("bid"), F.lit(0.0)) > max_spread),
            ("price_jump", F.abs((F.col("_mid") - F.col("_pm")) / F.nullif(F.col("_pm"), F.lit(0.0))) > max_jump),
            ("out_of_order", F.col("ts") < F.col("_pt")),
        ]
        if arrival:
            age = epoch_seconds(arrival) - epoch_seconds("ts")
            rules.append(("stale", market_open(F.col(arrival)) & (age > max_age)))
        return d.withColumn("issues", reasons(*rules)).drop("_mid", "_pm", "_pt")

    return windowed(ticks, s, build, back=1)


_LEVELS = "array<struct<price:string,liquidity:bigint>>"


def normalise_raw_ticks(raw: DataFrame) -> DataFrame:
    """Raw quote JSON (epoch time text, price levels) to ticks; crossed quotes drop out."""
    body = F.from_json("payload", f"time string, instrument string, bids {_LEVELS}, asks {_LEVELS}")
    d = raw.select(body.alias("b"))
    micros = (F.col("b.time").cast("decimal(24,6)") * 1_000_000).cast("bigint")
    out = d.select(
        F.col("b.instrument").alias("instrument"),
        F.expr("timestamp_ntz'1970-01-01 00:00:00'").alias("_e"), micros.alias("_us"),
        F.get(F.col("b.bids"), 0)["price"].cast("decimal(18,6)").alias("bid"),
        F.get(F.col("b.asks"), 0)["price"].cast("decimal(18,6)").alias("ask"),
        F.get(F.col("b.bids"), 0)["liquidity"].alias("bid_volume"),
        F.get(F.col("b.asks"), 0)["liquidity"].alias("ask_volume"),
    )
    ts = F.expr("_e + make_dt_interval(0, 0, 0, CAST(_us AS DECIMAL(24,6)) / 1000000)")
    return out.withColumns({"ts": ts, "spread": F.col("ask") - F.col("bid")}).where("ask >= bid").drop("_e", "_us")


def signal_contract(signals: DataFrame) -> DataFrame:
    """Adds the broken clauses of the signal contract; a missing value breaks its clause."""
    return signals.withColumn("violations", reasons(
        ("quantity", unless(F.col("quantity") > 0)),
        ("confidence", unless(F.col("confidence").between(0, 1))),
        ("rationale", unless(F.length("rationale") >= 10)),
    ))


def drop_warmup(bars: DataFrame, n: int, s: Series = BARS) -> DataFrame:
    """Removes the first n rows of every series."""
    return windowed(bars, s, lambda d, w: d.withColumn("_pos", position(w))).where(F.col("_pos") >= n).drop("_pos")


def shortlist_filter(candidates: DataFrame, shortlist: DataFrame) -> DataFrame:
    """Candidates matching (name, config); if none, those matching the name; if
    none, all.  The fallback is decided inside the plan by two global flags."""
    pairs = shortlist.select("name", "config", F.lit(True).alias("_p")).distinct()
    names = shortlist.select("name", F.lit(True).alias("_n")).distinct()
    d = candidates.join(pairs, ["name", "config"], "left").join(names, "name", "left")
    flags = d.agg(F.max("_p").alias("_any_p"), F.max("_n").alias("_any_n"))
    keep = F.when(F.col("_any_p"), F.col("_p")).when(F.col("_any_n"), F.col("_n")).otherwise(F.lit(True))
    return d.crossJoin(F.broadcast(flags)).where(F.coalesce(keep, F.lit(False))).drop("_p", "_n", "_any_p", "_any_n")


def instruments_with_history(bars: DataFrame, least: int) -> DataFrame:
    """Bars of instruments that have at least ``least`` bars."""
    enough = bars.groupBy("instrument").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    return bars.join(enough, "instrument", "left_semi")


def route(ticks: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Each tick to every strategy subscribed to its instrument."""
    return ticks.join(subscriptions, "instrument")


def min_confidence(signals: DataFrame, least: float) -> DataFrame:
    return signals.where(F.col("confidence") >= least)


def causality_check(
    bars: DataFrame, cut, features: Callable[[DataFrame], DataFrame], columns: Sequence[str], s: Series = BARS
) -> DataFrame:
    """Recomputes features without the rows after ``cut``: values up to the cut
    must not change.  One row: compared, mismatches."""
    key = [*s.keys, *s.order]
    full = features(bars).where(F.col(s.ts) <= cut).select(*key, *[F.round(c, 9).alias(f"f_{c}") for c in columns])
    part = features(bars.where(F.col(s.ts) <= cut)).select(*key, *[F.round(c, 9).alias(f"p_{c}") for c in columns])
    same = F.lit(True)
    for c in columns:
        same = same & F.col(f"f_{c}").eqNullSafe(F.col(f"p_{c}"))
    return full.join(part, key, "full_outer").agg(
        F.count(F.lit(1)).alias("compared"), F.count(F.when(~same, 1)).alias("mismatches")
    )
