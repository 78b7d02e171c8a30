"""Risk screens on signals, trades, orders and feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barlume.operators.align import plus_seconds
from barlume.operators.quality import dedupe, missing, reasons
from barlume.operators.series import Series, asof, asof_many, chunked, epoch_micros, epoch_seconds, materialise, position, running

# Default risk limits.
LIMITS = {
    "max_order_size": 5000.0, "max_position_size": 10000.0, "max_stop_distance": 0.005, "max_leverage": 10.0, "min_balance": 5000.0,
    "max_exposure": 50000.0, "max_daily_loss": 1000.0, "loss_streak": 5, "loss_velocity_1h": 500.0, "max_drawdown_pct": 0.2,
}


def pre_trade(signals: DataFrame, limits: dict = LIMITS, value: Column | None = None) -> DataFrame:
    """Eight checks per signal, and one that nothing they need is missing: approved flag
    and the list of failed ones.

    signals: side, quantity, entry_price, stop, position, balance, exposure,
    daily_pnl, breaker_active.  ``value`` replaces quantity * entry_price where the
    order's value comes in another product, whose last bit may decide at a limit.
    """
    q, px = F.col("quantity"), F.col("entry_price")
    after = F.abs(F.col("position") + F.when(F.col("side") == "BUY", q).otherwise(-q))
    value = q * px if value is None else value
    failed = reasons(
        ("order_size", q > limits["max_order_size"]), ("position_size", after > limits["max_position_size"]),
        ("stop_loss", F.col("stop").isNull() | (F.abs(px - F.col("stop")) > limits["max_stop_distance"])),
        ("leverage", value / F.nullif(F.col("balance"), F.lit(0.0)) > limits["max_leverage"]), ("account_balance", F.col("balance") < limits["min_balance"]),
        ("total_exposure", F.col("exposure") + value > limits["max_exposure"]), ("daily_loss", F.col("daily_pnl") <= -limits["max_daily_loss"]),
        ("circuit_breaker", F.col("breaker_active")),
        ("missing_input", missing("side", "quantity", "entry_price", "position", "balance", "exposure", "daily_pnl", "breaker_active")),
    )
    return signals.withColumn("reasons", failed).withColumn("approved", F.size("reasons") == 0)


def circuit_breaker(trades: DataFrame, initial: float, s: Series, limits: dict = LIMITS, seconds: int = 3600) -> DataFrame:
    """Loss streak, loss within an hour, daily loss and drawdown after each trade,
    and a trip that stays on.

    Every measure is a difference of running totals, found by scans and one as-of
    step, so a busy hour or day needs no special care.
    """
    p = F.col("pnl")
    loss = F.when(p < 0, -p).otherwise(0.0)
    d = running(
        trades, s, sums={"_cum": p, "_loss": loss}, peaks={"_top": "_cum"}, lasts={"_ok": F.when(p >= 0, F.col("_rn"))},
        prepare=lambda x, w: x.withColumn("_rn", position(w) + 1),
    )
    d = materialise(d.withColumns({"_day": F.unix_date(F.col(s.ts).cast("date")), "_peak": F.lit(initial) + F.col("_top")}).drop("_top"))
    days = d.groupBy("_day").agg(F.sum("pnl").alias("_sum"))  # one row per day
    upto = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("_day", F.coalesce(F.sum("_sum").over(upto), F.lit(0.0)).alias("_start"))
    d = d.join(_loss_before(d, s, seconds), s.ts, "left")
    d = d.join(days, "_day").withColumn("daily_pnl", F.col("_cum") - F.col("_start")).drop("_start")
    peak = F.greatest(F.col("_peak"), F.lit(initial))
    d = d.withColumns({
        "loss_streak": F.col("_rn") - F.coalesce("_ok", F.lit(0)), "loss_1h": F.col("_loss") - F.coalesce("_before", F.lit(0.0)),
        "drawdown": F.when(peak > 0, (peak - (initial + F.col("_cum"))) / peak).otherwise(0.0),
    })
    trip = reasons(
        ("consecutive_losses", F.col("loss_streak") >= limits["loss_streak"]), ("loss_velocity", F.col("loss_1h") > limits["loss_velocity_1h"]),
        ("daily_loss", F.col("daily_pnl") <= -limits["max_daily_loss"]), ("drawdown", F.col("drawdown") > limits["max_drawdown_pct"]),
    )
    d = materialise(d.withColumn("reasons", trip))
    d = running(d, s, maxs={"_on": (F.size("reasons") > 0).cast("int")})
    return d.withColumn("halted", F.col("_on") == 1).drop("_cum", "_loss", "_rn", "_peak", "_ok", "_before", "_on", "_day")


def _loss_before(d: DataFrame, s: Series, seconds: int) -> DataFrame:
    """(time, _before): the running loss total ``seconds`` before each time; equal times take the last row.
    It depends on the time alone, so the as-of step moves one row per time and not the trades."""
    last = materialise(d.groupBy(s.ts).agg(F.max_by("_loss", "_rn").alias("_before")))
    flat = Series(keys=(), ts=s.ts, order=(s.ts,), slice_seconds=s.slice_seconds)
    shifted = last.select(F.col(s.ts).alias("_now"), plus_seconds(F.col(s.ts), -seconds).alias(s.ts))
    found = asof(shifted, last.withColumnRenamed(s.ts, "_at"), ["_before"], flat, right_ts="_at")
    return found.select(F.col("_now").alias(s.ts), "_before")


def first_per_signal(signals: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First occurrence of each signal id."""
    return dedupe(signals, [key], order)


def control_state(orders: DataFrame, commands: DataFrame, tie: str) -> DataFrame:
    """Kill switch and shadow mode in force at each order: the latest command of
    each kind at or before it.  commands: ts, action."""
    s = Series(keys=(), order=("ts",), slice_seconds=86400)
    a = F.col("action")
    side = lambda on, off, name: commands.where(a.isin(on, off)).select(F.col("ts").alias("_at"), (a == on).alias(name))
    kill, shadow = side("kill_switch_on", "kill_switch_off", "kill_switch"), side("shadow_mode_on", "shadow_mode_off", "shadow_mode")
    d = asof_many(orders, [(kill, "_at", ["kill_switch"]), (shadow, "_at", ["shadow_mode"])], s, tie=(tie,))
    no = F.lit(False)
    return d.withColumns({"kill_switch": F.coalesce("kill_switch", no), "shadow_mode": F.coalesce("shadow_mode", no)})


def feed_staleness(ticks: DataFrame, now: Column | None = None, warn: float = 10, critical: float = 30) -> DataFrame:
    """Age of the newest tick per instrument and its status."""
    last = ticks.groupBy("instrument").agg(F.max("ts").alias("last_ts"))
    if now is None:
        last = last.crossJoin(F.broadcast(ticks.agg(F.max("ts").alias("_now"))))
    else:
        last = last.withColumn("_now", now)
    age = epoch_seconds("_now") - epoch_seconds("last_ts")
    d = last.withColumn("staleness", age).drop("_now")
    return d.withColumn("status", F.when(F.col("staleness") > critical, "critical").when(F.col("staleness") > warn, "warning").otherwise("healthy"))


def route_alerts(alerts: DataFrame, channels: dict | None = None) -> DataFrame:
    """One row per alert and channel of its severity."""
    table = channels or {"info": ["log"], "warning": ["log"], "critical": ["log", "email"]}
    pick = F.array(F.lit("log"))
    for sev, names in table.items():
        pick = F.when(F.col("severity") == sev, F.array(*[F.lit(n) for n in names])).otherwise(pick)
    return alerts.withColumn("channel", F.explode(pick))


def backlog_alerts(stats: DataFrame, limit: int = 1000) -> DataFrame:
    """Streams whose lag (produced minus acknowledged) is over the limit."""
    d = stats.withColumn("lag", F.col("produced") - F.col("acknowledged"))
    return d.where(F.col("lag") > limit)


def thin_by_time(rows: DataFrame, keys: Sequence[str], seconds: int, s: Series) -> DataFrame:
    """Keeps a row only if ``seconds`` have passed since the last kept row of its key.

    A chunk's outcome depends only on which of its first rows is kept first.  Pass
    one lists, for each such row (those within ``seconds`` of the chunk's start),
    where the chain of kept rows would end; the lists are chained per key; pass two
    replays each chunk.
    """
    import numpy as np

    k = list(keys)
    cs = s.with_(keys=tuple(k))
    d = chunked(rows.withColumn("_us", epoch_micros(s.ts)), cs).drop("_own", "_base")
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in d.select(*k, "_chunk").schema)
    names, wait = rows.columns, seconds * 1_000_000
    by = ["_us", *[c for c in s.order if c != s.ts], *(["_tie"] if "_tie" in d.columns else [])]

    def ends(pdf):
        t = np.sort(pdf["_us"].to_numpy())
        nxt = np.searchsorted(t, t + wait)
        end = t.copy()
        for i in range(len(t) - 1, -1, -1):
            if nxt[i] < len(t):
                end[i] = end[nxt[i]]
        n = int(min(len(t), np.searchsorted(t, t[0] + wait) + 1))
        out = pdf[[*k, "_chunk"]].head(1).copy()
        out["firsts"], out["lasts"] = [t[:n].tolist()], [end[:n].tolist()]
        return out

    def chain(pdf):
        pdf = pdf.sort_values("_chunk")
        last, starts = -(2**62), []
        for firsts, lasts in zip(pdf["firsts"], pdf["lasts"]):
            starts.append(last)
            j = int(np.searchsorted(firsts, last + wait))
            if j < len(firsts):
                last = int(lasts[j])
        return pdf[[*k, "_chunk"]].assign(last=starts)

    def replay(left, right):
        if left.empty:
            return left[names]
        left = left.sort_values(by, kind="stable")
        last, keep = int(right["last"].iloc[0]), []
        for t in left["_us"]:
            ok = t >= last + wait
            last = t if ok else last
            keep.append(ok)
        return left[names][keep]

    m = d.groupBy(*k, "_chunk").applyInPandas(ends, f"{key_schema}, firsts array<bigint>, lasts array<bigint>")
    st = m.groupBy(*k).applyInPandas(chain, f"{key_schema}, last bigint")
    return d.groupBy(*k, "_chunk").cogroup(st.groupBy(*k, "_chunk")).applyInPandas(replay, rows.schema)
