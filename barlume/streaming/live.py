"""Structured Streaming forms of the live pipeline."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupStateTimeout

from barlume.operators.align import first_crossing
from barlume.operators.quality import tick_issues
from barlume.operators.risk import LIMITS, pre_trade
from barlume.operators.series import Series, as_instant, as_utc, materialise, order_key, shared_folder


#: State store of streams with list and map state.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STORE = "spark.sql.streaming.stateStore.providerClass"


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def run_available(df: DataFrame, mode: str = "append", each: Callable | None = None, store: str | None = None, base: str | None = None, name: str | None = None) -> tuple[str, StreamingQuery]:
    """Runs a stream over everything available; returns (output folder, query).
    ``store`` is the state store of this stream alone; a stream given its earlier ``base`` goes on from there."""
    base = base or new_folder(df.sparkSession)
    w = df.writeStream.outputMode(mode).queryName(name or f"stream-{uuid.uuid4().hex}").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    w = w.format("parquet").option("path", f"{base}/out") if each is None else w.foreachBatch(lambda batch, no: each(batch, no, f"{base}/out"))
    conf = df.sparkSession.conf
    before = conf.get(_STORE)
    conf.set(_STORE, store or before)
    try:
        q = w.start()
    finally:
        conf.set(_STORE, before)
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return f"{base}/out", q


def read_output(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def candles(ticks: DataFrame, every: str, delay: str = "10 minutes", tie: str = "event_id") -> DataFrame:
    """Tumbling candles; a bar is emitted once the watermark passes its end, and
    ticks later than ``delay`` are dropped (and counted by the state operator)."""
    ticks = ticks.withColumn("ts", as_instant("ts"))
    at = order_key(ticks, ("ts", tie))
    return (
        ticks.withWatermark("ts", delay).groupBy("instrument", F.window("ts", every).alias("_w"))
        .agg(F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("volume").alias("volume"))
        .select("instrument", as_utc(F.col("_w.start")).alias("ts"), "open", "high", "low", "close", "volume")
    )


def punctual(ticks: DataFrame, delay: str = "10 minutes", key: str = "event_id") -> DataFrame:
    """Each tick once, unless it comes behind the watermark.  No rows merge before
    the state, so ``late_rows`` of this stream counts single ticks."""
    return ticks.withColumn("ts", as_instant("ts")).withWatermark("ts", delay).dropDuplicatesWithinWatermark([key])


def late_rows(query: StreamingQuery) -> int:
    """Rows dropped as too late over a query's recorded progress; behind an
    aggregation these are partial groups, not ticks."""
    return sum(op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"])


def last_bars(bars: DataFrame, lookback: int = 20) -> DataFrame:
    """The last ``lookback`` bars per instrument, the start of ``closed_bar_signals``.
    Each task keeps that many rows per instrument before the shuffle."""
    newest = Window.partitionBy("instrument").orderBy(F.desc("ts"))
    return bars.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= lookback).select("instrument", "ts", "high", "low")


class _Breakouts(StatefulProcessor):
    """Per instrument the last highs and lows (list state) and the last side (value state)."""

    def __init__(self, lookback: int):
        self.lookback = lookback

    def init(self, handle):
        self.bars = handle.getListState("bars", "at bigint, high double, low double")
        self.last = handle.getValueState("last", "side int")

    def _rows(self, bars: pd.DataFrame) -> list[tuple[int, float, float]]:
        at = bars["ts"].to_numpy().astype("datetime64[us]").astype(np.int64)
        high, low = bars["high"].fillna(-np.inf), bars["low"].fillna(np.inf)
        return list(zip(at.tolist(), high.astype(float).tolist(), low.astype(float).tolist(), strict=True))

    def handleInitialState(self, key, initialState, timerValues):
        self.bars.appendList(self._rows(initialState))

    def handleInputRows(self, key, rows, timerValues):
        n = self.lookback
        new = pd.concat(list(rows), ignore_index=True).sort_values("ts", kind="stable", ignore_index=True)
        kept = sorted(self.bars.get()) if self.bars.exists() else []
        bars = [tuple(x) for x in kept[-n:]] + self._rows(new)
        skip = min(max(n - len(kept), 0), len(new))
        side = np.zeros(len(new), dtype=np.int32)
        if skip < len(new):
            past = np.lib.stride_tricks.sliding_window_view(np.array(bars, dtype=float)[:-1, 1:], n, axis=0)
            top, bottom = past[:, 0].max(axis=1), past[:, 1].min(axis=1)
            close = new["close"].to_numpy(dtype=float)[skip:]
            side[skip:] = (close > top * 1.0002).astype(np.int32) - ((close < bottom * 0.9998) & ~(close > top * 1.0002))
        at = np.flatnonzero(side)
        before = self.last.get()[0] if self.last.exists() else 0
        turn = at[side[at] != np.concatenate([[before], side[at][:-1]])] if len(at) else at
        self.bars.put(bars[-n:])
        if len(at):
            self.last.update((int(side[at[-1]]),))
        yield pd.DataFrame({"instrument": key[0], "ts": new["ts"].iloc[turn], "direction": side[turn], "entry_price": new["close"].iloc[turn]})

    def close(self):
        pass


def closed_bar_signals(bars: DataFrame, lookback: int = 20, warm: DataFrame | None = None) -> DataFrame:
    """Breakout signals on closed bars with kept highs, lows and last direction.

    ``warm`` is the initial state, read in the first trigger: stored bars of the batch table that
    ``last_bars`` has chosen.  Bars of a trigger are ordered in memory, so admission (files per trigger)
    bounds a step.  Missing highs and lows count as no limit.  Needs the state store ``ROCKS``.
    """
    start = None if warm is None else warm.groupBy("instrument")
    return bars.groupBy("instrument").transformWithStateInPandas(
        _Breakouts(lookback), "instrument string, ts timestamp_ntz, direction int, entry_price double", "append", "none", start
    )


def screen(signals: DataFrame, accounts: DataFrame, limits: dict = LIMITS, value: Column | None = None) -> DataFrame:
    """Pre-trade checks on streamed signals against the static account table."""
    return pre_trade(signals.join(accounts, "instrument"), limits, value)


def _exists(spark: SparkSession, path: str, delete: bool = False) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(at, True) if delete else fs.exists(at))


def _carried(spark: SparkSession, path: str, no: int, like: DataFrame) -> DataFrame:
    """What the batch before ``no`` left for this one; what older batches left is deleted."""
    _exists(spark, f"{path}-kept/batch={no - 2}", delete=True)
    before = f"{path}-kept/batch={no - 1}"
    return spark.read.schema(like.schema).parquet(before) if _exists(spark, before) else like.limit(0)


def read_batches(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that the batches of a stream wrote under their numbers."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    d = spark.read.option("basePath", path).parquet(path)
    return d.drop("batch")


HITS = "position_id bigint, exit_ts timestamp_ntz, exit_reason string"


def position_watch(positions: DataFrame, ticks: DataFrame) -> DataFrame:
    """Positions and quotes as one stream, for ``close_positions``."""
    p = positions.select(F.lit(False).alias("quote"), "instrument", F.col("opened_at").alias("ts"), "position_id", "side", "stop", "target")
    return p.unionByName(ticks.select(F.lit(True).alias("quote"), "instrument", "ts", "bid", "ask"), allowMissingColumns=True)


def close_positions(batch: DataFrame, no: int, path: str) -> None:
    """Writes the quote that closes each position, however long after its opening; replays overwrite.

    Positions that stay open are kept beside the output for the batch after; nothing else is carried. A position meets the quotes of the
    trigger it arrives in and of those after it. ``first_crossing`` does the search in chunks, so no
    task holds an instrument's quotes or positions.
    """
    spark = batch.sparkSession
    rows = materialise(batch)
    new = rows.where("NOT quote").select("instrument", F.col("ts").alias("start_ts"), "position_id", "side", "stop", "target")
    quotes = rows.where("quote").select("instrument", "ts", *[F.col(c).alias(n) for c, n in (("bid", "buy_lo"), ("bid", "buy_hi"), ("ask", "sell_lo"), ("ask", "sell_hi"))])
    done = materialise(first_crossing(_carried(spark, path, no, new).unionByName(new), quotes, tie="ts"))
    done.where("exit_ts IS NULL").select(*new.columns).write.mode("overwrite").parquet(f"{path}-kept/batch={no}")
    done.where("exit_ts IS NOT NULL").select("position_id", "exit_ts", "exit_reason").write.mode("overwrite").parquet(f"{path}/batch={no}")


def journal_totals(executions: DataFrame, delay: str = "1 day") -> DataFrame:
    """Daily totals per instrument for update mode."""
    return executions.withColumn("ts", as_instant("ts")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day").alias("_w"), "instrument").agg(
        F.count(F.lit(1)).alias("executions"), F.sum("quantity").alias("quantity"), F.sum(F.col("quantity") * F.col("price")).alias("notional")
    ).select(as_utc(F.col("_w.start")).alias("day"), "instrument", "executions", "quantity", "notional")


def upsert_batch(batch: DataFrame, no: int, path: str) -> None:
    """Writes a batch of changed totals under its number; replays overwrite."""
    batch.write.mode("overwrite").parquet(f"{path}/batch={no}")


def latest_totals(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    d = spark.read.option("basePath", path).parquet(path)
    rest = [c for c in d.columns if c not in (*keys, "batch")]
    return d.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


ISSUES = "event_id bigint, instrument string, issues string"


def tick_quality(batch: DataFrame, no: int, path: str, max_spread: float = 0.005, max_jump: float = 0.02) -> None:
    """Writes the tick problems of a batch against the previous tick of the instrument by event_id; replays overwrite.

    The last tick per instrument is kept beside the output for the batch after and stands before all its ticks.  The ticks
    of a batch are compared in chunks, so no task holds an instrument.
    """
    new = batch.select(F.lit(1).alias("_new"), "event_id", "instrument", "ts", "bid", "ask")
    rows = materialise(new)
    rows = _carried(batch.sparkSession, path, no, rows).withColumn("_new", F.lit(0)).unionByName(rows)
    last = rows.groupBy("instrument").agg(F.max_by(F.struct(*rows.columns), F.struct("_new", "event_id")).alias("_r")).select("_r.*")
    last.write.mode("overwrite").parquet(f"{path}-kept/batch={no}")
    by = F.when(F.col("_new") == 0, -(2**62)).otherwise(F.shiftright("event_id", 16))
    found = tick_issues(rows, max_spread, max_jump, s=Series(order=("_new", "event_id"), slice_by=by))
    bad = found.where((F.col("_new") == 1) & (F.size("issues") > 0))
    bad.select("event_id", "instrument", F.array_join("issues", ",").alias("issues")).write.mode("overwrite").parquet(f"{path}/batch={no}")


def spaced_alerts(alerts: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """Alerts at least ``seconds`` after the last one let through of their key (event_id, keys, ts);
    that time is the only state, and the step jumps from one alert kept to the next."""
    wait = np.timedelta64(seconds, "s")

    def step(key, batches, state):
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["ts", "event_id"], kind="stable")
        ts, kept = rows["ts"].to_numpy(), []
        at = int(np.searchsorted(ts, np.datetime64(state.get[0]) + wait)) if state.exists else 0
        while at < len(ts):
            kept.append(at)
            at = int(np.searchsorted(ts, ts[at] + wait))
        if kept:
            state.update((rows["ts"].iloc[kept[-1]],))
        yield rows.iloc[kept]

    return alerts.groupBy(*keys).applyInPandasWithState(step, alerts.schema, "sent timestamp_ntz", "append", GroupStateTimeout.NoTimeout)


def control_state(orders: DataFrame, commands: DataFrame, buckets: int = 16) -> DataFrame:
    """Kill switch and shadow mode in force at each order (event_id, ts): the last command of each kind at
    or before it.  Commands are few and go to every bucket of orders, so orders spread over tasks."""
    none = F.lit(None)
    k = commands.select(F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), none.cast("bigint").alias("event_id"), "ts", "action")
    o = orders.select(F.pmod(F.xxhash64("event_id"), F.lit(buckets)).cast("int").alias("bucket"), "event_id", "ts", none.cast("string").alias("action"))

    def step(key, batches, state):
        rows = pd.concat(list(batches), ignore_index=True)
        rows = rows.assign(_order=rows["event_id"].notna()).sort_values(["ts", "_order"], kind="stable")
        before = state.get if state.exists else (False, False)
        out, last = {}, []
        for name, old in zip(("kill_switch", "shadow_mode"), before, strict=True):
            now = rows["action"].map({f"{name}_on": 1.0, f"{name}_off": 0.0}).ffill().fillna(float(old))
            out[name] = now.astype(bool)
            last.append(bool(now.iloc[-1]))
        state.update(tuple(last))
        yield rows.assign(**out)[rows["_order"]][["event_id", "ts", "kill_switch", "shadow_mode"]].astype({"event_id": "int64"})

    return k.union(o).groupBy("bucket").applyInPandasWithState(
        step, "event_id bigint, ts timestamp_ntz, kill_switch boolean, shadow_mode boolean", "kill boolean, shadow boolean", "append", GroupStateTimeout.NoTimeout
    )


def feed_staleness(ticks: DataFrame, warn: float = 10, critical: float = 30, delay: str = "1 minute") -> DataFrame:
    """(instrument, last_ts, status) for every silence of a feed longer than ``warn`` seconds:
    warning or critical.  A silence that no tick has ended yet is told by a timer once the watermark is ``critical`` seconds past the
    last tick."""

    def step(key, batches, state):
        columns = ["instrument", "last_ts", "status"]
        if state.hasTimedOut:
            last = state.get[0]
            state.update((last, True))
            yield pd.DataFrame([(key[0], last, "critical")], columns=columns)
            return
        last, told = state.get if state.exists else (None, False)
        ts = pd.concat([b["ts"] for b in batches]).sort_values()
        if last is not None:
            ts = pd.concat([pd.Series([pd.Timestamp(last)]), ts]).sort_values()
        silent = ts.diff().shift(-1).dt.total_seconds()
        gap = silent > warn
        out = pd.DataFrame({"instrument": key[0], "last_ts": ts[gap], "status": np.where(silent[gap] > critical, "critical", "warning")})
        newest = ts.iloc[-1]
        state.update((newest, False))
        state.setTimeoutTimestamp(max(int((newest.timestamp() + critical) * 1000), state.getCurrentWatermarkMs() + 1))
        yield out[out["last_ts"] != last] if told else out

    at = ticks.select("instrument", "ts", as_instant("ts").alias("at")).withWatermark("at", delay)
    return at.groupBy("instrument").applyInPandasWithState(
        step, "instrument string, last_ts timestamp_ntz, status string", "last timestamp_ntz, told boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def unique_signals(signals: DataFrame, memory: str = "30 days", key: str = "signal_id", ts: str = "ts") -> DataFrame:
    """First message per signal id within the memory span."""
    return signals.withColumn(ts, as_instant(ts)).withWatermark(ts, memory).dropDuplicatesWithinWatermark([key])


class BacklogListener(StreamingQueryListener):
    """Rows done per stream, late rows and the backlog that its sources report, as a table.

    Sources that report no offsets (files) get their backlog from counts of what
    was written.  Keeps one entry per stream, however long it runs.
    """

    def __init__(self) -> None:
        self.seen: dict[str, tuple[int, int, int]] = {}
        self._ended = threading.Condition()
        self._over: set[str] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        name = p.name or str(p.id)
        done, late, _ = self.seen.get(name, (0, 0, 0))
        behind = sum(int(float((s.metrics or {}).get("maxOffsetsBehindLatest", 0))) for s in p.sources)
        self.seen[name] = (done + int(p.numInputRows), late + sum(int(s.numRowsDroppedByWatermark) for s in p.stateOperators), behind)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._ended:
            self._over.add(str(event.runId))
            self._ended.notify_all()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Returns when the last event of an ended query has arrived."""
        with self._ended:
            if not self._ended.wait_for(lambda: str(query.runId) in self._over, seconds):
                raise TimeoutError(f"no end of stream {query.name} within {seconds} s")

    def stats(self, spark: SparkSession, written: DataFrame | None = None) -> DataFrame:
        """stream, produced, acknowledged and late for ``risk.backlog_alerts``; ``written`` (stream,
        produced) replaces the backlog that sources report."""
        rows = [(name, done + behind, done, late) for name, (done, late, behind) in self.seen.items()]
        d = spark.createDataFrame(rows, "stream string, produced bigint, acknowledged bigint, late bigint")
        return d if written is None else d.drop("produced").join(written, "stream").select("stream", "produced", "acknowledged", "late")
