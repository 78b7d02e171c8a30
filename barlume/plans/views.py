"""Market-data views over the given tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.operators import resample as rs
from barlume.operators import series as sr
from barlume.plans.registry import Tables, view


@view(
    "ticks",
    """SELECT event_id, event_type AS instrument, ts, user_id, value - 0.01 AS bid, value + 0.01 AS ask,
       value AS price, CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS volume FROM events""",
)
def ticks(t: Tables):
    return t.events.select(
        "event_id",
        F.col("event_type").alias("instrument"),
        "ts",
        "user_id",
        (F.col("value") - 0.01).alias("bid"),
        (F.col("value") + 0.01).alias("ask"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("bigint").alias("volume"),
    )


def _bars_sql(trunc: str) -> str:
    return f"""SELECT instrument, {trunc} AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high,
       min(price) AS low, last(price ORDER BY ts, event_id) AS close, CAST(sum(volume) AS BIGINT) AS volume
       FROM ticks GROUP BY instrument, {trunc}"""


def _bars(t: Tables, every: str):
    """Candles, written once per query: every later step reads the compact bar
    table (bounded by the time grid) instead of scanning the ticks again."""
    return sr.materialise(rs.ticks_to_bars(t.ticks, every))


@view("bars_m15", _bars_sql("time_bucket(INTERVAL '15 minutes', ts)"))
def bars_m15(t: Tables):
    return _bars(t, "15 minutes")


@view("bars_h1", _bars_sql("date_trunc('hour', ts)"))
def bars_h1(t: Tables):
    return _bars(t, "1 hour")


@view("bars_h4", _bars_sql("time_bucket(INTERVAL '4 hours', ts)"))
def bars_h4(t: Tables):
    return _bars(t, "4 hours")


@view("bars_d1", _bars_sql("CAST(date_trunc('day', ts) AS TIMESTAMP)"))
def bars_d1(t: Tables):
    return _bars(t, "1 day")


@view(
    "calendar",
    """SELECT ts AS event_ts FROM events WHERE event_type = 'error' AND value >
       (SELECT quantile_cont(value, 0.99) FROM events WHERE event_type = 'error')""",
)
def calendar(t: Tables):
    errors = t.events.where(F.col("event_type") == "error").select("event_type", "ts", "value")
    cut = sr.quantiles(errors, ["event_type"], "value", {"cut": 0.99})
    return sr.attach(errors, cut, ["event_type"]).where(F.col("value") > F.col("cut")).select(F.col("ts").alias("event_ts"))


@view(
    "fills",
    """SELECT l_suppkey % 10 AS instrument, row_number() OVER (PARTITION BY l_suppkey % 10 ORDER BY l_shipdate,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS seq, l_shipdate AS ts,
       CASE WHEN l_linestatus = 'O' THEN 'BUY' ELSE 'SELL' END AS side, CAST(l_quantity AS BIGINT) AS quantity,
       l_extendedprice / l_quantity AS price, l_quantity / 10000 AS commission FROM lineitem""",
)
def fills(t: Tables):
    rows = t.lineitem.select(
        (F.col("l_suppkey") % 10).alias("instrument"),
        F.col("l_shipdate").alias("ts"),
        F.when(F.col("l_linestatus") == "O", "BUY").otherwise("SELL").alias("side"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_quantity") / 10000).alias("commission"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
    )
    order = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    out = sr.running(rows, sr.Series(order=order, slice_seconds=86400), row_no="seq")
    return out.select("instrument", "seq", "ts", "side", "quantity", "price", "commission")


@view(
    "scores",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ts, o_orderpriority AS session,
       year(l_shipdate) AS fold, (l_discount - 0.05) * 40 + (l_tax - 0.04) * 20 AS score,
       1 / (1 + exp(-((l_discount - 0.05) * 40 + (l_tax - 0.04) * 20))) AS prob,
       CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y_true,
       (2 * (CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) - 1) * l_discount AS pnl, l_tax AS spread_proxy,
       l_quantity AS quantity, l_extendedprice AS notional
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def scores(t: Tables):
    j = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    score = (F.col("l_discount") - 0.05) * 40 + (F.col("l_tax") - 0.04) * 20
    y = F.when(F.col("l_returnflag") == "R", 1).otherwise(0)
    return j.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_shipdate").alias("ts"),
        F.col("o_orderpriority").alias("session"),
        F.year("l_shipdate").cast("bigint").alias("fold"),
        score.alias("score"),
        (1 / (1 + F.exp(-score))).alias("prob"),
        y.alias("y_true"),
        ((2 * y - 1) * F.col("l_discount")).alias("pnl"),
        F.col("l_tax").alias("spread_proxy"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("notional"),
    )


@view(
    "sleeve_pnl",
    """SELECT d.day, s.sleeve, coalesce(p.pnl, 0.0) AS pnl FROM
       (SELECT DISTINCT l_shipdate AS day FROM lineitem) d
       CROSS JOIN (SELECT DISTINCT l_suppkey % 4 AS sleeve FROM lineitem) s
       LEFT JOIN (SELECT l_shipdate AS day, l_suppkey % 4 AS sleeve, sum(l_extendedprice * (l_discount - 0.05)) AS pnl
                  FROM lineitem GROUP BY ALL) p ON p.day = d.day AND p.sleeve = s.sleeve""",
)
def sleeve_pnl(t: Tables):
    """One row per day and sleeve; missing days count as zero."""
    rows = t.lineitem.select(
        F.col("l_shipdate").alias("day"), (F.col("l_suppkey") % 4).alias("sleeve"),
        (F.col("l_extendedprice") * (F.col("l_discount") - 0.05)).alias("x"),
    )
    wide = rows.groupBy("day").agg(
        *[F.coalesce(F.sum(F.when(F.col("sleeve") == i, F.col("x"))), F.lit(0.0)).alias(f"s{i}") for i in range(4)]
    )
    return wide.selectExpr("day", "stack(4, 0L, s0, 1L, s1, 2L, s2, 3L, s3) AS (sleeve, pnl)")


@view(
    "positions",
    """SELECT event_id AS position_id, instrument, CASE WHEN event_id % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side,
       price AS entry, CASE WHEN event_id % 2 = 0 THEN price * 0.8 ELSE price * 1.2 END AS stop,
       CASE WHEN event_id % 2 = 0 THEN price * 1.2 ELSE price * 0.8 END AS target, ts AS opened_at FROM ticks""",
)
def positions(t: Tables):
    """Every tick opens a position, long on even ids and short on odd ones."""
    long = F.col("event_id") % 2 == 0
    return t.ticks.select(
        F.col("event_id").alias("position_id"), "instrument",
        F.when(long, "BUY").otherwise("SELL").alias("side"), F.col("price").alias("entry"),
        F.when(long, F.col("price") * 0.8).otherwise(F.col("price") * 1.2).alias("stop"),
        F.when(long, F.col("price") * 1.2).otherwise(F.col("price") * 0.8).alias("target"),
        F.col("ts").alias("opened_at"),
    )
