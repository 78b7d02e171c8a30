"""Trade-accounting queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from barlume.functions import costs
from barlume.operators import series as sr, sessions as se, trades as tr
from barlume.plans import sqltext as q
from barlume.plans.registry import query, sql_view, view

lag, OVER = q.lag, q.OVER


@view("trades", """SELECT b.instrument, CASE WHEN b.seq < s.seq THEN s.ts ELSE b.ts END AS ts, greatest(b.seq, s.seq) AS exit_seq, least(b.seq, s.seq) AS entry_seq, CASE WHEN b.seq < s.seq THEN 'BUY' ELSE 'SELL' END AS entry_side,
  least(b.hi, s.hi) - greatest(b.lo, s.lo) AS quantity, CASE WHEN b.seq < s.seq THEN b.price ELSE s.price END AS entry_price, CASE WHEN b.seq < s.seq THEN s.price ELSE b.price END AS exit_price,
  (b.commission / b.quantity + s.commission / s.quantity) * (least(b.hi, s.hi) - greatest(b.lo, s.lo)) AS commission,
  (s.price - b.price) * (least(b.hi, s.hi) - greatest(b.lo, s.lo)) - (b.commission / b.quantity + s.commission / s.quantity) * (least(b.hi, s.hi) - greatest(b.lo, s.lo)) AS pnl
  FROM unit_buckets b JOIN unit_buckets s ON b.instrument = s.instrument AND b.k = s.k AND b.side = 'BUY' AND s.side = 'SELL' AND b.lo < s.hi AND s.lo < b.hi AND greatest(b.lo, s.lo) // 64 = b.k""")
def trades(t):
    return sr.materialise(tr.fifo_trades(t.fills_table))


sql_view("units", """SELECT *, hi - quantity AS lo FROM (SELECT *, CAST(sum(quantity) OVER (PARTITION BY instrument, side ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS hi FROM fills)""")
sql_view("unit_buckets", "SELECT *, unnest(range(CAST(lo // 64 AS BIGINT), CAST((hi - 1) // 64 AS BIGINT) + 1)) AS k FROM units")


@view("fills_table", "SELECT * FROM fills")
def fills_table(t):
    """Fills with their sequence, written once."""
    return sr.materialise(t.fills)


_SIGS = f"""SELECT instrument || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS position_id, instrument, ts, CASE WHEN close >= open THEN 'BUY' ELSE 'SELL' END AS side, close, open FROM bars_h1"""


def bar_signals(t):
    return t.bars_h1.select(
        F.concat_ws("|", "instrument", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("position_id"), "instrument", "ts",
        F.when(F.col("close") >= F.col("open"), "BUY").otherwise("SELL").alias("side"), "close", "open",
    )


@query("b01_next_open_fill", "position_id fill_ts fill_mid:r", "SELECT * FROM (SELECT position_id, lead(ts) OVER (PARTITION BY instrument ORDER BY ts) AS fill_ts, lead(open) OVER (PARTITION BY instrument ORDER BY ts) AS fill_mid FROM sg) WHERE fill_ts IS NOT NULL", sg=_SIGS)
def _(t):
    return tr.next_open_fill(bar_signals(t).drop("open"), t.bars_h1)


@query("b01_touch_fill", "position_id fill_ts", """SELECT position_id, min(b.ts) AS fill_ts FROM (SELECT *, close * CASE WHEN side = 'BUY' THEN 0.7 ELSE 1.3 END AS ep FROM sg) s LEFT JOIN bars_h1 b ON b.instrument = s.instrument AND b.ts >= s.ts
  AND CASE WHEN side = 'BUY' THEN b.low <= ep ELSE b.high >= ep END GROUP BY position_id""", sg=_SIGS)
def _(t):
    sig = bar_signals(t).withColumn("entry_price", F.col("close") * F.when(F.col("side") == "BUY", 0.7).otherwise(1.3))
    return tr.touch_fill(sr.materialise(sig), t.bars_h1)


_POS = """SELECT *, close * CASE WHEN side = 'BUY' THEN 0.6 ELSE 1.4 END AS stop, close * CASE WHEN side = 'BUY' THEN 1.8 ELSE 0.5 END AS target FROM sg"""


def bar_positions(t):
    buy = F.col("side") == "BUY"
    return sr.materialise(bar_signals(t).select(
        "position_id", "instrument", "side", F.col("ts").alias("start_ts"), F.col("close").alias("entry_price"),
        (F.col("close") * F.when(buy, 0.6).otherwise(1.4)).alias("stop"), (F.col("close") * F.when(buy, 1.8).otherwise(0.5)).alias("target"),
    ))


_EXITS = """SELECT p.position_id, p.instrument, p.side, p.ts AS start_ts, p.close AS entry_price, p.stop, p.target, x.exit_ts, CASE WHEN x.exit_ts IS NULL THEN NULL WHEN x.st THEN 'stop_loss' ELSE 'take_profit' END AS exit_reason,
  CASE WHEN x.st THEN p.stop WHEN x.exit_ts IS NOT NULL THEN p.target END AS exit_price FROM po p LEFT JOIN (SELECT position_id, min(b.ts) AS exit_ts, arg_min(CASE WHEN side = 'BUY' THEN b.low <= stop ELSE b.high >= stop END, b.ts) AS st
  FROM po JOIN bars_h1 b ON b.instrument = po.instrument AND b.ts >= po.ts AND CASE WHEN side = 'BUY' THEN b.low <= stop OR b.high >= target ELSE b.high >= stop OR b.low <= target END GROUP BY position_id) x USING (position_id)"""


@query("b02_exit_resolution", "position_id exit_ts exit_reason exit_price:r", "SELECT * FROM ex", sg=_SIGS, po=_POS, ex=_EXITS)
def _(t):
    return tr.resolve_exits(bar_positions(t), t.bars_h1)


# Test instruments named as currency pairs for the pip tables.
FX = {"click": "EUR_USD", "error": "USD_JPY", "purchase": "GBP_JPY", "signup": "XAU_USD", "view": "AUD_USD"}
_FXC = "CASE instrument " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in FX.items()) + " END"


@query("b03_b04_fill_price_commission", "event_id fill:r core:r spread_only:r fixed:r", f"""SELECT event_id, price + CASE WHEN event_id % 2 = 0 THEN 1 ELSE -1 END * (CASE fx WHEN 'EUR_USD' THEN 1.4 WHEN 'USD_JPY' THEN 1.4 WHEN 'GBP_JPY' THEN 3.1 WHEN 'AUD_USD' THEN 1.4 ELSE 1.5 END / 2 + 0.3)
   * CASE WHEN fx LIKE '%\\_JPY' ESCAPE '\\' THEN 0.01 ELSE 0.0001 END AS fill, volume / 10000.0 AS core, 0.0 AS spread_only, 2.5 AS fixed FROM (SELECT *, {_FXC} AS fx FROM ticks)""")
def _(t):
    fx = F.lit(None)
    for a, b in FX.items():
        fx = F.when(F.col("instrument") == a, b).otherwise(fx)
    d = t.ticks.withColumns({"fx": fx, "side": F.when(F.col("event_id") % 2 == 0, "BUY").otherwise("SELL")})
    q_ = F.col("volume")
    return d.select("event_id", costs.fill_price(F.col("price"), F.col("side"), F.col("fx"), 0.3).alias("fill"), costs.commission(q_).alias("core"),
                    costs.commission(q_, "spread_only").alias("spread_only"), costs.commission(q_, "fixed", 2.5).alias("fixed"))


@query("b05_fifo_trades", "instrument ts exit_seq:i entry_seq:i entry_side quantity:i entry_price:r5 exit_price:r5 commission:r pnl:r4", "SELECT * FROM trades")
def _(t):
    return tr.fifo_trades(t.fills_table)


CURVE = sr.Series(keys=(), order=("ts", "instrument", "exit_seq", "entry_seq"), slice_seconds=86400)
_EQ = {"eq0": "SELECT *, 100000000.0 + sum(pnl) OVER o AS equity FROM trades WINDOW o AS (ORDER BY ts, instrument, exit_seq, entry_seq ROWS UNBOUNDED PRECEDING)",
       "eq1": "SELECT *, greatest(100000000.0, max(equity) OVER (ORDER BY ts, instrument, exit_seq, entry_seq ROWS UNBOUNDED PRECEDING)) AS peak FROM eq0"}


@query("b06_equity_curve", "instrument exit_seq:i entry_seq:i equity:r2 drawdown:r6", "SELECT *, (peak - equity) / peak AS drawdown FROM eq1", **_EQ)
def _(t):
    return tr.equity_curve(t.trades, 100000000.0, CURVE)


@query("b06_max_drawdown", "max_drawdown:r", "SELECT max((peak - equity) / peak) AS max_drawdown FROM eq1", **_EQ)
def _(t):
    return tr.equity_curve(t.trades, 100000000.0, CURVE).agg(F.max("drawdown").alias("max_drawdown"))


@query("b07_b08_trade_stats", "instrument trades:i win_rate:r expectancy:r4 net_pnl:r2 profit_factor:r profit_factor_infinite sharpe_raw:r sharpe:r", """SELECT instrument, count(*) AS trades, avg(CASE WHEN pnl > 0 THEN 1.0 ELSE 0 END) AS win_rate, avg(pnl) AS expectancy, sum(pnl) AS net_pnl,
  sum(greatest(pnl, 0)) / nullif(sum(greatest(-pnl, 0)), 0) AS profit_factor, sum(greatest(-pnl, 0)) = 0 AND sum(greatest(pnl, 0)) > 0 AS profit_factor_infinite, avg(pnl) / stddev_samp(pnl) AS sharpe_raw, avg(pnl) / stddev_samp(pnl) * sqrt(count(*)) AS sharpe FROM trades GROUP BY instrument""")
def _(t):
    return tr.trade_stats(t.trades, ["instrument"], 100000.0)


@query("b09_financing", "position_id roll_day financing:r", """SELECT n.position_id, n.roll_day, n.entry_price * 0 + 10 * coalesce(b.close, n.entry_price) * CASE WHEN n.side = 'BUY' THEN 0.03 ELSE -0.01 END / 365 * CASE WHEN isodow(n.roll_day) = 3 THEN 3 ELSE 1 END AS financing FROM (
   SELECT *, CAST(unnest(generate_series(CAST(start_ts - INTERVAL '22 hours' AS DATE) + 1, CAST(exit_ts - INTERVAL '22 hours' AS DATE), INTERVAL '1 day')) AS DATE) AS roll_day FROM ex WHERE exit_ts IS NOT NULL) n
   ASOF LEFT JOIN bars_h1 b ON b.instrument = n.instrument AND n.roll_day + INTERVAL '22 hours' > b.ts""", sg=_SIGS, po=_POS, ex=_EXITS)
def _(t):
    pos = sr.materialise(tr.resolve_exits(bar_positions(t), t.bars_h1).where("exit_ts IS NOT NULL"))
    pos = pos.select("position_id", "instrument", "side", F.col("start_ts").alias("open_ts"), F.col("exit_ts").alias("close_ts"), "entry_price", F.lit(10).alias("quantity"))
    return tr.financing(pos, t.bars_h1, 0.03, -0.01)


@query("b10_mark_to_market", "instrument realised:r2 unrealised:r2 reserved:r4 net_quantity:i equity:r2", """SELECT instrument, coalesce(realised, 0) AS realised, coalesce(unrealised, 0) AS unrealised, coalesce(reserved, 0) AS reserved, coalesce(nq, 0) AS net_quantity,
   1000000 + coalesce(realised, 0) + coalesce(unrealised, 0) - coalesce(reserved, 0) AS equity FROM (SELECT instrument, sum(pnl) AS realised FROM trades GROUP BY 1) r FULL JOIN (
   SELECT u.instrument, sum((px - price) * oq * sg) AS unrealised, sum(oq * commission / quantity) AS reserved, sum(oq * sg) AS nq FROM (SELECT *, CASE WHEN side = 'BUY' THEN 1 ELSE -1 END AS sg, hi - greatest(lo, least(tb, ts_)) AS oq FROM units
     JOIN (SELECT instrument, sum(quantity) FILTER (side = 'BUY') AS tb, sum(quantity) FILTER (side = 'SELL') AS ts_, arg_max(price, seq) AS px FROM fills GROUP BY 1) USING (instrument)) u WHERE oq > 0 GROUP BY 1) x USING (instrument)""")
def _(t):
    return tr.mark_to_market(t.fills_table, t.trades, 1000000.0)


@query("b11_net_positions", "instrument seq:i net_quantity:i", "SELECT instrument, seq, sum(CASE WHEN side = 'BUY' THEN quantity ELSE -quantity END) OVER (PARTITION BY instrument ORDER BY seq ROWS UNBOUNDED PRECEDING) AS net_quantity FROM fills")
def _(t):
    return tr.net_positions(t.fills_table)


@query("b12_exposure_screen", "o_orderkey exposure:r2 breach", "SELECT o_orderkey, sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS exposure, sum(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) > 300000000 AS breach FROM orders")
def _(t):
    d = t.orders.select("o_orderkey", F.col("o_orderpriority").alias("instrument"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("notional"))
    return tr.exposure_screen(d, 300000000.0, sr.Series(order=("ts", "o_orderkey")))


@query("b13_order_fills", "order_id ordered:i filled:i fill_share:r vwap:r", """SELECT l_orderkey AS order_id, sum(l_quantity) AS ordered, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) AS filled, coalesce(sum(l_quantity) FILTER (l_linestatus = 'F'), 0) / sum(l_quantity) AS fill_share,
   sum(l_extendedprice) FILTER (l_linestatus = 'F') / sum(l_quantity) FILTER (l_linestatus = 'F') AS vwap FROM lineitem GROUP BY 1""")
def _(t):
    li = t.lineitem
    ordered = li.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.sum("l_quantity").alias("ordered"))
    ex = li.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("filled"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"))
    return tr.order_fill_summary(ordered, ex)


@query("b14_journal", "day month instrument:i mode executions:i quantity:i notional:r2 commission:r4", """SELECT strftime(l_shipdate, '%Y-%m-%d') AS day, strftime(l_shipdate, '%Y-%m') AS month, l_suppkey % 10 AS instrument, o_orderstatus AS mode, count(*) AS executions, sum(l_quantity) AS quantity,
   sum(l_extendedprice) AS notional, sum(l_quantity / 10000) AS commission FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY GROUPING SETS ((day), (month), (day, instrument), (month, instrument), (day, mode), (month, mode))""")
def _(t):
    d = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_shipdate").alias("ts"), (F.col("l_suppkey") % 10).alias("instrument"), F.col("o_orderstatus").alias("mode"), F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), (F.col("l_quantity") / 10000).alias("commission"))
    return tr.journal(d)


_SLEEVES = f"""SELECT b.*, s.sleeve, (volume * s.k) % 3 - 1 AS side, ((volume * s.k) % 5) / 10.0 AS allocation, lead(close) OVER (PARTITION BY instrument, sleeve ORDER BY ts) AS close_next, (volume * s.k) % 4 > 0 AS passed, volume % 6 > 0 AS tradable,
   {"CASE " + " ".join(f"WHEN hour(ts) * 60 + minute(ts) < {end} THEN '{n}'" for n, _, end in se.SESSIONS) + " END"} AS session_bucket FROM bars_h1 b CROSS JOIN (VALUES ('asia', 1), ('london', 2), ('newyork', 4)) s(sleeve, k)"""


def sleeve_rows(t):
    d = sr.windowed(t.bars_h1.withColumn("session_bucket", se.session_bucket()), sr.BARS, lambda x, w: x.withColumn("close_next", F.lead("close").over(w)), ahead=1)
    d = d.where("close_next IS NOT NULL").withColumn("_s", F.explode(F.array(*[F.struct(F.lit(n).alias("sleeve"), F.lit(k).alias("k")) for n, k in (("asia", 1), ("london", 2), ("newyork", 4))])))
    vk = F.col("volume") * F.col("_s.k")
    return d.select("*", F.col("_s.sleeve").alias("sleeve"), (vk % 3 - 1).alias("side"), (vk % 5 / 10).alias("allocation"), (vk % 4 > 0).alias("passed"), (F.col("volume") % 6 > 0).alias("tradable")).drop("_s")


def _step_sql(src: str, keys: str, sp: str, co: str) -> dict[str, str]:
    return {
        f"{src}_a": f"SELECT *, sign(side) AS sg, ({sp}) * 0.5e-4 AS half, 100000 * 20.0 * 0.5 * allocation / sum(allocation) OVER (PARTITION BY {keys}) AS notional FROM {src} WHERE allocation > 0 AND side <> 0",
        f"{src}_b": f"SELECT *, close * (1 + sg * half) AS en, abs(notional) * ({co}) * 1e-4 * 2 AS fee FROM {src}_a",
        f"{src}_c": f"""SELECT *, notional / greatest(abs(en), 1e-12) * (close_next * (1 - sg * half) - en) * sg - fee AS net, notional / greatest(abs(en), 1e-12) * ((CASE WHEN sg > 0 THEN low ELSE high END) * (1 - sg * half) - en) * sg - fee AS worst FROM {src}_b""",
        f"{src}_d": f"SELECT *, (100000 + sum(worst) OVER (PARTITION BY {keys})) / sum(notional / 20.0) OVER (PARTITION BY {keys}) * 100 AS margin_level FROM {src}_c",
        f"{src}_e": f"SELECT *, margin_level < 50 AS stopped_out, CASE WHEN margin_level < 50 THEN worst ELSE net END AS pnl FROM {src}_d",
    }


@query("b15_sleeve_step", "instrument ts sleeve notional:r2 margin_level:r2 stopped_out pnl:r2", "SELECT * FROM slv_e WHERE pnl IS NOT NULL", slv0=_SLEEVES, slv="SELECT * FROM slv0 WHERE close_next IS NOT NULL AND close > 0", **_step_sql("slv", "instrument, ts", "2.0 + 0.5", "0.3"))
def _(t):
    return tr.sleeve_step(sleeve_rows(t).where("close > 0"), 100000.0, 2.0, 0.5, 0.3, ["instrument", "ts"])


_LAY = ", ".join(str(x) for x in tr.LAYERS)


@query("b16_cost_layers", "layer session_bucket pnl_sum:r1 trade_bars:i", "SELECT layer, session_bucket, sum(pnl) AS pnl_sum, count(DISTINCT (instrument, ts)) AS trade_bars FROM lay_e GROUP BY 1, 2", slv0=_SLEEVES,
       lay=f"SELECT * FROM slv0 CROSS JOIN (VALUES {_LAY}) l(layer, c_sp, c_sl, c_co, c_th, c_tr) WHERE close_next IS NOT NULL AND close > 0 AND (c_th = 0 OR passed) AND (c_tr = 0 OR tradable)", **_step_sql("lay", "layer, instrument, ts", "2.0 * c_sp + 0.5 * c_sl", "0.3 * c_co"))
def _(t):
    return tr.cost_layers(sleeve_rows(t).where("close > 0"), 100000.0, 2.0, 0.5, 0.3, ["instrument", "ts"])


_ORDERS = "risk_of_ruin:r mean_max_drawdown:r max_drawdown_p95:r equity_lo95:r1 equity_hi95:r1 equity_lo99:r1 equity_hi99:r1"
_TRADE_KEY = ("instrument", "exit_seq", "entry_seq")


def keyed_pnl(t):
    """What a trade order needs of the trades, written once."""
    return sr.materialise(tr.fifo_trades(t.fills_table).select(*_TRADE_KEY, "pnl"), tidy=True)


_ROUND = "(z * z % 2147483647 + z * 69069 + 12345) % 2147483647 AS z"


@query("b18_trade_permutation", _ORDERS)
def _(t):
    """10,000 orders of all trades; the same orders have a SQL form in the next query."""
    return tr.simulation_summary(tr.permute_trades(keyed_pnl(t), F.concat_ws("-", *_TRADE_KEY), 1000000000.0))


@query("b18_permutation_by_scans", _ORDERS, """SELECT avg(CASE WHEN fe < 0 THEN 1.0 ELSE 0 END) AS risk_of_ruin, avg(dd) AS mean_max_drawdown, quantile_cont(dd, 0.95) AS max_drawdown_p95,
   quantile_cont(fe, 0.025) AS equity_lo95, quantile_cont(fe, 0.975) AS equity_hi95, quantile_cont(fe, 0.005) AS equity_lo99, quantile_cont(fe, 0.995) AS equity_hi99 FROM (SELECT sim, max((peak - equity) / peak) AS dd, arg_max(equity, (z, k)) AS fe FROM pm2 GROUP BY sim)""",
       pmk="SELECT pnl, md5(instrument || '-' || exit_seq || '-' || entry_seq) AS k FROM trades",
       pm0="SELECT sim, pnl, k, (CAST('0x' || k[1:12] AS BIGINT) % 2147483647 + (sim + 1) * 1103515245 + 42 * 69069) % 2147483647 AS z FROM pmk CROSS JOIN range(100) r(sim)",
       pmr=f"SELECT sim, pnl, k, {_ROUND} FROM (SELECT sim, pnl, k, {_ROUND} FROM (SELECT sim, pnl, k, {_ROUND} FROM pm0))",
       pm1="SELECT *, 1000000000.0 + sum(pnl) OVER (PARTITION BY sim ORDER BY z, k ROWS UNBOUNDED PRECEDING) AS equity FROM pmr",
       pm2="SELECT *, greatest(1000000000.0, max(equity) OVER (PARTITION BY sim ORDER BY z, k ROWS UNBOUNDED PRECEDING)) AS peak FROM pm1")
def _(t):
    """The form for any number of trades, with 100 orders for the sake of its SQL."""
    return tr.simulation_summary(tr.permute_by_scans(keyed_pnl(t), F.concat_ws("-", *_TRADE_KEY), 1000000000.0, 100))
