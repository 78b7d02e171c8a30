"""Hand-computed values and small references for single operators."""

import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.functions import costs
from barlume.operators import (
    align, dependence as dp, evaluate as ev, features as fe, labels as lb, models as md, quality, risk as rk, rules as ru, series as sr, sessions as se, trades as tr,
)
from tests.test_series import SMALL, frame, walk

T0 = pd.Timestamp("2024-01-01")


def bars(spark, closes, hours=1, **cols):
    n = len(closes)
    pdf = pd.DataFrame({"instrument": "x", "ts": [T0 + pd.Timedelta(hours=hours * i) for i in range(n)], "close": np.asarray(closes, float)})
    for c in ("open", "high", "low"):
        pdf[c] = cols.get(c, pdf["close"])
    pdf["volume"] = cols.get("volume", 1)
    for c, v in cols.items():
        pdf[c] = v
    return frame(spark, pdf)


def test_round_trip_trade_and_fees(spark):
    fills = frame(spark, pd.DataFrame({"instrument": "x", "seq": [1, 2], "ts": [T0, T0 + pd.Timedelta(hours=1)], "side": ["BUY", "SELL"], "quantity": 10000, "price": [1.10000, 1.10086], "commission": 1.0}))
    t = tr.fifo_trades(fills).toPandas()
    assert len(t) == 1 and t["pnl"][0] == pytest.approx(6.6) and t["commission"][0] == pytest.approx(2.0)


def test_fifo_against_sequential_matching(spark):
    rng = np.random.default_rng(4)
    n = 300
    f = pd.DataFrame({"instrument": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "ts": T0, "side": rng.choice(["BUY", "SELL"], n), "quantity": rng.integers(1, 900, n), "price": rng.random(n) * 10 + 100, "commission": 0.0})
    f["seq"] = f.groupby("instrument").cumcount() + 1
    got = tr.fifo_trades(frame(spark, f), 500).toPandas()
    want = []
    for k, g in f.groupby("instrument"):
        lots = []
        for r in g.itertuples():
            q = r.quantity
            while q and lots and lots[0][1] != r.side:
                m = min(q, lots[0][2])
                want.append((k, r.seq, lots[0][0], m))
                lots[0][2] -= m
                q -= m
                if not lots[0][2]:
                    lots.pop(0)
            if q:
                lots.append([r.seq, r.side, q])
    assert sorted(zip(got["instrument"], got["exit_seq"], got["entry_seq"], got["quantity"])) == sorted(want)


def test_metric_toy(spark):
    d = frame(spark, pd.DataFrame({"instrument": "x", "ts": [T0 + pd.Timedelta(hours=i) for i in range(3)], "pnl": [10.0, -5.0, -10.0]}))
    s = tr.trade_stats(d.withColumn("pnl", F.when(F.col("pnl") == -10, 15.0).otherwise(F.col("pnl"))), ["instrument"], 100.0).first()
    assert s["win_rate"] == pytest.approx(2 / 3) and s["profit_factor"] == pytest.approx(5.0)
    c = tr.equity_curve(d, 100.0, sr.Series(keys=())).toPandas().sort_values("ts")
    assert c["equity"].tolist() == [110.0, 105.0, 95.0] and c["drawdown"].max() == pytest.approx(15 / 110)


def test_higher_timeframe_visible_only_when_complete(spark):
    base = bars(spark, range(10), hours=0.25)
    slow = frame(spark, pd.DataFrame({"instrument": "x", "ts": [T0 + pd.Timedelta(hours=i) for i in range(3)], "regime": [10.0, 20.0, 30.0]}))
    got = align.align_completed(base, slow, ["regime"]).toPandas().sort_values("ts")["regime"].tolist()
    assert [x if x == x else None for x in got] == [None] * 4 + [10.0] * 4 + [20.0] * 2


def test_triple_barrier_rules(spark):
    cfg = lb.BarrierConfig(take={"asia": 1.0}, stop={"asia": 1.0}, horizon={"asia": 3}, band={"asia": 0.0}, vol_col="sigma")
    d = bars(spark, [100, 100, 100, 100, 100, 100], high=[100, 100.5, 101.5, 100, 101.5, 100], low=[100, 99.5, 99.8, 98.5, 98.5, 100], sigma=1.0, session_bucket="asia", spread_proxy_bps=0.01, event_window_flag=[0, 0, 0, 0, 0, 1])
    got = lb.triple_barrier(d, cfg).toPandas().sort_values("ts")
    assert got["y_dir"].tolist()[:4] == [1, 1, -1, 0]
    assert got["label_horizon_bars"].tolist()[:4] == [2, 1, 1, 1]
    assert got["label_state"].iloc[5] == "excluded_event" and pd.isna(got["y_dir"].iloc[5])


def test_class_weights(spark):
    d = spark.createDataFrame([("asia", 1), ("asia", 1), ("asia", 0), ("asia", -1)], "session_bucket string, y_dir int")
    w = {r["y_dir"]: r["weight"] for r in lb.class_weights(d).collect()}
    assert w == {1: pytest.approx(4 / 6), 0: pytest.approx(4 / 3), -1: pytest.approx(4 / 3)}


def test_session_edges_in_london_summer_time(spark):
    ts = ["2024-07-01 06:59:00", "2024-07-01 07:00:00", "2024-01-01 07:59:00", "2024-01-01 08:00:00", "2024-07-01 23:00:00"]
    d = spark.createDataFrame([(x,) for x in ts], "t string").select(F.col("t").cast("timestamp_ntz").alias("ts"))
    assert [r[0] for r in d.select(se.session_bucket()).collect()] == ["pre_london", "london_open", "pre_london", "london_open", "asia"]


def test_leak_detector_positive_and_negative(spark):
    d = se.developing_state(se.with_sessions(bars(spark, [1, 2, 3, 2, 1], high=[1, 2, 3, 2, 1], low=[1, 2, 3, 2, 1])))
    clean = se.future_extreme_leaks(d, "current_session_developing_high", "current_session_developing_low")
    assert clean.count() == 0
    leaky = se.future_extreme_leaks(d.withColumn("bad", F.lit(3.0)), "bad", "current_session_developing_low")
    assert leaky.count() == 2


def test_trigger_overlap_toy(spark):
    d = spark.createDataFrame(list(zip([1, 0, 1, 0, 0, 1], [1, 1, 0, 0, 0, 1])), "a int, b int")
    r = dp.trigger_overlap(d, ["a", "b"]).first()
    assert r["overlap_count"] == 2 and r["jaccard"] == pytest.approx(0.5)


def test_suppression_brute_force(spark):
    rng = np.random.default_rng(8)
    names = ["s0", "s1", "s2", "s3"]
    pairs = [(a, b, float(rng.random() * 2)) for i, a in enumerate(names) for b in names[i + 1:]]
    rows = [(t, n, int(rng.integers(-1, 2)), float(np.round(rng.random(), 1)), None if n == "s2" else float(rng.random())) for t in range(60) for n in names]
    cand = spark.createDataFrame(rows, "ts int, sleeve string, signal int, expected_utility double, recent_brier double")
    got = dp.suppress_redundant(cand, spark.createDataFrame(pairs, "a string, b string, pair_penalty double"), 1.0).toPandas()
    out = {(r.ts, r.sleeve): (r.signal, r.suppressed) for r in got.itertuples()}
    for t in range(60):
        g = {r[1]: list(r[2:]) for r in rows if r[0] == t}
        active = [n for n in names if g[n][0] != 0]
        live = [p for p in pairs if p[0] in active and p[1] in active]
        pen = {n: sum(p[2] for p in live if n in p[:2]) for n in names}
        key = lambda n: (g[n][1], -g[n][2] if g[n][2] is not None else -np.inf, -pen[n], n)
        sig, off = {n: g[n][0] for n in names}, set()
        for a, b, v in live:
            if v >= 1.0 and sig[a] and sig[b]:
                loser = b if key(a) >= key(b) else a
                sig[loser] = 0
                off.add(loser)
        assert {n: out[(t, n)] for n in names} == {n: (sig[n], n in off) for n in names}


def test_ridge_and_platt_against_numpy(spark):
    rng = np.random.default_rng(6)
    n = 500
    x = rng.normal(size=(n, 2))
    y = (x @ [1.0, -0.5] + rng.normal(size=n) > 0).astype(int)
    d = spark.createDataFrame(pd.DataFrame({"f": x[:, 0], "g": x[:, 1], "y": y, "session": "x", "score": x[:, 0], "y_true": y}))
    m = md.fit_ridge(d, ["f", "g"], "y")
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 1e-3 * np.eye(2), z.T @ y)
    np.testing.assert_allclose(m["weights"], beta, rtol=1e-9)
    p = np.clip(1 / (1 + np.exp(-z @ beta)), 1e-6, 1 - 1e-6)
    assert m["intercept"] == pytest.approx(np.mean(y - np.log(p / (1 - p))))
    r = md.fit_platt(d, "session").first()
    q = 1 / (1 + np.exp(-(r["a"] * x[:, 0] + r["b"])))
    assert abs(np.sum(q - y)) < 1e-3 and abs(np.sum((q - y) * x[:, 0])) < 1e-3


def test_regime_assignment_toy(spark):
    c = spark.createDataFrame([([("0", [0.0, 0.0]), ("1", [10.0, 10.0])],)], "centers array<struct<regime:string,center:array<double>>>")
    r = ru.assign_regime(spark.createDataFrame([([0.1, 0.2],)], "features array<double>"), c).first()
    assert r["regime"] == "0" and r["probability"] == pytest.approx(1.0)


def test_causality_of_feature_frames(spark):
    d = frame(spark, walk(400, keys=("a", "b")))
    cut = F.lit("2024-05-01 00:00:00").cast("timestamp_ntz")
    for s in (sr.BARS, SMALL):
        r = quality.causality_check(d, cut, lambda x: fe.base_frame(x, s), fe.SEQ_COLUMNS, s).first()
        assert r["compared"] > 50 and r["mismatches"] == 0


def test_feature_frame_same_in_small_chunks(spark):
    d = frame(spark, walk(500, keys=("a",)))
    cols = [F.round(c, 8).alias(c) for c in fe.SEQ_COLUMNS]
    a = fe.base_frame(d).select("ts", *cols)
    b = fe.base_frame(d, SMALL).select("ts", *cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_daily_limits_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(200):
        ts = T0 + pd.Timedelta(minutes=int(40 * i))
        gone = rng.random() < 0.15
        rows.append(("x", ts, None if gone else ts + pd.Timedelta(minutes=int(rng.integers(15, 300))), None if gone else str(rng.choice(["stop_loss", "take_profit"]))))
    plain = [(i, ts.to_pydatetime(), ex.to_pydatetime() if ex is not None else None, why) for i, ts, ex, why in rows]
    d = spark.createDataFrame(plain, "instrument string, ts timestamp_ntz, exit_ts timestamp_ntz, exit_reason string")
    got = ru.daily_limits(d, 2, 3).toPandas()["ts"].tolist()
    want, losses, open_, day, taken = [], 0, None, None, 0
    for _, ts, ex, why in rows:
        if ts.date() != day:
            if open_ is not None and open_[0] is not None and open_[0].date() == day:
                losses = losses + 1 if open_[1] == "stop_loss" else 0
            day, taken, open_ = ts.date(), 0, None
        if open_ is not None and open_[0] is not None and open_[0] <= ts:
            losses = losses + 1 if open_[1] == "stop_loss" else 0
            open_ = None
        if taken < 2 and losses < 3 and open_ is None:
            want.append(ts)
            taken += 1
            open_ = (ex, why)
    assert sorted(got) == want


def test_calibration_and_psi(spark):
    rng = np.random.default_rng(12)
    p = np.round(rng.random(2000), 3)
    y = (rng.random(2000) < p).astype(int)
    d = spark.createDataFrame(pd.DataFrame({"prob": p, "y_true": y}))
    i = np.digitize(p, np.linspace(0, 1, 11)[1:-1], right=True)
    want = sum((i == b).mean() * abs(y[i == b].mean() - p[i == b].mean()) for b in range(10))
    assert ev.calibration_error(d, []).first()["ece"] == pytest.approx(want)
    v = pd.DataFrame({"v": np.r_[rng.normal(0, 1, 1500), rng.normal(0.3, 1.2, 1200)], "ref": [True] * 1500 + [False] * 1200})
    r, c = v["v"][v["ref"]], v["v"][~v["ref"]]
    e = np.unique(np.quantile(r, np.linspace(0, 1, 11)))
    rp, cp = (np.clip(np.histogram(z, e)[0] / np.histogram(z, e)[0].sum(), 1e-6, None) for z in (r, c))
    assert ev.psi(spark.createDataFrame(v), [], "v", F.col("ref")).first()["psi"] == pytest.approx(np.sum((cp - rp) * np.log(cp / rp)))


def test_circuit_breaker_stays_on(spark):
    pnl = [-1.0, -1.0, 5.0, -1.0, -1.0, -1.0, 9.0]
    d = frame(spark, pd.DataFrame({"ts": [T0 + pd.Timedelta(hours=2 * i) for i in range(7)], "pnl": pnl}))
    s = sr.Series(keys=(), slice_seconds=86400, chunk_rows=2)
    got = rk.circuit_breaker(d, 1000.0, s, {**rk.LIMITS, "loss_streak": 3}).toPandas().sort_values("ts")
    assert got["loss_streak"].tolist() == [1, 2, 0, 1, 2, 3, 0]
    assert got["halted"].tolist() == [False] * 5 + [True, True]


def test_fill_price_pips(spark):
    d = spark.createDataFrame([("EUR_USD", "BUY", 1.1), ("USD_JPY", "SELL", 150.0)], "i string, s string, m double")
    r = [x[0] for x in d.select(costs.fill_price(F.col("m"), F.col("s"), F.col("i"))).collect()]
    assert r == [pytest.approx(1.10007), pytest.approx(149.993)]


def test_trade_orders_brute_force(spark):
    """Both forms against one walk per order; repeated keys, equal and missing pnl."""
    rng = np.random.default_rng(3)
    rows = [(f"t{i % 37}", None if i == 5 else float(x)) for i, x in enumerate(rng.normal(0, 60, 40).round(0))]
    d = spark.createDataFrame(rows, "name string, pnl double")
    initial, sims = 100.0, 30
    listed = sorted((hashlib.md5(k.encode()).hexdigest(), p or 0.0) for k, p in rows)
    want = {}
    for sim in range(sims):
        order = sorted((tr._place(int(k[:12], 16) % (2**31 - 1), sim, 42), k, p) for k, p in listed)
        equity = peak = initial
        deepest = 0.0
        for *_, p in order:
            equity += p
            peak = max(peak, equity)
            deepest = max(deepest, (peak - equity) / peak)
        want[sim] = (round(deepest, 9), round(equity, 6))
    got = lambda df: {r["sim"]: (round(r["max_drawdown"], 9), round(r["final_equity"], 6)) for r in df.collect()}
    key = F.col("name")
    assert got(tr.permute_trades(d, key, initial, sims, block=7)) == want
    assert got(tr.permute_by_scans(d, key, initial, sims)) == want
    assert got(tr.permute_trades(d, key, initial, sims, most=39)) == want
    assert tr.permute_trades(d.limit(0), key, initial, sims).count() == 0


def test_trade_orders_are_even():
    """Every trade comes first about equally often, and neighbours fall in either order."""
    h = np.array([int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16) % (2**31 - 1) for i in range(20)])
    places = np.array([tr._place(h, sim, 42) for sim in range(10_000)])
    first = np.bincount(places.argmin(axis=1), minlength=20)
    assert ((first - 500) ** 2 / 500).sum() < 45
    assert abs((places[:, 0] < places[:, 1]).mean() - 0.5) < 0.02
    assert abs((places[:-1, 0] < places[1:, 0]).mean() - 0.5) < 0.02
