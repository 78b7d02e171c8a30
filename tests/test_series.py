"""Chunking must never change a result: tiny chunks against plain pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barlume.operators import align, indicators as ind, risk as rk, rules as ru, series as sr


def walk(n=400, keys=("a", "b", "c"), seed=7, gaps=True):
    rng = np.random.default_rng(seed)
    out = []
    for i, k in enumerate(keys):
        m = n if i == 0 else n // 3  # one hot key
        ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.integers(1, 30 if gaps else 2, m)), unit="h")
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, m)))
        high, low = close * (1 + rng.random(m) * 0.01), close * (1 - rng.random(m) * 0.01)
        out.append(pd.DataFrame({"instrument": k, "ts": ts, "open": close, "high": high, "low": low, "close": close, "volume": rng.integers(1, 100, m)}))
    return pd.concat(out, ignore_index=True)


def frame(spark, pdf):
    d = spark.createDataFrame(pdf)
    return d.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


SMALL = sr.Series(chunk_rows=17, slice_seconds=86400)


@pytest.mark.parametrize("s", [sr.BARS, SMALL, sr.Series(chunk_rows=1, slice_seconds=3600)])
def test_bounded_windows_match_pandas(spark, s):
    pdf = walk()
    got = sr.windowed(frame(spark, pdf), s, lambda d, w: d.withColumns({
        "m": ind.rolling(F.avg, "close", w, 20), "nxt": F.lead("close", 9).over(w), "pos": sr.position(w)}), back=19, ahead=9)
    got = got.toPandas().sort_values(["instrument", "ts"]).reset_index(drop=True)
    g = pdf.sort_values(["instrument", "ts"]).groupby("instrument")["close"]
    assert len(got) == len(pdf)
    np.testing.assert_allclose(got["m"], g.transform(lambda x: x.rolling(20).mean()), rtol=1e-9)
    np.testing.assert_allclose(got["nxt"], g.transform(lambda x: x.shift(-9)), rtol=1e-12)
    assert (got["pos"] == g.cumcount().to_numpy()).all()


@pytest.mark.parametrize("s", [sr.BARS, SMALL])
def test_running_aggregates(spark, s):
    pdf = walk()
    x = F.when(F.col("volume") > 90, F.col("volume"))
    d = sr.running(frame(spark, pdf), s, sums={"c": F.col("close") - 100}, maxs={"mx": F.col("close")}, lasts={"la": x}, prevs={"pr": x}, peaks={"pk": "c"}, row_no="n")
    got = d.toPandas().sort_values(["instrument", "ts"]).reset_index(drop=True)
    p = pdf.sort_values(["instrument", "ts"]).reset_index(drop=True)
    g = p.groupby("instrument")
    cum = (p["close"] - 100).groupby(p["instrument"]).cumsum()
    np.testing.assert_allclose(got["c"], cum, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got["pk"], cum.groupby(p["instrument"]).cummax(), rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(got["mx"], g["close"].cummax())
    v = p["volume"].where(p["volume"] > 90)
    last = v.groupby(p["instrument"]).ffill()
    np.testing.assert_array_equal(got["la"].astype(float), last)
    np.testing.assert_array_equal(got["pr"].astype(float), last.groupby(p["instrument"]).shift(1))
    np.testing.assert_array_equal(got["n"], g.cumcount() + 1)


@pytest.mark.parametrize("span", [2, 5, 50])
@pytest.mark.parametrize("s", [sr.BARS, SMALL])
def test_ewm_matches_pandas(spark, span, s):
    pdf = walk(n=900)
    got = ind.ema(frame(spark, pdf), {"e": span}, s).toPandas().sort_values(["instrument", "ts"])
    want = pdf.sort_values(["instrument", "ts"]).groupby("instrument")["close"].transform(lambda x: x.ewm(span=span, adjust=False).mean())
    np.testing.assert_allclose(got["e"].to_numpy(), want.to_numpy(), rtol=1e-9)


@pytest.mark.parametrize("s", [sr.BARS, SMALL])
def test_wilder_matches_pandas(spark, s):
    pdf = walk(n=300, keys=("a",))
    got = ind.wilder(frame(spark, pdf), 14, s).toPandas().sort_values("ts")
    c, h, l = pdf["close"], pdf["high"], pdf["low"]
    tr = pd.concat([h - l, (h - c.shift()).abs(), (l - c.shift()).abs()], axis=1).max(axis=1)
    e = lambda x: x.ewm(alpha=1 / 14, adjust=False, min_periods=14).mean()
    atr = e(tr)
    up, dn = h.diff(), -l.diff()
    pdm, mdm = np.where((up > dn) & (up > 0), up, 0.0), np.where((dn > up) & (dn > 0), dn, 0.0)
    pdi, mdi = 100 * e(pd.Series(pdm)) / (atr + 1e-9), 100 * e(pd.Series(mdm)) / (atr + 1e-9)
    adx = e(100 * (pdi - mdi).abs() / (pdi + mdi + 1e-9))
    d = c.diff()
    rsi = 100 - 100 / (1 + e(d.clip(lower=0)) / (e((-d).clip(lower=0)) + 1e-9))
    np.testing.assert_allclose(got["atr"], atr, rtol=1e-9)
    np.testing.assert_allclose(got["rsi"], rsi, rtol=1e-8)
    np.testing.assert_allclose(got["adx"], adx, rtol=1e-8)


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"k": rng.choice(["x", "y", "z"], 3000, p=[0.8, 0.15, 0.05]), "v": np.round(rng.standard_cauchy(3000), 2)})
    d = spark.createDataFrame(pdf)
    q = sr.quantiles(d, ["k"], "v", {"a": 0.01, "b": 0.5, "c": 0.993}).toPandas().set_index("k")
    for k, g in pdf.groupby("k")["v"]:
        np.testing.assert_allclose(q.loc[k, ["a", "b", "c"]].astype(float), g.quantile([0.01, 0.5, 0.993]), rtol=1e-9)
    r = sr.average_rank(d, ["k"], "v", "r").toPandas().sort_values(["k", "v"])
    want = pdf.assign(r=pdf.groupby("k")["v"].rank()).sort_values(["k", "v"])
    np.testing.assert_allclose(r["r"].to_numpy(), want["r"].to_numpy())


@pytest.mark.parametrize("s", [sr.BARS, SMALL])
def test_asof_ties_and_strictness(spark, s):
    base, slow = walk(200), walk(90, seed=9).rename(columns={"close": "x"})
    slow.loc[slow.index % 5 == 0, "ts"] = base["ts"].iloc[: len(slow)].to_numpy()[slow.index % 5 == 0]
    slow = slow.drop_duplicates(["instrument", "ts"])
    for strict in (False, True):
        got = sr.asof(frame(spark, base).select("instrument", "ts", "close"), frame(spark, slow), ["x"], s, strict=strict).toPandas().sort_values(["ts", "instrument"])
        want = pd.merge_asof(base.sort_values("ts"), slow.sort_values("ts")[["instrument", "ts", "x"]], on="ts", by="instrument", allow_exact_matches=not strict).sort_values(["ts", "instrument"])
        np.testing.assert_array_equal(got["x"].to_numpy(), want["x"].to_numpy())


@pytest.mark.parametrize("levels", [(7200, 20 * 7200), (3600, 4 * 3600, 86400, 7 * 86400), (86400,)])
def test_first_crossing_brute_force(spark, levels):
    pdf = walk(300, gaps=True)
    p = pdf.assign(position_id=range(len(pdf)), side=np.where(np.arange(len(pdf)) % 2, "BUY", "SELL"))
    sign = np.where(p["side"] == "BUY", 1, -1)
    p["stop"], p["target"] = p["close"] * (1 - sign * 0.03), p["close"] * (1 + sign * 0.05)
    bars = frame(spark, pdf)
    path = bars.select("instrument", "ts", F.col("low").alias("buy_lo"), F.col("high").alias("buy_hi"), F.col("low").alias("sell_lo"), F.col("high").alias("sell_hi"))
    pos = frame(spark, p).select("position_id", "instrument", "side", F.col("ts").alias("start_ts"), "stop", "target")
    got = align.first_crossing(pos, path, tie="ts", levels=levels).toPandas().set_index("position_id")
    for r in p.itertuples():
        f = pdf[(pdf["instrument"] == r.instrument) & (pdf["ts"] > r.ts)]
        sl = f["low"] <= r.stop if r.side == "BUY" else f["high"] >= r.stop
        tp = f["high"] >= r.target if r.side == "BUY" else f["low"] <= r.target
        hit = f[sl | tp]
        if hit.empty:
            assert pd.isna(got.loc[r.position_id, "exit_ts"])
        else:
            i = hit["ts"].idxmin()
            assert got.loc[r.position_id, "exit_ts"] == hit.loc[i, "ts"]
            assert got.loc[r.position_id, "exit_reason"] == ("stop_loss" if sl[i] else "take_profit")


@pytest.mark.parametrize("s", [sr.BARS, SMALL])
def test_cooldown_brute_force(spark, s):
    pdf = walk(300)
    pdf["bar_no"] = pdf.groupby("instrument").cumcount() + 1
    rng = np.random.default_rng(5)
    c = pdf[rng.random(len(pdf)) < 0.5].assign(direction=lambda d: rng.choice([-1, 1], len(d)))[["instrument", "ts", "bar_no", "direction"]]
    got = ru.cooldown(frame(spark, c), 5, s=s).toPandas()
    want = []
    for k, g in c.groupby("instrument"):
        last, at = 0, -10**9
        for r in g.itertuples():
            if r.bar_no - at >= 5 and r.direction != last:
                last, at = r.direction, r.bar_no
                want.append((k, r.bar_no))
    assert sorted(zip(got["instrument"], got["bar_no"])) == sorted(want)


def hysteresis_step(side, since, score, enter, leave, flip, wait):
    since = min(wait, since + 1)
    sign, size = (score > 0) - (score < 0), abs(score)
    if side == 0:
        want = sign if size >= enter else 0
    elif sign == side:
        want = side
    elif size <= leave:
        want = 0
    else:
        want = sign if sign != 0 and size >= flip else side
    if want != side and since < wait and want != 0:
        want = side
    return (want, 0) if want != side else (side, since)


def test_state_scan_is_a_walk():
    rng = np.random.default_rng(2)
    for n, n_states in ((0, 3), (1, 1), (2, 4), (9, 5), (10, 2), (257, 13)):
        moves = rng.integers(0, n_states, (n, n_states))
        ends = []
        for start in range(n_states):
            at, before = start, []
            for m in moves:
                before.append(at)
                at = m[at]
            ends.append(at)
            assert sr.state_scan(moves, start).tolist() == before
        assert sr.state_scan(moves).tolist() == ends


@pytest.mark.parametrize("fan", [2, 3, 256])
def test_chunk_starts_compose_in_blocks(spark, monkeypatch, fan):
    monkeypatch.setattr(sr, "_FAN", fan)
    rng = np.random.default_rng(3)
    rows, want = [], {}
    for key, chunks in ((None, range(5)), ("a", range(-3, 60)), ("b", sorted(rng.choice(1000, 40, replace=False).tolist()))):
        at = 1
        for c in chunks:
            want[key, c] = at
            rows.append((key, c, rng.integers(0, 4, 4).tolist()))
            at = rows[-1][2][at]
    got = sr.chunk_starts(spark.createDataFrame(rows, "k string, c long, ends array<int>"), ["k"], "c", 1).collect()
    assert {(r.k, r.c): r.state for r in got} == want and len(got) == len(want)
    assert sr.chunk_starts(spark.createDataFrame([], "k string, c long, ends array<int>"), ["k"], "c", 1).count() == 0


@pytest.mark.parametrize("s", [sr.BARS, SMALL])
def test_hysteresis_brute_force(spark, s):
    pdf = walk(250)
    pdf["score"] = np.random.default_rng(1).normal(0, 0.07, len(pdf))
    pdf.loc[::17, "score"] = np.nan
    d = frame(spark, pdf).select("instrument", "ts", "score")
    got = ru.side_state(d, s=s).toPandas().sort_values(["instrument", "ts"])
    want = []
    for _, g in pdf.sort_values(["instrument", "ts"]).groupby("instrument"):
        side, since = 0, 3
        for x in g["score"]:
            side, since = hysteresis_step(side, since, x, 0.05, 0.02, 0.08, 3)
            want.append(side)
    assert got["side"].tolist() == want


def test_time_thinning_brute_force(spark):
    rng = np.random.default_rng(2)
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.cumsum(rng.exponential(90, 800)), unit="s")
    pdf = pd.DataFrame({"event_id": range(800), "k": rng.choice(["a", "b"], 800, p=[0.9, 0.1]), "ts": ts.floor("us")})
    s = sr.Series(order=("ts", "event_id"), slice_seconds=600, chunk_rows=7)
    got = rk.thin_by_time(frame(spark, pdf), ["k"], 300, s).toPandas()
    want, last = [], {}
    for r in pdf.itertuples():
        if r.k not in last or (r.ts - last[r.k]).total_seconds() >= 300:
            last[r.k] = r.ts
            want.append(r.event_id)
    assert sorted(got["event_id"]) == want


def test_ewm_memory_is_enough():
    for a in (2 / 3, 1 / 14, 2 / 201):
        assert (1 - a) ** sr.ewm_memory(a) < 1e-16
        assert math.isfinite((1 - a) ** (-5.0 * sr.ewm_memory(a)))


@pytest.mark.parametrize("most", [0, 100])
def test_attach_broadcast_and_salted(spark, most):
    rows = spark.range(500).selectExpr("id", "IF(id % 10 < 7, 'hot', concat('k', id % 10)) AS k")
    params = spark.createDataFrame([("hot", 1), ("hot", 2), ("k7", 3)], "k string, p int")
    got = sr.attach(rows, params, ["k"], "left", most=most).select("id", "k", "p")
    assert sorted(got.collect(), key=str) == sorted(rows.join(params, "k", "left").select("id", "k", "p").collect(), key=str)


def test_order_key_orders_like_the_pair(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(id % 3 AS DECIMAL(18,6)) / 1000000) AS ts, id * 4611686018427387 - 9223372036854775807 AS n FROM range(2000)")
    rows = df.withColumn("key", sr.order_key(df, ("ts", "n"))).collect()
    assert [r.n for r in sorted(rows, key=lambda r: r.key)] == [r.n for r in sorted(rows, key=lambda r: (r.ts, r.n))]


def test_load_problems(spark, tmp_path):
    from barlume.sources import files

    lines = ["instrument,Timestamp,open,high,low,close"]
    lines += [f"a,2024-01-01 00:{m:02d}:00,1,2,1,2" for m in (0, 15, 30, 15, 45)] + ["a,,1,2,1,2", "a,2024-01-01 01:00:00,x,2,1,2", "a,2024-01-01 02:00:00,1,2,1,"]
    (tmp_path / "bars.csv").write_text("\n".join(lines))
    bars, bad = files.load_ohlc(spark, str(tmp_path / "bars.csv"))
    found = sorted((str(r.ts)[11:16], r.issue) for r in bad.collect())
    want = {("00:15", "cadence"), ("00:15", "duplicate_timestamp"), ("00:15", "not_increasing"), ("01:00", "non_numeric_price"), ("02:00", "cadence"), ("02:00", "non_numeric_price"), ("", "missing_timestamp")}
    assert set(found) == want and len(found) == len(want)
    assert bars.count() == 8


def crowded(n=600, seed=11):
    """One key with most rows in one instant, in order by text and by a number with nulls, some rows equal in all of those."""
    rng = np.random.default_rng(seed)
    at = np.where(rng.random(n) < 0.7, 0, rng.integers(1, 5000, n))
    pdf = pd.DataFrame({"instrument": np.where(rng.random(n) < 0.8, "a", "b"), "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(at, unit="us"), "name": rng.choice(["x", "y", "z"], n), "event_id": rng.integers(0, 30, n).astype(float), "x": rng.integers(1, 100, n)})
    pdf.loc[pdf.index % 7 == 0, "event_id"] = None
    return pdf


@pytest.mark.parametrize("keys", [("instrument",), ()])
def test_crowded_slices_are_cut_until_they_fit(spark, keys):
    pdf = crowded()
    df = frame(spark, pdf).withColumn("event_id", F.when(~F.isnan("event_id"), F.col("event_id")).cast("bigint"))
    s = sr.Series(keys=keys, order=("ts", "name", "event_id"), chunk_rows=20, slice_seconds=86400)
    sizes = sr.chunked(df, s, 5, 5).groupBy(*keys, "_chunk").agg(F.count("*").alias("all"), F.count_if("_own").alias("own")).toPandas()
    assert sizes["own"].sum() == len(pdf) and sizes["own"].max() <= 2 * s.chunk_rows and sizes["all"].max() <= 4 * s.chunk_rows
    # sums, positions and frames are those of one order of the whole series
    got = sr.windowed(df, s, lambda d, w: d.withColumns({"pos": sr.position(w), "near": F.sum("x").over(w.rowsBetween(-3, 2))}), back=3, ahead=2).toPandas()
    got["event_id"] = got["event_id"].fillna(-1)
    for _, g in got.groupby(list(keys)) if keys else [(None, got)]:
        g = g.sort_values("pos")
        assert g["pos"].tolist() == list(range(len(g)))
        assert g[["ts", "name", "event_id"]].apply(tuple, axis=1).is_monotonic_increasing
        x = g["x"].to_numpy()
        assert g["near"].tolist() == [x[max(0, i - 3) : i + 3].sum() for i in range(len(x))]
    total = sr.running(df, s, sums={"c": F.col("x")}, peaks={"top": "c"}, row_no="n").toPandas()
    for _, g in total.groupby(list(keys)) if keys else [(None, total)]:
        g = g.sort_values("n")
        assert (g["c"].to_numpy() == g["x"].cumsum().to_numpy()).all() and (g["top"] == g["c"]).all()


def test_crowded_slices_give_what_whole_ones_give(spark):
    pdf = crowded().drop_duplicates(["instrument", "ts", "name", "event_id"])
    df = frame(spark, pdf)
    whole, cut = sr.Series(order=("ts", "name", "event_id")), sr.Series(order=("ts", "name", "event_id"), chunk_rows=9, slice_seconds=3600)
    build = lambda d, w: d.withColumn("near", F.sum("x").over(w.rowsBetween(-30, 4)))
    a, b = (sorted(map(tuple, sr.windowed(df, s, build, back=30, ahead=4).fillna(-1.0).collect())) for s in (whole, cut))
    assert a == b


def test_null_order_keys_keep_their_rows(spark):
    from barlume.operators import quality, resample

    ticks = spark.createDataFrame([(1, 10.0), (None, 11.0), (None, 12.0)], "event_id long, price double").withColumns({"instrument": F.lit("a"), "ts": F.lit("2024-01-01 00:00:01").cast("timestamp_ntz"), "volume": F.lit(1)})
    only = ticks.where("event_id IS NULL AND price = 11")
    assert [tuple(r) for r in resample.ticks_to_bars(only, "1 hour").select("open", "high", "low", "close").collect()] == [(11.0,) * 4]
    bar = resample.ticks_to_bars(ticks.where("price < 12"), "1 hour").first()
    assert (bar.open, bar.close) == (11.0, 10.0)  # null comes first
    for keep in ("first", "last"):
        rows = quality.dedupe(only, ["instrument", "ts"], ["ts", "event_id"], keep=keep).collect()
        assert [(r.price, r.volume) for r in rows] == [(11.0, 1)]
    assert quality.dedupe(ticks.where("price > 10").withColumn("ts", F.lit(None).cast("timestamp_ntz")), ["instrument"], ["ts"]).first().price is not None
