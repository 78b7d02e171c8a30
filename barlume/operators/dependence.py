"""Dependence between strategy sleeves and portfolio control."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barlume.operators.evaluate import drawdown_series
from barlume.operators.series import Series, average_rank, materialise, quantiles, windowed

Pairs = Sequence[tuple[str, str]]


def all_pairs(names: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]


def pair_rows(wide: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Long rows (a, b, xa, xb) for the configured sleeve pairs, both present."""
    items = [
        F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("xa"), F.col(b).cast("double").alias("xb")))
        for a, b in all_pairs(names)
    ]
    return wide.select(*keep, F.explode(F.array_compact(F.array(*items))).alias("_p")).select(*keep, "_p.*")


def safe_corr(x: str, y: str) -> Column:
    """Correlation, NULL for fewer than two rows or a constant side."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    sx, sy = F.stddev_pop(F.when(both, F.col(x))), F.stddev_pop(F.when(both, F.col(y)))
    return F.when((F.count(F.when(both, 1)) >= 2) & (sx > 0) & (sy > 0), F.corr(x, y))


def rank_corr(pairs: DataFrame) -> DataFrame:
    """Spearman per pair from tie-averaged ranks."""
    d = average_rank(average_rank(pairs, ["a", "b"], "xa", "_ra"), ["a", "b"], "xb", "_rb")
    return d.groupBy("a", "b").agg(safe_corr("_ra", "_rb").alias("spearman"))


def signal_dependence(wide: DataFrame, names: Sequence[str], q: float = 0.8) -> DataFrame:
    """Pearson, Spearman and high-confidence Pearson per pair."""
    p = materialise(pair_rows(wide, names))
    cut = quantiles(p, ["a", "b"], "xa", {"_qa": q}).join(quantiles(p, ["a", "b"], "xb", {"_qb": q}), ["a", "b"])
    h = p.join(cut, ["a", "b"])
    high = (F.col("xa") >= F.col("_qa")) | (F.col("xb") >= F.col("_qb"))
    h = h.withColumns({"_ha": F.when(high, F.col("xa")), "_hb": F.when(high, F.col("xb"))})
    g = h.groupBy("a", "b").agg(safe_corr("xa", "xb").alias("pearson"), safe_corr("_ha", "_hb").alias("high_conf_corr"), F.count(F.lit(1)).alias("n"), F.count("_ha").alias("n_high_conf"))
    return g.join(rank_corr(p), ["a", "b"])


def trigger_overlap(wide: DataFrame, names: Sequence[str], high: Sequence[str] | None = None) -> DataFrame:
    """Jaccard overlap of non-zero signals per pair, in one aggregation."""
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) != 0
    aggs, items = [], []
    for i, (a, b) in enumerate(all_pairs(names)):
        aggs += [F.count(F.when(on(a) & on(b), 1)).alias(f"i{i}"), F.count(F.when(on(a) | on(b), 1)).alias(f"u{i}")]
        fields = [F.lit(a).alias("a"), F.lit(b).alias("b"), F.when(F.col(f"u{i}") > 0, F.col(f"i{i}") / F.col(f"u{i}")).alias("jaccard"), F.col(f"i{i}").alias("overlap_count"), F.col(f"u{i}").alias("union_count")]
        if high:
            ha, hb = high[names.index(a)], high[names.index(b)]
            aggs += [F.count(F.when(on(ha) & on(hb), 1)).alias(f"hi{i}"), F.count(F.when(on(ha) | on(hb), 1)).alias(f"hu{i}")]
            fields += [F.when(F.col(f"hu{i}") > 0, F.col(f"hi{i}") / F.col(f"hu{i}")).alias("high_conf_jaccard"), F.col(f"hi{i}").alias("high_conf_overlap_count")]
        items.append(F.struct(*fields))
    return wide.agg(*aggs).select(F.explode(F.array(*items)).alias("_p")).select("_p.*")


def residual_dependence(wide: DataFrame, names: Sequence[str], outcome: str, digits: int = 9) -> DataFrame:
    """Pearson and Spearman of outcome minus prediction, which tie when equal to ``digits`` decimals."""
    p = materialise(pair_rows(wide.withColumns({c: F.round(F.col(outcome) - F.col(c), digits) for c in names}), names))
    return p.groupBy("a", "b").agg(safe_corr("xa", "xb").alias("pearson")).join(rank_corr(p), ["a", "b"])


def pnl_dependence(wide: DataFrame, names: Sequence[str], s: Series, windows=(20, 60)) -> DataFrame:
    """Correlation of PnL per row, per day and of rolling sums."""

    def build(d: DataFrame, w: WindowSpec) -> DataFrame:
        return d.withColumns({f"_{n}_{c}": F.when(F.count(c).over(w.rowsBetween(-(n - 1), 0)) >= n, F.sum(c).over(w.rowsBetween(-(n - 1), 0))) for n in windows for c in names})

    rolled = windowed(wide, s, build, back=max(windows) - 1)
    aggs, items = [], []
    for i, (a, b) in enumerate(all_pairs(names)):
        aggs.append(safe_corr(a, b).alias(f"t{i}"))
        aggs += [safe_corr(f"_{n}_{a}", f"_{n}_{b}").alias(f"r{n}_{i}") for n in windows]
        items.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"t{i}").alias("trade_pearson"), *[F.col(f"r{n}_{i}").alias(f"rolling_{n}") for n in windows]))
    base = rolled.agg(*aggs).select(F.explode(F.array(*items)).alias("_p")).select("_p.*")
    daily = wide.groupBy(F.col(s.ts).cast("date").alias("_d")).agg(*[F.sum(c).alias(c) for c in names])
    dp = materialise(pair_rows(daily, names))
    day = dp.groupBy("a", "b").agg(safe_corr("xa", "xb").alias("daily_pearson"))
    trade_rank = rank_corr(materialise(pair_rows(wide, names))).withColumnRenamed("spearman", "trade_spearman")
    day_rank = rank_corr(dp).withColumnRenamed("spearman", "daily_spearman")
    return base.join(trade_rank, ["a", "b"]).join(day, ["a", "b"]).join(day_rank, ["a", "b"])


def tail_dependence(long: DataFrame, names: Sequence, s: Series, sleeve: str = "sleeve", tail: float = 0.1) -> DataFrame:
    """Joint worst-decile frequency and drawdown overlap with start and end
    coincidence.  long: time, sleeve, pnl (zero-filled)."""
    ts = s.ts
    k = s.with_(keys=(sleeve,))
    cut = quantiles(long, [sleeve], "pnl", {"_q": tail})
    d = drawdown_series(long, k).join(cut, sleeve)
    d = d.withColumns({"_tail": F.col("pnl") <= F.col("_q"), "_wet": F.col("drawdown") < 0}).select(ts, sleeve, "_tail", "_wet")
    d = materialise(d)

    def build(x: DataFrame, w: WindowSpec) -> DataFrame:
        before, after = F.coalesce(F.lag("_wet").over(w), F.lit(False)), F.coalesce(F.lead("_wet").over(w), F.lit(False))
        return x.withColumns({"_start": F.col("_wet") & ~before, "_end": F.col("_wet") & ~after})

    d = windowed(d, k, build, back=1, ahead=1)
    flags = ("_tail", "_wet", "_start", "_end")
    wide = d.groupBy(ts).agg(*[F.max(F.when(F.col(sleeve) == n, F.col(f))).alias(f"{f}{i}") for i, n in enumerate(names) for f in flags])
    aggs, items = [], []
    pairs = [(i, j) for i in range(len(names)) for j in range(i + 1, len(names))]
    on = lambda c: F.coalesce(F.col(c), F.lit(False))
    for p, (i, j) in enumerate(pairs):
        out = [F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b")]
        for f, name in zip(flags, ("worst_decile_freq", "drawdown_overlap", "start_coincidence", "end_coincidence")):
            aggs += [F.count(F.when(on(f"{f}{i}") & on(f"{f}{j}"), 1)).alias(f"i{f}{p}"), F.count(F.when(on(f"{f}{i}") | on(f"{f}{j}"), 1)).alias(f"u{f}{p}")]
            u = F.col(f"u{f}{p}")
            safe = u if f in ("_tail", "_wet") else F.greatest(u, F.lit(1))
            out.append(F.when(safe > 0, F.col(f"i{f}{p}") / safe).alias(name))
        items.append(F.struct(*out))
    return wide.agg(*aggs).select(F.explode(F.array(*items)).alias("_p")).select("_p.*")


def additivity(rows: DataFrame, s: Series, cost: float = 0.0, aversion: float = 0.5) -> DataFrame:
    """Marginal value of a candidate sleeve over a base portfolio.

    rows: time, base_pnl, base_signal, cand_pnl, cand_signal and optionally
    pnl_frozen.
    """
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    on = F.coalesce(F.col("cand_signal"), F.lit(0)) != 0
    fee = cost * on.cast("double")
    frozen = F.col("pnl_frozen") if "pnl_frozen" in rows.columns else F.col("cand_pnl")
    d = rows.select(
        *s.order, z("base_pnl").alias("_b"), (z("base_pnl") + z("cand_pnl") - fee).alias("_c"), (z("base_pnl") + F.coalesce(frozen, F.lit(0.0)) - fee).alias("_f"),
        on.alias("_on"), (F.coalesce(F.col("base_signal"), F.lit(0)) != 0).alias("_bon"),
    )
    d = materialise(d)
    u = lambda x: F.avg(x) - aversion * F.stddev_pop(x)
    g = d.agg(
        (F.avg("_c") - F.avg("_b")).alias("marginal_expectancy"), (u("_c") - u("_b")).alias("marginal_utility"), (u("_f") - u("_b")).alias("_frozen"),
        (F.count(F.when(F.col("_on") & ~F.col("_bon"), 1)) / F.greatest(F.lit(1), F.count(F.when(F.col("_on"), 1)))).alias("unique_trade_share"),
    )
    low = lambda c: drawdown_series(d.select(*s.order, F.col(c).alias("pnl")), s).agg(F.min("drawdown").alias(f"_dd{c}"))
    g = g.crossJoin(low("_b")).crossJoin(low("_c"))
    return g.select(
        "marginal_expectancy", (F.col("_dd_c") - F.col("_dd_b")).alias("marginal_drawdown"), "unique_trade_share", "marginal_utility",
        (F.col("marginal_utility") > 0).alias("improves_utility"), (F.col("_frozen") > 0).alias("survives_frozen"),
    )


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair once from either side."""
    return pairs.unionByName(pairs.withColumns({"a": F.col("b"), "b": F.col("a")}))


def redundancy_flags(pairs: DataFrame, added: DataFrame, limits: dict) -> DataFrame:
    """Reasons why a sleeve is redundant.  pairs: a, b, pearson, jaccard,
    trade_pearson, worst_decile_freq; added: sleeve, marginal_utility,
    unique_trade_share."""
    p = both_ways(pairs)
    tests = (
        (F.abs("pearson") >= limits["score_corr"], "high_score_corr_vs_"), (F.col("jaccard") >= limits["overlap"], "high_trigger_overlap_vs_"),
        (F.abs("trade_pearson") >= limits["pnl_corr"], "high_pnl_corr_vs_"), (F.col("worst_decile_freq") >= limits["coloss"], "high_coloss_vs_"),
    )
    r = p.select(F.col("a").alias("sleeve"), F.array_compact(F.array(*[F.when(t, F.concat(F.lit(n), F.col("b").cast("string"))) for t, n in tests])).alias("_r"))
    extra = F.array_compact(F.array(
        F.when(F.coalesce("marginal_utility", F.lit(0.0)) <= limits["utility"], F.lit("non_positive_marginal_utility")),
        F.when(F.coalesce("unique_trade_share", F.lit(1.0)) <= limits["unique"], F.lit("low_unique_trade_share")),
    ))
    r = r.unionByName(r.select("sleeve").distinct().join(added, "sleeve", "left").select("sleeve", extra.alias("_r")))
    g = r.groupBy("sleeve").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_r")))).alias("_r"))  # few reasons per sleeve
    return g.select("sleeve", (F.size("_r") > 0).alias("is_redundant"), F.array_join("_r", ";").alias("reasons"))


def pair_penalty(pairs: DataFrame, weights=(1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    z = lambda c: F.coalesce(c, F.lit(0.0))
    w = weights
    pen = w[0] * z(F.abs("score_corr")) + w[1] * z(F.col("trigger_overlap")) + w[2] * z(F.abs("pnl_corr")) + w[3] * z(F.col("coloss_freq"))
    return pairs.withColumn("pair_penalty", pen)


def sleeve_penalty(pairs: DataFrame, weights=(1.0, 1.0, 1.0, 1.0)) -> DataFrame:
    """Dependence penalty per sleeve: the sum over its pairs."""
    return both_ways(pair_penalty(pairs, weights).select("a", "b", "pair_penalty")).groupBy(F.col("a").alias("sleeve")).agg(F.sum("pair_penalty").alias("penalty"))


def expected_utility(p: Column, payoff: Column, cost: Column) -> Column:
    return p * payoff - cost


def suppress_redundant(candidates: DataFrame, pairs: DataFrame, limit: float = 1.5, at: str = "ts") -> DataFrame:
    """Per time, of two active sleeves whose pair penalty reaches the limit the
    weaker one is switched off, pair by pair in order.

    A time holds a handful of sleeves, so they fold in one array expression.
    Strength: utility, then calibration, then lower penalty, then name.
    candidates: at, sleeve, signal, expected_utility, recent_brier.
    """
    one = pairs.agg(F.sort_array(F.collect_list(F.struct("a", "b", "pair_penalty"))).alias("_pairs"))  # sleeve pairs of the configuration
    g = candidates.groupBy(at).agg(F.collect_list(F.struct("sleeve", "signal", "expected_utility", "recent_brier")).alias("_rows"))
    g = g.crossJoin(F.broadcast(one))
    g = g.withColumn("_on", F.array_sort(F.transform(F.filter("_rows", lambda r: r["signal"] != 0), lambda r: r["sleeve"])))
    has = lambda x: F.array_contains(F.col("_on"), x)
    g = g.withColumn("_live", F.filter("_pairs", lambda p: has(p["a"]) & has(p["b"])))
    penalty = lambda n: F.aggregate(F.filter("_live", lambda p: (p["a"] == n) | (p["b"] == n)), F.lit(0.0), lambda acc, p: acc + p["pair_penalty"])
    order = F.sort_array(F.transform("_rows", lambda r: F.struct(
        r["expected_utility"].alias("u"), (-F.coalesce(r["recent_brier"], F.lit(1e300))).alias("c"), (-penalty(r["sleeve"])).alias("p"), r["sleeve"].alias("n"))), asc=False)
    g = g.withColumn("_order", F.transform(order, lambda r: r["n"]))
    rank = lambda n: F.array_position(F.col("_order"), n)
    step = lambda acc, p: F.when(
        F.array_contains(acc, p["a"]) & F.array_contains(acc, p["b"]), F.array_remove(acc, F.when(rank(p["a"]) < rank(p["b"]), p["b"]).otherwise(p["a"]))
    ).otherwise(acc)
    kept = F.aggregate(F.filter("_live", lambda p: p["pair_penalty"] >= limit), F.col("_on"), step)
    g = g.withColumn("_kept", kept).withColumn("_pen", F.transform("_rows", lambda r: penalty(r["sleeve"])))
    g = g.select(at, "_on", "_kept", F.explode(F.arrays_zip("_rows", "_pen")).alias("_z"))
    name = F.col("_z._rows.sleeve")
    off = F.array_contains("_on", name) & ~F.array_contains("_kept", name)
    return g.select(
        at, name.alias("sleeve"), F.when(off, 0).otherwise(F.col("_z._rows.signal")).alias("signal"), F.col("_z._rows.expected_utility").alias("expected_utility"),
        F.when(F.array_contains("_on", name), F.col("_z._pen")).otherwise(0.0).alias("dependence_penalty"), off.alias("suppressed"),
    )


def drawdown_multiplier(dd: float, soft: float = 0.08, hard: float = 0.15) -> float:
    if dd >= hard:
        return 0.0
    return 1.0 if dd <= soft else max(0.0, 1 - (dd - soft) / max(1e-9, hard - soft))


def allocate_risk(rows: DataFrame, at: str = "ts", most: int = 3, total: float = 1.0, per_sleeve: float = 0.3, per_cluster: float = 0.5, dd: float = 0.0) -> DataFrame:
    """Risk share per active sleeve: top ``most`` by utility, proportional to
    positive utility, capped per sleeve and then per cluster.  Windows are per
    time, a handful of sleeves each."""
    mult = drawdown_multiplier(dd)
    on = (F.col("signal") != 0) & ~F.col("suppressed")
    order = Window.partitionBy(at, "_on").orderBy(F.col("expected_utility").desc(), "sleeve")
    d = rows.withColumn("_on", on)
    d = d.withColumn("_in", F.col("_on") & (F.row_number().over(order) <= most))
    u = F.when(F.col("_in"), F.greatest(F.col("expected_utility"), F.lit(0.0))).otherwise(0.0)
    d = d.withColumn("_u", u)
    w = Window.partitionBy(at)
    sum_u, n = F.sum("_u").over(w), F.count(F.when(F.col("_in"), 1)).over(w)
    share = F.when(sum_u > 0, F.col("_u") / sum_u).otherwise(1 / F.nullif(n, F.lit(0)))
    d = d.withColumn("_r", F.when(F.col("_in"), F.least(share * total * mult, F.lit(per_sleeve))).otherwise(0.0))
    c = F.sum("_r").over(Window.partitionBy(at, "cluster"))
    return d.withColumn("risk_alloc", F.when(c > per_cluster, F.col("_r") * per_cluster / c).otherwise(F.col("_r"))).drop("_on", "_in", "_u", "_r")


def redundancy_alerts(pairs: DataFrame, limit: float = 0.85) -> DataFrame:
    """Sleeve pairs whose score correlation is at the limit or over it."""
    return pairs.where(F.col("score_corr") >= limit)


def final_action(alloc: DataFrame, at: str = "ts", digits: int = 9) -> DataFrame:
    """LONG, SHORT or NO_TRADE by the sign of the signed allocation, to ``digits`` decimals."""
    live = (F.col("signal") != 0) & (F.col("risk_alloc") > 0)
    g = alloc.groupBy(at).agg(
        F.round(F.coalesce(F.sum(F.when(live, F.col("risk_alloc") * F.col("signal"))), F.lit(0.0)), digits).alias("_net"), F.coalesce(F.sum(F.when(live, F.col("risk_alloc"))), F.lit(0.0)).alias("_size"),
        F.count(F.when(live, 1)).alias("selected"),
    )
    act = F.when(F.col("_net") > 0, "LONG").when(F.col("_net") < 0, "SHORT").otherwise("NO_TRADE")
    return g.select(at, act.alias("action"), F.when(F.col("_net") != 0, F.col("_size")).otherwise(0.0).alias("size"), "selected")


def abstain_reason(rows: DataFrame, at: Sequence[str], meta_min: float = 0.55) -> DataFrame:
    """Why a time has no trade, strongest reason first.  rows: at, action, tradable,
    raw_signal, signal, meta_prob, long_enabled, short_enabled."""
    cand = (F.col("raw_signal") != 0) & (F.col("signal") == 0)
    meta = cand & (F.col("meta_prob") < meta_min)
    side = ((F.col("raw_signal") > 0) & ~F.col("long_enabled")) | ((F.col("raw_signal") < 0) & ~F.col("short_enabled"))
    g = rows.groupBy(*at).agg(
        F.max("action").alias("action"), F.max("tradable").alias("_t"), F.max(meta).alias("_m"), F.max(side).alias("_s"), F.max(cand & ~meta & ~side).alias("_c")
    )
    why = F.when(~F.col("_t"), "tradability_block").when(F.col("_m"), "meta_edge_block").when(F.col("_s"), "side_disabled").when(F.col("_c"), "cost_threshold_block").otherwise("no_candidate")
    return g.select(*at, F.when(F.col("action") == "NO_TRADE", why).otherwise("").alias("abstain_reason"))
