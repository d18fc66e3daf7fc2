"""Reversal mode: one snapshot for each symbol and interval, signals across intervals, score, stage, grade and plan.

All four intervals go through one pass; the snapshot has one row for each (symbol, interval), so what follows is small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickframe.config import PENALTIES, WEIGHTS, Config, strictness
from wickframe.functions import scalar as sc
from wickframe.operators import indicators as ind
from wickframe.operators import structure as st
from wickframe.operators.indicators import SERIES
from wickframe.sources.shared import cut

KEY = list(SERIES)


def false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


# ---------------------------------------------------------------- snapshot
def snapshot(bars: DataFrame, cfg: Config) -> DataFrame:
    """State of each series of at least min_bars bars at its last one."""
    d = ind.with_cvd(ind.with_volume(ind.with_vwap(ind.with_choppiness(ind.with_atr(ind.with_rsi(ind.with_changes(bars)))))))
    for p in (20, 50, 200):
        d = ind.ema(d, "close", p, f"ema_{p}")
    # a dozen states are read off these columns
    d = cut(st.with_pivots(d, cfg.structure.pivot))
    swings, events = st.swings(d), st.structure_events(d, cfg.structure.skip_last)
    last = ind.last_of_series(d).where(F.col("bar_idx") >= cfg.structure.min_bars - 1)
    s = last.select(
        *SERIES, F.col("close").alias("price"), F.col("high").alias("last_bar_high"), F.col("low").alias("last_bar_low"), "atr", "rsi", "vwap", "ema_20", "ema_50", "ema_200", "choppiness",
        F.coalesce("rel_volume_5", "rel_volume").alias("noise_volume"), "rel_volume_5", "surge", "cvd_slope", "delta", "change_6", "change_24", sc.lower_wick().alias("lower_wick"), sc.upper_wick().alias("upper_wick"),
        sc.close_pos().alias("close_pos"), sc.sell_ratio().alias("sell_ratio"), false(F.when(F.col("avg_volume") != 0, sc.div(F.col("volume"), F.col("avg_volume")) >= 1.2)).alias("high_volume"))
    s = s.join(st.structure_summary(d, cfg.structure.skip_last), KEY, "left").join(st.last_swing(swings), KEY, "left")
    prices = swings.groupBy(*SERIES).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("price")))).alias(f"{k}s") for k in ("high", "low")])
    equal = st.equal_levels(swings, ind.last_valid(d, "atr"), cfg.structure.equal_tolerance)
    equal = equal.groupBy(*SERIES).agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("price")))).alias(f"equal_{k}s") for k in ("high", "low")])
    s = s.join(prices, KEY, "left").join(equal, KEY, "left")
    for side in ("low", "high"):
        w = st.sweeps(d, side, cfg.structure.sweep_lookback).select(*SERIES, F.struct("recovered", "failed", "valid").alias(f"{side}_sweep"))
        s = s.join(w, KEY, "left")
    at = s.select(*SERIES, "price")
    gaps = _pick(st.gaps(d, cfg.structure).join(at, KEY), F.col("gap_low"), F.col("gap_high"), F.col("status").isin("open", "partial"), F.col("status") != "filled", "gap")
    blocks = _pick(st.order_blocks(d, events, cfg.structure.block_lookback).join(at, KEY), F.col("bottom"), F.col("top"), ~F.col("invalidated"), ~F.col("invalidated"), "block")
    golden = st.golden_cross_retest(d, cfg.retest).select(*SERIES, "detected", "has_rejection")
    return s.join(gaps, KEY, "left").join(blocks, KEY, "left").join(golden, KEY, "left")


def _pick(zones: DataFrame, lo: Column, hi: Column, live: Column, valid: Column, name: str) -> DataFrame:
    """For each side the newest live zone around the price, else the newest valid one; and whether any is valid."""
    z = F.struct(lo.alias("lo"), hi.alias("hi"), "mid")
    inside = live & (F.col("price") >= lo) & (F.col("price") <= hi)
    aggs = []
    for side in ("bullish", "bearish"):
        mine = F.col("side") == side
        newest = lambda cond, mine=mine: F.max_by(z, F.when(mine & cond, F.col("open_time_ms")))
        aggs += [F.coalesce(newest(inside), newest(valid)).alias(f"{side}_{name}"), F.bool_or(mine & valid).alias(f"has_{side}_{name}")]
    return zones.groupBy(*SERIES).agg(*aggs)


INTERVALS = {"4h": "a4", "1h": "a1", "15m": "a15", "5m": "a5"}


def across(snap: DataFrame) -> DataFrame:
    """One row for each symbol that has all four intervals: a struct for each."""
    state = F.struct(*[c for c in snap.columns if c not in SERIES])
    wide = snap.groupBy("symbol").agg(*[F.first(F.when(F.col("tf") == tf, state), ignorenulls=True).alias(a) for tf, a in INTERVALS.items()])
    return wide.dropna(subset=list(INTERVALS.values()))


# ---------------------------------------------------------------- plans
def plan(price: Column, side: str, zones: list[Column], swing: Column, atr: Column, levels: list[Column], cfg: Config) -> Column:
    """entry at the nearest zone behind the price, stop beyond the swing, targets at levels (else at 1.5, 2.5, 3.5
    times the risk), risk_reward to the second target."""
    long = side == "long"
    sign = 1 if long else -1
    usable = [F.when((z <= price) if long else (z >= price), z) for z in zones]
    entry = F.coalesce((F.greatest if long else F.least)(*usable), price)
    buffer = F.greatest(F.coalesce(atr, F.lit(0.0)) * cfg.reversal.stop_atr, price * (cfg.reversal.min_stop_pct / 100))
    raw = F.coalesce(swing, price - F.coalesce(F.when(atr > 0, atr), price * 0.01) * 2 * sign)
    stop = (F.least if long else F.greatest)(raw, entry) - buffer * sign
    tp = [F.coalesce(lv, entry + (entry - stop) * k) for lv, k in zip(levels, (1.5, 2.5, 3.5), strict=True)]
    risk = F.greatest((entry - stop) * sign, F.lit(1e-9))
    rr = F.greatest((tp[1] - entry) * sign, F.lit(0.0)) / risk
    return F.struct(entry.alias("entry"), stop.alias("stop"), *[t.alias(f"tp{k + 1}") for k, t in enumerate(tp)], rr.alias("risk_reward"), ((rr > 0) & ((entry - stop) * sign > 0)).alias("valid"))


def above(levels: Column, price: Column) -> Column:
    return F.array_min(F.filter(levels, lambda x: x > price))


def below(levels: Column, price: Column) -> Column:
    return F.array_max(F.filter(levels, lambda x: x < price))


# ---------------------------------------------------------------- signals
def signals(wide: DataFrame, side: str, cfg: Config) -> DataFrame:
    """Boolean signals of one side, the plan, and what the absorption vote needs.  wide: across(), quote_volume,
    new_listing.  Short mirrors long; the nearest support of a short is the lowest equal low under the price."""
    long = side == "long"
    b = "bullish" if long else "bearish"
    a4, a1, a15, a5 = (lambda x, n=n: F.col(f"{n}.{x}") for n in ("a4", "a1", "a15", "a5"))
    price = a15("price")
    atr = F.coalesce(F.when(a15("atr") > 0, a15("atr")), price * 0.01)
    sign = 1 if long else -1
    sweep = "low_sweep" if long else "high_sweep"
    shift = lambda a: a("bullish_shift") if long else a("last_event").isNotNull() & ~a("bullish_shift")
    turned = lambda a: false(a("choch") & shift(a))
    from_swing = lambda a: st.from_last_low(a("price"), a("last_low")) if long else st.from_last_high(a("price"), a("last_high"))
    rsi15, rsi5, rsi1 = F.coalesce(a15("rsi"), F.lit(50.0)), F.coalesce(a5("rsi"), F.lit(50.0)), a1("rsi")
    gap, block = F.col(f"a15.{b}_gap"), F.col(f"a15.{b}_block")
    swing = F.coalesce(a15("last_low"), a15("last_bar_low")) if long else F.coalesce(a15("last_high"), a15("last_bar_high"))
    target = above(a1("highs"), a1("price")) if long else below(a1("lows"), a1("price"))
    barrier = above(a1("equal_highs"), price) if long else F.get(F.filter(a1("equal_lows"), lambda x: x < price), F.lit(0))
    c = cfg.candidate
    moved = (a1("change_6") <= c.drop_6h) | (from_swing(a1) <= c.near_low) if long else (a1("change_6") >= c.surge_6h) | (from_swing(a1) <= c.near_high)
    levels = [above(a15("highs"), price), above(a1("highs"), price), target] if long else [below(a15("lows"), price), below(a1("lows"), price), target]
    d = wide.withColumn("plan", plan(price, side, [gap["mid"], block["mid"], a1("vwap"), a15("ema_20")], swing, atr, levels, cfg))
    any_label = lambda x: false(a15(x)) | false(a1(x))
    lead, pull = ("has_hh", "has_hl") if long else ("has_ll", "has_lh")
    trend = (a4("price") < a4("ema_50")) & (a4("ema_50") < a4("ema_200")) & (F.coalesce(a4("rsi"), F.lit(50.0)) < 42) if long else (a4("price") > a4("ema_50")) & (a4("ema_50") > a4("ema_200")) & (F.coalesce(a4("rsi"), F.lit(50.0)) > 58)
    trigger = false(a5("has_hl")) if long else false(a5("last_label") == "LH")
    within = lambda z: false((price >= z["lo"]) & (price <= z["hi"]))
    rr = F.col("plan.risk_reward")
    values = {
        "dropAndOversold": false(moved & ((rsi1 <= 50) if long else (rsi1 >= 50))), "goodLiquidity": F.col("quote_volume") >= cfg.universe.min_quote_volume * 1.5,
        "lowSweep": a15(sweep).isNotNull() | a1(sweep).isNotNull(), "lowSweepValid": false(a15(f"{sweep}.valid")), "sweepRecovered": false(a15(f"{sweep}.recovered")) | false(a1(f"{sweep}.recovered")),
        "structureShift1h": false(a1("last_event").isNotNull() & shift(a1)), "choch1h": turned(a1), "choch15m": turned(a15), "choch5m": turned(a5),
        "fvgObOverlap": false(sc.overlap(gap["lo"], gap["hi"], block["lo"], block["hi"])), "fvgReentry": within(gap), "obReentry": within(block), "fvgCreated": false(a15(f"has_{b}_gap")), "obCreated": false(a15(f"has_{b}_block")),
        "volumeDeltaShift": (a15("cvd_slope") * sign > 0) & false(a15("rel_volume_5") >= 1.0), "cvdImproved": a15("cvd_slope") * sign > 0, "deltaImproved": a15("delta") * sign > 0,
        "low5mDefended": false(a5(f"{sweep}.recovered")), "entryTrigger5m": turned(a5) | (trigger & false(a5("rel_volume_5") >= 1.1)), "volumeReSurge": false(a5("rel_volume_5") >= 1.2) | a15("surge"), "volumeReacted": false(a15("rel_volume_5") >= 1.0),
        "firstHH": any_label(lead), "firstHL": any_label(pull), "firstPushDone": false(a15("last_label") == ("HH" if long else "LL")) & (from_swing(a15) > 8),
        "overExtended15m": (from_swing(a15) > 12) & ((rsi15 > 70) if long else (rsi15 < 30)), "farFromLowAtr": false((price - swing) * sign / atr > 8), "shortTargetDistance": false((target - price) * sign / atr < 1.5),
        "strongResistanceAbove": false((barrier - price) * sign / atr < 1), "tooLowVolume": false(a15("rel_volume_5") < 0.5), "strongDowntrend4h": false(trend), "newListingThin": F.col("new_listing"),
        "rsiOverheated": ((rsi15 > 78) | (rsi5 > 82)) if long else ((rsi15 < 22) | (rsi5 < 18)), "riskRewardOk": rr >= 2, "poorRiskReward": rr < 1.5}
    d = d.withColumn("direction", F.lit(side)).withColumns(values)
    flat = (a1("change_6") >= -1) & (a15("cvd_slope") < 0) if long else (a1("change_6") <= 1) & (a15("cvd_slope") > 0)
    wick, pos, sellers = (a15("lower_wick"), a15("close_pos") >= 0.5, a15("sell_ratio") > 0.5) if long else (a15("upper_wick"), a15("close_pos") <= 0.5, 1 - a15("sell_ratio") > 0.5)
    votes = [sellers, a15("high_volume"), pos, wick >= 0.3, F.col("sweepRecovered"), flat]
    return d.withColumn("absorption_points", sum((false(v).cast("int") for v in votes), F.lit(0))).withColumn("absorption", absorption(F.col("absorption_points")))


def absorption(points: Column) -> Column:
    return F.when(points >= 5, "strong").when(points >= 3, "normal").otherwise("insufficient")


def stage() -> Column:
    """5 late, 4 entry zone, 3 structure shift, 2 liquidity taken, 1 watch: the first that holds."""
    c = F.col
    return (
        F.when(c("overExtended15m") | c("farFromLowAtr") | c("shortTargetDistance") | c("rsiOverheated"), 5)
        .when((c("fvgReentry") | c("obReentry")) & (c("choch5m") | c("low5mDefended")) & c("volumeReSurge"), 4)
        .when((c("choch1h") | c("choch15m")) & (c("firstHH") | c("firstHL")) & (c("fvgCreated") | c("obCreated")) & ~c("firstPushDone"), 3)
        .when(c("lowSweep") & c("sweepRecovered") & c("volumeReacted") & (c("cvdImproved") | c("deltaImproved")), 2)
        .otherwise(1))


#: Which signal earns which weight.
ITEMS = {
    "dropAndOversold": "dropAndOversold", "volumeLiquidity": "goodLiquidity", "lowLiquiditySweep": "lowSweepValid", "sweepPriceRecovery": "sweepRecovered", "sellAbsorption": "absorbed",
    "structureShift1h": "structureShift1h", "fvgObOverlap": "fvgObOverlap", "volumeDeltaShift": "volumeDeltaShift", "entryTrigger5m": "entryTrigger5m", "riskReward": "riskRewardOk"}


def with_score(d: DataFrame, cfg: Config) -> DataFrame:
    """breakdown, penalties (of the group only the worst, the first of equals), score, grade, core_pct, top_signals."""
    _, values = strictness(cfg.reversal.strictness)
    d = d.withColumn("absorbed", F.col("absorption") != "insufficient")
    item = lambda k, s: F.struct(F.lit(k).alias("key"), F.lit(WEIGHTS[k]).alias("weight"), F.when(F.col(s), WEIGHTS[k]).otherwise(0).alias("got"))
    d = d.withColumn("breakdown", F.array(*[item(k, s) for k, s in ITEMS.items()]))
    hit = lambda k: F.when(F.col(k), F.struct(F.lit(k).alias("key"), F.lit(values[k]).alias("val")))
    d = d.withColumn("_all", F.filter(F.array(*[hit(k) for k in PENALTIES]), lambda p: p.isNotNull()))
    grouped = lambda p: p["key"].isin(*cfg.reversal.penalty_group)
    d = d.withColumn("_worst", F.array_min(F.transform(F.filter("_all", grouped), lambda p: p["val"])))
    d = d.withColumn("_kept", F.get(F.filter("_all", lambda p: grouped(p) & (p["val"] == F.col("_worst"))), F.lit(0))["key"])
    d = d.withColumn("penalties", F.filter("_all", lambda p: ~grouped(p) | (p["key"] == F.col("_kept"))))
    total = lambda c, f, start: F.aggregate(c, F.lit(start), lambda a, x: a + x[f])
    d = d.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total("breakdown", "got", 0) + total("penalties", "val", 0))))
    core = F.filter("breakdown", lambda x: x["key"].isin(*cfg.reversal.core))
    most = sum(WEIGHTS[k] for k in cfg.reversal.core)
    d = d.withColumn("core_pct", total(core, "got", 0) * 100.0 / most).withColumn("grade", sc.grade(F.col("score"), cfg.reversal.grades))
    best = F.array_sort(F.transform(F.filter("breakdown", lambda x: x["got"] > 0), lambda x: F.struct((-x["weight"]).alias("w"), x["key"].alias("key"))))
    return d.withColumn("top_signals", F.slice(F.transform(best, lambda x: x["key"]), 1, 3)).withColumn("stage", stage()).drop("_all", "_worst", "_kept")


def results(bars: DataFrame, symbols: DataFrame, cfg: Config, direction: str = "both") -> DataFrame:
    """The better side of each symbol (long wins ties) that has enough of the core signals, with badges.
    symbols: symbol, quote_volume, new_listing, and change_24h if known."""
    wide = across(snapshot(bars, cfg)).join(symbols, "symbol")
    wide = cut(wide)
    sides = [with_score(signals(wide, s, cfg), cfg) for s in (("long", "short") if direction == "both" else (direction,))]
    d = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    best = Window.partitionBy("symbol").orderBy(F.desc("score"), "direction")
    d = d.withColumn("_r", F.row_number().over(best)).where("_r = 1").where(F.col("core_pct") >= cfg.reversal.core_min)
    near = false(F.abs(F.col("a1.price") - F.col("a1.ema_200")) <= F.col("a1.atr") * cfg.reversal.near_ema200)
    noisy = false(F.col("a15.choppiness") > cfg.noise.choppiness_max) | false(F.col("a15.noise_volume") < cfg.noise.min_rel_vol)
    return d.select(
        "symbol", F.col("a15.price").alias("price"), F.col("a1.change_6").alias("change_6h"), F.col("a1.change_24").alias("change_24h"), "quote_volume", "new_listing", "direction", "score", "grade", "stage", "absorption", "breakdown", "penalties", "top_signals",
        "core_pct", false(F.col("a4.detected")).alias("golden_cross"), near.alias("near_ema200"), noisy.alias("noisy"), "plan", F.col("a1.rsi").alias("rsi_1h"),
        F.create_map(*[x for tf, a in INTERVALS.items() for x in (F.lit(tf), summary(a, "direction"))]).alias("timeframes"))


def summary(a: str, direction: str) -> Column:
    """Rounded state of one interval."""
    c = lambda x: F.col(f"{a}.{x}")
    side = lambda what: F.when(F.col(direction) == "short", false(c(f"has_bearish_{what}"))).otherwise(false(c(f"has_bullish_{what}")))
    trend = F.when(c("cvd_slope") > 0, "up").when(c("cvd_slope") < 0, "down").otherwise("flat")
    return F.struct(c("price").alias("price"), *[sc.r(c(x)).alias(x) for x in ("rsi", "ema_20", "ema_50", "vwap")], c("last_event").alias("last_structure"), c("last_label").alias("last_label"), sc.r(c("noise_volume"), 2).alias("rel_volume"), trend.alias("cvd"), side("gap").alias("gap"), side("block").alias("block"))
