"""Price structure: pivots, breaks, levels, sweeps, gaps, blocks, retests.

Nothing joins all bars of a series with each other.  Rows that describe a series' state have one row for each
(symbol, tf).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickframe.config import Retest, Structure
from wickframe.functions.scalar import close_pos, div, pct, upper_wick
from wickframe.operators.indicators import SERIES, o, w

SERIES_LIST = list(SERIES)


def whole() -> Window:
    return Window.partitionBy(*SERIES)


def with_pivots(df: DataFrame, length: int = 5) -> DataFrame:
    """pivot_high, pivot_low: strictly beyond all bars within `length` on both sides, which must be there."""
    n = F.count(F.lit(1)).over(whole())
    there = (F.col("bar_idx") >= length) & (F.col("bar_idx") < n - length)
    high = (F.col("high") > F.max("high").over(w(-length, -1))) & (F.col("high") > F.max("high").over(w(1, length)))
    low = (F.col("low") < F.min("low").over(w(-length, -1))) & (F.col("low") < F.min("low").over(w(1, length)))
    return df.withColumn("pivot_high", F.coalesce(there & high, F.lit(False))).withColumn("pivot_low", F.coalesce(there & low, F.lit(False)))


def swings(df: DataFrame) -> DataFrame:
    """A row for each pivot, labelled against the one of its kind before: HH or LH, HL or LL (null for the first).
    Needs pivots."""
    kind = lambda name, price, rank: F.struct(F.lit(name).alias("kind"), F.col(price).alias("price"), F.lit(rank).alias("rank"))
    both = F.filter(F.array(F.when(F.col("pivot_high"), kind("high", "high", 0)), F.when(F.col("pivot_low"), kind("low", "low", 1))), lambda p: p.isNotNull())
    rows = df.where("pivot_high or pivot_low").select(*SERIES, "bar_idx", "open_time_ms", F.explode(both).alias("p")).select(*SERIES, "bar_idx", "open_time_ms", "p.*")
    before = F.lag("price").over(Window.partitionBy(*SERIES, "kind").orderBy("bar_idx"))
    label = F.when(F.col("kind") == "high", F.when(F.col("price") > before, "HH").otherwise("LH")).otherwise(F.when(F.col("price") > before, "HL").otherwise("LL"))
    return rows.withColumn("label", F.when(before.isNotNull(), label))


def structure_events(df: DataFrame, skip_last: bool = True) -> DataFrame:
    """Breaks of structure by close: each pivot's level can be broken once, from the bar after it until a pivot of its
    kind replaces it.  A break against the direction of the one before is a change of character.  None in series of
    fewer than three pivots; the last bar doesn't count unless skip_last is off.  Needs pivots."""
    n = F.count(F.lit(1)).over(whole())
    pivots = F.sum(F.col("pivot_high").cast("int") + F.col("pivot_low").cast("int")).over(whole())
    df = df.withColumn("_ok", (pivots >= 3) & (F.col("bar_idx") < n - (1 if skip_last else 0)))
    before = o().rowsBetween(Window.unboundedPreceding, -1)
    arms = []
    for side, price, rank in (("bullish", "high", 0), ("bearish", "low", 1)):
        level = F.last(F.when(F.col(f"pivot_{price}"), F.struct("bar_idx", F.col(price).alias("price"))), ignorenulls=True).over(before)
        d = df.withColumn("_l", level)
        crossed = F.col("_ok") & (F.col("close") > F.col("_l.price") if side == "bullish" else F.col("close") < F.col("_l.price"))
        first = F.min("bar_idx").over(Window.partitionBy(*SERIES, F.col("_l.bar_idx")))
        arms.append(d.where(crossed).withColumn("_first", first).where("bar_idx = _first").select(*SERIES, "bar_idx", "open_time_ms", F.lit(side).alias("side"), F.lit(rank).alias("rank"), F.col("_l.price").alias("price")))
    events = arms[0].unionByName(arms[1])
    last = F.lag("side").over(o().orderBy("bar_idx", "rank"))
    return events.withColumn("type", F.concat("side", F.when(last != F.col("side"), "_choch").otherwise("_bos")))


def structure_summary(df: DataFrame, skip_last: bool = True) -> DataFrame:
    """State of each series: last event, whether it was a change of character, which labels occur, the last label."""
    s, e = swings(df), structure_events(df, skip_last)
    at = F.struct("bar_idx", "rank")
    seen = [F.bool_or(F.coalesce(F.col("label") == x, F.lit(False))).alias(f"has_{x.lower()}") for x in ("HH", "HL", "LH", "LL")]
    labels = s.groupBy(*SERIES).agg(*seen, F.max_by(F.struct("label"), at)["label"].alias("last_label"))
    last = e.groupBy(*SERIES).agg(F.max_by("type", at).alias("last_event"))
    out = df.select(*SERIES).distinct().join(labels, SERIES_LIST, "left").join(last, SERIES_LIST, "left")
    out = out.fillna(False, ["has_hh", "has_hl", "has_lh", "has_ll"])
    return out.withColumn("choch", F.coalesce(F.col("last_event").endswith("choch"), F.lit(False))).withColumn("bullish_shift", F.coalesce(F.col("last_event").startswith("bullish"), F.lit(False)))


def equal_levels(pivots: DataFrame, atr: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """Clusters of two or more pivots of a kind, each within tolerance * atr of its neighbour by price: mean price,
    count and members.  atr: one row for each series."""
    by_price = Window.partitionBy(*SERIES, "kind").orderBy("price", "bar_idx")
    tied = pivots.join(atr.select(*SERIES, "atr"), SERIES_LIST, "left")
    gap = F.col("price") - F.lag("price").over(by_price)
    tied = tied.withColumn("_new", F.when(gap <= F.coalesce("atr", F.lit(0.0)) * tolerance, 0).otherwise(1))
    tied = tied.withColumn("cluster", F.sum("_new").over(by_price.rowsBetween(Window.unboundedPreceding, 0)))
    members = F.array_sort(F.collect_list(F.struct("price", "bar_idx")))
    return tied.groupBy(*SERIES, "kind", "cluster").agg(F.avg("price").alias("price"), F.count(F.lit(1)).alias("count"), members.alias("members")).where("count >= 2")


def sweeps(df: DataFrame, side: str = "low", lookback: int = 6) -> DataFrame:
    """The latest pivot's level taken by a wick within the last bars: at most one row for each series.  Needs pivots
    and avg_volume (of the last bar; no confirmation is asked for without it)."""
    low = side == "low"
    px, sign = ("low", 1) if low else ("high", -1)
    n = F.count(F.lit(1)).over(whole())
    prior = F.max_by(F.struct("bar_idx", F.col(px).alias("price")), F.when(F.col(f"pivot_{side}"), F.col("bar_idx"))).over(whole())
    d = df.withColumn("_n", n).withColumn("_p", prior).withColumn("_end", F.max_by(F.struct("close", "avg_volume"), "bar_idx").over(whole())).where("_n >= 3 and _p is not null")
    level = F.col("_p.price")
    taken = (F.col(px) * sign < level * sign) & (F.col("close") * sign > level * sign) & (F.col("bar_idx") > F.col("_p.bar_idx")) & (F.col("bar_idx") >= F.col("_n") - lookback)
    d = d.withColumn("_s", F.min(F.when(taken, F.struct("bar_idx", F.col(px).alias("price"), "open_time_ms", "volume", "taker_sell_base", "taker_buy_base"))).over(whole())).where("_s is not null")
    again = F.bool_or((F.col("bar_idx") > F.col("_s.bar_idx")) & (F.col(px) * sign < F.col("_s.price") * sign))
    one = d.groupBy(*SERIES).agg(F.first("_s").alias("s"), F.first("_p.price").alias("swept_level"), again.alias("failed"), F.first("_end").alias("e"))
    out = one.select(
        *SERIES, "swept_level", F.col("s.price").alias("sweep_price"), F.col("s.open_time_ms").alias("sweep_time"),
        (F.col("e.close") * sign > F.col("swept_level") * sign).alias("recovered"), "failed",
        F.when(F.coalesce(F.col("e.avg_volume"), F.lit(0.0)) == 0, True).otherwise(F.col("s.volume") >= F.col("e.avg_volume") * 1.1).alias("volume_confirm"),
        (F.col("s.taker_sell_base") > F.col("s.taker_buy_base")).alias("sell_pressure"))
    return out.withColumn("valid", ~F.col("failed") & F.col("recovered"))


def nearest_levels(pivots: DataFrame, prices: DataFrame) -> DataFrame:
    """above: the lowest pivot high over the price; below: the highest pivot low under it.  prices: symbol, tf, price
    of each series."""
    both = prices.select(*SERIES, F.col("price").alias("now")).join(pivots, SERIES_LIST, "left")
    return both.groupBy(*SERIES).agg(F.min(F.when((F.col("kind") == "high") & (F.col("price") > F.col("now")), F.col("price"))).alias("above"), F.max(F.when((F.col("kind") == "low") & (F.col("price") < F.col("now")), F.col("price"))).alias("below"))


def first_reach(zones: DataFrame, bars: DataFrame, step: int = 64) -> DataFrame:
    """zones (symbol, tf, side, bar_idx, level) with reached and reached_close: the first bar after bar_idx whose x is
    at least the level, and its close (null if there is none).  bars: symbol, tf, side, k, x, close.

    A tree of maxima over step, step**2 bars: each zone looks at the rest of its own node on each level (all nodes on
    the top one), then down into the first one that reaches: about 5 * step rows, not all later bars."""
    on, top = [*SERIES, "side"], 2
    node = lambda c, lv: F.floor(F.col(c) / step**lv)
    up = lambda c, lv: F.lit(0).cast("long") if lv == top else node(c, lv + 1)
    leaves = bars.withColumn("n", F.explode(F.array(*[F.struct(F.lit(lv).alias("lv"), node("k", lv).alias("at"), up("k", lv).alias("up")) for lv in range(top + 1)])))
    tree = leaves.groupBy(*on, "n.lv", "n.at", "n.up").agg(F.max("x").alias("x"), F.max("close").alias("close"))
    keys = [*on, "bar_idx"]
    climb = zones.select(*keys, "level", F.explode(F.array(*[F.struct(F.lit(lv).alias("lv"), node("bar_idx", lv).alias("own"), up("bar_idx", lv).alias("up")) for lv in range(top + 1)])).alias("n")).select(*keys, "level", "n.*")
    got = climb.join(tree, [*on, "lv", "up"]).where((F.col("at") > F.col("own")) & (F.col("x") >= F.col("level")))
    got = got.groupBy(*keys, "level").agg(F.min(F.struct("lv", "at", "close")).alias("f")).select(*keys, "level", "f.*")
    for lv in range(top, 0, -1):
        below = tree.where(F.col("lv") == lv - 1).select(*on, "up", F.col("at").alias("_at"), F.col("x").alias("_x"), F.col("close").alias("_close"))
        down = got.withColumn("up", F.when(F.col("lv") == lv, F.col("at"))).join(below, [*on, "up"], "left").where((F.col("lv") < lv) | (F.col("_x") >= F.col("level")))
        first = F.struct(F.least("lv", F.lit(lv - 1)).alias("lv"), F.coalesce("_at", "at").alias("at"), F.coalesce("_close", "close").alias("close"))
        got = down.groupBy(*keys, "level").agg(F.min(first).alias("f")).select(*keys, "level", "f.*")
    return zones.join(got.select(*keys, "level", F.col("at").alias("reached"), F.col("close").alias("reached_close")), [*keys, "level"], "left")


def gaps(df: DataFrame, cfg: Structure | None = None) -> DataFrame:
    """Three-bar gaps of at least gap_min_atr of the last ATR and gap_min_pct: side, from, to, and how far later bars
    filled them: open, partial, filled, or inverse (filled by a bar that closed beyond).  Needs atr."""
    cfg = cfg or Structure()
    end = F.max_by("atr", F.when(F.col("atr").isNotNull(), F.col("bar_idx"))).over(whole())
    h2, l2 = F.lag("high", 2).over(o()), F.lag("low", 2).over(o())
    up = F.when(h2 < F.col("low"), F.struct(F.lit("bullish").alias("side"), h2.alias("gap_low"), F.col("low").alias("gap_high")))
    down = F.when(l2 > F.col("high"), F.struct(F.lit("bearish").alias("side"), F.col("high").alias("gap_low"), l2.alias("gap_high")))
    found = df.select(*SERIES, "bar_idx", "open_time_ms", end.alias("_atr"), F.coalesce(up, down).alias("g")).where("g is not null").select(*SERIES, "bar_idx", "open_time_ms", "_atr", "g.*")
    size, mid = F.col("gap_high") - F.col("gap_low"), (F.col("gap_high") + F.col("gap_low")) / 2
    found = found.withColumn("size", size).withColumn("mid", mid).withColumn("size_pct", F.coalesce(div(F.col("size"), F.col("mid")) * 100, F.lit(0.0)))
    found = found.where((F.col("size") >= F.coalesce("_atr", F.lit(0.0)) * cfg.gap_min_atr) & (F.col("size_pct") >= cfg.gap_min_pct))
    bull = F.col("side") == "bullish"
    # upside down for bullish gaps, so that on both sides a bar fills a gap that reaches its level
    flip = lambda c: F.when(bull, -F.col(c)).otherwise(F.col(c))
    sides = df.select(*SERIES, F.col("bar_idx").alias("k"), "low", "high", "close", F.explode(F.array(F.lit("bullish"), F.lit("bearish"))).alias("side"))
    bars = sides.select(*SERIES, "side", "k", F.when(bull, -F.col("low")).otherwise(F.col("high")).alias("x"), flip("close").alias("close"))
    level = F.when(bull, -F.col("gap_low")).otherwise(F.col("gap_high"))
    out = first_reach(found.withColumn("level", level), bars)
    # before the first full touch no bar reaches depth 1, so the deepest of all bars tells the part if there is none
    most = bars.withColumn("most", F.max("x").over(Window.partitionBy(*SERIES, "side").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)))
    out = out.join(most.select(*SERIES, "side", F.col("k").alias("bar_idx"), "most"), [*SERIES, "side", "bar_idx"], "left")
    out = out.withColumn("deepest", F.when(bull, F.col("gap_high") + F.col("most")).otherwise(F.col("most") - F.col("gap_low")))
    out = out.withColumn("first", F.when(F.col("reached").isNotNull(), F.struct(F.col("reached").alias("k"), (F.col("reached_close") > F.col("level")).alias("beyond"))))
    part = div(F.greatest(F.coalesce("deepest", F.lit(0.0)), F.lit(0.0)), F.col("size"))
    level = F.when(F.col("first").isNotNull(), 1.0).otherwise(part)
    status = F.when(F.coalesce(F.col("first.beyond"), F.lit(False)), "inverse").when(level >= 0.99, "filled").when(level > 0.05, "partial").otherwise("open")
    return out.withColumn("status", status).drop("first", "deepest", "_atr", "level", "reached", "reached_close", "most")


def order_blocks(df: DataFrame, events: DataFrame, lookback: int = 12) -> DataFrame:
    """The last opposite bar before each break, at most `lookback` bars back: one row for each side and bar (of the
    first break), with whether a later close went through it.  Needs avg_volume."""
    bars = df.select(*SERIES, F.col("bar_idx").alias("k"), F.col("open_time_ms").alias("time"), "open", "high", "low", "close", "volume", "avg_volume")
    before = F.explode(F.sequence(F.col("bar_idx") - lookback, F.col("bar_idx") - 1)).alias("k")
    near = events.select(*SERIES, F.col("bar_idx").alias("at"), "rank", "side", "type", before).join(bars, [*SERIES_LIST, "k"])
    opposite = near.where(F.when(F.col("side") == "bullish", F.col("close") < F.col("open")).otherwise(F.col("close") > F.col("open")))
    block = F.max(F.struct("k", "time", "high", "low", "volume", "avg_volume", "open", "close"))
    found = opposite.groupBy(*SERIES, "side", "at", "rank", "type").agg(block.alias("b"))
    first = F.row_number().over(Window.partitionBy(*SERIES, "side", "b.k").orderBy("at"))
    found = found.withColumn("_n", first).where("_n = 1").select(
        *SERIES, "side", F.col("b.k").alias("bar_idx"), F.col("b.time").alias("open_time_ms"), F.greatest("b.open", "b.close", "b.high").alias("top"), F.least("b.open", "b.close", "b.low").alias("bottom"),
        F.when(F.coalesce(F.col("b.avg_volume"), F.lit(0.0)) > 0, F.col("b.volume") >= F.col("b.avg_volume")).otherwise(False).alias("strong"), F.col("type").alias("from_event"))
    later = Window.partitionBy(*SERIES).orderBy(F.desc("bar_idx")).rowsBetween(Window.unboundedPreceding, -1)
    closes = df.select(*SERIES, "bar_idx", F.min("close").over(later).alias("_least"), F.max("close").over(later).alias("_most"))
    through = F.when(F.col("side") == "bullish", F.col("_least") < F.col("bottom")).otherwise(F.col("_most") > F.col("top"))
    out = found.join(closes, [*SERIES, "bar_idx"], "left").withColumn("invalidated", F.coalesce(through, F.lit(False))).drop("_least", "_most")
    return out.withColumn("mid", (F.col("top") + F.col("bottom")) / 2)


def golden_cross_retest(df: DataFrame, cfg: Retest | None = None) -> DataFrame:
    """One row for each series: whether ema_50 crossed ema_200 upwards within the last bars after an impulse, held it
    by close, and came back to the two; and the last rejection after that.  Needs ema_50, ema_200, atr."""
    cfg = cfg or Retest()
    i, all_ = F.col("bar_idx"), whole()
    n = F.count(F.lit(1)).over(all_)
    a, b = F.col("ema_50"), F.col("ema_200")
    pa, pb = F.lag("ema_50").over(o()), F.lag("ema_200").over(o())
    d = df.withColumn("_n", n).withColumn("_atr", F.max_by("atr", F.when(F.col("atr").isNotNull(), i)).over(all_))
    d = d.withColumn("_x", (pa <= pb) & (a > b) & (i >= F.greatest(F.lit(1), F.col("_n") - cfg.cross)))
    d = d.withColumn("cross", F.max(F.when(F.col("_x"), i)).over(all_))
    c = F.col("cross")
    impulse = F.bool_or((F.col("close") > b * (1 + cfg.impulse_margin / 100)) & (i >= c - cfg.impulse) & (i <= c)).over(all_)
    held = ~F.coalesce(F.bool_or((F.col("close") < b) & (i >= c)).over(all_), F.lit(False))
    slack = F.col("_atr") * cfg.zone_atr
    back = (i >= c) & (F.col("low") <= F.greatest(a, b) + slack) & (F.col("low") >= F.least(a, b) - slack) & a.isNotNull() & b.isNotNull()
    d = d.withColumn("_imp", F.coalesce(impulse, F.lit(False))).withColumn("_held", held).withColumn("retest", F.min(F.when(back, i)).over(all_))
    reject = (i >= F.col("retest")) & (upper_wick() >= cfg.wick) & (close_pos() <= cfg.close_pos) & (F.col("close") > b)
    g = d.groupBy(*SERIES).agg(
        F.max("_n").alias("n"), F.max("_atr").alias("a"), F.max("cross").alias("cross"), F.bool_or("_imp").alias("imp"), F.bool_and("_held").alias("held"), F.max("retest").alias("retest"), F.max(F.when(reject, i)).alias("reject"),
        F.max(F.when(i == F.col("cross"), F.col("open_time_ms"))).alias("cross_time"), F.max(F.when(i == F.col("retest"), F.col("open_time_ms"))).alias("retest_time"), F.max(F.when(reject, F.col("open_time_ms"))).alias("reject_time"))
    reason = F.when((F.col("n") < 10) | (F.coalesce("a", F.lit(0.0)) == 0), "too few bars").when(F.col("cross").isNull(), "no cross").when(~F.col("imp"), "no impulse").when(~F.col("held"), "closed below").when(F.col("retest").isNull(), "no retest")
    g = g.withColumn("reason", reason).withColumn("detected", F.col("reason").isNull())
    times = [F.when(F.col("detected"), F.col(t)).alias(t) for t in ("cross_time", "retest_time", "reject_time")]
    return g.select(*SERIES, "detected", "reason", (F.col("detected") & F.col("reject").isNotNull()).alias("has_rejection"), *times)


def last_swing(pivots: DataFrame) -> DataFrame:
    """Price of the last pivot of each kind: last_high, last_low."""
    at = lambda k: F.max_by("price", F.when(F.col("kind") == k, F.col("bar_idx")))
    return pivots.groupBy(*SERIES).agg(at("high").alias("last_high"), at("low").alias("last_low"))


def from_last_low(price: Column, last_low: Column) -> Column:
    return F.coalesce(pct(price, last_low), F.lit(0.0))


def from_last_high(price: Column, last_high: Column) -> Column:
    return F.coalesce(div(last_high - price, last_high) * 100, F.lit(0.0))
