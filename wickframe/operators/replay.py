"""Walk-forward replay: labels, exits, cooldown, and trade statistics.

Signals are rows of causal window columns, so nothing is recomputed per prefix.  A trade's path is the next `hold` bars,
a bounded array; what happens first on it is found by array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickframe.functions.scalar import div, r_multiple
from wickframe.operators import indicators as ind
from wickframe.operators.indicators import SERIES, w
from wickframe.operators.structure import first_reach


def with_length(bars: DataFrame) -> DataFrame:
    """Adds n_bars, the length of the series, before any row is filtered away."""
    return bars.withColumn("n_bars", F.count(F.lit(1)).over(Window.partitionBy(*SERIES)))


def grid(d: DataFrame, start: int = 240, step: int = 6, ahead: int = 2) -> DataFrame:
    """Evaluation bars: from `start` every `step`, with `ahead` more bars behind them.  Rows that are no longer whole
    series must have n_bars."""
    d = d if "n_bars" in d.columns else with_length(d)
    i = F.col("bar_idx")
    return d.where((i >= start) & ((i - start) % step == 0) & (i < F.col("n_bars") - ahead))


def with_labels(d: DataFrame, rise: float = 40.0, ahead: int = 42, day: int = 6) -> DataFrame:
    """What the future holds (labels only): label_a: some high within `ahead` bars is `rise` % over the close `day`
    bars before it (null if the future is too short to say no); best_change: the best change over `day` bars inside
    `ahead`; peak_7, peak_14, trough_7: extremes of highs and lows against the close."""
    then = ind.back("close", day)
    d = d.withColumn("_rise", div(F.col("high") - then, then) * 100).withColumn("_chg", div(F.lead("close", day).over(ind.o()) - F.col("close"), F.col("close")) * 100)
    n_future = F.count(F.lit(1)).over(w(1, ahead))
    best = F.max("_rise").over(w(1, ahead))
    d = d.withColumn("label_a", F.when(best >= rise, True).when(n_future == ahead, False))
    d = d.withColumn("best_change", F.max("_chg").over(w(1, ahead - day)))
    ext = lambda c, f, k: div(f(c).over(w(1, k)) - F.col("close"), F.col("close")) * 100
    return d.withColumn("peak_7", ext("high", F.max, ahead)).withColumn("peak_14", ext("high", F.max, 2 * ahead)).withColumn("trough_7", ext("low", F.min, ahead)).drop("_rise", "_chg")


def with_paths(signals: DataFrame, bars: DataFrame, hold: int) -> DataFrame:
    """Adds fill (the next bar's open), path (the next `hold` bars: k, high, low, close and the highest high so far) and
    the last bar's close and place.  signals: symbol, tf, bar_idx, ... ; those without a next bar go."""
    end = bars.groupBy(*SERIES).agg(F.max("bar_idx").alias("_end"))
    nexts = bars.select(*SERIES, (F.col("bar_idx") - 1).alias("bar_idx"), F.col("open").alias("fill"))
    s = signals.join(nexts, [*SERIES, "bar_idx"]).join(end, list(SERIES))
    path = bars.select(*SERIES, F.col("bar_idx").alias("k"), "high", "low", "close")
    steps = s.select(*SERIES, "bar_idx", F.explode(F.sequence(F.col("bar_idx") + 1, F.col("bar_idx") + hold)).alias("k"))
    j = steps.join(path, [*SERIES, "k"])
    top = F.max("high").over(Window.partitionBy(*SERIES, "bar_idx").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    steps = j.withColumn("top", top).groupBy(*SERIES, "bar_idx").agg(F.array_sort(F.collect_list(F.struct("k", "high", "low", "close", "top"))).alias("path"))
    out = s.join(steps, [*SERIES, "bar_idx"])
    return out.withColumn("last", F.element_at("path", -1)).withColumn("last_k", F.least(F.col("bar_idx") + hold, F.col("_end"))).drop("_end")


def first(path: str, when) -> Column:
    """k of the first step for which `when` holds, or null."""
    return F.get(F.filter(path, when), F.lit(0))["k"]


def with_fixed_exit(d: DataFrame, target_r: float, cost: float, out: str = "fixed", share_of: str = "path") -> DataFrame:
    """Stop at 1R against, target, or the last close; the stop comes first on a bar that has both.  Needs fill, risk."""
    f, k = F.col("fill"), F.col("risk")
    stop, target = f - k, f + k * target_r
    d = d.withColumn("_s", first(share_of, lambda b: b["low"] <= stop)).withColumn("_t", first(share_of, lambda b: b["high"] >= target))
    stopped = F.col("_s").isNotNull() & (F.col("_t").isNull() | (F.col("_s") <= F.col("_t")))
    why = F.when(stopped, "stop").when(F.col("_t").isNotNull(), "target").otherwise("time")
    price = F.when(stopped, stop).when(F.col("_t").isNotNull(), target).otherwise(F.col("last.close"))
    at = F.when(stopped, F.col("_s")).otherwise(F.coalesce("_t", "last_k"))
    return d.withColumn(out, F.struct(r_multiple(f, price, k, cost).alias("r"), why.alias("why"), at.alias("k"))).drop("_s", "_t")


def with_partial_exit(d: DataFrame, target_r: float, cost: float, at_r: float = 1.0, share: float = 0.5, out: str = "partial") -> DataFrame:
    """At at_r a share is taken (without cost) and the stop moves to the fill, from the next bar on; the target counts
    from the bar of the partial."""
    f, k = F.col("fill"), F.col("risk")
    stop, half, target = f - k, f + k * at_r, f + k * target_r
    d = d.withColumn("_s", first("path", lambda b: b["low"] <= stop)).withColumn("_p", first("path", lambda b: b["high"] >= half))
    d = d.withColumn("_p", F.when(F.col("_s").isNull() | (F.col("_p") < F.col("_s")), F.col("_p")))
    d = d.withColumn("_t", first("path", lambda b: (b["k"] >= F.col("_p")) & (b["high"] >= target))).withColumn("_b", first("path", lambda b: (b["k"] > F.col("_p")) & (b["low"] <= f)))
    taken = F.col("_p").isNotNull()
    even = taken & F.col("_b").isNotNull() & (F.col("_t").isNull() | (F.col("_b") <= F.col("_t")))
    hit = taken & F.col("_t").isNotNull() & ~even
    R = lambda px: r_multiple(f, px, k, cost)
    rest = F.lit(share * at_r)
    value = F.when(even, rest + R(f) * (1 - share)).when(hit, rest + R(target) * (1 - share)).when(taken, rest + R(F.col("last.close")) * (1 - share)).when(F.col("_s").isNotNull(), R(stop)).otherwise(R(F.col("last.close")))
    why = F.when(even, "even").when(hit, "target").when(~taken & F.col("_s").isNotNull(), "stop").otherwise("time")
    at = F.when(even, F.col("_b")).when(hit, F.col("_t")).when(~taken & F.col("_s").isNotNull(), F.col("_s")).otherwise(F.col("last_k"))
    return d.withColumn(out, F.struct(value.alias("r"), why.alias("why"), at.alias("k"))).drop("_s", "_p", "_t", "_b")


def with_trailing_exit(d: DataFrame, cost: float, arm_r: float = 2.0, give_r: float = 1.0, out: str = "trail") -> DataFrame:
    """Stop at 1R until the highest high so far is arm_r up; then give_r below that high."""
    f, k = F.col("fill"), F.col("risk")
    peak = lambda b: (b["top"] - f) / k
    level = lambda b: F.when(peak(b) >= arm_r, f + (peak(b) - give_r) * k).otherwise(f - k)
    d = d.withColumn("_x", F.get(F.filter("path", lambda b: b["low"] <= level(b)), F.lit(0)))
    armed = (F.col("_x.top") - f) / k >= arm_r
    price = F.when(F.col("_x").isNull(), F.col("last.close")).when(armed, f + ((F.col("_x.top") - f) / k - give_r) * k).otherwise(f - k)
    why = F.when(F.col("_x").isNull(), "time").when(armed, "trail").otherwise("stop")
    return d.withColumn(out, F.struct(r_multiple(f, price, k, cost).alias("r"), why.alias("why"), F.coalesce(F.col("_x.k"), F.col("last_k")).alias("k"))).drop("_x")


def with_early_exit(d: DataFrame, target_r: float, cost: float, bars: int = 30, out: str = "early_out") -> DataFrame:
    """The fixed rule, but out at the close of bar `bars` if 1R was not seen by then."""
    f, k = F.col("fill"), F.col("risk")
    d = with_fixed_exit(d, target_r, cost, "_f")
    d = d.withColumn("_q", F.get(F.filter("path", lambda b: b["k"] == F.col("bar_idx") + bars), F.lit(0)))
    quit_ = F.col("_q").isNotNull() & ((F.col("_q.top") - f) / k < 1) & ((F.col("_f.why") == "time") | (F.col("_f.k") > F.col("_q.k")))
    return d.withColumn(out, F.when(quit_, F.struct(r_multiple(f, F.col("_q.close"), k, cost).alias("r"), F.lit("quit").alias("why"), F.col("_q.k").alias("k"))).otherwise(F.col("_f"))).drop("_f", "_q")


def with_excursions(d: DataFrame, exits: list[str]) -> DataFrame:
    """mfe, mae: furthest ways with and against the trade, in R, up to the bar by which all these rules are out."""
    f, k = F.col("fill"), F.col("risk")
    out_by = F.greatest(*[F.col(f"{e}.k") for e in exits])
    seen = F.filter("path", lambda b: b["k"] <= out_by)
    return d.withColumn("mfe", F.greatest(F.lit(0.0), (F.array_max(F.transform(seen, lambda b: b["high"])) - f) / k)).withColumn("mae", F.least(F.lit(0.0), (F.array_min(F.transform(seen, lambda b: b["low"])) - f) / k))


def cooled(trades: DataFrame, by: tuple = SERIES, exit_col: str = "exit_k") -> DataFrame:
    """Of each series, in order, the trades that start after the last kept one is over.  A fold over the series' trades,
    whose number is bounded by its evaluation bars."""
    one = F.struct(F.col("bar_idx").cast("long").alias("i"), F.col(exit_col).cast("long").alias("x"))
    start = F.struct(F.lit(-1).cast("long").alias("until"), F.expr("cast(array() as array<bigint>)").alias("kept"))
    step = lambda acc, t: F.when(t["i"] > acc["until"], F.struct(t["x"].alias("until"), F.concat(acc["kept"], F.array(t["i"])).alias("kept"))).otherwise(acc)
    kept = trades.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("t")).select(*by, F.explode(F.aggregate("t", start, step)["kept"]).alias("bar_idx"))
    return trades.join(kept, [*by, "bar_idx"], "left_semi")


def _stats() -> list[Column]:
    gain, loss = F.sum(F.when(F.col("r") > 0, F.col("r")).otherwise(0.0)), -F.sum(F.when(F.col("r") <= 0, F.col("r")).otherwise(0.0))
    count = lambda x: F.count_if(F.col("why") == x).alias(f"n_{x}")
    n = F.count(F.lit(1))
    win = (F.count_if(F.col("r") > 0) * 100.0 / n).alias("win_pct")
    factor = F.when(loss > 0, div(gain, loss)).alias("profit_factor")
    return [n.alias("n"), win, F.avg("r").alias("avg_r"), F.sum("r").alias("total_r"), factor, *[count(x) for x in ("target", "even", "stop", "time")]]


def trade_stats(trades: DataFrame, *by: str) -> DataFrame:
    """n, win rate (%), mean and total R, profit factor (null without losses), and exits by reason.  Needs r, why."""
    return trades.groupBy(*by).agg(*_stats())


def trade_report(trades: DataFrame, *by: str, order: tuple = ("bar_idx",)) -> DataFrame:
    """trade_stats() and drawdown() of the same groups in one pass over the trades."""
    return _run_down(trades, by, order).groupBy(*by).agg(*_stats(), _deepest())


def report_groups(trades: DataFrame, edges: tuple = (25, 40, 55, 70, 101), stages: tuple = (1, 2, 3)) -> DataFrame:
    """A row of each trade for `all`, for its band of score, and for its stage: group, and ord, the order in which the
    trades of a group are summed (the whole list by symbol, the others by score first)."""
    band = F.lit(None).cast("string")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        band = F.when((F.col("score") >= a) & (F.col("score") < b), f"score {a}-{b}").otherwise(band)
    stage = F.when(F.col("stage").isin(*stages), F.concat(F.lit("stage "), F.col("stage").cast("string")))
    rows = trades.withColumn("group", F.explode(F.array_compact(F.array(F.lit("all"), band, stage))))
    return rows.withColumn("ord", F.when(F.col("group") == "all", 0).otherwise(F.col("score")))


def _run_down(trades: DataFrame, by: tuple, order: tuple) -> DataFrame:
    run = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return trades.withColumn("_c", F.sum("r").over(run)).withColumn("_p", F.greatest(F.lit(0.0), F.max("_c").over(run)))


def _deepest() -> Column:
    return F.least(F.lit(0.0), F.min(F.col("_c") - F.col("_p"))).alias("max_drawdown")


def drawdown(trades: DataFrame, *by: str, order: tuple = ("bar_idx",)) -> DataFrame:
    """The deepest fall of summed R from its peak so far (at least 0), in the given order within each group."""
    return _run_down(trades, by, order).groupBy(*by).agg(_deepest())


def as_of(left: DataFrame, rates: DataFrame, value: str = "rate") -> DataFrame:
    """left (symbol, ms, ...) with the latest rate (symbol, ms, rate) at or before ms; null if there is none.  One
    sort of both sides by symbol and time, no join."""
    cols = [c for c in left.columns if c not in ("symbol", "ms")]
    a = rates.groupBy("symbol", "ms").agg(F.max(value).alias(value)).select("symbol", "ms", F.lit(0).alias("_side"), value, F.lit(None).cast(left.select(F.struct(*cols).alias("r")).schema[0].dataType).alias("_row"))
    b = left.select("symbol", "ms", F.lit(1).alias("_side"), F.lit(None).cast(dict(rates.dtypes)[value]).alias(value), F.struct(*cols).alias("_row"))
    seen = F.last(value, ignorenulls=True).over(Window.partitionBy("symbol").orderBy("ms", "_side").rowsBetween(Window.unboundedPreceding, 0))
    return a.unionByName(b).withColumn("_v", seen).where("_side = 1").select("symbol", "ms", "_row.*", F.col("_v").alias(value))


def paper_resolved(log: DataFrame, bars: DataFrame, as_of_ms: int, cost: float = 0.0) -> DataFrame:
    """Paper trades (id, symbol, at_ms, entry, stop, tp2) against bars (one series a symbol) that began at or after them
    and are over: lost at the first low at the stop, won at the first high at the target, the loss first
    on a bar with both, else open and marked at the last close.

    A trade meets its first bar by as_of(), and the bars that reach its levels by first_reach(), so no trade is joined
    with all later bars of its symbol."""
    nth = F.row_number().over(Window.partitionBy("symbol").orderBy("open_time_ms")).cast("long") - 1
    bars = bars.where(F.col("close_time_ms") <= as_of_ms).select("symbol", F.lit("").alias("tf"), nth.alias("bar_idx"), "open_time_ms", "high", "low", "close")
    # the last bar that began before the trade; -1 if none did
    keys = log.select("id", "symbol", (F.col("at_ms") - 1).alias("ms"), "stop", "tp2")
    since = as_of(keys, bars.select("symbol", F.col("open_time_ms").alias("ms"), F.col("bar_idx").alias("before")), "before")
    since = since.select("id", "symbol", F.lit("").alias("tf"), F.coalesce("before", F.lit(-1)).cast("long").alias("bar_idx"), "stop", "tp2")
    levels = F.explode(F.array(F.struct(F.lit("stop").alias("side"), (-F.col("stop")).alias("level")), F.struct(F.lit("target").alias("side"), F.col("tp2").alias("level"))))
    zones = since.select("id", "symbol", "tf", "bar_idx", levels.alias("z")).select("id", "symbol", "tf", "bar_idx", "z.*")
    # several trades of a bar have levels of their own
    zones = zones.withColumn("level", F.col("level").cast("double"))
    asked = zones.select("symbol", "tf", "side", "bar_idx", "level").distinct()
    sides = F.explode(F.array(F.struct(F.lit("stop").alias("side"), (-F.col("low")).alias("x")), F.struct(F.lit("target").alias("side"), F.col("high").alias("x"))))
    steps = bars.select("symbol", "tf", F.col("bar_idx").cast("long").alias("k"), "close", sides.alias("s")).select("symbol", "tf", "s.side", "k", "s.x", "close")
    found = first_reach(asked, steps).select("symbol", "tf", "side", "bar_idx", "level", "reached")
    hit = zones.join(found, ["symbol", "tf", "side", "bar_idx", "level"], "left")
    at = lambda side: F.max(F.when(F.col("side") == side, F.col("reached"))).alias(side)
    both = hit.groupBy("id", "symbol", "bar_idx").agg(at("stop"), at("target"))
    is_lost = F.col("stop").isNotNull() & (F.col("target").isNull() | (F.col("stop") <= F.col("target")))
    both = both.select("id", "symbol", F.col("bar_idx").alias("_from"), is_lost.alias("_lost"), F.col("target").isNotNull().alias("_won"), F.when(is_lost, F.col("stop")).otherwise(F.col("target")).alias("_at"))
    times = bars.select("symbol", F.col("bar_idx").cast("long").alias("_at"), F.col("open_time_ms").alias("exit_ms"))
    end = bars.groupBy("symbol").agg(F.max_by("close", "bar_idx").alias("mark"), F.max("bar_idx").alias("_end"))
    both = both.join(times, ["symbol", "_at"], "left").join(end, "symbol", "left").drop("symbol")
    g = log.join(both, "id", "left")
    state = F.when(F.col("_lost"), "loss").when(F.col("_won"), "win").otherwise("open")
    # only bars from the trade on count as its mark
    mark = F.when(F.col("_end") > F.col("_from"), F.col("mark"))
    price = F.when(state == "loss", F.col("stop")).when(state == "win", F.col("tp2")).otherwise(F.coalesce(mark, "entry"))
    return g.select(*log.columns, state.alias("state"), "exit_ms", div(price - F.col("entry"), F.col("entry") - F.col("stop")).alias("r"))


def paper_summary(resolved: DataFrame, *by: str) -> DataFrame:
    """n, closed, wins, win_pct of the closed ones, total_r and total_money of resolved paper trades.  Money is R times
    the money at risk by the trade's own seed and leverage (seed, leverage, entry, stop)."""
    closed, won = F.col("state") != "open", F.col("state") == "win"
    money = F.col("seed") * F.col("leverage") * div(F.col("entry") - F.col("stop"), F.col("entry")) * F.col("r")
    return resolved.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(closed).alias("closed"), F.count_if(won).alias("wins"),
        div(F.count_if(won) * 100.0, F.count_if(closed)).alias("win_pct"), F.coalesce(F.sum(F.when(closed, F.col("r"))), F.lit(0.0)).alias("total_r"),
        F.coalesce(F.sum(F.when(closed, money)), F.lit(0.0)).alias("total_money"))


def paper_added(log: DataFrame, new: DataFrame) -> DataFrame:
    """log with new records, except for symbols that have an open one."""
    return log.unionByName(new.join(log.where("state = 'open'").select("symbol").distinct(), "symbol", "left_anti"))
