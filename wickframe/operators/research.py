"""Research over evaluated rows: lifts, bands, tops per day, variants, refit, run-ups and pre-move windows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickframe.functions.scalar import div, r0, ramp
from wickframe.operators import indicators as ind
from wickframe.operators.indicators import SERIES
from wickframe.operators.reduce import Sums
from wickframe.sources.shared import cut


def lift_table(rows: DataFrame, predicates: dict[str, Column], least: int = 30) -> DataFrame:
    """predicate, n, rate (%), lift against all rows, for predicates that hold for at least `least` rows: one pass."""
    ok = {k: F.coalesce(p, F.lit(False)) for k, p in predicates.items()}
    aggs = [F.count_if(p).alias(f"n_{k}") for k, p in ok.items()] + [F.count_if(p & F.col("hit")).alias(f"h_{k}") for k, p in ok.items()]
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("predicate"), F.col(f"n_{k}").alias("n"), F.col(f"h_{k}").alias("h")) for k in ok]))
    out = one.select(F.col("n").alias("all_n"), F.col("h").alias("all_h"), each.alias("x")).select("x.*", "all_n", "all_h").where(F.col("n") >= least)
    rate, base = div(F.col("h"), F.col("n")), div(F.col("all_h"), F.col("all_n"))
    return out.select("predicate", "n", (rate * 100).alias("rate"), div(rate, base).alias("lift"))


def lifts_by(rows: DataFrame, predicates: dict[str, Column], by: str, least: int = 8) -> DataFrame:
    """by, predicate, n, rate (%), lift against the rows of the same period (or other group), where a predicate holds
    for at least `least` of them: one pass."""
    ok = {k: F.coalesce(p, F.lit(False)) for k, p in predicates.items()}
    aggs = [x for k, p in ok.items() for x in (F.count_if(p).alias(f"n_{k}"), F.count_if(p & F.col("hit")).alias(f"h_{k}"))]
    one = rows.groupBy(by).agg(F.count(F.lit(1)).alias("all_n"), F.count_if("hit").alias("all_h"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("predicate"), F.col(f"n_{k}").alias("n"), F.col(f"h_{k}").alias("h")) for k in ok]))
    out = one.select(by, "all_n", "all_h", each.alias("x")).select(by, "all_n", "all_h", "x.*").where(F.col("n") >= least)
    rate, base = div(F.col("h"), F.col("n")), div(F.col("all_h"), F.col("all_n"))
    return out.select(by, "predicate", "n", (rate * 100).alias("rate"), div(rate, base).alias("lift"))


def compared(rows: DataFrame, scores: dict[str, Column], least: int = 40, top: int = 3) -> DataFrame:
    """Models side by side: model, n (rows that score `least` or more), rate, lift, and top_rate, the rate of the best
    `top` rows of each day (ties by symbol)."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), c.alias("points")) for k, c in scores.items()]))
    d = rows.select("day", "symbol", "hit", each.alias("m")).select("day", "symbol", "hit", "m.*")
    nth = F.row_number().over(Window.partitionBy("model", "day").orderBy(F.desc("points"), "symbol"))
    good, best, hit = F.col("points") >= least, F.col("nth") <= top, F.col("hit").cast("int")
    g = d.withColumn("nth", nth).groupBy("model").agg(
        F.count_if(good).alias("n"), F.avg(F.when(good, hit)).alias("rate"), F.avg(hit).alias("base"), F.avg(F.when(best, hit)).alias("top_rate"))
    return g.select("model", "n", "rate", div(F.col("rate"), F.col("base")).alias("lift"), "top_rate")


def newcomers(members: DataFrame, period: str, key: str = "symbol") -> DataFrame:
    """Rows of members whose key isn't among those of the period before (periods are whole numbers)."""
    before = members.select(key, (F.col(period) + 1).alias(period)).distinct()
    return members.join(before, [key, period], "left_anti")


def banded(rows: DataFrame, by: str, edges: list[float]) -> DataFrame:
    """Rate and lift by half-open bands [edge, next edge)."""
    band = F.lit(None).cast("string")
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        band = F.when((F.col(by) >= a) & (F.col(by) < b), f"{a:g}-{b:g}").otherwise(band)
    base = rows.agg(F.avg(F.col("hit").cast("int")).alias("base"))
    got = rows.withColumn("band", band).where("band is not null").groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("hit").cast("int")).alias("rate"))
    return got.join(F.broadcast(base)).select("band", "n", "rate", div(F.col("rate"), F.col("base")).alias("lift"))


def top_per_day(rows: DataFrame, score: str, sizes: tuple = (1, 3, 5, 10, 20)) -> DataFrame:
    """Rate and lift of the best n rows of each day by score (ties by symbol), for each n."""
    best = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(score), "symbol"))
    d = rows.withColumn("_k", best)
    aggs = [x for n in sizes for x in (F.count_if(F.col("_k") <= n).alias(f"n{n}"), F.count_if((F.col("_k") <= n) & F.col("hit")).alias(f"h{n}"))]
    one = d.agg(F.avg(F.col("hit").cast("int")).alias("base"), *aggs)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("top"), F.col(f"n{n}").alias("n"), F.col(f"h{n}").alias("h")) for n in sizes]))
    out = one.select("base", each.alias("x")).select("base", "x.*")
    rate = div(F.col("h"), F.col("n"))
    return out.select("top", "n", rate.alias("rate"), div(rate, F.col("base")).alias("lift"))


def split(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """Adds train: rows before the time at place floor(share * n) in time order; a time is never on both sides.  The
    cut comes from counts by time, so no task sorts all rows."""
    times = rows.groupBy("ms").agg(F.count(F.lit(1)).alias("k"))
    total = F.sum("k").over(Window.partitionBy())
    upto = F.sum("k").over(Window.orderBy("ms"))
    limit = times.withColumn("_t", total).withColumn("_u", upto).where(F.col("_u") > F.floor(F.col("_t") * share)).agg(F.min("ms").alias("cut"))
    return rows.join(F.broadcast(limit)).withColumn("train", F.col("ms") < F.col("cut")).drop("cut")


#: Fixed values of five additive scores: weights, penalty for flat funding, penalty for thin trading.
VARIANTS = {
    "A": ({"momentum": 34, "change": 26, "volume": 16, "age": 14, "funding": 10}, 25, 10),
    "B": ({"momentum": 38, "change": 28, "volume": 16, "age": 18}, 25, 10),
    "C": ({"momentum": 45, "change": 32, "age": 23}, 25, 10),
    "D": ({"momentum": 45, "change": 32, "age": 23}, 0, 10),
    "E": ({"momentum": 38, "change": 28, "volume": 16, "age": 18}, 40, 20),
}


def variant(name: str, min_turnover: float = 5e6) -> Column:
    """An additive score from momentum, change_24h, vol_expand, age_days, funding and turnover_24h."""
    weights, flat, thin = VARIANTS[name]
    parts = {
        "momentum": ramp(F.abs(F.coalesce("momentum", F.lit(0.0))), 15, 60), "change": ramp(F.abs(F.coalesce("change_24h", F.lit(0.0))), 5, 20),
        "volume": ramp(F.coalesce("vol_expand", F.lit(1.0)), 1.2, 5), "age": 1 - ramp(F.coalesce("age_days", F.lit(400.0)), 200, 800),
        "funding": ramp(F.abs(F.coalesce("funding", F.lit(0.0))), 0.00006, 0.0004)}
    total = F.lit(0.0)
    for k, v in weights.items():
        total = total + parts[k] * float(v)
    total = total - F.when(F.abs("funding") < 0.00006, flat).otherwise(0) - F.when(F.coalesce("turnover_24h", F.lit(0.0)) < min_turnover, thin).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), r0(total))).cast("int")


def features(rows: DataFrame) -> DataFrame:
    """The eight inputs of the refit, with defaults for what is missing."""
    v = lambda c, d: F.coalesce(F.col(c), F.lit(float(d)))
    pos = lambda x: F.log(F.greatest(x, F.lit(0.0)) + 1)
    return rows.select(
        "*", F.log(F.abs(v("funding", 0)) + 1e-6).alias("f_funding"), pos(v("momentum", 0)).alias("f_up"), pos(-v("momentum", 0)).alias("f_down"), F.log(v("vol_expand", 1) + 0.1).alias("f_volume"),
        F.log(v("age_days", 400) + 1).alias("f_age"), pos(v("change_24h", 0)).alias("f_change_up"), pos(-v("change_24h", 0)).alias("f_change_down"), F.log(v("turnover_24h", 1e6) + 1).alias("f_turnover"))


FEATURES = ("f_funding", "f_up", "f_down", "f_volume", "f_age", "f_change_up", "f_change_down", "f_turnover")


def standardised(rows: DataFrame, cols: tuple = FEATURES) -> DataFrame:
    """z_<col> with mean and population deviation of the training rows; a deviation of 0 counts as 1."""
    fit = rows.where("train").agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in cols])
    d = rows.join(F.broadcast(fit))
    for c in cols:
        s = F.col(f"_{c}.s")
        d = d.withColumn(f"z_{c}", (F.col(c) - F.col(f"_{c}.m")) / F.when(F.coalesce(s, F.lit(0.0)) == 0, 1.0).otherwise(s))
    return d.drop(*[f"_{c}" for c in cols])


def logistic_fit(rows: DataFrame, cols: tuple, rounds: int = 4000, rate: float = 0.3, l2: float = 1e-3, per_task: int = 100_000) -> tuple[list[float], float]:
    """Weights and bias by gradient descent from zero on the rows' (z columns, hit), as many rounds as the reference's:
    with rare hits (or misses) they end well before the optimum, so a faster way to that gives other weights.

    One barrier stage: each task keeps its share of the rows, all rounds long, and in every round the tasks add up
    their sums (a double for each column, see reduce.py), and so have the same weights.  There
    are at least two tasks, and one for every `per_task` rows as far as the cluster's cores go, since all must run at
    once."""
    data = cut(rows.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)], F.col("hit").cast("double").alias("y")))
    m = len(cols)
    tasks = max(1, min(data.sparkSession.sparkContext.defaultParallelism, max(2, -(-data.count() // per_task))))

    def fit(batches):
        from pyspark import BarrierTaskContext

        context = BarrierTaskContext.get()
        sums = Sums(context)
        parts = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches]
        d = np.concatenate([np.zeros((0, m + 1)), *parts])
        z, y = np.ascontiguousarray(d[:, :m]), d[:, m]
        n, w, b = sums.total(np.array([float(len(y))]))[0], np.zeros(m), 0.0
        with np.errstate(over="ignore"):
            for _ in range(rounds if n else 0):
                e = 1 / (1 + np.exp(-(z @ w + b))) - y
                g = sums.total(np.append(e @ z, e.sum())) / n
                w, b = w - rate * (g[:m] + l2 * w), b - rate * g[m]
        sums.close()
        if context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64())), pa.array([float(b)])], ["w", "b"])

    w, b = data.repartition(tasks).mapInArrow(fit, "w array<double>, b double", barrier=True).collect()[0]
    return list(w), b


def run_up(bars: DataFrame) -> DataFrame:
    """Of each series: changes over 1, 7 and 30 bars, the best rise from a low to a later high, bars, price."""
    low = F.min("low").over(ind.past())
    d = bars.withColumn("_r", F.when(low > 0, (F.col("high") / low - 1) * 100))
    for k in (1, 7, 30):
        then = ind.back("close", k)
        d = d.withColumn(f"d{k}", F.when(then != 0, (F.col("close") / then - 1) * 100))
    last = lambda c: F.max_by(c, "bar_idx").alias(c)
    return d.groupBy(*SERIES).agg(last("d1"), last("d7"), last("d30"), F.greatest(F.lit(0.0), F.max("_r")).alias("runup"), F.count(F.lit(1)).alias("bars"), F.max_by("close", "bar_idx").alias("price"))


def pre_state(bars: DataFrame, day: int = 24, pre: int = 48, week: int = 168, lag: int = 0, tag: str = "") -> DataFrame:
    """Each bar with the window of `pre` bars before it, as seen `lag` bars earlier: ranges (and those a week before),
    volume ratio, position, trends, fall from the high, rising bars.  tag ends the columns' names."""
    w, n = ind.w, lambda c: f"{c}{tag}"
    prev = ind.back("close", 1 + lag)
    rng = lambda a, b: (F.max("high").over(w(a, b)), F.min("low").over(w(a, b)))
    h, lo = rng(-pre - lag, -1 - lag)
    bh, bl = rng(-pre - week - lag, -1 - week - lag)
    i = F.col("bar_idx")
    enough = lambda k, x: F.when(i >= k + lag, x)
    d = bars.withColumn("_up", (F.col("close") > ind.back("close", 1)).cast("int"))
    d = d.withColumn(n("range_pct"), F.when(lo > 0, (h / lo - 1) * 100)).withColumn(n("base_range"), enough(pre + week, F.when(bl > 0, (bh / bl - 1) * 100)))
    base_volume = enough(pre + week, F.avg("quote_volume").over(w(-pre - week - lag, -1 - pre - lag)))
    d = d.withColumn(n("volume_ratio"), F.when(base_volume > 0, F.avg("quote_volume").over(w(-pre - lag, -1 - lag)) / base_volume))
    d = d.withColumn(n("position"), F.when(h > lo, (prev - lo) / (h - lo) * 100))
    for name, k in (("r14", 14 * day), ("r30", 30 * day)):
        then = ind.back("close", k + lag)
        d = d.withColumn(n(name), F.when(then > 0, (prev / then - 1) * 100))
    top = F.max("high").over(ind.o().rowsBetween(Window.unboundedPreceding, -1 - lag))
    d = d.withColumn(n("from_high"), F.when(top > 0, (prev / top - 1) * 100)).withColumn(n("up_bars"), F.sum("_up").over(w(-pre - lag, -1 - lag))).drop("_up")
    return d.withColumn(n("compress"), F.when(F.col(n("base_range")) > 0, F.col(n("range_pct")) / F.col(n("base_range"))))


def pre_move(bars: DataFrame, day: int = 24, pre: int = 48, week: int = 168, lag: int = 0) -> DataFrame:
    """The pre_state() of each series' best change over `day` bars (ties: the first; `pre` bars must come before, and
    `day` bars after it and one more)."""
    i, c = F.col("bar_idx"), F.col("close")
    n = F.count(F.lit(1)).over(Window.partitionBy(*SERIES))
    d = pre_state(bars, day, pre, week, lag)
    d = d.withColumn("move", F.when((i >= pre + lag) & (i < n - day) & (c > 0), (F.lead("close", day).over(ind.o()) / c - 1) * 100))
    seen = F.struct("move", "open_time_ms", "range_pct", "base_range", "volume_ratio", "position", "r14", "r30", "from_high", "up_bars", "compress")
    best = F.max_by(seen, F.when(F.col("move").isNotNull(), F.struct("move", (-i).alias("first"))))
    return d.groupBy(*SERIES).agg(best.alias("b")).where("b is not null").select(*SERIES, "b.*")


#: Conditions in a word of a bitmap.
WORD = 62


def bitmaps(rows: DataFrame, atoms: dict[str, Column]) -> DataFrame:
    """n and hits of each combination of conditions that occurs: bits, words with a bit for each atom in their order.
    One pass over the rows; a condition on a missing value doesn't hold."""
    held = [F.when(F.coalesce(c, F.lit(False)), F.lit(1 << (k % WORD)).cast("long")).otherwise(F.lit(0).cast("long")) for k, c in enumerate(atoms.values())]
    words = [sum(held[k + 1 : k + WORD], held[k]) for k in range(0, len(held), WORD)]
    return rows.select(F.array(*words).alias("bits"), "hit").groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("h"))


def _lifted(found: DataFrame, counts: DataFrame, *by: str, least: int) -> DataFrame:
    """by, n, rate (%), lift of groups (by, n, h) against all rows of counts (n, h)."""
    base = counts.agg(F.sum("n").alias("all_n"), F.sum("h").alias("all_h"))
    out = found.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("h").alias("h")).where(F.col("n") >= least).join(F.broadcast(base))
    rate = div(F.col("h"), F.col("n"))
    return out.select(*by, "n", (rate * 100).alias("rate"), div(rate, div(F.col("all_h"), F.col("all_n"))).alias("lift"))


def mask_lifts(rows: DataFrame, atoms: dict[str, Column], named: dict[str, tuple[str, ...]], least: int = 8) -> DataFrame:
    """predicate, n, rate, lift of each atom and of each named conjunction of atoms that hold for at least `least` rows.
    Rows are read once; the conjunctions are tested on the distinct bitmaps."""
    place = {k: i for i, k in enumerate(atoms)}
    masks = []
    for name, parts in ({k: (k,) for k in atoms} | named).items():
        words = [sum(1 << (place[p] % WORD) for p in parts if place[p] // WORD == w) for w in range(-(-len(atoms) // WORD))]
        masks.append(F.struct(F.lit(name).alias("predicate"), F.array(*[F.lit(x).cast("long") for x in words]).alias("mask")))
    counts = cut(bitmaps(rows, atoms))
    holds = lambda m: F.forall(F.zip_with(m["mask"], F.col("bits"), lambda a, b: a.bitwiseAND(b) == a), lambda x: x)
    found = counts.select("n", "h", F.explode(F.filter(F.array(*masks), holds)).alias("m")).select("n", "h", "m.predicate")
    return _lifted(found, counts, "predicate", least=least)


def pair_lifts(rows: DataFrame, atoms: dict[str, Column], least: int = 30) -> DataFrame:
    """a < b, n, rate, lift of every two atoms that hold together for at least `least` rows.  A bitmap gives at most as
    many pairs as there are of atoms, however many rows it stands for."""
    counts = cut(bitmaps(rows, atoms))
    bit = lambda k: F.col("bits")[k // WORD].bitwiseAND(F.lit(1 << (k % WORD)).cast("long")) != 0
    names = F.array_compact(F.array(*[F.when(bit(k), F.lit(name)) for k, name in enumerate(atoms)]))
    on = counts.select("n", "h", F.array_sort(names).alias("on")).withColumn("a", F.explode("on"))
    both = on.withColumn("b", F.explode(F.filter("on", lambda x: x > F.col("a"))))
    return _lifted(both, counts, "a", "b", least=least)


def window_change(moves: DataFrame, series: DataFrame, before_ms: int, least: int = 10) -> DataFrame:
    """symbol, move_ms, n, change (%, from the first to the last value), mean of a series (symbol, ms, value) in the
    `before_ms` up to each move (symbol, move_ms); change and mean are null with fewer than `least` values.  Joined on
    symbol and on time steps of that length, so a move meets only its two steps."""
    step = lambda c: F.floor(F.col(c) / before_ms)
    m = moves.select("symbol", "move_ms", F.explode(F.sequence(step("move_ms") - 1, step("move_ms"))).alias("step"))
    j = m.join(series.withColumn("step", step("ms")), ["symbol", "step"]).where((F.col("ms") >= F.col("move_ms") - before_ms) & (F.col("ms") <= F.col("move_ms")))
    g = j.groupBy("symbol", "move_ms").agg(F.count(F.lit(1)).alias("n"), F.min_by("value", "ms").alias("a"), F.max_by("value", "ms").alias("b"), F.avg("value").alias("m"))
    ok = F.col("n") >= least
    return moves.select("symbol", "move_ms").join(g, ["symbol", "move_ms"], "left").select("symbol", "move_ms", F.coalesce("n", F.lit(0)).alias("n"), F.when(ok & (F.col("a") > 0), (F.col("b") / F.col("a") - 1) * 100).alias("change"), F.when(ok, F.col("m")).alias("mean"))


def order_statistics(rows: DataFrame, by: list[str], values: list[str], picks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """by, n_<value> and <value>_<pick> of each group: how many values there are (nulls aside), and the one whose rank
    (from 0) is picks[pick](n); null if there is none.  Groups with a null in `by` are left out.

    All groups and columns in one range sort; a value's rank is its place in its partition and how many of its group
    come in those before, so no task holds a group.  Equal values are dealt over partitions by a hash of their rows."""
    each = F.explode(F.array(*[F.struct(F.lit(v).alias("of"), F.col(v).cast("double").alias("x")) for v in values])).alias("v")
    key = [*by, "of"]
    long = rows.dropna(subset=by).select(*by, F.xxhash64(*rows.columns).alias("salt"), each) if by else rows.select(F.xxhash64(*rows.columns).alias("salt"), each)
    long = long.select(*by, "salt", "v.*").where("x is not null").repartitionByRange(*key, "x", "salt").sortWithinPartitions(*key, "x")
    row = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = cut(long.select(*key, "x", F.spark_partition_id().alias("part"), row.alias("row")))
    # a row for each group, column and partition that has some of it
    parts = placed.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("k"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("k").over(Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("before", before).withColumn("n", F.sum("k").over(Window.partitionBy(*key)))
    want = F.explode(F.array(*[F.struct(F.lit(p).alias("pick"), f(F.col("n")).cast("long").alias("rank")) for p, f in picks.items()]))
    at = parts.withColumn("p", want).select(*key, "part", "n", "before", "k", "first", "p.*").where("rank >= before and rank < before + k")
    got = at.withColumn("row", F.col("first") + F.col("rank") - F.col("before")).join(placed, [*key, "part", "row"])
    counts = [F.coalesce(F.max(F.when(F.col("of") == v, F.col("n"))), F.lit(0)).alias(f"n_{v}") for v in values]
    return got.groupBy(*by).agg(*counts, *[F.max(F.when((F.col("of") == v) & (F.col("pick") == p), F.col("x"))).alias(f"{v}_{p}") for v in values for p in picks])


def tiers(rows: DataFrame, by: str, values: list[str]) -> DataFrame:
    """Medians by tier of `by`: 40 and more, 15 and more, the rest; upper_<v> is the upper median (an element)."""
    tier = F.when(F.col(by) >= 40, "40+").when(F.col(by) >= 15, "15-40").otherwise("rest")
    rows = rows.withColumn("tier", tier).select("tier", *values)
    got = order_statistics(rows, ["tier"], values, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)})
    middle = [((F.col(f"{v}_low") + F.col(f"{v}_high")) / 2).alias(f"median_{v}") for v in values]
    return rows.groupBy("tier").agg(F.count(F.lit(1)).alias("n")).join(got, "tier", "left").select("tier", "n", *middle, *[F.col(f"{v}_high").alias(f"upper_{v}") for v in values])


def at_share(p: float) -> Callable[[Column], Column]:
    """The pick of the element at floor(p * n), at most the last."""
    return lambda n: F.least(n - 1, F.floor(n * p))


def nearest_rank(values: str, p: float) -> Column:
    """Aggregate for small groups, whose values fit in an array: the element at floor(p * n) of the sorted values.
    order_statistics() has no such bound."""
    n = F.count(values)
    return F.element_at(F.array_sort(F.collect_list(values)), (F.least(n - 1, F.floor(n * p)) + 1).cast("int"))


def overlaps(rows: DataFrame, a: Column, b: Column) -> DataFrame:
    """both, only_a, only_b."""
    a, b = F.coalesce(a, F.lit(False)), F.coalesce(b, F.lit(False))
    return rows.agg(F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"))
