"""Indicators as window columns over bars (symbol, tf, bar_idx, ...): every interval and symbol in one pass.

Values are null during warm-up.  Nothing looks ahead.  Recursive averages use the closed form of their recursion, in
blocks that are long enough for what came before the last block to have vanished, so they neither overflow nor need
a row-by-row loop.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wickframe.functions.scalar import div

SERIES = ("symbol", "tf")


def o():
    return Window.partitionBy(*SERIES).orderBy("bar_idx")


def w(a: int, b: int = 0):
    """From a to b bars relative to the current one."""
    return o().rowsBetween(a, b)


def past():
    return o().rowsBetween(Window.unboundedPreceding, 0)


def back(c: str, k: int) -> Column:
    return F.lag(c, k).over(o())


def full(k: int, value: Column) -> Column:
    """value once k bars are there."""
    return F.when(F.col("bar_idx") >= k - 1, value)


def sma(c: str, p: int) -> Column:
    return full(p, F.avg(c).over(w(1 - p)))


def smooth(df: DataFrame, value: Column, since: Column, alpha: float, out: str) -> DataFrame:
    """E = value at since = 0, then E = alpha * value + (1 - alpha) * E; null where since < 0.  since counts bars."""
    q = 1 - alpha
    block = int(600 / math.log(1 / q))
    df = df.withColumn("_k", since).withColumn("_y", F.when(F.col("_k") == 0, value).when(F.col("_k") > 0, value * alpha))
    df = df.withColumn("_b", F.floor(F.col("_k") / block)).withColumn("_j", F.col("_k") - F.col("_b") * block)
    inside = Window.partitionBy(*SERIES, "_b").orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_e", F.pow(F.lit(q), F.col("_j")) * F.sum(F.when(F.col("_k") >= 0, F.col("_y") * F.pow(F.lit(q), -F.col("_j")))).over(inside))
    ends = F.last(F.when(F.col("_j") == block - 1, F.col("_e")), ignorenulls=True).over(o().rowsBetween(Window.unboundedPreceding, -1))
    carried = F.when(F.col("_b") > 0, F.pow(F.lit(q), F.col("_j") + 1) * ends).otherwise(0.0)
    return df.withColumn(out, F.when(F.col("_k") >= 0, F.col("_e") + carried)).drop("_k", "_y", "_b", "_j", "_e")


def ema(df: DataFrame, c: str, p: int, out: str, first: int = 0) -> DataFrame:
    """Seeded with the mean of the first p values; first: the bar that has the first value."""
    seed = first + p - 1
    value = F.when(F.col("bar_idx") == seed, F.avg(c).over(w(1 - p))).otherwise(F.col(c))
    return smooth(df, value, F.col("bar_idx") - seed, 2 / (p + 1), out)


def wilder(df: DataFrame, c: str, p: int, out: str) -> DataFrame:
    """Seeded at bar p with the mean of bars 1 to p."""
    value = F.when(F.col("bar_idx") == p, F.avg(c).over(w(1 - p))).otherwise(F.col(c))
    return smooth(df, value, F.col("bar_idx") - p, 1 / p, out)


def with_true_range(df: DataFrame) -> DataFrame:
    before = back("close", 1)
    wide = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return df.withColumn("tr", F.when(F.col("bar_idx") == 0, F.col("high") - F.col("low")).otherwise(wide))


def with_rsi(df: DataFrame, p: int = 14, out: str = "rsi") -> DataFrame:
    """100 where nothing has fallen, flat series included."""
    step = F.col("close") - back("close", 1)
    df = df.withColumn("_up", F.greatest(step, F.lit(0.0))).withColumn("_down", F.greatest(-step, F.lit(0.0)))
    df = wilder(wilder(df, "_up", p, "_gain"), "_down", p, "_loss")
    return df.withColumn(out, F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + div(F.col("_gain"), F.col("_loss"))))).drop("_up", "_down", "_gain", "_loss")


def with_atr(df: DataFrame, p: int = 14, out: str = "atr") -> DataFrame:
    df = df if "tr" in df.columns else with_true_range(df)
    return wilder(df, "tr", p, out)


def with_macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    df = ema(ema(df, "close", fast, "_fast"), "close", slow, "_slow").withColumn("macd", F.col("_fast") - F.col("_slow"))
    df = ema(df, "macd", signal, "macd_signal", first=slow - 1)
    return df.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def with_bollinger(df: DataFrame, p: int = 20, mult: float = 2.0) -> DataFrame:
    sd = full(p, F.stddev_pop("close").over(w(1 - p)))
    df = df.withColumn("bb_mid", sma("close", p)).withColumn("_sd", sd)
    df = df.withColumn("bb_upper", F.col("bb_mid") + F.col("_sd") * mult).withColumn("bb_lower", F.col("bb_mid") - F.col("_sd") * mult)
    return df.withColumn("bb_width", div(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_mid"))).drop("_sd")


def with_vwap(df: DataFrame) -> DataFrame:
    """Starts anew each UTC day; null while nothing was traded."""
    day = Window.partitionBy(*SERIES, F.floor(F.col("open_time_ms") / 86_400_000)).orderBy("bar_idx").rowsBetween(Window.unboundedPreceding, 0)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return df.withColumn("vwap", div(F.sum(typical * F.col("volume")).over(day), F.sum("volume").over(day)))


def with_obv(df: DataFrame) -> DataFrame:
    signed = F.when(F.col("bar_idx") == 0, 0.0).otherwise(F.signum(F.col("close") - back("close", 1)) * F.col("volume"))
    return df.withColumn("_s", signed).withColumn("obv", F.sum("_s").over(past())).drop("_s")


def with_stoch_rsi(df: DataFrame, rsi_p: int = 14, stoch_p: int = 14, k: int = 3, d: int = 3) -> DataFrame:
    df = df if "rsi" in df.columns else with_rsi(df, rsi_p)
    first = rsi_p + stoch_p
    lo, hi = F.min("rsi").over(w(1 - stoch_p)), F.max("rsi").over(w(1 - stoch_p))
    raw = F.when(F.col("bar_idx") >= first, F.when(hi == lo, 0.0).otherwise(div(F.col("rsi") - lo, hi - lo) * 100))
    df = df.withColumn("_raw", raw).withColumn("stoch_k", full(first + k, F.avg("_raw").over(w(1 - k))))
    return df.withColumn("stoch_d", full(first + k + d - 1, F.avg("stoch_k").over(w(1 - d)))).drop("_raw")


def with_volume(df: DataFrame, p: int = 20) -> DataFrame:
    """avg_volume, rel_volume (the bar itself is in the mean), rel_volume_5 (mean of the last five that are there),
    rel_volume_3 (0 if there is none), surge, fade."""
    df = df.withColumn("avg_volume", sma("volume", p))
    df = df.withColumn("rel_volume", F.when(F.col("avg_volume") > 0, div(F.col("volume"), F.col("avg_volume"))))
    df = df.withColumn("rel_volume_5", F.avg("rel_volume").over(w(-4))).withColumn("rel_volume_3", F.coalesce(F.avg("rel_volume").over(w(-2)), F.lit(0.0)))
    return df.withColumn("surge", F.coalesce(F.col("rel_volume_5") >= 1.6, F.lit(False))).withColumn("fade", F.coalesce(F.col("rel_volume_5") <= 0.6, F.lit(False)))


def with_cvd(df: DataFrame, lookback: int = 10) -> DataFrame:
    """delta, cvd, and cvd_slope over the lookback (0 if the series is shorter)."""
    df = df.withColumn("delta", F.col("taker_buy_base") - F.col("taker_sell_base")).withColumn("cvd", F.sum("delta").over(past()))
    return df.withColumn("cvd_slope", F.when(F.col("bar_idx") >= lookback, F.col("cvd") - back("cvd", lookback)).otherwise(0.0))


def with_squeeze(df: DataFrame, lookback: int = 100) -> DataFrame:
    """Share of the last `lookback` band widths that are smaller than this one, in per cent.  Needs bb_width."""
    recent = F.collect_list("bb_width").over(w(1 - lookback))
    df = df.withColumn("_w", recent)
    smaller = F.size(F.filter("_w", lambda x: x < F.col("bb_width")))
    return df.withColumn("squeeze", F.when((F.size("_w") == lookback) & F.col("bb_width").isNotNull(), smaller * 100.0 / lookback)).drop("_w")


def with_choppiness(df: DataFrame, p: int = 14) -> DataFrame:
    df = df if "tr" in df.columns else with_true_range(df)
    total, wide = F.sum("tr").over(w(1 - p)), F.max("high").over(w(1 - p)) - F.min("low").over(w(1 - p))
    return df.withColumn("choppiness", full(p + 1, F.when((wide > 0) & (total > 0), F.log10(div(total, wide)) * 100 / math.log10(p))))


def with_box(df: DataFrame, p: int = 60) -> DataFrame:
    """The last p bars' high and low, their distance in per cent of the middle, and where the close lies between."""
    df = df.withColumn("box_high", full(p, F.max("high").over(w(1 - p)))).withColumn("box_low", full(p, F.min("low").over(w(1 - p))))
    mid, wide = (F.col("box_high") + F.col("box_low")) / 2, F.col("box_high") - F.col("box_low")
    df = df.withColumn("box_width", F.when(mid > 0, div(wide, mid) * 100).when(mid.isNotNull(), 0.0))
    return df.withColumn("range_pos", F.when(wide > 0, div(F.col("close") - F.col("box_low"), wide)).when(wide.isNotNull(), 0.0))


def with_breakout(df: DataFrame, p: int = 60) -> DataFrame:
    """Close above the high of the p bars before (of the box itself while there are fewer).  Needs the box."""
    before = F.when(F.col("bar_idx") >= p, F.max("high").over(w(-p, -1)))
    df = df.withColumn("breakout_level", F.coalesce(before, F.col("box_high")))
    df = df.withColumn("breakout", F.coalesce(F.col("close") > F.col("breakout_level"), F.lit(False)))
    return df.withColumn("run_pct", F.when(F.col("breakout_level") > 0, div(F.col("close") - F.col("breakout_level"), F.col("breakout_level")) * 100).when(F.col("breakout_level").isNotNull(), 0.0))


def with_momentum(df: DataFrame, k: int = 84, out: str = "momentum") -> DataFrame:
    then = back("close", k)
    return df.withColumn(out, F.when(then > 0, div(F.col("close") - then, then) * 100))


def with_dry_ratio(df: DataFrame, recent: int = 20, prior: int = 60) -> DataFrame:
    before = F.avg("volume").over(w(1 - recent - prior, -recent))
    return df.withColumn("vol_expand", full(recent + prior, F.when(before > 0, div(F.avg("volume").over(w(1 - recent)), before))))


def with_changes(df: DataFrame) -> DataFrame:
    """change_6, change_24 (against the first bar while there are fewer), and the distances from the low and high of
    24 bars, in per cent."""
    opening = F.first("close").over(past())
    for k in (6, 24):
        then = F.coalesce(back("close", k), opening)
        df = df.withColumn(f"change_{k}", div(F.col("close") - then, then) * 100)
    low, high = F.min("low").over(w(-23)), F.max("high").over(w(-23))
    return df.withColumn("near_low", div(F.col("close") - low, low) * 100).withColumn("near_high", div(high - F.col("close"), high) * 100)


def last_of_series(df: DataFrame) -> DataFrame:
    newest = F.max("bar_idx").over(Window.partitionBy(*SERIES))
    return df.withColumn("_n", newest).where("bar_idx = _n").drop("_n")


def last_valid(df: DataFrame, *cols: str) -> DataFrame:
    """One row for each series: the last value of each column that isn't null."""
    return df.groupBy(*SERIES).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("bar_idx"))).alias(c) for c in cols])
