"""From the symbol universe to candidates: filters, the ticker join, tops, and the final view."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wickframe.config import Config
from wickframe.functions.scalar import new_listing
from wickframe.operators import indicators as ind


def universe(symbols: DataFrame, cfg: Config) -> DataFrame:
    """Perpetual contracts against USDT that trade, without stable bases and leveraged tokens."""
    u = cfg.universe
    open_ = (F.col("contract_type") == "PERPETUAL") & (F.col("quote_asset") == "USDT") & (F.col("status") == "TRADING")
    return symbols.where(open_ & ~F.col("base_asset").isin(*u.stable_bases) & ~F.col("symbol").rlike(u.leveraged))


def without_majors(df: DataFrame, cfg: Config) -> DataFrame:
    return df.where(~F.col("base_asset").isin(*cfg.universe.majors))


def with_tickers(symbols: DataFrame, tickers: DataFrame, as_of_ms: int, cfg: Config) -> DataFrame:
    """Inner join on symbol; ticker numbers may be strings; new_listing by the age at as_of_ms."""
    num = [F.expr(f"try_cast({c} as double)").alias(c) for c in tickers.columns if c != "symbol"]
    joined = symbols.join(tickers.select("symbol", *num), "symbol")
    return joined.withColumn("new_listing", new_listing(F.col("onboard_date_ms"), F.lit(as_of_ms), cfg.universe.new_listing_days))


def liquid(joined: DataFrame, cfg: Config, min_quote_volume: float | None = None, top: int | None = None) -> DataFrame:
    """Traded enough; the first `top` by turnover (ties by symbol)."""
    u = cfg.universe
    enough = (F.col("last_price") >= u.min_price) & (F.col("quote_volume") >= (min_quote_volume or u.min_quote_volume)) & (F.col("count") >= u.min_trades)
    return joined.where(enough).orderBy(F.desc("quote_volume"), "symbol").limit(top or u.top)


def stage3(bars: DataFrame, cfg: Config) -> DataFrame:
    """Quick metrics of every bar, and whether it is a long or a short candidate (30 bars must be there)."""
    c = cfg.candidate
    d = ind.with_volume(ind.with_rsi(ind.with_changes(bars)))
    dropped = (F.col("change_6") <= c.drop_6h) | (F.col("change_24") <= c.drop_24h) | (F.col("near_low") <= c.near_low)
    long = (F.col("change_24") <= c.surge_24h_exclude) & dropped & (F.col("change_6") <= c.counter_6h) & (F.col("rsi") <= c.rsi_long_max)
    surged = (F.col("change_6") >= c.surge_6h) | (F.col("near_high") <= c.near_high)
    short = (F.col("change_24") >= c.crash_24h_exclude) & surged & (F.col("change_6") >= -c.counter_6h) & (F.col("rsi") >= c.rsi_short_min)
    there = F.col("bar_idx") >= c.min_bars - 1
    return d.withColumn("long", F.coalesce(there & long, F.lit(False))).withColumn("short", F.coalesce(there & short, F.lit(False)))


def candidates(d: DataFrame, cfg: Config, direction: str = "both") -> DataFrame:
    """Passing rows of stage3 with the direction they hint at, largest 6-bar move first, at most `keep`."""
    want = {"long": F.col("long"), "short": F.col("short"), "both": F.col("long") | F.col("short")}[direction]
    long, short = F.col("long") & (direction != "short"), F.col("short") & (direction != "long")
    hint = F.when(long & ~short, "long").when(short & ~long, "short").otherwise(direction)
    return d.where(want).withColumn("hint", hint).orderBy(F.desc(F.abs("change_6")), "symbol", "bar_idx").limit(cfg.candidate.keep)


def most_traded(d: DataFrame, keep: int = 50) -> DataFrame:
    """Rows by turnover, at most `keep`: what the early mode looks at closely."""
    return d.orderBy(F.desc("quote_volume"), "symbol", "bar_idx").limit(keep)


def ranked(results: DataFrame, by: str = "score", within: tuple = ()) -> DataFrame:
    """rank from 1, highest first, ties by symbol; only filtered results should come here if `within` is empty."""
    order = Window.partitionBy(*within).orderBy(F.desc(by), "symbol")
    return results.withColumn("rank", F.row_number().over(order))


def view(results: DataFrame, cfg: Config, early: bool = False, min_score: int = 30, direction: str = "both", favourites: list | None = None, hide_new: bool = True, only_golden: bool = False, near_ema200: bool = False, hide_noisy: bool = True, excluded: list | None = None, stage: int | None = None, sort: str = "score") -> DataFrame:
    """What is shown: ten predicates, then the best few by score, then the user's order, then ranks."""
    d = results
    if not early and direction != "both":
        d = d.where(F.col("direction") == direction)
    d = d.where(F.col("score") >= (cfg.early.min_score if early else min_score))
    if favourites:
        d = d.where(F.col("symbol").isin(*favourites))
    d = d.where(F.coalesce(F.col("stage") != 5, F.lit(True)))
    if hide_new:
        d = d.where(~F.coalesce("new_listing", F.lit(False)))
    if only_golden:
        d = d.where("golden_cross")
    if near_ema200:
        d = d.where("near_ema200")
    if not early and hide_noisy:
        d = d.where("not noisy")
    if excluded:
        d = d.where(~F.col("symbol").isin(*excluded))
    if stage is not None:
        d = d.where(F.col("stage") == stage)
    d = d.orderBy(F.desc("score"), "symbol").limit(cfg.early.keep_top if early else cfg.reversal.keep_top)
    order = {"score": [F.desc("score")], "change": [F.asc("change_6h")], "volume": [F.desc("quote_volume")]}[sort]
    return d.withColumn("rank", F.row_number().over(Window.orderBy(*order, "symbol")))


def visible_peers(view_rows: DataFrame, peers: DataFrame) -> DataFrame:
    """Correlated peers (symbol, peer, r) that are themselves shown: their number, the two closest, the highest r."""
    shown = view_rows.select("symbol")
    both = peers.join(shown, "symbol", "left_semi").join(shown.withColumnRenamed("symbol", "peer"), "peer", "left_semi")
    best = F.array_sort(F.collect_list(F.struct((-F.col("r")).alias("k"), "peer")))
    got = both.groupBy("symbol").agg(F.count(F.lit(1)).alias("n_peers"), F.slice(F.transform(best, lambda x: x["peer"]), 1, 2).alias("closest"), F.max("r").alias("top_r"))
    return view_rows.join(got, "symbol", "left").fillna(0, ["n_peers"])
