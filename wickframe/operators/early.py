"""Early mode: metrics, stage, score, plan and result of every bar (a live scan keeps the last one)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wickframe.config import Config, Costs
from wickframe.functions.scalar import age_days, div, grade, pct, position_money, r, r0, ramp
from wickframe.operators import indicators as ind
from wickframe.operators.indicators import w


def metrics(bars: DataFrame, cfg: Config, change_bars: int = 6) -> DataFrame:
    """All early metrics as causal window columns.  bars may have onboard_ms; change and turnover over change_bars."""
    e = cfg.early
    d = ind.with_squeeze(ind.with_bollinger(bars), e.squeeze)
    d = ind.with_breakout(ind.with_box(d, e.box), e.box)
    d = ind.with_dry_ratio(ind.with_momentum(ind.with_volume(d), e.momentum_bars), e.vol_recent, e.vol_prior)
    d = ind.with_atr(ind.ema(d, "close", 200, "ema_200"))
    opening = F.first("close").over(ind.past())
    then = F.coalesce(ind.back("close", change_bars), opening)
    d = d.withColumn("change_24h", div(F.col("close") - then, then) * 100).withColumn("turnover_24h", F.sum("quote_volume").over(w(1 - change_bars)))
    d = d.withColumn("atr_rising", F.coalesce(F.col("atr") > ind.back("atr", 5), F.lit(False)))
    d = d.withColumn("above_ema200", F.coalesce(F.col("close") > F.col("ema_200"), F.lit(False))).withColumn("ema200_rising", F.coalesce(F.col("ema_200") >= ind.back("ema_200", 20), F.lit(False)))
    d = d.withColumn("momentum_abs", F.abs("momentum"))
    return d.withColumn("age_days", age_days(F.col("onboard_ms"), F.col("open_time_ms")) if "onboard_ms" in d.columns else F.lit(None).cast("double"))


def excluded(cfg: Config) -> Column:
    return F.coalesce(F.col("change_24h") > cfg.early.pumped, F.lit(False))


def stage(cfg: Config) -> Column:
    """3 breakout, 2 imminent, 1 watch; null for none, or a breakout that has run too far."""
    e = cfg.early
    hits = F.coalesce(F.col("momentum_abs") >= e.dead_zone, F.lit(False)).cast("int") + F.coalesce(F.abs("change_24h") >= e.change_min, F.lit(False)).cast("int")
    broke = F.col("breakout") & (F.col("rel_volume_3") >= e.breakout_rel_vol) & F.col("atr_rising")
    return F.when(broke, F.when(F.col("run_pct") <= e.breakout_max_run, 3)).when(hits >= 2, 2).when(hits == 1, 1)


def with_score(d: DataFrame, cfg: Config) -> DataFrame:
    """got_momentum, got_change, got_fresh (two decimals), thin, score (whole, 0 to 100), grade, hit_rate."""
    e = cfg.early
    fresh = 1 - ramp(F.coalesce("age_days", F.lit(float(e.default_age))), e.fresh_full, e.fresh_zero)
    d = d.withColumn("got_momentum", r(ramp(F.col("momentum_abs"), e.dead_zone, e.momentum_full) * e.weight_momentum, 2))
    d = d.withColumn("got_change", r(ramp(F.abs("change_24h"), e.change_min, e.change_full) * e.weight_change, 2)).withColumn("got_fresh", r(fresh * e.weight_fresh, 2))
    d = d.withColumn("thin", F.coalesce("turnover_24h", F.lit(0.0)) < e.min_quote_volume)
    total = F.col("got_momentum") + F.col("got_change") + F.col("got_fresh") + F.when(F.col("thin"), e.thin).otherwise(0)
    d = d.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), r0(total))).cast("int"))
    return d.withColumn("grade", grade(F.col("score"), e.grades)).withColumn("hit_rate", grade(F.col("score"), e.grades, 2))


def with_plan(d: DataFrame, cfg: Config) -> DataFrame:
    """entry, stop, tp1, tp2, tp3, risk_reward, valid."""
    e, price = cfg.early, F.col("close")
    stop = F.when(F.coalesce("atr", F.lit(0.0)) > 0, price - F.col("atr") * e.stop_atr).otherwise(F.least("box_low", price) - price * 1e-3)
    stop = F.when(stop < price, stop).otherwise(price * (1 - 1e-3))
    d = d.withColumn("entry", price).withColumn("stop", stop)
    risk = F.col("entry") - F.col("stop")
    d = d.withColumn("tp1", F.col("entry") + risk * e.partial_r).withColumn("tp2", F.col("entry") + risk * e.target_r).withColumn("tp3", F.col("entry") + risk * (e.target_r * 1.5))
    d = d.withColumn("risk_reward", div(F.col("tp2") - F.col("entry"), risk))
    return d.withColumn("valid", F.coalesce((F.col("risk_reward") > 0) & (F.col("entry") > F.col("stop")), F.lit(False)))


def results(bars: DataFrame, cfg: Config) -> DataFrame:
    """Bars that the early mode would show: box there, not excluded, in a stage; scored and planned."""
    d = metrics(bars, cfg).where("box_high is not null").where(~excluded(cfg)).withColumn("stage", stage(cfg)).where("stage is not null")
    return with_plan(with_score(d, cfg), cfg)


def prefilter(bars: DataFrame, cfg: Config) -> DataFrame:
    """Bars with a box whose momentum is unknown or outside the dead zone."""
    d = ind.with_dry_ratio(ind.with_momentum(ind.with_box(bars, cfg.early.box), cfg.early.momentum_bars), cfg.early.vol_recent, cfg.early.vol_prior)
    return d.where("box_high is not null").where(F.col("momentum").isNull() | (F.abs("momentum") >= cfg.early.dead_zone))


def with_money(d: DataFrame, seed: float, costs: Costs, leverage: int, share: float = 0.5) -> DataFrame:
    return d.withColumn("money", position_money(F.col("entry"), F.col("stop"), F.col("tp2"), F.col("valid"), seed, costs, leverage, share))


def oi_deltas(oi: DataFrame) -> DataFrame:
    """Changes of open interest in per cent by position: now against 72 and 12 rows back, and 12 against 24; null while
    the rows aren't there or the base isn't positive.  oi: symbol, tf, bar_idx, oi."""
    now, b12, b24, b72 = F.col("oi"), ind.back("oi", 12), ind.back("oi", 24), ind.back("oi", 72)
    return oi.withColumn("change_72", pct(now, b72)).withColumn("change_12", pct(now, b12)).withColumn("before_12", pct(b12, b24))
