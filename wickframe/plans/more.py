"""Reports, joins and tables around the main queries, with their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickframe.functions import scalar as sc
from wickframe.operators import early, funnel, replay, research
from wickframe.operators import indicators as ind
from wickframe.plans import queries as q
from wickframe.plans import sql as w
from wickframe.sources import bars as src
from wickframe.sources import klines
from wickframe.sources.shared import base, cut

FOREVER, SEED, LEVERAGE = 4_102_444_800_000, 1_000_000.0, 3
MODELS = ("A", "D")


def backtest_report(s: SparkSession, d: str) -> DataFrame:
    """All trades, bands of score, and stages."""
    t = replay.report_groups(q.trades(s, d))
    got = replay.trade_report(t, "group", order=("ord", "symbol", "bar_idx"))
    return q.shown(got, "n", "win_pct", "avg_r", "total_r", "profit_factor", "n_target", "n_even", "n_stop", "n_time", "max_drawdown", keys=("group",))


def paper_log(s: SparkSession, d: str) -> DataFrame:
    """Every valid plan on the evaluation grid as a paper trade, noted when its bar was over."""
    g = replay.grid(q.early_results(s, d)).where("valid")
    return g.select(
        F.concat_ws("-", "symbol", F.col("open_time_ms").cast("string")).alias("id"), "symbol", (F.col("open_time_ms") + src.DAY_MS).alias("at_ms"), "entry", "stop", "tp2",
        F.lit(SEED).alias("seed"), F.lit(LEVERAGE).alias("leverage"))


def paper_trades(s: SparkSession, d: str) -> DataFrame:
    got = replay.paper_resolved(paper_log(s, d), src.daily(s, d).withColumn("close_time_ms", F.col("open_time_ms") + src.DAY_MS - 1), FOREVER)
    return q.shown(got, "state", "exit_ms", "r", keys=("id",))


def paper_summary(s: SparkSession, d: str) -> DataFrame:
    got = replay.paper_resolved(paper_log(s, d), src.daily(s, d).withColumn("close_time_ms", F.col("open_time_ms") + src.DAY_MS - 1), FOREVER)
    g = replay.paper_summary(got, "symbol")
    return g.select("symbol", "n", "closed", "wins", sc.r("win_pct").alias("win_pct"), sc.r("total_r").alias("total_r"), sc.r("total_money", 2).alias("total_money"))


def early_candidates(s: SparkSession, d: str) -> DataFrame:
    """The most traded of the bars that pass the first filter of the early mode."""
    b = ind.with_squeeze(ind.with_bollinger(src.daily(s, d)), q.TAPE.early.squeeze)
    return q.shown(funnel.most_traded(early.prefilter(b, q.TAPE)), "squeeze", "momentum", "quote_volume")


def candidate_context(s: SparkSession, d: str) -> DataFrame:
    """Every 4h bar with the last funding rate and the open interest up to its begin, now and 72 hours before."""
    b = src.hourly(s, d, 4).select("symbol", "tf", F.col("open_time_ms").alias("ms"), "close")
    rates = src.table(s, d, "events").select(F.col("event_type").alias("symbol"), src.millis("ts").alias("ms"), F.col("value").alias("rate")).where("rate is not null")
    oi = src.hourly(s, d).select("symbol", F.col("open_time_ms").alias("ms"), F.sum("volume").over(ind.past()).alias("oi"))
    now = replay.as_of(replay.as_of(b, rates), oi, "oi").withColumnRenamed("oi", "oi_now")
    then = now.withColumn("ms", F.col("ms") - 72 * src.HOUR_MS)
    got = replay.as_of(then, oi, "oi").withColumn("ms", F.col("ms") + 72 * src.HOUR_MS)
    change = F.when(F.col("oi") > 0, sc.div(F.col("oi_now") - F.col("oi"), F.col("oi")) * 100)
    return q.shown(got.withColumn("oi_change_72h", change), "close", "rate", "oi_now", "oi_change_72h", keys=("symbol", "tf", "ms"))


def top_gainers(s: SparkSession, d: str) -> DataFrame:
    """period, symbol, runup: the three best rises of each month of 31 bars."""
    b = src.daily(s, d).withColumn("tf", F.concat("tf", F.lit("#"), F.floor(F.col("bar_idx") / 31).cast("string"))).drop("bar_idx", "taker_sell_base")
    r = research.run_up(src.indexed(b)).withColumn("period", F.split_part("tf", F.lit("#"), F.lit(2)).cast("long"))
    return funnel.ranked(r, "runup", ("period",)).where("rank <= 3").select("period", "symbol", "runup", "rank")


def new_gainers(s: SparkSession, d: str) -> DataFrame:
    return q.shown(research.newcomers(top_gainers(s, d), "period"), "rank", "runup", keys=("period", "symbol"))


def lifts_by_year(s: SparkSession, d: str) -> DataFrame:
    r = q.rows(s, d).withColumn("year", F.year(F.timestamp_millis("open_time_ms")))
    got = research.lifts_by(r, {k: F.expr(v) for k, v in q.RULES.items()}, "year")
    return q.shown(got, "n", "rate", "lift", keys=("year", "predicate"))


def model_comparison(s: SparkSession, d: str) -> DataFrame:
    got = research.compared(q.rows(s, d), {m: research.variant(m, 1e6) for m in MODELS})
    return q.shown(got, "n", "rate", "lift", "top_rate", keys=("model",))


def csv_round_trip(s: SparkSession, d: str) -> DataFrame:
    """Run-ups, written as CSV and read again."""
    rows = q.runup(s, d)
    path = f"{base(s)}/wickframe/csv-{uuid.uuid4().hex}"
    src.write_csv(rows, path)
    return src.read_csv(s, path, rows.schema)


def symbol_list(s: SparkSession, d: str) -> DataFrame:
    """Totals of the symbols that a list names (here: those with a letter N), the list being a file of its own."""
    b = src.daily(s, d)
    path = f"{base(s)}/wickframe/list-{uuid.uuid4().hex}"
    src.write_csv(b.where(F.col("symbol").contains("N")).select("symbol").distinct(), path)
    named = b.join(src.read_csv(s, path, "symbol string"), "symbol", "left_semi")
    return named.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.sum("trades").alias("trades"))


#: Models side by side: exit rule, and the least score of the signals that it takes.
EXITS = {"partial": ("partial", 40), "trailing": ("trail", 55)}


def model_trades(s: SparkSession, d: str) -> DataFrame:
    """Two models with exits and trades of their own: statistics of each, and how many of its entries the other shares."""
    e = q.exits(s, d)
    each = []
    for name, (rule, least) in EXITS.items():
        t = e.where(F.col("score") >= least).select("symbol", "tf", "bar_idx", f"{rule}.r", f"{rule}.why", F.col(f"{rule}.k").alias("exit_k"))
        each.append(replay.cooled(t).withColumn("model", F.lit(name)))
    both = cut(each[0].unionByName(each[1]))
    entries = both.groupBy("symbol", "tf", "bar_idx").agg(F.count(F.lit(1)).alias("models"))
    shared = both.join(entries, ["symbol", "tf", "bar_idx"]).groupBy("model").agg(F.count_if(F.col("models") == len(EXITS)).alias("shared"))
    return q.shown(replay.trade_stats(both, "model").join(shared, "model"), "n", "shared", "win_pct", "avg_r", "total_r", "profit_factor", "n_target", "n_even", "n_stop", "n_time", keys=("model",))


#: Bars that must lie behind a row of the feature table.
AHEAD = 85


def feature_table(s: SparkSession, d: str) -> DataFrame:
    """The sixteen columns that the refit and the evaluation read, of every evaluation bar with two weeks behind it."""
    m = q.labelled(s, d).withColumn("_oi", F.sum("volume").over(ind.past()))
    then = ind.back("_oi", 72)
    m = m.withColumn("oi_72", F.when(then > 0, (F.col("_oi") - then) / then * 100)).withColumn("stage", early.stage(q.TAPE))
    shows = ~early.excluded(q.TAPE) & F.col("stage").isNotNull()
    g = replay.grid(m, ahead=AHEAD).where("box_high is not null").withColumn("gate", F.coalesce(shows, F.lit(False)).cast("int"))
    f4 = lambda c: sc.r(c, 4).alias(c)
    return g.select(
        "symbol", "open_time_ms", "gate", F.when(F.col("gate") == 1, F.col("stage")).alias("stage"), "score", sc.r(F.abs("funding"), 6).alias("crowd"), f4("momentum"), f4("vol_expand"), sc.r("age_days", 0).alias("age_days"),
        f4("oi_72"), f4("change_24h"), sc.r("turnover_24h", 0).alias("turnover_24h"), f4("best_change"), f4("peak_7"), f4("peak_14"), f4("trough_7"))


#: What the page query asks for: symbols, and a span of open times.
PAGE_SYMBOLS, PAGE_SPAN = ("AF", "NO", "RO"), (760_000_000_000, 860_000_000_000)


def kline_pages(s: SparkSession, d: str) -> DataFrame:
    """Some symbols' daily bars of some years, read from pages of raw klines; other pages aren't opened."""
    path = f"{base(s)}/wickframe/pages-{uuid.uuid4().hex}"
    klines.write_pages(src.daily(s, d), path, 200)
    klines.register(s)
    pages = s.read.format("kline_pages").option("path", path).option("symbols", ",".join(PAGE_SYMBOLS))
    got = pages.option("from_ms", PAGE_SPAN[0]).option("to_ms", PAGE_SPAN[1]).load()
    return q.shown(got, "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base")


QUERIES = {
    "model_trades": model_trades, "feature_table": feature_table, "kline_pages": kline_pages, "backtest_report": backtest_report, "paper_trades": paper_trades, "paper_summary": paper_summary, "early_candidates": early_candidates, "candidate_context": candidate_context,
    "new_gainers": new_gainers, "lifts_by_year": lifts_by_year, "model_comparison": model_comparison, "csv_round_trip": csv_round_trip, "symbol_list": symbol_list}


# ---------------------------------------------------------------- SQL
def _report() -> str:
    c = w.bt()
    band = "case " + " ".join(f"when score >= {a} and score < {b} then 'score {a}-{b}'" for a, b in ((25, 40), (40, 55), (55, 70), (70, 101))) + " end"
    arms = f"select 'all' as \"group\", 0 as ord, * from {{t}} union all select {band}, score, * from {{t}} where score >= 25 and score < 101 union all select 'stage ' || stage, score, * from {{t}} where stage in (1, 2, 3)"
    c.raw(arms)
    t = c.top
    w.stats(c, '"group"', "partial_r", "partial_why")
    g = c.top
    run = '(partition by "group" order by ord, symbol, i)'
    c.raw(f'select "group", least(0, min(c - p)) as max_drawdown from (select *, greatest(0, max(c) over {run}) as p from (select "group", ord, symbol, i, sum(partial_r) over {run} as c from {t})) group by 1')
    c.raw(f'select g.*, d.max_drawdown from {g} g join {c.top} d using ("group")')
    return w.finished(c, "n", "n_target", "n_even", "n_stop", "n_time", keys='"group"', rounded=("win_pct", "avg_r", "total_r", "profit_factor", "max_drawdown"))


def _paper(stop: str = "stop", target: str = "tp2") -> w.Chain:
    c = w.Chain().results().grid().where("valid")
    c.raw(f"select symbol, symbol || '-' || open_time_ms as id, open_time_ms + {w.DAY} as at_ms, entry, {stop} as stop, {target} as tp2 from {{t}}")
    log = c.top
    c.raw(f"select l.id, min(b.open_time_ms) filter (b.low <= l.stop) as lost, min(b.open_time_ms) filter (b.high >= l.tp2) as won, arg_max(b.close, b.open_time_ms) as mark from {log} l left join t1 b on b.symbol = l.symbol and b.open_time_ms >= l.at_ms group by 1")
    c.raw(f"select l.*, lost, won, mark, lost is not null and (won is null or lost <= won) as is_lost from {log} l join {{t}} using (id)")
    c.add(state="case when is_lost then 'loss' when won is not null then 'win' else 'open' end", exit_ms="case when is_lost then lost else won end")
    return c.add(r="(case state when 'loss' then stop when 'win' then tp2 else coalesce(mark, entry) end - entry) / nullif(entry - stop, 0)")


def _paper_summary() -> str:
    c = _paper()
    c.raw(f"select symbol, count(*) as n, count(*) filter (state <> 'open') as closed, count(*) filter (state = 'win') as wins, count(*) filter (state = 'win') * 100.0::double / nullif(count(*) filter (state <> 'open'), 0) as win_pct, coalesce(sum(r) filter (state <> 'open'), 0) as total_r, coalesce(sum({SEED!r}::double * {LEVERAGE} * ((entry - stop) / nullif(entry, 0)) * r) filter (state <> 'open'), 0) as total_money from {{t}} group by 1")
    return c.out("n", "closed", "wins", f"{w.R('total_money', 2)} as total_money", keys="symbol", rounded=("win_pct", "total_r"))


def _early_candidates() -> str:
    c = w.Chain().bands().add(ws=f"list(bb_width) filter (bb_width is not null) over {w.W(-99)}")
    c.add(squeeze="case when len(ws) = 100 and bb_width is not null then len([x for x in ws if x < bb_width]) * 100.0::double / 100 end")
    c.box().momentum().where("box_high is not null and (momentum is null or abs(momentum) >= 15)")
    return c.where("true order by quote_volume desc, symbol, i limit 50").out(rounded=("squeeze", "momentum", "quote_volume"))


def _context() -> str:
    c = w.Chain(w.hourly(4))
    b = c.top
    one = w.hourly(1).replace("r as (", "r1 as (", 1).replace("from r group", "from r1 group").replace("d as (", "d1 as (", 1)
    c.parts.insert(1, one)
    c.raw(f"select symbol, open_time_ms as ms, sum(volume) over (partition by symbol order by open_time_ms) as oi from d1")
    oi = c.top
    c.raw("select event_type as symbol, epoch_ms(cast(ts as timestamp)) as ms, max(value) as rate from events where value is not null group by 1, 2")
    rate = c.top
    c.raw(f"select b.symbol, b.tf, b.open_time_ms as ms, b.open_time_ms - {72 * w.DAY // 24} as before, b.close, r.rate from {b} b asof left join {rate} r on r.symbol = b.symbol and r.ms <= b.open_time_ms")
    c.raw(f"select b.*, o.oi as oi_now from {{t}} b asof left join {oi} o on o.symbol = b.symbol and o.ms <= b.ms")
    c.raw(f"select b.*, o.oi as oi_then from {{t}} b asof left join {oi} o on o.symbol = b.symbol and o.ms <= b.before")
    return c.add(oi_change_72h="case when oi_then > 0 then (oi_now - oi_then) / oi_then * 100 end").out(keys="symbol, tf, ms", rounded=("close", "rate", "oi_now", "oi_change_72h"))


def _new_gainers() -> str:
    c = w.run_ups().add(period="cast(split_part(tf, '#', 2) as bigint)").add(rank="cast(row_number() over (partition by period order by runup desc, symbol) as int)").where("rank <= 3")
    t = c.top
    return c.where(f"not exists (select 1 from {t} b where b.symbol = {t}.symbol and b.period = {t}.period - 1)").out("rank", keys="period, symbol", rounded=("runup",))


def _lifts_by_year() -> str:
    c = w.Chain().rows().add(year="cast(year(make_timestamp(open_time_ms * 1000)) as int)")
    arm = lambda k, v: f"select year, '{k}' as predicate, count(*) filter ({v}) as n, count(*) filter (({v}) and hit) as h, count(*) as an, count(*) filter (hit) as ah from {c.top} group by 1"
    c.raw(" union all ".join(arm(k, v) for k, v in q.RULES.items()))
    return c.where("n >= 8").add(rate="h / n::double * 100", lift="h / n::double / nullif(ah / an::double, 0)").out("n", keys="year, predicate", rounded=("rate", "lift"))


def _models() -> str:
    c = w.Chain().rows()
    c.raw(" union all ".join(f"select '{m}' as model, day, symbol, hit, {w.variant(*research.VARIANTS[m])} as points from {{t}}" for m in MODELS))
    c.add(nth="row_number() over (partition by model, day order by points desc, symbol)")
    c.raw("select model, count(*) filter (points >= 40) as n, avg(cast(hit as int)) filter (points >= 40) as rate, avg(cast(hit as int)) as base, avg(cast(hit as int)) filter (nth <= 3) as top_rate from {t} group by 1")
    return c.add(lift="rate / nullif(base, 0)").out("n", keys="model", rounded=("rate", "lift", "top_rate"))


def _model_trades() -> str:
    c = w.all_exits()
    signals = c.top
    arms = []
    for name, (rule, least) in EXITS.items():
        c.top = signals
        w.cooled(c.where(f"score >= {least}"), "symbol", f"{rule}_k", f"kept_{rule}")
        arms.append(f"select '{name}' as model, symbol, i, {rule}_r as r, {rule}_why as why from {c.top}")
    both = c.raw(" union all ".join(arms)).top
    g = w.stats(c, "model", "r", "why").top
    c.raw(f"select model, count(*) filter (k = {len(EXITS)}) as shared from (select *, count(*) over (partition by symbol, i) as k from {both}) group by 1")
    c.raw(f"select g.*, x.shared from {g} g join {c.top} x using (model)")
    return w.finished(c, "n", "shared", "n_target", "n_even", "n_stop", "n_time", keys="model", rounded=("win_pct", "avg_r", "total_r", "profit_factor"))


def _feature_table() -> str:
    c = w.Chain().early().labels().add(_oi=f"sum(volume) over {w.W(None)}", n_all=f"count(*) over {w.A}")
    c.add(oi_72=f"case when lag(_oi, 72) over {w.O} > 0 then (_oi - lag(_oi, 72) over {w.O}) / lag(_oi, 72) over {w.O} * 100 end")
    c.where(f"i >= 240 and (i - 240) % 6 = 0 and i < n_all - {AHEAD} and box_high is not null").add(gate="case when not coalesce(change_24h > 40, false) and stage is not null then 1 else 0 end")
    f4 = [f"{w.R(x, 4)} as {x}" for x in ("momentum", "vol_expand", "oi_72", "change_24h", "best_change", "peak_7", "peak_14", "trough_7")]
    return c.out("gate", "case when gate = 1 then stage end as stage", "score", f"{w.R('abs(funding)')} as crowd", f"{w.R('age_days', 0)} as age_days", f"{w.R('turnover_24h', 0)} as turnover_24h", *f4, keys="symbol, open_time_ms")


_PAGED = "symbol in (" + ", ".join(f"'{x}'" for x in PAGE_SYMBOLS) + f") and open_time_ms between {PAGE_SPAN[0]} and {PAGE_SPAN[1]}"
ORACLE_SQL = {
    "model_trades": _model_trades(), "feature_table": _feature_table(), "kline_pages": w.Chain().where(_PAGED).out("trades", rounded=w.PX),
    "backtest_report": _report(), "paper_trades": _paper().out("state", "exit_ms", keys="id", rounded=("r",)), "paper_summary": _paper_summary(), "early_candidates": _early_candidates(), "candidate_context": _context(),
    "new_gainers": _new_gainers(), "lifts_by_year": _lifts_by_year(), "model_comparison": _models(),
    "csv_round_trip": w.run_ups().out("bars", keys="symbol, tf", rounded=("d1", "d7", "d30", "runup", "price")),
    "symbol_list": w.Chain().where("symbol like '%N%'").out("count(*) as bars", "cast(sum(trades) as bigint) as trades", keys="symbol", tail="group by symbol")}
