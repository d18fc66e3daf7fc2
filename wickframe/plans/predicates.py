"""The lift studies' conditions as data, single and together, over the evaluation rows, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickframe.functions import scalar as sc
from wickframe.operators import indicators as ind
from wickframe.operators import early, replay, research
from wickframe.plans import queries as q
from wickframe.plans import sql as w
from wickframe.plans.sql import O, W

LAG = 24
#: A hit: the best change that about half of the tape's rows reach (its prices are independent draws).
HIT = 4500.0
#: Conditions on the state before a move, asked of it now and LAG bars earlier.
STATE = (
    "compress > 3", "compress < 0.5", "volume_ratio > 3", "volume_ratio < 0.6", "position > 80", "position < 20", "r14 > 25", "r14 < -25", "from_high < -30", "from_high > -10",
    "oi > 20", "oi < -10", "fund < -0.03", "fund > 0.02")
#: Conditions that are asked once.
SINGLE = (
    "oi > 30", "from_high < -20", "compress_lag > 2", "compress_lag < 0.7", "volume_ratio_lag > 2", "volume_ratio_lag > 1.5", "volume_ratio_lag < 0.7", "abs(fund_lag) > 0.02", "abs(fund_lag) < 0.006",
    "r14_lag > 40", "r14_lag < -40", "r14_lag >= -40 and r14_lag < -15", "r14_lag >= -15 and r14_lag < 0", "r14_lag >= 0 and r14_lag < 15", "r14_lag >= 15 and r14_lag < 40", "r14_lag >= 40", "r14_lag > -15 and r14_lag < 15", "abs(r14_lag) > 25",
    "age_days < 300", "age_days >= 300 and age_days < 500", "age_days >= 500 and age_days < 800", "age_days >= 800", "age_days < 400", "age_days > 600", "age_days > 800",
    "abs(funding) > 0.0002", "abs(funding) > 0.0006", "abs(funding) < 0.00006", "momentum > 25", "momentum > 60", "momentum < -25", "momentum < -60", "abs(momentum) < 15",
    "vol_expand > 2.5", "vol_expand > 5", "vol_expand < 0.7", "change_24h > 15", "change_24h < -15", "turnover_24h < 1e7", "turnover_24h > 1e8", "score >= 25", "stage = 1", "stage = 2", "stage = 3")
#: Conditions that hold together.
TOGETHER = (
    ("oi > 30", "volume_ratio > 3"), ("compress > 3", "volume_ratio > 3"), ("age_days < 400", "from_high < -20"), ("volume_ratio_lag > 2", "compress_lag > 2"), ("volume_ratio_lag > 2", "from_high_lag < -30"),
    ("age_days < 400", "volume_ratio_lag > 2"), ("age_days < 400", "from_high_lag < -30"), ("compress_lag < 0.7", "volume_ratio_lag < 0.7"), ("age_days < 400", "from_high_lag < -30", "volume_ratio_lag > 1.5"),
    ("abs(fund_lag) > 0.02", "abs(r14_lag) > 25"))


def _lagged(condition: str) -> str:
    column, rest = condition.split(" ", 1)
    return f"{column}_lag {rest}"


ATOMS = (*STATE, *map(_lagged, STATE), *SINGLE)
NAMED = {" and ".join(parts): parts for parts in TOGETHER}


def states(s: SparkSession, d: str) -> DataFrame:
    """The evaluation rows with their states: funding is the mean of the window, in per cent; open interest (summed
    quantity) its change over the window."""
    m = q.labelled(s, d)
    m = m.withColumn("stage", early.stage(q.TAPE)).withColumn("_oi", F.sum("volume").over(ind.past()))
    for tag, lag in (("", 0), ("_lag", LAG)):
        m = research.pre_state(m, lag=lag, tag=tag)
        then, now = ind.back("_oi", 48 + lag), ind.back("_oi", lag) if lag else F.col("_oi")
        m = m.withColumn(f"fund{tag}", F.avg("funding").over(ind.w(-48 - lag, -1 - lag)) * 100).withColumn(f"oi{tag}", F.when(then > 0, (now - then) / then * 100))
    g = replay.grid(m).where("box_high is not null and best_change is not null")
    return g.withColumn("hit", F.col("best_change") >= HIT)


def named(s: SparkSession, d: str) -> DataFrame:
    got = research.mask_lifts(states(s, d), {a: F.expr(a) for a in ATOMS}, NAMED)
    return q.shown(got, "n", "rate", "lift", keys=("predicate",))


def pairs(s: SparkSession, d: str) -> DataFrame:
    got = research.pair_lifts(states(s, d), {a: F.expr(a) for a in ATOMS})
    return q.shown(got, "n", "rate", "lift", keys=("a", "b"))


QUERIES = {"lift_conjunctions": named, "lift_pairs": pairs}


# ---------------------------------------------------------------- SQL
def _states() -> w.Chain:
    c = w.Chain().early().labels()
    c.add(_oi=f"sum(volume) over {W(None)}")
    for tag, lag in (("", 0), ("_lag", LAG)):
        prev = f"lag(close, {1 + lag}) over {O}"
        h, lo, bh, bl = (f"{f}({x}) over {W(a - lag, b - lag)}" for f, x, a, b in (("max", "high", -48, -1), ("min", "low", -48, -1), ("max", "high", -216, -169), ("min", "low", -216, -169)))
        bv = f"avg(quote_volume) over {W(-216 - lag, -49 - lag)}"
        c.add(**{
            f"range_pct{tag}": f"case when {lo} > 0 then ({h} / {lo} - 1) * 100 end", f"base_range{tag}": f"case when i >= {216 + lag} and {bl} > 0 then ({bh} / {bl} - 1) * 100 end",
            f"volume_ratio{tag}": f"case when i >= {216 + lag} and {bv} > 0 then avg(quote_volume) over {W(-48 - lag, -1 - lag)} / {bv} end", f"position{tag}": f"case when {h} > {lo} then ({prev} - {lo}) / ({h} - {lo}) * 100 end",
            f"r14{tag}": f"case when lag(close, {336 + lag}) over {O} > 0 then ({prev} / lag(close, {336 + lag}) over {O} - 1) * 100 end",
            f"from_high{tag}": f"case when max(high) over {W(None, -1 - lag)} > 0 then ({prev} / max(high) over {W(None, -1 - lag)} - 1) * 100 end",
            f"fund{tag}": f"avg(funding) over {W(-48 - lag, -1 - lag)} * 100", f"oi{tag}": f"case when lag(_oi, {48 + lag}) over {O} > 0 then (lag(_oi, {lag}) over {O} - lag(_oi, {48 + lag}) over {O}) / lag(_oi, {48 + lag}) over {O} * 100 end",
        }).add(**{f"compress{tag}": f"case when base_range{tag} > 0 then range_pct{tag} / base_range{tag} end"})
    return c.grid().where("box_high is not null and best_change is not null").add(hit=f"best_change >= {HIT}")


def _named() -> str:
    c = _states()
    rows = c.top
    every = {a: a for a in ATOMS} | {k: " and ".join(f"({p})" for p in v) for k, v in NAMED.items()}
    c.raw(" union all ".join(f"select '{k}' as predicate, count(*) filter ({v}) as n, count(*) filter (({v}) and hit) as h, count(*) as an, count(*) filter (hit) as ah from {rows}" for k, v in every.items()))
    return c.where("n >= 8").add(rate="h / n::double * 100", lift="h / n::double / nullif(ah / an::double, 0)").out("n", keys="predicate", rounded=("rate", "lift"))


def _pairs() -> str:
    c = _states()
    rows = c.top
    held = ", ".join(f"case when {a} then '{a}' end" for a in ATOMS)
    on = c.raw(f"select symbol, i, hit, unnest([x for x in [{held}] if x is not null]) as p from {rows}").top
    c.raw(f"select x.p as a, y.p as b, count(*) as n, count(*) filter (x.hit) as h from {on} x join {on} y on x.symbol = y.symbol and x.i = y.i and x.p < y.p group by 1, 2 having count(*) >= 30")
    base = f"(select count(*) filter (hit) / count(*)::double from {rows})"
    return c.add(rate="h / n::double * 100", lift=f"h / n::double / nullif({base}, 0)").out("n", keys="a, b", rounded=("rate", "lift"))


ORACLE_SQL = {"lift_conjunctions": _named(), "lift_pairs": _pairs()}
