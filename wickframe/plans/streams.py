"""Queries that replay the events tape as a stream, with state, and their DuckDB SQL.

Bars are cut into slices by the time they arrive, up to two hours after they are over and so out of order, and each
slice is a file of the stream.  A replay runs when its query is asked for, until the last file is read; what it has put
out by then (bars that the watermark has passed) is the result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wickframe.functions import scalar as sc
from wickframe.operators import indicators as ind
from wickframe.operators import control, funnel, replay
from wickframe.plans import more
from wickframe.plans import queries as q
from wickframe.plans import sql as w
from wickframe.sources import bars as src
from wickframe.sources.shared import base, cut
from wickframe.streaming import state, store

LATE_HOURS, SLICES, HIGHER_HOURS = 6, 4, 4
LATE = f"{LATE_HOURS} hours"
#: Entry filters of the replayed trades; prices of the tape are independent draws, so it is choppier than a market.
RULES = state.Rules(cooldown=5, min_gap=8, choppiness=90.0)
#: Stop and target of the logged paper trades, as shares of the entry.
NEAR = (0.5, 2.0)


def streaming_session(spark: SparkSession) -> SparkSession:
    """A session of its own, with the caller's settings and the state store that typed state needs."""
    s = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if k.startswith("spark.sql.") and spark.conf.isModifiable(k):
            s.conf.set(k, v)
    s.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return s


def sliced(rows: DataFrame, by: str, folder: str, slices: int) -> bool:
    """Writes the rows as files of equal spans of `by`, the smaller ones first: the order in which a stream reads them.
    False if there are no rows."""
    rows = cut(rows)
    ends = rows.agg(F.min(by), F.max(by)).first()
    if ends[0] is None:
        return False
    width = (ends[1] - ends[0]) // slices + 1
    for k in range(slices):
        rows.where(F.floor((F.col(by) - ends[0]) / width) == k).coalesce(1).write.mode("append").parquet(folder)
    return True


def replayed(spark: SparkSession, tape: DataFrame, through, schema: str, slices: int = SLICES) -> DataFrame:
    """What `through` (a stream to a stream of that schema) makes of the tape (symbol, ts, at, rank, ...), read in
    slices; of an empty tape, nothing."""
    folder = f"{base(spark)}/wickframe/stream-{uuid.uuid4().hex}"
    arrival = F.col("at") + F.crc32(F.concat_ws(":", "symbol", "rank", "at").cast("binary")) % (2 * src.HOUR_MS)
    if not sliced(tape.withColumn("_arrival", arrival), "_arrival", f"{folder}/in", slices):
        return spark.createDataFrame([], schema)
    s = streaming_session(spark)
    rows = s.readStream.schema(tape.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = through(rows)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")


def tape(b: DataFrame, hours: int, rank: int) -> DataFrame:
    """Bars with the time at which they are over: ts, at; and their rank among rows of one time."""
    at = F.col("open_time_ms") + hours * src.HOUR_MS
    return b.withColumn("at", at).withColumn("ts", F.timestamp_millis("at")).withColumn("rank", F.lit(rank))


def structure(s: SparkSession, d: str) -> DataFrame:
    rows = tape(src.hourly(s, d), 1, 1).select(*state._names(state.BARS))
    got = replayed(s, rows, lambda x: state.structure_stream(x, LATE), state.STRUCTURE)
    zones = [c for c in got.columns if c.startswith(("gap_", "block_"))]
    plain = [c for c in got.columns if c not in zones and c not in ("symbol", "open_time_ms")]
    return got.select("symbol", "open_time_ms", *plain, *[sc.r(c).alias(c) for c in zones])


def higher_bars(s: SparkSession, d: str) -> DataFrame:
    b = ind.ema(src.hourly(s, d, HIGHER_HOURS), "close", 20, "ema")
    return tape(b, HIGHER_HOURS, 0)


def higher(s: SparkSession, d: str) -> DataFrame:
    cols = ("symbol", "ts", "at", "rank", "open_time_ms", "close", "ema")
    fine = tape(src.hourly(s, d), 1, 1).withColumn("ema", F.lit(None).cast("double"))
    rows = fine.select(*cols).unionByName(higher_bars(s, d).select(*cols))
    got = replayed(s, rows, lambda x: state.higher_stream(x, LATE), state.HIGHER)
    return got.select("symbol", "open_time_ms", "higher_open_ms", *[sc.r(c).alias(c) for c in ("close", "higher_close", "higher_ema")])


def signalled(b: DataFrame) -> DataFrame:
    """Hourly bars with the signals that the trade machine reads: with the momentum, a stop half an ATR away, a target three quarters."""
    x = ind.with_volume(ind.with_choppiness(ind.with_atr(ind.with_rsi(b))))
    long = F.col("rsi") < 50
    side = F.when(long, 1.0).otherwise(-1.0)
    x = x.withColumn("long", long).withColumn("passes", F.coalesce((F.col("rsi") <= 49) | (F.col("rsi") >= 51), F.lit(False)) & F.col("atr").isNotNull())
    x = x.withColumn("entry", F.col("close")).withColumn("stop", F.col("close") - side * F.col("atr") * 0.5).withColumn("target", F.col("close") + side * F.col("atr") * 0.75)
    x = x.withColumn("rr", sc.div(F.abs(F.col("target") - F.col("entry")), F.abs(F.col("entry") - F.col("stop"))))
    x = x.withColumn("stage", F.when((F.col("rsi") <= 20) | (F.col("rsi") >= 80), 5).otherwise(3))
    return x.withColumn("rel_volume", F.coalesce("rel_volume_5", "rel_volume"))


SIGNALS = ("high", "low", "close", "ema", "passes", "long", "entry", "stop", "target", "rr", "stage", "choppiness", "rel_volume")


def trade_tape(s: SparkSession, d: str) -> DataFrame:
    keys = ("symbol", "ts", "at", "rank", "open_time_ms")
    fine = tape(signalled(src.hourly(s, d)), 1, 1).withColumn("ema", F.lit(None).cast("double")).select(*keys, *SIGNALS)
    kinds = dict(fine.dtypes)
    coarse = higher_bars(s, d)
    return fine.unionByName(coarse.select(*keys, *[F.col(c) if c in ("high", "low", "close", "ema") else F.lit(None).cast(kinds[c]).alias(c) for c in SIGNALS]))


def trades(s: SparkSession, d: str) -> DataFrame:
    got = replayed(s, trade_tape(s, d), lambda x: state.trade_stream(x, RULES, LATE), state.TRADES)
    return got.select("symbol", "open_time_ms", "event", "long", sc.r("price").alias("price"), sc.r("r").alias("r"))


def paper_store(s: SparkSession, d: str) -> DataFrame:
    """Paper trades as events, in slices of time, merged into a log; what the log holds in the end.  Their stops and
    targets are near, as on this tape those of the plans are hardly ever reached."""
    near = more.paper_log(s, d).withColumn("stop", F.col("entry") * NEAR[0]).withColumn("tp2", F.col("entry") * NEAR[1])
    found = replay.paper_resolved(near, src.daily(s, d).withColumn("close_time_ms", F.col("open_time_ms") + src.DAY_MS - 1), more.FOREVER)
    plan = ("id", "symbol", "entry", "stop", F.col("tp2").alias("target"))
    opens = found.select(F.lit("open").alias("kind"), F.col("at_ms").alias("ms"), *plan, F.lit(None).cast("string").alias("state"))
    closes = found.where("state != 'open'").select(F.lit("close").alias("kind"), (F.col("exit_ms") + src.DAY_MS).alias("ms"), *plan, "state")
    folder = f"{base(s)}/wickframe/paper-{uuid.uuid4().hex}"
    log = store.PaperLog(s, f"{folder}/log")
    sliced(opens.unionByName(closes), "ms", f"{folder}/in", SLICES)
    rows = streaming_session(s).readStream.schema(store.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    query = rows.writeStream.foreachBatch(log.merge).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return log.read().select("id", "symbol", "at_ms", "state", "exit_ms", *[sc.r(c).alias(c) for c in ("entry", "stop", "target")])


def funnel_progress(s: SparkSession, d: str) -> DataFrame:
    """Rows that each phase of the funnel leaves, counted by the jobs that compute them."""
    u, as_of = q.FUNNEL, 900_000_000_000
    tickers = q.tickers_of_lines(s, d)
    named = lambda t: tickers.join(t.select("p_partkey", "symbol"), "p_partkey").drop("p_partkey")
    scan = control.Scan(s)
    scan.run(q.symbols_of_parts(s, d), [
        ("listed", lambda t: t), ("universe", lambda t: funnel.universe(t, u)), ("without majors", lambda t: funnel.without_majors(t, u)),
        ("with tickers", lambda t: funnel.with_tickers(t, named(t), as_of, u)), ("liquid", lambda t: funnel.liquid(t, u)),
    ])
    return s.createDataFrame([(k, name, n) for k, (name, n) in enumerate(scan.progress)], "place int, phase string, rows long")


QUERIES = {"streamed_structure": structure, "streamed_higher": higher, "streamed_trades": trades, "paper_store": paper_store, "funnel_progress": funnel_progress}


# ---------------------------------------------------------------- SQL
HOUR = w.DAY // 24
SEEN = f"open_time_ms + {HOUR} <= {{end}} - {LATE_HOURS * HOUR}"


def _held(x: str, upto: int = 0) -> str:
    return f"last_value({x} ignore nulls) over {w.W(None, upto)}"


def _structure() -> str:
    c = w.Chain(w.hourly(1)).atr()
    pivot = lambda x, f, op: f"case when i >= 10 and lag({x}, 5) over {w.O} {op} {f}({x}) over {w.W(-10, -6)} and lag({x}, 5) over {w.O} {op} {f}({x}) over {w.W(-4)} then lag({x}, 5) over {w.O} end"
    c.add(up=pivot("high", "max", ">"), down=pivot("low", "min", "<"))
    c.add(last_high=_held("up"), last_low=_held("down"), _u=_held("up", -1), _d=_held("down", -1), n_up=f"count(up) over {w.W(None)}", n_down=f"count(down) over {w.W(None)}")
    c.add(hl="case when up is not null and _u is not null then (case when up > _u then 'HH' else 'LH' end) end", ll="case when down is not null and _d is not null then (case when down > _d then 'HL' else 'LL' end) end")
    c.add(last_label=_held("coalesce(ll, hl)"), nh=f"count(hl) over {w.W(None)}", nl=f"count(ll) over {w.W(None)}")
    newest = lambda n, x, v: f"coalesce({n} - max(case when {x} = '{v}' then {n} end) over {w.W(None)} < 15, false)"
    c.add(has_hh=newest("nh", "hl", "HH"), has_hl=newest("nl", "ll", "HL"))
    first = lambda cond, n: f"coalesce({cond}, false) and sum(cast(coalesce({cond}, false) as int)) over {w.W(None, 0, f'symbol, tf, {n}')} = 1"
    c.add(bull=first("close > last_high", "n_up"), bear=first("close < last_low", "n_down"))
    c.add(_e="case when bear then -1 when bull then 1 end").add(_before=f"coalesce({_held('_e', -1)}, 0)")
    c.add(_c="case when bear and bull then true when bear then _before = 1 when bull then _before = -1 end")
    c.add(event="case when bear then 'bearish' when bull then 'bullish' end || case when _c then '_choch' else '_bos' end", direction=f"cast(coalesce({_held('_e')}, 0) as int)", choch=f"coalesce({_held('_c')}, false)")
    for side, wick, level, op, back, f in (("low", "low", "last_low", "<", ">", "min"), ("high", "high", "last_high", ">", "<", "max")):
        at = " ".join(f"when lag({wick}, {k}) over {w.O} {op} {level} and lag(close, {k}) over {w.O} {back} {level} then {k}" for k in range(6, 0, -1))
        c.add(_at=f"case {at} end")
        broken = " ".join(f"when {k} then {f}({wick}) over {w.W(1 - k)} {op} lag({wick}, {k}) over {w.O}" for k in range(1, 7))
        c.add(**{f"{side}_sweep": "_at is not null", f"{side}_sweep_valid": f"coalesce(_at is not null and not (case _at {broken} end) and close {back} {level}, false)"}).step("* exclude (_at)")

    def zone(name: str, there: str, lo: str, hi: str, f: str, x: str, over: str):
        c.add(_z=f"coalesce({there}, false)", _a=lo, _b=hi)
        c.add(_n=f"sum(cast(_z as int)) over {w.W(None)}", _la=_held("case when _z then _a end"), _lb=_held("case when _z then _b end"))
        c.add(_x=f"{f}({x}) over {w.W(None, 0, 'symbol, tf, _n')}")
        c.add(**{f"{name}_low": f"case when _n > 0 and not (_x {over}) then _la end", f"{name}_high": f"case when _n > 0 and not (_x {over}) then _lb end"}).step("* exclude (_z, _a, _b, _n, _la, _lb, _x)")

    h2, l2 = f"lag(high, 2) over {w.O}", f"lag(low, 2) over {w.O}"
    wide = lambda a, b: f"{a} < {b} and {b} - {a} >= atr * 0.05::double and ({b} - {a}) / nullif(({b} + {a}) / 2, 0) * 100 >= 0.15::double"
    zone("gap_bull", wide(h2, "low"), h2, "low", "min", "low", "<= _la")
    zone("gap_bear", wide("high", l2), "high", l2, "max", "high", ">= _lb")
    po, pc, pl, ph = (f"lag({x}) over {w.O}" for x in ("open", "close", "low", "high"))
    zone("block_bull", f"bull and {pc} < {po}", f"least({po}, {pc}, {pl})", f"greatest({po}, {pc}, {ph})", "min", "close", "< _la")
    zone("block_bear", f"bear and {pc} > {po}", f"least({po}, {pc}, {pl})", f"greatest({po}, {pc}, {ph})", "max", "close", "> _lb")
    c.where(SEEN.replace("{end}", f"(select max(open_time_ms) + {HOUR} from d)"))
    plain = ("event", "direction", "choch", "last_label", "has_hh", "has_hl", "low_sweep", "low_sweep_valid", "high_sweep", "high_sweep_valid")
    return c.out(*plain, keys="symbol, open_time_ms", rounded=[f"{z}_{e}" for z in ("gap_bull", "gap_bear", "block_bull", "block_bear") for e in ("low", "high")])


def _two(c: w.Chain) -> tuple[str, str]:
    """The chain with bars of the higher interval beside its own: their name, and when the last of all bars is over."""
    four = w.hourly(HIGHER_HOURS).replace("r as (", "r4 as (", 1).replace("from r group", "from r4 group").replace("d as (", "d4 as (", 1)
    c.parts.insert(1, four)
    fine = c.top
    c.raw("select *, cast(row_number() over (partition by symbol, tf order by open_time_ms) - 1 as bigint) as i from d4").ema("close", 20, "ema")
    c.raw(f"select symbol, open_time_ms as higher_open_ms, open_time_ms + {HIGHER_HOURS * HOUR} as over_ms, close as higher_close, ema as higher_ema from {{t}}")
    coarse = c.top
    c.raw(f"select b.*, h.* exclude (symbol, over_ms) from {fine} b asof left join {coarse} h on h.symbol = b.symbol and h.over_ms <= b.open_time_ms + {HOUR}")
    return coarse, f"greatest((select max(open_time_ms) + {HOUR} from d), (select max(over_ms) from {coarse}))"


def _higher() -> str:
    c = w.Chain(w.hourly(1))
    _, end = _two(c)
    return c.where(SEEN.replace("{end}", end)).out("higher_open_ms", keys="symbol, open_time_ms", rounded=("close", "higher_close", "higher_ema"))


def _trades() -> str:
    c = w.Chain(w.hourly(1)).rsi().atr().volume()
    c.add(choppiness=f"case when i >= 14 then (case when max(high) over {w.W(-13)} > min(low) over {w.W(-13)} and sum(tr) over {w.W(-13)} > 0 then log10(sum(tr) over {w.W(-13)} / (max(high) over {w.W(-13)} - min(low) over {w.W(-13)})) * 100 / log10(14) end) end")
    c.add(long="rsi < 50", rv="coalesce(rel_volume_5, rel_volume)", side="case when rsi < 50 then 1 else -1 end")
    c.add(entry="close", stop="close - side * atr * 0.5::double", target="close + side * atr * 0.75::double")
    _, end = _two(c)
    trend = "coalesce(case when long then higher_close > higher_ema else higher_close < higher_ema end, false)"
    c.add(ok=f"coalesce((rsi <= 49 or rsi >= 51) and not (rsi <= 20 or rsi >= 80) and abs(target - entry) / nullif(abs(entry - stop), 0) >= {RULES.min_rr} and {trend} and coalesce(choppiness, 0) <= {RULES.choppiness} and coalesce(rv, 1) >= {RULES.rel_volume}, false)")
    c.where(SEEN.replace("{end}", end))
    sig = c.top
    null = "cast(null as double)"
    move = f"""select s.symbol, s.i, s.open_time_ms, s.high, s.low, s.ok, s.long as s_long, s.entry as s_entry, s.stop as s_stop, s.target as s_target, m.long, m.entry, m.stop, m.target, m.last_stop, m.last_entry,
      m.long is not null as inside, m.long is null and s.ok and (m.last_stop is null or s.i - m.last_stop > {RULES.cooldown}) and (m.last_entry is null or s.i - m.last_entry >= {RULES.min_gap}) as enters,
      coalesce(case when m.long then s.low <= m.stop else s.high >= m.stop end, false) as stopped, coalesce(case when m.long then s.high >= m.target else s.low <= m.target end, false) as hit
      from m join {sig} s on s.symbol = m.symbol and s.i = m.i + 1"""
    c.parts.append(f"""m as (
    select distinct symbol, cast(-1 as bigint) as i, cast(null as bigint) as open_time_ms, cast(null as varchar) as event, cast(null as boolean) as was_long, {null} as price, {null} as r,
      cast(null as boolean) as long, {null} as entry, {null} as stop, {null} as target, cast(null as bigint) as last_stop, cast(null as bigint) as last_entry from {sig}
    union all
    select symbol, i, open_time_ms, case when enters then 'enter' when inside and stopped then 'stop' when inside and hit then 'target' end, case when enters then s_long else long end,
      case when enters then s_entry when stopped then stop else target end, case when enters then 0 else ((case when stopped then stop else target end) - entry) / nullif(entry - stop, 0) end,
      case when enters then s_long when inside and not stopped and not hit then long end, case when enters then s_entry when inside and not stopped and not hit then entry end,
      case when enters then s_stop when inside and not stopped and not hit then stop end, case when enters then s_target when inside and not stopped and not hit then target end,
      case when inside and stopped then i else last_stop end, case when enters then i else last_entry end
    from ({move}))""")
    c.top = "m"
    c.where("event is not null")
    return c.out("event", "was_long as long", keys="symbol, open_time_ms", rounded=("price", "r")).replace("with ", "with recursive ", 1)


def _store() -> str:
    c = more._paper(f"entry * {NEAR[0]}::double", f"entry * {NEAR[1]}::double")
    t = c.add(over_ms=f"case when state <> 'open' then exit_ms + {w.DAY} end").top
    c.parts.append(f"""p as (
    select symbol, min({{'at': at_ms, 'id': id}}) as k from {t} group by 1
    union all
    select p.symbol, min({{'at': n.at_ms, 'id': n.id}}) from p join {t} x on x.id = p.k.id join {t} n on n.symbol = p.symbol and n.at_ms >= x.over_ms group by 1)""")
    c.top = f"{t} where id in (select k.id from p)"
    return c.out("symbol", "at_ms", "state", "over_ms as exit_ms", f"{w.R('entry')} as entry", f"{w.R('stop')} as stop", f"{w.R('tp2')} as target", keys="id").replace("with ", "with recursive ", 1)


def _progress() -> str:
    counts = [
        ("listed", "select count(*) from part"), ("universe", "select count(*) from u"),
        ("without majors", "select count(*) from u where base_asset <> 'BTC'"), ("with tickers", "select count(*) from x"),
        ("liquid", "select least(50, count(*)) from x where px >= 0.0001::double and qv >= 500000 and n >= 20")]
    arms = " union all ".join(f"select cast({k} as int) as place, '{name}' as phase, ({sql}) as rows" for k, (name, sql) in enumerate(counts))
    tickers = "t as (select l_partkey as p_partkey, round(sum(l_extendedprice), 2) as qv, count(*) as n, max(l_extendedprice / l_quantity) as px from lineitem group by 1)"
    joined = "x as (select a.symbol, t.qv, t.n, t.px from u a join u b on a.symbol = b.symbol join t on t.p_partkey = b.p_partkey where a.base_asset <> 'BTC')"
    return f"{w.UNIVERSE}, {tickers}, {joined} {arms}"


ORACLE_SQL = {"streamed_structure": _structure(), "streamed_higher": _higher(), "streamed_trades": _trades(), "paper_store": _store(), "funnel_progress": _progress()}
