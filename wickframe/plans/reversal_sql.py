"""DuckDB SQL of the reversal mode: state of four intervals, signals of both sides, score, stage and plan."""

from __future__ import annotations

from wickframe.config import PENALTIES, WEIGHTS, Config, strictness
from wickframe.plans import sql as w
from wickframe.plans.sql import DAY, A, O, R, W

TF = {"4h": "a4", "1h": "a1", "15m": "a15", "5m": "a5"}
CRC = """xor(4294967295, list_reduce(list_concat([4294967295], [cast(ascii(x) as bigint) for x in string_split(symbol, '')]),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))))"""


def stacked() -> str:
    coarse = " union all ".join(
        f"select symbol, '{tf}' as tf, cast(open_time_ms // {days * DAY} * {days * DAY} as bigint) as open_time_ms, {w.COARSE} from d group by 1, 2, 3" for tf, days in (("15m", 7), ("1h", 14), ("4h", 28)))
    return f"{w.DAILY}, s as (select symbol, '5m' as tf, * exclude (symbol, tf) from d union all {coarse})"


def _bars(c: w.Chain) -> None:
    """Every indicator that the snapshot reads, and pivots."""
    c.changes().rsi().atr().volume()
    span = f"(max(high) over {W(-13)} - min(low) over {W(-13)})"
    c.add(choppiness=c.full(15, f"case when {span} > 0 and sum(tr) over {W(-13)} > 0 then log10(sum(tr) over {W(-13)} / {span}) * 100 / log10(14) end"), day=f"open_time_ms // {DAY}")
    c.add(vwap=f"sum((high + low + close) / 3 * volume) over {W(None, 0, 'symbol, tf, day')} / nullif(sum(volume) over {W(None, 0, 'symbol, tf, day')}, 0)")
    c.add(delta="taker_buy_base - taker_sell_base").add(cvd=f"sum(delta) over {W(None)}").add(cvd_slope=f"case when i >= 10 then cvd - lag(cvd, 10) over {O} else 0 end")
    c.ema("close", 20, "ema_20").ema("close", 50, "ema_50").ema("close", 200, "ema_200").with_last_atr().pivots()


def _sweep(c: w.Chain, bars: str, side: str) -> str:
    px, lt, gt = ("low", "<", ">") if side == "low" else ("high", ">", "<")
    c.top = bars
    c.add(pi=f"max(case when pivot_{side} then i end) over {A}").where("pi is not null and n >= 3")
    c.add(lvl=f"max(case when i = pi then {px} end) over {A}", e_close=f"arg_max(close, i) over {A}")
    c.add(si=f"min(case when i > pi and i >= n - 6 and {px} {lt} lvl and close {gt} lvl then i end) over {A}").where("si is not null")
    c.add(sp=f"max(case when i = si then {px} end) over {A}")
    c.raw(f"select symbol, tf, any_value(e_close {gt} lvl) as recovered, bool_or(i > si and {px} {lt} sp) as failed from {{t}} group by 1, 2")
    return c.raw("select symbol, tf, {'recovered': recovered, 'valid': not failed and recovered} as " + f"{side}_sweep from {c.top}").top


def _gaps(c: w.Chain, bars: str) -> str:
    c.top = bars
    c.add(h2=f"lag(high, 2) over {O}", l2=f"lag(low, 2) over {O}").where("h2 < low or l2 > high")
    c.add(side="case when h2 < low then 'bullish' else 'bearish' end", lo="case when h2 < low then h2 else high end", hi="case when h2 < low then low else l2 end")
    c.where("hi - lo >= coalesce(atr_last, 0) * 0.05::double and coalesce((hi - lo) / nullif((hi + lo) / 2, 0) * 100, 0) >= 0.15::double")
    touch = "case when g.side = 'bullish' then b.low <= g.lo else b.high >= g.hi end"
    c.raw(f"select g.symbol, g.tf, g.open_time_ms, g.side, g.lo, g.hi, min(b.i) filter ({touch}) as fi, arg_min(case when g.side = 'bullish' then b.close < g.lo else b.close > g.hi end, b.i) filter ({touch}) as beyond, max(case when g.side = 'bullish' then g.hi - b.low else b.high - g.lo end) as deep from {c.top} g left join {bars} b on b.symbol = g.symbol and b.tf = g.tf and b.i > g.i group by all")
    level = "case when fi is not null then 1 else greatest(coalesce(deep, 0), 0) / (hi - lo) end"
    c.add(status=f"case when coalesce(beyond, false) then 'inverse' when {level} >= 0.99::double then 'filled' when {level} > 0.05::double then 'partial' else 'open' end", mid="(lo + hi) / 2")
    return c.add(live="status in ('open', 'partial')", good="status <> 'filled'").top


def _blocks(c: w.Chain, bars: str, events: str) -> str:
    c.raw(f"select e.symbol, e.tf, e.side, e.i as ev, e.rnk, max(b.i) as k from {events} e join {bars} b on b.symbol = e.symbol and b.tf = e.tf and b.i < e.i and b.i >= e.i - 12 and (case when e.side = 'bullish' then b.close < b.open else b.close > b.open end) group by all")
    c.where("true qualify row_number() over (partition by symbol, tf, side, k order by ev) = 1")
    c.raw(f"select f.symbol, f.tf, b.open_time_ms, f.side, f.k, greatest(b.open, b.close, b.high) as hi, least(b.open, b.close, b.low) as lo from {c.top} f join {bars} b on b.symbol = f.symbol and b.tf = f.tf and b.i = f.k")
    c.add(live=f"not exists (select 1 from {bars} b where b.symbol = {c.top}.symbol and b.tf = {c.top}.tf and b.i > {c.top}.k and (case when {c.top}.side = 'bullish' then b.close < {c.top}.lo else b.close > {c.top}.hi end))", mid="(lo + hi) / 2")
    return c.add(good="live").top


def _picked(c: w.Chain, zones: str, last: str, name: str) -> str:
    z = "{'lo': z.lo, 'hi': z.hi, 'mid': z.mid}"
    cols = []
    for side in ("bullish", "bearish"):
        newest = lambda cond, side=side: f"arg_max({z}, z.open_time_ms) filter (z.side = '{side}' and {cond})"
        cols += [f"coalesce({newest('z.live and p.close >= z.lo and p.close <= z.hi')}, {newest('z.good')}) as {side}_{name}", f"bool_or(z.side = '{side}' and z.good) as has_{side}_{name}"]
    return c.raw(f"select z.symbol, z.tf, {', '.join(cols)} from {zones} z join {last} p on p.symbol = z.symbol and p.tf = z.tf group by 1, 2").top


def _golden(c: w.Chain, bars: str) -> str:
    c.top = bars
    c.add(p50=f"lag(ema_50) over {O}", p200=f"lag(ema_200) over {O}").add(cr=f"max(case when p50 <= p200 and ema_50 > ema_200 and i >= greatest(1, n - 60) then i end) over {A}")
    near = "low <= greatest(ema_50, ema_200) + atr_last * 1.5::double and low >= least(ema_50, ema_200) - atr_last * 1.5::double"
    c.add(imp=f"coalesce(bool_or(close > ema_200 * 1.05::double and i >= cr - 30 and i <= cr) over {A}, false)", held=f"not coalesce(bool_or(close < ema_200 and i >= cr) over {A}, false)", re=f"min(case when i >= cr and {near} and ema_50 is not null and ema_200 is not null then i end) over {A}")
    return c.raw("select symbol, tf, max(n) >= 10 and coalesce(max(atr_last), 0) <> 0 and max(cr) is not null and bool_or(imp) and bool_and(held) and max(re) is not null as detected from {t} group by 1, 2").top


def snapshot(c: w.Chain) -> str:
    """One row for each series of 40 bars or more."""
    _bars(c)
    bars = c.top
    wick = "(case when high = low then 1e-9::double else high - low end)"
    last = c.where("i = n - 1 and i >= 39").add(
        price="close", noise_volume="coalesce(rel_volume_5, rel_volume)", lower_wick=f"(least(open, close) - low) / {wick}", upper_wick=f"(high - greatest(open, close)) / {wick}", close_pos=f"(close - low) / {wick}",
        sell_ratio="case when volume > 0 then taker_sell_base / volume else 0 end", high_volume="coalesce(volume / nullif(avg_volume, 0) >= 1.2::double, false)").top
    c.top = bars
    events = c.events().top
    happened = c.raw("select symbol, tf, arg_max(type, i * 2 + rnk) as last_event from {t} group by 1, 2").top
    c.top = bars
    swings = c.swings().top
    seen = ", ".join(f"bool_or(label = '{x}') as has_{x.lower()}" for x in ("HH", "HL", "LH", "LL"))
    labels = c.raw(f"select symbol, tf, {seen}, arg_max_null(label, i * 2 + rnk) as last_label, arg_max(price, i) filter (kind = 'high') as last_high, arg_max(price, i) filter (kind = 'low') as last_low, list(price) filter (kind = 'high') as highs, list(price) filter (kind = 'low') as lows from {swings} group by 1, 2").top
    by = "partition by symbol, tf, kind order by price, i"
    c.top = swings
    c.add(new=f"case when price - lag(price) over ({by}) <= coalesce(atr_last, 0) * 0.1::double then 0 else 1 end").add(cl=f"sum(new) over ({by} rows unbounded preceding)")
    c.raw("select symbol, tf, kind, avg(price) as price from {t} group by symbol, tf, kind, cl having count(*) >= 2")
    equal = c.raw("select symbol, tf, list(price order by price) filter (kind = 'high') as equal_highs, list(price order by price) filter (kind = 'low') as equal_lows from {t} group by 1, 2").top
    low, high = _sweep(c, bars, "low"), _sweep(c, bars, "high")
    gaps = _picked(c, _gaps(c, bars), last, "gap")
    blocks = _picked(c, _blocks(c, bars, events), last, "block")
    golden = _golden(c, bars)
    joins = " ".join(f"left join {x} using (symbol, tf)" for x in (happened, labels, equal, low, high, gaps, blocks, golden))
    c.raw(f"select * from {last} {joins}")
    return c.add(choch="coalesce(last_event like '%choch', false)", bullish_shift="coalesce(last_event like 'bullish%', false)").top


def _side(side: str) -> dict[str, dict[str, str]]:
    """Columns of one side, in steps: each step reads the ones before."""
    long = side == "long"
    b, sign = ("bullish", 1) if long else ("bearish", -1)
    sweep = "low_sweep" if long else "high_sweep"
    f = lambda x: f"coalesce({x}, false)"
    shift = lambda a: f"{a}.bullish_shift" if long else f"({a}.last_event is not null and not {a}.bullish_shift)"
    turned = lambda a: f(f"{a}.choch and {shift(a)}")
    above = lambda xs, p: f"list_min([x for x in {xs} if x > {p}])"
    below = lambda xs, p: f"list_max([x for x in {xs} if x < {p}])"
    swing = lambda a: f"coalesce(case when {a}.last_low > 0 then ({a}.price - {a}.last_low) / {a}.last_low * 100 end, 0)" if long else f"coalesce(({a}.last_high - {a}.price) / nullif({a}.last_high, 0) * 100, 0)"
    near, far = ("highs", above) if long else ("lows", below)
    moved = f"({'a1.change_6 <= -1.5::double' if long else 'a1.change_6 >= 1.5::double'} or {swing('a1')} <= 8)"
    trend = "a4.price < a4.ema_50 and a4.ema_50 < a4.ema_200 and coalesce(a4.rsi, 50) < 42" if long else "a4.price > a4.ema_50 and a4.ema_50 > a4.ema_200 and coalesce(a4.rsi, 50) > 58"
    lead, pull = ("has_hh", "has_hl") if long else ("has_ll", "has_lh")
    trigger = f("a5.has_hl") if long else f("a5.last_label = 'LH'")
    inside = lambda z: f(f"price >= {z}.lo and price <= {z}.hi")
    op = ("<=", "<") if long else (">=", ">")
    hot = lambda x, hi, lo: f"{x} > {hi}" if long else f"{x} < {lo}"
    one = {
        "price": "a15.price", "atr": "coalesce(case when a15.atr > 0 then a15.atr end, a15.price * 0.01::double)", "gap": f"a15.{b}_gap", "block": f"a15.{b}_block",
        "swing": "coalesce(a15.last_low, a15.last_bar_low)" if long else "coalesce(a15.last_high, a15.last_bar_high)", "target": far(f"a1.{near}", "a1.price"),
        "barrier": above("a1.equal_highs", "a15.price") if long else "[x for x in a1.equal_lows if x < a15.price][1]", "rsi15": "coalesce(a15.rsi, 50)", "rsi5": "coalesce(a5.rsi, 50)"}
    pick = "list_max" if long else "list_min"
    two = {"entry": f"coalesce({pick}([z for z in [gap.mid, block.mid, a1.vwap, a15.ema_20] if z {op[0]} price]), price)", "buffer": "greatest(atr * 0.5::double, price * 0.005::double)"}
    three = {"stop": f"{'least' if long else 'greatest'}(coalesce(swing, price - atr * 2 * {sign}), entry) - buffer * {sign}"}
    four = {f"tp{k + 1}": f"coalesce({lv}, entry + (entry - stop) * {x}::double)" for k, (lv, x) in enumerate(zip((far(f"a15.{near}", "price"), far(f"a1.{near}", "price"), "target"), (1.5, 2.5, 3.5), strict=True))}
    five = {"rr": f"greatest((tp2 - entry) * {sign}, 0) / greatest((entry - stop) * {sign}, 1e-9::double)"}
    six = {
        "valid": f"rr > 0 and (entry - stop) * {sign} > 0", "dropAndOversold": f(f"{moved} and a1.rsi {op[0]} 50"), "goodLiquidity": "quote_volume >= 30000000", "lowSweep": f"a15.{sweep} is not null or a1.{sweep} is not null",
        "lowSweepValid": f(f"a15.{sweep}.valid"), "sweepRecovered": f"{f(f'a15.{sweep}.recovered')} or {f(f'a1.{sweep}.recovered')}", "structureShift1h": f(f"a1.last_event is not null and {shift('a1')}"),
        "choch1h": turned("a1"), "choch15m": turned("a15"), "choch5m": turned("a5"), "fvgObOverlap": f("greatest(gap.lo, block.lo) <= least(gap.hi, block.hi) and gap is not null and block is not null"), "fvgReentry": inside("gap"), "obReentry": inside("block"),
        "fvgCreated": f(f"a15.has_{b}_gap"), "obCreated": f(f"a15.has_{b}_block"), "volumeDeltaShift": f"a15.cvd_slope * {sign} > 0 and {f('a15.rel_volume_5 >= 1')}", "cvdImproved": f"a15.cvd_slope * {sign} > 0", "deltaImproved": f"a15.delta * {sign} > 0",
        "low5mDefended": f(f"a5.{sweep}.recovered"), "entryTrigger5m": f"{turned('a5')} or ({trigger} and {f('a5.rel_volume_5 >= 1.1::double')})", "volumeReSurge": f"{f('a5.rel_volume_5 >= 1.2::double')} or a15.surge", "volumeReacted": f("a15.rel_volume_5 >= 1"),
        "firstHH": f"{f(f'a15.{lead}')} or {f(f'a1.{lead}')}", "firstHL": f"{f(f'a15.{pull}')} or {f(f'a1.{pull}')}", "firstPushDone": f"{f(f'''a15.last_label = '{'HH' if long else 'LL'}' ''')} and {swing('a15')} > 8",
        "overExtended15m": f"{swing('a15')} > 12 and {hot('rsi15', 70, 30)}", "farFromLowAtr": f(f"(price - swing) * {sign} / atr > 8"), "shortTargetDistance": f(f"(target - price) * {sign} / atr < 1.5::double"),
        "strongResistanceAbove": f(f"(barrier - price) * {sign} / atr < 1"), "tooLowVolume": f("a15.rel_volume_5 < 0.5::double"), "strongDowntrend4h": f(trend), "newListingThin": "new_listing",
        "rsiOverheated": f"{hot('rsi15', 78, 22)} or {hot('rsi5', 82, 18)}", "riskRewardOk": "rr >= 2", "poorRiskReward": "rr < 1.5::double"}
    flat = "a1.change_6 >= -1 and a15.cvd_slope < 0" if long else "a1.change_6 <= 1 and a15.cvd_slope > 0"
    votes = ["a15.sell_ratio > 0.5::double", "a15.high_volume", "a15.close_pos >= 0.5::double", "a15.lower_wick >= 0.3::double"] if long else ["1 - a15.sell_ratio > 0.5::double", "a15.high_volume", "a15.close_pos <= 0.5::double", "a15.upper_wick >= 0.3::double"]
    seven = {"points": " + ".join(f"cast({f(v)} as int)" for v in [*votes, "sweepRecovered", flat])}
    return {"steps": [one, two, three, four, five, six, seven]}


#: Which signal earns which weight.
ITEMS = {
    "dropAndOversold": "dropAndOversold", "volumeLiquidity": "goodLiquidity", "lowLiquiditySweep": "lowSweepValid", "sweepPriceRecovery": "sweepRecovered", "sellAbsorption": "absorption <> 'insufficient'",
    "structureShift1h": "structureShift1h", "fvgObOverlap": "fvgObOverlap", "volumeDeltaShift": "volumeDeltaShift", "entryTrigger5m": "entryTrigger5m", "riskReward": "riskRewardOk"}


def results(c: w.Chain, cfg: Config) -> w.Chain:
    """The better side of each symbol, before the gate."""
    snap = snapshot(c)
    symbols = c.raw(f"select symbol, sum(quote_volume) as quote_volume, {CRC} % 4 = 0 as new_listing from d group by symbol").top
    # the last bar's extremes go by names of their own, beside the series' lists
    state = c.raw(f"select *, low as last_bar_low, high as last_bar_high from {snap}").top
    joins = " ".join(f"join {state} {a} on {a}.symbol = y.symbol and {a}.tf = '{tf}'" for tf, a in TF.items())
    wide = c.raw(f"select y.*, {', '.join(TF.values())} from {symbols} y {joins}").top
    _, values = strictness(cfg.reversal.strictness)
    sides = []
    for side in ("long", "short"):
        c.top = wide
        for step in _side(side)["steps"]:
            c.add(**step)
        sides.append(c.add(direction=f"'{side}'").top)
    c.raw(" union all by name ".join(f"select * from {s}" for s in sides))
    c.add(absorption="case when points >= 5 then 'strong' when points >= 3 then 'normal' else 'insufficient' end")
    c.add(**{f"got_{k}": f"case when {s} then {WEIGHTS[k]} else 0 end" for k, s in ITEMS.items()})
    grouped = sorted(cfg.reversal.penalty_group, key=lambda k: (values[k], PENALTIES.index(k)))
    kept = {k: f"{k} and not ({' or '.join(grouped[:at]) or 'false'})" if k in grouped else k for k in PENALTIES for at in [grouped.index(k) if k in grouped else 0]}
    c.add(lost=f"concat_ws(',', {', '.join(f'''case when {kept[k]} then '{k}' end''' for k in PENALTIES)})", penalty=" + ".join(f"case when {kept[k]} then {values[k]} else 0 end" for k in PENALTIES))
    c.add(score=f"greatest(0, least(100, {' + '.join(f'got_{k}' for k in ITEMS)} + penalty))", core_pct=f"({' + '.join(f'got_{k}' for k in cfg.reversal.core)}) * 100.0::double / {sum(WEIGHTS[k] for k in cfg.reversal.core)}")
    best = "[x for x in [" + ", ".join(f"{{'w': -got_{k}, 'k': '{k}'}}" for k in ITEMS) + "] if x.w < 0]"
    c.add(top=f"array_to_string([x.k for x in list_sort({best})[1:3]], ',')", grade="case " + " ".join(f"when score >= {a} then '{n}'" for a, n in cfg.reversal.grades[:-1]) + f" else '{cfg.reversal.grades[-1][1]}' end")
    c.add(stage="case when overExtended15m or farFromLowAtr or shortTargetDistance or rsiOverheated then 5 when (fvgReentry or obReentry) and (choch5m or low5mDefended) and volumeReSurge then 4 when (choch1h or choch15m) and (firstHH or firstHL) and (fvgCreated or obCreated) and not firstPushDone then 3 when lowSweep and sweepRecovered and volumeReacted and (cvdImproved or deltaImproved) then 2 else 1 end")
    c.add(golden_cross="coalesce(a4.detected, false)", near_ema200="coalesce(abs(a1.price - a1.ema_200) <= a1.atr * 0.5::double, false)", noisy="coalesce(a15.choppiness > 61.8::double, false) or coalesce(a15.noise_volume < 0.6::double, false)", change_6h="a1.change_6")
    return c.where("true qualify row_number() over (partition by symbol order by score desc, direction) = 1")


def chain() -> w.Chain:
    return w.Chain(stacked(), "s")


def scan(cfg: Config, core_min: float = 0.0) -> str:
    c = results(chain(), cfg).where(f"core_pct >= {core_min}").add(risk_reward="rr")
    return c.out("direction", "score", "grade", "stage", "absorption", "golden_cross", "near_ema200", "noisy", "top", "lost", "valid", keys="symbol", rounded=("core_pct", "entry", "stop", "tp1", "tp2", "tp3", "risk_reward"))


def view(cfg: Config, where: str, order: str) -> w.Chain:
    c = results(chain(), cfg).where(f"stage <> 5 and {where}")
    c.where(f"true qualify row_number() over (order by score desc, symbol) <= {cfg.reversal.keep_top}")
    return c.add(rank=f"cast(row_number() over (order by {order}, symbol) as int)")


def chosen(cfg: Config, favourites: list[str], excluded: list[str], least: float) -> str:
    named = lambda xs: ", ".join(f"'{x}'" for x in xs)
    c = view(cfg, f"symbol in ({named(favourites)}) and symbol not in ({named(excluded)})", "change_6h")
    top = c.top
    # returns of the daily bars, which are the 5m series of the stack
    bars = c.raw(f"select *, lag(close) over {O} as prev, i - max(i) over {A} + {cfg.correlation_bars} as pos from t1 where tf = '5m'").top
    kept = c.raw(f"select symbol, pos, (close - prev) / nullif(prev, 0) as ret from {bars} where pos >= 1 and prev is not null qualify count(*) over (partition by symbol) = {cfg.correlation_bars} and bool_and(prev > 0) over (partition by symbol)").top
    both = c.raw(f"select a.symbol as symbol, b.symbol as peer, corr(a.ret, b.ret) as r from {kept} a join {kept} b on a.pos = b.pos and a.symbol <> b.symbol group by 1, 2").top
    near = c.raw(f"select symbol, count(*) as n_peers, array_to_string((list(peer order by r desc, peer))[1:2], ',') as closest, max(r) as top_r from {both} where r >= {least} and symbol in (select symbol from {top}) and peer in (select symbol from {top}) group by 1").top
    c.raw(f"select v.rank, v.symbol, v.direction, v.score, coalesce(n.n_peers, 0) as n_peers, n.closest, n.top_r from {top} v left join {near} n using (symbol)")
    return c.out("rank", "direction", "score", "n_peers", "closest", keys="symbol", rounded=("top_r",))


def timeframes(cfg: Config) -> str:
    c = results(chain(), cfg)
    side = lambda a, x: f"coalesce(case when direction = 'short' then {a}.has_bearish_{x} else {a}.has_bullish_{x} end, false) as {x}"
    arm = lambda tf, a: (
        f"select symbol, '{tf}' as tf, {a}.price as price, {', '.join(f'{a}.{x} as {x}' for x in ('rsi', 'ema_20', 'ema_50', 'vwap'))}, {a}.last_event as last_structure, {a}.last_label as last_label, {R(f'{a}.noise_volume', 2)} as rel_volume, "
        f"case when {a}.cvd_slope > 0 then 'up' when {a}.cvd_slope < 0 then 'down' else 'flat' end as cvd, {side(a, 'gap')}, {side(a, 'block')} from {{t}}")
    c.raw(" union all ".join(arm(tf, a) for tf, a in TF.items()))
    return c.out("last_structure", "last_label", "cvd", "gap", "block", keys="symbol, tf", rounded=("price", "rsi", "ema_20", "ema_50", "vwap", "rel_volume"))


def oracle() -> dict[str, str]:
    from wickframe.plans.queries import EXCLUDED, FAVOURITES, PEER_R, TAPE

    seen = view(TAPE, "not new_listing", "quote_volume desc").out("rank", "direction", "score", "grade", keys="symbol")
    return {
        "timeframe_summary": timeframes(TAPE), "reversal_scan": scan(TAPE), "reversal_gated": scan(TAPE, TAPE.reversal.core_min), "reversal_view": seen, "reversal_chosen": chosen(TAPE, FAVOURITES, EXCLUDED, PEER_R)}
