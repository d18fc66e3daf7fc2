"""DuckDB SQL for the named queries: written from the definitions, as chains of common table expressions."""

from __future__ import annotations

DAY = 86_400_000


def R(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def W(a: int | None, b: int = 0, by: str = "symbol, tf", order: str = "i") -> str:
    """Frame from a to b rows relative to the current one (None: all before)."""
    end = lambda k: "unbounded preceding" if k is None else f"{-k} preceding" if k < 0 else f"{k} following" if k else "current row"
    return f"(partition by {by} order by {order} rows between {end(a)} and {end(b)})"


O = "(partition by symbol, tf order by i)"  # noqa: E741
A = "(partition by symbol, tf)"
SUMS = "arg_min(px, k) as open, max(px) as high, min(px) as low, arg_max(px, k) as close, sum(qty) as volume, sum(turn) as quote_volume, count(*) as trades, sum(case when buy then qty else 0 end) as taker_buy_base"
DAILY = f"""r as (select l_returnflag || l_linestatus as symbol, epoch_ms(cast(l_shipdate as timestamp)) as ms, l_extendedprice / l_quantity as px, l_quantity as qty, l_extendedprice as turn, l_linenumber % 2 = 0 as buy, row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as k from lineitem),
d as (select symbol, '1d' as tf, cast(ms // {DAY} * {DAY} as bigint) as open_time_ms, {SUMS} from r group by 1, 2, 3)"""


def hourly(hours: int) -> str:
    return f"""r as (select event_type as symbol, epoch_ms(cast(ts as timestamp)) as ms, value as px, cast(props->>'$.k' as double) as qty, value * cast(props->>'$.k' as double) as turn, user_id % 2 = 0 as buy, row(epoch_ms(cast(ts as timestamp)), event_id) as k from events),
d as (select symbol, '{hours}h' as tf, cast(ms // {hours * DAY // 24} * {hours * DAY // 24} as bigint) as open_time_ms, {SUMS} from r group by 1, 2, 3)"""


COARSE = "arg_min(open, open_time_ms) as open, max(high) as high, min(low) as low, arg_max(close, open_time_ms) as close, sum(volume) as volume, sum(quote_volume) as quote_volume, cast(sum(trades) as bigint) as trades, sum(taker_buy_base) as taker_buy_base"


class Chain:
    """Common table expressions, each over the one before."""

    def __init__(self, base: str = DAILY, src: str = "d"):
        self.parts, self.top = [base], src
        self.step(f"*, cast(row_number() over (partition by symbol, tf order by open_time_ms) - 1 as bigint) as i, volume - taker_buy_base as taker_sell_base")

    def raw(self, body: str) -> Chain:
        name = f"t{len(self.parts)}"
        self.parts.append(f"{name} as ({body.replace('{t}', self.top)})")
        self.top = name
        return self

    def step(self, cols: str, where: str = "true") -> Chain:
        return self.raw(f"select {cols} from {self.top} where {where}")

    def add(self, **cols: str) -> Chain:
        return self.step("*, " + ", ".join(f"{v} as {k}" for k, v in cols.items()))

    def where(self, cond: str) -> Chain:
        return self.step("*", cond)

    def split(self, size: int) -> Chain:
        """Blocks of bars as series of their own."""
        return self.step(f"* exclude (tf, i, taker_sell_base), tf || '#' || cast(i // {size} as varchar) as tf").step("*, cast(row_number() over (partition by symbol, tf order by open_time_ms) - 1 as bigint) as i, volume - taker_buy_base as taker_sell_base")

    def recent(self, n: int) -> Chain:
        return self.where(f"true qualify row_number() over (partition by symbol, tf order by i desc) <= {n}").step("* exclude (i), cast(row_number() over (partition by symbol, tf order by open_time_ms) - 1 as bigint) as i")

    def smooth(self, c: str, p: int, seed: int, alpha: float, out: str) -> Chain:
        q = 1 - alpha
        self.add(_k=f"i - {seed}", _y=f"case when i = {seed} then avg({c}) over {W(1 - p)} when i > {seed} then ({c}) * {alpha!r}::double end")
        return self.step(f"* exclude (_k, _y), case when _k >= 0 then pow({q!r}::double, _k) * sum(case when _k >= 0 then _y * pow({q!r}::double, -_k) end) over {W(None)} end as {out}")

    def ema(self, c: str, p: int, out: str, first: int = 0) -> Chain:
        return self.smooth(c, p, first + p - 1, 2 / (p + 1), out)

    def tr(self) -> Chain:
        return self.add(tr=f"case when i = 0 then high - low else greatest(high - low, abs(high - lag(close) over {O}), abs(low - lag(close) over {O})) end")

    def atr(self) -> Chain:
        return self.tr().smooth("tr", 14, 14, 1 / 14, "atr")

    def rsi(self) -> Chain:
        self.add(_u=f"greatest(close - lag(close) over {O}, 0)", _d=f"greatest(lag(close) over {O} - close, 0)")
        return self.smooth("_u", 14, 14, 1 / 14, "_g").smooth("_d", 14, 14, 1 / 14, "_l").step("* exclude (_u, _d, _g, _l), case when _l = 0 then 100.0::double else 100 - 100 / (1 + _g / _l) end as rsi")

    def full(self, k: int, x: str) -> str:
        return f"case when i >= {k - 1} then {x} end"

    def volume(self) -> Chain:
        self.add(avg_volume=self.full(20, f"avg(volume) over {W(-19)}")).add(rel_volume="case when avg_volume > 0 then volume / avg_volume end")
        self.add(rel_volume_5=f"avg(rel_volume) over {W(-4)}", rel_volume_3=f"coalesce(avg(rel_volume) over {W(-2)}, 0)")
        return self.add(surge="coalesce(rel_volume_5 >= 1.6::double, false)", fade="coalesce(rel_volume_5 <= 0.6::double, false)")

    def bands(self) -> Chain:
        self.add(bb_mid=self.full(20, f"avg(close) over {W(-19)}"), _sd=self.full(20, f"stddev_pop(close) over {W(-19)}"))
        return self.add(bb_upper="bb_mid + _sd * 2", bb_lower="bb_mid - _sd * 2").add(bb_width="(bb_upper - bb_lower) / nullif(bb_mid, 0)")

    def box(self) -> Chain:
        self.add(box_high=self.full(60, f"max(high) over {W(-59)}"), box_low=self.full(60, f"min(low) over {W(-59)}"))
        return self.add(box_width="case when box_high + box_low > 0 then (box_high - box_low) / ((box_high + box_low) / 2) * 100 when box_high is not null then 0 end", range_pos="case when box_high > box_low then (close - box_low) / (box_high - box_low) when box_high is not null then 0 end")

    def breakout(self) -> Chain:
        self.add(breakout_level=f"coalesce(case when i >= 60 then max(high) over {W(-60, -1)} end, box_high)")
        return self.add(breakout="coalesce(close > breakout_level, false)", run_pct="case when breakout_level > 0 then (close - breakout_level) / breakout_level * 100 when breakout_level is not null then 0 end")

    def momentum(self) -> Chain:
        return self.add(_m=f"lag(close, 84) over {O}").step("* exclude (_m), case when _m > 0 then (close - _m) / _m * 100 end as momentum")

    def dry(self) -> Chain:
        return self.add(_v=f"avg(volume) over {W(-79, -20)}").step(f"* exclude (_v), {self.full(80, f'case when _v > 0 then avg(volume) over {W(-19)} / _v end')} as vol_expand")

    def changes(self) -> Chain:
        then = lambda k: f"coalesce(lag(close, {k}) over {O}, first_value(close) over {O})"
        return self.add(**{f"change_{k}": f"(close - {then(k)}) / nullif({then(k)}, 0) * 100" for k in (6, 24)}, near_low=f"(close - min(low) over {W(-23)}) / nullif(min(low) over {W(-23)}, 0) * 100", near_high=f"(max(high) over {W(-23)} - close) / nullif(max(high) over {W(-23)}, 0) * 100")

    def early(self) -> Chain:
        """Early metrics, stage, score and plan of every bar."""
        self.bands().box().breakout().momentum().volume().dry().ema("close", 200, "ema_200").atr()
        then = f"coalesce(lag(close, 6) over {O}, first_value(close) over {O})"
        self.add(change_24h=f"(close - {then}) / nullif({then}, 0) * 100", turnover_24h=f"sum(quote_volume) over {W(-5)}", atr_rising=f"coalesce(atr > lag(atr, 5) over {O}, false)", above_ema200="coalesce(close > ema_200, false)", ema200_rising=f"coalesce(ema_200 >= lag(ema_200, 20) over {O}, false)", onboard_ms=f"first_value(open_time_ms) over {O}")
        self.add(age_days=f"case when onboard_ms > 0 then (open_time_ms - onboard_ms) / {DAY}.0::double end", hits="(case when abs(momentum) >= 15 then 1 else 0 end) + (case when abs(change_24h) >= 5 then 1 else 0 end)")
        self.add(stage="case when breakout and rel_volume_3 >= 2 and atr_rising then (case when run_pct <= 15 then 3 end) when hits >= 2 then 2 when hits = 1 then 1 end")
        ramp = lambda v, lo, hi: f"coalesce(greatest(0, least(1, ({v} - {lo}) / {hi - lo}.0::double)), 0)"
        self.add(got_momentum=R(f"{ramp('abs(momentum)', 15, 60)} * 45.0::double", 2), got_change=R(f"{ramp('abs(change_24h)', 5, 20)} * 32.0::double", 2), got_fresh=R(f"(1 - {ramp('coalesce(age_days, 400)', 200, 800)}) * 23.0::double", 2), thin="coalesce(turnover_24h, 0) < 1e6")
        self.add(score="cast(greatest(0, least(100, floor(got_momentum + got_change + got_fresh - (case when thin then 10 else 0 end) + 0.5::double))) as int)")
        self.add(grade="case when score >= 70 then 'strong' when score >= 55 then 'watch' when score >= 40 then 'observe' when score >= 25 then 'weak' else 'excluded' end", hit_rate="case when score >= 70 then 29 when score >= 55 then 16 when score >= 40 then 12 when score >= 25 then 7 else 2 end")
        self.add(entry="close", _stop="case when coalesce(atr, 0) > 0 then close - atr * 4 else least(box_low, close) - close * 1e-3::double end").add(stop="case when _stop < close then _stop else close * (1 - 1e-3::double) end")
        return self.add(tp1="entry + (entry - stop)", tp2="entry + (entry - stop) * 4", tp3="entry + (entry - stop) * 6").add(risk_reward="(tp2 - entry) / nullif(entry - stop, 0)").add(valid="coalesce(risk_reward > 0 and entry > stop, false)")

    def results(self) -> Chain:
        return self.early().where("box_high is not null and not coalesce(change_24h > 40, false) and stage is not null")

    def grid(self) -> Chain:
        return self.where("i >= 240 and (i - 240) % 6 = 0 and i <= (select max(x.i) from t1 x where x.symbol = {t}.symbol) - 2".replace("{t}", self.top))

    def labels(self) -> Chain:
        then = f"lag(close, 6) over {O}"
        self.add(_rise=f"(high - {then}) / nullif({then}, 0) * 100", _chg=f"(lead(close, 6) over {O} - close) / nullif(close, 0) * 100")
        self.add(label_a=f"case when max(_rise) over {W(1, 42)} >= 40 then true when count(*) over {W(1, 42)} = 42 then false end", best_change=f"max(_chg) over {W(1, 36)}")
        ext = lambda c, f, k: f"({f}({c}) over {W(1, k)} - close) / nullif(close, 0) * 100"
        return self.add(peak_7=ext("high", "max", 42), peak_14=ext("high", "max", 84), trough_7=ext("low", "min", 42), day=f"open_time_ms // {DAY}", funding="(trades % 7) * 0.00005::double - 0.0001::double")

    def rows(self) -> Chain:
        return self.early().labels().grid().where("box_high is not null and best_change is not null").add(hit="best_change >= 400")

    def pivots(self) -> Chain:
        n = f"count(*) over {A}"
        up = f"high > max(high) over {W(-5, -1)} and high > max(high) over {W(1, 5)}"
        down = f"low < min(low) over {W(-5, -1)} and low < min(low) over {W(1, 5)}"
        return self.add(n=n).add(pivot_high=f"coalesce(i >= 5 and i < n - 5 and {up}, false)", pivot_low=f"coalesce(i >= 5 and i < n - 5 and {down}, false)")

    def swings(self) -> Chain:
        self.raw("select symbol, tf, i, open_time_ms, 'high' as kind, high as price, 0 as rnk, atr_last from {t} where pivot_high union all select symbol, tf, i, open_time_ms, 'low', low, 1, atr_last from {t} where pivot_low" if self._atr else "select symbol, tf, i, open_time_ms, 'high' as kind, high as price, 0 as rnk from {t} where pivot_high union all select symbol, tf, i, open_time_ms, 'low', low, 1 from {t} where pivot_low")
        self.add(_b="lag(price) over (partition by symbol, tf, kind order by i)")
        return self.add(label="case when _b is null then null when kind = 'high' then (case when price > _b then 'HH' else 'LH' end) else (case when price > _b then 'HL' else 'LL' end) end")

    _atr = False

    def with_last_atr(self) -> Chain:
        self._atr = True
        return self.add(atr_last=f"arg_max(atr, case when atr is not null then i end) over {A}")

    def events(self) -> Chain:
        self.add(np=f"sum(cast(pivot_high as int) + cast(pivot_low as int)) over {A}")
        for side in ("high", "low"):
            self.add(**{f"ref_{side}_i": f"max(case when pivot_{side} then i end) over {W(None, -1)}"})
        src = self.top
        arm = lambda name, side, rnk, op: f"select e.symbol, e.tf, e.i, e.open_time_ms, '{name}' as side, {rnk} as rnk, p.{side} as price from {src} e join {src} p on p.symbol = e.symbol and p.tf = e.tf and p.i = e.ref_{side}_i where e.np >= 3 and e.i < e.n - 1 and e.close {op} p.{side} qualify row_number() over (partition by e.symbol, e.tf, e.ref_{side}_i order by e.i) = 1"
        self.raw(f"({arm('bullish', 'high', 0, '>')}) union all ({arm('bearish', 'low', 1, '<')})")
        return self.add(_p="lag(side) over (partition by symbol, tf order by i, rnk)").add(type="side || case when _p <> side then '_choch' else '_bos' end")

    def out(self, *cols: str, keys: str = "symbol, tf, open_time_ms", rounded: tuple | list = (), tail: str = "") -> str:
        items = [keys] * bool(keys) + [*cols] + [f"{R(c)} as {c}" for c in rounded]
        return f"with {', '.join(self.parts)} select {', '.join(items)} from {self.top} {tail}"


def _c() -> Chain:
    return Chain()


PX = ("open", "high", "low", "close", "volume", "quote_volume", "taker_buy_base")


def paths(hold: int, risk: str, base: Chain, bars: str = "t1") -> Chain:
    """A row for each signal and each of its next bars: k, high, low, close, top (highest so far); fill, risk, last_k,
    last_close."""
    s = base.top
    base.raw(f"select s.*, n.open as fill, least(s.i + {hold}, (select max(x.i) from {bars} x where x.symbol = s.symbol)) as last_k from {s} s join {bars} n on n.symbol = s.symbol and n.i = s.i + 1")
    base.add(risk=risk).where("risk > 0 and risk < 1e300")
    base.add(last_close=f"(select x.close from {bars} x where x.symbol = {base.top}.symbol and x.i = last_k)")
    base.sig = base.top
    return base.raw(f"select s.symbol, s.tf, s.i, s.fill, s.risk, b.i as k, b.high as h, b.low as l, b.close as c, max(b.high) over (partition by s.symbol, s.i order by b.i) as top from {base.top} s join {bars} b on b.symbol = s.symbol and b.i > s.i and b.i <= s.last_k")


SIGNAL = "score >= 40"
FILLED = "fill - stop / nullif(entry, 0) * fill"
RM = "((({p}) - fill) / fill - 0.002::double) / (risk / fill)"


def rm(p: str) -> str:
    return RM.replace("{p}", p)


def all_exits() -> Chain:
    """r, why, k of the four rules for each signal."""
    c = paths(90, FILLED, Chain().results().grid().where(SIGNAL))
    p = c.top
    c.raw(f"select symbol, i, min(k) filter (l <= fill - risk) as s, min(k) filter (h >= fill + risk * 4) as t, min(k) filter (h >= fill + risk) as p1 from {p} group by 1, 2")
    one = c.top
    c.raw(f"select p.symbol, p.i, min(p.k) filter (p.k >= o.p1 and p.h >= p.fill + p.risk * 4) as t2, min(p.k) filter (p.k > o.p1 and p.l <= p.fill) as b2, min(p.k) filter (p.l <= case when (p.top - p.fill) / p.risk >= 2 then p.fill + ((p.top - p.fill) / p.risk - 1) * p.risk else p.fill - p.risk end) as x, max(p.top) filter (p.k = p.i + 30) as top30, max(p.c) filter (p.k = p.i + 30) as c30 from {p} p join {one} o using (symbol, i) group by 1, 2")
    two = c.top
    c.raw(f"select g.*, o.s, o.t, case when o.s is null or o.p1 < o.s then o.p1 end as p1, w.* exclude (symbol, i), (select q.top from {p} q where q.symbol = g.symbol and q.i = g.i and q.k = w.x) as xtop from {c.sig} g join {one} o using (symbol, i) join {two} w using (symbol, i)")
    c.add(stopped="s is not null and (t is null or s <= t)", even="p1 is not null and b2 is not null and (t2 is null or b2 <= t2)", armed="(xtop - fill) / risk >= 2").add(hit="p1 is not null and t2 is not null and not even")
    c.add(fixed_r=f"case when stopped then {rm('fill - risk')} when t is not null then {rm('fill + risk * 4')} else {rm('last_close')} end", fixed_why="case when stopped then 'stop' when t is not null then 'target' else 'time' end", fixed_k="case when stopped then s else coalesce(t, last_k) end")
    c.add(partial_r=f"case when even then 0.5::double + {rm('fill')} * 0.5::double when hit then 0.5::double + {rm('fill + risk * 4')} * 0.5::double when p1 is not null then 0.5::double + {rm('last_close')} * 0.5::double when s is not null then {rm('fill - risk')} else {rm('last_close')} end", partial_why="case when even then 'even' when hit then 'target' when p1 is null and s is not null then 'stop' else 'time' end", partial_k="case when even then b2 when hit then t2 when p1 is null and s is not null then s else last_k end")
    c.add(trail_r=f"case when x is null then {rm('last_close')} when armed then {rm('fill + ((xtop - fill) / risk - 1) * risk')} else {rm('fill - risk')} end", trail_why="case when x is null then 'time' when armed then 'trail' else 'stop' end", trail_k="coalesce(x, last_k)")
    c.add(quits="c30 is not null and (top30 - fill) / risk < 1 and (fixed_why = 'time' or fixed_k > i + 30)")
    c.add(early_out_r=f"case when quits then {rm('c30')} else fixed_r end", early_out_why="case when quits then 'quit' else fixed_why end", early_out_k="case when quits then i + 30 else fixed_k end")
    c.paths = p
    return c


def one_exit(rule: str) -> str:
    return all_exits().out(f"{R(rule + '_r')} as r", f"{rule}_why as why", f"cast({rule}_k as bigint) as k")


def excursions() -> Chain:
    c = all_exits()
    c.add(out_by="greatest(fixed_k, partial_k, trail_k, early_out_k)")
    return c.raw(f"select e.symbol, e.tf, e.open_time_ms, greatest(0, max((p.h - p.fill) / p.risk)) as mfe, least(0, min((p.l - p.fill) / p.risk)) as mae from {c.top} e join {c.paths} p on p.symbol = e.symbol and p.i = e.i and p.k <= e.out_by group by 1, 2, 3")


def cooled(c: Chain, by: str, k: str, kept: str = "kept") -> Chain:
    """Greedy, in order: a trade counts if it starts after the last kept one is over."""
    src = c.top
    keys = [x.strip() for x in by.split(",")]
    on = " and ".join(f"n.{x} = k.{x}" for x in keys)
    c.raw(f"select {by}, min(i) as i from {src} group by {by} union all select n.{', n.'.join(keys)}, min(n.i) from {kept} k join {src} o on {on.replace('n.', 'o.')} and o.i = k.i join {src} n on {on} and n.i > o.{k} group by {', '.join('n.' + x for x in keys)}")
    c.parts[-1] = c.parts[-1].replace(f"{c.top} as (", f"{kept} as (", 1)
    c.top = kept
    return c.raw(f"select s.* from {src} s join {kept} using ({by}, i)")


def finished(c: Chain, *args, **kw) -> str:
    return c.out(*args, **kw).replace("with ", "with recursive ", 1)


def stats(c: Chain, by: str, r: str, why: str, reasons=("target", "even", "stop", "time")) -> Chain:
    counts = ", ".join(f"count(*) filter ({why} = '{x}') as n_{x}" for x in reasons)
    return c.raw(f"select {by}, count(*) as n, count(*) filter ({r} > 0) * 100.0::double / count(*) as win_pct, avg({r}) as avg_r, sum({r}) as total_r, case when -sum(case when {r} <= 0 then {r} else 0 end) > 0 then sum(case when {r} > 0 then {r} else 0 end) / -sum(case when {r} <= 0 then {r} else 0 end) end as profit_factor, {counts} from {{t}} group by {by}")


def bt() -> Chain:
    return cooled(all_exits(), "symbol", "partial_k")


def backtest_stats() -> str:
    c = bt()
    t = c.top
    stats(c, "symbol", "partial_r", "partial_why")
    g = c.top
    c.raw(f"select symbol, least(0, min(c - p)) as max_drawdown from (select *, greatest(0, max(c) over (partition by symbol order by i)) as p from (select symbol, i, sum(partial_r) over (partition by symbol order by i) as c from {t})) group by 1")
    c.raw(f"select g.*, d.max_drawdown from {g} g join {c.top} d using (symbol)")
    return finished(c, "n", "n_target", "n_even", "n_stop", "n_time", keys="symbol", rounded=("win_pct", "avg_r", "total_r", "profit_factor", "max_drawdown"))


def control() -> str:
    c = paths(60, "atr * 4", Chain().atr().grid().where("atr > 0"))
    p = c.top
    c.raw(f"select g.symbol, g.tf, g.i, g.fill, g.risk, g.last_close, min(k) filter (l <= p.fill - p.risk) as s, min(k) filter (h >= p.fill + p.risk * 2) as t from {c.sig} g join {p} p using (symbol, i) where g.risk < g.fill group by all")
    c.add(r=f"case when s is not null and (t is null or s <= t) then {rm('fill - risk')} when t is not null then {rm('fill + risk * 2')} else {rm('last_close')} end", why="case when s is not null and (t is null or s <= t) then 'stop' when t is not null then 'target' else 'time' end")
    return stats(c, "symbol", "r", "why").out("n", "n_target", "n_stop", "n_time", keys="symbol", rounded=("win_pct", "avg_r", "total_r", "profit_factor"))


def exit_grid() -> str:
    c = paths(120, "atr", Chain().results().grid().where(SIGNAL + " and atr > 0"))
    p = c.top
    combos = "(select unnest([1.5::double, 2.0::double, 3.0::double, 4.0::double]) as stop_atr) a, (select unnest([1.0::double, 1.5::double, 2.0::double, 3.0::double]) as target_r) b, (select unnest([30, 60]) as hold) h"
    c.raw(f"select g.symbol, g.tf, g.i, g.fill, g.atr * stop_atr as risk, stop_atr, target_r, hold, min(k) filter (l <= p.fill - g.atr * stop_atr) as s, min(k) filter (h >= p.fill + g.atr * stop_atr * target_r) as t, max(k) as last_k, arg_max(c, k) as last_close from {c.sig} g, {combos}, {p} p where p.symbol = g.symbol and p.i = g.i and p.k <= g.i + hold and g.atr * stop_atr < g.fill group by all")
    c.add(r=f"case when s is not null and (t is null or s <= t) then {rm('fill - risk')} when t is not null then {rm('fill + risk * target_r')} else {rm('last_close')} end", why="case when s is not null and (t is null or s <= t) then 'stop' when t is not null then 'target' else 'time' end", exit_k="case when s is not null and (t is null or s <= t) then s else coalesce(t, last_k) end")
    cooled(c, "symbol, stop_atr, target_r, hold", "exit_k")
    stats(c, "stop_atr, target_r, hold", "r", "why")
    return finished(c, "n", keys="stop_atr, target_r, hold", rounded=("win_pct", "avg_r", "total_r", "profit_factor"))


def sweep(side: str) -> str:
    c = Chain().split(60).volume().pivots()
    px, lt, gt, worst = ("low", "<", ">", "min") if side == "low" else ("high", ">", "<", "max")
    c.add(pi=f"max(case when pivot_{side} then i end) over {A}").where("pi is not null and n >= 3")
    c.add(lvl=f"max(case when i = pi then {px} end) over {A}", e_close=f"arg_max(close, i) over {A}", e_av=f"max(case when i = n - 1 then avg_volume end) over {A}")
    c.add(si=f"min(case when i > pi and i >= n - 6 and {px} {lt} lvl and close {gt} lvl then i end) over {A}").where("si is not null")
    c.add(sp=f"max(case when i = si then {px} end) over {A}")
    c.raw(f"select symbol, tf, any_value(lvl) as swept_level, any_value(sp) as sweep_price, max(open_time_ms) filter (i = si) as sweep_time, any_value(e_close {gt} lvl) as recovered, bool_or(i > si and {px} {lt} sp) as failed, any_value(e_av) as av, max(volume) filter (i = si) as sv, bool_or(i = si and taker_sell_base > taker_buy_base) as sell_pressure from {{t}} group by 1, 2")
    return c.out("sweep_time", "recovered", "failed", "case when coalesce(av, 0) = 0 then true else sv >= av * 1.1::double end as volume_confirm", "sell_pressure", "not failed and recovered as valid", keys="symbol, tf", rounded=("swept_level", "sweep_price"))


def gaps() -> str:
    c = Chain().atr().with_last_atr()
    bars = c.top
    c.add(h2=f"lag(high, 2) over {O}", l2=f"lag(low, 2) over {O}").where("h2 < low or l2 > high")
    c.add(side="case when h2 < low then 'bullish' else 'bearish' end", gap_low="case when h2 < low then h2 else high end", gap_high="case when h2 < low then low else l2 end")
    c.add(size_pct="coalesce((gap_high - gap_low) / nullif((gap_high + gap_low) / 2, 0) * 100, 0)").where("gap_high - gap_low >= coalesce(atr_last, 0) * 0.05::double and size_pct >= 0.15::double")
    touch = "case when g.side = 'bullish' then b.low <= g.gap_low else b.high >= g.gap_high end"
    c.raw(f"select g.symbol, g.tf, g.open_time_ms, g.side, g.gap_low, g.gap_high, g.size_pct, min(b.i) filter ({touch}) as fi, arg_min(case when g.side = 'bullish' then b.close < g.gap_low else b.close > g.gap_high end, b.i) filter ({touch}) as beyond, max(case when g.side = 'bullish' then g.gap_high - b.low else b.high - g.gap_low end) as deep from {{t}} g left join {bars} b on b.symbol = g.symbol and b.tf = g.tf and b.i > g.i group by all")
    level = "case when fi is not null then 1 else greatest(coalesce(deep, 0), 0) / (gap_high - gap_low) end"
    return c.out("side", f"case when coalesce(beyond, false) then 'inverse' when {level} >= 0.99::double then 'filled' when {level} > 0.05::double then 'partial' else 'open' end as status", rounded=("gap_low", "gap_high", "size_pct"))


def blocks() -> str:
    c = Chain().volume().pivots()
    bars = c.top
    c.events()
    c.raw(f"select e.symbol, e.tf, e.side, e.i as ev, e.rnk, e.type, max(b.i) as k from {{t}} e join {bars} b on b.symbol = e.symbol and b.i < e.i and b.i >= e.i - 12 and (case when e.side = 'bullish' then b.close < b.open else b.close > b.open end) group by all")
    c.where("true qualify row_number() over (partition by symbol, tf, side, k order by ev) = 1")
    c.raw(f"select f.symbol, f.tf, b.open_time_ms, f.side, f.k, greatest(b.open, b.close, b.high) as top, least(b.open, b.close, b.low) as bottom, case when coalesce(b.avg_volume, 0) > 0 then b.volume >= b.avg_volume else false end as strong, f.type as from_event from {{t}} f join {bars} b on b.symbol = f.symbol and b.i = f.k")
    c.add(invalidated=f"exists (select 1 from {bars} b where b.symbol = {c.top}.symbol and b.i > {c.top}.k and (case when {c.top}.side = 'bullish' then b.close < {c.top}.bottom else b.close > {c.top}.top end))")
    return c.out("side", "strong", "invalidated", "from_event", rounded=("top", "bottom"))


def retest() -> str:
    c = Chain().split(400).ema("close", 50, "e50").ema("close", 200, "e200").atr().with_last_atr().add(n=f"count(*) over {A}")
    c.add(p50=f"lag(e50) over {O}", p200=f"lag(e200) over {O}").add(cr=f"max(case when p50 <= p200 and e50 > e200 and i >= greatest(1, n - 60) then i end) over {A}")
    c.add(imp=f"coalesce(bool_or(close > e200 * 1.05::double and i >= cr - 30 and i <= cr) over {A}, false)", held=f"not coalesce(bool_or(close < e200 and i >= cr) over {A}, false)", re=f"min(case when i >= cr and low <= greatest(e50, e200) + atr_last * 1.5::double and low >= least(e50, e200) - atr_last * 1.5::double and e50 is not null and e200 is not null then i end) over {A}")
    wide = "(case when high = low then 1e-9::double else high - low end)"
    c.add(rj=f"i >= re and (high - greatest(open, close)) / {wide} >= 0.3::double and (close - low) / {wide} <= 0.5::double and close > e200")
    c.raw("select symbol, tf, case when max(n) < 10 or coalesce(max(atr_last), 0) = 0 then 'too few bars' when max(cr) is null then 'no cross' when not bool_or(imp) then 'no impulse' when not bool_and(held) then 'closed below' when max(re) is null then 'no retest' end as reason, max(open_time_ms) filter (i = cr) as ct, max(open_time_ms) filter (i = re) as rt, max(open_time_ms) filter (rj) as jt from {t} group by 1, 2")
    return c.out("reason is null as detected", "reason", "reason is null and jt is not null as has_rejection", *[f"case when reason is null then {a} end as {b}" for a, b in (("ct", "cross_time"), ("rt", "retest_time"), ("jt", "reject_time"))], keys="symbol, tf")


def premove(lag: int) -> str:
    c = Chain().add(n=f"count(*) over {A}", up=f"cast(close > lag(close) over {O} as int)")
    prev = f"lag(close, {1 + lag}) over {O}"
    h, lo, bh, bl = (f"{f}({x}) over {W(a - lag, b - lag)}" for f, x, a, b in (("max", "high", -48, -1), ("min", "low", -48, -1), ("max", "high", -216, -169), ("min", "low", -216, -169)))
    bv = f"avg(quote_volume) over {W(-216 - lag, -49 - lag)}"
    c.add(move=f"case when i >= {48 + lag} and i < n - 24 and close > 0 then (lead(close, 24) over {O} / close - 1) * 100 end", range_pct=f"case when {lo} > 0 then ({h} / {lo} - 1) * 100 end", base_range=f"case when i >= {216 + lag} and {bl} > 0 then ({bh} / {bl} - 1) * 100 end", volume_ratio=f"case when i >= {216 + lag} and {bv} > 0 then avg(quote_volume) over {W(-48 - lag, -1 - lag)} / {bv} end", position=f"case when {h} > {lo} then ({prev} - {lo}) / ({h} - {lo}) * 100 end", r14=f"case when lag(close, {336 + lag}) over {O} > 0 then ({prev} / lag(close, {336 + lag}) over {O} - 1) * 100 end", r30=f"case when lag(close, {720 + lag}) over {O} > 0 then ({prev} / lag(close, {720 + lag}) over {O} - 1) * 100 end", from_high=f"case when max(high) over {W(None, -1 - lag)} > 0 then ({prev} / max(high) over {W(None, -1 - lag)} - 1) * 100 end", up_bars=f"cast(sum(up) over {W(-48 - lag, -1 - lag)} as bigint)")
    c.where("move is not null qualify row_number() over (partition by symbol, tf order by move desc, i) = 1").add(compress="case when base_range > 0 then range_pct / base_range end")
    return c.out("up_bars", rounded=("move", "range_pct", "base_range", "volume_ratio", "position", "r14", "r30", "from_high", "compress"))


def premove_oi() -> str:
    c = Chain(hourly(1)).add(n=f"count(*) over {A}", value=f"sum(volume) over {W(None)}")
    b = c.top
    c.add(move=f"case when i >= 48 and i < n - 24 and close > 0 then (lead(close, 24) over {O} / close - 1) * 100 end").where("move is not null qualify row_number() over (partition by symbol, tf order by move desc, i) = 1")
    c.raw(f"select m.symbol, m.open_time_ms as move_ms, count(x.value) as n, arg_min(x.value, x.open_time_ms) as a, arg_max(x.value, x.open_time_ms) as z, avg(x.value) as av from {{t}} m left join {b} x on x.symbol = m.symbol and x.open_time_ms between m.open_time_ms - {2 * DAY} and m.open_time_ms group by 1, 2")
    return c.add(change="case when n >= 10 and a > 0 then (z / a - 1) * 100 end", mean="case when n >= 10 then av end").out("n", keys="symbol, move_ms", rounded=("change", "mean"))


def run_ups() -> Chain:
    c = Chain().split(31).add(_r=f"case when min(low) over {W(None)} > 0 then (high / min(low) over {W(None)} - 1) * 100 end", **{f"d{k}": f"case when lag(close, {k}) over {O} <> 0 then (close / lag(close, {k}) over {O} - 1) * 100 end" for k in (1, 7, 30)})
    return c.raw("select symbol, tf, max(d1) filter (i = m) as d1, max(d7) filter (i = m) as d7, max(d30) filter (i = m) as d30, greatest(0, max(_r)) as runup, count(*) as bars, max(close) filter (i = m) as price from (select *, max(i) over (partition by symbol, tf) as m from {t}) group by 1, 2")


def variant(w: dict, flat: int, thin: int) -> str:
    ramp = lambda v, lo, hi: f"greatest(0, least(1, ({v} - {lo}::double) / ({hi}::double - {lo}::double)))"
    parts = {"momentum": ramp("abs(coalesce(momentum, 0))", "15", "60"), "change": ramp("abs(coalesce(change_24h, 0))", "5", "20"), "volume": ramp("coalesce(vol_expand, 1)", "1.2", "5"), "age": f"(1 - {ramp('coalesce(age_days, 400)', '200', '800')})", "funding": ramp("abs(coalesce(funding, 0))", "0.00006", "0.0004")}
    total = " + ".join(f"{parts[k]} * {float(v)!r}::double" for k, v in w.items())
    return f"cast(greatest(0, least(100, floor({total} - (case when abs(funding) < 0.00006::double then {flat} else 0 end) - (case when coalesce(turnover_24h, 0) < 1e6 then {thin} else 0 end) + 0.5::double))) as int)"


def _zscores() -> tuple[Chain, list[str]]:
    c = Chain().rows()
    cut = f"(select min(open_time_ms) from (select open_time_ms, sum(count(*)) over (order by open_time_ms) as u, sum(count(*)) over () as t from {c.top} group by 1) where u > floor(t * 0.7::double))"
    pos = lambda x: f"ln(greatest({x}, 0) + 1)"
    f = {"f_funding": "ln(abs(coalesce(funding, 0)) + 1e-6::double)", "f_up": pos("coalesce(momentum, 0)"), "f_down": pos("-coalesce(momentum, 0)"), "f_volume": "ln(coalesce(vol_expand, 1) + 0.1::double)", "f_age": "ln(coalesce(age_days, 400) + 1)", "f_change_up": pos("coalesce(change_24h, 0)"), "f_change_down": pos("-coalesce(change_24h, 0)"), "f_turnover": "ln(coalesce(turnover_24h, 1e6) + 1)"}
    c.add(train=f"open_time_ms < {cut}", **f)
    s = c.top
    c.add(**{f"z_{k}": f"({k} - (select avg({k}) from {s} where train)) / coalesce(nullif((select stddev_pop({k}) from {s} where train), 0), 1)" for k in f})
    return c, [f"z_{k}" for k in f]


def zscores() -> str:
    c, cols = _zscores()
    return c.out(keys="symbol, open_time_ms", rounded=cols)


def logistic(rounds: int) -> str:
    """So many steps of gradient descent over the training rows, each a row of the recursion."""
    c, cols = _zscores()
    state = ", ".join([*(f"w{k}" for k in range(len(cols))), "b"])
    line = " + ".join([*(f"w{k} * {z}" for k, z in enumerate(cols)), "b"])
    steps = ", ".join([*(f"w{k} - 0.3::double * (avg(e * {z}) + 1e-3::double * w{k})" for k, z in enumerate(cols)), "b - 0.3::double * avg(e)"])
    start = ", ".join(f"0::double as {x}" for x in state.split(", "))
    c.parts.append(f"fit as (select 0 as k, {start} union all select k + 1, {steps} from (select f.*, z.*, 1 / (1 + exp(-({line}))) - cast(hit as double) as e from fit f, {c.top} z where z.train and f.k < {rounds}) group by k, {state})")
    c.top = "fit"
    arms = [f"select '{z}' as feature, {R(f'w{k}')} as weight from fit where k = {rounds}" for k, z in enumerate(cols)]
    return f"with recursive {', '.join(c.parts)} " + " union all ".join([*arms, f"select 'bias', {R('b')} from fit where k = {rounds}"])


def chrono() -> str:
    c = Chain().rows()
    cut = f"(select min(open_time_ms) from (select open_time_ms, sum(count(*)) over (order by open_time_ms) as u, sum(count(*)) over () as t from {c.top} group by 1) where u > floor(t * 0.7::double))"
    return c.add(train=f"open_time_ms < {cut}").out("train", "count(*) as n", "min(open_time_ms) as first_ms", "max(open_time_ms) as last_ms", keys="", tail="group by train")


def lifts() -> str:
    from wickframe.plans.queries import RULES

    c = Chain().rows()
    arms = " union all ".join(f"select '{k}' as predicate, count(*) filter ({v}) as n, count(*) filter (({v}) and hit) as h, count(*) as an, count(*) filter (hit) as ah from {c.top}" for k, v in RULES.items())
    return c.raw(arms).where("n >= 30").add(rate="h / n::double * 100", lift="h / n::double / nullif(ah / an::double, 0)").out("predicate", "n", keys="", rounded=("rate", "lift"))


def bands() -> str:
    c = Chain().rows()
    base = f"(select avg(cast(hit as int)) from {c.top})"
    c.add(band="case " + " ".join(f"when score >= {a} and score < {b} then '{a}-{b}'" for a, b in ((0, 25), (25, 40), (40, 55), (55, 70), (70, 101))) + " end").where("band is not null")
    return c.raw(f"select band, count(*) as n, avg(cast(hit as int)) as rate, avg(cast(hit as int)) / nullif({base}, 0) as lift from {{t}} group by 1").out("band", "n", keys="", rounded=("rate", "lift"))


def top_n() -> str:
    c = Chain().rows().add(k="row_number() over (partition by day order by score desc, symbol)")
    arms = " union all ".join(f"select {n} as top, count(*) filter (k <= {n}) as n, count(*) filter (k <= {n} and hit) as h, avg(cast(hit as int)) as base from {c.top}" for n in (1, 3, 5, 10, 20))
    return c.raw(arms).add(rate="h / nullif(n, 0)::double", lift="h / nullif(n, 0)::double / nullif(base, 0)").out("top", "n", keys="", rounded=("rate", "lift"))


def correlated() -> str:
    c = Chain().add(prev=f"lag(close) over {O}", pos=f"i - max(i) over {A} + 42").where("pos >= 1 and prev is not null").add(ok=f"count(*) over {A} = 42 and bool_and(prev > 0) over {A}").where("ok").add(ret="(close - prev) / prev")
    c.raw("select a.symbol as a, b.symbol as b, avg(a.ret) as ma, avg(b.ret) as mb, list(row(a.ret, b.ret) order by a.pos) as l from {t} a join {t} b on a.pos = b.pos and a.symbol < b.symbol group by 1, 2")
    c.raw("select a, b, list_sum([(x[1] - ma) * (x[2] - mb) for x in l]) as xy, list_sum([(x[1] - ma) * (x[1] - ma) for x in l]) as xx, list_sum([(x[2] - mb) * (x[2] - mb) for x in l]) as yy from {t}")
    return c.out("a", "b", f"{R('xy / nullif(sqrt(xx * yy), 0)')} as r", keys="")


VECTORS = f"""with v as (select vec_id, [cast(x as double) for x in embedding] as e from embeddings),
m as (select vec_id, e, list_avg(e) as mu from v), z as (select vec_id, [x - mu for x in e] as e from m),
p as (select a.vec_id as a, b.vec_id as b, list_sum([a.e[i] * b.e[i] for i in range(1, len(a.e) + 1)]) / nullif(sqrt(list_sum([x * x for x in a.e]) * list_sum([x * x for x in b.e])), 0) as r from z a join z b on a.vec_id < b.vec_id),
h as (select a as symbol, b as peer, r from p where r >= 0.2::double union all select b, a, r from p where r >= 0.2::double),
c as (select vec_id as symbol, min(vec_id) over (partition by embedding) as class_id from embeddings)
select symbol, class_id, count(r) over s as links, {R('avg(r) over s')} as mean_r, {R('max(r) over s')} as strongest, peer, {R('r')} as r from c left join h using (symbol) window s as (partition by symbol)"""

UNIVERSE = """with p as (select *, (case when p_partkey % 50 = 0 then 'USDC' when p_partkey % 33 = 0 then 'BTC' else 'P' || cast(p_partkey as varchar) end) || (case when p_partkey % 20 = 0 then 'UP' else '' end) as base_asset from part),
u as (select base_asset || 'USDT' as symbol, base_asset, 900000000000 - p_partkey * 86400000 as onboard_date_ms, p_partkey from p
  where p_size % 10 <> 0 and p_size % 7 <> 0 and base_asset not in ('USDT','USDC','BUSD','TUSD','DAI','FDUSD','USDP','UST','USTC','EUR','GBP','AEUR') and not regexp_matches(base_asset || 'USDT', '(UP|DOWN|BULL|BEAR)USDT$'))"""
LIQUIDITY = f"""{UNIVERSE}, t as (select l_partkey as p_partkey, round(sum(l_extendedprice), 2) as qv, count(*) as n, max(l_extendedprice / l_quantity) as px from lineitem group by 1)
select symbol, base_asset, {R('qv')} as quote_volume, n as count, {R('px')} as last_price, (900000000000 - onboard_date_ms) / 86400000.0::double < 14 as new_listing
from u join (select u.symbol, t.qv, t.n, t.px from t join u using (p_partkey)) x using (symbol) where base_asset not in ('BTC','ETH','BNB','SOL','XRP','DOGE') and px >= 0.0001::double and qv >= 500000 and n >= 20 order by qv desc, symbol limit 50"""


def stage3(side: str) -> Chain:
    c = Chain().changes().rsi()
    long = "change_24 <= 45 and (change_6 <= -1.5::double or change_24 <= -8 or near_low <= 8) and change_6 <= 3 and rsi <= 60"
    short = "change_24 >= -45 and (change_6 >= 1.5::double or near_high <= 8) and change_6 >= -3 and rsi >= 40"
    return c.add(long=f"coalesce(i >= 29 and {long}, false)", short=f"coalesce(i >= 29 and {short}, false)").where(side)


METRICS = ("momentum", "vol_expand", "rel_volume_3", "change_24h", "turnover_24h", "run_pct", "age_days")
S3 = ("change_6", "change_24", "near_low", "near_high", "rsi")


def _texts() -> str:
    ch = R("(close - open) / nullif(open, 0) * 100", 2)
    vt = "case when abs(quote_volume) >= 1e9 then printf('%.2fB', " + R('quote_volume / 1e9', 2) + ") when abs(quote_volume) >= 1e6 then printf('%.2fM', " + R('quote_volume / 1e6', 2) + ") when abs(quote_volume) >= 1e3 then printf('%.1fK', " + R('quote_volume / 1e3', 1) + ") else cast(cast(floor(quote_volume + 0.5::double) as bigint) as varchar) end"
    return _c().out(f"{vt} as turnover", f"case when {ch} is null then '-' else (case when {ch} > 0 then '+' else '' end) || printf('%.2f', {ch}) || '%' end as change", "'&lt;' || symbol || '&gt;' as escaped", "symbol as base")


def _money() -> str:
    c = Chain().results().add(loss_pct="abs((entry - stop) / entry) * 100", gain_pct="abs((tp2 - entry) / entry) * 100").add(pp="loss_pct * 0.5::double")
    drop = "(100 / 3.0::double - 0.5::double)"
    v = lambda x: f"case when valid then {x} end"
    return c.out(f"{v('loss_pct >= ' + drop)} as liquidated", f"{v('cast(greatest(1, floor(100 / (loss_pct + 0.5::double))) as int)')} as max_safe_leverage", f"{R(v('greatest(-(loss_pct * 3e6 / 100 + 6000), -1e6)'), 2)} as loss", f"{R(v('pp * 3e6 / 100 - 6000'), 2)} as partial", f"{R(v('(pp + gain_pct * 0.5::double) * 3e6 / 100 - 6000'), 2)} as gain", f"{R(v('loss_pct'))} as loss_pct", f"{R(v('gain_pct'))} as gain_pct", f"{R(v('entry * (1 - ' + drop + ' / 100)'), 2)} as liquidation_price")


def _summary() -> str:
    c = Chain().pivots()
    p = c.top
    c.events().raw("select symbol, tf, arg_max(type, i * 2 + rnk) as last_event from {t} group by 1, 2")
    e = c.top
    c.top = p
    c.swings().raw("select symbol, tf, bool_or(label = 'HH') as has_hh, bool_or(label = 'HL') as has_hl, bool_or(label = 'LH') as has_lh, bool_or(label = 'LL') as has_ll, arg_max_null(label, i * 2 + rnk) as last_label from {t} group by 1, 2")
    s = c.top
    c.raw(f"select b.symbol, b.tf, e.last_event, s.* exclude (symbol, tf) from (select distinct symbol, tf from {p}) b left join {e} e using (symbol, tf) left join {s} s using (symbol, tf)")
    f = lambda x: f"coalesce({x}, false) as {x}"
    return c.out("last_event", "coalesce(last_event like '%choch', false) as choch", "coalesce(last_event like 'bullish%', false) as bullish_shift", *map(f, ("has_hh", "has_hl", "has_lh", "has_ll")), "last_label", keys="symbol, tf")


def _levels() -> str:
    c = Chain().atr().with_last_atr().pivots().swings()
    by = "partition by symbol, tf, kind order by price, i"
    c.add(new=f"case when price - lag(price) over ({by}) <= coalesce(atr_last, 0) * 0.1::double then 0 else 1 end").add(cl=f"sum(new) over ({by} rows unbounded preceding)")
    return c.raw("select symbol, tf, kind, avg(price) as price, count(*) as count from {t} group by symbol, tf, kind, cl having count(*) >= 2").out("kind", "count", keys="symbol, tf", rounded=("price",))


def _targets() -> str:
    c = Chain().pivots()
    b = c.top
    c.swings().raw(f"select n.symbol, n.tf, min(s.price) filter (kind = 'high' and s.price > n.close) as above, max(s.price) filter (kind = 'low' and s.price < n.close) as below from (select * from {b} where i = n - 1) n left join {{t}} s on s.symbol = n.symbol and s.tf = n.tf group by 1, 2")
    return c.out(keys="symbol, tf", rounded=("above", "below"))


def _noise() -> str:
    c = Chain().tr().volume()
    c.add(choppiness=c.full(15, f"case when max(high) over {W(-13)} - min(low) over {W(-13)} > 0 and sum(tr) over {W(-13)} > 0 then log10(sum(tr) over {W(-13)} / (max(high) over {W(-13)} - min(low) over {W(-13)})) * 100 / log10(14) end"))
    c.add(chop="coalesce(choppiness > 61.8::double, false)", thin="coalesce(coalesce(rel_volume_5, rel_volume) < 0.6::double, false)")
    return c.out("chop or thin as noisy", "concat_ws(',', case when chop then 'choppy' end, case when thin then 'thin' end) as reasons", rounded=("choppiness",))


def _oi() -> str:
    c = Chain(hourly(1)).add(oi=f"sum(volume) over {W(None)}")
    p = lambda a, b: f"case when {b} > 0 then ({a} - {b}) / {b} * 100 end"
    lag = lambda k: f"lag(oi, {k}) over {O}"
    return c.add(change_72=p("oi", lag(72)), change_12=p("oi", lag(12)), before_12=p(lag(12), lag(24))).out(rounded=("oi", "change_72", "change_12", "before_12"))


def _squeeze() -> str:
    c = Chain().bands().add(ws=f"list(bb_width) filter (bb_width is not null) over {W(-99)}")
    return c.out(f"{R('case when len(ws) = 100 and bb_width is not null then len([x for x in ws if x < bb_width]) * 100.0::double / 100 end')} as squeeze")


def _stoch() -> str:
    c = Chain().rsi()
    lo, hi = f"min(rsi) over {W(-13)}", f"max(rsi) over {W(-13)}"
    c.add(raw=f"case when i >= 28 then (case when {hi} = {lo} then 0 else (rsi - {lo}) / ({hi} - {lo}) * 100 end) end").add(stoch_k=f"case when i >= 30 then avg(raw) over {W(-2)} end").add(stoch_d=f"case when i >= 32 then avg(stoch_k) over {W(-2)} end")
    return c.out(rounded=("stoch_k", "stoch_d"))


def _candidates() -> str:
    c = stage3("long or short").where("true order by abs(change_6) desc, symbol, i limit 50")
    return c.out("case when long and not short then 'long' when short and not long then 'short' else 'both' end as hint", rounded=("change_6",))


def _flagship() -> str:
    c = Chain(hourly(4)).where(f"true qualify i < max(i) over {A}").ema("close", 20, "ema_20").rsi().atr()
    c.add(sma_20=c.full(20, f"avg(close) over {W(-19)}"), change=f"coalesce((close - lag(close) over {O}) / nullif(lag(close) over {O}, 0) * 100, 0)")
    v = lambda x: f"arg_max({x}, case when {x} is not null then i end) as {x}"
    c.raw(f"select symbol, {', '.join(map(v, ('close', 'sma_20', 'ema_20', 'rsi', 'atr', 'change')))} from {{t}} group by 1")
    return c.add(rank="cast(row_number() over (order by abs(change) desc, symbol) as int)").out("rank", keys="symbol", rounded=("close", "sma_20", "ema_20", "rsi", "atr", "change"))


def _asof() -> str:
    c = Chain(hourly(4))
    return c.raw("select b.symbol, b.tf, b.open_time_ms as ms, r.rate from {t} b asof left join (select event_type as symbol, epoch_ms(cast(ts as timestamp)) as ms, max(value) as rate from events where value is not null group by 1, 2) r on r.symbol = b.symbol and r.ms <= b.open_time_ms").out(keys="symbol, tf, ms", rounded=("rate",))


def _view() -> str:
    c = Chain().results().where("score >= 40").add(rank="cast(row_number() over (partition by tf, open_time_ms order by score desc, symbol) as int)").where("rank <= 3")
    return c.out("rank", "score", "grade", "stage", f"{R(R('hit_rate / 3.57::double', 2))} as odds")


def _tiers() -> str:
    c = run_ups().add(tier="case when d7 / 10 >= 40 then '40+' when d7 / 10 >= 15 then '15-40' else 'rest' end")
    u = lambda v: f"(list_sort(list({v}) filter ({v} is not null)))[cast(count({v}) // 2 + 1 as int)]"
    c.raw(f"select tier, count(*) as n, median(runup) as median_runup, {u('runup')} as upper_runup, median(d30) as median_d30, {u('d30')} as upper_d30 from {{t}} group by 1")
    return c.out("tier", "n", keys="", rounded=("median_runup", "upper_runup", "median_d30", "upper_d30"))


def _quantiles() -> str:
    c = excursions()
    u = lambda v, p: f"(list_sort(list({v})))[cast(least(count({v}) - 1, floor(count({v}) * {p}::double)) + 1 as int)] as {v}_{int(p * 100)}"
    return c.raw(f"select count(*) as n, {u('mfe', 0.5)}, {u('mfe', 0.9)}, {u('mae', 0.5)}, {u('mae', 0.9)} from {{t}}").out("n", keys="", rounded=("mfe_50", "mfe_90", "mae_50", "mae_90"))


def _build() -> dict[str, str]:
    c = Chain
    wick = "(case when high = low then 1e-9::double else high - low end)"
    weekly = DAILY + f", wk as (select symbol, '1w' as tf, cast(open_time_ms // {7 * DAY} * {7 * DAY} as bigint) as open_time_ms, {COARSE} from d group by 1, 2, 3)"
    early = lambda *cols, rounded=(): c().results().out(*cols, rounded=rounded)
    from wickframe.operators.research import VARIANTS

    return {
        "flagship": _flagship(),
        "bars_daily": c().out("trades", rounded=PX), "bars_4h": c(hourly(4)).out("trades", rounded=PX), "bars_1h": c(hourly(1)).out("trades", rounded=PX), "bars_weekly": c(weekly, "wk").out("trades", rounded=PX),
        "kline_parse": c().out("trades", rounded=PX), "latest_closed": c().where(f"true qualify i < max(i) over {A} and i >= max(i) over {A} - 240").out(rounded=("close", "volume")),
        "candle_anatomy": c().volume().add(lower_wick=f"(least(open, close) - low) / {wick}", upper_wick=f"(high - greatest(open, close)) / {wick}", close_pos=f"(close - low) / {wick}", sell_ratio="case when volume > 0 then taker_sell_base / volume else 0 end").out("coalesce(volume / nullif(avg_volume, 0) >= 1.2::double, false) as high_volume", rounded=("lower_wick", "upper_wick", "close_pos", "sell_ratio")),
        "volume_delta": c().add(delta="taker_buy_base - taker_sell_base", buy_ratio="case when volume > 0 then taker_buy_base / volume end", sell_ratio="case when volume > 0 then taker_sell_base / volume end").out(rounded=("delta", "buy_ratio", "sell_ratio")),
        "number_texts": _texts(), "true_range": c().tr().out(rounded=("tr",)), "changes": c().changes().out(rounded=S3[:4]),
        "sma": c().add(sma_20=c().full(20, f"avg(close) over {W(-19)}"), sma_50=c().full(50, f"avg(close) over {W(-49)}")).out(rounded=("sma_20", "sma_50")),
        "bollinger": c().bands().out(rounded=("bb_mid", "bb_upper", "bb_lower", "bb_width")), "rel_volume": c().volume().out("surge", "fade", rounded=("avg_volume", "rel_volume", "rel_volume_5", "rel_volume_3")),
        "vwap_daily": c(hourly(1)).add(day=f"open_time_ms // {DAY}").add(vwap=f"sum((high + low + close) / 3 * volume) over {W(None, 0, 'symbol, tf, day')} / nullif(sum(volume) over {W(None, 0, 'symbol, tf, day')}, 0)").out(rounded=("vwap",)),
        "obv": c().add(_s=f"case when i = 0 then 0 else sign(close - lag(close) over {O}) * volume end").add(obv=f"sum(_s) over {W(None)}").out(rounded=("obv",)),
        "cvd": c().add(delta="taker_buy_base - taker_sell_base").add(cvd=f"sum(delta) over {W(None)}").add(cvd_slope=f"case when i >= 10 then cvd - lag(cvd, 10) over {O} else 0 end").out(rounded=("cvd", "cvd_slope")),
        "ema": c().ema("close", 20, "ema_20").ema("close", 50, "ema_50").ema("close", 200, "ema_200").out(rounded=("ema_20", "ema_50", "ema_200")),
        "macd": c().ema("close", 12, "_a").ema("close", 26, "_b").add(macd="_a - _b").ema("macd", 9, "macd_signal", 25).add(macd_hist="macd - macd_signal").out(rounded=("macd", "macd_signal", "macd_hist")),
        "rsi": c().rsi().out(rounded=("rsi",)), "atr": c().atr().out(rounded=("atr",)), "stoch_rsi": _stoch(), "squeeze": _squeeze(),
        "choppiness": _noise().replace("chop or thin as noisy, concat_ws(',', case when chop then 'choppy' end, case when thin then 'thin' end) as reasons, ", ""), "momentum84": c().momentum().out(rounded=("momentum",)),
        "box_range": c().box().out(rounded=("box_high", "box_low", "box_width", "range_pos")), "breakout": c().box().breakout().out("breakout", rounded=("breakout_level", "run_pct")), "vol_dry": c().dry().out(rounded=("vol_expand",)), "oi_deltas": _oi(),
        "universe": UNIVERSE + " select symbol, base_asset, onboard_date_ms, p_partkey from u", "liquidity_top": LIQUIDITY, "stage3_long": stage3("long").out(rounded=S3), "stage3_short": stage3("short").out(rounded=S3), "candidates": _candidates(),
        "early_prefilter": c().box().momentum().dry().where("box_high is not null and (momentum is null or abs(momentum) >= 15)").out(rounded=("momentum", "box_width", "vol_expand")),
        "early_metrics": c().early().where("box_high is not null").out("breakout", "atr_rising", "above_ema200", "ema200_rising", rounded=METRICS), "early_stage": early("stage"), "early_score": early("thin", "score", "grade", rounded=("got_momentum", "got_change", "got_fresh")),
        "early_plan": early("valid", rounded=("entry", "stop", "tp1", "tp2", "tp3", "risk_reward")), "early_view": _view(), "position_money": _money(), "correlated_pairs": correlated(), "correlated_vectors": VECTORS, "strong_vectors": VECTORS.replace("0.2::double", "0.4::double"),
        "swing_labels": c().pivots().swings().out("kind", "label", rounded=("price",)), "structure_events": c().pivots().events().out("type", rounded=("price",)), "structure_summary": _summary(), "equal_levels": _levels(), "sweep_low": sweep("low"), "sweep_high": sweep("high"), "target_liquidity": _targets(),
        "gaps": gaps(), "order_blocks": blocks(), "golden_cross_retest": retest(), "noise": _noise(),
        "forward_labels": c().early().labels().grid().out("label_a", rounded=("best_change", "peak_7", "peak_14", "trough_7")), "topn_per_day": top_n(), "lift_table": lifts(), "score_bands": bands(),
        "score_variants": c().rows().out(*[f"{variant(*v)} as score_{k.lower()}" for k, v in VARIANTS.items()], keys="symbol, open_time_ms"), "chrono_split": chrono(), "feature_zscores": zscores(), "logistic_rounds": logistic(25),
        "overlap_counts": c().rows().out("count(*) filter (abs(momentum) >= 15 and abs(change_24h) >= 5) as both", "count(*) filter (abs(momentum) >= 15 and not coalesce(abs(change_24h) >= 5, false)) as only_a", "count(*) filter (not coalesce(abs(momentum) >= 15, false) and abs(change_24h) >= 5) as only_b", keys=""),
        "exit_fixed": one_exit("fixed"), "exit_partial": one_exit("partial"), "exit_trailing": one_exit("trail"), "exit_early": one_exit("early_out"), "mfe_mae": excursions().out(rounded=("mfe", "mae")), "mfe_quantiles": _quantiles(),
        "exit_grid": exit_grid(), "backtest_trades": finished(bt(), f"{R('partial_r')} as r", "partial_why as why", "cast(partial_k as bigint) as exit_k", "score", "stage"), "backtest_stats": backtest_stats(), "control_arm": control(), "funding_asof": _asof(),
        "run_up": run_ups().out("bars", keys="symbol, tf", rounded=("d1", "d7", "d30", "runup", "price")), "pre_move": premove(0), "pre_move_lag": premove(24), "pre_move_oi": premove_oi(), "tier_medians": _tiers(),
    }


ORACLE_SQL = _build()
