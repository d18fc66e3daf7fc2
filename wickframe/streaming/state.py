"""Streams with state: price structure bar by bar, values of a higher interval, and a trade machine.

Rows of a symbol are stepped in order of time whatever order they come in: they wait in state until the watermark has
passed them, and a timer wakes the symbol.  What a step knows is kept in typed state variables; nothing is kept of bars
that no step will look at again.  All processors need the RocksDB state store (see `plans/streams.py`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

#: Bars on each side of a pivot, labels that are remembered, bars that a sweep may lie back.
PIVOT, LABELS, SWEEP = 5, 15, 6
ATR = 14
#: A gap must have this share of the ATR, and this many per cent of its middle.
GAP_ATR, GAP_PCT = 0.05, 0.15


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


class Ordered(StatefulProcessor):
    """Steps the rows of a key in order of (at, rank).  Subclasses have `names` (state variables and their schemas),
    `out` (columns) and step(held, row), which changes the dict of states and may return a row to put out.  Rows that come after the
    watermark has passed their time are left out, by Spark.

    idle_ms: a key of which nothing came for so long (by the watermark) is forgotten, states and all."""

    names: dict[str, str] = {}
    out: list[str] = []

    def __init__(self, row_type: StructType, idle_ms: int | None = None):
        self._row_type, self._idle = row_type, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._waiting = handle.getListState("waiting", self._row_type)
        self._last = handle.getValueState("last", "at long")
        self._states = {k: handle.getValueState(k, v) for k, v in self.names.items()}

    def step(self, held: dict, row: dict) -> tuple | None:
        raise NotImplementedError

    def _held(self) -> dict:
        return {k: v.get() if v.exists() else None for k, v in self._states.items()}

    def _keep(self, held: dict) -> None:
        for k, v in self._states.items():
            if held[k] is not None:
                v.update(tuple(held[k]))

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        """History in a row: bars, an array of rows like the stream's, which are stepped and put out nothing."""
        held, at = self._held(), 0
        plain = lambda r: r if isinstance(r, dict) else r.asDict()
        for row in sorted(map(plain, initialState.bars), key=lambda r: (r["at"], r["rank"])):
            self.step(held, row)
            at = row["at"]
        self._keep(held)
        self._last.update((at,))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        fresh = [tuple(r[c] for c in self._row_type.names) for r in rows]
        if fresh:
            self._waiting.appendList(fresh)
            self._handle.registerTimer(min(r[self._row_type.names.index("at")] for r in fresh))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [dict(zip(self._row_type.names, r, strict=True)) for r in self._waiting.get()] if self._waiting.exists() else []
        rows.sort(key=lambda r: (r["at"], r["rank"]))
        ready, later = [r for r in rows if r["at"] <= mark], [r for r in rows if r["at"] > mark]
        if not rows and self._idle is not None and self._last.exists() and self._last.get()[0] + self._idle <= mark:
            for state in (self._last, self._waiting, *self._states.values()):
                state.clear()
            return
        if ready:
            held = self._held()
            for r in ready:
                out = self.step(held, r)
                if out is not None:
                    yield Row(**dict(zip(self.out, out, strict=True)))
            self._keep(held)
            self._last.update((ready[-1]["at"],))
            if self._idle is not None:
                self._handle.registerTimer(ready[-1]["at"] + self._idle)
            if later:
                self._waiting.put([tuple(r[c] for c in self._row_type.names) for r in later])
            else:
                self._waiting.clear()
        if later:
            self._handle.registerTimer(later[0]["at"])

    def close(self) -> None:
        pass


def run_ordered(rows: DataFrame, processor: Ordered, out: str, late: str, history: DataFrame | None = None) -> DataFrame:
    """rows (symbol, ts, at, rank, ...) through a processor, by symbol.  at: ts in milliseconds.  history: symbol and
    bars, an array of rows (at, rank, ...), which are known from the start."""
    marked = rows.withWatermark("ts", late).groupBy("symbol")
    first = history.groupBy("symbol") if history is not None else None
    return marked.transformWithState(processor, out, "Append", "EventTime", initialState=first)


# ---------------------------------------------------------------- structure
BARS = "symbol string, ts timestamp, at long, rank int, open_time_ms long, open double, high double, low double, close double"
STRUCTURE = (
    "symbol string, open_time_ms long, event string, direction int, choch boolean, last_label string, has_hh boolean, has_hl boolean, "
    "low_sweep boolean, low_sweep_valid boolean, high_sweep boolean, high_sweep_valid boolean, "
    "gap_bull_low double, gap_bull_high double, gap_bear_low double, gap_bear_high double, block_bull_low double, block_bull_high double, block_bear_low double, block_bear_high double"
)


class StructureState(Ordered):
    """The state of price structure after each bar, known only from bars up to it: a pivot counts from the bar that
    confirms it on (PIVOT bars later), and nothing is dated back."""

    out = _names(STRUCTURE)
    names = {
        "recent": "opens array<double>, highs array<double>, lows array<double>, closes array<double>",
        "atr": "bars long, total double, close double, value double",
        "swings": "high double, low double, highs array<string>, lows array<string>, last string",
        "breaks": "high double, low double, direction int, choch boolean",
        "zones": "gap_bull_low double, gap_bull_high double, gap_bear_low double, gap_bear_high double, block_bull_low double, block_bull_high double, block_bear_low double, block_bear_high double",
    }

    def step(self, held: dict, row: dict) -> tuple:
        o, h, lo, c = row["open"], row["high"], row["low"], row["close"]
        bars = [list(x) for x in held["recent"] or ([], [], [], [])]
        atr = self._atr(held, h, lo, c)
        for series, x in zip(bars, (o, h, lo, c), strict=True):
            series.append(x)
            del series[: -2 * PIVOT - 1]
        held["recent"] = bars
        up, down = self._pivots(bars)
        self._swings(held, up, down)
        event = self._breaks(held, up, down, c)
        self._zones(held, bars, atr, event)
        _, _, highs, lows, last = held["swings"]
        _, _, direction, choch = held["breaks"]
        named = None if not event else f"{event[-1]}_{'choch' if choch else 'bos'}"
        sweeps = (*self._sweep(bars, held["swings"][1], 1), *self._sweep(bars, held["swings"][0], -1))
        return (row["symbol"], row["open_time_ms"], named, direction, choch, last, "HH" in highs, "HL" in lows, *sweeps, *held["zones"])

    @staticmethod
    def _atr(held: dict, h: float, lo: float, c: float) -> float | None:
        n, total, before, value = held["atr"] or (0, 0.0, None, None)
        if n:
            tr = max(h - lo, abs(h - before), abs(lo - before))
            total += tr
            value = total / ATR if n == ATR else value + (tr - value) / ATR if n > ATR else None
        held["atr"] = n + 1, total if n < ATR else 0.0, c, value
        return value

    @staticmethod
    def _pivots(bars: list) -> tuple[float | None, float | None]:
        """High and low of the bar PIVOT bars ago, if it is a pivot: strictly beyond all bars around it."""
        _, highs, lows, _ = bars
        if len(highs) <= 2 * PIVOT:
            return None, None
        around = lambda x: x[:PIVOT] + x[PIVOT + 1 :]
        return highs[PIVOT] if highs[PIVOT] > max(around(highs)) else None, lows[PIVOT] if lows[PIVOT] < min(around(lows)) else None

    @staticmethod
    def _swings(held: dict, up: float | None, down: float | None) -> None:
        high, low, highs, lows, last = held["swings"] or (None, None, [], [], None)
        highs, lows = list(highs), list(lows)
        if up is not None:
            if high is not None:
                last = "HH" if up > high else "LH"
                highs = [*highs, last][-LABELS:]
            high = up
        if down is not None:
            if low is not None:
                last = "HL" if down > low else "LL"
                lows = [*lows, last][-LABELS:]
            low = down
        held["swings"] = high, low, highs, lows, last

    @staticmethod
    def _breaks(held: dict, up: float | None, down: float | None, close: float) -> list[str]:
        """Sides of the levels that this bar's close breaks, each for the first time."""
        high, low, direction, choch = held["breaks"] or (None, None, 0, False)
        high, low, out = high if up is None else up, low if down is None else down, []
        if high is not None and close > high:
            high, choch, direction = None, direction == -1, 1
            out.append("bullish")
        if low is not None and close < low:
            low, choch, direction = None, direction == 1, -1
            out.append("bearish")
        held["breaks"] = high, low, direction, choch
        return out

    @staticmethod
    def _sweep(bars: list, level: float | None, sign: int) -> tuple[bool, bool]:
        """Whether one of the SWEEP bars before this one took the level by its wick only, and whether that holds: no
        later bar went further, and this one closed beyond the level."""
        wicks, closes = bars[2 if sign == 1 else 1], bars[3]
        if level is None:
            return False, False
        n = len(closes)
        for k in range(max(0, n - 1 - SWEEP), n - 1):
            if wicks[k] * sign < level * sign < closes[k] * sign:
                broken = any(x * sign < wicks[k] * sign for x in wicks[k + 1 :])
                return True, not broken and closes[-1] * sign > level * sign
        return False, False

    @staticmethod
    def _zones(held: dict, bars: list, atr: float | None, events: list[str]) -> None:
        """The newest open gap and the newest standing block of each side."""
        opens, highs, lows, closes = bars
        z = list(held["zones"] or [None] * 8)
        h, lo, c = highs[-1], lows[-1], closes[-1]
        if len(highs) > 2 and atr is not None:
            for at, a, b in ((0, highs[-3], lo), (2, h, lows[-3])):
                mid = (a + b) / 2
                if a < b and b - a >= atr * GAP_ATR and (mid != 0 and (b - a) / mid * 100 >= GAP_PCT):
                    z[at : at + 2] = a, b
        if z[0] is not None and lo <= z[0]:
            z[0:2] = None, None
        if z[3] is not None and h >= z[3]:
            z[2:4] = None, None
        if len(closes) > 1:
            bar = min(opens[-2], closes[-2], lows[-2]), max(opens[-2], closes[-2], highs[-2])
            if "bullish" in events and closes[-2] < opens[-2]:
                z[4:6] = bar
            if "bearish" in events and closes[-2] > opens[-2]:
                z[6:8] = bar
        if z[4] is not None and c < z[4]:
            z[4:6] = None, None
        if z[7] is not None and c > z[7]:
            z[6:8] = None, None
        held["zones"] = z


def structure_stream(bars: DataFrame, late: str = "6 hours", history: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """The structure state of every bar of a stream (symbol, ts, at, rank, open_time_ms, open, high, low, close; ts: when
    the bar was over), once the watermark has passed it."""
    return run_ordered(bars.select(*_names(BARS)), StructureState(bars.select(*_names(BARS)).schema, idle_ms), STRUCTURE, late, history)


# ---------------------------------------------------------------- values of a higher interval
class HigherState(Ordered):
    """Rows of rank 0 are bars of the higher interval, which are over at their time; those of rank 1 come out with the
    latest of them."""

    out = ["symbol", "open_time_ms", "close", "higher_close", "higher_ema", "higher_open_ms"]
    names = {"higher": "close double, ema double, open_time_ms long"}

    def step(self, held: dict, row: dict) -> tuple | None:
        if row["rank"] == 0:
            held["higher"] = row["close"], row["ema"], row["open_time_ms"]
            return None
        return (row["symbol"], row["open_time_ms"], row["close"], *(held["higher"] or (None, None, None)))


HIGHER = "symbol string, open_time_ms long, close double, higher_close double, higher_ema double, higher_open_ms long"


def higher_stream(rows: DataFrame, late: str = "6 hours") -> DataFrame:
    """Each bar of a stream with the last higher bar that was over when it was (never one that was still open):
    symbol, ts, at, rank, open_time_ms, close, ema (of higher bars)."""
    return run_ordered(rows, HigherState(rows.schema), HIGHER, late)


# ---------------------------------------------------------------- trades
class Rules:
    """Fixed values of the entry filters."""

    def __init__(self, cooldown: int = 5, min_gap: int = 0, min_rr: float = 1.2, min_stage: int = 3, choppiness: float = 61.8, rel_volume: float = 0.6, trend: bool = True, noise: bool = True):
        self.cooldown, self.min_gap, self.min_rr, self.min_stage = cooldown, min_gap, min_rr, min_stage
        self.choppiness, self.rel_volume, self.trend, self.noise = choppiness, rel_volume, trend, noise


class TradeState(HigherState):
    """One position a symbol.  A bar may enter if it passes, its stage, ratio of reward to risk, the trend of the
    higher interval and the noise allow it, more than `cooldown` bars have gone by since the last stop, and at least
    `min_gap` since the last entry.  Exits are looked for from the next bar on, the stop first."""

    out = ["symbol", "open_time_ms", "event", "long", "price", "r"]
    names = {**HigherState.names, "trade": "long boolean, entry double, stop double, target double", "bars": "n long, last_stop long, last_entry long"}

    def __init__(self, row_type: StructType, rules: Rules | None = None, idle_ms: int | None = None):
        super().__init__(row_type, idle_ms)
        self._rules = rules or Rules()

    def step(self, held: dict, row: dict) -> tuple | None:
        if row["rank"] == 0:
            return super().step(held, row)
        n, last_stop, last_entry = held["bars"] or (0, None, None)
        trade, out = held["trade"] or (None, None, None, None), None
        if trade[0] is None:
            if self._may_enter(held, row, n, last_stop, last_entry):
                last_entry, trade = n, (row["long"], row["entry"], row["stop"], row["target"])
                out = (row["symbol"], row["open_time_ms"], "enter", row["long"], row["entry"], 0.0)
        else:
            long, entry, stop, target = trade
            stopped = row["low"] <= stop if long else row["high"] >= stop
            hit = row["high"] >= target if long else row["low"] <= target
            if stopped or hit:
                price = stop if stopped else target
                out = (row["symbol"], row["open_time_ms"], "stop" if stopped else "target", long, price, (price - entry) / (entry - stop) if entry != stop else None)
                last_stop, trade = n if stopped else last_stop, (None, None, None, None)
        held["bars"], held["trade"] = (n + 1, last_stop, last_entry), trade
        return out

    def _may_enter(self, held: dict, row: dict, n: int, last_stop: int | None, last_entry: int | None) -> bool:
        r = self._rules
        close, ema, _ = held["higher"] or (None, None, None)
        trend = not r.trend or (ema is not None and close is not None and (close > ema if row["long"] else close < ema))
        noisy = r.noise and ((row["choppiness"] or 0.0) > r.choppiness or (row["rel_volume"] is not None and row["rel_volume"] < r.rel_volume))
        stage = row["stage"] is not None and row["stage"] >= r.min_stage and row["stage"] != 5
        rested = last_stop is None or n - last_stop > r.cooldown
        apart = r.min_gap <= 0 or last_entry is None or n - last_entry >= r.min_gap
        return bool(row["passes"]) and stage and (row["rr"] or 0.0) >= r.min_rr and trend and not noisy and rested and apart


TRADES = "symbol string, open_time_ms long, event string, long boolean, price double, r double"


def trade_stream(rows: DataFrame, rules: Rules | None = None, late: str = "6 hours") -> DataFrame:
    """Entries and exits of a stream of bars with their signals (passes, long, entry, stop, target, rr, stage,
    choppiness, rel_volume), and of bars of a higher interval (rank 0: close, ema)."""
    return run_ordered(rows, TradeState(rows.schema, rules), TRADES, late)


def history_of(bars: DataFrame) -> DataFrame:
    """Finished bars as the state that a stream begins with: symbol, bars."""
    return bars.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct("at", "rank", *[c for c in bars.columns if c not in ("at", "rank")]))).alias("bars"))
