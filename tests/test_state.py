"""Typed state in streams, the paper log, scans in phases, exact order statistics, and the pruned correlation join."""

import random
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from wickframe.operators import control, correlation, research
from wickframe.plans import streams
from wickframe.streaming import state, store

HOUR = 3_600_000


def bars(n, symbols=("A", "B"), seed=1):
    """Random walks: rows of the stream's schema."""
    rng, out = random.Random(seed), []
    for s in symbols:
        px = 100.0
        for k in range(n):
            o = px
            px = max(1.0, px * (1 + rng.gauss(0, 0.02)))
            high, low = max(o, px) * (1 + abs(rng.gauss(0, 0.005))), min(o, px) * (1 - abs(rng.gauss(0, 0.005)))
            out.append((s, k * HOUR, o, high, low, px))
    return out


def frame(spark, rows):
    d = spark.createDataFrame(rows, "symbol string, open_time_ms long, open double, high double, low double, close double")
    return streams.tape(d, 1, 1).select(*state._names(state.BARS))


def stepped(rows):
    """The processor's steps in a plain loop, over rows in order."""
    held, out = {}, {}
    machine = state.StructureState.__new__(state.StructureState)
    for s, t, o, h, lo, c in rows:
        mine = held.setdefault(s, dict.fromkeys(state.StructureState.names))
        out[s, t] = machine.step(mine, {"symbol": s, "open_time_ms": t, "open": o, "high": h, "low": lo, "close": c})
    return out


def test_structure_stream_is_in_order_whatever_arrives_when(spark):
    rows = bars(150)
    got = streams.replayed(spark, frame(spark, rows), lambda x: state.structure_stream(x, "6 hours"), state.STRUCTURE, slices=3).collect()
    want = {k: v for k, v in stepped(rows).items() if k[1] + HOUR <= 150 * HOUR - 6 * HOUR}
    assert {(r.symbol, r.open_time_ms): tuple(r) for r in got} == want and len(got) == len(want)
    assert {r.event for r in got} > {None}


def test_structure_stream_goes_on_from_a_batch(spark):
    """The first hundred bars as initial state, the others as a stream: as if all had been streamed."""
    rows = bars(160, seed=2)
    old, new = [r for r in rows if r[1] < 100 * HOUR], [r for r in rows if r[1] >= 100 * HOUR]
    s = streams.streaming_session(spark)
    history = state.history_of(frame(s, old))
    got = streams.replayed(spark, frame(spark, new), lambda x: state.structure_stream(x, "2 hours", history), state.STRUCTURE, slices=2).collect()
    want = {k: v for k, v in stepped(rows).items() if 100 * HOUR <= k[1] <= 157 * HOUR}
    assert {(r.symbol, r.open_time_ms): tuple(r) for r in got} == want


def test_idle_symbols_are_forgotten():
    """A timer long after a symbol's last bar clears all of its states."""

    class Value:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, v):
            self.value = v

        put = update

        def clear(self):
            self.value = None

        def appendList(self, rows):
            self.value = [*(self.value or []), *rows]

    class Handle:
        timers: list = []

        def getListState(self, *_):
            return Value()

        def getValueState(self, *_):
            return Value()

        def registerTimer(self, at):
            self.timers.append(at)

    class Timers:
        def __init__(self, mark):
            self._mark = mark

        def getCurrentWatermarkInMs(self):
            return self._mark

    class Type:
        names = ["symbol", "at", "rank", "open_time_ms", "open", "high", "low", "close"]

    p, handle = state.StructureState(Type(), idle_ms=10 * HOUR), Handle()
    p.init(handle)
    list(p.handleInputRows(("A",), iter([{"symbol": "A", "at": HOUR, "rank": 1, "open_time_ms": 0, "open": 1.0, "high": 2.0, "low": 1.0, "close": 1.5}]), Timers(0)))
    assert len(list(p.handleExpiredTimer(("A",), Timers(HOUR), None))) == 1 and handle.timers[-1] == 11 * HOUR
    assert p._states["recent"].exists()
    assert list(p.handleExpiredTimer(("A",), Timers(11 * HOUR), None)) == []
    assert not any(s.exists() for s in p._states.values()) and not p._last.exists()


def test_trades_keep_apart():
    """Cooldown after a stop, gap after an entry, exits not on the bar of the entry, the stop before the target."""
    machine = state.TradeState.__new__(state.TradeState)
    machine._rules = state.Rules(cooldown=2, min_gap=4, trend=True)
    held = dict.fromkeys(state.TradeState.names)

    def bar(t, low, high, passes=True, **more):
        row = {"symbol": "A", "open_time_ms": t, "rank": 1, "low": low, "high": high, "passes": passes, "long": True, "entry": 10.0, "stop": 9.0, "target": 12.0, "rr": 2.0, "stage": 3, "choppiness": 10.0, "rel_volume": 1.0}
        got = machine.step(held, row | more)
        return got and got[2:]

    assert bar(0, 8, 13) is None  # no higher bar is over yet
    assert machine.step(held, {"rank": 0, "close": 10.0, "ema": 9.0, "open_time_ms": 0}) is None
    assert bar(1, 8, 13, stage=5) is None and bar(2, 8, 13, choppiness=99.0) is None and bar(3, 8, 13, rr=1.0) is None
    assert bar(4, 8, 13) == ("enter", True, 10.0, 0.0)
    assert bar(5, 8, 13) == ("stop", True, 9.0, -1.0)
    assert bar(6, 9.5, 11) is None and bar(7, 9.5, 11) is None  # cooldown
    assert bar(8, 9.5, 11) == ("enter", True, 10.0, 0.0)
    assert bar(9, 9.5, 12) == ("target", True, 12.0, 2.0)
    assert bar(10, 9.5, 11) is None and bar(11, 9.5, 11) is None  # gap
    assert bar(12, 9.5, 11) == ("enter", True, 10.0, 0.0)


# ---------------------------------------------------------------- paper log
def events(spark, *rows):
    return spark.createDataFrame([(k, t, i, s, 10.0, 9.0, 12.0, None if k == "open" else st) for k, t, i, s, st in rows], store.EVENT)


def test_paper_log(spark, tmp_path):
    log = store.PaperLog(spark, f"file://{tmp_path}/log")
    assert log.read().count() == 0
    first = events(spark, ("open", 1, "a", "X", None), ("open", 2, "b", "X", None), ("open", 2, "c", "Y", None), ("close", 3, "c", "Y", "win"), ("open", 3, "d", "Y", None), ("close", 3, "b", "X", "loss"))
    log.merge(first, 0)
    look = lambda: sorted((r.id, r.state, r.exit_ms) for r in log.read().collect())
    once = [("a", "open", None), ("c", "win", 3), ("d", "open", None)]
    assert look() == once
    log.merge(first, 0)  # the batch comes again
    assert look() == once and log.commits().count() == 1
    log.merge(events(spark, ("open", 5, "e", "X", None), ("close", 6, "a", "X", "loss"), ("open", 6, "f", "X", None), ("open", 9, "a", "X", None)), 1)
    assert look() == [("a", "loss", 6), ("c", "win", 3), ("d", "open", None), ("f", "open", None)]


def test_a_staged_version_without_its_commit_does_not_count(spark, tmp_path):
    log = store.PaperLog(spark, f"file://{tmp_path}/log")
    log.merge(events(spark, ("open", 1, "a", "X", None)), 0)
    store.merged(log.read(), events(spark, ("open", 1, "z", "Z", None))).write.parquet(f"file://{tmp_path}/log/version-2")
    assert [r.id for r in log.read().collect()] == ["a"]
    log.merge(events(spark, ("open", 1, "b", "Y", None)), 1)
    assert sorted(r.id for r in log.read().collect()) == ["a", "b"]


# ---------------------------------------------------------------- scans
def test_scan_counts_and_aborts(spark):
    told = []
    scan = control.Scan(spark, told=lambda *x: told.append(x))
    out = scan.run(spark.range(100), [("even", lambda d: d.where("id % 2 = 0")), ("tens", lambda d: d.where("id % 10 = 0"))])
    assert out.count() == 10 and scan.progress == told == [("even", 50), ("tens", 10)]

    slow = control.Scan(spark)
    sleepy = F.udf(lambda x: time.sleep(5) or x, "long")
    threading.Timer(2.0, slow.abort).start()
    began = time.monotonic()
    with pytest.raises(control.Aborted, match="slow"):
        slow.run(spark.range(40), [("first", lambda d: d), ("slow", lambda d: d.select(sleepy("id").alias("id"))), ("never", lambda d: d)])
    assert time.monotonic() - began < 30 and slow.progress == [("first", 40)]
    assert spark.range(10).count() == 10  # other jobs go on


# ---------------------------------------------------------------- order statistics
def test_order_statistics(spark):
    rng = random.Random(5)
    rows = [(rng.choice("abc"), rng.choice([None, 1.0, 2.0, rng.random()]), rng.gauss(0, 1)) for _ in range(3000)] + [("one", None, 7.0), (None, 1.0, 1.0)]
    rows += [("hot", 5.0, float(k % 3)) for k in range(5000)]  # a value that many share
    d = spark.createDataFrame(rows, "g string, x double, y double").repartition(7)
    got = research.order_statistics(d, ["g"], ["x", "y"], {"low": lambda n: F.floor((n - 1) / 2), "p90": research.at_share(0.9)})
    for r in got.collect():
        for c, k in (("x", 1), ("y", 2)):
            v = sorted(t[k] for t in rows if t[0] == r.g and t[k] is not None)
            assert r[f"n_{c}"] == len(v)
            assert r[f"{c}_low"] == (v[(len(v) - 1) // 2] if v else None) and r[f"{c}_p90"] == (v[min(len(v) - 1, int(len(v) * 0.9))] if v else None)
    assert got.count() == 5
    assert "collect_list" not in got._jdf.queryExecution().toString()
    whole = research.order_statistics(d, [], ["y"], {"min": lambda n: n * 0}).collect()
    assert [tuple(r) for r in whole] == [(len(rows), min(t[2] for t in rows))]


def test_refit_rows_are_dealt(spark):
    rng = np.random.default_rng(6)
    z = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-z[:, 0]))).astype(float)
    d = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(z, y, strict=True)], "a double, b double, hit boolean")
    one, four = research.logistic_fit(d, ("a", "b"), 200), research.logistic_fit(d, ("a", "b"), 200, per_task=125)
    assert np.abs(np.array([*one[0], one[1]]) - np.array([*four[0], four[1]])).max() < 1e-12
    assert research.logistic_fit(d.where("a > 1e9"), ("a", "b"), 10) == ([0.0, 0.0], 0.0)


# ---------------------------------------------------------------- correlation
def test_strong_peers_compare_neighbours_only(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24)) * np.array([6, 5, 4, 3] + [0.3] * 20)
    rows = [(i, (centres[i % 12] + rng.normal(size=24) * 0.4).tolist()) for i in range(600)]
    rows += [(1000, None), (1001, [1.0] * 24), (1002, [1.0, 2.0, 4.0]), (1003, [*rows[0][1][:-1], None]), (1004, [float("nan")] * 24), (1005, [*rows[0][1]]), (1006, [1.0, 2.0, 4.5])]
    d = spark.createDataFrame(rows, "symbol long, v array<double>").repartition(5)
    pairs = lambda x: {(r.symbol, r.peer): r.r for r in x.collect()}
    got, want = pairs(correlation.strong_peers(d, 0.95, block=16)), pairs(correlation.vector_peers(d, 0.95))
    assert got.keys() == want.keys() and len(got) > 1000
    assert max(abs(got[k] - want[k]) for k in got) < 1e-12
    assert (1003, 1005) in got and (1002, 1006) in got
    share = correlation.compared_share(d.where("symbol < 600"), 0.95, block=16)
    print("compared share", share)
    assert share < 0.35
    assert correlation.strong_peers(d.where("symbol < 0"), 0.9).collect() == []


# ---------------------------------------------------------------- pages
def test_kline_pages_are_planned_by_symbol_and_time(spark, tmp_path):
    from wickframe.sources import bars as src
    from wickframe.sources import klines

    d = src.indexed(spark.createDataFrame([(s, "1h", t, o, h, lo, c, 1.0, 2.0, 3, 0.5) for s, t, o, h, lo, c in bars(230)], klines.SCHEMA))
    klines.write_pages(d, f"file://{tmp_path}/p", 50)
    reader = lambda **o: klines.PageReader({"path": f"file://{tmp_path}/p", **{k: str(v) for k, v in o.items()}})
    assert len(list(reader().pages())) == len(reader().partitions()) == 10
    assert len(reader(symbols="A").partitions()) == 5
    times = sorted(r.open_time_ms for r in d.where("symbol = 'A'").collect())
    assert [p.symbol for p in reader(symbols="A", from_ms=times[60], to_ms=times[110]).partitions()] == ["A", "A"]
    pushed = klines.FilteredPageReader({"path": f"file://{tmp_path}/p"})
    time_filter = klines.GreaterThan(("open_time_ms",), times[160])
    assert list(pushed.pushFilters([klines.EqualTo(("symbol",), "B"), time_filter])) == [time_filter] and len(pushed.partitions()) == 2
    assert reader(symbols="nobody").partitions()[0].file == "" and list(reader().read(klines.Page("", ""))) == []
    klines.register(spark)
    got = spark.read.format("kline_pages").option("path", f"file://{tmp_path}/p").option("tf", "1h").load()
    cols = [c.split()[0] for c in klines.SCHEMA.split(", ")]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, d.select(*cols).collect()))
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        some = spark.read.format("kline_pages").option("path", f"file://{tmp_path}/p").option("pushdown", "true").load().where(f"symbol = 'B' and open_time_ms > {times[160]}")
        assert some.count() == 69 and some.rdd.getNumPartitions() == 2
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
