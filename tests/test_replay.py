import math
import random

import pytest
from pyspark.sql import functions as F

from tests import series as S
from wickframe.operators import correlation, replay, research


def trades(spark, rows, hold=40):
    bars = S.frame(spark, rows)
    n = len(rows)
    sig = bars.where((F.col("bar_idx") % 7 == 0) & (F.col("bar_idx") < n - 2)).select("symbol", "tf", "bar_idx", "open_time_ms")
    return replay.with_paths(sig, bars, hold).withColumn("risk", F.col("fill") * 0.03)


@pytest.mark.parametrize("seed", range(3))
def test_exits_equal_the_bar_by_bar_rules(spark, seed):
    rows = S.walk(300, seed + 9)
    got = replay.with_trailing_exit(replay.with_partial_exit(trades(spark, rows), 4.0, 0.002), 0.002).collect()
    assert len(got) == len([i for i in range(0, 298, 7)])
    for t in got:
        risk = rows[t.bar_idx + 1][3] * 0.03
        for name, rule in (("partial", S.partial_exit), ("trail", S.trailing_exit)):
            r, why, k = rule(rows, t.bar_idx, risk, 40)
            assert (t[name].why, t[name].k) == (why, k) and math.isclose(t[name].r, r, abs_tol=1e-9)


def test_stop_comes_first(spark):
    rows = [("X", "1h", i, 100.0, 100.5, 99.5, 100.0, 1.0, 1.0, 1, 0.5) for i in range(4)]
    rows[2] = ("X", "1h", 2, 100.0, 200.0, 50.0, 100.0, 1.0, 1.0, 1, 0.5)
    bars = S.frame(spark, rows)
    t = replay.with_paths(bars.where("bar_idx = 0").select("symbol", "tf", "bar_idx"), bars, 3).withColumn("risk", F.lit(10.0))
    assert replay.with_fixed_exit(t, 4.0, 0.0).first().fixed.why == "stop"


def test_cooldown_is_greedy(spark):
    rng = random.Random(2)
    rows, kept, until = [], [], -1
    for i in range(0, 300, 3):
        x = i + rng.randint(1, 25)
        rows.append(("X", "1h", i, x))
        if i > until:
            kept.append(i)
            until = x
    got = replay.cooled(spark.createDataFrame(rows, "symbol string, tf string, bar_idx int, exit_k int"))
    assert sorted(r.bar_idx for r in got.collect()) == kept


def test_stats_and_drawdown(spark):
    t = spark.createDataFrame([("X", i, r, "stop") for i, r in enumerate([1.0, -1.0, -1.0, 3.0, -0.5])], "symbol string, bar_idx int, r double, why string")
    s = replay.trade_stats(t, "symbol").first()
    assert (s.n, s.win_pct, s.total_r, s.profit_factor) == (5, 40.0, 1.5, 1.6)
    assert replay.drawdown(t, "symbol").first().max_drawdown == -2


def test_as_of(spark):
    left = spark.createDataFrame([("A", 5, 1), ("A", 10, 2), ("B", 7, 3)], "symbol string, ms long, id int")
    rates = spark.createDataFrame([("A", 6, 0.1), ("A", 10, 0.2), ("A", 11, 0.3)], "symbol string, ms long, rate double")
    assert {r.id: r.rate for r in replay.as_of(left, rates).collect()} == {1: None, 2: 0.2, 3: None}


def test_paper_log(spark):
    bars = spark.createDataFrame([("A", 100, 199, 101.0, 99.0, 100.0), ("A", 200, 299, 150.0, 80.0, 120.0), ("A", 300, 399, 500.0, 1.0, 300.0)], "symbol string, open_time_ms long, close_time_ms long, high double, low double, close double")
    log = spark.createDataFrame([(1, "A", 50, 100.0, 90.0, 140.0, "open"), (2, "A", 150, 100.0, 50.0, 140.0, "open"), (3, "B", 50, 100.0, 90.0, 140.0, "open")], "id int, symbol string, at_ms long, entry double, stop double, tp2 double, state string").drop("state")
    got = {r.id: (r.state, r.r) for r in replay.paper_resolved(log, bars, 299).collect()}
    assert got == {1: ("loss", -1.0), 2: ("win", 0.8), 3: ("open", 0.0)}


def test_labels_look_only_ahead(spark):
    rows = S.walk(200, 4)
    d = replay.with_labels(S.frame(spark, rows)).collect()
    for r in d:
        i = r.bar_idx
        best = [(rows[k + 6][6] / rows[k][6] - 1) * 100 for k in range(i + 1, min(i + 37, 194))]
        assert (r.best_change is None) == (not best) and (not best or math.isclose(r.best_change, max(best), rel_tol=1e-9))


def test_correlation_of_copies_and_mirrors(spark):
    a = S.walk(60, 1, "A")
    b = [("B", *r[1:]) for r in a]
    c, px = [], 100.0
    for r, p in zip(a[1:], a, strict=False):
        px *= 1 - (r[6] / p[6] - 1)
        c.append(("C", *r[1:6], px, *r[7:]))
    got = {(r.a, r.b): r.r for r in correlation.pairs(correlation.returns(S.frame(spark, a + b + c), 42)).collect()}
    assert got["A", "B"] == pytest.approx(1) and got["A", "C"] == pytest.approx(-1)


def test_lift_and_split(spark):
    rows = spark.createDataFrame([(i, i // 10, f"S{i}", float(i), i % 4 == 0) for i in range(100)], "ms int, day int, symbol string, score double, hit boolean")
    assert {r.predicate: r.lift for r in research.lift_table(rows, {"all": F.expr("true"), "hits": F.expr("hit")}, 1).collect()} == {"all": 1.0, "hits": 4.0}
    assert research.split(rows).where("train").count() == 70


def test_quantiles_and_tiers(spark):
    rows = spark.createDataFrame([(float(i), float(i)) for i in range(4)], "a double, b double")
    assert research.tiers(rows, "a", ["b"]).select("median_b", "upper_b").first()[:] == (1.5, 2.0)
    assert rows.agg(research.nearest_rank("b", 0.5)).first()[0] == 2


def test_window_before_a_move(spark):
    moves = spark.createDataFrame([("A", 100), ("B", 100), ("C", 5)], "symbol string, move_ms long")
    series = spark.createDataFrame([("A", t, float(t)) for t in range(40, 140, 10)] + [("B", 90, 1.0)], "symbol string, ms long, value double")
    got = {r.symbol: (r.n, r.change, r["mean"]) for r in research.window_change(moves, series, 50, 5).collect()}
    assert got == {"A": (6, 100.0, 75.0), "B": (1, None, None), "C": (0, None, None)}
