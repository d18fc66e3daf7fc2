"""Registered queries and the operators behind them do the whole job, not a part of it."""

import random

import numpy as np
import pytest

from tests import series as S
from wickframe.operators import correlation, funnel, research, structure
from wickframe.operators import indicators as ind
from wickframe.plans.queries import QUERIES, TAPE, rows
from wickframe.sources import bars as src

SMALL = "/root/testdata/sf0.001"


def test_all_vectors_are_correlated(spark):
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").toPandas()
    r = np.corrcoef(np.array(e.embedding.tolist(), float))
    want = {(int(e.vec_id[i]), int(e.vec_id[j])): r[i, j] for i, j in zip(*np.nonzero(r >= 0.2), strict=True) if i != j}
    pairs = correlation.vector_peers(spark.read.parquet(f"{SMALL}/embeddings.parquet").selectExpr("vec_id as symbol", "embedding as v"), 0.2)
    got = {(x.symbol, x.peer): x.r for x in pairs.collect()}
    assert got.keys() == want.keys() and max(a for a, _ in want) >= 40
    assert all(abs(got[k] - want[k]) < 1e-6 for k in want)
    by_vector = {int(k): [x for (a, _), x in want.items() if a == k] for k in e.vec_id}
    found = {x.symbol: x for x in QUERIES["correlated_vectors"](spark, SMALL).collect()}
    assert found.keys() == by_vector.keys()
    for k, rs in by_vector.items():
        assert found[k].links == len(rs) and found[k].class_id == k
        assert not rs or abs(found[k].strongest - max(rs)) < 1e-6 and abs(found[k].mean_r - sum(rs) / len(rs)) < 1e-6


def test_vector_peers_equal_pairs_of_positions(spark):
    """Over several blocks, with vectors of other lengths, constant and missing ones."""
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(rng.choice([8, 8, 6]))]) for i in range(40)] + [(40, [1.0] * 8), (41, [1.0]), (42, []), (43, None)]
    d = spark.createDataFrame(rows, "symbol long, v array<double>")
    p = correlation.peers(correlation.pairs(d.selectExpr("symbol", "posexplode(v) as (pos, ret)")), 0.3)
    want = {(x.symbol, x.peer): x.r for x in p.collect()}
    for block in (7, 4096):
        rows = correlation.vector_peers(d, 0.3, block).collect()
        got = {(x.symbol, x.peer): x.r for x in rows}
        assert len(rows) == len(got) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_candidates_are_the_largest_of_all_bars(spark):
    d = funnel.stage3(src.daily(spark, SMALL), TAPE).where("long or short").select("symbol", "bar_idx", "open_time_ms", "change_6").collect()
    want = sorted(d, key=lambda x: (-abs(x.change_6), x.symbol, x.bar_idx))[: TAPE.candidate.keep]
    got = {(x.symbol, x.open_time_ms) for x in QUERIES["candidates"](spark, SMALL).collect()}
    assert len(want) == TAPE.candidate.keep and got == {(x.symbol, x.open_time_ms) for x in want}


def gap_status(bars, g):
    """By walking through the later bars."""
    deep = 0.0
    for b in bars[g.bar_idx + 1 :]:
        bull = g.side == "bullish"
        if b.low <= g.gap_low if bull else b.high >= g.gap_high:
            return "inverse" if (b.close < g.gap_low if bull else b.close > g.gap_high) else "filled"
        deep = max(deep, g.gap_high - b.low if bull else b.high - g.gap_low)
    part = deep / g.size
    return "filled" if part >= 0.99 else "partial" if part > 0.05 else "open"


@pytest.mark.parametrize("n", [300, 9000])
def test_gaps_equal_the_walk(spark, n):
    rows = S.walk(n, 8)
    jumps = random.Random(n)
    rows = [(*r[:3], *[x * f for x in r[3:7]], *r[7:]) for r in rows for f in [1 + 0.2 * jumps.random()]]
    d = ind.with_atr(S.frame(spark, rows))
    bars = d.orderBy("bar_idx").collect()
    got = structure.gaps(d).collect()
    assert len(got) > n / 50 and len({g.status for g in got}) >= 2
    assert [g.status for g in got] == [gap_status(bars, g) for g in got]


def test_gaps_and_blocks_of_all_bars(spark):
    daily = src.daily(spark, SMALL)
    bars = {}
    for b in daily.orderBy("symbol", "bar_idx").collect():
        bars.setdefault(b.symbol, []).append(b)
    at = {(b.symbol, b.open_time_ms): b.bar_idx for x in bars.values() for b in x}
    early = lambda rows: sum(at[r.symbol, r.open_time_ms] < len(bars[r.symbol]) - 260 for r in rows)
    d = ind.with_atr(daily)
    want = {(g.symbol, g.open_time_ms, g.side, gap_status(bars[g.symbol], g)) for g in structure.gaps(d).collect()}
    rows = QUERIES["gaps"](spark, SMALL).collect()
    assert early(rows) > 0 and {(r.symbol, r.open_time_ms, r.side, r.status) for r in rows} == want
    rows = QUERIES["order_blocks"](spark, SMALL).collect()
    assert early(rows) > 0
    for r in rows:
        closes = [b.close for b in bars[r.symbol][at[r.symbol, r.open_time_ms] + 1 :]]
        assert r.invalidated == any(c < r.bottom - 1e-6 if r.side == "bullish" else c > r.top + 1e-6 for c in closes)


def descent(z, y, rounds=4000, rate=0.3, l2=1e-3):
    """The reference's fit."""
    w, b = np.zeros(z.shape[1]), 0.0
    for _ in range(rounds):
        e = 1 / (1 + np.exp(-(z @ w + b))) - y
        w, b = w - rate * (z.T @ e / len(y) + l2 * w), b - rate * e.mean()
    return np.array([*w, b])


def test_fit_goes_all_the_way(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(800, 3))
    z[:, 1] = 0.8 * z[:, 0] + 0.6 * z[:, 1]
    y = (rng.random(800) < 1 / (1 + np.exp(-(2.0 * z[:, 0] - 1.5 * z[:, 2] - 2)))).astype(float)
    d = spark.createDataFrame([(*map(float, r), bool(t)) for r, t in zip(z, y, strict=True)], "a double, b double, c double, hit boolean")
    w, b = research.logistic_fit(d, ("a", "b", "c"))
    assert np.abs(np.array([*w, b]) - descent(z, y)).max() < 1e-9 < np.abs(descent(z, y, 30) - descent(z, y)).max()


def test_refit_of_the_tape(spark):
    """Against the reference's fit of the same rows, at sf0.01."""
    d = "/root/testdata/sf0.01"
    got = [r.weight for r in QUERIES["logistic_refit"](spark, d).collect()]
    cols = QUERIES["feature_zscores"](spark, d).columns[2:]
    t = research.standardised(research.features(research.split(rows(spark, d)))).where("train").select(*cols, "hit").toPandas()
    z, y = t[cols].to_numpy(float), t.hit.to_numpy(float)
    want = descent(z, y)
    print("largest difference", np.abs(np.array(got) - want).max(), "after 30 rounds", np.abs(descent(z, y, 30) - want).max(), len(y), y.mean())
    assert np.abs(np.array(got) - want).max() < 1e-9
