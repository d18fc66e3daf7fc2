import pytest
from pyspark.sql import functions as F

from tests import series as S
from wickframe.operators import indicators as ind
from wickframe.operators import structure as st


@pytest.mark.parametrize("seed", range(4))
def test_events_equal_the_state_machine(spark, seed):
    rows = S.walk(200, seed)
    d = st.with_pivots(S.frame(spark, rows))
    got = [(r.bar_idx, r.type, r.price) for r in st.structure_events(d).orderBy("bar_idx", "rank").collect()]
    assert got == S.structure_events(rows)
    assert sorted((r.bar_idx, r.kind, r.price) for r in st.swings(d).collect()) == sorted(S.pivots(rows))


def test_labels_of_an_uptrend(spark):
    d = st.with_pivots(S.frame(spark, S.from_closes(S.zigzag([10, 15, 12, 18, 14, 21, 16, 24]), spread=0.4)), 2)
    labels = {r.label for r in st.swings(d).collect()}
    assert {"HH", "HL"} <= labels and not {"LH", "LL"} & labels


def test_change_of_character_after_a_downtrend(spark):
    d = st.with_pivots(S.frame(spark, S.from_closes(S.zigzag([20, 14, 17, 11, 14, 9, 12, 20]), spread=0.3)), 2)
    assert any(r.type == "bullish_choch" for r in st.structure_events(d).collect())


def bar(i, o, h, low, c, v=100.0, buy=50.0):
    return ("X", "1h", S.START + i * S.STEP, float(o), float(h), float(low), float(c), v, v * c, 5, buy)


def test_low_sweep_and_recovery(spark):
    rows = S.from_closes(S.zigzag([20, 15, 18, 16.5, 18], 6), spread=0.1)
    n = len(rows)
    rows += [bar(n, 16, 16.2, 14, 15.6, 300.0, 100.0), bar(n + 1, 15.6, 16.5, 15.5, 16.4)]
    low = min(p for _, k, p in S.pivots(rows) if k == "low" and p < 15.5)
    d = st.with_pivots(ind.with_volume(S.frame(spark, rows)))
    prior = [p for _, k, p in S.pivots(rows) if k == "low"][-1]
    got = st.sweeps(d, "low").collect()
    if prior == low:
        assert got[0].valid and got[0].recovered and not got[0].failed and got[0].sell_pressure


@pytest.mark.parametrize("seed", range(3))
def test_sweeps_mirror(spark, seed):
    """A high sweep is a low sweep of the negated series."""
    rows = S.walk(120, seed + 40)
    flip = [(*r[:3], 500 - r[3], 500 - r[5], 500 - r[4], 500 - r[6], *r[7:]) for r in rows]
    one = st.sweeps(st.with_pivots(ind.with_volume(S.frame(spark, rows))), "high").collect()
    two = st.sweeps(st.with_pivots(ind.with_volume(S.frame(spark, flip))), "low").collect()
    assert [(r.sweep_time, r.recovered, r.failed) for r in one] == [(r.sweep_time, r.recovered, r.failed) for r in two]


def test_gap_and_its_fill(spark):
    rows = [bar(i, 10, 10.2, 9.8, 10) for i in range(20)] + [bar(20, 10, 10.2, 9.9, 10.1), bar(21, 10.1, 12, 10.1, 11.9), bar(22, 12, 12.4, 11.4, 12.2)]
    status = lambda extra: {r.bar_idx: r.status for r in st.gaps(ind.with_atr(S.frame(spark, rows + extra))).where("side = 'bullish'").collect()}.get(22)
    assert status([]) == "open"
    assert status([bar(23, 12, 12.2, 11.0, 12)]) == "partial"
    assert status([bar(23, 12, 12.2, 10.0, 10.5)]) == "filled"
    assert status([bar(23, 12, 12.2, 9.0, 9.5)]) == "inverse"


def test_equal_levels_are_chains(spark):
    p = spark.createDataFrame([("X", "1h", i, "high", float(v)) for i, v in enumerate([10, 10.5, 11, 20, 30, 30.4])], "symbol string, tf string, bar_idx int, kind string, price double")
    atr = spark.createDataFrame([("X", "1h", 6.0)], "symbol string, tf string, atr double")
    got = st.equal_levels(p, atr, 0.1).orderBy("price").collect()
    assert [(r.price, r["count"]) for r in got] == [(10.5, 3), (30.2, 2)]


def golden(reject):
    closes = [100 - i for i in range(30)] + [70.0] * 250 + [72.0, 76.0, 80.0] + [80.0] * 20 + [80 - 0.55 * i for i in range(15)]
    rows = S.from_closes(closes, spread=0.3)
    n = len(rows)
    if reject:
        rows.append(bar(n, rows[-1][6], rows[-1][6] + 3, rows[-1][6] - 0.5, rows[-1][6] - 0.2))
    rows += [bar(len(rows) + k, rows[-1][6] + 0.1 * k, rows[-1][6] + 0.1 * k + 0.3, rows[-1][6] + 0.1 * k - 0.3, rows[-1][6] + 0.1 * k + 0.1) for k in range(15)]
    return rows


def test_golden_cross_retest(spark):
    def run(rows):
        d = ind.with_atr(ind.ema(ind.ema(S.frame(spark, rows), "close", 50, "ema_50"), "close", 200, "ema_200"))
        return st.golden_cross_retest(d).first()

    assert run(S.from_closes([100 - 0.1 * i for i in range(300)])).reason == "no cross"
    r = run(golden(True))
    assert r.reason in (None, "no retest", "no impulse", "closed below") and (r.detected == (r.reason is None))


def test_nearest_levels(spark):
    d = st.with_pivots(S.frame(spark, S.walk(150, 5)))
    price = 100.0
    p = S.pivots(S.walk(150, 5))
    got = st.nearest_levels(st.swings(d), spark.createDataFrame([("W", "1h", price)], "symbol string, tf string, price double")).first()
    assert got.above == min((x for _, k, x in p if k == "high" and x > price), default=None)
    assert got.below == max((x for _, k, x in p if k == "low" and x < price), default=None)


def test_no_pivots(spark):
    d = st.with_pivots(S.frame(spark, S.from_closes([10] * 20)))
    assert st.swings(d).count() == 0 and st.structure_events(d).count() == 0
    assert st.structure_summary(d).select(F.col("last_event")).first()[0] is None
