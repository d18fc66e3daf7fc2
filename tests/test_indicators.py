import math

import pytest
from pyspark.sql import functions as F

from tests import series as S
from wickframe.operators import indicators as ind


def close(a, b, tol=1e-8):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert (x is None) == (y is None), (x, y)
        assert x is None or math.isclose(x, y, rel_tol=tol, abs_tol=tol), (x, y)


def test_sma_and_ema_seed(spark):
    df = S.frame(spark, S.from_closes([1, 2, 3, 4, 5]))
    assert S.column(df.withColumn("s", ind.sma("close", 3)), "s") == [None, None, 2, 3, 4]
    assert S.column(ind.ema(df, "close", 3, "e"), "e")[2] == 2


@pytest.mark.parametrize("p", [5, 20, 50])
def test_ema_equals_recursion(spark, p):
    rows = S.walk(300, p)
    close(S.column(ind.ema(S.frame(spark, rows), "close", p, "e"), "e"), S.ema([r[6] for r in rows], p))


def test_smoothing_in_blocks_equals_recursion(spark):
    """So many bars that one block would overflow: alpha 0.9 ends a block after 260."""
    rows = S.walk(1200, 3)
    df = ind.smooth(S.frame(spark, rows), F.col("close"), F.col("bar_idx"), 0.9, "e")
    e, want = None, []
    for r in rows:
        e = r[6] if e is None else 0.9 * r[6] + 0.1 * e
        want.append(e)
    close(S.column(df, "e"), want)


def test_rsi_and_atr(spark):
    rows = S.walk(200, 1)
    df = S.frame(spark, rows)
    close(S.column(ind.with_rsi(df), "rsi"), S.rsi([r[6] for r in rows]))
    tr = [rows[0][4] - rows[0][5]] + [max(b[4] - b[5], abs(b[4] - a[6]), abs(b[5] - a[6])) for a, b in zip(rows, rows[1:], strict=False)]
    close(S.column(ind.with_atr(df), "atr"), S.wilder(tr, 14))


@pytest.mark.parametrize(("closes", "want"), [(range(1, 40), 100.0), (range(40, 1, -1), 0.0), ([5] * 40, 100.0)])
def test_rsi_extremes(spark, closes, want):
    assert S.column(ind.with_rsi(S.frame(spark, S.from_closes(list(closes)))), "rsi")[-1] == pytest.approx(want)


def test_constant_range_gives_atr_2(spark):
    rows = [("X", "1h", i, 10.0, 11.0, 9.0, 10.0, 1.0, 10.0, 1, 0.5) for i in range(30)]
    assert S.column(ind.with_atr(S.frame(spark, rows)), "atr")[-1] == pytest.approx(2)


def test_box_of_six_closes(spark):
    rows = [("X", "1h", i, float(c), float(c), float(c), float(c), 1.0, 1.0, 1, 0.5) for i, c in enumerate([10, 20, 12, 18, 11, 19])]
    r = ind.with_box(S.frame(spark, rows), 6).orderBy(F.desc("bar_idx")).first()
    assert (r.box_high, r.box_low, round(r.box_width, 2), r.range_pos) == (20, 10, 66.67, 0.9)


@pytest.mark.parametrize(("widths", "want"), [([5, 4, 3, 2, 1], 0), ([1, 2, 3, 4, 5], 80)])
def test_squeeze(spark, widths, want):
    rows = S.from_closes(widths)
    df = S.frame(spark, rows).withColumn("bb_width", F.col("close"))
    assert S.column(ind.with_squeeze(df, 5), "squeeze")[-1] == want


def test_vwap_starts_anew_each_day(spark):
    day = 86_400_000
    rows = [("X", "1h", t, 1.0, p, p, p, v, 1.0, 1, 0.5) for t, p, v in ((0, 10.0, 1.0), (1, 20.0, 1.0), (day, 30.0, 0.0), (day + 1, 40.0, 2.0))]
    assert S.column(ind.with_vwap(S.frame(spark, rows)), "vwap") == [10, 15, None, 40]


def test_nothing_looks_ahead(spark):
    """Values of a prefix are those of the whole series."""
    rows = S.walk(260, 8)

    def values(part):
        d = S.frame(spark, part)
        d = ind.with_choppiness(ind.with_stoch_rsi(ind.with_macd(ind.with_squeeze(ind.with_bollinger(ind.with_volume(ind.with_cvd(ind.with_obv(d))))))))
        d = ind.with_dry_ratio(ind.with_momentum(ind.with_breakout(ind.with_box(d))))
        names = ["macd_signal", "stoch_d", "squeeze", "rel_volume_5", "cvd_slope", "obv", "choppiness", "vol_expand", "momentum", "breakout_level", "range_pos"]
        return [[r[n] for n in names] for r in d.orderBy("bar_idx").collect()]

    short, whole = values(rows[:170]), values(rows)
    for a, b in zip(short, whole, strict=False):
        close(a, b)


def test_empty_series(spark):
    assert ind.with_rsi(S.frame(spark, [])).count() == 0
