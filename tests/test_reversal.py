import dataclasses

import pytest
from pyspark.sql import functions as F

from tests import series as S
from wickframe.config import PENALTIES, WEIGHTS, Config, load, merged, refresh_delay_ms, save, strictness
from wickframe.functions import scalar as sc
from wickframe.operators import funnel, reversal
from wickframe.sources.bars import BAR, indexed

FLAGS = ("lowSweep", "volumeReacted", "cvdImproved", "deltaImproved", "choch1h", "choch15m", "choch5m", "firstHH", "firstHL", "fvgCreated", "obCreated", "firstPushDone", "fvgReentry", "obReentry", "low5mDefended", "volumeReSurge", "rsiOverheated", *(s for s in reversal.ITEMS.values() if s != "absorbed"), *PENALTIES)


def scored(spark, absorption="strong", **on):
    names = list(dict.fromkeys(FLAGS))
    df = spark.createDataFrame([(*[bool(on.get(n, False)) for n in names], absorption)], ", ".join(f"{n} boolean" for n in names) + ", absorption string")
    return reversal.with_score(df, Config()).first()


def test_weights_and_bands():
    assert sum(WEIGHTS.values()) == 100 and set(reversal.ITEMS) == set(WEIGHTS)
    mins = [g[0] for g in Config().reversal.grades]
    assert mins == sorted(mins, reverse=True) and mins[-1] == 0
    assert strictness(9) == strictness(3) and [strictness(k)[0] for k in range(1, 6)] == [20, 25, 30, 40, 55]


def test_all_and_none(spark):
    best = scored(spark, **{s: True for s in reversal.ITEMS.values()})
    assert (best.score, best.grade, best.core_pct) == (100, "strong", 100.0) and best.top_signals == ["lowLiquiditySweep", "structureShift1h", "dropAndOversold"]
    none = scored(spark, "insufficient")
    assert (none.score, none.grade, none.stage) == (0, "excluded", 1)


def test_only_the_worst_of_a_group_counts(spark):
    on = {s: True for s in reversal.ITEMS.values()}
    r = scored(spark, **on, strongResistanceAbove=True, shortTargetDistance=True, poorRiskReward=True, tooLowVolume=True)
    assert [p.key for p in r.penalties] == ["tooLowVolume", "poorRiskReward"] and r.score == 80
    r = scored(spark, **on, strongResistanceAbove=True, shortTargetDistance=True)
    assert [p.key for p in r.penalties] == ["strongResistanceAbove"] and r.score == 92


@pytest.mark.parametrize(("on", "stage"), [(("farFromLowAtr", "fvgReentry", "choch5m", "volumeReSurge"), 5), (("fvgReentry", "choch5m", "volumeReSurge", "choch1h"), 4), (("choch1h", "firstHL", "fvgCreated"), 3), (("choch1h", "firstHL", "fvgCreated", "firstPushDone"), 1), (("lowSweep", "sweepRecovered", "volumeReacted", "deltaImproved"), 2)])
def test_stages(spark, on, stage):
    assert scored(spark, **dict.fromkeys(on, True)).stage == stage


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_plans_mirror(spark):
    cfg, lit = Config(), lambda x: F.lit(x).cast("double")
    long = one(spark, p=reversal.plan(lit(100), "long", [lit(97), lit(99.5), lit(120), lit(None)], lit(95), lit(2), [lit(None), lit(110), lit(130)], cfg)).p
    short = one(spark, p=reversal.plan(lit(100), "short", [lit(103), lit(100.5), lit(80), lit(None)], lit(105), lit(2), [lit(None), lit(90), lit(70)], cfg)).p
    assert (long.entry, long.stop, long.tp2, long.valid) == (99.5, 94.0, 110, True) and long.risk_reward == pytest.approx(10.5 / 5.5)
    for k in ("entry", "stop", "tp1", "tp2", "tp3"):
        assert long[k] + short[k] == pytest.approx(200)
    assert long.risk_reward == pytest.approx(short.risk_reward)


def test_position_money(spark):
    costs, lit = Config().costs, lambda x: F.lit(float(x))
    m = one(spark, m=sc.position_money(lit(100), lit(90), lit(140), F.lit(True), 1_000_000, costs)).m
    assert (m.loss, m.partial, m.gain, m.liquidated) == (-102_000, 48_000, 248_000, False)
    m = one(spark, m=sc.position_money(lit(100), lit(62), lit(252), F.lit(True), 1_000_000, costs, 3)).m
    assert m.loss == -1_000_000 and m.liquidated and m.max_safe_leverage == 2
    assert one(spark, m=sc.position_money(lit(100), lit(90), lit(140), F.lit(False), 1_000_000, costs)).m is None


def test_texts(spark):
    r = one(spark, a=sc.price_text(F.lit(0.00012345)), b=sc.price_text(F.lit(1234.5)), c=sc.pct_text(F.lit(1.234)), d=sc.volume_text(F.lit(120_300_000.0)), e=sc.price_text(F.lit(None).cast("double")), f=sc.html_escaped(F.lit("<a&'>")), g=sc.chart_url("http://x/", F.lit("A B")))
    assert r[:] == ("0.00012345", "1,234.50", "+1.23%", "120.30M", "-", "&lt;a&amp;&#39;&gt;", "http://x/A+B")


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert load(path) == Config()
    mine = merged({"early": {"pumped": 25}, "unknown": 1})
    save(mine, path)
    assert load(path) == mine and mine.early.pumped == 25 and mine.early.box == 60
    assert (refresh_delay_ms(90_000, False), refresh_delay_ms(1000, False), refresh_delay_ms(90_000, True)) == (90_000, 30_000, 360_000)


def test_scan_end_to_end(spark):
    rows = []
    for k, symbol in enumerate(("AA", "BB", "CC")):
        for j, tf in enumerate(("4h", "1h", "15m", "5m")):
            rows += [(symbol, tf, *r[2:]) for r in S.walk(250 if symbol != "CC" or tf != "5m" else 20, 10 * k + j)]
    bars = indexed(spark.createDataFrame(rows, BAR))
    symbols = spark.createDataFrame([("AA", 1e9, False), ("BB", 1e3, True), ("CC", 1e9, False)], "symbol string, quote_volume double, new_listing boolean")
    cfg = dataclasses.replace(Config(), reversal=dataclasses.replace(Config().reversal, core_min=0.0))
    got = {r.symbol: r for r in reversal.results(bars, symbols, cfg).collect()}
    assert set(got) == {"AA", "BB"}  # CC has too few bars on one interval
    for r in got.values():
        assert 0 <= r.score <= 100 and set(r.timeframes) == {"4h", "1h", "15m", "5m"}
        want = max(0, min(100, sum(x.got for x in r.breakdown) + sum(p.val for p in r.penalties)))
        assert r.score == want and r.plan.risk_reward >= 0
    assert any(p.key == "newListingThin" for p in got["BB"].penalties)
    view = funnel.view(reversal.results(bars, symbols, cfg), cfg, min_score=0, hide_noisy=False, hide_new=False)
    assert [r["rank"] for r in view.orderBy("rank").collect()] == list(range(1, view.count() + 1))
