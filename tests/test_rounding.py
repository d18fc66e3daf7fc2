"""Rows at the edge of a rounding are where the SQL has them."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from wickframe.functions import scalar as sc
from wickframe.plans import registry
from wickframe.sources import bars as src


def from_sql(name, **tables):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for table, path in tables.items():
        con.sql(f"create view {table} as select * from read_parquet('{path}/*.parquet')")
    return con.sql(registry.ORACLE_SQL[name])


@pytest.fixture(scope="module")
def tape(spark, tmp_path_factory):
    """120 hours of trades; some come in the last half millisecond of an hour, or in another order than their ids within one."""
    start, rows = dt.datetime(2024, 1, 1), []
    for k in range(120):
        hour = start + dt.timedelta(hours=k)
        for us in (400, 1_800_000_000, 3_599_998_900, 3_599_999_200, 3_599_999_700)[: 4 + k % 2]:
            n = len(rows)
            rows.append((n if us != 3_599_998_900 else n + 10_000, hour + dt.timedelta(microseconds=us), n % 7, "view", 100.0 + 7 * (n % 13), f'{{"k": {n % 11 + 1}}}'))
    folder = str(tmp_path_factory.mktemp("tape"))
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["bars_1h", "vwap_daily", "streamed_higher", "streamed_trades"])
def test_times_round_to_the_nearest_millisecond(spark, tape, name):
    want = from_sql(name, events=f"{tape}/events.parquet")
    got = registry.QUERIES[name](spark, tape).select(*want.columns)
    rows = sorted(map(tuple, got.collect()))
    assert len(rows) == len(want.fetchall()) and rows == sorted(want.fetchall())
    assert rows or name == "streamed_trades"


def test_millis_of_times_before_1970(spark):
    micros = [-1_000_500, -1_000_499, -500, -499, 499, 500, 1_499, 1_500, 253_402_300_799_999_600]
    d = spark.createDataFrame([(x,) for x in micros], "us long").select("us", F.timestamp_micros("us").alias("ts")).select("us", src.millis("ts").alias("ms"))
    con = duckdb.connect()
    want = {x: con.sql(f"select epoch_ms(make_timestamp({x}::bigint))").fetchall()[0][0] for x in micros}
    assert {x.us: x.ms for x in d.collect()} == want


def test_a_change_that_rounds_to_zero_has_no_sign(spark, tmp_path):
    change = spark.createDataFrame([(0.004,), (-0.004,), (0.005,), (0.0,), (-0.006,)], "x double").select(sc.pct_text(F.col("x")).alias("t"))
    assert [x.t for x in change.collect()] == ["0.00%", "0.00%", "+0.01%", "0.00%", "-0.01%"]
    day = dt.datetime(2000, 1, 1)
    lines = [(k, 1, 1, k % 2 + 1, 1.0, p, 0.0, 0.0, "A", "F", day + dt.timedelta(days=k // 2)) for k, p in enumerate([90_000.0, 90_001.5, 90_000.0, 89_998.5, 100.0, 200.0])]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    spark.createDataFrame(lines, schema).write.parquet(str(tmp_path / "lineitem.parquet"))
    want = from_sql("number_texts", lineitem=tmp_path / "lineitem.parquet")
    assert sorted(map(tuple, registry.QUERIES["number_texts"](spark, str(tmp_path)).select(*want.columns).collect())) == sorted(want.fetchall())
