import pandas as pd
from pyspark.sql import functions as F

from wickframe.sources import bars as src
from wickframe.streaming import bars as stream


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    rows = [(("A", "B")[k % 2], k * 600_000, k, 100.0 + (k * 7) % 13, 1.0 + k % 3, k % 2 == 0) for k in range(600)]
    t = spark.createDataFrame(rows, "symbol string, ms long, seq long, price double, quantity double, buy boolean").withColumn("turnover", F.col("price") * F.col("quantity"))
    t.withColumn("ts", F.timestamp_millis("ms")).repartition(3).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    q = stream.closed_bars(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.symbol, r.open_time_ms): (r.open, r.close, r.high, r.low, r.volume, r.trades) for r in spark.table("bars_out").collect()}
    want = {(r.symbol, r.open_time_ms): (r.open, r.close, r.high, r.low, r.volume, r.trades) for r in src.bars_of_trades(t, "4h", 14_400_000).collect()}
    last = max(t for _, t in want)
    assert got == {k: v for k, v in want.items() if k[1] < last}  # the newest bar is not over yet


def test_trade_machine(spark, tmp_path):
    rows = [("A", 1, 10.0, 9.0, 10.0, True, 9.0, 12.0), ("A", 2, 10.5, 9.5, 10.0, True, 9.0, 12.0), ("A", 3, 12.5, 8.0, 10.0, False, 9.0, 12.0), ("A", 4, 10.0, 9.0, 10.0, True, 9.0, 12.0), ("A", 5, 10.0, 9.5, 10.0, True, 9.0, 12.0), ("A", 6, 13.0, 9.5, 12.0, False, 9.0, 12.0)]
    schema = "symbol string, open_time_ms long, high double, low double, close double, enter boolean, stop double, target double"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = stream.trade_machine(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), cooldown=1).writeStream.format("memory").queryName("trades_out").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = [(r.event, r.open_time_ms, r.price, r.r) for r in spark.table("trades_out").orderBy("open_time_ms").collect()]
    assert got == [("enter", 1, 10.0, 0.0), ("stop", 3, 9.0, -1.0), ("enter", 5, 10.0, 0.0), ("target", 6, 12.0, 2.0)]
    assert isinstance(pd.DataFrame(got), pd.DataFrame)
