"""A log of paper trades that batches of events are merged into, each once.

A version is a table of its own; a version counts once it is committed, by a row with the batch that made it.  A batch
that comes again, after a failure between the two or after a restart of its stream, changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

RECORD = "id string, symbol string, at_ms long, entry double, stop double, target double, state string, exit_ms long"
#: kind: open (with the plan) or close (with the state it ends in).
EVENT = "kind string, ms long, id string, symbol string, entry double, stop double, target double, state string"
COMMIT = "version long, batch long"


class PaperLog:
    """The log in a folder.  A symbol has at most one open record: while there is one, further ones don't count."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def commits(self, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self._spark
        try:
            return spark.read.schema(COMMIT).parquet(f"{self._folder}/commits/*")
        except AnalysisException:  # there is none yet
            return spark.createDataFrame([], COMMIT)

    def read(self, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self._spark
        last = self.commits(spark).agg(F.max("version")).first()[0]
        if last is None:
            return spark.createDataFrame([], RECORD)
        return spark.read.schema(RECORD).parquet(f"{self._folder}/version-{last}")

    def merge(self, events: DataFrame, batch: int) -> None:
        """For foreachBatch.  Of one time, what closes comes before what opens, then by id."""
        spark = events.sparkSession  # a stream's batches have a session of their own
        done = self.commits(spark)
        if done.where(F.col("batch") == batch).limit(1).count():
            return
        version = 1 + (done.agg(F.max("version")).first()[0] or 0)
        merged(self.read(spark), events).write.mode("overwrite").parquet(f"{self._folder}/version-{version}")
        spark.createDataFrame([(version, batch)], COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self._folder}/commits/{version}")


def merged(log: DataFrame, events: DataFrame) -> DataFrame:
    """The log after the events (kind, ms, id, symbol, ...), which are folded by symbol in order of time: one that opens
    counts if the symbol has no open record, one that closes if the record of its id is the open one.  A fold sees a
    symbol's events of one batch and its open record.  An id opens once."""
    known = events.where("kind = 'open'").join(log.select("id"), "id", "left_semi").select("id").distinct()
    events = events.join(known.withColumn("_known", F.lit(True)), "id", "left").where("kind = 'close' or _known is null").drop("_known")
    one = F.struct(F.col("ms").alias("ms"), (F.col("kind") == "open").alias("opens"), F.col("id").alias("id"))
    now = log.where("state = 'open'").select("symbol", F.col("id").alias("now"))
    by = events.groupBy("symbol").agg(F.array_sort(F.collect_list(one)).alias("e")).join(now, "symbol", "left")
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(F.col("now").alias("now"), none.alias("opened"), none.alias("closed"))
    also = lambda c, x: F.concat(c, F.array(x))

    def step(a, x):
        opened = F.struct(x["id"].alias("now"), also(a["opened"], x["id"]).alias("opened"), a["closed"].alias("closed"))
        closed = F.struct(F.lit(None).cast("string").alias("now"), a["opened"].alias("opened"), also(a["closed"], x["id"]).alias("closed"))
        return F.when(x["opens"] & a["now"].isNull(), opened).when(~x["opens"] & a["now"].eqNullSafe(x["id"]), closed).otherwise(a)

    folded = by.select("symbol", F.aggregate("e", start, step).alias("f"))
    opened = folded.select("symbol", F.explode("f.opened").alias("id"))
    closed = folded.select("symbol", F.explode("f.closed").alias("id"))
    plain = events.where("kind = 'open'").join(opened, ["symbol", "id"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("id").orderBy("ms"))
    plain = plain.withColumn("_n", nth).where("_n = 1")
    fresh = plain.select("id", "symbol", F.col("ms").alias("at_ms"), "entry", "stop", "target", F.lit("open").alias("state"), F.lit(None).cast("long").alias("exit_ms"))
    ends = events.where("kind = 'close'").join(closed, ["symbol", "id"], "left_semi").groupBy("id").agg(F.min(F.struct("ms", "state")).alias("end"))
    every = log.unionByName(fresh).join(ends, "id", "left")
    over = F.col("end").isNotNull() & (F.col("state") == "open")
    return every.withColumn("exit_ms", F.when(over, F.col("end.ms")).otherwise(F.col("exit_ms"))).withColumn("state", F.when(over, F.col("end.state")).otherwise(F.col("state"))).drop("end")
