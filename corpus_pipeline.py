"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; what it decides takes effect.  All
but the last return the columns of documents.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wickframe.llm import jaccard, langid, mixing, packing, suffixes
from wickframe.llm.common import crc_mod, written


#: Upper bounds of the session's settings while it runs the pipeline; they change no result.  Texts are long, so a tenth of Spark's
#: default of rows go to a Python worker at once (batches of some ten megabytes stay with the executors' buffers), and
#: tasks read and shuffle less at a time, so their sorts take less of the heap.
SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": 1000,
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": 16 << 20,
    "spark.sql.files.maxPartitionBytes": 32 << 20,
}
#: Chunks that an encoder keeps, and bytes of text that it works on at once: fewer than by default, as executors have run
#: other stages before and hold what these left in memory.
ENCODER_CACHE, ENCODER_RUN = 40_000, 1 << 19


def in_bytes(value: str) -> int:
    """A setting's number, which may end in a unit (k, m, g, with or without b)."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", value.strip().lower()).groups()
    return int(number) << (10 * "_kmgt".index(unit or "_"))


def over_texts(stage):
    """The stage, with no setting of its session above SETTINGS.  They stay, as the stage's table is computed later."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for key, most in SETTINGS.items():
            if not 0 < in_bytes(spark.conf.get(key)) <= most:
                spark.conf.set(key, str(most))
        return stage(spark, docs, sf_dir)

    return run_stage


@over_texts
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is none of the known ones (or that have no letter) go."""
    return langid.accepted(docs, langid.learn(docs.where(crc_mod(F.col("doc_id"), 4) != 2)))


@over_texts
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    return jaccard.one_of_each(docs)


@over_texts
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that occurred before are taken out of the texts."""
    return suffixes.without_repeats(docs)


@over_texts
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target shares, in training order; a document that is taken twice comes twice."""
    return mixing.mixed_documents(docs)


def in_file_order(docs: DataFrame, name: str, most: int = 1_000_000) -> DataFrame:
    """docs, read from files, with a column of places in their order: by the number in a file's name (part-N), those
    without one last; files of one number, and those without, by path; then by row.  There is room for 2**28 rows a
    file and 4096 files a number.  The table of files, a row each, is broadcast up to so many."""
    path = F.col("_metadata.file_path")
    files = docs.select(path.alias("_file")).distinct()
    part = F.regexp_extract(F.element_at(F.split("_file", "/"), -1), r"^part-(\d+)", 1).try_cast("long")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy("_file")) - 1
    first = F.when(F.col("_part").isNull(), (nth + (1 << 22)) * (1 << 40)).otherwise(F.col("_part") * (1 << 40) + nth * (1 << 28))
    files = files.withColumn("_part", part).select("_file", first.alias("_first"))
    files = F.broadcast(files) if files.count() <= most else files
    placed = docs.withColumns({"_file": path, "_row": F.col("_metadata.row_index")}).join(files, "_file")
    return placed.withColumn(name, F.col("_first") + F.col("_row")).drop("_file", "_row", "_first")


@over_texts
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, along the training order: a row for each piece of a document.  The order is that of the
    table's files and of the rows in them; `position` tells a document's passes apart.  Null texts are a piece of the
    end id; an empty table gives no pieces."""
    return packing.pack_documents(in_file_order(docs, "_position"), position="_position", cache=ENCODER_CACHE, run=ENCODER_RUN)


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("source_mix", mix),
    ("packing", pack),
]

#: SQL can express neither the language filters nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
