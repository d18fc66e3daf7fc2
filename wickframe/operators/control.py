"""Scans in phases: rows left after each, and an abort that reaches running jobs."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wickframe.sources.shared import cut


class Aborted(RuntimeError):
    """The scan was aborted in (or before) the named phase."""


class Scan:
    """Runs phases (name, table -> table) one after the other.  Each phase's rows are counted by the job that computes
    them, and stand in `progress` as soon as it is over; `told`, if given, is called with them.  abort(), from any
    thread, cancels the jobs of this scan alone, which carry its tag, and no further phase begins."""

    def __init__(self, spark: SparkSession, told: Callable[[str, int], None] | None = None):
        self._spark, self._told, self._stop = spark, told, threading.Event()
        self.tag = f"scan-{uuid.uuid4().hex}"
        self.progress: list[tuple[str, int]] = []

    def abort(self) -> None:
        self._stop.set()
        # a session's own tags are known to the thread that set them only
        self._spark.sparkContext.cancelJobsWithTag(self.tag)

    def run(self, first: DataFrame, phases: list[tuple[str, Callable[[DataFrame], DataFrame]]]) -> DataFrame:
        table = first
        self._spark.sparkContext.addJobTag(self.tag)
        try:
            for name, phase in phases:
                if self._stop.is_set():
                    raise Aborted(name)
                seen = Observation()
                try:
                    table = cut(phase(table).observe(seen, F.count(F.lit(1)).alias("n")))
                    self.progress.append((name, seen.get["n"]))
                except Exception as e:
                    if self._stop.is_set():
                        raise Aborted(name) from e
                    raise
                if self._told:
                    self._told(*self.progress[-1])
        finally:
            self._spark.sparkContext.removeJobTag(self.tag)
        return table
