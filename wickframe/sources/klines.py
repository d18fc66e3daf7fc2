"""Pages of raw kline arrays as a data source: a partition for each page, and pages that can't matter aren't read.

    register(spark)
    spark.read.format("kline_pages").option("path", folder).option("symbols", "BTCUSDT,ETHUSDT").option("from_ms", ...)

A page is a text file with one JSON array of klines, in a folder that names its symbol and the open times of its first
and last bar.  symbols, from_ms and to_ms (both included) limit what is planned; where the session lets Python sources
see filters (spark.sql.python.filterPushdown.enabled), those on symbol and open_time_ms do the same.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bars in a page.
PAGE = 500
SCHEMA = "symbol string, tf string, open_time_ms long, open double, high double, low double, close double, volume double, quote_volume double, trades long, taker_buy_base double"
#: Places of these columns in a kline array.
PLACES = (0, 1, 2, 3, 4, 5, 7, 8, 9)
_FOLDER = re.compile(r"symbol=([^/]*)/first_ms=(-?\d+)/last_ms=(-?\d+)/[^/]*\.txt$")


class Page(InputPartition):
    def __init__(self, symbol: str, file: str):
        self.symbol, self.file = symbol, file


class KlinePages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "kline_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return (FilteredPageReader if self.options.get("pushdown") == "true" else PageReader)(self.options)


class PageReader(DataSourceReader):
    def __init__(self, options):
        self._path, self._tf = options["path"], options.get("tf", "1d")
        named = options.get("symbols")
        self._symbols = None if named is None else set(named.split(","))
        self._from, self._to = int(options.get("from_ms", -(1 << 62))), int(options.get("to_ms", 1 << 62))

    def pages(self) -> Iterator[tuple[str, int, int, str]]:
        """symbol, first and last time, and path of every page."""
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self._path)
        for info in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if found := _FOLDER.search(info.path):
                yield found[1], int(found[2]), int(found[3]), info.path

    def partitions(self) -> list[InputPartition]:
        wanted = [Page(s, path) for s, first, last, path in self.pages() if (self._symbols is None or s in self._symbols) and last >= self._from and first <= self._to]
        return wanted or [Page("", "")]

    def read(self, page: Page) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if not page.file:
            return
        store, _ = fs.FileSystem.from_uri(self._path)
        with store.open_input_stream(page.file) as f:
            lines = f.read().decode().splitlines()
        rows = [k for line in lines for k in json.loads(line)]
        rows = [k for k in rows if self._from <= int(k[0]) <= self._to]
        whole = lambda x: None if x is None else int(float(x))
        real = lambda x: None if x is None else float(x)
        cols = [pa.array([(whole if at in (0, 8) else real)(k[at]) for k in rows], pa.int64() if at in (0, 8) else pa.float64()) for at in PLACES]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([page.symbol] * len(rows), pa.string()), pa.array([self._tf] * len(rows), pa.string()), *cols], names)


class FilteredPageReader(PageReader):
    def pushFilters(self, filters):
        """Takes filters on the symbol; those on the time also stay with Spark, as a page may hold more."""
        for f in filters:
            mine = f.attribute == ("symbol",) and isinstance(f, (EqualTo, In))
            if mine:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self._symbols = values if self._symbols is None else self._symbols & values
                continue
            if f.attribute == ("open_time_ms",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self._from = max(self._from, f.value)
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self._to = min(self._to, f.value)
            yield f


def register(spark: SparkSession) -> None:
    """Makes the source known to the session, unless it is."""
    try:
        spark.dataSource.register(KlinePages)
    except AnalysisException as e:
        if e.getCondition() != "DATA_SOURCE_ALREADY_EXISTS":
            raise


def write_pages(bars: DataFrame, path: str, size: int = PAGE) -> None:
    """Bars (with bar_idx) as pages of so many: one text file each."""
    text = lambda c: F.col(c).cast("string")
    zero = F.lit("0")
    row = F.array(text("open_time_ms"), text("open"), text("high"), text("low"), text("close"), text("volume"), zero, text("quote_volume"), text("trades"), text("taker_buy_base"), zero, zero)
    one = F.struct("open_time_ms", row.alias("k"))
    pages = bars.groupBy("symbol", F.floor(F.col("bar_idx") / size).alias("page")).agg(
        F.min("open_time_ms").alias("first_ms"), F.max("open_time_ms").alias("last_ms"), F.to_json(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["k"])).alias("value"))
    pages.drop("page").write.partitionBy("symbol", "first_ms", "last_ms").text(path)


# for executors that have no copy of this repository
cloudpickle.register_pickle_by_value(sys.modules[__name__])
