"""Streams: bars that are emitted once they are over, periodic scans, and a stateful trade machine."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wickframe.config import Config, refresh_delay_ms


def closed_bars(trades: DataFrame, width: str = "4 hours", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars of a stream of trades (symbol, ts, seq, price, quantity, turnover, buy): a bar comes out once, when
    the watermark has passed its end; trades later than `late` are left out."""
    return (
        trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
        .agg(F.min_by("price", "seq").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "seq").alias("close"), F.sum("quantity").alias("volume"), F.sum("turnover").alias("quote_volume"), F.count(F.lit(1)).alias("trades"), F.sum(F.when(F.col("buy"), F.col("quantity")).otherwise(0.0)).alias("taker_buy_base"))
        .select("symbol", F.unix_millis(F.col("w.start").cast("timestamp")).alias("open_time_ms"), "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base"))


def scan_stream(bars: DataFrame, scan: Callable[[DataFrame, int], None], checkpoint: str, config: Config | None = None, background: bool = False):
    """Runs `scan` on each micro-batch, no more often than the refresh delay; one scan runs at a time."""
    config = config or Config()
    delay = refresh_delay_ms(config.refresh_ms, background, config)
    return bars.writeStream.foreachBatch(scan).option("checkpointLocation", checkpoint).trigger(processingTime=f"{delay} milliseconds").start()


STATE = "entry double, stop double, target double, entry_ms long, rest int"
OUT = "symbol string, event string, open_time_ms long, price double, r double"


def trade_machine(signals: DataFrame, cooldown: int = 5) -> DataFrame:
    """Opens and closes one position for each symbol as confirmed bars arrive: symbol, open_time_ms, high, low, close,
    enter (boolean), stop, target.  A position opens at the close of a bar that says so, is checked from the next bar
    on (stop first), and after it `cooldown` bars go by before the next."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        entry, stop, target, since, rest = state.get if state.exists else (None, None, None, None, 0)
        out = []
        for b in pd.concat(list(parts)).sort_values("open_time_ms").itertuples():
            if entry is not None:
                price = stop if b.low <= stop else target if b.high >= target else None
                if price is not None:
                    out.append((key[0], "stop" if price == stop else "target", b.open_time_ms, price, (price - entry) / (entry - stop)))
                    entry, rest = None, cooldown
            elif rest > 0:
                rest -= 1
            elif b.enter and b.stop < b.close:
                entry, stop, target, since = b.close, b.stop, b.target, b.open_time_ms
                out.append((key[0], "enter", since, entry, 0.0))
        state.update((entry, stop, target, since, rest))
        yield pd.DataFrame(out, columns=["symbol", "event", "open_time_ms", "price", "r"])

    return signals.groupBy("symbol").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
