"""Dollar bars over a stream of ticks, with the running total of each symbol as state: an extension.

Ticks wait in the state until the watermark has passed them, so that those of several batches, in any order, are added up in order of
(us, seq); a timer at the earliest waiting tick wakes a symbol that gets no more. A bar is given out when it is full, which nothing can change
any more. State of a symbol: its total, its open bar, and the ticks of the last `late` time. A query that is started again from
its checkpoint goes on where it was.

A symbol's total is one sequence, so its ticks of a batch are one task; symbols are spread.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

TICK = "us long, seq long, price double, qty double, cents long"
OPEN = "total long, bar_id long, us long, open double, high double, low double, close double, qty double, cents long, ticks long"
BARS = "symbol string, bar_id long, us long, open double, high double, low double, close double, qty double, cents long, ticks long"
_FIELDS = ["symbol", *(f.split()[0] for f in BARS.split(", ")[1:])]


class _Open:
    """A symbol's total and its open bar; add() gives a bar that is full."""

    def __init__(self, row, threshold: int):
        self.threshold = threshold
        self.total, self.bar = (0, None) if row is None else (row[0], None if row[1] is None else list(row[1:]))

    def add(self, us: int, price: float, qty: float, cents: int):
        """The bar before, if this tick opens another one. The tick belongs to the bar that the total up to and with it falls in."""
        self.total += cents
        number = (self.total - 1) // self.threshold
        done = None
        if self.bar is not None and self.bar[0] != number:
            done, self.bar = tuple(self.bar), None
        if self.bar is None:
            self.bar = [number, us, price, price, price, price, qty, cents, 1]
        else:
            b = self.bar
            b[1], b[3], b[4], b[5] = us, max(b[3], price), min(b[4], price), price
            b[6], b[7], b[8] = b[6] + qty, b[7] + cents, b[8] + 1
        return done

    def full(self):
        """The open bar, if its total is at its very end: the next tick of any value opens another."""
        if self.bar is not None and self.total == (self.bar[0] + 1) * self.threshold:
            done, self.bar = tuple(self.bar), None
            return done
        return None

    def row(self):
        return (self.total, *(self.bar or [None] * 9))


class DollarBars(StatefulProcessor):
    def __init__(self, threshold_cents: int):
        self.threshold = threshold_cents

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", OPEN)
        self.waiting = handle.getListState("waiting", TICK)

    def _settle(self, key, ticks: list[tuple], watermark_ms: int) -> pd.DataFrame:
        """Add the ticks up to the watermark in order, keep the rest, and set the timer for the first of those."""
        ready = sorted(t for t in ticks if t[0] <= watermark_ms * 1000)
        rest = [t for t in ticks if t[0] > watermark_ms * 1000]
        done = []
        if ready:
            now = _Open(self.open.get(), self.threshold)
            for us, _, price, qty, cents in ready:
                for bar in (now.add(us, price, qty, cents), now.full()):
                    if bar is not None:
                        done.append((key[0], *bar))
            self.open.update(now.row())
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(t[0] for t in rest) // 1000 + 1)
        elif self.waiting.exists():
            self.waiting.clear()
        return pd.DataFrame(done, columns=_FIELDS)

    def _held(self) -> list[tuple]:
        return [tuple(t) for t in self.waiting.get()] if self.waiting.exists() else []

    def handleInputRows(self, key, rows, timerValues):
        ticks = self._held()
        for frame in rows:
            ticks += list(zip(*(frame[c].tolist() for c in ("us", "seq", "price", "qty", "cents"))))
        yield self._settle(key, ticks, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield self._settle(key, self._held(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """The state store that such queries need; set it before they are started."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def dollar_bars(ticks: DataFrame, threshold_cents: int = 100_000, late: str = "10 minutes") -> DataFrame:
    """(symbol, bar_id, us, open, high, low, close, qty, cents, ticks) of a streaming frame (symbol, ts timestamp, us, seq, price, qty, cents).

    The bars are those of `operators.bars.dollar_bars` over the same ticks; a symbol's last bar comes when it is full or a later tick has opened
    another. Ticks more than `late` behind the latest one of all symbols when they come are left out, as are those with a null time, price or value, or
    a value that is not above 0.
    """
    use_rocksdb(ticks.sparkSession)
    good = ticks.filter("ts is not null and us is not null and price is not null and cents > 0 and symbol is not null")
    grouped = good.withWatermark("ts", late).groupBy("symbol")
    return grouped.transformWithStateInPandas(statefulProcessor=DollarBars(threshold_cents), outputStructType=BARS, outputMode="Append", timeMode="EventTime")
