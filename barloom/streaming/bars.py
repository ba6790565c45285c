"""Time bars over a stream of ticks: an extension, with a watermark that bounds state by lateness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def time_bars(ticks: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(symbol, start, open, high, low, close, cents, ticks) of a streaming or plain frame (symbol, ts timestamp, seq, price, cents).

    Ticks more than `late` behind the latest one may be left out of a closed bar.
    """
    at = F.struct("ts", "seq")
    grouped = ticks.withWatermark("ts", late).groupBy("symbol", F.window("ts", width).alias("w"))
    return grouped.agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("cents").alias("cents"), F.count("*").alias("ticks")
    ).select("symbol", F.col("w.start").alias("start"), "open", "high", "low", "close", "cents", "ticks")
