"""Information-time and clock bars from ticks, and their timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scan import DAY_US, position, running_sum


def _ohlc(at):
    return [
        F.max("us").alias("us"),
        F.min_by("price", at).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", at).alias("close"),
        F.sum("qty").alias("qty"),
        F.sum("cents").alias("cents"),
        F.count("*").alias("ticks"),
    ]


def dollar_bars(ticks: DataFrame, threshold_cents: int = 100_000, bucket_us: int = DAY_US) -> DataFrame:
    """(symbol, bar_id, us, open, high, low, close, qty, cents, ticks): a bar for each `threshold_cents` traded.

    A tick belongs to the bar that the traded value up to and with it falls in; a total exactly at a border still belongs to the
    earlier bar, and a huge tick skips bars. Only a symbol's last bar is dropped if it is short. Values are integer
    cents, so that sums do not depend on the order of addition.
    """
    at = F.struct("us", "seq")
    summed = running_sum(ticks, ["symbol"], ["us", "seq"], F.col("cents"), F.floor(F.col("us") / bucket_us), "_cum")
    bars = summed.groupBy("symbol", F.floor((F.col("_cum") - 1) / threshold_cents).alias("bar_id")).agg(*_ohlc(at))
    last = bars.groupBy("symbol").agg(F.max("bar_id").alias("_last"))
    return bars.join(last, "symbol").filter((F.col("bar_id") < F.col("_last")) | (F.col("cents") >= threshold_cents)).drop("_last")


def adaptive_threshold(ticks: DataFrame, threshold_cents: int, bars_per_day: int, factor: float) -> DataFrame:
    """(symbol, threshold_cents): median daily value over bars_per_day, within `factor` of the given threshold."""
    daily = ticks.groupBy("symbol", F.floor(F.col("us") / DAY_US).alias("day")).agg(F.sum("cents").alias("c"))
    want = F.percentile("c", F.lit(0.5)) / bars_per_day
    held = F.greatest(F.least(want, F.lit(threshold_cents * factor)), F.lit(threshold_cents / factor))
    return daily.groupBy("symbol").agg(F.when(want > 0, held).otherwise(F.lit(float(threshold_cents))).alias("threshold_cents"))


def time_bars(ticks: DataFrame, width_us: int) -> DataFrame:
    """(symbol, start_us, us, open, high, low, close, qty, cents, ticks): one bar for each interval that has ticks."""
    start = (F.floor(F.col("us") / width_us) * width_us).alias("start_us")
    return ticks.groupBy("symbol", start).agg(*_ohlc(F.struct("us", "seq")))


def numbered(bars: DataFrame, order: str = "us") -> DataFrame:
    """bars with `pos`, their place within the symbol, from 0."""
    return position(bars, ["symbol"], [order, "bar_id"], F.floor(F.col(order) / DAY_US))


def bump(df: DataFrame, keys: list[str], order: list[str], ts: str, bucket: Column | None = None) -> DataFrame:
    """df with `bumped`: ts made strictly rising, each at least one above the one before.

    With a bucket, which must rise with the order, a key's rows are windowed within buckets, and what earlier buckets bring on is one row each.
    """
    rows = position(df, keys, order, F.lit(0) if bucket is None else bucket, "_n").withColumn("_bk", F.lit(0) if bucket is None else bucket)
    slack = F.col(ts) - F.col("_n")
    ends = rows.groupBy(*keys, "_bk").agg(F.max(slack).alias("_m"))
    before = F.max("_m").over(Window.partitionBy(*keys).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.join(ends.select(*keys, "_bk", before.alias("_before")), [*keys, "_bk"])
    upto = F.max(slack).over(Window.partitionBy(*keys, "_bk").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("bumped", F.greatest(upto, "_before") + F.col("_n")).drop("_n", "_bk", "_before")
