"""Synthetic ticks: from klines, and a seeded random walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def kline_ticks(klines: DataFrame, per_bar: int = 60, seed: int = 7) -> DataFrame:
    """(symbol, open_time, k, us, price, qty, is_buyer_maker) of klines (symbol, open_time ms, close_time ms, OHLC, volume, trades, taker_buy_volume).

    Each bar gets between 4 and per_bar ticks at even times. Prices start at open, touch high and low in seeded order, end at close and stay between
    low and high; quantities are positive and add up to the volume. Seeded hashes stand for random draws, so a lost
    task makes the same ticks again.
    """
    n = F.greatest(F.lit(4), F.least(F.lit(per_bar), F.coalesce(F.col("trades"), F.lit(per_bar)).cast("int")))
    draw = lambda salt: (F.pmod(F.xxhash64("symbol", "open_time", "k", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    rows = klines.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    up = F.pmod(F.xxhash64("symbol", "open_time", F.lit(seed)), F.lit(2)) == 0
    first, second = F.floor((F.col("n") - 1) / 3).cast("int"), F.floor(2 * (F.col("n") - 1) / 3).cast("int")
    a, b = F.when(up, F.col("high")).otherwise(F.col("low")), F.when(up, F.col("low")).otherwise(F.col("high"))
    wander = F.col("low") + (F.col("high") - F.col("low")) * draw(1)
    price = F.when(F.col("k") == 0, F.col("open")).when(F.col("k") == F.col("n") - 1, F.col("close")).when(F.col("k") == first, a).when(F.col("k") == second, b).otherwise(wander)
    rows = rows.withColumns({"price": price, "_e": -F.ln(draw(2))})
    share = F.col("_e") / F.sum("_e").over(Window.partitionBy("symbol", "open_time"))  # a bar's own ticks
    sold = 1 - F.coalesce(F.try_divide("taker_buy_volume", "volume"), F.lit(0.5))
    step = (F.col("close_time") - F.col("open_time")) * 1000 / (F.col("n") - 1)
    return rows.select(
        "symbol", "open_time", "k", (F.col("open_time") * 1000 + F.floor(step * F.col("k"))).cast("long").alias("us"), "price",
        (share * F.col("volume")).alias("qty"), (draw(3) < sold).cast("byte").alias("is_buyer_maker"),
    )


def random_walk(spark: SparkSession, n: int, start: float = 30_000.0, sigma: float = 5.0, seed: int = 1337) -> DataFrame:
    """n ticks, one a second: a Gaussian walk of prices and uniform quantities from 0.01 to 0.5."""
    from .scan import running_sum

    rows = spark.range(n).select(F.lit("DEMO").alias("symbol"), F.col("id").alias("seq"), (F.col("id") * 1_000_000).alias("us"), (F.randn(seed) * sigma).alias("_d"), (F.rand(seed + 1) * 0.49 + 0.01).alias("qty"))
    rows = running_sum(rows, ["symbol"], ["seq"], F.col("_d"), F.floor(F.col("seq") / 100_000), "_s")
    return rows.withColumn("price", start + F.col("_s")).drop("_d", "_s")
