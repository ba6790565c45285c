"""Table functions for SQL: klines expanded to ticks, partition by partition."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

TICKS = "symbol string, open_time long, k int, us long, price double, qty double, is_buyer_maker int"


def _draws(seed: int, *key):
    """Numbers in (0, 1] that follow from the key alone, so a task that is run again makes the same ticks."""
    n = 0
    while True:
        block = hashlib.sha256("/".join(map(str, (seed, *key, n))).encode()).digest()
        for i in range(0, 32, 8):
            yield (int.from_bytes(block[i : i + 8], "little") + 1) / 2.0**64
        n += 1


def bridged(open_: float, high: float, low: float, close: float, n: int, draw) -> list[float]:
    """n prices from open to close that touch high and low, in an order by draw, and stay between them."""
    prices = [low + (high - low) * next(draw) for _ in range(n)]
    first, second = (n - 1) // 3, 2 * (n - 1) // 3
    prices[first], prices[second] = (high, low) if next(draw) < 0.5 else (low, high)
    prices[0], prices[-1] = open_, close
    return prices


@udtf(returnType=TICKS)
class KlineTicks:
    """kline_ticks(TABLE(klines) PARTITION BY symbol ORDER BY (open_time) [, per_bar]): the ticks of each kline.

    klines: symbol, open_time and close_time in ms, open, high, low, close, volume, trades, taker_buy_volume; others are not looked at. A kline gets between 4
    and per_bar (60) ticks, as many as it had trades if these are known. Ticks are numbered within their kline by k; gathered again they give its prices and
    volume. Klines without a price or time give none.
    """

    def eval(self, kline: Row, per_bar: int = 60):
        has = kline.asDict()
        prices = [has["open"], has["high"], has["low"], has["close"]]
        if has["open_time"] is None or any(p is None or math.isnan(p) for p in prices):
            return
        n = max(4, min(per_bar, int(has["trades"]) if has.get("trades") is not None else per_bar))
        draw = _draws(7, has["symbol"], has["open_time"])
        path = bridged(*prices, n, draw)
        volume = has.get("volume") or 0.0
        parts = [-math.log(next(draw)) + 1e-12 for _ in range(n)]
        total, bought = sum(parts), (has.get("taker_buy_volume") or 0.0) / volume if volume and has.get("taker_buy_volume") is not None else 0.5
        span = ((has.get("close_time") or has["open_time"] + 59_999) - has["open_time"]) * 1000
        for k in range(n):
            yield has["symbol"], has["open_time"], k, has["open_time"] * 1000 + span * k // (n - 1), path[k], volume * parts[k] / total, int(next(draw) < 1 - bought)


def register(spark: SparkSession) -> None:
    """Make kline_ticks callable from SQL."""
    spark.udtf.register("kline_ticks", KlineTicks)
