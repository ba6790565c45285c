"""Volatility and return measures of bars; those used for barriers look back only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .halo import filled, previous, windowed
from .scan import ewma

KEYS = ["symbol"]


def true_range(bars: DataFrame) -> DataFrame:
    """bars with `tr`: the largest of high - low and the distances of both to the close before."""
    prev = F.col("_prev")
    tr = F.greatest(F.abs(F.col("high") - F.col("low")), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))
    return previous(bars, KEYS, "pos", {"_prev": "close"}).withColumn("tr", tr).drop("_prev")


def atr(bars: DataFrame, period: int = 14, kind: str = "wilder") -> DataFrame:
    """bars with `tr` and `atr`, the running average of tr (wilder: 1/period, ema: 2/(period+1)), seeded with the first."""
    return ewma(true_range(bars), ["symbol"], "pos", F.col("tr"), 1 / period if kind == "wilder" else 2 / (period + 1), "atr")


def atr_vol(bars: DataFrame, period: int = 14, kind: str = "wilder", by_close: bool = True) -> DataFrame:
    """bars with `vol`: the average true range known before the bar, over the close; the first takes the next known value."""
    rows = previous(atr(bars, period, kind), KEYS, "pos", {"vol": "atr"})
    known = F.col("vol") / F.col("close") if by_close else F.col("vol")
    return filled(rows, KEYS, "pos", known, "vol", ahead=True).withColumn("vol", F.coalesce("vol", F.lit(0.0)))


def returns(bars: DataFrame) -> DataFrame:
    """bars with `ret`, the change of close against the bar before over that one's close."""
    return previous(bars, KEYS, "pos", {"_prev": "close"}).withColumn("ret", F.try_divide(F.col("close"), F.col("_prev")) - 1).drop("_prev")


def ewma_vol(bars: DataFrame, span: int = 32) -> DataFrame:
    """bars with `vol`: the exponentially weighted standard deviation of returns, unbiased, known before the bar.

    Null returns count as 0. Where it is unknown or 0 the last known value holds, before that the first known one, else 0.
    """
    alpha, r = 2 / (span + 1), 1 - 2 / (span + 1)
    rows = returns(bars).withColumn("_r", F.coalesce("ret", F.lit(0.0)))
    rows = ewma(ewma(rows, ["symbol"], "pos", F.col("_r"), alpha, "_m"), ["symbol"], "pos", F.col("_r") * F.col("_r"), alpha, "_q")
    past = F.pow(F.lit(r * r), F.col("pos"))
    squares = past + alpha**2 * (1 - past) / (1 - r * r)
    var = F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), F.lit(0.0)) / F.nullif(1 - squares, F.lit(0.0))
    rows = previous(rows.withColumn("_s", F.when(F.col("pos") > 0, F.sqrt(var))), KEYS, "pos", {"_p": "_s"})
    rows = filled(rows, KEYS, "pos", F.col("_p"), "_p", ahead=True)
    rows = filled(rows, KEYS, "pos", F.nullif("_p", F.lit(0.0)), "vol")
    return rows.withColumn("vol", F.coalesce("vol", F.lit(0.0))).drop("_r", "_m", "_q", "_s", "_p")


def rolling_vol(bars: DataFrame, width: int, least: int = 5) -> DataFrame:
    """bars with `vol_m`: the sample standard deviation of the last `width` returns, the first counting as 0; below `least` of them the next known one."""
    rows = returns(bars).withColumn("_r", F.coalesce("ret", F.lit(0.0)))
    last = lambda w: w.rowsBetween(1 - width, 0)
    rows = windowed(rows, KEYS, "pos", lambda w: {"vol_m": F.when(F.count("_r").over(last(w)) >= least, F.stddev_samp("_r").over(last(w)))}, back=width - 1).drop("_r")
    return filled(rows, KEYS, "pos", F.col("vol_m"), "vol_m", ahead=True)


def window_vol(bars: DataFrame, width_us: int) -> DataFrame:
    """bars with `vol_t`: the deviation of returns in the time (t - width, t], as known one bar later."""
    span = lambda w: w.rangeBetween(1 - width_us, 0)
    rows = windowed(returns(bars), KEYS, "us", lambda w: {"_v": F.when(F.count("ret").over(span(w)) >= 2, F.stddev_samp("ret").over(span(w)))}, back=width_us)
    return previous(rows, KEYS, "pos", {"vol_t": "_v"}).drop("_v")


def forward_return(bars: DataFrame, horizon_us: int) -> DataFrame:
    """bars with `ret_f`: the return to the last close within horizon_us from now. It looks ahead: a target, not a feature."""
    end = lambda w: F.last("close").over(w.rangeBetween(0, horizon_us))
    return windowed(bars, KEYS, "us", lambda w: {"ret_f": end(w) / F.col("close") - 1}, ahead=horizon_us)


def at_samples(samples: DataFrame, features: DataFrame, columns: list[str]) -> DataFrame:
    """samples (symbol, bar_pos) with the features of that bar, of the second one for entries at the first, of the last one for entries beyond it."""
    last = features.groupBy("symbol").agg(F.max("pos").alias("_last"))
    rows = samples.join(last, "symbol").withColumn("_at", F.least(F.greatest("bar_pos", F.lit(1)), "_last").cast("long"))
    return rows.join(features.select("symbol", F.col("pos").cast("long").alias("_at"), *columns), ["symbol", "_at"], "left").drop("_at", "_last")
