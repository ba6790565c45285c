"""Purged and embargoed cross-validation folds over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .scan import DAY_US, position


def ranked(events: DataFrame, time: str = "us") -> DataFrame:
    """events with `rank`, the place in time over all of them; counted by days, so no task holds all rows."""
    return position(events.withColumn("_all", F.lit(1)), ["_all"], [time, "eid"], F.floor(F.col(time) / DAY_US), "rank").drop("_all")


def _with_folds(events: DataFrame, k: int, first_larger: bool, time: str) -> tuple[DataFrame, DataFrame]:
    n = events.agg(F.count("*").alias("_n"))
    rows = ranked(events, time).join(F.broadcast(n))  # one row
    if first_larger:  # sizes differ by one, the larger ones first
        q, r = F.floor(F.col("_n") / k), F.col("_n") % k
        head = r * (q + 1)
        fold = F.when(F.col("rank") < head, F.floor(F.col("rank") / (q + 1))).otherwise(r + F.floor((F.col("rank") - head) / F.greatest(q, F.lit(1))))
    else:  # cut at floor(n * i / k)
        fold = F.floor((F.col("rank") * k + k - 1) / F.col("_n"))
    rows = staged(rows.withColumn("own", fold.cast("int")).drop("_n"), "ranked")  # read for the bounds and again for the rows
    return rows, rows.groupBy("own").agg(F.min("us").alias("t0"), F.max("end_us").alias("t1"), F.min(time).alias("key_lo"), F.max(time).alias("key_hi"))


def purged_kfold(events: DataFrame, k: int = 5, embargo_us: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """(eid, fold, split): contiguous folds by start. Training rows of a fold end before it begins or start after it ends, and not
    within the embargo after its end. With `carry` also these columns of events, which saves a join of k times the rows."""
    rows, bounds = _with_folds(events, k, True, "us")
    pairs = rows.join(F.broadcast(bounds.withColumnRenamed("own", "fold")))  # k rows
    val = F.col("own") == F.col("fold")
    clash = (F.col("us") < F.col("t1")) & (F.col("end_us") > F.col("t0"))
    near = (F.col("us") >= F.col("t1")) & (F.col("us") < F.col("t1") + embargo_us)
    return pairs.filter(val | ~(clash | near)).select("eid", "fold", F.when(val, "val").otherwise("train").alias("split"), *carry)


def embargo_folds(events: DataFrame, k: int = 5, purge_us: int = 3_600_000_000, embargo_us: int = 1_800_000_000) -> DataFrame:
    """(eid, fold, split): folds by end time, all rows within a fold's closed range of it are validation. Training rows start after
    the range and the embargo or end before it and the purge; others are left out of that fold."""
    _, bounds = _with_folds(events, k, False, "end_us")
    pairs = events.join(F.broadcast(bounds.withColumnRenamed("own", "fold")))
    val = F.col("end_us").between(F.col("key_lo"), F.col("key_hi"))
    train = (F.col("us") > F.col("key_hi") + embargo_us) | (F.col("end_us") < F.col("key_lo") - purge_us)
    return pairs.filter(val | train).select("eid", "fold", F.when(val, "val").otherwise("train").alias("split"))


def walk_forward(events: DataFrame, ranges: list[tuple[str, str, str, str]]) -> DataFrame:
    """(eid, fold, split) for date ranges (train from, train to, test from, test to), ends excluded."""
    spark = events.sparkSession
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(ranges)], "fold int, a string, b string, c string, d string")
    day = F.date_format(F.timestamp_micros("us"), "yyyy-MM-dd")
    split = F.when((day >= F.col("a")) & (day < F.col("b")), "train").when((day >= F.col("c")) & (day < F.col("d")), "val")
    return events.join(F.broadcast(table)).withColumn("split", split).filter("split is not null").select("eid", "fold", "split")


def materialise(folds: DataFrame, labels: DataFrame, weights: DataFrame) -> DataFrame:
    """Fold rows with their labels and weights; a row without a weight counts one."""
    out = folds.join(labels, "eid", "left").join(weights.select("eid", "weight"), "eid", "left")
    return out.withColumn("sample_w", F.coalesce("weight", F.lit(1.0))).drop("weight")
