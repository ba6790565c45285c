"""Windows over long series in buckets that also hold the neighbouring rows their frames need.

A series (keys, axis) is cut into buckets of the axis; a row goes to its own bucket and as a halo to those whose frames reach it. So lags, rolling and range
frames are local to a bucket, and one symbol with all rows is as many tasks as it has buckets. What has no bounded frame (the last known value, a running
maximum) is carried on by one row for each bucket.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Positions of a bucket.
ROWS = 4096


def haloed(df: DataFrame, keys: list[str], axis: str, width: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """df with `_hb`, a bucket, and `_own`: each row in its own bucket and, not owned, in those with rows up to `back` after or `ahead` before it on the axis."""
    x = F.col(axis)
    reach = F.sequence(F.floor((x - ahead) / width), F.floor((x + back) / width))
    return df.withColumn("_hb", F.explode(reach)).withColumn("_own", F.col("_hb") == F.floor(x / width))


def windowed(
    df: DataFrame, keys: list[str], axis: str, make: Callable[[WindowSpec], dict[str, Column]], back: int = 0, ahead: int = 0, width: int = ROWS, ties: tuple[str, ...] = ()
) -> DataFrame:
    """df with the columns that make(w) gives, w a window along the axis of each key; their frames may reach `back` and `ahead` on the axis. Rows without a place on it go."""
    width = max(width, back, ahead)
    w = Window.partitionBy(*keys, "_hb").orderBy(axis, *ties)
    return haloed(df.filter(F.col(axis).isNotNull()), keys, axis, width, back, ahead).withColumns(make(w)).filter("_own").drop("_hb", "_own")


def previous(df: DataFrame, keys: list[str], pos: str, columns: dict[str, str]) -> DataFrame:
    """df with new columns {new: old} that hold the row before's values; pos is 0, 1, 2 ... within a key."""
    return windowed(df, keys, pos, lambda w: {new: F.lag(old).over(w) for new, old in columns.items()}, back=1)


def filled(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, ahead: bool = False, width: int = ROWS) -> DataFrame:
    """df with `out`: the last value along pos that is not null, this row's included, or with ahead the next one."""
    rows = df.withColumns({"_fb": F.floor(F.col(pos) / width), "_fv": value})
    seen = F.when(F.col("_fv").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("_fv").alias("v")))
    ends = rows.groupBy(*keys, "_fb").agg((F.min(seen) if ahead else F.max(seen)).alias("_fe"))
    along = Window.partitionBy(*keys).orderBy(F.desc("_fb") if ahead else F.asc("_fb")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    ends = ends.select(*keys, "_fb", F.last("_fe", ignorenulls=True).over(along).alias("_fe"))
    local = Window.partitionBy(*keys, "_fb").orderBy(F.desc(pos) if ahead else F.asc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(ends, [*keys, "_fb"])
    return rows.withColumn(out, F.coalesce(F.last("_fv", ignorenulls=True).over(local), F.col("_fe.v"))).drop("_fb", "_fv", "_fe")


def running_max(df: DataFrame, keys: list[str], pos: str, value: Column, out: str, width: int = ROWS) -> DataFrame:
    """df with `out`: the largest value along pos up to this row."""
    rows = df.withColumns({"_fb": F.floor(F.col(pos) / width), "_fv": value})
    along = Window.partitionBy(*keys).orderBy("_fb").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "_fb").agg(F.max("_fv").alias("_fm")).select(*keys, "_fb", F.max("_fm").over(along).alias("_fe"))
    local = Window.partitionBy(*keys, "_fb").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(ends, [*keys, "_fb"]).withColumn(out, F.greatest(F.max("_fv").over(local), "_fe")).drop("_fb", "_fv", "_fe")
