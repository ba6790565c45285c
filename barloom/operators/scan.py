"""Running sums and ranks over long series, without one task for one key.

A series is cut into time buckets: totals of buckets are small, their prefix is a window over few rows, and
within a bucket the window is local. A symbol with a third of all rows is thus as many tasks as it has buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def running_sums(df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], bucket: Column) -> DataFrame:
    """df with a column for each of values: its sum over the rows of a key up to this one. bucket must rise with the order."""
    names = list(values)
    rows = df.withColumns({f"_v{i}": values[n] for i, n in enumerate(names)} | {"_b": bucket})
    totals = rows.groupBy(*keys, "_b").agg(*[F.sum(f"_v{i}").alias(f"_t{i}") for i in range(len(names))])
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*keys, "_b", *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_base{i}") for i in range(len(names))])
    local = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(starts, [*keys, "_b"]).withColumns({n: F.col(f"_base{i}") + F.sum(f"_v{i}").over(local) for i, n in enumerate(names)})
    return out.drop("_b", *[f"{c}{i}" for c in ("_v", "_base") for i in range(len(names))])


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, bucket: Column, out: str) -> DataFrame:
    """df with `out`: the sum of value over the rows of a key up to this one. bucket must rise with the order."""
    return running_sums(df, keys, order, {out: value}, bucket)


def position(df: DataFrame, keys: list[str], order: list[str], bucket: Column, out: str = "pos") -> DataFrame:
    """df with `out`: the row's place in its key's order, from 0."""
    counted = running_sum(df, keys, order, F.lit(1).cast("long"), bucket, out)
    return counted.withColumn(out, F.col(out) - 1)


def ewma(df: DataFrame, keys: list[str], pos: str, value: Column, alpha: float, out: str) -> DataFrame:
    """df with `out`: y[0] = x[0], y[t] = (1 - alpha) y[t-1] + alpha x[t], along pos 0, 1, ... of each key.

    Blocks of rows are summed with weights relative to their own start; what a block brings on is faded by whole blocks, and as many
    earlier blocks are added as still count in double precision. Linear, with no array per row.
    """
    import math

    r = 1.0 - alpha
    fade = -math.log(r)
    block = max(1, min(256, int(230 / fade)))
    back = max(1, math.ceil(40 / (fade * block)))
    rows = df.withColumns({"_blk": F.floor(F.col(pos) / block), "_j": F.col(pos) % block, "_x": value})
    weight = F.when(F.col(pos) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    inside = Window.partitionBy(*keys, "_blk").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_local", F.sum(weight * F.col("_x") * F.pow(F.lit(1 / r), F.col("_j"))).over(inside) * F.pow(F.lit(r), F.col("_j")))
    # one row for each full block; what earlier ones bring on is a window over those
    ends = rows.filter(F.col("_j") == block - 1).select(*keys, (F.col("_blk") + 1).alias("_blk"), F.col("_local").alias("_end"))
    by_block = Window.partitionBy(*keys).orderBy("_blk")
    carry = sum((F.coalesce(F.max("_end").over(by_block.rangeBetween(-d, -d)), F.lit(0.0)) * r ** (block * d) for d in range(back)), F.lit(0.0))
    ends = ends.withColumn("_carry", carry).drop("_end")
    joined = rows.join(ends, [*keys, "_blk"], "left")
    return joined.withColumn(out, F.col("_local") + F.coalesce("_carry", F.lit(0.0)) * F.pow(F.lit(r), F.col("_j") + 1)).drop("_blk", "_j", "_x", "_local", "_carry")
