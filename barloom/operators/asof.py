"""As-of joins by union and fill, and horizon positions by range counts. No pair of rows is ever formed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import DAY_US


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, value: str, tolerance: int | None = None, how: str = "backward", bucket: int = DAY_US) -> DataFrame:
    """left with `<value>` and `<on>_right` of right's row that is as-of it: the last one not after it, or with how="nearest" the closest.

    Ties of distance go backward; among right's rows of one time the largest value counts. Beyond `tolerance` both are null. A key's rows
    are filled within stretches of `bucket` units of `on`; what comes from stretches before or after is one row for each stretch.
    """
    r = right.groupBy(*keys, on).agg(F.max(value).alias("_v"))
    both = left.withColumn("_left", F.lit(True)).unionByName(
        r.select(*keys, on, F.col("_v"), F.lit(False).alias("_left")), allowMissingColumns=True
    )
    seen = F.when(~F.col("_left"), F.struct(F.col(on).alias("t"), F.col("_v").alias("v")))
    both = both.withColumns({"_bk": F.floor(F.col(on) / bucket), "_s": seen})
    ends = both.groupBy(*keys, "_bk").agg(F.max("_s").alias("_hi"), F.min("_s").alias("_lo"))
    along = Window.partitionBy(*keys).orderBy("_bk")
    before = F.last("_hi", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_lo", ignorenulls=True).over(along.rowsBetween(1, Window.unboundedFollowing))
    ends = ends.select(*keys, "_bk", before.alias("_before"), after.alias("_after"))
    w = Window.partitionBy(*keys, "_bk").orderBy(F.col(on), F.col("_left"))
    out = both.withColumn("_b", F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if how == "nearest":  # the first at or after: the last in the opposite order
        back = Window.partitionBy(*keys, "_bk").orderBy(F.col(on).desc(), F.col("_left"))
        out = out.withColumn("_f", F.last("_s", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.filter("_left").join(ends, [*keys, "_bk"], "left").withColumn("_b", F.coalesce("_b", "_before"))
    pick = F.col("_b")
    if how == "nearest":
        out = out.withColumn("_f", F.coalesce("_f", "_after"))
        ahead, behind = F.col("_f.t") - F.col(on), F.col(on) - F.col("_b.t")
        pick = F.when(F.col("_b").isNull() | (ahead < behind), F.col("_f")).otherwise(F.col("_b"))
    out = out.withColumn("_p", pick)
    if tolerance is not None:
        out = out.withColumn("_p", F.when(F.abs(F.col("_p.t") - F.col(on)) <= tolerance, F.col("_p")))
    return out.select(*left.columns, F.col("_p.t").alias(f"{on}_right"), F.col("_p.v").alias(value))


def coverage(df: DataFrame, column: str) -> float:
    """The share of rows in which column is known; 0 without rows."""
    return float(df.agg(F.avg(F.col(column).isNotNull().cast("double"))).first()[0] or 0.0)


def horizon(bars: DataFrame, width_us: int, pos: str = "pos", out: str = "t1") -> DataFrame:
    """bars with `t1`: the position of the first bar at or after us + width_us, at most the last. Positions are 0, 1, 2 ... in order of us."""
    places = bars.select("symbol", F.col("us").alias("_t"), F.col(pos).cast("long").alias("_p"))
    last = bars.groupBy("symbol").agg(F.max(pos).alias("_last"))  # a row for each symbol
    found = asof(bars.withColumn("_t", F.col("us") + (width_us - 1)), places, ["symbol"], "_t", "_p")
    return found.join(last, "symbol").withColumn(out, F.least(F.coalesce(F.col("_p") + 1, F.lit(0)), "_last").cast("long")).drop("_t", "_t_right", "_p", "_last")
