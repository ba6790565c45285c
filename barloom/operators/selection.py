"""Exact quantiles by selection: histograms over ranges that close in on the wanted ranks, with no reducer that holds all values.

The values of a group are counted in `CELLS` equal cells of their range, each with its least and largest value; a wanted rank lies in one cell, whose values are
the range of the next round. A rank is found when its cell has one value, or few enough to be sorted. Rounds are few (a cell is a CELLS-th of its range), each is a
map-side combined count of the rows that are still in some range, and what is kept between rounds is a row for each rank.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged

#: Cells of a range, and values that a range may have to be sorted in one task.
CELLS, SORTED = 1024, 4096


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, rank, v): the value of each rank (from 0) among the group's values, for ranks (keys, rank) of whole numbers; ranks beyond a group go.

    df must be a table that may be read again and again. Null values, and such that are not a number, don't count.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    first = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    open_ = staged(_meet(ranks.distinct(), first, keys).filter("rank >= 0 and rank < _n").withColumn("_base", F.lit(0).cast("long")), "ranks")
    found = []
    while True:
        done = open_.filter(f"_lo = _hi or _n <= {SORTED}")
        found.append(done)
        left = open_.filter(f"_lo < _hi and _n > {SORTED}")
        if left.isEmpty():
            break
        ranges = left.select(*keys, "_lo", "_hi", "_base").distinct()
        met = _meet(rows, ranges, keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        # halves first: the difference of two doubles may be beyond a double
        part = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        cell = F.least(F.floor(part * CELLS), F.lit(CELLS - 1))
        cells = met.groupBy(*keys, "_lo", "_hi", "_base", cell.alias("_c")).agg(F.count("*").alias("_k"), F.min("_v").alias("_a"), F.max("_v").alias("_z"))
        along = Window.partitionBy(*keys, "_lo", "_hi", "_base").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # at most CELLS rows
        cells = cells.withColumn("_from", F.col("_base") + F.coalesce(F.sum("_k").over(along), F.lit(0)))
        inside = _meet(left.drop("_n"), cells.select(*keys, *[F.col(c).alias(f"{c}_") for c in ("_lo", "_hi", "_base")], "_k", "_a", "_z", "_from"), keys)
        inside = inside.filter("_lo = _lo_ and _hi = _hi_ and _base = _base_ and rank >= _from and rank < _from + _k")
        open_ = staged(inside.select(*keys, "rank", F.col("_k").alias("_n"), F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), F.col("_from").alias("_base")), "ranks")
    every = staged(reduce(DataFrame.unionByName, found), "ranks")
    one = every.filter("_lo = _hi").select(*keys, "rank", F.col("_lo").alias("v"))
    few = every.filter("_lo < _hi")
    held = _meet(rows, few.select(*keys, "_lo", "_hi", "_base").distinct(), keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    lists = held.groupBy(*keys, "_lo", "_hi", "_base").agg(F.sort_array(F.collect_list("_v")).alias("_l"))  # at most SORTED values
    some = few.drop("_n").join(lists, [*keys, "_lo", "_hi", "_base"]).select(*keys, "rank", F.get("_l", (F.col("rank") - F.col("_base")).cast("int")).alias("v"))
    return one.unionByName(some)


def _meet(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys) if keys else left.crossJoin(right)  # without keys right is one group's rows: a few


def quantiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """(keys, one column for each of levels): exact quantiles of value, linear between neighbours; groups without a value have nulls.

    levels: name of the column -> 0 .. 1.
    """
    spark = df.sparkSession
    rows = staged(df.select(*keys, F.col(value).cast("double").alias("_x")), "values")
    sizes = rows.groupBy(*keys).agg(F.count_if(F.col("_x").isNotNull() & ~F.isnan("_x")).alias("_n"))
    places = spark.createDataFrame([(n, float(q)) for n, q in levels.items()], "_q string, _p double")  # a row for each level
    wanted = sizes.crossJoin(F.broadcast(places)).withColumn("_at", F.col("_p") * (F.col("_n") - 1)).withColumn("_low", F.floor("_at")).filter("_n > 0")
    wanted, groups = staged(wanted, "wanted"), rows.select(*keys).distinct()
    ranks = wanted.select(*keys, F.explode(F.array("_low", F.least(F.col("_low") + 1, F.col("_n") - 1))).alias("rank"))
    got = staged(ranked_values(rows, keys, "_x", ranks), "found")
    low = got.withColumnsRenamed({"rank": "_low", "v": "_a"})
    high = got.withColumnsRenamed({"rank": "_high", "v": "_b"})
    both = wanted.join(low, [*keys, "_low"]).withColumn("_high", F.least(F.col("_low") + 1, F.col("_n") - 1)).join(high, [*keys, "_high"])
    part = F.col("_at") - F.col("_low")
    at = both.withColumn("_v", F.when(part == 0, F.col("_a")).otherwise(F.col("_a") * (1 - part) + F.col("_b") * part))
    wide = at.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == n, F.col("_v"))).alias(n) for n in levels])
    return groups.join(wide, keys, "left") if keys else wide
