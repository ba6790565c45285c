"""Connected components of an edge table, by alternating star contraction.

Every round is two shuffles of the edges: `large star` points each vertex's larger neighbours at
the smallest one it knows, `small star` does so for the smaller ones. The number of rounds grows with
the logarithm of the longest chain. A hub with a third of all edges is harmless: the minimum per vertex
is a map-side combined aggregate and its join back is an ordinary equi-join that AQE may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import release, staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on (u, v): returns (u, v) with u > v."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(low, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether (u, v) is a forest of stars: no vertex points twice, and none that is pointed at points on. One aggregate by vertex, in one pass."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("on"), F.lit(0).alias("at"))
    ends = ends.unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("on"), F.lit(1).alias("at")))
    odd = ends.groupBy("x").agg(F.sum("on").alias("on"), F.max("at").alias("at")).filter("on > 1 or on > 0 and at > 0")
    return odd.agg(F.count("*")).first()[0] == 0


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) for every id that has an edge; component is the smallest id reachable.

    Rows with a null end and self-loops say nothing and are dropped; repeated edges count once; an
    empty table gives an empty result.
    """
    now = staged(
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
        .distinct(),
        "edges",
    )
    while True:  # every round lowers some vertex's target
        if _stars(now):
            break
        nxt = staged(_star(_star(now, True), False), "edges")
        release(now)
        now = nxt
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
