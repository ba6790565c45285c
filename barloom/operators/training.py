"""Joins that bring folds, labels, features, weights and images together for a trainer, and clusters of motifs."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import release, staged


def fold_rows(folds: DataFrame, labels: DataFrame, fold: int) -> DataFrame:
    """The fold's rows (split train or val) with their labels, by row id; raises where either side is empty."""
    rows = folds.filter(F.col("fold") == fold).select("eid", "split").join(labels, "eid")
    sides = {r[0] for r in rows.select("split").distinct().collect()}  # two values at most
    if sides != {"train", "val"}:
        raise ValueError(f"fold {fold}: empty train or val after the join")
    return rows


def with_features(rows: DataFrame, features: DataFrame, key: str = "eid", filled: tuple[str, ...] = ("ret_m", "vol_m", "hour")) -> DataFrame:
    """rows with the features of their id; rows without them, and unknown values of `filled`, get 0."""
    out = rows.join(features, key, "left")
    return out.fillna(0, [c for c in filled if c in features.columns])


def with_end(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the end of their event, by row id; null where labels have none."""
    return rows.join(labels.select("eid", "end_us"), "eid", "left")


def paired(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (symbol, bar_pos) with the label of their last bar (symbol, pos); images without one go."""
    return images.join(labels.select("symbol", F.col("pos").alias("bar_pos"), "label"), ["symbol", "bar_pos"])


def motifs(df: DataFrame, vector: str, k: int = 8, seed: int = 1337, tries: int = 10) -> DataFrame:
    """df with `cluster`: k-means of a column of number arrays, the cheapest of `tries` starts, of equal ones the first.

    Rows whose array is null, empty, of another length than the most frequent one or holds null or non-finite numbers get null; so do all where no row is
    left. The fits read the vectors alone, written once; a fit is Spark's own, a pass of partial sums a step.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    numbers = F.col(vector).cast("array<double>")
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usual = df.filter(finite & (F.size(numbers) > 0)).groupBy(F.size(numbers).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not usual:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    good = F.coalesce(finite & (F.size(numbers) == usual[0]["n"]), F.lit(False))
    points = staged(df.filter(good).select(numbers.alias("_v")), "motifs")
    rows = points.select(array_to_vector("_v").alias("_f")).persist(StorageLevel.DISK_ONLY)
    best = None
    for i in range(tries):
        model = KMeans(k=k, seed=seed + i, featuresCol="_f", predictionCol="cluster").fit(rows)
        if best is None or model.summary.trainingCost < best.summary.trainingCost:
            best = model
    rows.unpersist()
    release(df.sparkSession, points)
    origin = F.array_repeat(F.lit(0.0), usual[0]["n"])  # stands in where a row has no vector, so that rows keep their number and order
    placed = best.transform(df.withColumn("_f", array_to_vector(F.when(good, numbers).otherwise(origin))))
    return placed.withColumn("cluster", F.when(good, F.col("cluster"))).drop("_f")
