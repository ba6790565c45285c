"""Embedding near-duplicates: spherical k-means cells, blocked cosine products, one representative kept.

Centroids come from Spark's k-means with cosine distance over a bounded sample (`SAMPLE` vectors); every vector is then
assigned to its home cell and also visits the cells whose centroid is nearly as close, so that a pair cut by
a cell border still meets. Vectors are compared only within one label and cell: home rows with home rows and visitors.
A cell's rows are dealt into blocks and each pair of blocks is one matrix product in a task, so a dense cell, or
a label with a third of all rows, is spread over many tasks. Pairs never leave a task: it returns link counts and
a spanning forest. Equal vectors collapse to one class with a count beforehand.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as tk
from .components import components
from .minhash import grouped
from .scratch import small_batches, staged

#: Vectors the centroids are fitted to; home rows a cell should have; cells at most (k x dimension is broadcast).
SAMPLE, CELL, CELLS = 40_000, 1024, 4096
#: How much less close than the home centroid a visited one may be.
MARGIN = 0.15
#: Home rows of a block.
BLOCK = 1024


def centroids(unit: DataFrame, dim: int, k: int, seed: int) -> np.ndarray:
    """k unit vectors, by k-means with cosine distance over the SAMPLE vectors of lowest hash."""
    some = unit.filter(F.size("v") == dim).orderBy(F.xxhash64("id", F.lit(seed)), "id", "h1").limit(SAMPLE)
    model = KMeans(k=k, seed=seed, maxIter=10, distanceMeasure="cosine", featuresCol="f").fit(some.select(array_to_vector("v").alias("f")))
    c = np.array(model.clusterCenters())
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)


def _assigned(unit: DataFrame, center: np.ndarray, margin: float) -> DataFrame:
    """(label, cell, homes, cells, cid, n, v): one row for each cell a vector is in; cells, all it visits, only in its home."""
    shared = unit.sparkSession.sparkContext.broadcast(center)  # at most CELLS x dimension

    def assign(batches):
        c = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                size = batch.column(2).value_lengths().to_numpy(zero_copy_only=False)
                flat = batch.column(2).flatten().to_numpy(zero_copy_only=False)
                fit = size == c.shape[1]
                homes = len(c) + size.astype(np.int64)  # another dimension: its own cell
                near = np.zeros((len(size), len(c)), bool)
                if fit.any():
                    dot = flat[np.repeat(fit, size)].reshape(-1, c.shape[1]) @ c.T
                    homes[fit] = dot.argmax(axis=1)
                    near[fit] = dot >= dot.max(axis=1, keepdims=True) - margin
                many = np.where(fit, near.sum(axis=1), 1)
                cells = np.empty(int(many.sum()), np.int64)
                mine = np.repeat(fit, many)
                cells[mine] = np.nonzero(near)[1]
                cells[~mine] = homes[~fit]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(cells, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(homes, pa.int32()), lists, batch.column(2), batch.column(3)],
                    names=["label", "cid", "homes", "cells", "v", "n"],
                )

    got = unit.select("label", "cid", "v", "n").mapInArrow(tk.tidy(assign), "label string, cid long, homes int, cells array<int>, v array<double>, n long")
    each = got.select("label", F.explode("cells").alias("cell"), "homes", "cells", "cid", "n", "v")
    return each.withColumn("cells", F.when(F.col("cell") == F.col("homes"), F.col("cells")))


def _twice(cells: np.ndarray, homes: np.ndarray, cell: int) -> np.ndarray:
    """Whether a pair (host, visitor) is met in the visitor's home as well and counts there, since that is the lower cell and the host visits it."""
    names, place = np.unique(homes, return_inverse=True)
    visits = np.zeros((len(cells), len(names)), bool)
    flat = np.concatenate(cells)
    row = np.repeat(np.arange(len(cells)), [len(c) for c in cells])
    at = np.minimum(np.searchsorted(names, flat), len(names) - 1)
    known = names[at] == flat
    visits[row[known], at[known]] = True
    return visits[:, place] & (homes < cell)[None, :]


def _compare(rows: DataFrame, floor: float) -> DataFrame:
    """(cid, n, to): links found for a class of vectors (n, counting copies) and one class it is connected to.

    Home rows and visitors of a cell are dealt into blocks by their own numbers; each pair of home blocks, and of a home and a visitors' block, is a group.
    """
    here = F.col("cell") == F.col("homes")
    sizes = rows.groupBy("label", "cell").agg(F.count_if(here).alias("home"), F.count_if(~here).alias("visits"))
    blocks = lambda c: F.ceil(F.col(c) / BLOCK).cast("int")
    sizes = sizes.filter("home > 0").select("label", "cell", blocks("home").alias("hb"), blocks("visits").alias("vb"))
    dealt = rows.join(sizes, ["label", "cell"]).withColumn("deal", F.pmod(F.xxhash64("cid", F.lit(3)), F.when(here, F.col("hb")).otherwise(F.col("vb"))).cast("int"))
    group = lambda i, j: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"))
    deal, upto = F.col("deal"), lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    among = F.transform(upto("hb"), lambda o: group(F.least(deal, o), F.greatest(deal, o)))
    hosting = F.when(F.col("vb") > 0, F.transform(upto("vb"), lambda o: group(deal, -1 - o))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    meets = F.when(here, F.concat(among, hosting)).otherwise(F.transform(upto("hb"), lambda o: group(o, -1 - deal)))
    spread = dealt.select("label", "cell", F.explode(meets).alias("m"), "homes", "cid", "n", "deal", "cells", "v")
    tasks = spread.select("label", "cell", "m.i", "m.j", "homes", "cid", "n", "deal", "cells", "v").repartition("label", "cell", "i", "j").sortWithinPartitions("label", "cell", "i", "j", "cid")

    def links(cols):
        _, cell, i, j, homes, cid, n, deal, cells, v = cols
        cell, i, j = int(cell[0]), int(i[0]), int(j[0])
        home = homes == cell
        a, b = (np.flatnonzero(home & (deal == i)), np.flatnonzero(home & (deal == j))) if j >= 0 else (np.flatnonzero(home), np.flatnonzero(~home))
        if not len(a) or not len(b):
            return
        x, y = np.stack(v[a]), np.stack(v[b])
        hit = np.empty((len(a), len(b)), bool)
        for k in range(0, len(a), 256):
            at = slice(k, k + 256)
            hit[at] = x[at] @ y.T >= floor
            if j == i:
                hit[at] &= cid[a[at]][:, None] != cid[b][None, :]
            elif j < 0 and hit[at].any():
                hit[at] &= ~_twice(cells[a[at]], homes[b], cell)
        if not hit.any():
            return
        count, label = np.zeros(len(cid), np.int64), cid.copy()
        count[a] += hit @ n[b]
        if j != i:
            count[b] += hit.T @ n[a]
        while True:  # smallest class connected within this pair of blocks
            low = np.where(hit, label[b][None, :], np.iinfo(np.int64).max).min(axis=1)
            new = label.copy()
            new[a] = np.minimum(new[a], low)
            low = np.where(hit, new[a][:, None], np.iinfo(np.int64).max).min(axis=0)
            new[b] = np.minimum(new[b], low)
            if (new == label).all():
                break
            label = new
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(cid[found]), pa.array(count[found]), pa.array(label[found])], names=["cid", "n", "to"])

    return tasks.mapInArrow(tk.tidy(lambda batches: grouped(batches, 4, links)), "cid long, n long, to long")


def near_vectors(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    floor: float = 0.93,
    margin: float = MARGIN,
    cell: int = CELL,
    seed: int = 17,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of df.

    Vectors of equal, non-null labels and equal dimension are linked when their cosine in double precision is `floor`
    or more (no pair below it is ever linked; a pair whose vectors are far from each other's cells may be missed). n_links: other
    rows linked directly; component_id: the smallest id reachable; kept: whether that is the row's own id.
    Vectors that are null, empty, zero or have null or non-finite components, and rows with a null label or id,
    link with nothing: n_links 0, their own id, kept. Repeated rows are linked copies; different vectors that share an id have their own links each; an empty table gives an empty
    result; other columns of df are not looked at.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("e"))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x * x)))
    good = F.col("id").isNotNull() & F.col("label").isNotNull() & (F.col("norm") > 0) & (F.col("norm") < float("inf"))
    rows = rows.withColumn("good", F.coalesce(good & ~F.isnan("norm"), F.lit(False)))
    rows = rows.withColumns({"h1": F.xxhash64("e"), "h2": F.xxhash64(F.lit(1), "e")})
    valid = rows.filter("good")
    classes = valid.groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("e").alias("e"), F.first("norm").alias("norm"))
    classes = classes.withColumn("v", F.transform("e", lambda x: x / F.col("norm"))).select("label", "h1", "h2", "id", "n", "v")
    # vectors may share an id, so a class has a number of its own; it is fixed by being written
    unit = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "vectors")

    kinds = unit.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not kinds:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    largest = unit.groupBy("label").count().agg(F.max("count")).first()[0]
    k = int(min(CELLS, max(2, -(-largest // cell))))
    center = centroids(unit, kinds[0]["dim"], k, seed) if unit.count() > k else np.zeros((1, kinds[0]["dim"]))
    found = staged(_compare(_assigned(unit, center, margin), floor), "links")
    counts = found.groupBy("cid").agg(F.sum("n").alias("links"))
    placed = components(found, "cid", "to").withColumnRenamed("id", "cid")
    out = unit.select("label", "h1", "h2", "cid", "id", "n").join(counts, "cid", "left").join(placed, "cid", "left")
    out = staged(out.select("label", "h1", "h2", "id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "cid").alias("component")), "classes")
    first = out.groupBy("component").agg(F.min("id").alias("first"))
    out = out.join(first, "component").select("label", "h1", "h2", "links", "first")
    key = [rows[c] == out[c] for c in ("label", "h1", "h2")]
    joined = rows.join(out, [*key, rows["good"]], "left")
    component = F.coalesce(out["first"], rows["id"])
    return joined.select(
        rows["id"].alias(id_col),
        F.coalesce(out["links"], F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(rows["id"] == component, F.lit(True)).alias("kept"),
    )
