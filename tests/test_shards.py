"""Shards: written, appended, read back whole and by single rows; a failed task leaves nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.sources import shards

CHANNELS, SIDE = ("a", "b"), 3


def frame(spark, first, n, parts=2):
    rows = [("S", first + i, [float(first + i)] * 9, [float(j) for j in range(9)]) for i in range(n)]
    return spark.createDataFrame(rows, "symbol string, start long, a array<float>, b array<float>").repartitionByRange(parts, "start").sortWithinPartitions("start")


def files(path):
    return sorted(os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs)


def test_written_appended_and_read_back(spark, tmp_path):
    path = str(tmp_path / "images")
    shards.write_shards(frame(spark, 0, 25), path, CHANNELS, SIDE, 5)
    shards.write_shards(frame(spark, 100, 7, 1), path, CHANNELS, SIDE, 5)
    names = [f for f in files(path) if f.endswith(".npy")]
    assert names == [f"shards/images_{k:04d}.npy" for k in range(len(names))] and not any("_run" in f for f in files(path))
    rows = shards.manifest(spark, path).orderBy("shard", "idx_in_shard").collect()
    assert sorted(r.start for r in rows) == [*range(25), *range(100, 107)] and len({(r.shard, r.idx_in_shard) for r in rows}) == 32
    assert {r.shard for r in rows if r.start >= 100} == {len(names) - 2, len(names) - 1}
    for r in rows:
        array = np.load(f"{path}/{r.relpath}")
        assert array.dtype == np.float32 and array.shape[1:] == (2, 3, 3) == (r.c, r.h, r.w)
        assert (array[r.idx_in_shard, 0] == r.start).all() and array[r.idx_in_shard, 1].ravel().tolist() == list(range(9))
    whole = spark.read.format("image_shards").option("path", path).load()
    joined = whole.join(shards.manifest(spark, path), ["shard", "idx_in_shard"])
    assert joined.count() == 32 and joined.filter(F.get("image", 0) != F.col("start")).count() == 0


def test_single_rows_are_fetched(spark, tmp_path):
    path = str(tmp_path / "images")
    shards.write_shards(frame(spark, 0, 600, 3), path, CHANNELS, SIDE, 64)
    rows = shards.manifest(spark, path).filter("start % 7 = 3").select("shard", "idx_in_shard", "start")
    got = shards.fetch(rows.unionByName(rows.filter("start < 50")), path).collect()
    assert len(got) == 86 + 7 and all(r.image[0] == r.start and len(r.image) == 18 and (r.c, r.h, r.w) == (2, 3, 3) for r in got)
    odd = spark.createDataFrame([(999, 0, "x"), (0, 9999, "y"), (0, -1, "z"), (None, 1, "n"), (0, None, "n")], "shard int, idx_in_shard int, image2 string")
    assert shards.fetch(odd, path).count() == 0


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "images")
    shards.write_shards(frame(spark, 0, 10), path, CHANNELS, SIDE, 5)
    before = files(path)
    bad = frame(spark, 50, 40, 4).withColumn("a", F.when(F.col("start") == 89, F.expr("raise_error('no')")).otherwise(F.col("a")))
    with pytest.raises(Exception):
        shards.write_shards(bad, path, CHANNELS, SIDE, 5)
    wrong = frame(spark, 50, 4).withColumn("a", F.when(F.col("start") == 53, F.array(F.lit(1.0))).otherwise(F.col("a")))
    with pytest.raises(Exception):
        shards.write_shards(wrong, path, CHANNELS, SIDE, 5)
    assert files(path) == before
    shards.write_shards(frame(spark, 10, 1).filter("false"), path, CHANNELS, SIDE, 5)
    lost = frame(spark, 200, 2, 1).withColumn("b", F.when(F.col("start") == 200, F.col("b")))
    shards.write_shards(lost, path, CHANNELS, SIDE, 5)
    assert sorted(r.start for r in shards.manifest(spark, path).collect()) == [*range(10), 200]
