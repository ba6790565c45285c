"""Files around the tables, settings, and the joins of a trainer."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import policy, touch, training, weights
from barloom.sources import files
from barloom.sources import ticks as T


def test_snapshot(spark, tmp_path):
    for tag, rows in (("BTC_2024-01", ["a", "b"]), ("ETH_2024-01", ["c"])):
        (tmp_path / tag).mkdir()
        (tmp_path / tag / "manifest.csv").write_text("relpath,idx_in_shard\n" + "".join(f"{tag}/{r}.npy,{i}\n" for i, r in enumerate(rows)))
    for there in ("BTC_2024-01/a", "ETH_2024-01/x"):
        (tmp_path / f"{there}.npy").write_text("1")
    assert files.run_tags(spark, str(tmp_path)) == ["BTC_2024-01", "ETH_2024-01"]
    rows, counts = files.snapshot(spark, str(tmp_path))
    assert [r.relpath for r in rows.collect()] == ["BTC_2024-01/a.npy"] and rows.first().fullpath == f"{tmp_path}/BTC_2024-01/a.npy"
    assert {r.run_tag: r.n for r in counts.collect()} == {"BTC_2024-01": 1, "ETH_2024-01": 0}
    with pytest.raises(ValueError):
        files.snapshot(spark, str(tmp_path / "BTC_2024-01"))
    images = spark.createDataFrame([("a", 0, [1.0])], "symbol string, start long, gasf array<double>")
    one = files.examples(spark.createDataFrame([("a", 0), ("b", 0)], "symbol string, start long"), images).collect()
    assert [(r.y, r.w) for r in one] == [(0, 1.0)]


def test_sinks(spark, tmp_path):
    labels = spark.createDataFrame([(0, "t1"), (1, "pt"), (0, "dropped")], "label int, reason string")
    meta = files.write_labels(labels, str(tmp_path / "l"), {"pt": 1}, "2024-01-01")
    assert json.loads((tmp_path / "l.meta.json").read_text()) == meta == {"n_rows": 3, "n_dropped": 1, "label_counts": {"0": 2, "1": 1}, "config": {"pt": 1}, "created_utc": "2024-01-01"}
    rows = spark.createDataFrame([("a", "2024-01", 1), ("a", "2024-02", 2)], "symbol string, month string, v int")
    path = str(tmp_path / "chunks")
    files.write_chunks(rows.filter("v = 1"), path)
    assert [r.v for r in files.resumed(rows, path).collect()] == [2]
    files.write_chunks(rows.withColumn("v", F.col("v") * 10), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [1, 20]
    files.append_predictions(rows, str(tmp_path / "p"))
    files.append_predictions(rows, str(tmp_path / "p"))
    assert files.preview(spark.read.parquet(str(tmp_path / "p")), 1)["rows"] == 4
    assert files.newest(spark, f"{tmp_path}/*.json").endswith("l.meta.json") and files.newest(spark, f"{tmp_path}/*.none") is None
    folds = spark.createDataFrame([(1, 0, "train"), (2, 0, "val")], "eid long, fold int, split string")
    files.write_splits(folds, spark.createDataFrame([(1, 10, 0), (2, 20, 1)], "eid long, us long, label int"), str(tmp_path / "s"))
    assert {(r.fold, r.split, r.us) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(0, "train", 10), (0, "val", 20)}


def test_tick_sources_and_modes(spark, tmp_path):
    (tmp_path / "B-1m-2024-01.csv").write_text("timestamp,high,low\n1700000000,3,1\n")
    assert files.tick_source(spark, str(tmp_path), "B", "2024-01").endswith("B-1m-2024-01.csv")
    assert files.tick_source(spark, str(tmp_path), "B", "2024-01", ticks_only=True) is None
    raw = spark.read.csv(str(tmp_path / "B-1m-2024-01.csv"), header=True)
    assert [tuple(r) for r in T.label_path(raw).collect()] == [(1700000000000000, 3.0, 1.0)]
    assert [tuple(r) for r in T.label_path(raw.withColumn("Last", F.lit("2"))).collect()] == [(1700000000000000, 2.0, 2.0)]
    for mode, columns in (("ticks", ["ts", "high", "low"]), ("hilo", ["ts", "price"]), ("auto", ["ts", "open"]), ("auto", ["price"])):
        with pytest.raises(ValueError):
            T.label_path(spark.createDataFrame([("1",) * len(columns)], columns), mode)
    assert T.schema_audit(spark, [str(tmp_path / "none.csv"), str(tmp_path / "B-1m-2024-01.csv")])[0][1] != "ok"
    assert T.resolve(["t", "p", "amount"])["quote_qty"] == "amount" and T.resolve(["t", "p", "base_qty", "trade_side"])["side"] == "trade_side"


def test_settings(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"2024-01": {"tp_mult": 2}, "global": {"tp_mult": 9, "sl_mult": 9}}')
    (tmp_path / "r.json").write_text('{"2024-02": "2024-01"}')
    (tmp_path / "c.yaml").write_text("barriers:\n  mode: percent\n  up: 0.1\n  down: 0.2\n")
    rows = spark.createDataFrame([("2024-01",), ("2024-02",)], "month string")
    pol = files.read_policy(spark, str(tmp_path / "p.json"))
    got = lambda reg: sorted((r.month, r.tp_mult, r.sl_mult) for r in policy.level_for(rows, pol, reg, 1.0, 1.5).collect())
    assert got(None) == [("2024-01", 2.0, 1.5), ("2024-02", 1.0, 1.5)]
    assert got(files.read_regimes(spark, str(tmp_path / "r.json"))) == [("2024-01", 1.0, 1.5), ("2024-02", 2.0, 1.5)]
    assert files.labeling_settings(files.read_settings(spark, str(tmp_path / "c.yaml")))["normalize_by_close"] is True
    for bad in (None, {"barriers": {"mode": "x"}}, {"barriers": {"mode": "atr", "up": 1, "pt_mult": 1, "sl_mult": 1}}, {"barriers": {"mode": "percent", "up": 1}}):
        with pytest.raises(ValueError):
            files.labeling_settings(bad)
    assert [files.class_weights(t) for t in ('{"0": 1, "1": 2.5}', "{0: 1, 1: 2.5}", "0:1,1:2.5", "", None)] == [{0: 1.0, 1: 2.5}] * 3 + [None] * 2


def test_trainer_joins(spark):
    folds = spark.createDataFrame([(1, 0, "train"), (2, 0, "val"), (3, 1, "train")], "eid long, fold int, split string")
    labels = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "eid long, label int")
    assert training.fold_rows(folds, labels, 0).count() == 2
    with pytest.raises(ValueError):
        training.fold_rows(folds, labels, 1)
    with pytest.raises(ValueError):
        touch.label_at(labels, labels, 1.0, 1.0)
    w = weights.batch_normalised(spark.createDataFrame([(0, 0.0), (0, 2.0), (0, 4.0), (1, 0.0)], "b int, weight double"), "b").collect()
    assert sorted(r.batch_w for r in w) == [0.0, 0.0, 2 / 3, 4 / 3]


def test_first_touch_levels(spark):
    """Narrowing by extremes finds what a direct join finds."""
    import random

    rng = random.Random(2)
    path = spark.createDataFrame([("s", x, rng.uniform(0, 100), rng.uniform(-100, 0)) for x in sorted(rng.sample(range(5000), 900))], "k string, x long, high double, low double")
    events = spark.createDataFrame([("s", i, rng.randint(0, 4900), rng.uniform(90, 101), -rng.uniform(90, 101)) for i in range(300)], "k string, eid long, lo long, up double, dn double").withColumn("hi", F.col("lo") + 1000)
    keys = ["eid", "at", "hit_up", "hit_dn"]
    want = sorted(map(tuple, touch.first_touch(events, path, ["k"], 1000).select(*keys).collect()))
    for levels, fan in ((1, 10), (2, 4), (3, 16)):
        assert sorted(map(tuple, touch.first_touch(events, path, ["k"], 1000, levels, fan).select(*keys).collect())) == want
