"""Training over folds: the optimum against plain gradient descent, early stopping, reproducible predictions, resuming."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import decisions, fitting
from barloom.sources.files import exists


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    n = 300
    x = rng.normal(size=(n, 2))
    label = np.where(x[:, 0] + 0.3 * rng.normal(size=n) > 0.5, 2, np.where(x[:, 1] > 0, 1, 0))
    base = [(i, float(a), None if i == 7 else float(b), int(y), 0.5 + (i % 3) / 2) for i, ((a, b), y) in enumerate(zip(x, label))]
    df = spark.createDataFrame(base, "eid long, a double, b double, label int, uniqueness double")
    folds = spark.createDataFrame([(k,) for k in range(3)], "fold int")
    return df.join(folds).coalesce(2).withColumn("split", F.when(F.col("eid") % 3 == F.col("fold"), "val").otherwise("train"))


def plan(**kw):
    return fitting.Plan(**({"features": ("a", "b"), "classes": 3, "steps": fitting.logistic_path((0.1, 0.01))} | kw))


def test_the_optimum_is_that_of_plain_descent(spark, rows):
    got, history = fitting.train_folds(rows, plan(steps=fitting.logistic_path((0.01,), 200)))
    assert history.count() == 3 and got.count() == 300
    table = rows.toPandas()
    for fold in range(3):
        t = table[table.fold == fold].fillna(0.0)
        tr, va = t[t.split == "train"], t[t.split == "val"].sort_values("eid")
        w = (tr.uniqueness / tr.label.map(tr.label.value_counts())).to_numpy() + 1e-12
        mean, sd = tr[["a", "b"]].mean().to_numpy(), tr[["a", "b"]].std(ddof=1).to_numpy()
        x, y = (tr[["a", "b"]].to_numpy() - mean) / sd, np.eye(3)[tr.label]
        beta, bias = np.zeros((2, 3)), np.zeros(3)
        for _ in range(4000):
            z = x @ beta + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            g = (p - y) * (w / w.sum())[:, None]
            beta -= 1.0 * (x.T @ g + 0.01 * beta)
            bias -= 1.0 * g.sum(axis=0)
        z = (va[["a", "b"]].to_numpy() - mean) / sd @ beta + bias
        want = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        mine = np.array([r.probs for r in got.filter(F.col("fold") == fold).orderBy("eid").collect()])
        assert np.abs(mine - want).max() < 2e-3


def test_stops_early_and_keeps_the_best(spark, rows):
    calls = []

    def steps(previous, epoch):
        calls.append(epoch)
        return fitting.logistic_path((0.1, 0.01, 5.0, 5.0, 5.0, 0.001), 50)(previous, epoch)

    got, history = fitting.train_folds(rows.filter("fold = 0"), plan(steps=steps, patience=2))
    found = history.orderBy("epoch").collect()
    assert [h.epoch for h in found] == calls == [0, 1, 2, 3]
    assert [h.chosen for h in found] == [False, True, False, False] and found[1].val_loss == min(h.val_loss for h in found)
    loss = decisions.fold_metrics(got.withColumnRenamed("y_true", "label"), ["fold"]).first()
    assert loss.n == 100 and loss.accuracy == pytest.approx(found[1].val_acc)


def test_reproducible_and_resumed(spark, rows, tmp_path):
    out = str(tmp_path / "predictions")
    key = lambda df: sorted((r.fold, r.eid, r.y_true, *r.probs) for r in df.collect())
    first = key(fitting.train_folds(rows, plan())[0])
    fitting.train_folds(rows.filter("fold <> 1"), plan(), out)
    half = spark.read.parquet(f"{out}/fold=0").inputFiles()
    again, history = fitting.train_folds(rows, plan(), out)
    assert key(again) == first and {h.fold for h in history.collect()} == {1}
    assert spark.read.parquet(f"{out}/fold=0").inputFiles() == half and exists(spark, f"{out}/fold=1/_SUCCESS")


def test_perceptron_goes_on_from_epoch_to_epoch(spark, rows):
    _, history = fitting.train_folds(rows.filter("fold = 2"), plan(steps=fitting.perceptron_epochs((2, 4, 3), 3), epochs=6, min_delta=0.0))
    found = history.orderBy("epoch").collect()
    assert found[-1].val_loss < found[0].val_loss


def test_folds_without_a_side_and_missing_classes(spark, rows):
    lone = rows.filter("fold = 0 and split = 'train'").unionByName(rows.filter("fold = 1 and not (split = 'train' and label = 2)"))
    got, history = fitting.train_folds(lone, plan())
    assert {h.fold for h in history.collect()} == {1} and {len(r.probs) for r in got.collect()} == {3} and got.agg(F.max(F.get("probs", 2))).first()[0] == 0.0
    assert fitting.train_folds(rows.filter("false"), plan())[0].count() == 0
