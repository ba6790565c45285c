"""Splits cut into pieces give the predictions of whole ones."""

from pyspark.sql import functions as F

from barloom.operators import fitting


def test_pieces_change_no_prediction(spark, monkeypatch):
    df = spark.range(200).select(F.col("id").alias("eid"), (F.col("id") % 2).cast("int").alias("fold"), F.when(F.col("id") % 3 == 0, "val").otherwise("train").alias("split"), (F.col("id") % 5 > 2).cast("int").alias("label"), (F.col("id") % 7).cast("double").alias("a"))
    plan = fitting.Plan(("a",), 2, fitting.logistic_path((0.1,), 10))
    run = lambda: {r.eid: r.probs for r in fitting.train_folds(df, plan)[0].collect()}
    whole = run()
    monkeypatch.setattr(fitting, "PIECE", 20)
    cut = run()
    assert cut.keys() == whole.keys() and len(cut) == 67
    assert all(abs(x - y) < 1e-9 for i in cut for x, y in zip(cut[i], whole[i]))
