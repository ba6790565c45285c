"""Fold weights from carried columns, and how often their input is read."""

from pyspark.sql import functions as F

from barloom.operators import folds, weights

HOUR = 3_600_000_000


def test_carried_columns_weigh_as_joined_ones_and_input_is_not_read_again(spark):
    e = spark.range(600).select(F.lit("s").alias("symbol"), F.col("id").alias("eid"), (F.col("id") * HOUR).alias("us"), (F.col("id") * HOUR + F.col("id") % 27 * HOUR).alias("end_us"), (F.col("id") % 3).alias("label"))
    joined = weights.fold_weights(folds.purged_kfold(e, 5), e, HOUR)
    carried = weights.fold_weights(folds.purged_kfold(e, 5, carry=("symbol", "us", "end_us", "label")), None, HOUR)
    rows = lambda df: sorted((r.fold, r.eid, r.label, round(r.sample_w, 9)) for r in df.collect())
    assert rows(joined) == rows(carried) and len(rows(carried)) > 2000
    plan = carried._jdf.queryExecution().executedPlan().toString()
    assert "Range (" not in plan and "Window" not in plan  # sums and rows are read back, not made twice for the mean
