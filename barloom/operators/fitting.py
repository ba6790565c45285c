"""Training over folds: a pyspark.ml pipeline for each fold, stopped by its validation loss, with predictions that go on to the sweeps.

Rows of all folds are written once, partitioned by fold and split, so that a fit reads only its own. A fold is trained in steps (a path of
regularisations, or further iterations of a perceptron from where the last step ended) until `patience` steps in a row have not lowered the
weighted validation loss; the best step predicts. Folds are independent, run side by side, and each writes its predictions as a
partition of its own: a run that was ended goes on with the folds that are missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import exists
from ..sources.staging import shared_dir

#: Rows of all folds for each piece that a split is cut into.
PIECE = 4_000_000
#: A step gives the estimator of an epoch from the model of the one before, or None where the path ends.
Step = Callable[[object, int], object]


@dataclass(frozen=True)
class Plan:
    """What is trained: steps, the columns they read, and when to stop."""

    features: tuple[str, ...]
    classes: int
    steps: Step
    epochs: int = 20
    patience: int = 4
    min_delta: float = 1e-4
    parallel: int = 2
    extra: tuple[str, ...] = field(default=())  # columns that predictions carry on


def logistic_path(regs: tuple[float, ...] = (1.0, 0.3, 0.1, 0.03, 0.01, 0.003, 0.001), iterations: int = 50) -> Step:
    """Multinomial regressions from the strongest regularisation to the weakest, on weighted rows."""

    def step(previous, epoch):
        if epoch >= len(regs):
            return None
        return LogisticRegression(family="multinomial", regParam=regs[epoch], maxIter=iterations, tol=1e-6, standardization=False, weightCol="sample_w")

    return step


def perceptron_epochs(layers: tuple[int, ...], iterations: int = 5, seed: int = 1337) -> Step:
    """A perceptron trained on from epoch to epoch; it knows no weights, so train it on rows drawn by them."""

    def step(previous, epoch):
        est = MultilayerPerceptronClassifier(layers=list(layers), maxIter=iterations, seed=seed)
        return est if previous is None else est.setInitialWeights(previous.weights)

    return step


def sample_weights(rows: DataFrame) -> DataFrame:
    """rows (fold, split, label, uniqueness) with `sample_w`: uniqueness over the number of the fold's training rows of that label.

    A missing uniqueness counts one, and so does a label that no training row of the fold has.
    """
    counts = rows.filter("split = 'train'").groupBy("fold", "label").agg(F.count("*").alias("_n"))  # a row for each fold and class
    uniq = F.coalesce(F.col("uniqueness").cast("double"), F.lit(1.0)) if "uniqueness" in rows.columns else F.lit(1.0)
    return rows.join(F.broadcast(counts), ["fold", "label"], "left").withColumn("sample_w", uniq / F.coalesce("_n", F.lit(1)) + 1e-12).drop("_n")


def _probs(model_output: str, classes: int) -> Column:
    """The probabilities as an array of that many classes; one that a fold's training rows lack has 0."""
    found = vector_to_array(model_output)
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.coalesce(F.get(found, i), F.lit(0.0)))


def _scored(model, rows: DataFrame, classes: int) -> DataFrame:
    out = model.transform(rows).withColumn("probs", _probs("probability", classes))
    p = F.get("probs", F.col("label").cast("int"))
    top = F.array_position("probs", F.array_max("probs")) - 1
    return out.withColumns({"_loss": -F.ln(F.greatest(p, F.lit(1e-12))), "_hit": (top == F.col("label")).cast("double")})


def _fold(spark: SparkSession, table: DataFrame, out: str, fold: int, plan: Plan) -> list[tuple]:
    """Train one fold and write its predictions; (fold, epoch, train_loss, val_loss, val_acc, chosen) of its epochs."""
    rows = table.filter(F.col("fold") == fold).withColumn("label", F.col("label").cast("double"))
    train, val = rows.filter("split = 'train'"), rows.filter("split = 'val'")
    if train.isEmpty() or val.isEmpty():
        return []
    prep = Pipeline(stages=[VectorAssembler(inputCols=list(plan.features), outputCol="_raw", handleInvalid="error"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]).fit(train)
    ready, held = prep.transform(train).select("features", "label", "sample_w"), prep.transform(val)
    history, best, model, chosen = [], None, None, 0
    for epoch in range(plan.epochs):
        estimator = plan.steps(model, epoch)
        if estimator is None:
            break
        model = estimator.fit(ready)
        got = _scored(model, held, plan.classes).agg((F.sum(F.col("_loss") * F.col("sample_w")) / F.sum("sample_w")).alias("loss"), F.avg("_hit").alias("acc")).first()
        summary = (model.summary() if callable(model.summary) else model.summary) if model.hasSummary else None
        curve = list(summary.objectiveHistory) if summary is not None else []
        history.append((fold, epoch, float(curve[-1]) if curve else None, got.loss, got.acc))
        if best is None or got.loss < best[0] - plan.min_delta:
            best, chosen = (got.loss, model), epoch
        elif epoch - chosen >= plan.patience:
            break
    final = _scored(best[1], held, plan.classes)
    columns = ["eid", F.col("label").cast("int").alias("y_true"), "probs", *plan.extra]
    final.select(*columns).write.mode("overwrite").parquet(f"{out}/fold={fold}")
    return [(*h, h[1] == chosen) for h in history]


def train_folds(rows: DataFrame, plan: Plan, out: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(predictions, history) of every fold of rows (eid, fold, split, label from 0, features, and uniqueness where there is one).

    predictions: (eid, y_true, probs array, the extra columns, fold) of validation rows, read from the table at `out` (a new one in the shared folder without
    it). Folds that have a finished partition there are not trained again and have no history. Folds without training or validation rows are left out.
    Null features count 0, as do those that are not a number. The same rows give the same predictions.
    """
    from uuid import uuid4

    spark = rows.sparkSession
    base = f"{shared_dir(spark)}/staged/folds-{uuid4().hex}"
    out = out or f"{base}-predictions"
    clean = rows.select("eid", "fold", "split", "label", *(["uniqueness"] if "uniqueness" in rows.columns else []), *plan.extra, *[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(c) for c in plan.features])
    # a split is as many pieces, by its rows' ids, as keep each small enough to sort in memory; rows lie in order of their id, so that sums are added alike in every run
    pieces = clean.count() // PIECE + 1
    piece = [F.pmod(F.xxhash64("eid"), F.lit(pieces))] if pieces > 1 else []
    weighted = sample_weights(clean).repartition("fold", "split", *piece).sortWithinPartitions("fold", "split", "eid")
    weighted.write.partitionBy("fold", "split").parquet(base)
    table = spark.read.schema(weighted.schema).parquet(base)
    todo = [r.fold for r in table.select("fold").distinct().orderBy("fold").collect() if not exists(spark, f"{out}/fold={r.fold}/_SUCCESS")]
    with ThreadPool(min(plan.parallel, max(1, len(todo)))) as pool:
        found = pool.map(inheritable_thread_target(spark)(lambda f: _fold(spark, table, out, f, plan)), todo)
    schema = "fold int, epoch int, train_loss double, val_loss double, val_acc double, chosen boolean"
    history = spark.createDataFrame([h for fold in found for h in fold], schema)
    if not exists(spark, out):
        return spark.createDataFrame([], "eid long, y_true int, probs array<double>, fold int"), history
    return spark.read.parquet(out), history
