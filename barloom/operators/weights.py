"""Overlap-aware event weights, from elementary intervals between the starts and ends of a symbol's events.

Each event adds one at its start and takes one off at its end; a running sum gives the concurrency of each elementary interval,
a second one its prefix over intervals, and an event's mean is a difference of two prefixes: two equi-joins, no range join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..sources.staging import staged
from .scan import DAY_US, running_sum, running_sums


def _prefix(events: DataFrame, inverse: bool, points: bool) -> DataFrame:
    """(symbol, edge, at, sum): `at` intervals lie before the edge, with `sum` of their (inverse) concurrency."""
    delta = F.explode(F.array(F.struct(F.col("us").alias("edge"), F.lit(1).alias("d")), F.struct(F.col("end_us").alias("edge"), F.lit(-1).alias("d"))))
    edges = events.filter("end_us >= us" if points else "end_us > us").select("symbol", delta.alias("e")).groupBy("symbol", "e.edge").agg(F.sum("e.d").alias("d"))
    edges = staged(edges, "edges")  # running sums read their rows twice, and so does who reads the prefix
    day = F.floor(F.col("edge") / DAY_US)
    conc = running_sum(edges, ["symbol"], ["edge"], F.col("d"), day, "conc")
    value = 1 / F.greatest("conc", F.lit(1)) if inverse else F.col("conc").cast("double")
    conc = staged(conc.select("symbol", "edge", "conc", value.alias("v")), "concurrency")
    sums = running_sums(conc, ["symbol"], ["edge"], {"sum": F.col("v"), "at": F.lit(1).cast("long")}, day)
    return staged(sums.select("symbol", "edge", "conc", (F.col("at") - 1).alias("at"), (F.col("sum") - F.col("v")).alias("sum")), "prefix")


def _mean(events: DataFrame, inverse: bool, points: bool = False) -> DataFrame:
    p = _prefix(events, inverse, points)
    a = p.select("symbol", F.col("edge").alias("us"), F.col("at").alias("_a"), F.col("sum").alias("_sa"), *(["conc"] if points else []))
    a = a.withColumnRenamed("conc", "_conc")
    b = p.select("symbol", F.col("edge").alias("end_us"), F.col("at").alias("_b"), F.col("sum").alias("_sb"))
    out = events.join(a.hint("merge"), ["symbol", "us"], "left").join(b.hint("merge"), ["symbol", "end_us"], "left")  # as many rows as edges: never broadcast
    mean = F.when(F.col("end_us") > F.col("us"), (F.col("_sb") - F.col("_sa")) / F.nullif(F.col("_b") - F.col("_a"), F.lit(0)))
    return out.withColumn("_mean", mean).drop("_a", "_b", "_sa", "_sb")


def uniqueness(events: DataFrame, normalise: bool = True, within: tuple[str, ...] = ()) -> DataFrame:
    """events (symbol, us, end_us) with `weight`: mean of 1/concurrency over its elementary intervals; 1 for events without length.

    With normalise, weights are divided by their mean over all rows, or over the rows of equal `within` columns.
    """
    out = _mean(events, True).withColumn("weight", F.coalesce("_mean", F.lit(1.0))).drop("_mean")
    if normalise:
        out = staged(out, "uniqueness")
        means = out.groupBy(*within).agg(F.avg("weight").alias("_m"))  # without keys one row
        out = out.join(means, list(within)) if within else out.join(F.broadcast(means))
        out = out.withColumn("weight", F.when(F.col("_m") > 0, F.col("weight") / F.col("_m")).otherwise(F.col("weight"))).drop("_m")
    return out


def mean_concurrency_weight(events: DataFrame) -> DataFrame:
    """events with `weight`: 1 / mean concurrency over its elementary intervals, not normalised.

    An event without length has that of the interval it stands at, so it counts among the edges; one that ends before it starts has 1.
    """
    point = F.col("end_us") == F.col("us")
    out = _mean(events, False, points=True)
    at_point = F.when(point, F.col("_conc").cast("double"))
    return out.withColumn("weight", 1 / F.greatest(F.coalesce("_mean", at_point, F.lit(1.0)), F.lit(1.0))).drop("_mean", "_conc")


def fold_weights(folds: DataFrame, labels: DataFrame | None, horizon_us: int) -> DataFrame:
    """(fold, eid, label, sample_w): uniqueness within each fold's training rows, normalised in it.

    folds (eid, fold, split), labels (eid, symbol, us, label and what end_us() reads), or None where folds carry these columns. An event's interval is open among the training rows of its
    fold only, so the same event weighs differently in other folds.
    """
    train = folds.filter("split = 'train'")
    rows = train.drop("split") if labels is None else train.select("fold", "eid").join(labels, "eid")
    rows = rows.withColumn("end_us", S.end_us(rows.columns if labels is None else labels.columns, horizon_us)).withColumn("symbol", F.concat_ws("/", F.col("fold").cast("string"), "symbol"))
    rows = staged(rows.select("fold", "eid", "symbol", "us", "end_us", "label"), "training")
    return uniqueness(rows, within=("fold",)).select("fold", "eid", "label", F.col("weight").alias("sample_w"))


def monthly_mean(df: DataFrame, weight: str = "weight", time: str = "us") -> DataFrame:
    """(month, n, mean): mean weight of each month's rows."""
    return df.groupBy(S.month(F.col(time)).alias("month")).agg(F.count("*").alias("n"), F.avg(weight).alias("mean"))


def weight_stats(df: DataFrame, weight: str = "weight") -> DataFrame:
    """(n, mean, least, most) in one row."""
    return df.agg(F.count(weight).alias("n"), F.avg(weight).alias("mean"), F.min(weight).alias("least"), F.max(weight).alias("most"))


def batch_normalised(df: DataFrame, batch: str, weight: str = "weight") -> DataFrame:
    """df with `batch_w`: the weight over the mean of the positive ones of its batch; as it is where none is positive."""
    means = df.groupBy(batch).agg(F.avg(F.when(F.col(weight) > 0, F.col(weight))).alias("_m"))
    return df.join(means, batch).withColumn("batch_w", F.coalesce(F.try_divide(F.col(weight), F.col("_m")), F.col(weight))).drop("_m")


def class_weights(df: DataFrame, label: str = "label", weight: str = "weight") -> DataFrame:
    """df with `class_w` (inverse share of the label's rows, mean one over classes) and `sample_w`, its product with weight."""
    counts = df.groupBy(label).agg(F.count("*").alias("_n"))
    norm = counts.agg(F.avg(1 / F.col("_n")).alias("_mean"))
    table = counts.join(F.broadcast(norm)).select(label, (1 / F.col("_n") / F.col("_mean")).alias("class_w"))  # norm is one row
    return df.join(table, label).withColumn("sample_w", F.col("class_w") * F.col(weight))
