"""Evaluation of predictions: threshold sweeps, expected value, precision-recall, profit and loss, losses and label reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .halo import ROWS, previous, running_max
from .scan import running_sums


def ev_sweep(df: DataFrame, keys: list[str], steps: int, win: float, loss: float, least: int) -> DataFrame:
    """(keys, threshold, n, precision, ev): the threshold of i * (1/steps) with the highest expected value for each group, the lowest of equals.

    Rows are counted by grid cell first; a threshold's counts are suffix sums over at most steps + 1 cells, so rows are
    not multiplied by thresholds. Groups in which no threshold has `least` rows get nulls and their number of rows.
    """
    step = 1.0 / steps
    guess = F.floor(F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0)) * steps).cast("int")
    p = F.greatest(F.least(F.col("p"), F.lit(1.0)), F.lit(0.0))
    # the product may fall on the wrong side of a threshold
    cell = F.when(p >= (guess + 1) * step, guess + 1).when(p < guess * step, guess - 1).otherwise(guess)
    cells = df.groupBy(*keys, cell.alias("i")).agg(F.count("*").alias("c"), F.sum("y").alias("s"))
    grid = df.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(steps))))
    w = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    full = grid.join(cells, [*keys, "i"], "left").select(*keys, "i", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("n"), F.coalesce(F.sum("s").over(w), F.lit(0)).alias("hits"))
    prec = F.try_divide("hits", "n")
    full = full.withColumn("precision", prec).withColumn("ev", F.col("precision") * win - (1 - F.col("precision")) * loss)
    good = F.when((F.col("n") >= least) & F.col("ev").isNotNull(), F.struct(F.col("ev"), (-F.col("i")).alias("m"), F.col("n"), F.col("precision")))
    best = full.groupBy(*keys).agg(F.max(good).alias("b"), F.max("n").alias("all"))
    return best.select(*keys, (-F.col("b.m") * step).alias("threshold"), F.coalesce("b.n", "all").alias("n"), F.col("b.precision").alias("precision"), F.col("b.ev").alias("ev"))


def precision_recall(df: DataFrame, win: float, loss: float) -> DataFrame:
    """(n, base, average_precision, lift, breakeven) in one row; equal probabilities are one step of the curve."""
    steps = df.groupBy("p").agg(F.count("*").alias("c"), F.sum("y").alias("s"))
    total = steps.agg(F.sum("s").alias("pos"), F.sum("c").alias("n"))
    # from the highest probability down, cut into buckets of probabilities
    falling = steps.withColumns({"one": F.lit(1), "down": -F.col("p")})
    curve = running_sums(falling, ["one"], ["down"], {"_s": F.col("s"), "_c": F.col("c")}, F.floor(F.col("down") * 1024))
    curve = curve.select("s", (F.col("_s") / F.col("_c")).alias("prec"))
    ap = curve.agg(F.sum(F.col("s") * F.col("prec")).alias("a")).join(F.broadcast(total))
    base = F.col("pos") / F.col("n")
    return ap.select("n", base.alias("base"), (F.col("a") / F.col("pos")).alias("average_precision"), (F.col("a") / F.col("pos") / base).alias("lift"), F.lit(loss / (win + loss)).alias("breakeven"))


def ev_by(df: DataFrame, key: str, threshold: float, win: float, loss: float) -> DataFrame:
    """(key, n, precision, ev) at one threshold; groups in which nothing is chosen have zeros."""
    chosen = F.col("p") >= threshold
    out = df.groupBy(key).agg(F.count_if(chosen).alias("n"), F.sum(F.when(chosen, F.col("y")).otherwise(0)).alias("_h"))
    prec = F.coalesce(F.try_divide("_h", "n"), F.lit(0.0))
    return out.select(key, "n", prec.alias("precision"), F.when(F.col("n") > 0, prec * win - (1 - prec) * loss).otherwise(0.0).alias("ev"))


def pnl_grid(df: DataFrame, thresholds: list[float], confidences: list[float], fee_bp: float, periods_per_year: int = 252 * 24 * 60) -> DataFrame:
    """(threshold, confidence, n, mean, sd, sharpe) over rows (p_pos, p_neg, conf, label) for every grid point.

    Rows with conf below the confidence are left out; all others earn 1 if the action (p_pos at or above the threshold, less p_neg at or
    above it) is the label and -1 if it isn't, less the fee. Rows are counted by what they have reached of both grids first, so a row is
    never multiplied by the grid; mean and sample deviation follow from the counts. Points without rows have null figures.
    """
    reached = lambda x, grid: F.size(F.filter(F.array(*[F.lit(float(g)) for g in grid]), lambda g: g <= x))
    rows = df.select(reached(F.col("p_pos"), thresholds).alias("a"), reached(F.col("p_neg"), thresholds).alias("z"), reached(F.col("conf"), confidences).alias("c"), "label")
    cells = rows.groupBy("a", "z", "c", "label").agg(F.count("*").alias("k"))
    points = [(i, float(t), j, float(c)) for i, t in enumerate(sorted(thresholds)) for j, c in enumerate(sorted(confidences))]
    grid = df.sparkSession.createDataFrame(points, "i int, threshold double, j int, confidence double")
    act = (F.col("a") > F.col("i")).cast("int") - (F.col("z") > F.col("i")).cast("int")
    met = cells.join(F.broadcast(grid), F.col("c") > F.col("j"), "right")  # the grid is a parameter
    right = F.sum(F.when(act == F.col("label"), F.col("k")).otherwise(0))
    out = met.groupBy("i", "j", "threshold", "confidence").agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), right.alias("_r"))
    gross = F.try_divide(2 * F.col("_r") - F.col("n"), F.col("n"))
    out = out.withColumns({"mean": gross - fee_bp / 1e4, "sd": F.when(F.col("n") > 1, F.sqrt(F.col("n") * (1 - gross * gross) / (F.col("n") - 1)))})
    return out.withColumn("sharpe", F.col("mean") / (F.col("sd") + 1e-9) * periods_per_year**0.5).drop("_r")


def best_point(grid: DataFrame) -> DataFrame:
    """The grid point of the highest sharpe in one row, the first of equals by threshold and then confidence."""
    named = ("threshold", "confidence", "sharpe", "mean", "n")
    top = F.max_by(F.struct(*named), F.struct(F.col("sharpe"), -F.col("i"), -F.col("j")))
    return grid.filter("sharpe is not null").agg(top.alias("b")).select("b.*")


def positions(p_pos: Column, p_flat: Column, p_neg: Column, threshold: float) -> Column:
    """1, 0 or -1 for the likeliest of the three, the earlier of equals; 0 below the threshold."""
    top = F.greatest(p_pos, p_flat, p_neg)
    return F.when(top < threshold, 0).when(p_pos == top, 1).when(p_flat == top, 0).otherwise(-1)


def equity(df: DataFrame, keys: list[str], order: list[str], fee_bp: float, slip_bp: float) -> DataFrame:
    """df (price, position) with `pnl`, `equity`, `drawdown`: returns over the current price, costs on changes of position. order is a column of positions 0, 1, 2 ..."""
    pos = order[0]
    rows = previous(df, keys, pos, {"_price": "price", "_held": "position"})
    ret = F.coalesce((F.col("price") - F.col("_price")) / F.col("price"), F.lit(0.0))
    turn = F.abs(F.col("position") - F.coalesce("_held", F.lit(0)))
    rows = rows.withColumn("pnl", F.col("position") * ret - (fee_bp + slip_bp) * 1e-4 * turn).drop("_price", "_held")
    # a product: logarithms of the sizes, the number of negative factors, and whether any was zero
    factor = 1 + F.col("pnl")
    parts = {"_ln": F.coalesce(F.ln(F.nullif(F.abs(factor), F.lit(0.0))), F.lit(0.0)), "_neg": (factor < 0).cast("long"), "_nil": (factor == 0).cast("long")}
    rows = running_sums(rows, keys, [pos], parts, F.floor(F.col(pos) / ROWS))
    sign = F.when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    rows = rows.withColumn("equity", F.when(F.col("_nil") > 0, 0.0).otherwise(F.exp("_ln") * sign)).drop(*parts)
    rows = running_max(rows, keys, pos, F.col("equity"), "_top")
    return rows.withColumn("drawdown", 1 - F.col("equity") / F.col("_top")).drop("_top")


def label_shares(df: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, percent)."""
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    return n.join(F.broadcast(n.agg(F.sum("n").alias("_all")))).select(label, "n", F.round(100 * F.col("n") / F.col("_all"), 2).alias("percent"))


def label_pivot(df: DataFrame, key: str, labels: list[int], label: str = "label") -> DataFrame:
    """(key, n_<label> ..., total, pct_<label> ...): counts of each label by key; -1 is written m1."""
    name = lambda v: str(v).replace("-", "m")
    out = df.groupBy(key).agg(*[F.count_if(F.col(label) == v).alias(f"n_{name(v)}") for v in labels], F.count("*").alias("total"))
    return out.select("*", *[F.round(100 * F.col(f"n_{name(v)}") / F.col("total"), 2).alias(f"pct_{name(v)}") for v in labels])


def cross_entropy(p_true: Column, weight: Column, gamma: float = 0.0, least: float = 0.0, most: float = float("inf")) -> Column:
    """Weighted, with gamma > 0 focal, loss of the probability given to the true class."""
    p = F.greatest(p_true, F.lit(1e-12))
    w = F.greatest(F.least(weight, F.lit(most)), F.lit(least))
    return F.pow(1 - p, F.lit(gamma)) * -F.ln(p) * w


def temperatures(df: DataFrame, grid: list[float]) -> DataFrame:
    """(temperature, nll) for each candidate: mean loss of z/T for binary log odds z and outcomes y."""
    t = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("temperature")
    rows = df.select("z", "y", t).withColumn("_z", F.col("z") / F.col("temperature") * (1 - 2 * F.col("y")))
    softplus = F.greatest("_z", F.lit(0.0)) + F.log1p(F.exp(-F.abs("_z")))
    return rows.groupBy("temperature").agg(F.avg(softplus).alias("nll"))


def fitted_temperature(df: DataFrame, low: float = 1e-3, high: float = 100.0, rounds: int = 60, near: float = 1e-12) -> DataFrame:
    """(temperature, nll) in one row: the temperature in low .. high of least mean loss, for binary log odds z and outcomes y.

    The loss is convex in 1 / temperature, so Newton steps on sums of its first and second derivative lead to the minimum; where a step would leave the range that
    is still open, its middle is taken. A round is one aggregate over the rows, none of which is multiplied. Without rows both are null.
    """
    rows = df.filter("z is not null and y is not null").select((F.col("z") * (2 * F.col("y") - 1)).alias("w"))
    softplus = lambda x: F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))

    def at(b: float):
        s = 1 / (1 + F.exp(F.col("w") * b))
        return rows.agg(F.avg(-F.col("w") * s).alias("g"), F.avg(F.col("w") * F.col("w") * s * (1 - s)).alias("h"), F.avg(softplus(-F.col("w") * b)).alias("nll"), F.count("*").alias("n")).first()

    a, z, b = 1 / high, 1 / low, min(max(1.0, 1 / high), 1 / low)
    best = at(b)
    for _ in range(rounds if best.n else 0):
        if best.g > 0:
            z = b
        else:
            a = b
        step = b - best.g / best.h if best.h > 0 else a + (z - a) / 2
        new = step if a < step < z else a if best.g > 0 and a == 1 / high and step <= a else z if best.g < 0 and z == 1 / low and step >= z else (a + z) / 2
        if abs(new - b) <= near * b:
            break
        b, best = new, at(new)
    return df.sparkSession.createDataFrame([(1 / b if best.n else None, best.nll)], "temperature double, nll double")


def write_report(found: DataFrame, path: str) -> None:
    """A report as <path>.json, <path>.csv and <path>.md: a row for each group."""
    import json

    from ..sources.files import write_text

    spark, names = found.sparkSession, found.columns
    rows = [[r[n] for n in names] for r in found.collect()]  # a report's rows
    text = lambda v: "" if v is None else str(v)
    write_text(spark, f"{path}.json", json.dumps([dict(zip(names, r)) for r in rows], indent=2, default=str))
    write_text(spark, f"{path}.csv", "\n".join([",".join(names), *(",".join(map(text, r)) for r in rows)]) + "\n")
    write_text(spark, f"{path}.md", "\n".join(f"| {' | '.join(map(text, r))} |" for r in [names, ["---"] * len(names), *rows]) + "\n")


def report(equity_rows: DataFrame, order: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, coverage_pct, final_equity, max_drawdown_pct) for each group, from rows of `equity`."""
    last = F.max_by("equity", F.struct(*order))
    return equity_rows.groupBy(*keys).agg((100 * F.avg((F.col("position") != 0).cast("double"))).alias("coverage_pct"), last.alias("final_equity"), (100 * F.max("drawdown")).alias("max_drawdown_pct"))


def fold_metrics(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, loss, accuracy) from rows (label, probs array): mean cross entropy and the share of rows whose likeliest class, the first of equals, is the label."""
    top = F.array_position("probs", F.array_max("probs")) - 1
    loss = -F.ln(F.greatest(F.element_at("probs", (F.col("label") + 1).cast("int")), F.lit(1e-12)))
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(loss).alias("loss"), F.avg((top == F.col("label")).cast("double")).alias("accuracy"))


def described(df: DataFrame, column: str) -> DataFrame:
    """(n, mean, sd, least, q25, q50, q75, most) of a column of few rows, such as the folds' metrics."""
    q = lambda x: F.percentile(column, F.lit(x))
    return df.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("sd"), F.min(column).alias("least"), q(0.25).alias("q25"), q(0.5).alias("q50"), q(0.75).alias("q75"), F.max(column).alias("most"))
