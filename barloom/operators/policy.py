"""Take-profit and stop-loss levels from quantiles of excursions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .halo import windowed
from .scan import running_sum
from .selection import quantiles


def excursions(bars: DataFrame, horizon_bars: int) -> DataFrame:
    """bars with `mfe`, `mae`: best high above and worst low below the close over the next bars, in average true ranges.

    Bars without a following one or with no ATR have nulls.
    """
    unit = F.nullif(F.col("atr"), F.lit(0.0))
    best = lambda w: (F.max("high").over(w.rowsBetween(1, horizon_bars)) - F.col("close")) / unit
    worst = lambda w: (F.col("close") - F.min("low").over(w.rowsBetween(1, horizon_bars))) / unit
    return windowed(bars, ["symbol"], "pos", lambda w: {"mfe": best(w), "mae": worst(w)}, ahead=horizon_bars)


def timed_excursions(bars: DataFrame, horizon_us: int, floored: bool = False) -> DataFrame:
    """The same over the bars within horizon_us after this one, and over the next bar at least; floored holds both at 0 or more."""
    span = lambda w: w.rangeBetween(1, horizon_us)
    rows = windowed(bars, ["symbol"], "us", lambda w: {"_hi": F.max("high").over(span(w)), "_lo": F.min("low").over(span(w))}, ahead=horizon_us)
    rows = windowed(rows, ["symbol"], "pos", lambda w: {"_nh": F.lead("high").over(w), "_nl": F.lead("low").over(w)}, ahead=1)
    unit = F.nullif(F.col("atr"), F.lit(0.0))
    best = (F.greatest("_hi", "_nh") - F.col("close")) / unit
    worst = (F.col("close") - F.least("_lo", "_nl")) / unit
    if floored:
        best, worst = (F.when(c.isNotNull(), F.greatest(c, F.lit(0.0))) for c in (best, worst))
    return rows.withColumns({"mfe": best, "mae": worst}).drop("_hi", "_lo", "_nh", "_nl")


def winsorised(df: DataFrame, column: str, part: float) -> DataFrame:
    """df with column held between its quantiles part and 1 - part."""
    q = quantiles(df, [], column, {"_lo": part, "_hi": 1 - part})
    held = F.greatest(F.least(F.col(column), F.col("_hi")), F.col("_lo"))
    return df.join(F.broadcast(q)).withColumn(column, F.when(F.col(column).isNotNull(), held)).drop("_lo", "_hi")  # one row


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float, out: str) -> DataFrame:
    """(keys, out): value where the running weight, in order of value, reaches q of the total, interpolated between rows.

    Equal values are summed first, so what is sorted are distinct values. A group without positive weight has the plain quantile.
    """
    rows = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    totals = rows.groupBy(*keys).agg(F.sum("_w").alias("_all"))
    rows = running_sum(rows, keys, [value], F.col("_w"), F.floor(F.col(value) * 16), "_c").join(totals, keys)
    want, at = F.col("_all") * q, F.struct(F.col(value).alias("v"), F.col("_c").alias("c"))
    plain = F.percentile(F.when(~(F.col("_all") > 0), F.col(value)), F.lit(q), F.col("_n"))  # holds values only where it is needed
    got = rows.groupBy(*keys).agg(F.max("_all").alias("_all"), F.min(F.when(F.col("_c") >= want, at)).alias("_b"), F.max(F.when(F.col("_c") < want, at)).alias("_a"), F.max(value).alias("_m"), plain.alias("_p"))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("_all") * q - F.col("_a.c")) / (F.col("_b.c") - F.col("_a.c"))
    found = F.when(F.col("_b").isNull(), F.col("_m")).when(F.col("_a").isNull(), F.col("_b.v")).otherwise(between)
    return got.select(*keys, F.when(F.col("_all") > 0, found).otherwise(F.col("_p")).alias(out))


def levels(df: DataFrame, group: str, q_tp: float, q_sl: float, least: int, bounds: tuple[float, float]) -> DataFrame:
    """(group, n, tp_mult, sl_mult): weighted quantiles of mfe and mae by group; small groups get the global ones; held to bounds."""
    counts = df.groupBy(group).agg(F.count("*").alias("n"))
    every = df.withColumn("_g", F.lit(1))
    for side, value, q in (("tp", "mfe", q_tp), ("sl", "mae", q_sl)):
        own = weighted_quantile(df, [group], value, "weight", q, f"_{side}")
        common = weighted_quantile(every, ["_g"], value, "weight", q, f"_g{side}").drop("_g")
        counts = counts.join(own, group, "left").join(F.broadcast(common), how="left")  # one row
    held = lambda s: F.greatest(F.least(F.when(F.col("n") >= least, F.col(f"_{s}")).otherwise(F.col(f"_g{s}")), F.lit(bounds[1])), F.lit(bounds[0]))
    return counts.select(group, "n", held("tp").alias("tp_mult"), held("sl").alias("sl_mult"))


def level_for(rows: DataFrame, policy: DataFrame | None, regimes: DataFrame | None, default_tp: float, default_sl: float) -> DataFrame:
    """rows (month) with `tp_mult` and `sl_mult`: the policy's for the month or, with regimes (month, regime), for the month's regime; else the defaults.

    policy (key, tp_mult, sl_mult) may lack either multiple. Both tables are a row for each month or regime. A key `global` is never looked up.
    """
    out = rows.withColumn("_key", F.col("month"))
    if regimes is not None:
        out = out.drop("_key").join(regimes.select("month", F.col("regime").alias("_key")), "month", "left")
    if policy is None:
        return out.drop("_key").withColumns({"tp_mult": F.lit(float(default_tp)), "sl_mult": F.lit(float(default_sl))})
    table = policy.select(F.col("key").alias("_key"), F.col("tp_mult").alias("_t"), F.col("sl_mult").alias("_s"))
    out = out.join(table, "_key", "left")
    return out.withColumns({"tp_mult": F.coalesce("_t", F.lit(float(default_tp))), "sl_mult": F.coalesce("_s", F.lit(float(default_sl)))}).drop("_key", "_t", "_s")


def with_regime(rows: DataFrame, regimes: DataFrame) -> DataFrame:
    """rows (month) with their month's `regime`, or `unknown`."""
    return rows.join(regimes, "month", "left").withColumn("regime", F.coalesce("regime", F.lit("unknown")))


def drawn(seed: int, key: Column) -> Column:
    """A number in 0 .. 1 that follows from seed and key, with 52 random bits: the same in every engine that has md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key.cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = 7) -> DataFrame:
    """n rows without replacement, by a hash of the key: the same on every run."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(n)


def weighted_sample(df: DataFrame, n: int, key: str, weight: str, seed: int = 7) -> DataFrame:
    """n rows without replacement with chances by weight, by exponential keys."""
    u = F.greatest(drawn(seed, F.col(key)), F.lit(2.0**-53))
    return df.filter(F.col(weight) > 0).orderBy(-F.ln(u) / F.col(weight), key).limit(n)


def weighted_draws(df: DataFrame, n: int, order: list[str], weight: str, bucket: Column, seed: int = 7) -> DataFrame:
    """n draws with replacement, as (draw, columns of df), with chances by whole-number weights.

    Draws are even in 0 .. total; the row whose stretch of the running weight holds one is found by an equi-join on shares of the total as
    wide as a mean draw, so rows and draws meet once. bucket must rise with the order.
    """
    rows = running_sum(df.filter(F.col(weight) > 0).withColumn("_one", F.lit(1)), ["_one"], order, F.col(weight), bucket, "_z").drop("_one")
    rows = rows.withColumn("_a", F.col("_z") - F.col(weight)).join(F.broadcast(df.agg(F.sum(F.when(F.col(weight) > 0, F.col(weight))).alias("_all"))))
    width = F.greatest(F.floor(F.col("_all") / n), F.lit(1))
    rows = rows.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / width), F.floor((F.col("_z") - 1) / width)))).drop("_all")
    total = df.agg(F.sum(F.when(F.col(weight) > 0, F.col(weight))).alias("_all"))
    draws = df.sparkSession.range(n).withColumnRenamed("id", "draw").join(F.broadcast(total))
    at = F.floor(drawn(seed, F.col("draw")) * F.col("_all"))
    draws = draws.select("draw", at.alias("_u"), F.floor(at / width).alias("_k"))
    met = draws.join(rows, "_k").filter((F.col("_u") >= F.col("_a")) & (F.col("_u") < F.col("_z")))
    return met.drop("_k", "_u", "_a", "_z")
