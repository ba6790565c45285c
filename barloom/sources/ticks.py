"""Sources and sinks: loosely-schemed tick files, klines, and the test tables read as ticks.

Canonical ticks are (symbol, us, seq, price, qty, is_buyer_maker): microseconds since 1970, and seq breaking ties of time. Files are read by
Spark's readers, so a split of a file is a partition, and column and time filters reach the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Accepted column names, in order of preference.
ALIASES = {
    "timestamp": ("timestamp", "ts", "time", "t"),
    "price": ("price", "p"),
    "qty": ("qty", "quantity", "size", "q", "base_qty", "amount_base", "volume"),
    "quote_qty": ("quote_qty", "qv", "amount", "amount_quote", "quote_volume", "quotevolume"),
    "is_buyer_maker": ("is_buyer_maker", "isbuyer_maker", "isbuyer", "buyer_maker", "isbm", "maker_is_buyer", "isbuyermaker"),
    "side": ("side", "taker_side", "trade_side"),
}
#: Names of time and price in a table that labels are looked up in.
PATH_ALIASES = {"timestamp": ("timestamp", "ts", "time"), "price": ("price", "last", "close", "mid")}
KLINE = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades", "taker_buy_volume",
    "taker_buy_quote_asset_volume", "ignore",
)


def resolve(columns: list[str], overrides: dict[str, str] | None = None) -> dict[str, str]:
    """Canonical name -> column, ignoring case and blanks; raises where a needed one is missing."""
    by_name: dict[str, str] = {}
    for c in columns:
        by_name.setdefault(c.strip().lower(), c)
    found = {}
    for name, options in ALIASES.items():
        wanted = (overrides or {}).get(name)
        if wanted is not None:
            if wanted.strip().lower() not in by_name:
                raise ValueError(f"no column {wanted!r} for {name}")
            found[name] = by_name[wanted.strip().lower()]
        elif hit := next((by_name[o] for o in options if o in by_name), None):
            found[name] = hit
    for name in ("timestamp", "price"):
        if name not in found:
            raise ValueError(f"no {name} column among {columns}")
    if "qty" not in found and "quote_qty" not in found:
        raise ValueError(f"neither qty nor quote_qty among {columns}")
    return found


def with_epochs(raw: DataFrame, column: str, rule: str = "median", keys: tuple[str, ...] = ("_file",), out: str = "_ms") -> DataFrame:
    """raw with `out`: milliseconds since 1970 of a column of texts or numbers, in the one unit that all rows of a file (equal keys) have.

    median: the median of a file's numbers says which, seconds below 1e12, milliseconds up to 1e15, microseconds below 1e18, else nanoseconds; where less than half of its
    rows are numbers all are read as ISO texts. max: their largest, above 1e14 nanoseconds, above 1e11 milliseconds, else seconds. Other texts are read as ISO
    texts; what can't be read is null, and it is an error if that is so of every row that has something.

    Where the median lies follows from counts and extremes of the four ranges, so a file is aggregated in parts and never sorted.
    """
    keys = tuple(k for k in keys if k in raw.columns)
    n = S.number(F.col(column).cast("string"))
    n = F.when(~F.isnan(n), n)
    limits = [n < 1e12, n <= 1e15, n < 1e18, F.lit(True)]
    place = F.when(n.isNull(), None)
    for k, c in enumerate(limits):
        place = place.when(c, k)
    rows = raw.withColumns({"__n": n, "__k": place})
    per = rows.groupBy(*keys).agg(
        F.count("*").alias("__all"), F.count("__n").alias("__some"), F.max("__n").alias("__top"),
        *[F.count_if(F.col("__k") == k).alias(f"__c{k}") for k in range(4)], *[f(F.when(F.col("__k") == k, F.col("__n"))).alias(f"__{a}{k}") for k in range(4) for a, f in (("lo", F.min), ("hi", F.max))],
    )
    upto = [sum((F.col(f"__c{j}") for j in range(k + 1)), F.lit(0)) for k in range(4)]
    holds = lambda i, pick: F.coalesce(*[F.when(i < upto[k], F.col(f"__{pick}{k}")) for k in range(4)])
    low, high = F.floor((F.col("__some") - 1) / 2), F.floor(F.col("__some") / 2)
    at = lambda i: F.coalesce(*[F.when(i < upto[k], F.lit(k)) for k in range(4)])
    # both middle values in one range: any of it will do; else they are the neighbours at its border
    middle = F.when(at(low) == at(high), holds(low, "lo")).otherwise((holds(low, "hi") + holds(high, "lo")) / 2)
    if rule == "median":
        by = F.when(middle < 1e12, 1000.0).when(middle <= 1e15, 1.0).when(middle < 1e18, 1e-3).otherwise(1e-6)
        numeric = F.col("__some") >= F.greatest(F.lit(1), F.floor(F.col("__all") * 0.5))
    elif rule == "max":
        by, numeric = F.when(F.col("__top") > 1e14, 1e-6).when(F.col("__top") > 1e11, 1.0).otherwise(1000.0), F.lit(True)
    else:
        raise ValueError(f"no rule {rule}")
    per = per.select(*keys, by.alias("__by"), numeric.alias("__numeric"))
    joined = rows.join(per, list(keys)) if keys else rows.join(F.broadcast(per))  # without keys one row
    iso = F.unix_millis(F.try_to_timestamp(F.col(column).cast("string")))
    value = F.when(F.col("__n").isNotNull(), F.when(F.col("__numeric"), F.round(F.col("__n") * F.col("__by")).cast("long"))).otherwise(iso)
    return joined.withColumn(out, value).drop("__n", "__k", "__by", "__numeric")


def dated(df: DataFrame, column: str | None = None) -> DataFrame:
    """df with `us`, its time in microseconds since 1970, by the largest of its column; raises where there is no such column or none of its rows can be read."""
    by_name = {c.strip().lower(): c for c in df.columns}
    column = column or next((by_name[n] for n in ("timestamp", "ts", "time", "datetime", "date", "open_time") if n in by_name), None)
    if column is None:
        raise ValueError(f"no time column among {df.columns}")
    kind = df.schema[column].dataType.typeName()
    if kind.startswith("timestamp") or kind == "date":
        out = df.withColumn("us", F.unix_micros(F.col(column).cast("timestamp")))
    else:
        out = with_epochs(df, column, "max", ()).withColumn("us", F.col("_ms") * 1000).drop("_ms")
    seen = out.agg(F.count("*").alias("n"), F.count("us").alias("k")).first()
    if seen.n and not seen.k:
        raise ValueError(f"no time in {column} can be read")
    return out


def without_month(rows: DataFrame, month: str, time: str = "us") -> DataFrame:
    """rows with `month` as of their time, without those that have no time and those of that month."""
    return rows.filter(F.col(time).isNotNull()).withColumn("month", S.month(F.col(time))).filter(F.col("month") != month)


def normalise(raw: DataFrame, overrides: dict[str, str] | None = None, rule: str = "ticks") -> DataFrame:
    """(timestamp ms, price, qty, is_buyer_maker) and raw's columns that start with an underscore; rows that aren't trades go.

    rule: how times are read, value by value, or with `median` in the unit of their file (column _file, or all rows).
    """
    at = resolve(raw.columns, overrides)
    if rule == "median":
        raw = with_epochs(raw, at["timestamp"], "median").withColumn(at["timestamp"], F.col("_ms")).drop("_ms")
        rule = "millis"
    price = S.number(F.col(at["price"]))
    qty = S.number(F.col(at["qty"])) if "qty" in at else F.try_divide(S.number(F.col(at["quote_qty"])), price)
    if "is_buyer_maker" in at:
        maker = S.is_true(F.col(at["is_buyer_maker"]))
    elif "side" in at:
        maker = S.maker_from_side(F.col(at["side"]))
    else:
        maker = F.lit(0).cast("byte")
    kept = [c for c in raw.columns if c.startswith("_")]
    out = raw.select(S.epoch_ms(F.col(at["timestamp"]), rule).alias("timestamp"), price.alias("price"), qty.alias("qty"), maker.alias("is_buyer_maker"), *kept)
    good = F.col("timestamp").isNotNull() & (F.col("price") > 0) & (F.col("qty") > 0) & ~F.isnan("price") & ~F.isnan("qty")
    return out.filter(good).select("timestamp", F.col("price").cast("float").alias("price"), F.col("qty").cast("float").alias("qty"), "is_buyer_maker", *kept)


def read_ticks(spark: SparkSession, path, overrides: dict[str, str] | None = None, header: bool = True, rule: str = "median") -> DataFrame:
    """Canonical ticks of CSV files with one schema, with `_file` and `_seq` telling ties of time apart; times in the unit that their file's median shows."""
    raw = spark.read.csv(path, header=header, inferSchema=False).withColumns({"_file": F.input_file_name(), "_seq": F.monotonically_increasing_id()})
    return normalise(raw, overrides, rule)


def read_any(spark: SparkSession, path: str, rows: int | None = None) -> DataFrame:
    """A CSV, Parquet, JSON, ORC or Feather table by its ending; `rows` takes only the first."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "feather":
        from .arrowfiles import read_feather

        df = read_feather(spark, path)
        return df if rows is None else df.limit(rows)
    if kind not in ("csv", "parquet", "json", "orc"):
        raise ValueError(f"no reader for {path}")
    df = spark.read.csv(path, header=True, inferSchema=True) if kind == "csv" else getattr(spark.read, kind)(path)
    return df if rows is None else df.limit(rows)


def between(ticks: DataFrame, first_ms: int, last_ms: int, column: str = "timestamp") -> DataFrame:
    """Ticks of a closed time range; the filter is pushed down to the scan."""
    return ticks.filter(F.col(column).between(first_ms, last_ms))


def read_klines(spark: SparkSession, path) -> DataFrame:
    """Twelve-column klines without a header (a header line is skipped), with `symbol` from the file name."""
    schema = ", ".join(f"{c} string" for c in KLINE)
    raw = spark.read.csv(path, schema=schema, header=False)
    out = raw.select(S.epoch_ms(F.col("open_time")).alias("open_time"), *[F.coalesce(S.number(F.col(c)), F.lit(0.0)).alias(c) for c in KLINE[1:]], S.symbol_in(F.input_file_name()).alias("symbol"))
    return out.filter("open_time is not null")


def schema_audit(spark: SparkSession, paths: list[str]) -> list[tuple[str, str]]:
    """(path, problem or ok) by the header of each file, of which only the first line is read; the audit goes on after a bad one."""
    import csv

    from . import files

    out = []
    for p in paths:
        try:
            if not files.exists(spark, p):
                raise ValueError("no such file")
            resolve(next(csv.reader([files.first_line(spark, p)]), []))
            out.append((p, "ok"))
        except ValueError as e:
            out.append((p, str(e)))
    return out


BAR_KEYS = ("symbol", "month")


def _bumped(bars: DataFrame) -> DataFrame:
    """bars (symbol, month, bar_id, timestamp ms) with timestamps that rise strictly along the bars of a month, by 1 ms at least."""
    from ..operators.bars import bump

    rows = bump(bars, list(BAR_KEYS), ["bar_id"], "timestamp", F.floor(F.col("bar_id") / 4096))
    return rows.withColumn("timestamp", F.col("bumped").cast("long")).drop("bumped")


def write_bars(bars: DataFrame, path: str, again: bool = False) -> None:
    """Bars (symbol, bar_id, us, open, high, low, close ...) as one table partitioned by symbol and month, with strictly rising `timestamp` in ms and prices as 32-bit floats.

    Months that the table has stay as they are, but for timestamps that do not rise strictly along their bars: those months are mended. With again all
    months of bars are replaced, and no others.
    """
    from . import files
    from .staging import staged

    spark = bars.sparkSession
    rows = bars.withColumns({"month": S.month(F.col("us")), "timestamp": F.floor(F.col("us") / 1000)})
    if not again:
        if files.exists(spark, path):
            mend_bars(spark, path)
        rows = files.resumed(rows, path, BAR_KEYS)
    rows = _bumped(rows).withColumns({c: F.col(c).cast("float") for c in ("open", "high", "low", "close")})
    staged(rows, "bars").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BAR_KEYS).parquet(path)


def mend_bars(spark: SparkSession, path: str) -> int:
    """Rewrite the months of a table of bars whose timestamps do not rise strictly; how many there were. The others' files are not touched."""
    from .staging import staged

    there = spark.read.parquet(path)
    fixed = _bumped(there.withColumn("_was", F.col("timestamp")))
    wrong = staged(fixed.filter("timestamp <> _was").select(*BAR_KEYS).distinct(), "months")
    n = wrong.count()
    if n:
        mended = staged(fixed.drop("_was").join(wrong, list(BAR_KEYS), "left_semi").select(*there.columns), "bars")
        mended.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*BAR_KEYS).parquet(path)
    return n


def event_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table events read as ticks: its type is the symbol, its value the price, each of quantity one."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.filter(F.col("value") > 0).select(
        F.col("event_type").alias("symbol"), us.alias("us"), F.col("event_id").alias("seq"), F.col("value").alias("price"), F.lit(1.0).alias("qty"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )


def label_path(raw: DataFrame, mode: str = "auto", rule: str = "ticks") -> DataFrame:
    """(us, high, low), and raw's columns that start with an underscore, to look labels up in: prices, or with mode="hilo" bars' extremes; "auto" takes prices where there are any.

    Raises where the table has no time column or not what the mode asks for. Prices are compared as 32-bit floats, as they are stored.
    """
    by_name = {c.strip().lower(): c for c in raw.columns}
    kept = [c for c in raw.columns if c.startswith("_")]
    at = {k: next((by_name[n] for n in names if n in by_name), None) for k, names in PATH_ALIASES.items()}
    if at["timestamp"] is None:
        raise ValueError(f"no time column among {raw.columns}")
    extremes = "high" in by_name and "low" in by_name
    if mode not in ("auto", "ticks", "hilo") or (mode == "hilo" and not extremes) or (mode == "ticks" and at["price"] is None) or (at["price"] is None and not extremes):
        raise ValueError(f"mode {mode} with columns {raw.columns}")
    us = S.epoch_ms(F.col(at["timestamp"]), rule) * 1000
    if mode == "hilo" or at["price"] is None:
        high, low = S.number(F.col(by_name["high"])), S.number(F.col(by_name["low"]))
    else:
        high = low = S.number(F.col(at["price"])).cast("float").cast("double")
    return raw.select(us.alias("us"), high.alias("high"), low.alias("low"), *kept).filter("us is not null")


def label_tables(spark: SparkSession, path: str) -> DataFrame:
    """Label files of one or several schemas as one table, with `month` from the file name where they have none."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    return df if "month" in df.columns else df.withColumn("month", S.month_in(F.input_file_name()))
