"""Labelling a snapshot on tick files as one job that may be ended and begun again.

A chunk is a symbol and month of the snapshot. Which file serves it is decided once, from one listing of the folder: ticks before klines, Parquet before
CSV. Only files of chunks that are still to do are read, of these only the columns looked at, and only the time from the first entry to the last horizon. Chunks
are labelled in rounds: a round overwrites its own partitions of the table (and no others) and then notes them as done, so a run that was killed
leaves either a noted chunk or one that is made anew. The table at the end does not depend on where a run was ended.
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from ..sources.staging import staged
from ..sources.ticks import label_path
from . import touch

#: <symbol>-<kind>-<month>.<ending>; the columns looked at; and which of several files serves a month, the earlier ones.
NAME = re.compile(r"^(?P<symbol>.+)-(?P<kind>ticks|1m)-(?P<month>20\d{2}-\d{2})\.(?P<end>parquet|csv)$")
PART = re.compile(r"/(?P<symbol>[^/]+)-(?:ticks|1m)-(?P<month>20\d{2}-\d{2})\.(?:parquet|csv)(?=/|$)")
PATH = "symbol string, chunk string, us long, high double, low double"
ORDER = [("ticks", "parquet"), ("ticks", "csv"), ("1m", "parquet"), ("1m", "csv")]


def tick_files(spark: SparkSession, root: str, ticks_only: bool = False) -> dict[tuple[str, str], str]:
    """(symbol, month) -> the file that serves it, from one listing of root: a name for each month of each symbol."""
    best: dict[tuple[str, str], tuple[int, str]] = {}
    for path in files.children(spark, root):
        m = NAME.match(path.rstrip("/").rsplit("/", 1)[-1])
        if m and not (ticks_only and m["kind"] != "ticks"):
            rank = ORDER.index((m["kind"], m["end"]))
            best[m["symbol"], m["month"]] = min(best.get((m["symbol"], m["month"]), (len(ORDER), "")), (rank, path))
    return {k: v[1] for k, v in best.items()}


def _read(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """The files as few tables: all Parquet files of one schema, and all CSV files of one header, are one."""
    groups: dict[tuple, list[str]] = {}
    for p in sorted(paths):
        kind = p.rsplit(".", 1)[-1]
        names = spark.read.parquet(p).columns if kind == "parquet" else files.first_line(spark, p).split(",")  # a footer or a line of each
        groups.setdefault((kind, *names), []).append(p)
    return [spark.read.parquet(*g) if k[0] == "parquet" else spark.read.csv(g, header=True, inferSchema=False) for k, g in groups.items()]


def path_of(spark: SparkSession, chosen: dict[tuple[str, str], str], mode: str) -> DataFrame | None:
    """(symbol, chunk, us, high, low) of the chosen files; None where no file can be looked at.

    mode: `ticks` and `hilo` raise where a file lacks what they ask for; with `auto` such a file is as one that isn't there.
    """
    out = None
    for raw in _read(spark, list(chosen.values())):
        try:
            path = label_path(raw.withColumns({"_file": F.col("_metadata.file_path")}), mode)
        except ValueError:
            if mode != "auto":
                raise
            continue
        # which chunk a file is of is found once for the file, not again in each of its rows: a row for each part of the files of a round, in both spellings of a path without a host
        names = {spelt: list(PART.finditer(f))[-1] for f in raw.inputFiles() for spelt in (f, f.replace(":///", ":/", 1))}
        parts = [(f, unquote(m["symbol"]), m["month"]) for f, m in names.items()]
        of = spark.createDataFrame(parts, "_file string, symbol string, chunk string").coalesce(1)
        part = path.join(F.broadcast(of), "_file").select("symbol", "chunk", "us", "high", "low")
        out = part if out is None else out.unionByName(part)
    return out


def label_job(
    snapshot: DataFrame, bars: DataFrame, ticks_root: str, out: str, horizon_us: int, tp_mult: float, sl_mult: float, mode: str = "auto",
    policy: DataFrame | None = None, regimes: DataFrame | None = None, resume: bool = True, per_round: int = 64,
) -> DataFrame:
    """The labelled table at `out`, partitioned by symbol and chunk: the snapshot's rows (symbol, month, start, window, ...) with `label`, `us`, `up`, `dn`,
    `event_end_us`, `touched_us`, the levels, and month as of the entry; rows of months that the snapshot does not have are left out of what is returned.

    bars: (symbol, pos, us, close, atr). Labels are 1 (profit first), 0 (loss first) and 2: neither within the horizon, no tick file, an entry at the last
    bar or later, or no range to measure by. A row meets the ticks of its own month's file only. With resume, chunks that are noted as done stay as they are;
    without it all are made anew. mode: `ticks` asks for tick files (a chunk without one is an error), `hilo` for high and low, `auto` takes prices where a file has
    them. An empty snapshot gives an empty table.
    """
    spark = snapshot.sparkSession
    if mode not in ("auto", "ticks", "hilo"):
        raise ValueError(f"no mode {mode}")
    rows = snapshot.withColumn("chunk", F.coalesce(F.col("month"), F.lit("unknown")))
    done_path = f"{out.rstrip('/')}.done"
    keys = rows.select("symbol", "chunk").distinct()
    if resume and files.exists(spark, done_path):
        keys = keys.join(spark.read.schema("symbol string, chunk string").parquet(done_path).distinct(), ["symbol", "chunk"], "left_anti")
    elif not resume:
        files.remove(spark, done_path)
    todo = [(r.symbol, r.chunk) for r in keys.orderBy("symbol", "chunk").collect()]  # a row for each month of each symbol
    found = tick_files(spark, ticks_root, mode == "ticks")
    lost = [k for k in todo if k not in found]
    if mode == "ticks" and lost:
        raise ValueError(f"no tick file for {lost[0][0]} {lost[0][1]}")
    for a in range(0, len(todo), per_round):
        _round(spark, rows, bars, {k: found.get(k) for k in todo[a : a + per_round]}, out, done_path, horizon_us, tp_mult, sl_mult, mode, policy, regimes)
    if not files.exists(spark, out):  # nothing was to do
        none = spark.createDataFrame([], PATH)
        return touch.label_snapshot(rows.filter("false"), bars, none, horizon_us, tp_mult, sl_mult, policy, regimes, chunk="chunk").drop("chunk")
    merged = spark.read.parquet(out)
    return merged.join(snapshot.select("month").distinct(), "month", "left_semi").drop("chunk")


def _round(spark, rows, bars, chosen, out, done_path, horizon_us, tp_mult, sl_mult, mode, policy, regimes) -> None:
    keys = spark.createDataFrame(list(chosen), "symbol string, chunk string")  # per_round rows
    mine = staged(rows.join(keys, ["symbol", "chunk"], "left_semi"), "chunks")
    served = {k: p for k, p in chosen.items() if p}
    path = path_of(spark, served, mode) if served else None
    if path is None:
        path = spark.createDataFrame([], PATH)
    at = mine.select("symbol", (F.col("start") + F.col("window") - 1).cast("long").alias("pos"))
    reach = bars.join(at, ["symbol", "pos"], "left_semi").agg(F.min("us").alias("a"), F.max("us").alias("z")).first()
    if reach.a is not None:  # reaches the scan
        path = path.filter(F.col("us").between(reach.a, reach.z + horizon_us))
    got = touch.label_snapshot(mine, bars, path, horizon_us, tp_mult, sl_mult, policy, regimes, chunk="chunk")
    got.repartition("symbol", "chunk").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "chunk").parquet(out)
    keys.coalesce(1).write.mode("append").parquet(done_path)
