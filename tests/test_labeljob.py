"""The label job against a loop over rows; modes, missing files, and a run that is killed and begun again."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import labeljob
from barloom.sources import files

H = 3_600_000_000
MONTHS = {"2024-01": 1_704_067_200_000_000, "2024-02": 1_706_745_600_000_000, "2024-03": 1_709_251_200_000_000}


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    root, rng = str(tmp_path_factory.mktemp("ticks")), random.Random(4)
    bars, ticks, rows = [], {}, []
    for s in ("AAA", "B-B"):
        pos = 0
        for month, start in MONTHS.items():
            ticks[s, month] = [(start + k * 60_000_000 + rng.randrange(1000) * 1000, 100 + rng.gauss(0, 3)) for k in range(400)]
            for k in range(0, 400, 10):
                bars.append((s, pos, start + k * 60_000_000 + 5_000_000, 100 + rng.gauss(0, 1), rng.choice([2.0, 3.0, 0.0, float("nan")]) if pos % 9 == 0 else 2.0))
                rows.append((s, month, pos, 4, start))
                pos += 1
    frame = lambda t: spark.createDataFrame(t, "us long, price double")
    ms = (F.col("us") / 1000).cast("long")
    hilo = lambda t: frame(t).groupBy(F.floor(F.col("us") / (5 * 60_000_000)).alias("b")).agg(F.max("us").alias("us"), F.max("price").alias("high"), F.min("price").alias("low"))
    frame(ticks["AAA", "2024-01"]).select(ms.alias("Timestamp"), "price").coalesce(1).write.parquet(f"{root}/AAA-ticks-2024-01.parquet")
    frame(ticks["AAA", "2024-01"][:3]).select(ms.alias("ts"), F.lit(1.0).alias("price")).coalesce(1).write.csv(f"{root}/AAA-ticks-2024-01.csv", header=True)  # the Parquet file serves
    frame(ticks["AAA", "2024-02"]).select(ms.alias("ts"), F.col("price").alias("last")).coalesce(1).write.csv(f"{root}/AAA-ticks-2024-02.csv", header=True)
    hilo(ticks["B-B", "2024-01"]).select(ms.alias("time"), "high", "low").coalesce(1).write.csv(f"{root}/B-B-1m-2024-01.csv", header=True)
    frame(ticks["B-B", "2024-02"]).select(F.col("price").alias("what")).coalesce(1).write.parquet(f"{root}/B-B-ticks-2024-02.parquet")  # no time
    snap = spark.createDataFrame(rows, "symbol string, month string, start long, window int, t0 long")
    b = spark.createDataFrame(bars, "symbol string, pos long, us long, close double, atr double")
    seen = {("AAA", "2024-01"): [(u // 1000 * 1000, p, p) for u, p in ticks["AAA", "2024-01"]], ("AAA", "2024-02"): [(u // 1000 * 1000, p, p) for u, p in ticks["AAA", "2024-02"]]}
    seen["B-B", "2024-01"] = [(r.us // 1000 * 1000, r.high, r.low) for r in hilo(ticks["B-B", "2024-01"]).collect()]
    return root, snap, b, rows, bars, seen


def loop(rows, bars, seen, horizon, tp, sl):
    import datetime

    import numpy as np

    at = {(s, p): (us, c, a) for s, p, us, c, a in bars}
    last = {s: max(p for x, p, *_ in bars if x == s) for s in ("AAA", "B-B")}
    out, months = [], {r[1] for r in rows}
    for s, month, start, window, _ in rows:
        pos, label, us = start + window - 1, 2, None
        if pos < last[s]:
            us, c, a = at[s, pos]
            if a == a and a > 0:
                for t, hi, lo in sorted(seen.get((s, month), [])):
                    hi, lo = (hi, lo) if (s, month) == ("B-B", "2024-01") else (float(np.float32(hi)), float(np.float32(lo)))
                    if us < t <= us + horizon and (hi >= c + tp * a or lo <= c - sl * a):
                        label = 1 if hi >= c + tp * a else 0
                        break
        own = datetime.datetime.fromtimestamp(us / 1e6, datetime.timezone.utc).strftime("%Y-%m") if us else month
        if own in months:
            out.append((s, start, own, label, us + horizon if us else None))
    return sorted(out, key=str)


def keys(df):
    return sorted(((r.symbol, r.start, r.month, r.label, r.event_end_us) for r in df.collect()), key=str)


def test_equals_a_loop(spark, made, tmp_path):
    root, snap, b, rows, bars, seen = made
    got = labeljob.label_job(snap, b, root, str(tmp_path / "out"), 2 * H, 1.5, 1.2)
    want = loop(rows, bars, seen, 2 * H, 1.5, 1.2)
    assert keys(got) == want and {w[3] for w in want} == {0, 1, 2}
    assert set(snap.columns) <= set(got.columns)


def test_a_killed_run_ends_with_the_same_table(spark, made, tmp_path, monkeypatch):
    root, snap, b, rows, bars, seen = made
    out, real, calls = str(tmp_path / "out"), labeljob._round, []

    def dies(*args):
        calls.append(args)
        if len(calls) == 2:  # the partition is written, but not noted
            args[2].sparkSession.createDataFrame([("AAA", "2024-02", -1)], "symbol string, chunk string, start long").write.mode("append").partitionBy("symbol", "chunk").parquet(out)
            raise RuntimeError("killed")
        return real(*args)

    monkeypatch.setattr(labeljob, "_round", dies)
    with pytest.raises(RuntimeError):
        labeljob.label_job(snap, b, root, out, 2 * H, 1.5, 1.2, per_round=1)
    first = sorted(f for f in spark.read.parquet(f"{out}/symbol=AAA/chunk=2024-01").inputFiles())
    monkeypatch.setattr(labeljob, "_round", real)
    again = labeljob.label_job(snap, b, root, out, 2 * H, 1.5, 1.2, per_round=2)
    assert keys(again) == loop(rows, bars, seen, 2 * H, 1.5, 1.2)
    assert sorted(spark.read.parquet(f"{out}/symbol=AAA/chunk=2024-01").inputFiles()) == first
    labeljob.label_job(snap, b, root, out, 2 * H, 1.5, 1.2, resume=False)
    assert sorted(spark.read.parquet(f"{out}/symbol=AAA/chunk=2024-01").inputFiles()) != first


def test_modes(spark, made, tmp_path):
    root, snap, b, rows, bars, seen = made
    with pytest.raises(ValueError):
        labeljob.label_job(snap, b, root, str(tmp_path / "a"), H, 1.0, 1.0, mode="ticks")  # a month without ticks
    one = snap.filter("symbol = 'B-B' and month = '2024-01'")
    got = labeljob.label_job(one, b, root, str(tmp_path / "b"), 2 * H, 1.5, 1.2, mode="hilo")
    assert keys(got) == [w for w in loop(rows, bars, seen, 2 * H, 1.5, 1.2) if w[0] == "B-B" and w[2] == "2024-01"]
    with pytest.raises(ValueError):
        labeljob.label_job(snap.filter("symbol = 'AAA' and month = '2024-01'"), b, root, str(tmp_path / "c"), H, 1.0, 1.0, mode="hilo")
    nothing = labeljob.label_job(snap.filter("false"), b, root, str(tmp_path / "d"), H, 1.0, 1.0)
    assert nothing.count() == 0 and sorted(nothing.columns) == sorted(got.columns)
    assert labeljob.tick_files(spark, f"{root}/nowhere") == {} and files.first_line(spark, f"{root}/AAA-ticks-2024-02.csv") == "ts,last"


def test_a_file_tells_its_chunk_once(spark, tmp_path):
    """No row's path is searched for the names in it, and a plus stays one; parts of a file, blanks and other letters are known."""
    root = str(tmp_path / "a-ticks-2023-01.parquet")  # the folder itself is named like a file
    want = set()
    for s, month in (("A+B", "2024-01"), ("Ä C", "2024-02"), ("D%20", "2024-03")):
        spark.range(5).select((F.col("id") + 1_704_067_200_000).alias("ts"), F.lit(2.0).alias("price")).repartition(2).write.parquet(f"{root}/{s}-ticks-{month}.parquet")
        want |= {(s, month, (1_704_067_200_000 + i) * 1000) for i in range(5)}
    path = labeljob.path_of(spark, labeljob.tick_files(spark, root), "ticks")
    assert "regexp" not in path._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.symbol, r.chunk, r.us) for r in path.collect()} == want and path.count() == 15
