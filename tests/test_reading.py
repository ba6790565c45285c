"""Units of time by file, dated tables, bars written and mended, run tags and bins."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import imaging
from barloom.sources import ticks as T


def test_units_by_the_median_of_a_file(spark):
    us = 1_700_000_000_000_000
    files = {
        "micro": ([str(us + k) for k in range(9)] + ["5000000000000", "17", "2023-11-14T22:13:20Z", "x"], [us // 1000] * 9 + [5_000_000_000, 0, us // 1000, None]),
        "seconds": (["1700000000", "1700000001.5"], [us // 1000, us // 1000 + 1500]),
        "iso": (["2023-11-14T22:13:20Z", "2023-11-14T22:13:21Z", "2023-11-14T22:13:22Z", "1700000000"], [us // 1000, us // 1000 + 1000, us // 1000 + 2000, None]),
        "two sides": (["1000000000", "3000000000000"], [10**9, 3 * 10**12]),  # the mean of the middle two is in milliseconds
        "nano": ([str(us * 1000)], [us // 1000]),
        "nothing": ([None, "x"], [None, None]),
    }
    raw = spark.createDataFrame([(n, t, k) for n, (texts, _) in files.items() for k, t in enumerate(texts)], "_file string, t string, _k int")
    got = {(r["_file"], r["_k"]): r["_ms"] for r in T.with_epochs(raw, "t").collect()}
    assert got == {(n, k): v for n, (_, want) in files.items() for k, v in enumerate(want)}


def test_files_read_in_their_unit(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,price,qty\n" + "".join(f"{1_700_000_000_000_000 + k},1,1\n" for k in range(5)) + "900000000000000,2,1\n")
    (tmp_path / "b.csv").write_text("time,price,qty\n1700000000,3,1\n")
    got = sorted(r.timestamp for r in T.read_ticks(spark, str(tmp_path)).collect())
    assert got == [900_000_000_000, *[1_700_000_000_000] * 6]


def test_dated(spark):
    df = spark.createDataFrame([("1700000000000", 1), ("1600000000000", 2), (None, 3)], "Time string, v int")
    assert [r.us for r in T.dated(df).orderBy("v").collect()] == [1_700_000_000_000_000, 1_600_000_000_000_000, None]
    with pytest.raises(ValueError):
        T.dated(spark.createDataFrame([("x", 1)], "ts string, v int"))
    with pytest.raises(ValueError):
        T.dated(df.select("v"))
    assert T.dated(df.filter("false")).count() == 0
    rows = T.dated(df).unionByName(T.dated(df.limit(0)))
    assert [r.month for r in T.without_month(rows, "2020-09").collect()] == ["2023-11"]


def bars(spark, rows):
    return spark.createDataFrame([(s, i, us, 1.0, 2.0, 0.5, 1.5) for s, i, us in rows], "symbol string, bar_id long, us long, open double, high double, low double, close double")


def test_bars_rise_and_existing_months_are_mended(spark, tmp_path):
    path, jan, feb = str(tmp_path / "bars"), 1_704_067_200_000_000, 1_706_745_600_000_000
    T.write_bars(bars(spark, [("A", k, jan + t * 1000) for k, t in enumerate([5, 5, 5, 6, 10, 10, 11])]), path)
    read = lambda s="A": [r.timestamp - jan // 1000 for r in spark.read.parquet(path).filter(F.col("symbol") == s).orderBy("bar_id").collect()]
    assert read() == [5, 6, 7, 8, 10, 11, 12] and dict(spark.read.parquet(path).dtypes)["close"] == "float"
    before = set(spark.read.parquet(path).inputFiles())
    T.write_bars(bars(spark, [("A", 0, jan), ("A", 9, feb), ("B", 0, jan), ("B", 1, jan + 999)]), path)
    assert read()[:7] == [5, 6, 7, 8, 10, 11, 12] and before < set(spark.read.parquet(path).inputFiles()) and read("B") == [0, 1]
    rows = spark.read.parquet(path).filter("symbol = 'B'")
    other = set(spark.read.parquet(path).filter("symbol = 'A'").inputFiles())
    broken = spark.createDataFrame(rows.withColumn("timestamp", F.lit(jan // 1000)).collect(), rows.schema)
    broken.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(path)
    assert T.mend_bars(spark, path) == 1 and read("B") == [0, 1] and T.mend_bars(spark, path) == 0
    T.write_bars(bars(spark, [("B", 0, jan + 7000)]), path, again=True)
    assert read("B") == [7] and len(read()) == 8 and other


def test_run_tags(spark):
    cases = {"binance_BTCUSDT_2025-01_bars": "BTCUSDT_2025-01", "plain": "plain", "2025-01": "2025-01", "eth-usd- 2024-12": "USD_2024-12", "btc-ticks-2024-01": "TICKS_2024-01", "a_2024-01_b_2025-02": "A_2024-01"}
    rows = spark.createDataFrame([(k,) for k in cases], "stem string")
    assert {r.stem: r.tag for r in rows.withColumn("tag", S.run_tag(F.col("stem"))).collect()} == cases


def test_bins():
    assert imaging.bins(np.array([0, 0, 0, *range(1, 15)]), 8)[0].tolist() == np.digitize(np.float32([0, 0, 0, *range(1, 15)]), np.linspace(0, 14, 9)[1:-1]).tolist()
    assert imaging.bins(np.array([0, 0, 0, *range(1, 15)]), 8)[0].tolist()[:5] == [0, 0, 0, 0, 1]
    assert imaging.bins(np.full(5, 3.0), 8)[0].tolist() == [0] * 5 and imaging.bins(np.array([1.0, 1.0, 2.0]), 8)[1] == 2
    z, k = imaging.bins(np.arange(16.0), 4)
    assert k == 4 and z.tolist() == [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4
    assert (imaging.mtf(np.full(6, 2.0), 8, 6) == 1).all()
    m = imaging.mtf(np.array([0.0, 1, 0, 1, 0, 1]), 2, 6)
    assert m[0].tolist() == [0, 1, 0, 1, 0, 1] and m[1].tolist() == [1, 0, 1, 0, 1, 0]
