"""Operators against plain loops and by their invariants, on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import scalars as S
from barloom.operators import asof, bars, imaging, indicators, policy, scan, synthetic, touch
from barloom.plans import queries as plans
from barloom.sources import ticks as T

SF = "/root/testdata/sf0.001"


def test_epochs_and_flags(spark):
    df = spark.createDataFrame([("1700000000",), ("1700000000000",), ("1700000000000000",), ("1700000000000000000",), ("2023-11-14 22:13:20",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(S.epoch_ms(F.col("t"))).collect()] == [1700000000000] * 5 + [None] * 2
    flags = spark.createDataFrame([("true",), ("0",), ("2",), ("no",), (None,)], "f string")
    assert [r[0] for r in flags.select(S.is_true(F.col("f"))).collect()] == [1, 0, 1, 0, 0]
    soft = spark.createDataFrame([([1.0, 2.0, 3.0],)], "z array<double>").select(S.softmax(F.col("z"))).first()[0]
    assert np.allclose(soft, np.exp([1, 2, 3]) / np.exp([1, 2, 3]).sum())


@pytest.mark.parametrize(
    "header, rows, ticks, dollar",
    [
        ("timestamp,price,qty,is_buyer_maker", ["1700000000,100,12.5,1", "1700000001,101,10,0", "1700000002,102,9.5,1"], [1, 0, 1], 2),
        ("ts,p,quantity,isbuyer", ["1700001000,150,8,true", "1700001001,149.5,7.5,false", "1700001002,150.5,8.5,true"], [1, 0, 1], 3),
        ("time,price,quote_qty,side", ["1700002000,200,2200,sell", "1700002001,201,900,buy", "1700002002,202,950,SELL"], [1, 0, 1], 2),
    ],
)
def test_tick_files(spark, tmp_path, header, rows, ticks, dollar):
    (tmp_path / "t.csv").write_text("\n".join([header, *rows, "bad,-1,0,"]) + "\n")
    got = T.read_ticks(spark, str(tmp_path / "t.csv"))
    assert [r.is_buyer_maker for r in got.orderBy("timestamp").collect()] == ticks
    t = got.select(F.lit("s").alias("symbol"), (F.col("timestamp") * 1000).alias("us"), F.col("_seq").alias("seq"), "price", "qty", F.round(F.col("price").cast("double") * F.col("qty") * 100).cast("long").alias("cents"))
    assert bars.dollar_bars(t, 100_000).count() == dollar


def test_missing_columns():
    for columns in (["ts", "qty"], ["price", "qty"], ["ts", "price"]):
        with pytest.raises(ValueError):
            T.resolve(columns)
    with pytest.raises(ValueError):
        T.resolve(["ts", "price", "qty"], {"price": "none"})


def test_bump(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate([5, 5, 5, 6, 10, 10, 3])], "symbol string, i int, t long")
    assert [r.bumped for r in bars.bump(df, ["symbol"], ["i"], "t").orderBy("i").collect()] == [5, 6, 7, 8, 10, 11, 12]


def test_running_sum_and_ewma(spark):
    rng = random.Random(3)
    xs = [rng.random() for _ in range(1500)]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(xs)], "symbol string, pos long, x double")
    got = [r.c for r in scan.running_sum(df, ["symbol"], ["pos"], F.col("x"), F.floor(F.col("pos") / 100), "c").orderBy("pos").collect()]
    assert np.allclose(got, np.cumsum(xs))
    for alpha in (1 / 14, 2 / 33, 0.7):
        y, want = xs[0], []
        for i, x in enumerate(xs):
            y = x if i == 0 else y * (1 - alpha) + x * alpha
            want.append(y)
        got = [r.y for r in scan.ewma(df, ["symbol"], "pos", F.col("x"), alpha, "y").orderBy("pos").collect()]
        assert np.allclose(got, want, rtol=1e-12)


def test_ewma_vol_follows_pandas(spark):
    import pandas as pd

    rng = random.Random(5)
    close = [100.0]
    for _ in range(200):
        close.append(close[-1] * (1 + rng.gauss(0, 0.01)))
    df = spark.createDataFrame([("s", i, c) for i, c in enumerate(close)], "symbol string, pos long, close double")
    got = [r.vol for r in indicators.ewma_vol(df).orderBy("pos").collect()]
    r = pd.Series(close).pct_change().fillna(0)
    want = r.ewm(span=32, adjust=False).std().shift(1).bfill().replace(0, np.nan).ffill().fillna(0)
    assert np.allclose(got[3:], want[3:], rtol=1e-9)


def loop_labels(b, horizon, up, dn, rule):
    out = {}
    for i, (_, _, close, hi, lo) in enumerate(b):
        label, end = 0, min(i + horizon, len(b) - 1)
        for j in range(i + 1, end + 1):
            u, d = b[j][3] >= close * (1 + up), b[j][4] <= close * (1 - dn)
            if u or d:
                label, end = (({"pt_wins": 1, "sl_wins": -1, "drop": 0}[rule]) if u and d else 1 if u else -1), j
                break
        out[i] = (label, end)
    return out


@pytest.mark.parametrize("rule", ["drop", "pt_wins", "sl_wins"])
def test_labels_equal_a_loop(spark, rule):
    rng = random.Random(9)
    b = []
    for i in range(150):
        c = 100 + rng.uniform(-10, 10)
        b.append(("s", i, c, c + rng.uniform(0, 12), c - rng.uniform(0, 12)))
    df = spark.createDataFrame(b, "symbol string, pos long, close double, high double, low double")
    rows = touch.barriers(df, 0.1, 0.1).withColumn("t1", F.least(F.col("pos") + 7, F.lit(149)))
    got = {r.pos: (r.label, r.t_end) for r in touch.label_bars(rows, df, 7, rule=rule).collect()}
    assert got == loop_labels(b, 7, 0.1, 0.1, rule)
    parts = touch.label_bars(rows.repartition(5), df.repartition(3), 3, rule=rule)
    assert {r.pos: (r.label, r.t_end) for r in parts.collect()} == got


def test_exclusive(spark):
    df = spark.createDataFrame([("a", 0, 3), ("a", 2, 9), ("a", 4, 4), ("a", 5, 8), ("a", 9, 9), ("b", 1, 1), ("b", 2, 2)], "symbol string, pos long, t_end long")
    assert sorted((r.symbol, r.pos) for r in touch.exclusive(df).collect()) == [("a", 0), ("a", 4), ("a", 5), ("a", 9), ("b", 1), ("b", 2)]


def test_asof_edges(spark):
    left = spark.createDataFrame([("a", 10), ("a", 20), ("b", 5)], "k string, t long")
    right = spark.createDataFrame([("a", 8, 1.0), ("a", 12, 2.0), ("a", 20, 3.0)], "k string, t long, v double")
    back = {(r.k, r.t): r.v for r in asof.asof(left, right, ["k"], "t", "v", 1).collect()}
    assert back == {("a", 10): None, ("a", 20): 3.0, ("b", 5): None}
    near = {(r.k, r.t): r.v for r in asof.asof(left, right, ["k"], "t", "v", how="nearest").collect()}
    assert near == {("a", 10): 1.0, ("a", 20): 3.0, ("b", 5): None}


def test_weighted_quantile(spark):
    xs, ws = [3.0, 1.0, 2.0, 5.0], [1.0, 2.0, 1.0, 4.0]
    df = spark.createDataFrame([("g", x, w) for x, w in zip(xs, ws)], "g string, x double, w double")
    order = np.argsort(xs)
    for q in (0.05, 0.5, 0.8, 1.0):
        c = np.cumsum(np.array(ws)[order])
        want = np.interp(q * c[-1], c, np.array(xs)[order])
        assert np.isclose(policy.weighted_quantile(df, ["g"], "x", "w", q, "r").first().r, want)


def test_kline_ticks(spark):
    k = spark.createDataFrame([("s", 0, 59_999, 10.0, 12.0, 9.0, 11.0, 7.0, 25.0, 3.0), ("s", 60_000, 119_999, 5.0, 5.0, 5.0, 5.0, 0.0, 0.0, 0.0)], "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, trades double, taker_buy_volume double")
    rows = synthetic.kline_ticks(k).orderBy("us").collect()
    first = [r for r in rows if r.open_time == 0]
    assert len(first) == 25 and first[0].price == 10 and first[-1].price == 11
    assert max(r.price for r in first) == 12 and min(r.price for r in first) == 9 and abs(sum(r.qty for r in first) - 7) < 1e-9
    assert len(rows) - len(first) == 4


def test_images(spark):
    got = plans.QUERIES["window_images"](spark, "/root/testdata/sf0.01").first()
    x = np.array([1.0, 4, 2, 8, 5, 7, 3, 6])
    s, d = imaging.gaf(x, 8)
    assert np.allclose(s, s.T) and np.allclose(d, -d.T)
    m = imaging.mtf(x, 4, 8)
    assert m.min() >= 0 and m.max() <= 1 and len(got.gasf) == 64 and len(got.cwt) == 64
    assert imaging.recurrence(x, 8).diagonal().all()


def test_samples_and_months(spark):
    a = plans.QUERIES["seeded_sample"](spark, SF).collect()
    assert a == plans.QUERIES["seeded_sample"](spark, SF).collect() and len(a) == 500
    assert len({r.seq for r in plans.QUERIES["weighted_sample"](spark, SF).collect()}) == 500
    ticks = T.event_ticks(spark, SF).select(S.month(F.col("us")).alias("m")).distinct()
    kept = T.event_ticks(spark, SF).filter("seq % 2 = 0").select(S.month(F.col("us")).alias("m")).distinct()
    assert kept.join(ticks, "m", "left_anti").isEmpty()


def test_streaming_bars(spark, tmp_path):
    from barloom.streaming import bars as stream

    t = T.event_ticks(spark, SF).withColumn("ts", F.timestamp_micros("us"))
    t.write.parquet(str(tmp_path / "in"))
    q = stream.time_bars(spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("bars").count() == stream.time_bars(t).count() > 0
