"""Dollar bars of a stream equal those of the whole table, in several batches out of order, and after a restart from the checkpoint."""

import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars
from barloom.streaming import dollar

SCHEMA = "symbol string, ts timestamp, us long, seq long, price double, qty double, cents long"
T, START = 1000, 1_700_000_000_000_000


@pytest.fixture(scope="module")
def small_state(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def ticks(n, seed):
    rng = random.Random(seed)
    rows, us = [], START
    for k in range(n):
        s = rng.choice("AAAB" if k % 3 else "ABC")
        us += rng.choice([0, 0, 1, 200_000, 1_000_000])
        cents = rng.choice([1, 99, 250, 500, 1000, 3700])
        rows.append((s, us, k, cents / 100, 1.0, cents))
    return rows


def write(spark, rows, path):
    df = spark.createDataFrame(rows, "symbol string, us long, seq long, price double, qty double, cents long")
    df.withColumn("ts", F.timestamp_micros("us")).select(*[c.split()[0] for c in SCHEMA.split(", ")]).coalesce(1).write.mode("append").parquet(path)


def run(spark, src, out, state):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    q = dollar.dollar_bars(stream, T, "60 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


def keys(df):
    return sorted((r.symbol, r.bar_id, r.us, r.open, r.high, r.low, r.close, r.qty, r.cents, r.ticks) for r in df.collect())


def test_equals_the_batch_and_goes_on_after_a_restart(spark, small_state, tmp_path):
    src, out, state = (str(tmp_path / p) for p in ("src", "out", "state"))
    rows = ticks(900, 1)
    parts = [rows[k : k + 150] for k in range(0, 900, 150)]
    end = max(r[1] for r in rows)
    closing = [(s, end + 10_000_000 + k, 10_000 + 3 * k + j, 10.0, 1.0, T) for k in range(2) for j, s in enumerate("ABC")]  # fill whatever is open
    for part in parts[:3]:
        rng = random.Random(2)
        rng.shuffle(part)
        write(spark, part, src)
    run(spark, src, out, state)
    first = keys(spark.read.parquet(out))
    for part in [*parts[3:], closing, [("Z", end + 200_000_000, 99_999, 0.01, 1.0, 1)]]:  # the last one moves the watermark past all others
        write(spark, part, src)
    run(spark, src, out, state)
    got = keys(spark.read.parquet(out))
    whole = spark.createDataFrame([*rows, *closing], "symbol string, us long, seq long, price double, qty double, cents long")
    want = keys(bars.dollar_bars(whole, T))
    assert first and set(first) < set(got) and len(got) == len(set(got))
    # the last bar of a symbol may hold its whole value and still be open
    last = {s: max(b for x, b, *_ in want if x == s) for s in "ABC"}
    assert [b for b in want if b[1] < last[b[0]]] == [b for b in got if b[1] < last[b[0]]]
    assert set(got) <= set(want) and len(want) - len(got) <= 3


def test_ticks_too_late_are_left_out(spark, small_state, tmp_path):
    src, out, state = (str(tmp_path / p) for p in ("src", "out", "state"))
    sent = [("A", 0, 0, 6.0, 1.0, 600), ("A", 300_000_000, 1, 6.0, 1.0, 600), ("A", 310_000_000, 5, 1.0, 1.0, 100), ("A", 1_000_000, 2, 9.0, 1.0, 900), ("A", 700_000_000, 3, 5.0, 1.0, 500), ("B", 900_000_000, 4, 1.0, 1.0, 100)]
    for part in ([t] for t in sent):
        write(spark, [(s, us + START, *rest) for s, us, *rest in part], src)
    run(spark, src, out, state)
    got = keys(spark.read.parquet(out))
    assert got == [("A", 0, START, 6.0, 6.0, 6.0, 6.0, 1.0, 600, 1)]
