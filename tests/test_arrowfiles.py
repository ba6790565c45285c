"""Arrow files: partitions of record batches, column pruning, several files; klines by a table function."""

import datetime

import pyarrow as pa
import pyarrow.feather as feather
import pyarrow.ipc as ipc
import pytest

from barloom.functions import tablefns
from barloom.sources import arrowfiles, ticks


def table(first, n):
    return pa.table(
        {
            "timestamp": pa.array([1_700_000_000_000 + first + i for i in range(n)], pa.int64()),
            "price": pa.array([None if i == 3 else 1.5 * i for i in range(n)], pa.float64()),
            "side": pa.array(["buy" if i % 2 else "sell" for i in range(n)]).dictionary_encode(),
            "at": pa.array([datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=i) for i in range(n)], pa.timestamp("us", tz="UTC")),
        }
    )


def write(t, path, rows):
    with ipc.new_file(path, t.schema) as out:
        out.write_table(t, max_chunksize=rows)


def test_read_in_partitions(spark, tmp_path):
    write(table(0, 1000), str(tmp_path / "a.feather"), 100)
    feather.write_feather(table(5000, 50).drop_columns(["price"]), str(tmp_path / "b.feather"))
    one = ticks.read_any(spark, str(tmp_path / "a.feather"))
    assert one.columns == ["timestamp", "price", "side", "at"] and one.count() == 1000 and ticks.read_any(spark, str(tmp_path / "a.feather"), 7).count() == 7
    cut = arrowfiles.read_feather(spark, str(tmp_path), ["price", "timestamp"], partition_rows=250)
    assert cut.rdd.getNumPartitions() == 6 and set(cut.columns) == {"price", "timestamp"} and cut.count() == 1050
    assert cut.filter("price is null").count() == 51
    got = {r.timestamp: (r.price, r.side, r.at) for r in one.collect()}
    assert got[1_700_000_000_003][0] is None and got[1_700_000_000_004][:2] == (6.0, "sell") and got[1_700_000_000_004][2].second == 4


def test_bad_files(spark, tmp_path):
    (tmp_path / "x.feather").write_bytes(b"FEA1 not arrow")
    for path, columns in ((str(tmp_path / "x.feather"), None), (str(tmp_path / "none.feather"), None)):
        with pytest.raises(Exception):
            arrowfiles.read_feather(spark, path, columns).count()
    write(table(0, 5), str(tmp_path / "y.feather"), 5)
    with pytest.raises(Exception):
        arrowfiles.read_feather(spark, str(tmp_path / "y.feather"), ["nothing"]).count()
    write(table(0, 0), str(tmp_path / "z.feather"), 5)
    assert arrowfiles.read_feather(spark, str(tmp_path / "z.feather")).count() == 0


def test_klines_by_a_table_function(spark):
    tablefns.register(spark)
    rows = [("A", 60_000 * i, 60_000 * i + 59_999, 10.0 + i, 20.0 + i, 5.0 + i, 12.0 + i, 7.5, 3 if i == 0 else None if i == 1 else 500, 2.5, "x") for i in range(5)]
    rows += [("A", None, 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1, 1.0, "x"), ("B", 0, 59_999, 1.0, None, 1.0, 1.0, 1.0, 1, 1.0, "x"), ("C", 0, None, 3.0, 3.0, 3.0, 3.0, None, 9, None, "x")]
    spark.createDataFrame(rows, "symbol string, open_time long, close_time long, open double, high double, low double, close double, volume double, trades long, taker_buy_volume double, k string").createOrReplaceTempView("klines_here")
    found = spark.sql("SELECT * FROM kline_ticks(TABLE(klines_here) PARTITION BY symbol ORDER BY (open_time), 40)").collect()
    by = {}
    for r in found:
        by.setdefault((r.symbol, r.open_time), []).append(r)
    assert {k: len(v) for k, v in by.items()} == {("A", 0): 4, ("A", 60_000): 40, ("A", 120_000): 40, ("A", 180_000): 40, ("A", 240_000): 40, ("C", 0): 9}
    for (s, t), held in by.items():
        held.sort(key=lambda r: r.k)
        prices = [r.price for r in held]
        want = next(x for x in rows if x[0] == s and x[1] == t)
        assert (prices[0], max(prices), min(prices), prices[-1]) == want[3:7] and [r.us for r in held] == sorted(r.us for r in held)
        assert sum(r.qty for r in held) == pytest.approx(want[7] or 0.0) and held[-1].us <= (want[2] or t + 59_999) * 1000
    assert {tuple(r) for r in spark.sql("SELECT * FROM kline_ticks(TABLE(klines_here) PARTITION BY (symbol, open_time), 40)").collect()} == {tuple(r) for r in found}
