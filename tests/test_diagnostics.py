"""The labeler with diagnostics and exclusive events against a loop; halo windows against whole windows."""

import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import halo, touch

MIN = 60_000_000
BARS = "symbol string, pos long, us long, close double, high double, low double, atr double"


def series(n, seed):
    rng, rows, us, c = random.Random(seed), [], 0, 100.0
    for k in range(n):
        us += MIN * rng.choice([1, 1, 2, 7])
        c = max(5.0, c + rng.gauss(0, 1))
        rows.append((us, c, c + rng.random() * 2, c - rng.random() * 2, rng.choice([0.5, 1.0, 2.0, float("nan") if k % 11 == 5 else 1.5])))
    return rows


def loop(rows, cfg):
    """SURVEY's labeler, a row at a time: (pos, i, t_end, label, reason, pt_idx, sl_idx, t1)."""
    valid, known = [], None
    for pos, (us, c, hi, lo, a) in enumerate(rows):
        if cfg["barriers"]["mode"] == "atr":
            if known is not None:
                size = max(known, abs(c) * 1e-12)
                valid.append((pos, us, c, hi, lo, c + cfg["barriers"]["pt_mult"] * size, c - cfg["barriers"]["sl_mult"] * size))
            known = a if a == a else known
        else:
            valid.append((pos, us, c, hi, lo, c * (1 + cfg["barriers"]["up"]), c * (1 - cfg["barriers"]["down"])))
    n, out, free = len(valid), [], 0
    for i, (pos, us, c, _, _, up, dn) in enumerate(valid):
        t1 = next((j for j in range(n) if valid[j][1] >= us + cfg["horizon"]["minutes"] * MIN), n - 1)
        if i == n - 1:
            out.append((pos, i, i, 0, "", -1, -1, t1))
            continue
        if cfg.get("exclusive_events") and i < free:
            out.append((pos, i, i, 0, "dropped", -1, -1, t1))
            continue
        start = i if cfg.get("allow_same_bar_touch", True) else i + 1
        end, reason, hit = max(t1, start), "t1", -1
        for j in range(start, end + 1):
            u, d = valid[j][3] >= up, valid[j][4] <= dn
            if u or d:
                reason = {"pt_wins": "pt", "sl_first": "sl"}.get(cfg.get("same_bar_resolution"), "dropped") if u and d else "pt" if u else "sl"
                hit = j
                break
        t_end = hit if reason in ("pt", "sl") else i if reason == "dropped" else end
        out.append((pos, i, t_end, {"pt": 1, "sl": -1}.get(reason, 0), reason, hit if reason == "pt" else -1, hit if reason == "sl" else -1, t1))
        free = max(free, t_end + 1 + cfg.get("min_gap_bars", 0))
    return out


@pytest.mark.parametrize(
    "cfg",
    [
        {"barriers": {"mode": "atr", "pt_mult": 1.0, "sl_mult": 0.8}, "horizon": {"minutes": 20}},
        {"barriers": {"mode": "atr", "pt_mult": 2.0, "sl_mult": 1.5}, "horizon": {"minutes": 60}, "exclusive_events": True, "min_gap_bars": 1},
        {"barriers": {"mode": "percent", "up": 0.01, "down": 0.012}, "horizon": {"minutes": 45}, "allow_same_bar_touch": False, "same_bar_resolution": "pt_wins"},
        {"barriers": {"mode": "percent", "up": 0.02, "down": 0.02}, "horizon": {"minutes": 0}, "allow_same_bar_touch": False, "same_bar_resolution": "sl_first", "exclusive_events": True},
    ],
)
def test_diagnostics_equal_a_loop(spark, cfg):
    data = {s: series(n, k) for k, (s, n) in enumerate((("A", 150), ("B", 37), ("C", 2), ("D", 1)))}
    df = spark.createDataFrame([(s, p, *r) for s, rows in data.items() for p, r in enumerate(rows)], BARS)
    got = {}
    for r in touch.diagnostics(df.repartition(5), cfg).collect():
        got.setdefault(r.symbol, []).append((r.pos, r.i, r.t_end, r.label, r.reason, r.pt_idx, r.sl_idx, r.t1_idx))
        at = data[r.symbol]
        assert r.dropped == (r.reason == "dropped") and r.entry_px == at[r.pos][1] and r.time_to_hit_sec == (r.end_us - r.us) / 1e6
    want = {s: loop(rows, cfg) for s, rows in data.items()}
    assert {s: sorted(v) for s, v in got.items()} == {s: v for s, v in want.items() if v}


def test_a_bar_that_touches_both(spark):
    """The cases worked out by hand: barriers at 110 and 90, looked at from the next bar on."""
    for bars, rule, label, reason, pt, sl in [
        ([(105, 96), (111, 99)], "drop", 1, "pt", 2, -1), ([(105, 96), (103, 89)], "drop", -1, "sl", -1, 2), ([(111, 89), (1, 1)], "drop", 0, "dropped", -1, -1),
        ([(111, 89), (1, 1)], "pt_wins", 1, "pt", 1, -1), ([(111, 89), (1, 1)], "sl_wins", -1, "sl", -1, 1), ([(105, 96), (104, 97)], "drop", 0, "t1", -1, -1),
    ]:
        rows = [("A", 0, 0, 100.0, 101.0, 99.0, 1.0), *(("A", k + 1, (k + 1) * MIN, 100.0, float(h), float(lo), 1.0) for k, (h, lo) in enumerate(bars))]
        cfg = {"barriers": {"mode": "percent", "up": 0.10, "down": 0.10}, "horizon": {"minutes": 2}, "allow_same_bar_touch": False, "same_bar_resolution": rule}
        first = touch.diagnostics(spark.createDataFrame(rows, BARS), cfg).filter("i = 0").first()
        assert (first.label, first.reason, first.pt_idx, first.sl_idx) == (label, reason, pt, sl) and first.t_end == {"t1": 2, "dropped": 0}.get(reason, max(pt, sl))


def test_a_long_chain_in_few_rounds(spark):
    """A million rows of one symbol, dropped events that end at their own bar among them, and a gap."""
    n, gap = 1_000_000, 2
    end = F.when(F.col("pos") % 7 == 3, F.col("pos")).otherwise(F.col("pos") + F.pmod(F.xxhash64("pos"), F.lit(40)))
    df = spark.range(n).select(F.lit("A").alias("symbol"), F.col("id").alias("pos")).withColumn("t_end", end)
    links = df.select("symbol", "pos", F.when(F.col("t_end") + 1 + gap < n, F.col("t_end") + 1 + gap).alias("nxt"))
    began = time.time()
    got = sorted(r.pos for r in touch.reached(links, ["symbol"]).select("pos").collect())
    print(f"{len(got)} of {n} rows in {time.time() - began:.0f} s")
    ends, want, free = [r.t_end for r in df.orderBy("pos").select("t_end").collect()], [], 0
    while free < n:
        want.append(free)
        free = ends[free] + 1 + gap
    assert got == want


def test_halo_windows_equal_whole_ones(spark):
    rng = random.Random(6)
    rows, us = [], 0
    for s, n in (("A", 200), ("B", 1), ("C", 33)):
        for pos in range(n):
            us += rng.choice([0, 1, 5, 60])
            rows.append((s, pos, us, rng.gauss(0, 1) if rng.random() < 0.6 else None))
    df = spark.createDataFrame(rows, "symbol string, pos long, us long, x double")
    by_pos, by_us = Window.partitionBy("symbol").orderBy("pos"), Window.partitionBy("symbol").orderBy("us")
    key = lambda d, *c: sorted(((r.symbol, r.pos, *[None if r[k] is None else round(r[k], 9) for k in c]) for r in d.collect()), key=str)
    for width in (7, 64):
        got = halo.windowed(df, ["symbol"], "pos", lambda w: {"a": F.lag("x").over(w), "b": F.sum("x").over(w.rowsBetween(-5, 3))}, back=5, ahead=3, width=width)
        assert key(got, "a", "b") == key(df.withColumns({"a": F.lag("x").over(by_pos), "b": F.sum("x").over(by_pos.rowsBetween(-5, 3))}), "a", "b")
        got = halo.windowed(df, ["symbol"], "us", lambda w: {"a": F.max("x").over(w.rangeBetween(-90, 20))}, back=90, ahead=20, width=width)
        assert key(got, "a") == key(df.withColumn("a", F.max("x").over(by_us.rangeBetween(-90, 20))), "a")
        for ahead in (False, True):
            frame = by_pos.rowsBetween(0, Window.unboundedFollowing) if ahead else by_pos.rowsBetween(Window.unboundedPreceding, 0)
            want = (F.first if ahead else F.last)("x", ignorenulls=True).over(frame)
            assert key(halo.filled(df, ["symbol"], "pos", F.col("x"), "a", ahead, width), "a") == key(df.withColumn("a", want), "a")
        upto = by_pos.rowsBetween(Window.unboundedPreceding, 0)
        assert key(halo.running_max(df, ["symbol"], "pos", F.col("x"), "a", width), "a") == key(df.withColumn("a", F.max("x").over(upto)), "a")
