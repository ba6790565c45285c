"""The search for first touches against loops, on stretches of few rows, and its plan."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barloom.operators import search, touch

PATH, EVENTS = "k string, x long, high double, low double", "k string, eid long, lo long, hi long, up double, dn double"
above = lambda a, b: a is not None and b is not None and (math.isnan(a) or (a >= b if not math.isnan(b) else False))
below = lambda a, b: a is not None and b is not None and (math.isnan(b) or (a <= b if not math.isnan(a) else False))


@pytest.mark.parametrize("span, longest, rows", [(400, None, 1 << 14), (400, None, 4), (5000, None, 16)])
def test_first_rows_are_those_of_a_loop(spark, span, longest, rows):
    rng = random.Random(span + rows)
    odd = [None, float("nan"), float("inf"), -float("inf"), 0.0, -0.0]
    value = lambda lo, hi: rng.choice(odd) if rng.random() < 0.02 else rng.uniform(lo, hi)
    path = [(k, x, value(-1, 100), value(-100, 1)) for k in ("a", "b") for x in sorted(rng.sample(range(-3000, 6000), 1500))]
    events = [(rng.choice("abc"), i, lo, lo + rng.randint(0, span), value(0, 101), -(v if (v := value(0, 101)) is not None else 0.0)) for i in range(400) for lo in [rng.randint(-3100, 6100)]]
    want = {}
    for k, i, lo, hi, up, dn in events:
        got = next(((x, above(h, up), below(low, dn)) for kk, x, h, low in path if kk == k and lo <= x <= hi and (above(h, up) or below(low, dn))), None)
        if got:
            want[i] = got
    found = search.first_rows(spark.createDataFrame(events, EVENTS), spark.createDataFrame(path, PATH), ["k"], longest, rows)
    assert {r.eid: (r.at, r.hit_up, r.hit_dn) for r in found.collect()} == want and len(want) > 20


def test_touches_are_not_broadcast_and_rows_with_none_stay(spark):
    """Small files may hold many rows; what is found for each of them is joined by shuffle, and no pair of an event and a path row is."""
    events = spark.range(3000).select(F.lit("s").alias("symbol"), F.col("id").alias("eid"), F.floor(F.col("id") / 100).alias("us"), F.lit(2.0).alias("up"), F.when(F.col("id") % 2 == 0, 0.5).alias("dn"))
    path = spark.range(40).select(F.lit("s").alias("symbol"), F.col("id").alias("us"), F.when(F.col("id") == 20, 0.1).otherwise(1.0).alias("price"))
    got = touch.label_ticks(events, path, 10)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortAggregate" not in plan
    want = {i: (0, 20) if i % 2 == 0 and 10 <= i // 100 < 20 else (2, i // 100 + 10) for i in range(3000)}
    assert {r.eid: (r.label, r.event_end_us) for r in got.collect()} == want


def test_bars_with_far_horizons_meet_no_pairs(spark):
    """Every bar is touched by all later ones, thousands of them; only the first leaves the search."""
    bars = spark.range(4000).select(F.lit("s").alias("symbol"), F.col("id").alias("pos"), F.lit(3999).cast("long").alias("t1"), F.lit(1.0).alias("close"), F.lit(1.0).alias("up"), F.lit(0.5).alias("dn"))
    got = touch.label_bars(bars, bars, 32, close_only=True)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "BroadcastHashJoin" not in plan
    assert {(r.pos, r.t_end, r.label, r.reason) for r in got.collect()} == {(i, i + 1, 1, "pt") for i in range(3999)} | {(3999, 3999, 0, "t1")}
