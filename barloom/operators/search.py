"""The first row of a path inside an event's range that reaches one of its two levels, in passes that are linear in path and events.

The path is cut into stretches that hold no more than ROWS of its rows, however dense it is. A pass deals path and events by stretch, sorted so that a stretch's path
comes before its events; a task holds one stretch of the path at a time, as maxima and minima over powers of two rows, and streams the events, each of which
skips ahead by those. Where a stretch is longer than the longest range, it also holds the path up to that range beyond its end, and one pass is all. Else events that end beyond their
stretch go on among the extremes of stretches, which are a shorter path of the same kind, to the one stretch that can hold their touch. An event is thus moved three times
at most for each such level, and no pair of an event and a path row leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .halo import haloed

#: Rows of path in a stretch, about.
ROWS = 1 << 14
FOUND = ("at", "hit_up", "hit_dn", "high_at", "low_at")
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _ordered(column: pa.Array, missing: int) -> np.ndarray:
    """Doubles as whole numbers of the order that Spark compares them in: both zeros are equal, and what is not a number is above all; nulls as `missing`."""
    x = column.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    x[np.isnan(x)] = np.nan
    bits = np.abs(x).view(np.int64)
    return np.where(column.is_null().to_numpy(zero_copy_only=False), missing, np.where(np.signbit(x) & ~np.isnan(x), -bits, bits))


class _Stretch:
    """A stretch of path in order of x."""

    def __init__(self, parts: list[tuple[pa.Array, ...]]):
        x, self.high, self.low = (pa.concat_arrays([p[i] for p in parts]) for i in range(3)) if parts else (pa.array([], pa.int64()), pa.array([], pa.float64()), pa.array([], pa.float64()))
        self.x = x.to_numpy(zero_copy_only=False)
        # [k]: the extremes of 2**k rows from each row on
        self.top, self.bottom = [_ordered(self.high, _LEAST)], [_ordered(self.low, _MOST)]
        while 2 << len(self.top) - 1 <= len(self.x):
            half = 1 << len(self.top) - 1
            self.top.append(np.maximum(self.top[-1][:-half], self.top[-1][half:]))
            self.bottom.append(np.minimum(self.bottom[-1][:-half], self.bottom[-1][half:]))

    def find(self, lo: np.ndarray, hi: np.ndarray, up: pa.Array, dn: pa.Array) -> list[pa.Array]:
        """FOUND for each event."""
        at, end = np.searchsorted(self.x, lo, "left"), np.searchsorted(self.x, hi, "right")
        above, below = _ordered(up, _MOST), _ordered(dn, _LEAST)
        if len(self.x):
            for k in range(len(self.top) - 1, -1, -1):
                here = np.minimum(at, len(self.top[k]) - 1)
                free = (at + (1 << k) <= end) & (self.top[k][here] < above) & (self.bottom[k][here] > below)
                at = at + (free.astype(np.int64) << k)
        none = at >= end
        row = pa.array(np.where(none, 0, at), mask=none)
        i = np.minimum(at, max(len(self.x) - 1, 0))
        hit_up, hit_dn = (self.top[0][i] >= above, self.bottom[0][i] <= below) if len(self.x) else (none, none)
        return [pa.array(self.x, pa.int64()).take(row), pa.array(hit_up, mask=none), pa.array(hit_dn, mask=none), self.high.take(row), self.low.take(row)]


def _pass(path: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """events (keys, _g, eid, lo, hi, up, dn) with FOUND, from the rows of path (keys, _g, x, high, low) of their own stretch _g."""
    nothing = F.lit(None).cast(events.schema["eid"].dataType)
    rows = path.select(*keys, "_g", F.lit(0).alias("_kind"), F.col("x").alias("_x"), nothing.alias("eid"), F.lit(None).cast("long").alias("hi"), F.col("high").alias("up"), F.col("low").alias("dn"))
    rows = rows.unionByName(events.select(*keys, "_g", F.lit(1).alias("_kind"), F.col("lo").alias("_x"), "eid", "hi", "up", "dn"))
    dealt = rows.repartition(*keys, "_g").sortWithinPartitions(*keys, "_g", "_kind", "_x", "up", "dn")
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, stretch = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            new = np.ones(batch.num_rows, bool)
            same = [pa.compute.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False) for c in batch.columns[: n + 2]]
            new[1:] = np.logical_or.reduce(same)
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:]):
                part = batch.slice(a, z - a).columns
                key = tuple(c[0].as_py() for c in part[: n + 1])
                if key != now:
                    now, held, stretch = key, [], None
                if part[n + 1][0].as_py() == 0:
                    held.append((part[n + 2], part[n + 5], part[n + 6]))
                    continue
                if stretch is None:
                    stretch, held = _Stretch(held), []
                lo, hi = (part[i].to_numpy(zero_copy_only=False) for i in (n + 2, n + 4))
                found = stretch.find(lo, hi, part[n + 5], part[n + 6])
                yield pa.RecordBatch.from_arrays([*part[: n + 1], part[n + 3], part[n + 2], *part[n + 4 :], *found], names=[*names, *FOUND])

    names = [*keys, "_g", "eid", "lo", "hi", "up", "dn"]
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields} | {"lo": "long", "hi": "long", "up": "double", "dn": "double"}
    return dealt.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", at long, hit_up boolean, hit_dn boolean, high_at double, low_at double")


def _densest(df: DataFrame, keys: list[str], at: str, unit: int) -> int:
    """The most rows that a unit of the column `at` holds."""
    return df.groupBy(*keys, F.floor(F.col(at) / unit)).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def first_rows(events: DataFrame, path: DataFrame, keys: list[str], longest: int | None = None, rows: int = ROWS) -> DataFrame:
    """(keys, eid, at, hit_up, hit_dn, high_at, low_at) of events that touch; path's x is unique within keys. longest: no stretch is longer.

    events: keys, eid, lo, hi, up, dn, where lo <= hi and both are long; path: keys, x long, high, low as doubles.
    """
    width = (events.agg(F.max(F.col("hi") - F.col("lo"))).first()[0] or 0) + 1
    unit = min(width, max(2, longest or width))
    dense = _densest(path, keys, "x", unit)
    while dense > rows and unit > 2:  # at two at least, the extremes are half the path or less
        unit = max(2, unit * rows // (2 * dense))
        dense = _densest(path, keys, "x", unit)
    if unit == width:
        if longest is None:  # n units overlap n + 1 of those counted
            unit *= max(1, rows // max(1, dense, _densest(events, keys, "lo", unit)) - 1)
        ahead = haloed(path, keys, "x", unit, ahead=width - 1).withColumnRenamed("_hb", "_g")
        met = _pass(ahead, events.withColumn("_g", F.floor(F.col("lo") / unit)), keys)
        return met.filter("at is not null").select(*keys, "eid", *FOUND)
    own = path.withColumn("_g", F.floor(F.col("x") / unit))
    met = staged(_pass(own, events.withColumn("_g", F.floor(F.col("lo") / unit)), keys), "touches")
    last = F.floor(F.col("hi") / unit)
    more = met.filter(F.col("at").isNull() & (last > F.col("_g"))).select(*keys, "eid", F.col("lo").alias("_from"), F.col("hi").alias("_to"), "up", "dn", (F.col("_g") + 1).alias("lo"), last.alias("hi"))
    extremes = staged(own.groupBy(*keys, F.col("_g").alias("x")).agg(F.max("high").alias("high"), F.min("low").alias("low")), "extremes")
    # an event carries its range on as part of its id
    carried = F.struct("eid", "_from", "_to", "up", "dn").alias("eid")
    there = first_rows(more.select(*keys, carried, "lo", "hi", "up", "dn"), extremes, keys, rows=rows)
    late = there.select(*keys, F.col("at").alias("_g"), "eid.eid", F.col("eid._from").alias("lo"), F.col("eid._to").alias("hi"), "eid.up", "eid.dn")
    late = _pass(own, late, keys).filter("at is not null")
    return met.filter("at is not null").select(*keys, "eid", *FOUND).unionByName(late.select(*keys, "eid", *FOUND))
