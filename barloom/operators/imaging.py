"""Sliding windows of bars and the matrices made from them.

Windows are built by a window function; the matrices of a window are numpy work on that row alone, in Arrow batches, so windows spread
over tasks and memory is one batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .scan import position

SHARD = 2048


def windows(bars: DataFrame, width: int, stride: int) -> DataFrame:
    """(symbol, start, values, qtys, t0_us, t1_us): closes and quantities of each full window that starts at a multiple of stride.

    A bar goes to the windows it is in, width / stride of them at most, so nothing is gathered where no window starts.
    """
    first = F.ceil(F.greatest(F.col("pos") - (width - 1), F.lit(0)) / stride)
    starts = F.sequence(first, F.floor(F.col("pos") / stride))
    inside = bars.select("symbol", "pos", "us", "close", "qty", F.explode(F.when(first <= F.floor(F.col("pos") / stride), starts)).alias("k"))
    rows = inside.groupBy("symbol", (F.col("k") * stride).cast("long").alias("start")).agg(F.array_sort(F.collect_list(F.struct("pos", "close", "qty", "us"))).alias("w")).filter(F.size("w") == width)
    return rows.select("symbol", "start", F.col("w.close").alias("values"), F.col("w.qty").alias("qtys"), F.get("w.us", 0).alias("t0_us"), F.element_at("w.us", -1).alias("t1_us"))


def scaled(values):
    """A column: (x - median) / interquartile range of an array, over 1 where that range is 0."""
    at = lambda q: _linear(F.array_sort(values), q)
    spread = at(0.75) - at(0.25)
    return F.transform(values, lambda x: (x - at(0.5)) / F.when(spread == 0, 1.0).otherwise(spread))


def _linear(ordered, q: float):
    place = (F.size(ordered) - 1) * F.lit(q)
    low = F.floor(place).cast("int")
    a = F.get(ordered, low)
    b = F.coalesce(F.get(ordered, low + 1), a)
    return a + (b - a) * (place - low)


def _paa(x: np.ndarray, size: int) -> np.ndarray:
    return np.array([part.mean() for part in np.array_split(x, size)])


def gaf(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Angular sum and difference fields of a series scaled to -1 .. 1."""
    lo, hi = x.min(), x.max()
    c = np.clip(_paa(2 * (x - lo) / (hi - lo + 1e-12) - 1, size), -1, 1)
    s = np.sqrt(1 - c * c)
    return np.outer(c, c) - np.outer(s, s), np.outer(s, c) - np.outer(c, s)


def bins(x: np.ndarray, n: int) -> tuple[np.ndarray, int]:
    """(bin of each value, number of bins), by quantiles; evenly, with no more bins than distinct values, where two quantiles coincide, the outer ones included.

    A constant series is all in bin 0. A value at an edge belongs to the bin above it.
    """
    x = np.asarray(x, np.float32)
    n, distinct = max(2, n), len(np.unique(x))
    if distinct < 2:
        return np.zeros(len(x), int), 2
    edges = np.quantile(x, np.linspace(0, 1, n + 1))
    if (np.diff(edges) <= 0).any():
        edges = np.linspace(x.min(), x.max(), min(n, distinct) + 1)
    return np.digitize(x, edges[1:-1]), max(2, len(edges) - 1)


def mtf(x: np.ndarray, n: int, size: int) -> np.ndarray:
    """Transition probability between the bins of each two points."""
    z, k = bins(x, n)
    m = np.zeros((k, k))
    np.add.at(m, (z[:-1], z[1:]), 1)
    m /= np.maximum(m.sum(axis=1, keepdims=True), 1.0)
    return resize(m[z][:, z], size)


def recurrence(x: np.ndarray, size: int, part: float = 0.2) -> np.ndarray:
    """1 where two points are no further apart than `part` of the largest distance."""
    d = np.abs(x[:, None] - x[None, :])
    return (d <= part * d.max()).astype(float)[:size, :size]


def scalogram(x: np.ndarray, size: int, scales: int = 32) -> np.ndarray:
    """Real Morlet wavelet values over geometric widths from 1 to the size, scaled to 0 .. 1."""
    z = (x - x.mean()) / (x.std() + 1e-12)
    out = []
    for width in np.geomspace(1, max(2, size), min(32, max(4, min(scales, size)))):
        reach = int(8 * width)
        t = np.arange(-reach, reach + 1) / width
        full = np.convolve(z, np.cos(5 * t) * np.exp(-t * t / 2) / np.sqrt(width))
        out.append(full[reach : reach + len(x)])
    m = np.array(out)
    return resize((m - m.min()) / (m.max() - m.min() + 1e-12), size)


def resize(m: np.ndarray, size: int) -> np.ndarray:
    """size x size: rows by the nearest one below, columns linearly."""
    rows = m[np.clip(np.linspace(0, max(1, m.shape[0] - 1), size).astype(int), 0, m.shape[0] - 1)]
    at = np.linspace(0, max(1, m.shape[1] - 1), size)
    return np.array([np.interp(at, np.arange(m.shape[1]), r) for r in rows])


def channels(rp: bool = False, cwt: bool = False, calendar: bool = True) -> tuple[str, ...]:
    """The names of an image's channels, in order; their number is what a model is built for."""
    return ("gasf", "gadf", "mtf", *(["rp"] if rp else []), *(["cwt"] if cwt else []), "q_gasf", *(["tod_sin", "tod_cos", "dow_sin", "dow_cos"] if calendar else []))


def _robust(v) -> np.ndarray:
    x = np.asarray(v, float)
    q = np.quantile(x, [0.25, 0.5, 0.75])
    return (x - q[1]) / (q[2] - q[0] or 1.0)


def images(wins: DataFrame, size: int, n_bins: int = 8, rp: bool = False, cwt: bool = False, calendar: bool = True) -> DataFrame:
    """(symbol, start, <channel> array<float> of side x side, row by row) for each window; windows with non-finite prices go.

    side is `size`, or the window's length if that is less. Prices and quantities are scaled by median and interquartile range; the calendar
    channels hold one value each, of the window's last time.
    """
    names = channels(rp, cwt, calendar)

    def draw(frames):
        for f in frames:
            rows = []
            for s, a, v, n, *marks in zip(f["symbol"], f["start"], f["values"], f["qtys"], *(f[c] for c in ("tod_sin", "tod_cos", "dow_sin", "dow_cos"))):
                x = np.asarray(v, float)
                if not len(x) or not np.isfinite(x).all():
                    continue
                k = max(1, min(size, len(x)))
                x = _robust(x)
                m = [*gaf(x, k), mtf(x, n_bins, k)]
                m += [recurrence(x, k)] if rp else []
                m += [scalogram(x, k)] if cwt else []
                m += [gaf(_robust(n), k)[0]]
                m += [np.full((k, k), c) for c in marks] if calendar else []
                rows.append((s, a, *[c.astype(np.float32).ravel() for c in m]))
            yield pd.DataFrame(rows, columns=["symbol", "start", *names])

    schema = "symbol string, start long, " + ", ".join(f"{c} array<float>" for c in names)
    return wins.select("symbol", F.col("start").cast("long").alias("start"), "values", "qtys", *S.calendar(F.col("t1_us"))).mapInPandas(draw, schema)


def manifest(wins: DataFrame, shard: int = SHARD, first: int = 0) -> DataFrame:
    """wins with `shard` (from `first` on) and `idx_in_shard`, counted within each symbol, and bar_pos, the last bar of the window."""
    rows = position(wins, ["symbol"], ["start"], F.floor(F.col("start") / 4096), "_n")
    return rows.withColumns({"shard": F.floor(F.col("_n") / shard) + first, "idx_in_shard": F.col("_n") % shard, "bar_pos": F.col("start") + F.size("values") - 1}).drop("_n")
