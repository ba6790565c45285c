"""Motif clusters against plain k-means steps, and window images against loops over their definitions."""

import datetime
import math

import numpy as np

from barloom.operators import imaging, training

KINDS = "id long, vector array<float>, other string"


def test_motifs_are_a_fixed_point_and_the_cheapest(spark):
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(4, 6)) * 20
    points = np.vstack([c + rng.normal(size=(60, 6)) for c in centers]).astype(np.float32)
    odd = [None, [], [1.0, 2.0], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] * 6]
    rows = [(i, [float(x) for x in v], "x") for i, v in enumerate([*points, points[0]])] + [(1000 + i, v, None) for i, v in enumerate(odd)]
    df = spark.createDataFrame(rows, KINDS)
    got = {r.id: r.cluster for r in training.motifs(df, "vector", 4, tries=3).collect()}
    assert len(got) == len(rows) and all(got[1000 + i] is None for i in range(len(odd))) and got[240] == got[0]
    found = np.array([got[i] for i in range(240)])
    means = np.array([points[found == c].mean(axis=0) for c in range(4)])
    distance = ((points[:, None, :] - means[None]) ** 2).sum(axis=2)
    assert (distance.argmin(axis=1) == found).all()  # each in the nearest of the means of its groups
    assert all(len(set(found[k * 60 : k * 60 + 60])) == 1 for k in range(4)) and len(set(found)) == 4
    assert got == {r.id: r.cluster for r in training.motifs(df, "vector", 4, tries=3).collect()}
    assert training.motifs(df.filter("id < 0"), "vector").count() == 0
    assert [r.cluster for r in training.motifs(df.filter("id in (1000, 1001)"), "vector").collect()] == [None, None]


def parts(x, k):
    """Means of k consecutive parts, the first ones longer by one."""
    n, out, at = len(x), [], 0
    for i in range(k):
        size = n // k + (i < n % k)
        out.append(sum(x[at : at + size]) / size)
        at += size
    return out


def quantile(x, q):
    s, place = sorted(x), (len(x) - 1) * q
    low = math.floor(place)
    return s[low] + (s[min(low + 1, len(s) - 1)] - s[low]) * (place - low)


def robust(x):
    spread = quantile(x, 0.75) - quantile(x, 0.25)
    return [(v - quantile(x, 0.5)) / (spread or 1.0) for v in x]


def plain_gaf(x, k):
    lo, hi = min(x), max(x)
    angle = [math.acos(min(1.0, max(-1.0, v))) for v in parts([2 * (v - lo) / (hi - lo + 1e-12) - 1 for v in x], k)]
    return [[math.cos(a + b) for b in angle] for a in angle], [[math.sin(a - b) for b in angle] for a in angle]


def plain_mtf(x, n):
    x = [float(np.float32(v)) for v in x]
    different = len(set(x))
    edges = [quantile(x, i / n) for i in range(n + 1)]
    if different > 1 and any(b <= a for a, b in zip(edges, edges[1:])):
        n = min(n, different)
        edges = [min(x) + (max(x) - min(x)) * i / n for i in range(n + 1)]
    z = [sum(v >= e for e in edges[1:-1]) if different > 1 else 0 for v in x]
    moves = {}
    for a, b in zip(z, z[1:]):
        moves[a, b] = moves.get((a, b), 0) + 1
    leave = {a: sum(m for (c, _), m in moves.items() if c == a) for a in z}
    return [[moves.get((a, b), 0) / max(1, leave[a]) for b in z] for a in z]


def plain_scalogram(x, side):
    mean = sum(x) / len(x)
    std = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x))
    z = [(v - mean) / (std + 1e-12) for v in x]
    n = min(32, max(4, min(32, side)))
    m = []
    for i in range(n):
        w = max(2, side) ** (i / (n - 1))
        reach, row = int(8 * w + 1e-9), []
        for t in range(len(z)):
            at = [(u, (t - u) / w) for u in range(len(z)) if abs(t - u) <= reach]
            row.append(sum(z[u] * math.cos(5 * s) * math.exp(-s * s / 2) / math.sqrt(w) for u, s in at))
        m.append(row)
    low, high = min(map(min, m)), max(map(max, m))
    return [[(v - low) / (high - low + 1e-12) for v in row] for row in m]


def test_images_equal_loops(spark):
    rng = np.random.default_rng(9)
    n = 60
    price = np.round(100 + np.cumsum(rng.normal(size=n)), 2)
    price[20:40] = np.repeat(price[20:25], 4)  # ties
    start = datetime.datetime(2024, 3, 1, 22, tzinfo=datetime.timezone.utc)
    us = [int((start + datetime.timedelta(minutes=7 * i)).timestamp() * 1e6) for i in range(n)]
    rows = [("A", i, us[i], float(price[i]), float(rng.integers(1, 9))) for i in range(n)] + [("B", i, us[i], 5.0, 1.0) for i in range(16)]
    rows += [("C", i, us[i], float("nan") if i == 3 else 1.0 + i, 1.0) for i in range(16)] + [("D", i, us[i], 1.0, 1.0) for i in range(15)]
    bars = spark.createDataFrame(rows, "symbol string, pos long, us long, close double, qty double")
    width, side = 16, 16
    got = imaging.images(imaging.windows(bars, width, 4), side, 4, rp=True, cwt=True).collect()
    assert {(r.symbol, r.start) for r in got} == {("A", s) for s in range(0, n - width + 1, 4)} | {("B", 0)}  # C has no finite window, D no full one
    for r in got:
        mine = [x for x in rows if x[0] == r.symbol][r.start : r.start + width]
        x, q = robust([m[3] for m in mine]), robust([m[4] for m in mine])
        gap = 0.2 * max(abs(a - b) for a in x for b in x)
        same = lambda channel, want: np.testing.assert_allclose(np.array(channel).reshape(side, side), want, atol=2e-5)
        s, d = plain_gaf(x, side)
        if r.symbol == "A":  # of a constant series the angles are all the same
            same(r.gadf, d)
        same(r.gasf, s), same(r.q_gasf, plain_gaf(q, side)[0]), same(r.mtf, plain_mtf(x, 4))
        same(r.rp, [[float(abs(a - b) <= gap) for b in x] for a in x])
        same(r.cwt, plain_scalogram(x, side))
        end = datetime.datetime.fromtimestamp(mine[-1][2] / 1e6, datetime.timezone.utc)
        day = 2 * math.pi * (end.hour * 60 + end.minute) / 1440
        week = 2 * math.pi * end.weekday() / 7
        for channel, want in ((r.tod_sin, math.sin(day)), (r.tod_cos, math.cos(day)), (r.dow_sin, math.sin(week)), (r.dow_cos, math.cos(week))):
            same(channel, np.full((side, side), want))


def test_paa_and_resize():
    x = np.array([3.0, 1, 4, 1, 5, 9, 2])
    np.testing.assert_allclose(imaging._paa(x, 3), parts(list(x), 3))
    m = imaging.resize(np.arange(12.0).reshape(3, 4), 2)
    np.testing.assert_allclose(m, [[0, 3], [8, 11]])
