"""Vector codes against a plain Lloyd over all distances, in Python's whole numbers."""

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import veccodes

CLASHING = ("id", "v", "ids", "labels", "parts", "code", "error", "label_error", "n", "sums", "_label")


def plain_codes(rows, rounds=4, parts=4, entries=256):
    """rows: (id, vector, label) of the vectors that count."""
    whole = [[math.floor(1024 * x) for x in v] for _, v, _ in rows]
    d = len(whole[0]) // parts
    cut = lambda v, p: v[p * d : (p + 1) * d]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, whole[k]))[:entries]
    books = [[cut(whole[k], p) for k in order] for p in range(parts)]

    def nearest(p):
        out = []
        for v in whole:
            x = cut(v, p)
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])))
        return out

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for v, (_, e) in zip(whole, nearest(p)):
                groups[e].append(cut(v, p))
            for e, held in groups.items():
                books[p][e] = [sum(c) // len(held) for c in zip(*held)]
    last = [nearest(p) for p in range(parts)]
    errors = [sum(last[p][k][0] for p in range(parts)) for k in range(len(rows))]
    by_label = defaultdict(int)
    for (_, _, label), e in zip(rows, errors):
        by_label[label] += e
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{last[p][k][1]:02x}" for p in range(parts)), errors[k], by_label[label], digest) for k, (i, _, label) in enumerate(rows)), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit("x") for c in CLASHING})


def coded(df):
    return sorted(map(tuple, veccodes.vector_codes(df).collect()), key=str)


@pytest.mark.parametrize("n, block, leaf, spread", [(40, 8192, 16, 1.0), (420, 64, 4, 1.0), (600, 8192, 16, 0.01), (300, 100, 2, 3000.0)])
def test_codes_equal_a_plain_lloyd(spark, monkeypatch, n, block, leaf, spread):
    monkeypatch.setattr(veccodes, "BLOCK", block)
    monkeypatch.setattr(veccodes, "LEAF", leaf)
    rng = np.random.default_rng(n)
    centres = rng.normal(size=(9, 8)) * spread
    rows = [(int(i), [float(x) for x in (centres[rng.integers(9)] + rng.normal(size=8) * spread / 50).astype(np.float32)], int(rng.integers(3)) if i % 7 else None) for i in rng.permutation(n)]
    rows += [(i, rows[3][1], 1) for i in range(n, n + 20)] + [rows[5], (rows[6][0], rows[8][1], 2), (None, rows[9][1], 0), (None, rows[2][1], None)]
    bad = [(-1, None, 0), (-2, [0.5] * 7 + [None], 0), (-3, [float("nan")] * 8, 0), (-4, [float("inf")] + [0.0] * 7, 1), (-5, [0.1] * 4, 1), (-6, [], 1)]
    assert coded(table(spark, rows + bad).repartition(3)) == plain_codes(rows)


def test_empty_and_too_large(spark):
    assert coded(table(spark, []).limit(0)) == [] and coded(table(spark, [(1, None, 1), (2, [1.0, 2.0, 3.0], 1)])) == []
    with pytest.raises(ValueError):
        coded(table(spark, [(1, [1e30] * 4, 1)]))


def test_trees_find_what_all_distances_do():
    rng = random.Random(1)
    for _ in range(60):
        n, d, k = rng.randint(1, 300), rng.randint(1, 4), rng.randint(1, 40)
        x = np.array([[rng.randint(-4, 4) for _ in range(d)] for _ in range(n)])
        book = np.array([[rng.randint(-4, 4) for _ in range(d)] for _ in range(k)])
        far = ((x[:, None] - book[None]) ** 2).sum(axis=2)
        for exact in (True, False):
            tree = veccodes.Tree.build(x)
            code, error = veccodes.codes_of(tree, book, exact)
            assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()
            count, total, want = np.zeros(k, int), np.zeros((k, d), int), np.zeros((k, d), int)
            veccodes.sums_of(tree, book, exact, count, total)
            np.add.at(want, code, x)
            assert (count == np.bincount(code, minlength=k)).all() and (total == want).all()


def test_subtrees_are_assigned_whole():
    """Well separated groups never reach a leaf's points."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(-5, 6, (500, 3)) + 1000 * g for g in range(8)])
    seen = {"whole": 0, "single": 0}
    veccodes.Tree.build(x).nearest(
        np.array([[1000 * g] * 3 for g in range(8)]), True, lambda nodes, a, z, e: seen.__setitem__("whole", seen["whole"] + int((z - a).sum())), lambda at, e: seen.__setitem__("single", seen["single"] + len(at))
    )
    assert seen["whole"] > 3900 and seen["whole"] + seen["single"] == len(x)
