"""Quantiles by selection against numpy, and the temperature against a fine search."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import decisions, policy, selection

LEVELS = {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.731, "e": 0.99, "f": 1.0}


@pytest.mark.parametrize("cells, few", [(1024, 4096), (16, 40)])
def test_quantiles_equal_numpy(spark, monkeypatch, cells, few):
    monkeypatch.setattr(selection, "CELLS", cells)
    monkeypatch.setattr(selection, "SORTED", few)
    rng = np.random.default_rng(4)
    groups = {"n": rng.normal(size=500), "ties": rng.integers(0, 4, 300).astype(float), "one": np.array([3.5]), "wide": np.exp(rng.normal(size=200) * 30), "huge": np.array([-1.7e308, 1.7e308, 0.0, 1.0, 2.0] * 9), "same": np.full(50, 2.0)}
    if cells == 16:  # several rounds
        groups = {g: groups[g] for g in ("n", "ties", "wide")}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("n", None), ("none", None), ("n", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(4)
    got = {r.g: r for r in selection.quantiles(df, ["g"], "x", LEVELS).collect()}
    assert set(got) == {*groups, "none"} and all(got["none"][n] is None for n in LEVELS)
    for g, v in groups.items():
        if g == "huge":
            v = v / 1e10  # numpy's own interpolation would overflow
        for n, q in LEVELS.items():
            want = np.quantile(v, q)
            mine = got[g][n] / 1e10 if g == "huge" else got[g][n]
            assert mine == pytest.approx(want, rel=1e-9, abs=1e-12), (g, n)
    if cells == 16:
        return
    whole = selection.quantiles(df.filter("x is not null and not isnan(x) and g <> 'huge'"), [], "x", LEVELS).first()
    every = np.concatenate([v for g, v in groups.items() if g != "huge"])
    assert all(whole[n] == pytest.approx(np.quantile(every, q), rel=1e-9) for n, q in LEVELS.items())
    held = policy.winsorised(df.filter("g = 'n' and not isnan(x)"), "x", 0.1)
    lo, hi = np.quantile(groups["n"], [0.1, 0.9])
    assert sorted(r.x for r in held.filter("x is not null").collect()) == pytest.approx(sorted(np.clip(groups["n"], lo, hi)))


def test_temperature(spark, tmp_path):
    rng = random.Random(2)
    for true, n in ((0.4, 400), (3.0, 400)):
        rows = []
        for _ in range(n):
            z = rng.gauss(0, 2)
            rows.append((z, int(rng.random() < 1 / (1 + math.exp(-z / true)))))
        loss = lambda t: sum(math.log1p(math.exp(-abs(z / t))) + max(0.0, -z * (2 * y - 1) / t) for z, y in rows) / n
        got = decisions.fitted_temperature(spark.createDataFrame(rows, "z double, y int").coalesce(1)).first()
        assert got.nll == pytest.approx(loss(got.temperature)) and all(loss(got.temperature) <= loss(got.temperature * f) + 1e-12 for f in (0.999, 1.001, 0.5, 2.0))
    certain = spark.createDataFrame([(1.0, 1), (-2.0, 0)], "z double, y int")
    assert decisions.fitted_temperature(certain.coalesce(1), rounds=30).first().temperature < 0.05
    wrong = spark.createDataFrame([(1.0, 0), (-2.0, 1)], "z double, y int")
    assert decisions.fitted_temperature(wrong.coalesce(1)).first().temperature == pytest.approx(100.0)
    assert decisions.fitted_temperature(certain.filter("z > 5")).first().temperature is None
    rows = spark.createDataFrame([("A", 1.5), ("B", None)], "symbol string, final_equity double").orderBy("symbol")
    decisions.write_report(rows, str(tmp_path / "report"))
    assert (tmp_path / "report.csv").read_text() == "symbol,final_equity\nA,1.5\nB,\n" and (tmp_path / "report.md").read_text().startswith("| symbol | final_equity |\n| --- | --- |\n| A | 1.5 |")
    assert '"final_equity": null' in (tmp_path / "report.json").read_text()
