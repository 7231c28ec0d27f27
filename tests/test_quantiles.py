"""Exact quantiles by counting, against sorting."""

import numpy as np
import pytest

from tidewave.functions import quantiles

AT = {"q25": 0.25, "q75": 0.75, "low": 0.0, "high": 1.0, "mid": 0.5}


@pytest.mark.parametrize("slices,few", [(1024, 4096), (8, 5), (2, 1)])
def test_quantiles(spark, monkeypatch, slices, few):
    monkeypatch.setattr(quantiles, "SLICES", slices)
    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(1)
    groups = {
        "normal": rng.standard_normal(700), "ties": rng.integers(0, 3, 400).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 2.0]), "same": np.full(50, -3.5),
        "wide": np.concatenate([rng.standard_normal(60) * 1e-300, [1e308, -1e308]]), "tiny": np.array([0.0, 5e-324, 1e-323, 1.5e-323] * 5), "skewed": rng.lognormal(0, 4, 300),
    }
    rows = [(k, float(v)) for k, x in groups.items() for v in x] + [("normal", None), ("normal", float("nan")), ("none", None)]
    found = quantiles.quantiles(spark.createDataFrame(rows, "k string, value double").repartition(4), ["k"], AT).collect()
    assert {r["k"] for r in found} == set(groups)
    for r in found:
        x = np.sort(groups[r["k"]])
        for name, q in AT.items():
            spot = q * (len(x) - 1)
            a, b = x[int(np.floor(spot))], x[int(np.ceil(spot))]
            with np.errstate(over="ignore"):
                assert r[name] == a + (b - a) * (spot - np.floor(spot)), (r["k"], name)


def test_nothing(spark):
    assert quantiles.quantiles(spark.createDataFrame([], "k string, value double"), ["k"], AT).count() == 0
