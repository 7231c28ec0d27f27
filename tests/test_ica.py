"""Independent components from sums over partitions: planted sources, steps, repair."""

import numpy as np
import pytest

from tidewave.operators import ica

SHAPE = "signal_id long, seq long, x array<double>"


def planted(seed, n=6000):
    """Peaked, flat and spiky sources, mixed into four channels."""
    rng = np.random.default_rng(seed)
    s = np.stack([rng.laplace(size=n), rng.uniform(-1, 1, n), np.sign(rng.standard_normal(n)) * rng.exponential(size=n), (rng.random(n) < 0.01) * 30.0], 1)
    a = rng.standard_normal((4, 4)) + 2 * np.eye(4)
    return s, a, s @ a.T + rng.standard_normal(4) * 5


def table(spark, *signals):
    return spark.createDataFrame([(k, i, v.tolist()) for k, x in enumerate(signals) for i, v in enumerate(x)], SHAPE)


def distance(p):
    """Amari's: 0 for a scaled permutation."""
    p = np.abs(p)
    return float(((p / p.max(1, keepdims=True)).sum() + (p / p.max(0)).sum() - 2 * len(p)) / (2 * len(p) * (len(p) - 1)))


@pytest.mark.parametrize("method", ["picard", "infomax"])
def test_planted_sources(spark, method):
    parts = [planted(seed) for seed in (1, 2)]
    rows = table(spark, *(x for _, _, x in parts)).repartition(5).cache()
    model = ica.fit(rows, method)
    for k, (_, a, _) in enumerate(parts):
        assert distance(model[k].matrix @ a) < 0.08 and model[k].gradient < ica.ENOUGH
        assert model[k].steps < (40 if method == "picard" else 300)
    if method == "picard":
        again = ica.fit(rows.coalesce(1), method)
        assert all(np.allclose(again[k].matrix, model[k].matrix, atol=1e-6) for k in model)
    rows.unpersist()


def test_repair_takes_the_spikes(spark):
    s, a, x = planted(3)
    rows = table(spark, x).repartition(4)
    found = ica.repaired(rows).toPandas().sort_values("seq")
    clean = x - np.outer(s[:, 3] - s[:, 3].mean(), a[:, 3])
    assert found.seq.tolist() == list(range(len(x)))
    error = np.stack(found.x.tolist()) - clean
    assert np.sqrt((error**2).mean()) < 0.15 * np.sqrt(((x - clean) ** 2).mean())


def test_odd_signals(spark, monkeypatch):
    """A flat signal and one of a single sample have no component and stay; signals are taken in slices."""
    monkeypatch.setattr(ica, "MOST_SIGNALS", 2)
    _, _, x = planted(4, 400)
    rows = table(spark, x, np.ones((5, 4)), x[:1], -x)
    found = {(r["signal_id"], r["seq"]): r["x"] for r in ica.repaired(rows, rounds=3).collect()}
    assert len(found) == 806 and all(found[1, i] == [1.0] * 4 for i in range(5)) and np.allclose(found[2, 0], x[0])
    with pytest.raises(ValueError, match="unknown"):
        ica.fit(rows, "other")
    assert ica.repaired(rows.limit(0)).count() == 0


def test_fewer_components(spark):
    _, _, x = planted(5, 500)
    model = ica.fit(table(spark, x), components=2, rounds=2)
    assert model[0].matrix.shape == (2, 4)


@pytest.mark.parametrize("method", ["picard", "infomax"])
def test_short_signals_take_no_steps_of_the_driver(spark, monkeypatch, method):
    """Signals that a task can hold are repaired without jobs for each step, as by sums over partitions; a longer one among them goes by sums."""
    parts = [planted(seed, n)[2] for seed, n in ((6, 400), (7, 90), (8, 300), (9, 1500))]
    rows = table(spark, *parts, np.ones((5, 4)), parts[0][:1]).repartition(3).cache()
    order = lambda df: np.stack(df.toPandas().sort_values(["signal_id", "seq"])["x"])
    monkeypatch.setattr(ica, "WHOLE", 0)
    by_sums = order(ica.repaired(rows, method, rounds=8))
    monkeypatch.setattr(ica, "WHOLE", 500)
    assert np.allclose(order(ica.repaired(rows, method, rounds=8)), by_sums, atol=1e-6)
    monkeypatch.setattr(ica, "WHOLE", 2000)
    monkeypatch.setattr(ica, "fit", None)
    assert np.allclose(order(ica.repaired(rows, method, rounds=8)), by_sums, atol=1e-6)
    rows.unpersist()
