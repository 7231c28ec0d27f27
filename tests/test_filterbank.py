"""The filter bank against whole-trial convolutions, and common spatial patterns on its bands."""

import numpy as np
import pytest

from tidewave.operators import filterbank, models
from tidewave.plans import banks, catalog

SHAPE = "trial_id long, class string, seq long, x array<double>"


def trial(rng, n, channels=4):
    return rng.standard_normal((n, channels)) * 3 + 1


@pytest.fixture(scope="module")
def some(spark):
    rng = np.random.default_rng(3)
    x = {i: trial(rng, n) for i, n in enumerate((1, 2, 9, 40, 41, 333))}
    rows = [(i, "ab"[i % 2], s, v.tolist()) for i, t in x.items() for s, v in enumerate(t)]
    return x, spark.createDataFrame(rows, SHAPE).repartition(5)


def whole(x, bank):
    """(bands, samples, channels) by plain convolution."""
    return np.stack([np.stack([np.convolve(c, h)[bank.reach : bank.reach + len(x)] for c in x.T], 1) for h in bank.taps()])


@pytest.mark.parametrize("size", [16, 8192])
def test_blocks_equal_whole_trials(some, size):
    x, trials = some
    bank = filterbank.Bank.spaced(128.0, length=33)
    found = filterbank.filtered(trials, bank, size).toPandas().sort_values(["trial_id", "band", "seq"])
    assert len(bank.bands) == 9 and bank.bands[0] == (4, 8) and bank.bands[-1] == (36, 40)
    for i, t in x.items():
        own = found[found.trial_id == i]
        assert np.allclose(np.stack(own.x.tolist()).reshape(9, len(t), 4), whole(t, bank)) and set(own["class"]) == {"ab"[i % 2]}
        assert own.seq.tolist() == list(range(len(t))) * 9


@pytest.mark.parametrize("size", [16, 8192])
def test_covariances(some, size):
    x, trials = some
    bank = filterbank.Bank.spaced(128.0, length=33)
    found = {(r["trial_id"], r["band"]): r["cov"] for r in filterbank.covariances(trials, bank, size).collect()}
    assert {i for i, _ in found} == {1, 2, 3, 4, 5}  # one sample has no covariance
    for (i, band), cov in found.items():
        assert np.allclose(np.reshape(cov, (4, 4)), np.cov(whole(x[i], bank)[band].T))
    raw = filterbank.raw_covariances(filterbank.filtered(trials, bank, size))
    assert {(r["trial_id"], r["band"]) for r in raw.collect()} == set(found)
    assert all(np.allclose(r["cov"], found[r["trial_id"], r["band"]]) for r in raw.collect())


def test_planted_band(spark):
    """A rhythm of 22 Hz whose place on the channels differs between the classes tells them apart, in its own band."""
    rng = np.random.default_rng(4)
    rows, n = [], 400
    for i in range(60):
        t = np.arange(n) / 128
        x = rng.standard_normal((n, 4))
        x[:, i % 2] += 2 * np.sin(2 * np.pi * 22 * t + rng.uniform(0, 6))
        x = x @ np.array([[1, 0.4, 0.2, 0], [0.3, 1, 0, 0.2], [0, 0.1, 1, 0], [0.2, 0, 0, 1]])
        rows += [(i, "ab"[i % 2], s, v.tolist()) for s, v in enumerate(x)]
    bank = filterbank.Bank.spaced(128.0, length=257)
    cov = filterbank.covariances(spark.createDataFrame(rows, SHAPE), bank).cache()
    model = models.FBCSP.fit_covariances(cov.where("trial_id < 40"), n_features=1)
    assert [bank.bands[b] for b, _ in model.selected] == [(20, 24), (20, 24)]
    features = model.transform_covariances(cov)
    again = models.FBCSP.from_json(model.to_json())
    assert [r["x"] for r in again.transform_covariances(cov).orderBy("row_id").collect()] == [r["x"] for r in features.orderBy("row_id").collect()]
    lda = models.Discriminant.fit(features.where("row_id < 40"))
    assert lda.predict(features.where("row_id >= 40")).where("class = prediction").count() >= 19
    cov.unpersist()


def test_responses_are_made_once_for_a_length(monkeypatch):
    made = []
    design = filterbank.kernels.windowed_sinc
    monkeypatch.setattr(filterbank.kernels, "windowed_sinc", lambda *a, **k: made.append(a) or design(*a, **k))
    bank = filterbank.Bank.spaced(127.0, length=31)
    x = np.random.default_rng(1).standard_normal((40, 3))
    for _ in range(50):
        y = np.stack(list(bank.apply(x)))
    assert np.allclose(y, whole(x, bank))
    made.clear()
    list(bank.apply(x))
    assert not made


def test_filter_bank_shuffles_line_items_twice(spark, sf):
    """Once by supplier and once by block: trials are numbered where their supplier's rows are."""
    plan = banks.filter_bank(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_rounded_in_the_tasks(spark):
    rows = [(1, "a", s, [v]) for s, v in enumerate((0.126, -0.126, 0.3749))]
    bank = filterbank.Bank(2.0, ((0.0, 1.0),), 1)  # passes what it gets
    found = filterbank.filtered(spark.createDataFrame(rows, SHAPE), bank, digits=2).orderBy("seq").collect()
    assert np.allclose([r["x"][0] for r in found], [0.13, -0.13, 0.37], atol=1e-12)


def test_sums_of_a_trial_travel_as_one_row(spark, some):
    """With the channels known the sums are columns, not rows; covariances are those of the other form."""
    x, trials = some
    bank = filterbank.Bank.spaced(128.0, length=33)
    made = filterbank.covariances(trials, bank, 16, channels=4)
    assert "Generate posexplode(p" not in made._jdf.queryExecution().toString()
    found = {(r["trial_id"], r["band"]): r["cov"] for r in made.collect()}
    other = {(r["trial_id"], r["band"]): r["cov"] for r in filterbank.covariances(trials, bank, 16).collect()}
    assert found.keys() == other.keys() and all(np.allclose(found[k], other[k]) for k in other)


def test_trials_of_line_items_are_read_and_sorted_once(spark, sf):
    """One scan, one sort of the two flags' rows, and covariances without rows in Python: a task holds no more than a sort."""
    cov = filterbank.raw_covariances(catalog._trials(spark, sf), 4)
    plan = cov._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Sort [") == 1 and "MapInArrow" not in plan
    found = {(r["trial_id"], r["band"]): r["cov"] for r in cov.collect()}
    other = {(r["trial_id"], r["band"]): r["cov"] for r in filterbank.raw_covariances(catalog._trials(spark, sf)).collect()}
    assert found.keys() == other.keys() and all(np.allclose(found[k], other[k]) for k in other)
