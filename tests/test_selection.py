"""Features of common spatial patterns are selected on all trials, however many."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import densities
from tidewave.operators import models
from tidewave.plans import banks, catalog


def brute(x, label):
    """Mutual information with every two rows compared."""

    def density(points):
        h = densities.bandwidth(points.std(), len(points))
        return np.exp(-((x[:, None] - points[None]) ** 2) / (2 * h * h)).mean(1) / h

    a, b = density(x[label]) * label.mean(), density(x[~label]) * (1 - label.mean())
    entropy = lambda q: -(q * np.log(q) + (1 - q) * np.log(1 - q))
    return entropy(label.mean()) - entropy(np.clip(a / np.maximum(a + b, 1e-300), 1e-12, 1 - 1e-12)).mean()


def test_selection_comes_from_all_trials(spark):
    """Band 0 tells the classes of 2000 trials apart (those of the lowest hashes), band 1 those of 3000 others."""
    ids = [r[0] for r in spark.range(5000).orderBy(F.xxhash64("id"), "id").collect()]
    rng = np.random.default_rng(8)
    rows = []
    for k, i in enumerate(ids):
        for band, told in enumerate((k < 2000, k >= 2000)):
            wide = 4.0 if told else 1.0
            v = np.exp(rng.standard_normal(2) * 0.2) * ((wide, 1.0) if i % 2 else (1.0, wide))
            rows.append((i, "ab"[i % 2], band, np.diag(v).ravel().tolist()))
    cov = spark.createDataFrame(rows, "trial_id long, class string, band int, cov array<double>").repartition(6).cache()
    model = models.FBCSP.fit_covariances(cov, m=1, n_features=1)
    assert model.selected == [(1, 0), (1, 1)]
    assert model.transform_covariances(cov).count() == 5000
    cov.unpersist()


@pytest.mark.parametrize("parts", [1, 5])
def test_information_equals_brute_force(spark, parts):
    rng = np.random.default_rng(9)
    n = 900
    label = rng.random(n) < 0.4
    f = np.stack([rng.standard_normal(n) + label, rng.standard_cauchy(n) * 3, np.where(label, -3.7, rng.standard_normal(n)), np.full(n, 2.5), rng.integers(0, 3, n) - label * 1.0], 1)
    f[:, 0][5], f[:, 0][6], f[:, 1][7] = np.nan, -np.inf, 1e6
    rows = spark.createDataFrame([("a" if k else "b", v.tolist()) for k, v in zip(label, f)], "class string, f array<double>").repartition(parts)
    found = models.mutual_information(rows, ["a", "b"])
    own = np.isfinite(f)
    assert sorted(found) == list(range(5))
    assert np.allclose([found[j] for j in range(5)], [brute(f[own[:, j], j], label[own[:, j]]) for j in range(5)], atol=1e-10, rtol=0)


@pytest.mark.parametrize("name", ["fbcsp_bank", "fbcsp_extract", "fbcsp_json"])
def test_queries_select_on_every_trial(spark, sf, monkeypatch, name):
    """The selection's input are the trials that the query gives."""
    seen = []
    score = models.mutual_information
    monkeypatch.setattr(models, "mutual_information", lambda f, classes: seen.append({r[0] for r in f.select("trial_id").collect()}) or score(f, classes))
    found = {**banks.__dict__, **catalog.__dict__}[name](spark, sf)
    assert seen == [{r[0] for r in found.select("row_id").collect()}] and seen[0]
