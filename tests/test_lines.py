"""The harmonic F test: its tapers and level, planted lines, clean signals."""

import numpy as np
import pytest

from tidewave.functions import kernels
from tidewave.operators import lines

SHAPE = "signal_id long, channel string, seq long, value double"
FS = 256.0


def test_tapers():
    for n in (64, 300):
        assert np.allclose(np.abs(np.sum(lines.tapers(n) * kernels.slepians(n, 4.0, 7), 1)), 1, atol=1e-6)
    assert np.allclose(lines.tapers(2560) @ lines.tapers(2560).T, np.eye(7), atol=1e-9)


def test_level():
    """Noise passes as often as the level says, or less: the level is shared by the frequencies looked at."""
    rng = np.random.default_rng(1)
    false = np.mean([lines.line(rng.standard_normal(640), FS, 50.0, 0.05).any() for _ in range(600)])
    assert false <= 0.08
    assert not any(lines.line(rng.standard_normal(640), FS, 50.0, 1e-6).any() for _ in range(200))
    assert np.isclose(lines.critical(0.05, 7), 3.885, atol=1e-3)  # F(2, 12)


def test_one_window():
    rng = np.random.default_rng(2)
    t = np.arange(2560) / FS
    wave = 0.8 * np.sin(2 * np.pi * 50.03 * t + 1) + 0.4 * np.cos(2 * np.pi * 100 * t)
    found = lines.line(rng.standard_normal(2560) + wave + 7, FS, 50.0)
    assert np.sqrt(np.mean((found - wave) ** 2)) < 0.08
    assert not lines.line(np.zeros(10), FS, 50.0).any() and not lines.line(np.full(500, 3.0), FS, 50.0).any()


@pytest.mark.parametrize("seconds", [10.0, 2.0])
def test_planted_and_clean(spark, seconds):
    rng = np.random.default_rng(4)
    n = 256 * 33 + 17
    t = np.arange(n) / FS
    noise = {k: rng.standard_normal(n) for k in "abc"}
    clean_b = noise["b"] + np.sin(2 * np.pi * 10 * t) * 3  # another rhythm is no line
    rows = {"a": noise["a"] + 1.5 * np.sin(2 * np.pi * 50 * t + 0.3), "b": clean_b, "c": noise["c"][:40]}
    samples = spark.createDataFrame([(1, k, i, float(v)) for k, x in rows.items() for i, v in enumerate(x)], SHAPE).repartition(6)
    found = lines.removed(samples, FS, 50.0, level=1e-4, seconds=seconds).toPandas().sort_values("seq")
    own = {k: found[found.channel == k] for k in rows}
    assert all(len(own[k]) == len(x) for k, x in rows.items())
    assert (own["b"].value.to_numpy() == rows["b"]).all() and (own["c"].value.to_numpy() == rows["c"]).all() and (own["b"].line == 0).all()
    left = own["a"].value.to_numpy() - noise["a"]
    assert np.sqrt(np.mean(left**2)) < (0.1 if seconds == 10 else 0.25)
    spectrum = np.abs(np.fft.rfft(own["a"].value.to_numpy()[: 256 * 30])) ** 2
    assert spectrum[50 * 30] < 20 * np.median(spectrum)


def test_lines_of_the_detrended_signal(spark):
    t = np.arange(2000) / FS
    x = 40 * t + np.sin(2 * np.pi * 50 * t)
    rows = lambda v: spark.createDataFrame([(1, "a", i, float(y)) for i, y in enumerate(v)], SHAPE)
    found = lines.removed(rows(x), FS, 50.0, fitted=rows(x - 40 * t)).toPandas().sort_values("seq")
    assert np.abs(found.value - 40 * t).max() < 0.1
