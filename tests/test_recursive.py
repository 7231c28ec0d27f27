"""Recursive filters: designs, and blocks against the plain recurrence."""

import numpy as np
import pytest

from tidewave.operators import recursive

SHAPE = "signal_id long, channel string, seq long, value double"


def gain(sections, fs, f):
    z = np.exp(2j * np.pi * f / fs)
    return abs(np.prod([(b0 + b1 / z + b2 / z**2) / (1 + a1 / z + a2 / z**2) for b0, b1, b2, a1, a2 in sections]))


def test_designs():
    fs, half = 256.0, 1 / np.sqrt(2)
    for kind, cut, passed, stopped in (("low", [30], 0, 128), ("high", [5], 128, 0), ("band", [8, 30], np.sqrt(np.tan(np.pi * 8 / fs) * np.tan(np.pi * 30 / fs)), 0), ("stop", [48, 52], 0, None)):
        s = recursive.butterworth(fs, cut, kind)
        assert len(s) == (2 if kind in ("low", "high") else 4)
        assert all(np.isclose(gain(s, fs, f), half) for f in cut)
        middle = np.arctan(passed) * fs / np.pi if kind == "band" else passed
        assert np.isclose(gain(s, fs, middle), 1)
        if stopped is not None:
            assert gain(s, fs, stopped) < 1e-9
        assert all(abs(r) < 1 for *_, a1, a2 in s for r in np.roots([1, a1, a2]))
    n = recursive.notch(fs, 50.0, 25.0)
    assert gain(n, fs, 50) < 1e-9 and np.isclose(gain(n, fs, 0), 1) and abs(gain(n, fs, 49) - half) < 0.02
    with pytest.raises(ValueError, match="even"):
        recursive.butterworth(fs, [30], "low", 3)


def test_matrix_products_equal_the_recurrence():
    rng = np.random.default_rng(2)
    s = recursive.butterworth(256.0, [48, 52], "stop")
    for n in (0, 1, 63, 64, 65, 1000):
        x, start = rng.standard_normal(n), rng.standard_normal(8)
        y, end = recursive.System(s).apply(x, start)
        expected, last = recursive.run(s, x, start)
        assert np.allclose(y, expected) and np.allclose(end, last)


@pytest.mark.parametrize("size,fan", [(16_384, 1024), (7, 3), (64, 2)])
def test_blocks_equal_the_recurrence(spark, size, fan):
    rng = np.random.default_rng(3)
    s = recursive.butterworth(256.0, [4, 40], "band", 2) + recursive.notch(256.0, 50.0)
    x = {(i, c): rng.standard_normal(n) + 5 for (i, c), n in {(1, "a"): 500, (1, "b"): 1, (2, "a"): 63, (2, "c"): 128}.items()}
    samples = spark.createDataFrame([(*k, i, float(v)) for k, own in x.items() for i, v in enumerate(own)], SHAPE).repartition(5)
    rest = np.zeros(2 * len(s))
    once = {k: recursive.run(s, v, rest)[0] for k, v in x.items()}
    twice = {k: recursive.run(s, v[::-1], rest)[0][::-1] for k, v in once.items()}
    for made, expected in ((recursive.forward, once), (recursive.both_ways, twice)):
        found = made(samples, s, size, fan).toPandas()
        assert len(found) == sum(map(len, x.values()))
        for (i, c), y in expected.items():
            own = found[(found.signal_id == i) & (found.channel == c)].sort_values("seq")
            assert own.seq.tolist() == list(range(len(y))) and np.allclose(own.value, y)


def test_nothing(spark):
    assert recursive.forward(spark.createDataFrame([], SHAPE), recursive.notch(256.0, 50.0)).count() == 0


def test_inputs_together_equal_each_by_itself():
    rng = np.random.default_rng(5)
    s = recursive.butterworth(256.0, [48, 52], "stop")
    xs = [rng.standard_normal(n) for n in (3, 0, 63, 1, 20, 63)]
    for y, x in zip(recursive.together(s, xs), xs):
        assert y.tolist() == recursive.run(s, x, np.zeros(8))[0].tolist()
    assert recursive.together(s, []) == []


def test_channels_of_one_block_are_no_groups(spark, monkeypatch):
    """Channels shorter than a block go through in batches: no scan, no group in Python for each."""
    samples = spark.createDataFrame([(i, "a", k, float(k + i)) for i in range(30) for k in range(1 + 4 * i)], SHAPE).repartition(4)
    monkeypatch.setattr(recursive, "_scan", None)
    s = recursive.butterworth(256.0, [4, 40], "band", 2)
    for made, ways in ((recursive.forward, 1), (recursive.both_ways, 2)):
        found = made(samples, s)
        assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
        found = found.toPandas()
        for i, own in found.groupby("signal_id"):
            y = np.arange(1 + 4 * i) + float(i)
            for _ in range(ways):
                y = recursive.run(s, y, np.zeros(4))[0][::-1]
            assert np.allclose(own.sort_values("seq").value, y if ways == 2 else y[::-1])
        assert len(found) == samples.count()
