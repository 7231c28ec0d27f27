"""Consensus of channels, coherence over epochs, continuous wavelets."""

import numpy as np
import pytest

from tidewave.functions import kernels
from tidewave.operators import phase, ransac, wavelets

SHAPE = "signal_id long, channel string, seq long, value double"
FS = 256.0


def sphere(n):
    k = np.arange(n) + 0.5
    up, around = np.arccos(1 - 1.4 * k / n), np.pi * (1 + 5**0.5) * k
    return np.stack([np.cos(around) * np.sin(up), np.sin(around) * np.sin(up), np.cos(up)], 1)


def test_bad_channels_are_found(spark):
    """Sources vary smoothly over the head; two channels of noise and a flat one don't fit, whatever the partitioning."""
    rng = np.random.default_rng(5)
    at = sphere(20)
    places = {f"c{i:02d}": tuple(map(float, p)) for i, p in enumerate(at)}
    sources = sphere(3)
    mixing = np.exp(-((at[:, None] - sources[None]) ** 2).sum(2))
    n = 640
    x = rng.standard_normal((n, 3)) @ mixing.T + 0.02 * rng.standard_normal((n, 20))
    x[:, 4], x[:, 11], x[:, 15] = rng.standard_normal(n), rng.standard_normal(n) * 3, 1.0
    rows = [(s, c, i, float(x[i, k] + s)) for s in (1, 2) for k, c in enumerate(sorted(places)) for i in range(n)]
    rows.append((3, "c01", 0, 1.0))
    samples = spark.createDataFrame(rows, SHAPE)
    how = ransac.Consensus(window=128, subsets=30)
    found = ransac.bad_channels(samples.repartition(7), places, how).collect()
    assert {(r["signal_id"], r["channel"]) for r in found if r["bad"]} == {(s, c) for s in (1, 2) for c in ("c04", "c11", "c15")}
    assert len(found) == 40 and {r["windows"] for r in found} == {5}
    assert sorted(map(tuple, found)) == sorted(map(tuple, ransac.bad_channels(samples.coalesce(1), places, how).collect()))
    out = ransac.referenced(samples, places, how)
    good = [k for k in range(20) if k not in (4, 11, 15)]
    expected = {(s, c, i): x[i, k] - x[i, good].mean() for s in (1, 2) for k, c in enumerate(sorted(places)) for i in range(n)} | {(3, "c01", 0): 0.0}
    got = {(r["signal_id"], r["channel"], r["seq"]): r["value"] for r in out.collect()}
    assert got.keys() == expected.keys() and all(np.isclose(got[k], v) for k, v in expected.items())


@pytest.mark.parametrize("kernel", [lambda x: kernels.morlet(x, FS, np.array([16.0, 32.0])), lambda x: np.stack([kernels.morlet(x * t, FS, np.array([16.0, 32.0])) for t in (np.ones(len(x)), np.hanning(len(x)))])])
def test_coherence(spark, kernel):
    """Epochs of one phase are coherent at their frequency, of random phase not; equal to a loop over all epochs."""
    rng = np.random.default_rng(6)
    epochs = []
    for i in range(40):
        n = 128 if i % 5 else 100
        t = np.arange(n) / FS
        epochs.append(("locked", i, np.sin(2 * np.pi * 32 * t) + 0.2 * rng.standard_normal(n)))
        epochs.append(("free", i, np.sin(2 * np.pi * 32 * t + rng.uniform(0, 6.28)) + 0.2 * rng.standard_normal(n)))
    framed = spark.createDataFrame([(k, i, x.tolist()) for k, i, x in epochs], "kind string, epoch long, x array<double>").repartition(4)
    expected = {}
    for k, _, x in epochs:
        z = np.asarray(kernel(x))
        z = z if z.ndim == 3 else z[None]
        for f in range(2):
            for p in range(len(x)):
                expected.setdefault((k, f, p), []).append(z[:, f, p])
    found = {(r["kind"], r["item"], r["place"]): r for r in phase.averaged(framed, kernel, ["kind"]).collect()}
    assert found.keys() == expected.keys()
    for key, zs in expected.items():
        z = np.array(zs)
        assert found[key]["n"] == len(z) and np.isclose(found[key]["avg_power"], (np.abs(z) ** 2).mean()) and np.isclose(found[key]["itc"], np.abs((z / np.abs(z)).mean(0)).mean())
    assert found["locked", 1, 60]["itc"] > 0.9 and found["free", 1, 60]["itc"] < 0.5
    each = phase.coefficients(framed, kernel, ["kind", "epoch"]).where("kind = 'free' and epoch = 3").collect()
    z = np.asarray(kernel(next(x for k, i, x in epochs if (k, i) == ("free", 3))))
    z, power = (z.mean(0), (np.abs(z) ** 2).mean(0)) if z.ndim == 3 else (z, np.abs(z) ** 2)
    assert len(each) == z.size and all(np.allclose([r["re"], r["im"], r["power"], r["phase"]], [v.real, v.imag, power[r["item"], r["place"]], np.angle(v)]) for r in each for v in [z[r["item"], r["place"]]])


@pytest.mark.parametrize("name", ["morl", "cmor1.5-1.0", *(f"gaus{n}" for n in range(1, 9))])
def test_wavelets(name):
    """Real wavelets but the first have unit energy and none has a mean; a sine answers most at its scale."""
    psi, reach = wavelets.wavelet(name)
    t = np.linspace(-reach, reach, 200_001)
    assert abs(np.trapezoid(psi(t), t)) < 1e-3
    if name.startswith("gaus"):
        assert np.isclose(np.trapezoid(psi(t) ** 2, t), 1)
    scales = np.geomspace(2, 40, 30)
    wanted = wavelets.frequency(name, scales[15], FS)
    x = np.sin(2 * np.pi * wanted * np.arange(4000) / FS)
    energy = [np.mean(np.abs(y[1000:3000]) ** 2) / a for a, y in zip(scales, wavelets.transform(x, name, scales))]
    assert abs(int(np.argmax(energy)) - 15) <= 1


@pytest.mark.parametrize("size", [37, 16_384])
def test_wavelets_in_blocks(spark, size):
    rng = np.random.default_rng(7)
    x = {"a": rng.standard_normal(301), "b": rng.standard_normal(1), "c": rng.standard_normal(37)}
    samples = spark.createDataFrame([(1, k, i, float(v)) for k, own in x.items() for i, v in enumerate(own)], SHAPE).repartition(5)
    for name in ("gaus2", "cmor1.5-1.0"):
        rows = wavelets.coefficients(samples, name, [1.0, 3.5], size).collect()
        found = {(r["channel"], r["scale"], r["seq"]): complex(r["re"], r["im"]) for r in rows}
        power = {(r["channel"], r["scale"]): r["energy"] for r in wavelets.energy(samples, name, [1.0, 3.5], size).collect()}
        assert len(rows) == len(found) == 2 * 339
        for k, own in x.items():
            for a in (1.0, 3.5):
                h = np.conj(wavelets.taps(name, a))
                y = np.convolve(own, h[::-1])[len(h) // 2 : len(h) // 2 + len(own)]
                assert np.allclose([found[k, a, i] for i in range(len(own))], y) and np.isclose(power[k, a], (np.abs(y) ** 2).sum())
    with pytest.raises(ValueError, match="unknown"):
        wavelets.wavelet("gaus9")


def test_eigenvalues_of_correlations(spark):
    from tidewave.plans import catalog
    from tidewave.sources import tables

    sf = "/root/testdata/sf0.001"
    found = catalog.QUERIES["conn_corr_eigen"](spark, sf).toPandas()
    for signal, own in tables.wide(spark, sf).toPandas().groupby("signal_id"):
        x = own[list(tables.CHANNELS)].to_numpy(float)
        values = np.sort(np.linalg.eigvalsh(np.corrcoef(x.T)))[::-1]
        assert np.allclose(found[found.signal_id == signal].sort_values("item").value, values, atol=1e-6)
    assert np.allclose(kernels.correlation_eigenvalues(np.array([[4.0, 0.0], [0.0, 0.0]])), [1, 1])
