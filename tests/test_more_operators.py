"""Validators, metrics, filters in blocks and XDF files against plain numpy."""

import numpy as np
import pandas as pd
import pytest

from tidewave.functions import kernels
from tidewave.operators import signals, validation
from tidewave.sources import tables, xdf


def channel(spark, x):
    rows = pd.DataFrame({"signal_id": 1, "seq": np.arange(len(x)), "channel": "a", "value": x})
    return spark.createDataFrame(rows).repartition(3)


def test_filters():
    rng = np.random.default_rng(1)
    x, h = rng.standard_normal(3000), kernels.windowed_sinc(256, (8.0, 30.0), 101)
    for phase in ("forward", "zero_shift", "zero"):
        direct = kernels.fir(x, h, phase)
        for method in ("fft", "overlap_add"):
            assert np.allclose(kernels.fir(x, h, phase, method), direct)
    low = kernels.windowed_sinc(256, (30.0,), 101)
    least = kernels.minimum_phase(low)
    assert np.allclose(np.abs(np.fft.rfft(least, 1024)), np.abs(np.fft.rfft(low, 1024)), atol=0.01)
    assert np.abs(least[:30]).sum() > np.abs(low[:30]).sum()  # the energy comes early
    gain = lambda taps, f: abs((taps * np.exp(-2j * np.pi * f / 256 * np.arange(len(taps)))).sum())
    band, stop = kernels.designed(256, (8.0, 30.0)), kernels.designed(256, (48.0, 52.0), stop=True)
    assert len(band) % 2 and gain(band, 16) > 0.95 and gain(band, 2) < 0.05 and gain(stop, 50) < 0.05 and gain(stop, 30) > 0.95
    high = kernels.designed(256, (1.0,), stop=True)
    assert gain(high, 0) < 1e-6 and gain(high, 20) > 0.99


def test_wavelets():
    assert np.allclose(kernels.daubechies(1), np.sqrt([0.5, 0.5]))
    for n in (2, 4, 10):
        h = kernels.daubechies(n)
        assert len(h) == 2 * n and np.isclose(h.sum(), np.sqrt(2)) and np.isclose((h**2).sum(), 1) and np.isclose((h[2:] * h[:-2]).sum(), 0, atol=1e-6)
        assert all(abs((np.arange(2 * n) ** k * h[::-1] * (-1) ** np.arange(2 * n)).sum()) < 1e-3 * (2 * n) ** k for k in range(min(n, 4)))
    x = np.random.default_rng(2).standard_normal(64)
    assert np.allclose(kernels.wavelet_energy(x, kernels.daubechies(1), 3), kernels.haar_energy(x))


def test_blocks_equal_the_whole(spark):
    """A channel of several blocks gives what the whole channel gives."""
    x = np.random.default_rng(3).standard_normal(1000) + np.sin(np.arange(1000) * 2 * np.pi * 50 / 256)
    s = channel(spark, x)
    found = signals.spectrum(s, 256.0, 64, 4).orderBy("bin").toPandas()
    assert np.allclose(found.power, kernels.welch(x[: len(x) // 64 * 64], 256.0, 64)[1])
    ten = signals.spectrum(channel(spark, np.sin(np.arange(2048) * 2 * np.pi * 10 / 256)), 256.0).toPandas()
    assert ten.freq[ten.power.idxmax()] == 10 and ten.power[(ten.freq >= 8) & (ten.freq < 13)].sum() > 0.95 * ten.power.sum()
    clean = signals.without_lines(s, s, 256.0, 50.0).orderBy("seq").toPandas()
    assert np.allclose(clean.value, kernels.notch(x, 256.0, 50.0), atol=1e-5)
    short = channel(spark, x[:4])
    assert np.allclose(signals.without_lines(short, short, 256.0, 50.0).orderBy("seq").toPandas().value, x[:4], atol=1e-6)
    framed = signals.frames(signals.blocks(s, 128, 101), (*signals.SIGNAL, "block"))
    h = kernels.windowed_sinc(256, (8.0, 30.0), 101)
    out = signals.core(signals.transform(framed, lambda v: kernels.fir(v, h, "zero_shift")), 128, 101).orderBy("seq").toPandas()
    assert np.allclose(out.value, kernels.fir(x, h, "zero_shift"))
    energy = signals.spread(signals.transform(signals.frames(signals.blocks(s, 128), (*signals.SIGNAL, "block")), kernels.haar_energy), seq="item").groupBy("item").sum("value").orderBy("item").toPandas()
    assert np.allclose(energy["sum(value)"], kernels.haar_energy(x))


def test_polyphase_keeps_a_slow_sine(spark):
    t = np.arange(600)
    y = signals.polyphase(channel(spark, np.sin(2 * np.pi * 5 * t / 256)), kernels.windowed_sinc(3, (0.45,), 31), 3, 2).orderBy("seq").toPandas()
    assert len(y) == 900
    middle = y.value[60:-60]
    assert np.abs(middle - np.sin(2 * np.pi * 5 * middle.index / 384)).max() < 0.02


def test_xdf_streams(spark, tmp_path):
    ts = np.arange(5000) / 100
    x = np.random.default_rng(4).standard_normal((5000, 3))
    data = xdf.encode("eeg", "EEG", 100.0, ["Fp1", "Fp2", "Cz"], ts, x, offsets=[(0.0, 1.0), (50.0, 3.0)], unit="uV")
    found = pd.concat(xdf.decode(data, lower=True))
    assert list(found.channel[:3]) == ["fp1", "fp2", "cz"] and np.array_equal(found.value.to_numpy().reshape(-1, 3), x)
    assert np.allclose(found.ts[::3], ts + 1 + ts / 25) and data.count(xdf.BOUNDARY_MARK) == 2
    marks = xdf.encode("marks", "Markers", 0.0, ["m"], np.array([1.5, 2.5]), np.array([["left é"], [""]], object), "string")
    found = pd.concat(xdf.decode(marks))
    assert list(found.text) == ["left é", ""] and list(found.ts) == [1.5, 2.5]
    with pytest.raises(ValueError):
        xdf.encode("marks", "Markers", 10.0, ["m"], np.zeros(0), np.zeros((0, 1), object), "string")
    with pytest.raises(ValueError):
        list(xdf.decode(b"nothing"))
    # time stamps that lack follow from the rate
    import struct

    head = xdf._chunk(xdf.STREAM_HEADER, struct.pack("<I", 1) + xdf._header("s", "x", 10.0, ["c"], "int16", ""))
    body = xdf._chunk(xdf.SAMPLES, struct.pack("<I", 1) + xdf._sized(2) + b"\x08" + struct.pack("<dh", 7.0, 1) + b"\x00" + struct.pack("<h", 2))
    found = pd.concat(xdf.decode(xdf.MAGIC + head + body))
    assert list(found.ts) == [7.0, 7.1] and list(found.value) == [1, 2]
    rows = [("a", 0, 0.5, "x", 1.0), ("a", 0, 0.5, "y", 2.0), ("a", 1, 0.75, "x", 3.0), ("b", 0, 1.0, "z", 4.0)]
    samples = spark.createDataFrame(rows, "stream string, seq long, ts double, channel string, value double")
    path = f"file://{tmp_path}/streams"
    assert xdf.write(samples, path, 0.0).where("size > 0").count() == 2
    assert sorted(map(tuple, xdf.read(spark, path).drop("text").collect())) == sorted(rows)
    assert sorted(map(tuple, xdf.footers(spark, path).collect())) == [("a", 0.5, 0.75, 2), ("b", 1.0, 1.0, 1)]


def test_folds(spark):
    rows = spark.range(3, 26).withColumnRenamed("id", "row_id").selectExpr("row_id", "cast(row_id % 2 as string) as class")
    folds = [r["fold"] for r in validation.k_fold(rows, 5).orderBy("row_id").collect()]
    assert folds == [0] * 5 + [1] * 5 + [2] * 5 + [3] * 4 + [4] * 4
    one, two = ({tuple(r) for r in validation.k_fold(rows, 5, s).collect()} for s in (1, 2))
    assert one != two and sorted(f for _, f in one) == sorted(folds)
    assert [r["n"] for r in validation.stratified_k_fold(rows, 3).groupBy("class", "fold").count().selectExpr("count as n").collect()].count(4) >= 5
    assert {r["fold"] for r in validation.leave_one_out(rows).collect()} == set(range(23))
    assert validation.leave_two_out(rows).count() == 253
    with pytest.raises(ValueError):
        validation.leave_two_out(rows, 100)
    split = validation.shuffle_split(rows, 4, 20).groupBy("split", "is_test").count().collect()
    assert {r["count"] for r in split if r["is_test"]} == {5} and len(split) == 8
    assert validation.k_fold(rows.limit(0), 5).count() == 0


def test_scores(spark):
    rng = np.random.default_rng(6)
    score, label = np.round(rng.random(500), 2), rng.integers(0, 2, 500)
    df = spark.createDataFrame(pd.DataFrame({"score": score, "label": label}))
    pairs = score[label == 1][:, None] - score[label == 0][None]
    assert validation.roc_auc(df).first()["auc"] == pytest.approx(((pairs > 0) + 0.5 * (pairs == 0)).mean())
    value = 0.0
    for t in np.unique(score):
        value += (label[score == t].sum() / label.sum()) * label[score >= t].mean()
    assert validation.average_precision(df).first()["value"] == pytest.approx(value)
    assert validation.roc_auc(df.where("label = 1")).first()["auc"] is None
    p = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "z")], "class string, prediction string")
    found = {(r["metric"], r["average"]): r["value"] for r in validation.averages(p).collect()}
    assert found[("accuracy", "")] == 0.5 and found[("precision", "macro")] == 0.375 and found[("recall", "weighted")] == 0.5
    assert found[("balanced_accuracy", "")] == 0.5 and found[("jaccard", "micro")] == pytest.approx(2 / 6, abs=1e-6)


def test_scratch_needs_a_shared_folder(spark):
    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "spark://far:7077"})

    with pytest.raises(ValueError):
        tables.scratch(Far, "x")
