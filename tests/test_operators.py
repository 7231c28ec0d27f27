"""Kernels on known signals, online forms against batch, models on separable classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.functions import kernels
from tidewave.operators import models, signals
from tidewave.plans import catalog
from tidewave.sources import tables, xdf
from tidewave.streaming import online

FS = 256.0
T = np.arange(4 * 256) / FS
SINE = np.sin(2 * np.pi * 10 * T)


def test_spectra():
    f, p = kernels.welch(SINE, FS, 256)
    assert f[p.argmax()] == 10
    f, p = kernels.multitaper(SINE, FS)
    assert abs(f[p.argmax()] - 10) <= 1
    power = (np.abs(kernels.morlet(SINE, FS, np.array([5.0, 10.0, 20.0]))) ** 2).mean(1)
    assert power.argmax() == 1
    assert np.allclose(kernels.slepians(64, 2.0, 3) @ kernels.slepians(64, 2.0, 3).T, np.eye(3))


def test_phase_locking():
    other = np.sin(2 * np.pi * 10 * T + np.pi / 3)
    assert np.abs(np.exp(1j * (kernels.phase(SINE) - kernels.phase(other))).mean()) == pytest.approx(1)


def test_filters():
    impulse = np.zeros(200)
    impulse[50] = 1
    taps = kernels.windowed_sinc(FS, (8.0, 30.0), 41)
    assert np.allclose(kernels.fir(impulse, taps)[50:91], taps)
    assert kernels.fir(impulse, taps, "zero_shift").argmax() == 50
    gain = lambda h, f: abs(np.exp(-2j * np.pi * f / FS * np.arange(len(h))) @ h)
    assert gain(taps, 20) > 0.9 > 0.1 > gain(taps, 80)
    low, high = kernels.windowed_sinc(FS, (20.0,), 101), kernels.windowed_sinc(FS, (20.0,), 101, stop=True)
    assert gain(low, 1) > 0.99 and gain(low, 60) < 0.01 and gain(high, 1) < 0.01 and gain(high, 60) > 0.99
    assert np.abs(kernels.notch(SINE, FS, 10.0)).max() < 1e-6
    assert np.abs(kernels.detrend_local(np.arange(50.0), 10, 3)).max() < 1e-9
    assert len(kernels.resample(SINE, 1, 2)) == 512


def test_entropies():
    noise = np.random.default_rng(1).standard_normal(300)
    assert kernels.sample_entropy(noise) > kernels.sample_entropy(SINE[:300])
    assert kernels.approximate_entropy(noise) > kernels.approximate_entropy(SINE[:300])
    assert kernels.svd_entropy(noise) > kernels.svd_entropy(SINE[:300])


def test_spatial_filters():
    c1, c2 = np.diag([4.0, 1, 1, 1]), np.diag([1.0, 1, 1, 4])
    w = kernels.csp(c1, c2)
    share = (w @ c1 * w).sum(1)
    assert np.allclose((w @ (c1 + c2) @ w.T), np.eye(4)) and share[0] == share.max() and share[-1] == share.min()


def test_label_errors():
    with pytest.raises(ValueError, match="unknown"):
        signals.select_labels(None, ["nope"], tables.CHANNELS)
    with pytest.raises(ValueError, match="forwards"):
        signals.label_range(tables.CHANNELS, "l_tax", "l_quantity")
    with pytest.raises(ValueError, match="move"):
        signals.windows(None, 1.0, 0.0000001)


def test_fir_online_is_a_prefix_of_batch(spark, sf):
    batch = {}
    rows = tables.table(spark, sf, "events").orderBy("event_id").collect()
    for r in rows:
        batch.setdefault((r["user_id"], r["event_type"]), []).append(r["value"])
    found = online.drained(online.fir(online.stream(spark, f"{sf}/events.parquet*"), [0.5, 0.25, 0.25], block=4), "test")
    got = {}
    for r in found.orderBy("seq").collect():
        got.setdefault((r["signal_id"], r["channel"]), []).append(r["value"])
    for key, values in batch.items():
        whole = len(values) // 4 * 4
        assert np.allclose(got.get(key, []), kernels.fir(np.array(values), np.array([0.5, 0.25, 0.25]))[:whole])


def test_xdf_fills_times():
    x = np.arange(6.0).reshape(3, 2)
    found = next(xdf.decode(xdf.encode("s", "EEG", 10.0, ["a", "b"], np.array([1.0, 1.1, 1.2]), x, "float32")))
    assert found["value"].tolist() == list(range(6)) and found["ts"].tolist() == [1.0, 1.0, 1.1, 1.1, 1.2, 1.2]
    with pytest.raises(ValueError, match="not an XDF"):
        next(xdf.decode(b"abcdef"))


def test_classifiers(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], (rng.standard_normal(4) + 3 * (i % 2)).tolist()) for i in range(120)]
    f = spark.createDataFrame(rows, "row_id long, class string, x array<double>")
    for found in (models.predict(models.fit("logreg", f), f), models.Discriminant.fit(f).predict(f)):
        assert models.metrics(found).first()["accuracy"] > 0.95


def test_online_forms_take_files_in_any_order(spark, sf, tmp_path):
    events = tables.table(spark, sf, "events")
    events.repartition(5, "event_id").write.parquet(f"{tmp_path}/events.parquet")
    s = events.select(F.col("user_id").alias("signal_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value")
    plain = lambda df: sorted((str(tuple(v if not isinstance(v, float) else round(v, 9) for v in r)) for r in df.select(sorted(df.columns)).collect()))
    for name, batch in (("window_online", online.tumbling(s, "2 days")), ("session_online", online.sessions(s, "6 hours"))):
        found = catalog.QUERIES[name](spark, str(tmp_path))
        assert plain(found) == plain(batch)
        assert found.agg(F.sum("n")).first()[0] == events.count()
    assert plain(catalog.QUERIES["segment_online"](spark, str(tmp_path))) == plain(catalog.QUERIES["segment_online"](spark, sf))
    # signals whose span is longer than any watermark that was fitted to the data
    far = events.withColumn("ts", F.when(F.col("event_id") % 2 == 0, F.expr("ts + interval 400 days")).otherwise(F.col("ts")))
    far.repartition(5, F.col("event_id") % 2).write.parquet(f"{tmp_path}/far/events.parquet")
    m = far.where("event_type = 'purchase'").select(F.col("user_id").alias("u"), F.col("ts").alias("marker_ts"))
    near = F.expr("ts >= marker_ts - interval 6 hours and ts < marker_ts + interval 6 hours")
    expected = far.join(m, (F.col("user_id") == F.col("u")) & near).count()
    assert catalog.QUERIES["segment_online"](spark, f"{tmp_path}/far").count() == expected


def test_bands_hold_their_frequencies(spark, sf):
    for n in (1024, 256, 100):  # a short signal is filled up
        bands = catalog.band_power(SINE[:n])
        assert bands.argmax() == 2 and bands[2] > 0.9 * bands.sum()
    assert len(kernels.welch(SINE[:100], FS)[1]) == 129
    noise = np.random.default_rng(1).standard_normal(100)
    assert (catalog.band_power(noise) > 0).all()
    rows = catalog.QUERIES["psd_welch"](spark, sf).groupBy("signal_id", "channel").count().select("count").distinct().collect()
    assert [r[0] for r in rows] == [129]


def test_whole_tables_are_counted_and_written(spark, sf):
    lines, events = tables.table(spark, sf, "lineitem").count(), tables.table(spark, sf, "events")
    assert catalog.QUERIES["class_count_all"](spark, sf).agg(F.sum("n")).first()[0] == lines
    found = catalog.QUERIES["xdf_roundtrip_all"](spark, sf)
    assert found.count() == events.count()
    assert found.select("channel").distinct().count() == events.select("event_type").distinct().count() > 1


def test_filters_in_blocks_equal_the_whole(spark, sf, monkeypatch):
    monkeypatch.setattr(catalog, "_BLOCK", 6)
    monkeypatch.setattr(catalog, "_WINDOW", 4)
    whole = {}
    for r in tables.samples(spark, sf).orderBy("seq").collect():
        whole.setdefault((r["signal_id"], r["channel"]), []).append(r["value"])
    assert max(map(len, whole.values())) > 6
    kernel = {"fir_zero": lambda x: kernels.fir(x, catalog._BAND, "zero"), "detrend_highpass": lambda x: kernels.fir(x, catalog._HIGH, "zero_shift"), "detrend_local": lambda x: kernels.detrend_local(x, 8, 2)}
    for name, f in kernel.items():
        found = {(r["signal_id"], r["channel"], r["seq"]): r["value"] for r in catalog.QUERIES[name](spark, sf).collect()}
        expected = {(*key, i): v for key, x in whole.items() for i, v in enumerate(f(np.array(x)))}
        assert found.keys() == expected.keys()
        assert np.allclose([found[k] for k in expected], list(expected.values()))
    entropies = catalog.QUERIES["ent_sample"](spark, sf)
    assert entropies.count() == sum(-(-len(x) // 4) for x in whole.values())


def test_fbcsp_selects_on_bounded_trials(spark, monkeypatch):
    monkeypatch.setattr(models, "MOST_TRIALS", 30)
    seen = []
    score = models._mutual_information
    monkeypatch.setattr(models, "_mutual_information", lambda x, label: seen.append(len(x)) or score(x, label))
    rng = np.random.default_rng(6)
    rows = [(i, "ab"[i % 2], 0, s, (rng.standard_normal(4) * (1 + 2 * (i % 2 == np.arange(4) % 2))).tolist()) for i in range(60) for s in range(10)]
    trials = spark.createDataFrame(rows, "trial_id long, class string, band int, seq long, x array<double>")
    model = models.FBCSP.fit(trials)
    assert set(seen) == {30} and model.transform(trials).count() == 60
