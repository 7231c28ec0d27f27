"""The natural gradient goes on until it is small, also for signals of few rows."""

import numpy as np
from pyspark.sql import functions as F

from tidewave.operators import ica
from tidewave.plans import coherence
from tidewave.sources import tables


def short(spark, sf, rows):
    """Line items as suppliers of about ``rows`` rows each."""
    lines = tables.table(spark, sf, "lineitem")
    return lines.withColumn("l_suppkey", F.pmod(F.hash("l_orderkey", "l_linenumber"), F.lit(lines.count() // rows)).cast("long"))


def signals(lines):
    found = {}
    for r in lines.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice").collect():
        found.setdefault(r["l_suppkey"], []).append([float(r[c]) for c in tables.CHANNELS])
    return {k: np.array(v) for k, v in found.items()}


def test_query_takes_all_steps(spark, sf, tmp_path):
    """What the query takes from a signal is a component of a matrix whose gradient is small; none is stopped after some steps."""
    lines = short(spark, sf, 30)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = signals(lines)
    made = {}
    for r in coherence.ica_repair_infomax(spark, str(tmp_path)).orderBy("signal_id", "seq").collect():
        made.setdefault(r["signal_id"], []).append([r[c] for c in tables.CHANNELS])
    steps = []
    for (key, x), m in zip(whole.items(), ica.fit_whole([x.copy() for x in whole.values()], "infomax", rounds=10_000)):
        y = m.sources(x)
        k = int(((y**4).mean(0) / (y**2).mean(0) ** 2).argmax())
        assert m.gradient < ica.ENOUGH
        assert np.allclose((made[key] - x + np.outer(y[:, k], m.mixing()[:, k])) / x.std(0), 0, rtol=0, atol=1e-4)
        steps.append(m.steps)
    assert max(steps) > 100


def test_signals_that_turn_for_ever_end(spark, sf):
    """Of signals of six rows some turn between peaked and flat: held signs end them, in both forms alike."""
    x = [v for v in signals(short(spark, sf, 6)).values() if len(v) > 1]
    model = [m for m in ica.fit_whole([v.copy() for v in x], "infomax") if len(m.matrix)]
    assert len(model) > 500 and max(m.gradient for m in model) < ica.ENOUGH


def test_held_signs_in_both_forms(spark, sf, monkeypatch):
    monkeypatch.setattr(ica, "HELD", 4)
    x = dict(list(signals(short(spark, sf, 12)).items())[:20])
    rows = spark.createDataFrame([(k, i, v.tolist()) for k, own in x.items() for i, v in enumerate(own)], "signal_id long, seq long, x array<double>").repartition(3).cache()
    by_sums = ica.fit(rows, "infomax", rounds=9)
    held = dict(zip(x, ica.fit_whole([v.copy() for v in x.values()], "infomax", rounds=9)))
    monkeypatch.setattr(ica, "HELD", 100)
    free = dict(zip(x, ica.fit_whole([v.copy() for v in x.values()], "infomax", rounds=9)))
    assert all(np.isclose(by_sums[k].gradient, held[k].gradient, rtol=1e-5) and by_sums[k].steps == held[k].steps for k in x)
    assert any(not np.isclose(free[k].gradient, held[k].gradient, rtol=1e-5) for k in x)
    rows.unpersist()
