"""Faults that show on larger or odder tables than those at hand."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewave.operators import models
from tidewave.plans import catalog


def events(spark, path, rows):
    """A folder with a table of events (event_id, seconds, user_id, event_type, value)."""
    df = spark.createDataFrame(rows, "event_id long, s double, user_id long, event_type string, value double")
    ts = F.timestamp_micros(F.round((1704067200 + F.col("s")) * 1e6).cast("long")).cast("timestamp_ntz")
    df.select("event_id", ts.alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props")).write.parquet(f"file://{path}/events.parquet")
    return f"file://{path}"


@pytest.mark.parametrize("name", ["conn_spec_corr", "conn_corr"])
def test_constant_channels_have_no_correlation(spark, tmp_path, name):
    rows = [(i, i * 60.0, 1, c, {"a": 3.0, "b": float(i % 7), "c": float(i % 5)}[c]) for i in range(60) for c in "abc"] + [(1000, 0.0, 2, "a", 1.0), (1001, 0.0, 2, "b", 2.0)]
    found = {(r[0], r[1], r[2]): r[3] for r in catalog.QUERIES[name](spark, events(spark, tmp_path, rows)).collect()}
    assert found.pop((1, "b", "c")) is not None and set(found.values()) <= {None}


def test_dejitter_rounds_once(spark, tmp_path):
    """A time just below half a second, that is half a second in whole microseconds."""
    path = events(spark, tmp_path, [(0, 0.499999, 1, "a", 0.0), (1, 1.500003, 1, "a", 0.0), (2, 86402.500003, 1, "a", 0.0)])
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')")
    expected = sorted(duck.execute(catalog.ORACLES["dejitter"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["dejitter"](spark, path).collect())) == expected and expected[0][3] == 1704067200


def test_mean_covariances_gather_no_trial(spark):
    """Means of the covariances of trials, from sums of batches: no trial is a group in Python."""
    rng = np.random.default_rng(0)
    x = {(t, b): rng.normal(size=(20 + t, 3)) + 5 for t in range(6) for b in (0, 1)}
    rows = [(t, "AR"[t % 2], b, i, v.tolist()) for (t, b), own in x.items() for i, v in enumerate(own)]
    found = models.mean_covariances(spark.createDataFrame(rows, "trial_id long, class string, band int, seq long, x array<double>").repartition(5))
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    for r in found.collect():
        expected = np.mean([np.cov(x[t, r["band"]].T).ravel() for t in range(6) if "AR"[t % 2] == r["class"]], axis=0)
        assert np.allclose(r["cov"], expected)


def test_machines_are_fitted_side_by_side(spark):
    """The classes of a one-against-rest classifier do not wait for each other; predictions are those of one after another."""
    pipeline = models.classifier("svm", max_iter=5)
    one = pipeline.getStages()[1]
    assert one.getParallelism() == models.MACHINES > 1
    rng = np.random.default_rng(2)
    rows = [(i, str(i % 3), (rng.normal(size=4) + 3 * (np.arange(4) == i % 3)).tolist()) for i in range(90)]
    f = models._prepared(spark.createDataFrame(rows, "row_id long, class string, x array<double>").repartition(2)).cache()
    found = [[r["prediction"] for r in p.fit(f).transform(f).orderBy("row_id").collect()] for p in (pipeline, models.Pipeline(stages=[pipeline.getStages()[0], one.copy({one.parallelism: 1})]))]
    f.unpersist()
    assert found[0] == found[1]
