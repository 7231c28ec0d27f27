"""Queries of recordings on disk, replay, containers and scalar functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions import kernels
from tidewave.operators import signals
from tidewave.plans.registry import query
from tidewave.sources import generators, live, tables, xdf
from tidewave.streaming import online

_SAMPLES = "samples AS (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seq, ts, event_type AS channel, value FROM events)"
_SECONDS = "epoch_us(ts) / 1000000.0::DOUBLE"


def _streams(spark: SparkSession, sf: str) -> DataFrame:
    """Signals as streams of all their channels; a sample of each time has one cell."""
    e = tables.table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("stream"), F.col("event_id").alias("seq"), (signals.micros("ts") / 1e6).alias("ts"), F.col("event_type").alias("channel"), "value")


@query("scan_xdf", f"SELECT CAST(user_id AS VARCHAR) AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, {_SECONDS} AS ts, event_type AS channel, value FROM events")
def scan_xdf(spark: SparkSession, sf: str) -> DataFrame:
    """Every signal written as a file of several channels, and all files read."""
    path = tables.scratch(spark, "xdf")
    xdf.write(_streams(spark, sf), path, 0.0).write.format("noop").mode("overwrite").save()
    return xdf.read(spark, path).drop("text")


@query("scan_xdf_parts", f"SELECT CAST(user_id AS VARCHAR) AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, {_SECONDS} AS ts, event_type AS channel, value FROM events")
def scan_xdf_parts(spark: SparkSession, sf: str) -> DataFrame:
    """As ``scan_xdf``, with recordings that go on in further files after 64 samples, and files read in ranges of 1 KB."""
    path = tables.scratch(spark, "xdf")
    xdf.write(_streams(spark, sf), path, 0.0, file_rows=64).write.format("noop").mode("overwrite").save()
    return xdf.read(spark, path, part_bytes=1024).drop("text")


@query("sink_xdf", "SELECT CAST(user_id AS VARCHAR) AS stream, count(*) AS samples FROM events GROUP BY user_id")
def sink_xdf(spark: SparkSession, sf: str) -> DataFrame:
    """The files written, with what a reader finds in each."""
    path = tables.scratch(spark, "xdf")
    listed = tables.scratch(spark, "xdf-list")
    xdf.write(_streams(spark, sf), path, 0.0).write.parquet(listed)
    found = xdf.read(spark, path).groupBy("stream").agg(F.count("*").alias("samples"))
    return found.join(spark.read.parquet(listed).where("size > 0").select("stream"), "stream")


@query("scan_xdf_markers", f"SELECT 'user ' || user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, {_SECONDS} AS ts, 'marker' AS channel, event_type || ' ' || props AS text FROM events")
def scan_xdf_markers(spark: SparkSession, sf: str) -> DataFrame:
    """Streams of text, labels in lower case."""
    e = tables.table(spark, sf, "events")
    rows = e.select(F.concat(F.lit("user "), "user_id").alias("stream"), F.col("event_id").alias("seq"), (signals.micros("ts") / 1e6).alias("ts"), F.lit("Marker").alias("channel"), F.concat_ws(" ", "event_type", "props").alias("text"))
    path = tables.scratch(spark, "xdf")
    xdf.write(rows, path, 0.0, "Markers").write.format("noop").mode("overwrite").save()
    return xdf.read(spark, path, lower=True).drop("value")


@query("xdf_footers", "SELECT CAST(user_id AS VARCHAR) AS stream, min(epoch_us(ts)) / 1000000.0::DOUBLE AS first_timestamp, max(epoch_us(ts)) / 1000000.0::DOUBLE AS last_timestamp, count(*) AS sample_count FROM events GROUP BY user_id")
def xdf_footers(spark: SparkSession, sf: str) -> DataFrame:
    """Read from the footers of the files."""
    path = tables.scratch(spark, "xdf")
    xdf.write(_streams(spark, sf), path, 0.0).write.format("noop").mode("overwrite").save()
    return xdf.footers(spark, path)


@query("replay_blocks", f"WITH {_SAMPLES} SELECT signal_id, channel, seq // 4 AS block, seq % 4 AS place, (seq // 4 = max(seq) OVER (PARTITION BY signal_id, channel) // 4) AS last, value FROM samples")
def replay_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """A recording in the blocks of four samples in which it is played; the last of each channel may be short."""
    s = tables.samples(spark, sf)
    ends = s.groupBy(*signals.SIGNAL).agg(F.max("seq").alias("end"))
    block = F.floor(F.col("seq") / 4)
    return s.join(ends, list(signals.SIGNAL)).select(*signals.SIGNAL, block.alias("block"), (F.col("seq") % 4).alias("place"), (block == F.floor(F.col("end") / 4)).alias("last"), "value")


@query("from_mne", f"WITH {_SAMPLES}, n AS (SELECT *, count(*) OVER (PARTITION BY signal_id, channel) AS n FROM samples) SELECT signal_id, channel, seq, CASE WHEN n > 1 THEN round(seq * (n / 256) / (n - 1), 9) ELSE 0 END AS ts, value FROM n")
def from_mne(spark: SparkSession, sf: str) -> DataFrame:
    """Time stamps evenly from 0 to the duration, both included."""
    s = tables.samples(spark, sf)
    n = s.groupBy(*signals.SIGNAL).agg(F.count("*").alias("n"))
    ts = F.when(F.col("n") > 1, F.round(F.col("seq") * (F.col("n") / 256) / (F.col("n") - 1), 9)).otherwise(0.0)
    return s.join(n, list(signals.SIGNAL)).select(*signals.SIGNAL, "seq", ts.alias("ts"), "value")


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark: SparkSession, sf: str) -> DataFrame:
    return tables.table(spark, sf, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("class_map", "WITH n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT '{' || string_agg('\"' || label || '\":' || n, ',' ORDER BY label) || '}' AS counts FROM n")
def class_map(spark: SparkSession, sf: str) -> DataFrame:
    """Classes and their sizes as one map, in JSON."""
    n = tables.table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"))  # one row a class
    entries = F.array_sort(F.collect_list(F.struct(F.col("label").cast("int").alias("label"), "n")))
    return n.agg(F.to_json(F.map_from_entries(F.transform(entries, lambda r: F.struct(r["label"].cast("string"), r["n"])))).alias("counts"))


@query("array_functions", "SELECT vec_id, list_concat(embedding[1:2], embedding[3:4]) = embedding[1:4] AS joined, len(embedding) AS size, list_position(embedding, list_max(embedding)) AS argmax, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 6) AS square FROM embeddings")
def array_functions(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("embedding")
    square = F.aggregate(F.transform(x, lambda v: v.cast("double") * v.cast("double")), F.lit(0.0), lambda a, v: a + v)
    return tables.table(spark, sf, "embeddings").select("vec_id", (F.concat(F.slice(x, 1, 2), F.slice(x, 3, 2)) == F.slice(x, 1, 4)).alias("joined"), F.size(x).cast("long").alias("size"), F.array_position(x, F.array_max(x)).cast("int").alias("argmax"), F.round(square, 6).alias("square"))


@query("gen_number", f"SELECT range AS seq, 10 + floor(({generators.uniform_sql('range', 5)}) * 40)::BIGINT AS value FROM range(1000)")
def gen_number(spark: SparkSession, sf: str) -> DataFrame:
    return generators.integers(spark, 1000, 10, 50, 5)


@query("gen_trials", f"SELECT range // 3200 AS trial_id, 'channel_' || range // 100 % 32 AS channel, range % 100 AS seq, {generators.uniform_sql('range', 9)} AS value FROM range(160000)")
def gen_trials(spark: SparkSession, sf: str) -> DataFrame:
    return generators.trials(spark, 50, 32, 100, 9)


@query("gen_iris")
def gen_iris(spark: SparkSession, sf: str) -> DataFrame:
    return generators.flowers(spark)


#: Made-up positions of the five channels on a unit sphere, and the channel taken as bad.
_PLACES = {"click": (0.0, 0.0, 1.0), "error": (0.6, 0.0, 0.8), "purchase": (-0.6, 0.0, 0.8), "signup": (0.0, 0.6, 0.8), "view": (0.0, -0.6, 0.8)}
_BAD = "click"
_GOOD = {c: float(w) for c, w in zip([c for c in _PLACES if c != _BAD], kernels.spherical_weights(np.array([p for c, p in _PLACES.items() if c != _BAD]), np.array([_PLACES[_BAD]]))[0])}


@query("interp_bads", f"WITH {_SAMPLES}, w AS (SELECT unnest({list(_GOOD)}) AS channel, unnest({list(_GOOD.values())}) AS w), m AS (SELECT signal_id, seq, sum(value * w) AS value FROM samples JOIN w USING (channel) GROUP BY ALL HAVING count(*) = {len(_GOOD)}) SELECT signal_id, seq, channel, round(value, 6) AS value FROM samples WHERE channel <> '{_BAD}' UNION ALL SELECT signal_id, seq, '{_BAD}', round(value, 6) FROM m")
def interp_bads(spark: SparkSession, sf: str) -> DataFrame:
    weights = spark.createDataFrame([(_BAD, c, w) for c, w in _GOOD.items()], "bad string, channel string, w double")
    return signals.interpolate(tables.samples(spark, sf), weights).withColumn("value", F.round("value", 6))


# Arrival times: every third sample comes a day early, so that they go back.
_JITTER = f"{_SAMPLES}, j AS (SELECT signal_id, channel, seq, CASE WHEN seq % 3 = 2 THEN ts - INTERVAL 1 DAY ELSE ts END AS ts, value FROM samples)"


def _jittered(spark: SparkSession, sf: str) -> DataFrame:
    return tables.samples(spark, sf).withColumn("ts", F.when(F.col("seq") % 3 == 2, F.expr("ts - interval 1 day")).otherwise(F.col("ts")))


@query("monotonize", f"WITH {_JITTER} SELECT signal_id, channel, seq, max(ts) OVER (PARTITION BY signal_id, channel ORDER BY seq) AS ts, value FROM j")
def monotonize(spark: SparkSession, sf: str) -> DataFrame:
    return signals.monotonic(_jittered(spark, sf)).select("signal_id", "channel", "seq", "ts", "value")


@query("dejitter", f"WITH {_JITTER}, o AS (SELECT *, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY signal_id, channel) AS late, min(epoch_us(ts)) OVER (PARTITION BY signal_id, channel) AS origin FROM j), l AS (SELECT signal_id, channel, regr_slope(late, seq) AS slope, regr_intercept(late, seq) AS base FROM o GROUP BY ALL) SELECT signal_id, channel, seq, (round((origin + coalesce(base + slope * seq, late)) / 1000000))::BIGINT AS second FROM o JOIN l USING (signal_id, channel)")
def dejitter(spark: SparkSession, sf: str) -> DataFrame:
    return signals.dejittered(_jittered(spark, sf)).select("signal_id", "channel", "seq", F.round(F.col("fit") / 1e6).cast("long").alias("second"))


@query("multi_input_sync", f"WITH {_SAMPLES}, v AS (SELECT signal_id, ts, value AS last_view FROM samples WHERE channel = 'view') SELECT s.signal_id, s.ts, s.seq, s.value, v.last_view FROM (SELECT * FROM samples WHERE channel = 'click') s ASOF LEFT JOIN v ON s.signal_id = v.signal_id AND s.ts >= v.ts")
def multi_input_sync(spark: SparkSession, sf: str) -> DataFrame:
    """Each sample of one input with the latest of the other."""
    s = tables.samples(spark, sf)
    return signals.latest(s.where("channel = 'click'").select("signal_id", "ts", "seq", "value"), s.where("channel = 'view'").select("signal_id", "ts", F.col("value").alias("last_view")), "last_view")


@query("sink_xdf_stream", f"SELECT CAST(user_id AS VARCHAR) AS stream, {_SECONDS} AS ts, event_type AS channel, value FROM events")
def sink_xdf_stream(spark: SparkSession, sf: str) -> DataFrame:
    """A stream of samples written as XDF files, one for each signal and trigger."""
    path = tables.scratch(spark, "xdf")

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select(F.col("signal_id").cast("string").alias("stream"), "seq", (F.unix_micros("ts") / 1e6).alias("ts"), "channel", "value")
        xdf.write(rows, f"{path}/{number}", 0.0).write.format("noop").mode("overwrite").save()

    s = online.stream(spark, f"{sf}/events.parquet*")
    s.writeStream.option("checkpointLocation", tables.scratch(spark, "state")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return xdf.read(spark, path).select("stream", "ts", "channel", "value")


@query("source_live", f"SELECT CAST(user_id AS VARCHAR) AS stream, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, {_SECONDS} AS ts, event_type AS channel, value FROM events")
def source_live(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings followed by a stream that stops when it has the first half of the signals and starts again for the rest."""
    path, out = tables.scratch(spark, "live"), tables.scratch(spark, "live-rows")
    rows = tables.stored(_streams(spark, sf), "live-samples")
    state = tables.scratch(spark, "live-state")
    for half in (0, 1):
        xdf.write(rows.where(F.pmod(F.crc32("stream"), F.lit(2)) == half), path, 0.0).write.format("noop").mode("overwrite").save()
        samples = live.follow(spark, path).select("stream", "seq", "ts", "channel", "value")
        samples.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(samples.schema).parquet(out)


@query("sink_live", "SELECT user_id AS signal_id, event_id AS seq, event_type AS channel, value FROM events")
def sink_live(spark: SparkSession, sf: str) -> DataFrame:
    """A stream passed on as lines of JSON, and what arrives."""
    path = tables.scratch(spark, "live")
    s = online.stream(spark, f"{sf}/events.parquet*").select(F.to_json(F.struct("signal_id", "seq", "channel", "value")).alias("value"))
    s.writeStream.format("text").option("path", path).option("checkpointLocation", tables.scratch(spark, "state")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.text(path).select(F.from_json("value", "signal_id long, seq long, channel string, value double").alias("r")).select("r.*")


@query("session_variable", "SELECT event_id, value FROM events WHERE value > 99")
def session_variable(spark: SparkSession, sf: str) -> DataFrame:
    """A value set in one place and read in another."""
    spark.sql("DECLARE OR REPLACE VARIABLE tidewave_least DOUBLE DEFAULT 0")
    spark.sql("SET VAR tidewave_least = 99")
    return tables.table(spark, sf, "events", "event_id", "value").where("value > tidewave_least")
