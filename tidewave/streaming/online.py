"""Online forms of segment, window and FIR: Structured Streaming with the batch semantics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewave.sources.tables import scratch

SAMPLES = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of event files as a stream of samples.

    All files that are there come in one trigger, as they need not follow the
    order of time: of files taken in turn, rows older than the watermark of the
    earlier ones would be dropped. ``files_per_trigger`` is for files in order.
    """
    reader = spark.readStream.schema(SAMPLES)
    df = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)
    return df.select(F.col("user_id").alias("signal_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("channel"), "value")


def segment(samples: DataFrame, markers: DataFrame, before: float, after: float, late: str = "1 hour") -> DataFrame:
    """Stream-stream interval join; markers may come before their samples, and state ends with the watermark."""
    s = samples.withWatermark("ts", late)
    m = markers.withWatermark("marker_ts", late).withColumnRenamed("signal_id", "marker_signal")
    near = F.expr(f"ts >= marker_ts + make_dt_interval(0, 0, 0, {before}) and ts < marker_ts + make_dt_interval(0, 0, 0, {after})")
    return s.join(m, (F.col("signal_id") == F.col("marker_signal")) & near).drop("marker_signal")


def tumbling(samples: DataFrame, length: str, step: str | None = None, late: str = "1 hour") -> DataFrame:
    """Windowed statistics with event time and a watermark."""
    w = F.window("ts", length, step) if step else F.window("ts", length)
    return samples.withWatermark("ts", late).groupBy(w, "signal_id", "channel").agg(F.count("*").alias("n"), F.avg("value").alias("feature_mean"))


def sessions(samples: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    return samples.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "signal_id").agg(F.count("*").alias("n"))


def fir(samples: DataFrame, taps: Sequence[float], block: int = 8) -> DataFrame:
    """Causal FIR over the samples in the order of ``seq``; whole blocks are emitted, the rest waits in the state.

    State: the last ``len(taps) - 1`` inputs and the samples that don't fill a block.
    """
    h = np.asarray(taps, float)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(batches).sort_values("seq")
        past, seqs, waiting = state.get if state.exists else ([0.0] * (len(h) - 1), [], [])
        seqs, x = [*seqs, *new["seq"]], np.array([*waiting, *new["value"]], float)
        whole = len(x) // block * block
        joined = np.concatenate([past, x[:whole]])
        y = np.convolve(joined, h, "valid") if whole else np.zeros(0)
        keep = joined[len(joined) - (len(h) - 1) :] if len(h) > 1 else []
        state.update((list(map(float, keep)), [int(s) for s in seqs[whole:]], list(map(float, x[whole:]))))
        yield pd.DataFrame({"signal_id": np.full(whole, key[0], np.int64), "channel": [key[1]] * whole, "seq": np.array(seqs[:whole], np.int64), "value": y})

    return samples.groupBy("signal_id", "channel").applyInPandasWithState(run, "signal_id long, channel string, seq long, value double", "past array<double>, seqs array<long>, waiting array<double>", "append", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Runs a stream over all that is there and gives what it has written, as a table in the shared folder.

    ``complete`` gives every group of an aggregation, also those that the
    watermark has not closed at the end, and ``update`` every group as the one
    trigger leaves it; the last trigger's result counts. The state stays under
    ``path`` / state.
    """
    spark = df.sparkSession
    path = path or scratch(spark, name)
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True)
    if mode == "append":
        writer = writer.format("parquet").option("path", f"{path}/out")
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{path}/out"))
    started = writer.start()
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
