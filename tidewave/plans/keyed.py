"""Queries of streams with keyed state and timers, on the events replayed in order of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.plans.registry import query
from tidewave.sources import tables
from tidewave.streaming import stateful

DAY, SLICES = 86_400.0, 4
_STREAM = "e AS (SELECT user_id AS signal_id, event_id AS seq, ts, event_type AS channel, value FROM events)"


def replay(spark: SparkSession, sf: str, rest: float = 2 * DAY) -> tuple[DataFrame, str]:
    """The events of ``sf`` as a stream, slice by slice, and its delay; all that ends within ``rest`` seconds after the last event comes to an end."""
    e = tables.table(spark, sf, "events").select(F.col("user_id").alias("signal_id"), F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("channel"), "value")
    return stateful.replayed(e, tables.scratch(spark, "replay"), SLICES, rest)


def through(spark: SparkSession, sf: str, processor: stateful.Ordered) -> DataFrame:
    """The events of ``sf``, slice by slice, through ``processor``."""
    stream, late = replay(spark, sf, 2 * processor.bucket_ms / 1000)
    return stateful.run(stateful.online(stream, processor, late), "keyed").where(F.col("signal_id") != stateful.CLOCK)


@query(
    "sample_rate_online",
    f"WITH {_STREAM}, b AS (SELECT signal_id, channel, epoch_us(ts) // 86400000000 AS bucket, count(*) AS n, count(*) * 86400.0::DOUBLE / nullif((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE, 0) AS rate FROM e GROUP BY ALL), "
    "l AS (SELECT *, list(rate) FILTER (rate IS NOT NULL) OVER (PARTITION BY signal_id, channel ORDER BY bucket) AS rates FROM b) "
    "SELECT signal_id, channel, bucket, n, CASE WHEN len(rates) > 0 THEN round(list_reduce(rates, lambda a, x: a + 0.65 * (x - a)), 6) END AS per_day FROM l",
)
def sample_rate_online(spark: SparkSession, sf: str) -> DataFrame:
    """The smoothed rate of each channel, day by day."""
    found = through(spark, sf, stateful.SampleRate(DAY, 1e9))
    return found.select("signal_id", "channel", "bucket", "n", F.round(F.col("rate") * DAY, 6).alias("per_day"))


@query("drift_windows_online")
def drift_windows_online(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of three days every two, moved along by how long their samples really last; channels end after ten days without a sample."""
    return through(spark, sf, stateful.DriftWindows(3 * DAY, 2 * DAY, DAY, 10 * DAY))
