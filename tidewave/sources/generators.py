"""Made-up signals, numbers and features; each value is a hash of its place, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_STEPS = 1 << 24


def uniform(place: str, seed: int) -> Column:
    """A number in [0, 1) for each value of the column ``place``."""
    digits = F.substring(F.md5(F.concat_ws("-", F.lit(seed), F.col(place).cast("string"))), 1, 6)
    return F.conv(digits, 16, 10).cast("long") / F.lit(_STEPS)


def uniform_sql(place: str, seed: int) -> str:
    """The same in DuckDB."""
    return f"('0x' || substr(md5('{seed}-' || {place}), 1, 6))::BIGINT / {_STEPS}"


def class_features(spark: SparkSession, rows: int, features: int, classes: int, apart: float, seed: int) -> DataFrame:
    """(row_id, class, j, value): uniform features, those of class c moved by ``c * apart``, so that classes overlap."""
    df = spark.range(rows * features)
    row = F.floor(F.col("id") / features)
    return df.select(row.alias("row_id"), (row % classes).cast("string").alias("class"), (F.col("id") % features).alias("j"), (uniform("id", seed) + apart * (row % classes)).alias("value"))


def trials(spark: SparkSession, n: int, channels: int, samples: int, seed: int) -> DataFrame:
    """(trial_id, channel, seq, value) of ``n`` random trials."""
    df = spark.range(n * channels * samples)
    return df.select(F.floor(F.col("id") / (channels * samples)).alias("trial_id"), F.concat(F.lit("channel_"), F.floor(F.col("id") / samples) % channels).alias("channel"), (F.col("id") % samples).alias("seq"), uniform("id", seed).alias("value"))


def integers(spark: SparkSession, n: int, low: int, high: int, seed: int) -> DataFrame:
    """(seq, value): whole numbers in [low, high)."""
    return spark.range(n).select(F.col("id").alias("seq"), (low + F.floor(uniform("id", seed) * (high - low))).alias("value"))


def flowers(spark: SparkSession, per_class: int = 50, seed: int = 3) -> DataFrame:
    """(row_id, class, j, value): three classes of four measures, the first far from the others; a stand-in for a well-known small data set."""
    centres = ((5.0, 3.4, 1.5, 0.2), (5.9, 2.8, 4.3, 1.3), (6.6, 3.0, 5.6, 2.0))
    df = spark.range(3 * per_class * 4)
    row, j = F.floor(F.col("id") / 4), (F.col("id") % 4)
    kind = F.floor(row / per_class)
    centre = F.array(*[F.array(*map(F.lit, c)) for c in centres])
    value = F.round(F.get(F.get(centre, kind.cast("int")), j.cast("int")) + (uniform("id", seed) - 0.5) * 0.8, 1)
    return df.select(row.alias("row_id"), F.concat(F.lit("class_"), kind).alias("class"), j.alias("j"), value.alias("value"))
