"""Recordings in their canonical long form, from the tables at hand.

``samples``: signal_id, seq, ts, channel, value; ``markers``: signal_id, marker, ts;
``wide``: signal_id, seq, class and one column for each channel.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine may lack the setting; it gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-tidewave-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back, so that what reads it twice makes it once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


CHANNELS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as samples: a signal for each user, a channel for each type, ``seq`` in order of time per channel."""
    order = Window.partitionBy("signal_id", "channel").orderBy("ts", "event_id")
    df = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("signal_id"), F.col("event_type").alias("channel"), "value")
    # numbered by the names that rows leave with, so what groups by them needs no shuffle of its own
    return df.select("signal_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "ts", "channel", "value")


def markers(spark: SparkSession, sf_dir: str, name: str = "purchase") -> DataFrame:
    df = table(spark, sf_dir, "events", "ts", "user_id", "event_type").where(F.col("event_type") == name)
    return df.select(F.col("user_id").alias("signal_id"), F.col("event_type").alias("marker"), F.col("ts").alias("marker_ts"))


def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as rows of four channels, a signal for each supplier."""
    order = Window.partitionBy("signal_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    df = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("signal_id"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("class"), *CHANNELS)
    return df.select("signal_id", (F.row_number().over(order) - 1).cast("long").alias("seq"), "class", *CHANNELS)


def trial_rows(spark: SparkSession, sf_dir: str, classes: tuple[str, ...], back: int = 0) -> DataFrame:
    """Rows of ``wide`` of some classes, a trial for each signal and class: ``seq`` counts within the trial, ``n`` are its rows, ``m_`` the means of each channel's last ``back`` rows. One sort does it."""
    own = Window.partitionBy("signal_id", "class")
    order = own.orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    df = table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin(*classes)).select(F.col("l_suppkey").alias("signal_id"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("class"), *CHANNELS)
    means = [F.avg(c).over(order.rowsBetween(1 - back, 0)).alias(f"m_{c}") for c in CHANNELS] if back else []
    return df.select("signal_id", "class", (F.row_number().over(order) - 1).cast("long").alias("seq"), F.count("*").over(own).alias("n"), *CHANNELS, *means)


def melt(df: DataFrame, channels: tuple[str, ...] = CHANNELS) -> DataFrame:
    """Wide rows as long samples."""
    return df.unpivot(["signal_id", "seq", "class"], list(channels), "channel", "value")


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as labelled feature rows."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("string").alias("class"), F.transform("embedding", lambda x: x.cast("double")).alias("x"))
