"""Queries of recursive filters and of significant mains lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.operators import lines, recursive
from tidewave.plans.registry import QUERIES, query
from tidewave.sources import tables

FS = 256.0
_SAMPLES = "samples AS MATERIALIZED (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS seq, ts, event_type AS channel, value FROM events)"


def _recurrence(sections: recursive.Sections, table: str = "samples", name: str = "r") -> str:
    """The recurrence in SQL, a step for each sample: ``u`` and ``w`` are the state of each section."""
    steps = []
    for k, (b0, b1, b2, a1, a2) in enumerate(sections, 1):
        v = f"v{k - 1}"
        steps.append(f"{b0!r} * {v} + a{k} AS v{k}, {b1!r} * {v} - ({a1!r}) * v{k} + c{k} AS u{k}, {b2!r} * {v} - ({a2!r}) * v{k} AS w{k}")
    chain = f"SELECT signal_id, channel, seq, {', '.join(steps)}"
    rest = ", ".join(f"0.0::DOUBLE AS a{k}, 0.0::DOUBLE AS c{k}" for k in range(1, len(sections) + 1))
    held = ", ".join(f"p.u{k} AS a{k}, p.w{k} AS c{k}" for k in range(1, len(sections) + 1))
    return (
        f"{name} AS ({chain} FROM (SELECT signal_id, channel, seq, value::DOUBLE AS v0, {rest} FROM {table} WHERE seq = 0) "
        f"UNION ALL {chain} FROM (SELECT s.signal_id, s.channel, s.seq, s.value::DOUBLE AS v0, {held} FROM {name} p JOIN {table} s ON s.signal_id = p.signal_id AND s.channel = p.channel AND s.seq = p.seq + 1))"
    )


_STOP = recursive.butterworth(FS, (48.0, 52.0), "stop")
_BAND = recursive.butterworth(FS, (4.0, 40.0), "band", 2)
_TURNED = "back AS MATERIALIZED (SELECT signal_id, channel, max(seq) OVER (PARTITION BY signal_id, channel) - seq AS seq, v2 AS value FROM r)"


@query("notch_iir", f"WITH RECURSIVE {_SAMPLES}, {_recurrence(_STOP)} SELECT signal_id, channel, seq, round(v{len(_STOP)}, 6) + 0.0::DOUBLE AS value FROM r")
def notch_iir(spark: SparkSession, sf: str) -> DataFrame:
    """A Butterworth band-stop of fourth order at the mains frequency."""
    out = recursive.forward(tables.samples(spark, sf), _STOP)
    return out.withColumn("value", F.round("value", 6) + 0.0)


@query("band_iir_zero", f"WITH RECURSIVE {_SAMPLES}, {_recurrence(_BAND)}, {_TURNED}, {_recurrence(_BAND, 'back', 'q')} SELECT signal_id, channel, max(seq) OVER (PARTITION BY signal_id, channel) - seq AS seq, round(v2, 6) + 0.0::DOUBLE AS value FROM q")
def band_iir_zero(spark: SparkSession, sf: str) -> DataFrame:
    """A band-pass forwards and backwards, without a shift of phase."""
    out = recursive.both_ways(tables.samples(spark, sf), _BAND)
    return out.withColumn("value", F.round("value", 6) + 0.0)


@query("line_noise_ftest")
def line_noise_ftest(spark: SparkSession, sf: str) -> DataFrame:
    """Significant lines of the detrended signal, taken from the signal itself."""
    return lines.removed(tables.samples(spark, sf), FS, fitted=QUERIES["detrend_highpass"](spark, sf)).select("signal_id", "channel", "seq", "value", "line")
