"""Queries of coherence over epochs, continuous wavelets and consensus of channels."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.functions import kernels
from tidewave.operators import filterbank, ica, lines, phase, ransac, wavelets
from tidewave.plans import catalog, spectra
from tidewave.plans.registry import query
from tidewave.sources import tables

FS, SCALES = 256.0, (1.0, 2.0, 4.0)
_KEYS = ["signal_id", "channel", "window_id"]
_COEFFICIENTS = f"WITH {spectra._W}, {spectra._WAVES}, c AS ({spectra._convolved('w', spectra._KEY)})"


def morlet(x: np.ndarray) -> np.ndarray:
    return kernels.morlet(x, FS, catalog._FREQS)


def multitaper(x: np.ndarray) -> np.ndarray:
    """Coefficients for each of three tapers."""
    return np.stack([morlet(x * t) for t in (lines.tapers(len(x), 2.0, 3) if len(x) > 3 else np.ones((1, len(x))))])


@query("tfr_cells", f"{_COEFFICIENTS} SELECT {spectra._KEY}, item, i AS place, round(re, 6) + 0.0::DOUBLE AS re, round(im, 6) + 0.0::DOUBLE AS im, round(re * re + im * im, 6) AS power FROM c")
def tfr_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Complex coefficients and power of each window, by frequency and sample."""
    found = phase.coefficients(catalog._windowed(tables.samples(spark, sf)), morlet, _KEYS)
    return found.select(*_KEYS, "item", "place", (F.round("re", 6) + 0.0).alias("re"), (F.round("im", 6) + 0.0).alias("im"), F.round("power", 6).alias("power"))


@query("tfr_phase")
def tfr_phase(spark: SparkSession, sf: str) -> DataFrame:
    return phase.coefficients(catalog._windowed(tables.samples(spark, sf)), morlet, _KEYS).select(*_KEYS, "item", "place", "phase")


@query(
    "itc_morlet",
    f"{_COEFFICIENTS}, u AS (SELECT *, re * re + im * im AS p, CASE WHEN p >= 1e-12 THEN re / sqrt(p) ELSE 0 END AS x, CASE WHEN p >= 1e-12 THEN im / sqrt(p) ELSE 0 END AS y FROM c) "
    "SELECT channel, item, i AS place, count(*) AS n, round(avg(p), 6) AS avg_power, round(sqrt(sum(x) * sum(x) + sum(y) * sum(y)) / count(*), 6) AS itc FROM u GROUP BY ALL",
)
def itc_morlet(spark: SparkSession, sf: str) -> DataFrame:
    """Average power and inter-trial coherence over the windows of all signals."""
    return _averaged(spark, sf, morlet)


@query("itc_multitaper")
def itc_multitaper(spark: SparkSession, sf: str) -> DataFrame:
    return _averaged(spark, sf, multitaper)


@query("itc_stockwell")
def itc_stockwell(spark: SparkSession, sf: str) -> DataFrame:
    """Windows of one length share their frequencies, so the number of samples belongs to the keys."""
    framed = catalog._windowed(tables.samples(spark, sf)).withColumn("samples", F.size("x"))
    return _rounded(phase.averaged(framed, kernels.stockwell, ["channel", "samples"]))


def _averaged(spark: SparkSession, sf: str, kernel: phase.Kernel) -> DataFrame:
    return _rounded(phase.averaged(catalog._windowed(tables.samples(spark, sf)), kernel, ["channel"]))


def _rounded(found: DataFrame) -> DataFrame:
    return found.withColumns({"avg_power": F.round("avg_power", 6), "itc": F.round("itc", 6)})


def _energy_sql(psi: str, reach: float) -> str:
    scales = ", ".join(f"({a!r})" for a in SCALES)
    return (
        f"WITH {spectra._S}, a(scale) AS (VALUES {scales}), c AS (SELECT o.signal_id, o.channel, o.seq, scale, sum(s.value * {psi.format(t='((s.seq - o.seq) / scale)')}) / sqrt(scale) AS w "
        f"FROM samples o JOIN samples s ON s.signal_id = o.signal_id AND s.channel = o.channel JOIN a ON abs(s.seq - o.seq) <= ceil({reach!r} * scale) GROUP BY o.signal_id, o.channel, o.seq, scale) "
        "SELECT signal_id, channel, scale::DOUBLE AS scale, round(sum(w * w), 3) AS energy FROM c GROUP BY ALL"
    )


def _energy(name: str, psi: str, reach: float) -> None:
    @query(f"cwt_energy_{name}", _energy_sql(psi, reach))
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return wavelets.energy(tables.samples(spark, sf), name, SCALES).withColumn("energy", F.round("energy", 3))


_energy("morl", "exp(-{t} * {t} / 2) * cos(5 * {t})", 8.0)
_energy("gaus2", f"(4 * {{t}} * {{t}} - 2) * exp(-{{t}} * {{t}}) / {math.sqrt(3 * math.sqrt(math.pi / 2))!r}", 5.0)


@query("cwt_cmor")
def cwt_cmor(spark: SparkSession, sf: str) -> DataFrame:
    """Complex coefficients of every sample."""
    return wavelets.coefficients(tables.samples(spark, sf), "cmor1.5-1.0", SCALES)


@query("conn_corr_eigen")
def conn_corr_eigen(spark: SparkSession, sf: str) -> DataFrame:
    """Eigenvalues of each supplier's correlations between channels, from sums of products."""
    w = tables.wide(spark, sf)
    rows = w.select(F.col("signal_id").alias("trial_id"), F.lit("").alias("class"), F.lit(0).alias("band"), F.array(*[F.col(c).cast("double") for c in tables.CHANNELS]).alias("x"))

    @F.pandas_udf("array<double>")
    def values(cov: pd.Series) -> pd.Series:
        return pd.Series([kernels.correlation_eigenvalues(np.reshape(c, (int(len(c) ** 0.5), -1))).tolist() for c in cov], dtype=object)

    found = filterbank.raw_covariances(rows).select(F.col("trial_id").alias("signal_id"), F.posexplode(values("cov")).alias("item", "value"))
    return found.select("signal_id", F.col("item").cast("long").alias("item"), F.round("value", 6).alias("value"))


#: Places of the five channels on the head, made up, as the events have none.
PLACES = {"click": (0.0, 0.0, 1.0), "error": (0.8, 0.0, 0.6), "purchase": (-0.8, 0.0, 0.6), "signup": (0.0, 0.8, 0.6), "view": (0.0, -0.8, 0.6)}


@query("ransac_channels")
def ransac_channels(spark: SparkSession, sf: str) -> DataFrame:
    """How often each channel is badly predicted by the others."""
    return ransac.bad_channels(tables.samples(spark, sf), PLACES, ransac.Consensus(window=4, share=0.6))


@query("reref_ransac")
def reref_ransac(spark: SparkSession, sf: str) -> DataFrame:
    return ransac.referenced(tables.samples(spark, sf), PLACES, ransac.Consensus(window=4, share=0.6)).select("signal_id", "channel", "seq", "value", "bad")


def _repaired(spark: SparkSession, sf: str, method: str, rounds: int | None = None) -> DataFrame:
    w = tables.wide(spark, sf)
    rows = w.select("signal_id", "seq", F.array(*[F.col(c).cast("double") for c in tables.CHANNELS]).alias("x"))
    return ica.repaired(rows, method, rounds=rounds).select("signal_id", "seq", *[F.col("x")[i].alias(c) for i, c in enumerate(tables.CHANNELS)])


@query("ica_repair_picard")
def ica_repair_picard(spark: SparkSession, sf: str) -> DataFrame:
    """Every supplier's channels without the component of the greatest kurtosis."""
    return _repaired(spark, sf, "picard", 20)


@query("ica_repair_infomax")
def ica_repair_infomax(spark: SparkSession, sf: str) -> DataFrame:
    """As ``ica_repair_picard``; every signal goes on until its gradient is small."""
    return _repaired(spark, sf, "infomax")
