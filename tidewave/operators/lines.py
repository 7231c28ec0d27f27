"""Mains lines by Thomson's harmonic F test, removed only where they are significant.

A channel is cut into windows of ten seconds that overlap by half. In each the
tapered spectra give, near every harmonic of the mains, the amplitude of a line
and the ratio of its power to what is left over; under no line that ratio follows
the F distribution with 2 and 2K - 2 degrees of freedom. Lines that pass, at a
level shared by all frequencies looked at, are subtracted, blended from window to
window; where none passes a sample stays as it is, bit by bit.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import signals

#: Seconds of a window, time-bandwidth product and number of tapers, Hz to both sides of a harmonic, level of the test.
SECONDS, HALF_BANDWIDTH, TAPERS, REACH, LEVEL = 10.0, 4.0, 7, 1.0, 0.05
#: Spectra are made this much finer than the window alone gives.
FINER = 4
#: A window of fewer samples than this has no lines.
LEAST = 64


@lru_cache(maxsize=8)
def tapers(n: int, half_bandwidth: float = HALF_BANDWIDTH, k: int = TAPERS, basis: int = 40) -> np.ndarray:
    """Discrete prolate spheroidal sequences, k by n.

    They solve a tridiagonal problem (Slepian 1978); as the first ones are smooth,
    it is enough to solve it among polynomials of a degree below ``basis``.
    """
    i = np.arange(n)
    s = np.linalg.qr(np.polynomial.legendre.legvander((2 * i + 1) / n - 1, min(basis, n) - 1))[0].T
    diagonal, off = ((n - 1 - 2 * i) / 2) ** 2 * np.cos(2 * np.pi * half_bandwidth / n), i[1:] * (n - i[1:]) / 2
    t = s * diagonal
    t[:, 1:] += s[:, :-1] * off
    t[:, :-1] += s[:, 1:] * off
    vectors = np.linalg.eigh(t @ s.T)[1][:, ::-1][:, :k]
    return vectors.T @ s


def critical(level: float, k: int) -> float:
    """The F value with 2 and 2k - 2 degrees of freedom that chance passes with probability ``level``."""
    return (k - 1) * (level ** (-1 / (k - 1)) - 1)


def line(x: np.ndarray, fs: float, freq: float, level: float = LEVEL, reach: float = REACH) -> np.ndarray:
    """The sum of the significant lines of a window near ``freq`` and its harmonics; zeros if there are none."""
    n, out = len(x), np.zeros(len(x))
    harmonics = np.arange(freq, fs / 2 - reach, freq)
    if n < LEAST or not len(harmonics):
        return out
    size = 1 << int(np.ceil(np.log2(n * FINER)))
    grid = np.arange(size // 2 + 1) * fs / size
    h = tapers(n)
    sums = h.sum(1)
    sums[1::2] = 0  # odd tapers have none
    near_all = [np.flatnonzero(np.abs(grid - f) <= reach) for f in harmonics]
    bound = critical(level / max(1, sum(map(len, near_all))), len(h))
    left, t = x - x.mean(), np.arange(n)
    for near in near_all:
        spectra = np.fft.rfft(h * left, size, axis=1)[:, near]
        amplitude = sums @ spectra / (sums @ sums)
        rest = (np.abs(spectra - np.outer(sums, amplitude)) ** 2).sum(0)
        ratio = (len(h) - 1) * np.abs(amplitude) ** 2 * (sums @ sums) / np.maximum(rest, 1e-300)
        best = int(ratio.argmax())
        if ratio[best] > bound:
            own = 2 * (amplitude[best] * np.exp(2j * np.pi * grid[near[best]] * t / fs)).real
            out += own
            left = left - own
    return out


def removed(samples: DataFrame, fs: float, freq: float = 50.0, level: float = LEVEL, seconds: float = SECONDS, fitted: DataFrame | None = None) -> DataFrame:
    """``samples`` (signal_id, channel, seq from 0 on, value) without significant lines, and ``line``, what was taken from each.

    Lines are looked for in ``fitted`` if given (the same keys, such as the detrended signal).
    """
    hop = int(seconds * fs / 2)
    keys = [*signals.SIGNAL, "window"]
    at = F.floor(F.col("seq") / hop)
    source = samples if fitted is None else fitted
    framed = signals.frames(source.select(*signals.SIGNAL, "seq", "value").withColumn("window", F.explode(F.sequence(F.greatest(at - 1, F.lit(0)), at))), keys)

    @F.pandas_udf("array<double>")
    def found(x: pd.Series) -> pd.Series:
        def one(v: np.ndarray) -> list[float] | None:
            own = line(np.asarray(v, float), fs, freq, level)
            return own.tolist() if own.any() else None

        return pd.Series([one(v) for v in x], dtype=object)

    # only windows with a line go on
    own = framed.select(*keys, found("x").alias("y")).where("y is not null").select(*keys, F.posexplode("y").alias("place", "line"))
    # a window weighs most in its middle; two of them cover each sample but the first
    weight = 1 - F.abs(F.col("place") + 0.5 - hop) / hop
    part = own.select(*signals.SIGNAL, (F.col("window") * hop + F.col("place")).alias("seq"), F.when((F.col("window") == 0) & (F.col("place") < hop), 1.0).otherwise(weight).alias("w"), "line")
    total = part.groupBy(*signals.SIGNAL, "seq").agg(F.sum(F.col("line") * F.col("w")).alias("line"))
    joined = samples.join(total, [*signals.SIGNAL, "seq"], "left")
    return joined.withColumn("value", F.when(F.col("line").isNull(), F.col("value")).otherwise(F.col("value") - F.col("line"))).withColumn("line", F.coalesce("line", F.lit(0.0)))
