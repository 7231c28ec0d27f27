"""Continuous wavelet transforms of channels, scale by scale, in blocks with overlap."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import signals

#: Samples of a block.
BLOCK = 16_384


def wavelet(name: str) -> tuple[Callable[[np.ndarray], np.ndarray], float]:
    """The function and the half width of its support: ``morl``, ``cmor<bandwidth>-<centre>``, ``gaus1`` to ``gaus8``."""
    if name == "morl":
        return lambda t: np.exp(-(t**2) / 2) * np.cos(5 * t), 8.0
    if found := re.fullmatch(r"cmor(\d+(?:\.\d+)?)-(\d+(?:\.\d+)?)", name):
        width, centre = map(float, found.groups())
        return lambda t: np.exp(-(t**2) / width) * np.exp(2j * np.pi * centre * t) / np.sqrt(np.pi * width), 8.0
    if found := re.fullmatch(r"gaus([1-8])", name):
        n = int(found[1])
        hermite = np.polynomial.hermite.Hermite.basis(n)
        # the square of the n-th derivative of exp(-t^2) integrates to sqrt(pi / 2) (2n - 1)!!
        norm = math.sqrt(math.sqrt(math.pi / 2) * math.prod(range(1, 2 * n, 2)))
        return lambda t: (-1) ** n * hermite(t) * np.exp(-(t**2)) / norm, 5.0
    raise ValueError(f"unknown wavelet {name}")


def frequency(name: str, scale: float, fs: float) -> float:
    """The frequency at which a scale answers most, from the wavelet's spectrum."""
    psi, reach = wavelet(name)
    t = np.linspace(-reach, reach, 4096)
    power = np.abs(np.fft.fft(psi(t), 1 << 17)) ** 2
    f = np.fft.fftfreq(1 << 17, t[1] - t[0])
    return float(abs(f[f > 0][power[f > 0].argmax()]) * fs / scale)


def taps(name: str, scale: float) -> np.ndarray:
    """The wavelet at a scale, an odd number of samples around its centre."""
    psi, reach = wavelet(name)
    n = math.ceil(reach * scale)
    return psi(np.arange(-n, n + 1) / scale) / math.sqrt(scale)


def transform(x: np.ndarray, name: str, scales: Sequence[float]) -> Iterator[np.ndarray]:
    """Of each scale the correlation of ``x`` with the wavelet at every sample, by FFT."""
    for a in scales:
        h = np.conj(taps(name, a))[::-1]
        n = 1 << math.ceil(math.log2(max(2, len(x) + len(h) - 1)))
        full = np.fft.ifft(np.fft.fft(x, n) * np.fft.fft(h, n))
        own = full[(len(h) - 1) // 2 : (len(h) - 1) // 2 + len(x)]
        yield own if np.iscomplexobj(h) else own.real


def _over_blocks(samples: DataFrame, name: str, scales: Sequence[float], size: int, make: Callable, schema: str) -> DataFrame:
    reach = max((len(taps(name, a)) - 1) // 2 for a in scales)
    keys = [*signals.SIGNAL, "block"]
    framed = signals.frames(signals.blocks(samples, size, reach), keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(batch["block"].to_pylist()):
                x = batch["x"][i].values.to_numpy(zero_copy_only=False).astype(float)
                skip = min(block * size, reach)
                for k, y in enumerate(transform(x, name, scales)):
                    yield make(batch.slice(i, 1), k, block * size, y[skip : skip + size])

    kind = samples.schema["signal_id"].dataType.simpleString()
    return framed.mapInArrow(run, f"signal_id {kind}, channel string, {schema}")


def coefficients(samples: DataFrame, name: str, scales: Sequence[float], size: int = BLOCK) -> DataFrame:
    """(signal_id, channel, scale, seq, re, im) of every sample; ``im`` is 0 for real wavelets."""

    def rows(own: pa.RecordBatch, k: int, first: int, y: np.ndarray) -> pa.RecordBatch:
        at = pa.array(np.zeros(len(y), np.int64))
        return pa.record_batch([own["signal_id"].take(at), own["channel"].take(at), pa.array(np.full(len(y), float(scales[k]))), pa.array(first + np.arange(len(y))), pa.array(np.ascontiguousarray(y.real)), pa.array(np.ascontiguousarray(y.imag))], ["signal_id", "channel", "scale", "seq", "re", "im"])

    return _over_blocks(samples, name, scales, size, rows, "scale double, seq long, re double, im double")


def energy(samples: DataFrame, name: str, scales: Sequence[float], size: int = BLOCK) -> DataFrame:
    """(signal_id, channel, scale, energy): the sum of the squared coefficients; blocks send sums only."""

    def sums(own: pa.RecordBatch, k: int, first: int, y: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([own["signal_id"], own["channel"], pa.array([float(scales[k])]), pa.array([float((np.abs(y) ** 2).sum())])], ["signal_id", "channel", "scale", "energy"])

    return _over_blocks(samples, name, scales, size, sums, "scale double, energy double").groupBy(*signals.SIGNAL, "scale").agg(F.sum("energy").alias("energy"))
