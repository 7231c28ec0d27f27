"""A bank of band-pass filters over trials, in blocks that share one Fourier transform.

Trials are rows (trial_id, class, seq, x), ``x`` holding a value for each channel
and ``seq`` counting from 0 within the trial. A block of rows with the reach of the
filters on both sides is transformed once and multiplied by the response of each
band, so that a trial of any length is spread over tasks and the result is that
of the whole trial.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions import kernels
from tidewave.operators import signals

#: Rows of a block, filtered values that a task gives at once.
BLOCK, MOST_VALUES = 8192, 1 << 20


@dataclass(frozen=True)
class Bank:
    """Bands (low, high) in Hz at the sampling rate ``fs``; centred filters of ``length`` taps (odd)."""

    fs: float
    bands: tuple[tuple[float, float], ...]
    length: int = 65

    @classmethod
    def spaced(cls, fs: float, low: float = 4, high: float = 40, width: float = 4, length: int = 65) -> Bank:
        """Bands of equal width, one after another."""
        n = int(round((high - low) / width))
        return cls(fs, tuple((low + i * width, low + (i + 1) * width) for i in range(n)), length)

    @property
    def reach(self) -> int:
        return (self.length - 1) // 2

    def taps(self) -> np.ndarray:
        """Bands by taps."""
        return np.stack([kernels.windowed_sinc(self.fs, band, self.length) for band in self.bands])

    def apply(self, x: np.ndarray) -> np.ndarray:
        """The filtered ``x`` (samples by channels) of each band; one transform serves all bands."""
        n = 1 << int(np.ceil(np.log2(max(2, len(x) + self.length - 1))))
        spectrum = np.fft.rfft(x, n, axis=0)
        return np.fft.irfft(spectrum * _responses(self, n)[:, :, None], n, axis=1)[:, self.reach : self.reach + len(x)]


@lru_cache(maxsize=64)
def _responses(bank: Bank, n: int) -> np.ndarray:
    """Bands by frequencies of a transform of ``n`` samples."""
    return np.fft.rfft(bank.taps(), n, axis=1)


def _blocks(trials: DataFrame, bank: Bank, size: int) -> DataFrame:
    """One row for each block of a trial: its samples in order, flat, with the reach of the filters around."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "x")))
    framed = signals.blocks(trials, size, bank.reach).groupBy("trial_id", "class", "block").agg(ordered.alias("rows"))
    return framed.select("trial_id", "class", "block", F.size("rows").alias("n"), F.flatten(F.transform("rows", lambda r: r["x"])).alias("x"))


def _over_blocks(framed: DataFrame, bank: Bank, size: int, make: Callable, schema: str) -> DataFrame:
    """Rows that ``make`` builds from (rows of some blocks, the number of the first sample of each, bands by filtered samples of each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
            ends = np.cumsum(batch["x"].value_lengths().to_numpy(zero_copy_only=False)).tolist()
            own, firsts, filtered, held = [], [], [], 0
            for i, (block, n, begin, end) in enumerate(zip(batch["block"].to_pylist(), batch["n"].to_pylist(), [0, *ends], ends)):
                skip = min(block * size, bank.reach)
                y = bank.apply(flat[begin:end].reshape(n, -1))[:, skip : skip + size]
                if y.shape[1]:
                    own.append(i)
                    firsts.append(block * size)
                    filtered.append(y)
                    held += y.size
                if held >= MOST_VALUES:
                    yield make(batch.take(pa.array(own)), firsts, filtered)
                    own, firsts, filtered, held = [], [], [], 0
            if own:
                yield make(batch.take(pa.array(own)), firsts, filtered)

    return framed.mapInArrow(run, schema)


def filtered(trials: DataFrame, bank: Bank, size: int = BLOCK, digits: int | None = None) -> DataFrame:
    """(trial_id, class, band, seq, x): every trial through every band, rounded to ``digits`` if given, halves away from zero."""

    def rows(own: pa.RecordBatch, firsts: list[int], filtered: list[np.ndarray]) -> pa.RecordBatch:
        bands, _, c = filtered[0].shape
        sizes = np.array([y.shape[1] for y in filtered])
        at = pa.array(np.repeat(np.arange(len(sizes)), bands * sizes))
        band = np.concatenate([np.repeat(np.arange(bands, dtype=np.int32), n) for n in sizes])
        seq = np.concatenate([np.tile(np.arange(first, first + n), bands) for first, n in zip(firsts, sizes)])
        values = np.concatenate([y.ravel() for y in filtered])
        if digits is not None:
            values = np.trunc(values * 10.0**digits + np.copysign(0.5, values)) / 10.0**digits
        x = pa.ListArray.from_arrays(pa.array(np.arange(len(seq) + 1, dtype=np.int32) * c), pa.array(values))
        return pa.record_batch([own["trial_id"].take(at), own["class"].take(at), pa.array(band), pa.array(seq), x], ["trial_id", "class", "band", "seq", "x"])

    return _over_blocks(_blocks(trials, bank, size), bank, size, rows, "trial_id long, class string, band int, seq long, x array<double>")


def covariances(trials: DataFrame, bank: Bank, size: int = BLOCK, channels: int | None = None) -> DataFrame:
    """(trial_id, class, band, cov): the channel covariance of each trial in each band.

    Blocks give sums and sums of products, which are added up; filtered samples
    never leave their task.
    """

    def sums(own: pa.RecordBatch, firsts: list[int], filtered: list[np.ndarray]) -> pa.RecordBatch:
        bands = len(filtered[0])
        at = pa.array(np.repeat(np.arange(len(filtered)), bands))
        found = [np.concatenate([np.full((bands, 1), y.shape[1]), y.sum(1), np.matmul(y.transpose(0, 2, 1), y).reshape(bands, -1)], 1) for y in filtered]
        band = pa.array(np.tile(np.arange(bands, dtype=np.int32), len(filtered)))
        return pa.record_batch([own["trial_id"].take(at), own["class"].take(at), band, _lists(np.concatenate(found))], ["trial_id", "class", "band", "p"])

    parts = _over_blocks(_blocks(trials, bank, size), bank, size, sums, "trial_id long, class string, band int, p array<double>")
    return from_sums(parts, channels)


def _lists(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x, float).ravel()))


def from_sums(parts: DataFrame, channels: int | None = None) -> DataFrame:
    """Covariances (n - 1) from partial sums ``p``: the count, c sums, c times c sums of products; trials of one sample go.

    With ``channels`` (c) known a trial and band is one row of the shuffle, else one for each sum.
    """
    keys = ["trial_id", "class", "band"]
    if channels is not None:
        width = 1 + channels + channels**2
        total = parts.groupBy(*keys).agg(*[F.sum(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(width)])
        whole = total.select(*keys, F.array(*[f"p{i}" for i in range(width)]).alias("p"))
    else:
        cells = parts.select(*keys, F.posexplode("p").alias("i", "v"))
        total = cells.groupBy(*keys, "i").agg(F.sum("v").alias("v"))
        whole = total.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda r: r["v"]).alias("p"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch["p"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            more = v[:, 0] > 1
            own, v = batch.filter(pa.array(more)), v[more]
            c = int((np.sqrt(4 * v.shape[1] - 3) - 1) / 2)
            n, s, q = v[:, :1], v[:, 1 : c + 1], v[:, c + 1 :]
            cov = (q - (s[:, :, None] * s[:, None]).reshape(q.shape) / n) / (n - 1)
            yield pa.record_batch([*(own[k] for k in keys), _lists(cov)], [*keys, "cov"])

    return whole.mapInArrow(finish, "trial_id long, class string, band int, cov array<double>")


def raw_covariances(trials: DataFrame, channels: int | None = None) -> DataFrame:
    """As ``covariances`` for trials (trial_id, class, band, seq, x) that are filtered already: with ``channels`` known each is an aggregate, else each batch sums its rows first."""
    if channels is not None:
        x = [F.get("x", F.lit(i)) for i in range(channels)]
        upper = {(i, j): F.covar_samp(x[i], x[j]) for i in range(channels) for j in range(i, channels)}
        own = trials.groupBy("trial_id", "class", "band").agg(F.count("*").alias("n"), *[v.alias(f"c{i}_{j}") for (i, j), v in upper.items()]).where("n > 1")
        return own.select("trial_id", "class", F.col("band").cast("int").alias("band"), F.array(*[f"c{min(i, j)}_{max(i, j)}" for i in range(channels) for j in range(channels)]).alias("cov"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
            trial, band = batch["trial_id"].to_numpy(), batch["band"].to_numpy()
            order = np.lexsort((band, trial))
            start = np.flatnonzero(np.concatenate([[True], (np.diff(trial[order]) != 0) | (np.diff(band[order]) != 0)]))
            found = []
            for rows in np.split(order, start[1:]):
                y = x[rows]
                found.append(np.concatenate([[len(y)], y.sum(0), (y.T @ y).ravel()]))
            first = pa.array(order[start])
            yield pa.record_batch([*(batch[k].take(first) for k in ("trial_id", "class", "band")), pa.array(found, pa.list_(pa.float64()))], ["trial_id", "class", "band", "p"])

    return from_sums(trials.select("trial_id", "class", F.col("band").cast("int").alias("band"), "x").mapInArrow(sums, "trial_id long, class string, band int, p array<double>"))
