"""Independent components of recordings of any length, from sums over partitions.

Rows are (signal_id, seq, x), ``x`` holding a value for each channel. Every step
needs means over the samples only. Signals of up to ``WHOLE`` rows are taken each by
one task, which makes all steps of many of them at a time. For a longer one a task
sums up its own rows, the sums of the signal are added, and the driver, which holds
a small matrix for each of these signals, moves on. ``infomax`` follows the natural gradient of the likelihood (Bell and
Sejnowski 1995; Lee et al. 1999 for components flatter than the normal
distribution), ``picard`` divides it by an approximate curvature (Ablin et al.
2018), which takes far fewer steps. Long signals are worked on ``MOST_SIGNALS`` at a time.
Whether a component is peaked or flat is judged anew at each of the first ``HELD``
steps, then kept: signals of few rows can turn between the two for ever.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.sources.tables import stored

#: Signals whose matrices the driver holds at once; most steps (infomax: against an endless run), the gradient that ends them, and the longest step.
MOST_SIGNALS, ROUNDS, ENOUGH, LONGEST = 4096, {"infomax": 10_000, "picard": 50}, 1e-4, 0.3
#: Steps after which components stay peaked or flat.
HELD = 100
#: Rows of a signal up to which one task takes it whole, and rows of such signals that are worked on at once.
WHOLE = 65_536
#: First rate of the natural gradient, and by what it changes where steps turn back or go on, down to the least; the least curvature that is divided by.
RATE, SLOWER, FASTER, LEAST_RATE, LEAST_CURVATURE = 0.3, 0.7, 1.03, 0.02, 0.05


@dataclass
class Unmixing:
    """``mean`` and ``matrix`` (components by channels) of a signal; ``steps`` taken, ``gradient`` left."""

    mean: np.ndarray
    matrix: np.ndarray
    steps: int = 0
    gradient: float = np.inf
    rate: float = RATE
    last: np.ndarray | None = None
    sign: np.ndarray | None = None

    def sources(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.matrix.T

    def mixing(self) -> np.ndarray:
        """Channels by components."""
        return np.linalg.pinv(self.matrix)


def _by_signal(batch: pa.RecordBatch) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """(signal, indices, samples by channels) of each signal of a batch."""
    if not batch.num_rows:
        return
    codes = batch["signal_id"].dictionary_encode()
    at, x = codes.indices.to_numpy(), batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1)
    for k, key in enumerate(codes.dictionary.to_pylist()):
        own = np.flatnonzero(at == k)
        yield key, own, x[own]


def _sums(rows: DataFrame, make: Callable[[object, np.ndarray], np.ndarray | None]) -> dict[object, np.ndarray]:
    """Of each signal the sum over tasks of what ``make`` gives for the samples at hand."""
    kind = rows.schema["signal_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, np.ndarray] = {}
        for batch in batches:
            for key, _, x in _by_signal(batch):
                new = make(key, x)
                if new is not None:
                    held[key] = held[key] + new if key in held else new
        if held:
            yield pa.record_batch([pa.array(list(held)), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], ["signal_id", "v"])

    parts = rows.select("signal_id", "x").mapInArrow(run, f"signal_id {kind}, v array<double>").select("signal_id", F.posexplode("v").alias("i", "v"))
    total = parts.groupBy("signal_id", "i").agg(F.sum("v").alias("v")).groupBy("signal_id").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("v"))
    return {r["signal_id"]: np.array(r["v"]) for r in total.select("signal_id", F.col("v.v").alias("v")).collect()}  # channels squared for each of MOST_SIGNALS


def _whitened(rows: DataFrame, components: int | None) -> dict[object, Unmixing]:
    sums = _sums(rows, lambda _, x: np.concatenate([[len(x)], x.sum(0), (x.T @ x).ravel()]))
    out = {}
    for key, v in sums.items():
        c = int((np.sqrt(4 * len(v) - 3) - 1) / 2)
        mean = v[1 : c + 1] / v[0]
        out[key] = _whitening(mean, v[c + 1 :].reshape(c, c) / v[0] - np.outer(mean, mean), components)
    return out


def _whitening(mean: np.ndarray, cov: np.ndarray, components: int | None) -> Unmixing:
    values, vectors = np.linalg.eigh(cov)
    top = [k for k in np.argsort(-values)[: components or len(cov)] if values[k] > 1e-12 * max(values.max(), 1e-300)]
    return Unmixing(mean, (vectors[:, top] / np.sqrt(values[top])).T)


def _step(v: np.ndarray, d: int, method: str, sign: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """(relative change of the matrix, for infomax at rate 1, greatest gradient, signs) from the sums of a signal."""
    n, v = v[0], v[1:] / v[0]
    t, c, slope = v[: d * d].reshape(1, d, d), v[d * d : 2 * d * d].reshape(1, d, d), v[None, 2 * d * d :]
    signs = _signs(t, c, slope) if sign is None else sign[None]
    move, gradient = _moves(t, c, slope, method, signs)
    return move[0], float(gradient[0]), signs[0]


def _signs(t: np.ndarray, c: np.ndarray, slope: np.ndarray) -> np.ndarray:
    """1 for each component that is peaked, -1 for flat."""
    own = np.arange(t.shape[1])
    return np.where(slope * c[:, own, own] >= t[:, own, own], 1.0, -1.0)


def _moves(t: np.ndarray, c: np.ndarray, slope: np.ndarray, method: str, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(relative change, greatest gradient) of many signals from their means."""
    own = np.arange(t.shape[1])
    gradient = sign[:, :, None] * t + c - np.eye(len(own))
    if method == "infomax":
        move = -gradient
    else:
        a = (1 + sign * slope)[:, :, None] * c[:, own, own][:, None]  # curvature of (i, j) along itself
        b = a.transpose(0, 2, 1)
        low = (a + b) / 2 - np.sqrt((a - b) ** 2 / 4 + 1)  # lesser eigenvalue of [[a, 1], [1, b]]
        lift = np.maximum(0, LEAST_CURVATURE - low)
        a, b = a + lift, b + lift
        move = -(b * gradient - gradient.transpose(0, 2, 1)) / (a * b - 1)
        move[:, own, own] = -gradient[:, own, own] / np.maximum(a[:, own, own] + 1, LEAST_CURVATURE)
    return move, np.abs(gradient).max((1, 2))


def advance(m: Unmixing, v: np.ndarray, method: str, enough: float = ENOUGH) -> bool:
    """Move the matrix on by the sums ``v``; false if its gradient is small enough to end."""
    move, gradient, m.sign = _step(v, len(m.matrix), method, m.sign if m.steps >= HELD else None)
    if method == "infomax":
        back = m.last is not None and (m.last * move).sum() < 0
        m.rate, m.last = max(LEAST_RATE, m.rate * (SLOWER if back else FASTER)), move
        move = move * m.rate
    m.gradient = gradient
    if gradient < enough:
        return False
    move = move * min(1.0, LONGEST / max(np.abs(move).max(), 1e-300))
    m.matrix, m.steps = m.matrix + move @ m.matrix, m.steps + 1
    return True


def fit(rows: DataFrame, method: str = "picard", components: int | None = None, rounds: int | None = None, enough: float = ENOUGH) -> dict[object, Unmixing]:
    """The unmixing of each signal of ``rows``, of whom there are ``MOST_SIGNALS`` at most; read once for each step."""
    if method not in ROUNDS:
        raise ValueError(f"unknown method {method}")
    model = _whitened(rows, components)
    open_ = {k for k, m in model.items() if len(m.matrix)}
    for _ in range(rounds or ROUNDS[method]):
        if not open_:
            break
        shared = rows.sparkSession.sparkContext.broadcast({k: model[k] for k in open_})

        def means(key: object, x: np.ndarray) -> np.ndarray | None:
            if key not in shared.value:  # noqa: B023
                return None
            y = shared.value[key].sources(x)  # noqa: B023
            g = np.tanh(y)
            return np.concatenate([[len(y)], (g.T @ y).ravel(), (y.T @ y).ravel(), (1 - g * g).sum(0)])

        for key, v in _sums(rows, means).items():
            if not advance(model[key], v, method, enough):
                open_.discard(key)
        shared.unpersist()
    _warn(len(open_), rounds)
    return model


def _warn(count: int, rounds: int | None) -> None:
    if count and not rounds:
        logging.getLogger(__name__).warning("%d signals were stopped before their gradient was small", count)


def kurtosis(rows: DataFrame, model: dict[object, Unmixing]) -> dict[object, np.ndarray]:
    """Excess kurtosis of each component."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def moments(key: object, x: np.ndarray) -> np.ndarray:
        y = shared.value[key].sources(x)
        return np.concatenate([[len(y)], (y**2).sum(0), (y**4).sum(0)])

    out = {}
    for key, v in _sums(rows, moments).items():
        square, fourth = np.split(v[1:] / v[0], 2)
        out[key] = fourth / np.maximum(square, 1e-300) ** 2 - 3
    return out


def fit_whole(signals: list[np.ndarray], method: str = "picard", components: int | None = None, rounds: int | None = None, enough: float = ENOUGH) -> list[Unmixing]:
    """As ``fit``, for signals (samples by channels) at hand; those of about one length are worked on together."""
    model = [_whitening(x.mean(0), (x - x.mean(0)).T @ (x - x.mean(0)) / len(x), components) for x in signals]
    alike: dict[tuple, list[int]] = {}
    for i, (x, m) in enumerate(zip(signals, model)):
        if len(m.matrix):
            alike.setdefault((len(x).bit_length(), *m.matrix.shape), []).append(i)
    for (_, d, c), at in alike.items():
        n = np.array([len(signals[i]) for i in at], float)[:, None, None]
        z = np.zeros((len(at), c, max(len(signals[i]) for i in at)))  # what fills up a signal adds nothing to its sums
        for k, i in enumerate(at):
            z[k, :, : len(signals[i])] = (signals[i] - model[i].mean).T
        w, rate, last = np.stack([model[i].matrix for i in at]), np.full(len(at), RATE), np.zeros((len(at), d, d))
        own, steps, left = np.arange(len(at)), np.zeros(len(at), int), np.full(len(at), np.inf)  # of the signals that go on: their place
        for step in range(rounds or ROUNDS[method]):
            y = w[own] @ z
            g = np.tanh(y)
            turned = y.transpose(0, 2, 1)
            means = g @ turned / n, y @ turned / n, 1 - (g * g).sum(2) / n[:, :, 0]
            sign = _signs(*means) if step < HELD else sign
            move, gradient = _moves(*means, method, sign)
            if method == "infomax":
                back = (last[own] * move).sum((1, 2)) < 0
                rate[own], last[own] = np.maximum(LEAST_RATE, rate[own] * np.where(back, SLOWER, FASTER)), move
                move = move * rate[own, None, None]
            left[own] = gradient
            on = gradient >= enough
            move = move * np.minimum(1.0, LONGEST / np.maximum(np.abs(move).max((1, 2)), 1e-300))[:, None, None]
            w[own[on]] += move[on] @ w[own[on]]
            steps[own[on]] += 1
            if not on.all():
                own, z, n, sign = own[on], z[on], n[on], sign[on]
            if not len(own):
                break
        _warn(len(own), rounds)
        for k, i in enumerate(at):
            model[i].matrix, model[i].steps, model[i].gradient, model[i].rate = w[k], int(steps[k]), float(left[k]), float(rate[k])
    return model


def _repaired_whole(rows: DataFrame, method: str, components: int | None, rounds: int | None) -> DataFrame:
    """``repaired`` of signals that a task can hold."""
    kind = rows.schema["signal_id"].dataType.simpleString()

    def clean(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        x = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), -1)
        signals = np.split(x, starts[1:])
        for own, m in zip(signals, fit_whole(signals, method, components, rounds)):
            if len(m.matrix):
                y = m.sources(own)
                square, fourth = (y**2).mean(0), (y**4).mean(0)
                k = int((fourth / np.maximum(square, 1e-300) ** 2).argmax())
                own -= np.outer(y[:, k], m.mixing()[:, k])  # a part of x
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
        return pa.RecordBatch.from_arrays([t["signal_id"].combine_chunks(), t["seq"].combine_chunks(), lists], names=["signal_id", "seq", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= WHOLE:
                t = pa.Table.from_batches(held)
                starts = _starts(t)
                if len(starts) > 1:  # the last signal may go on
                    yield clean(t.slice(0, starts[-1]), starts[:-1])
                    t = t.slice(starts[-1])
                held, size = t.to_batches(), len(t)
        if held:
            t = pa.Table.from_batches(held)
            yield clean(t, _starts(t))

    return rows.repartition("signal_id").sortWithinPartitions("signal_id").mapInArrow(run, f"signal_id {kind}, seq long, x array<double>")


def _starts(t: pa.Table) -> np.ndarray:
    """Where signals start in rows that are sorted by them."""
    code = t["signal_id"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))


def repaired(rows: DataFrame, method: str = "picard", components: int | None = None, rounds: int | None = None) -> DataFrame:
    """``rows`` without the component of the greatest kurtosis of each signal, such as blinks have."""
    rows = stored(rows.select("signal_id", "seq", "x"), "ica-rows")
    long = stored(rows.groupBy("signal_id").agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select("signal_id"), "ica-long")
    many = long.count()  # a signal for each WHOLE rows at most
    if not many:
        return _repaired_whole(rows, method, components, rounds)
    out = _repaired_whole(rows.join(F.broadcast(long), "signal_id", "left_anti"), method, components, rounds)
    rows = stored(rows.join(F.broadcast(long), "signal_id", "left_semi"), "ica-rows")
    slices = -(-many // max(1, MOST_SIGNALS // 2))
    for k in range(slices):
        own = rows.where(F.pmod(F.xxhash64("signal_id"), F.lit(slices)) == k) if slices > 1 else rows
        model = fit(own, method, components, rounds)
        spiky = {key: int(v.argmax()) for key, v in kurtosis(own, model).items() if len(v)}
        out = out.union(_without(own, model, spiky))
    return out


def _without(rows: DataFrame, model: dict[object, Unmixing], drop: dict[object, int]) -> DataFrame:
    """``rows`` minus what the component ``drop`` of each signal adds to the channels."""
    away = {key: np.outer(model[key].matrix[k], model[key].mixing()[:, k]) for key, k in drop.items()}
    shared = rows.sparkSession.sparkContext.broadcast({key: (model[key].mean, a) for key, a in away.items()})
    kind = rows.schema["signal_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, own, x in _by_signal(batch):
                if key in shared.value:
                    mean, a = shared.value[key]
                    x = x - (x - mean) @ a
                at, c = pa.array(own), x.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * c), pa.array(np.ascontiguousarray(x).ravel()))
                yield pa.record_batch([batch["signal_id"].take(at), batch["seq"].take(at), lists], ["signal_id", "seq", "x"])

    return rows.mapInArrow(run, f"signal_id {kind}, seq long, x array<double>")
