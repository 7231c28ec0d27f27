"""Recursive (IIR) filters on channels of any length.

A cascade of second-order sections is a linear system: what it carries from one
sample to the next is a short vector, and over a block of ``n`` samples that vector
goes from s to P(n) s + c, where only c depends on the samples. So each block finds
its c from rest, a scan over these short vectors tells every block what it starts
from, and the blocks are filtered side by side. The scan works on groups of blocks
and on groups of groups, so no task walks through a channel.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.operators import signals
from tidewave.sources.tables import stored

#: Samples of a block, blocks of a group in the scan, samples that one matrix product covers.
BLOCK, FAN, STRIDE = 16_384, 1024, 64

Sections = tuple[tuple[float, ...], ...]


def notch(fs: float, freq: float, quality: float = 30.0) -> Sections:
    """One section that takes out ``freq``; the notch is ``freq / quality`` Hz wide at -3 dB."""
    w = 2 * np.pi * freq / fs
    gain = 1 / (1 + np.tan(w / quality / 2))
    return ((gain, -2 * gain * np.cos(w), gain, -2 * gain * np.cos(w), 2 * gain - 1),)


def butterworth(fs: float, cutoffs: Sequence[float], kind: str, order: int = 4) -> Sections:
    """Sections (b0, b1, b2, a1, a2) of a ``low``, ``high``, ``band`` or ``stop`` filter of even order, by the bilinear transform."""
    if order % 2:
        raise ValueError("the order must be even")
    edges = 2 * fs * np.tan(np.pi * np.asarray(cutoffs, float) / fs)
    poles = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    if kind in ("low", "high"):
        poles = poles * edges[0] if kind == "low" else edges[0] / poles
        at = {"low": (-1.0, -1.0), "high": (1.0, 1.0)}[kind]
        probe = 1.0 if kind == "low" else -1.0
    else:
        width, middle = edges[1] - edges[0], np.sqrt(edges[0] * edges[1])
        half = poles * width / 2 if kind == "band" else width / 2 / poles
        root = np.sqrt(half**2 - middle**2)
        poles = np.concatenate([half + root, half - root])
        centre = np.exp(2j * np.arctan(middle / (2 * fs)))
        at = (1.0, -1.0) if kind == "band" else (centre, centre.conjugate())
        probe = centre if kind == "band" else 1.0
    poles = (2 * fs + poles) / (2 * fs - poles)
    upper = poles[poles.imag > 1e-12]
    if 2 * len(upper) != len(poles):
        raise ValueError("the band is too wide for sections with complex poles")
    b = np.real(np.poly(at))
    out = []
    for p in sorted(upper, key=lambda p: (abs(p), p.real)):
        a = np.array([1, -2 * p.real, abs(p) ** 2])
        scale = abs(np.polyval(a, probe) / np.polyval(b, probe))  # gain 1 where the filter passes
        out.append((*(b * scale).tolist(), *a[1:].tolist()))
    return tuple(out)


def run(sections: Sections, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The recurrence itself, sample by sample: (output, state afterwards); two numbers of state for each section."""
    s, out = [float(v) for v in state], np.empty(len(x))
    for i, v in enumerate(x):
        v = float(v)
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            y = b0 * v + s[2 * k]
            s[2 * k], s[2 * k + 1] = b1 * v - a1 * y + s[2 * k + 1], b2 * v - a2 * y
            v = y
        out[i] = v
    return out, np.array(s)


def together(sections: Sections, xs: Sequence[np.ndarray]) -> list[np.ndarray]:
    """The outputs of ``run`` from rest for several inputs at once, a step of all for each sample."""
    sizes = np.array([len(x) for x in xs], int)
    order = np.argsort(-sizes, kind="stable")
    held = np.zeros((len(xs), sizes.max(initial=0)))
    held[np.arange(held.shape[1]) < sizes[order][:, None]] = np.concatenate([np.empty(0), *(xs[i] for i in order)])
    held, s = np.ascontiguousarray(held.T), np.zeros((2 * len(sections), len(xs)))
    for i, row in enumerate(held):
        live = np.searchsorted(-sizes[order], -i)  # inputs of more than i samples
        v = row[:live]
        for k, (b0, b1, b2, a1, a2) in enumerate(sections):
            y = b0 * v + s[2 * k, :live]
            s[2 * k, :live], s[2 * k + 1, :live] = b1 * v - a1 * y + s[2 * k + 1, :live], b2 * v - a2 * y
            v = y
        row[:live] = v
    out: list[np.ndarray] = [None] * len(xs)
    for place, i in enumerate(order):
        out[i] = held[: sizes[i], place]
    return out


class System:
    """A cascade as matrices over ``STRIDE`` samples: outputs and state from inputs and state."""

    def __init__(self, sections: Sections):
        self.sections, self.size = sections, 2 * len(sections)
        rest, unit = np.zeros(self.size), np.eye(self.size)
        tail = np.zeros(STRIDE)
        impulse = np.eye(1, STRIDE)[0]
        response = run(sections, impulse, rest)[0]
        lag = np.subtract.outer(np.arange(STRIDE), np.arange(STRIDE))
        self.outputs = np.where(lag >= 0, response[np.maximum(lag, 0)], 0.0)  # outputs by inputs
        self.seen = np.stack([run(sections, tail, u)[0] for u in unit], 1)  # outputs by state
        self.one = np.stack([run(sections, tail[:1], u)[1] for u in unit], 1)
        after = run(sections, impulse[:1], rest)[1]
        steps = [after]
        for _ in range(STRIDE - 1):
            steps.append(self.one @ steps[-1])
        self.inputs = np.stack(steps[::-1], 1)  # state by inputs
        self.powers: dict[int, np.ndarray] = {}

    def power(self, n: int) -> np.ndarray:
        """What becomes of a state over ``n`` samples without input."""
        if n not in self.powers:
            self.powers[n] = np.linalg.matrix_power(self.one, n)
        return self.powers[n]

    def apply(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``run``, by matrix products."""
        whole = len(x) // STRIDE
        parts = x[: whole * STRIDE].reshape(whole, STRIDE)
        moved, over = parts @ self.inputs.T, self.power(STRIDE)
        states = np.empty((whole + 1, self.size))
        states[0] = state
        for i in range(whole):
            states[i + 1] = over @ states[i] + moved[i]
        y = parts @ self.outputs.T + states[:-1] @ self.seen.T
        rest, end = run(self.sections, x[whole * STRIDE :], states[-1])
        return np.concatenate([y.ravel(), rest]), end


@lru_cache(maxsize=16)
def system(sections: Sections) -> System:
    return System(sections)


_KEYS = list(signals.SIGNAL)
_STATE = "signal_id {id}, channel string, block long"


def _scan(ends: DataFrame, sections: Sections, fan: int, back: bool = False) -> DataFrame:
    """(signal_id, channel, block, start) from (signal_id, channel, block, n, c): the state before each block, ``back``: coming from the last."""
    kind = ends.schema["signal_id"].dataType.simpleString()
    shape = _STATE.format(id=kind)

    def chain(t: pa.Table, start: np.ndarray) -> tuple[pa.Table, list[np.ndarray], np.ndarray, int]:
        t = t.sort_by([("block", "descending" if back else "ascending")])
        s, out, total = start, [], 0
        for n, c in zip(t["n"].to_pylist(), t["c"].to_pylist()):
            out.append(s)
            s = system(sections).power(n) @ s + np.array(c)
            total += n
        return t, out, s, total

    def starts(t: pa.Table) -> pa.Table:
        begin = np.array(t["begin"][0].as_py()) if "begin" in t.column_names else np.zeros(2 * len(sections))
        t, out, _, _ = chain(t, begin)
        return t.select([*_KEYS, "block"]).append_column("start", pa.array([s.tolist() for s in out], pa.list_(pa.float64())))

    def totals(t: pa.Table) -> pa.Table:
        t, _, end, n = chain(t, np.zeros(2 * len(sections)))
        first = t.select(_KEYS).slice(0, 1)
        first = first.append_column("block", t["group"].slice(0, 1))
        return first.append_column("n", pa.array([n], pa.int64())).append_column("c", pa.array([end.tolist()], pa.list_(pa.float64())))

    top = ends.agg(F.max("block")).first()[0]
    if top is None or top < fan:
        return ends.groupBy(*_KEYS).applyInArrow(starts, f"{shape}, start array<double>")
    grouped = ends.withColumn("group", F.floor(F.col("block") / fan))
    above = stored(grouped.groupBy(*_KEYS, "group").applyInArrow(totals, f"{shape}, n long, c array<double>"), "iir-groups")
    begins = _scan(above, sections, fan, back).select(*_KEYS, F.col("block").alias("group"), F.col("start").alias("begin"))
    return grouped.join(begins, [*_KEYS, "group"]).groupBy(*_KEYS, "group").applyInArrow(starts, f"{shape}, start array<double>")


def _alone(framed: DataFrame, ways: Sequence[bool], sections: Sections) -> DataFrame:
    """(signal_id, channel, block, y): channels of one block through the cascade from rest, once for each of ``ways`` (True: from the end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = system(sections)
        for batch in batches:
            if not batch.num_rows:
                continue
            sizes = batch["x"].value_lengths().to_numpy()
            xs = np.split(batch["x"].flatten().to_numpy(zero_copy_only=False).astype(float, copy=False), np.cumsum(sizes)[:-1])
            short = np.flatnonzero(sizes < STRIDE)
            for back in ways:
                xs = [x[::-1] for x in xs] if back else xs
                done = dict(zip(short.tolist(), together(sections, [xs[i] for i in short])))
                xs = [done[i] if i in done else own.apply(x, np.zeros(own.size))[0] for i, x in enumerate(xs)]
                xs = [x[::-1] for x in xs] if back else xs
            y = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(xs)))
            yield pa.record_batch([*(batch[k] for k in (*_KEYS, "block")), y], [*_KEYS, "block", "y"])

    kind = framed.schema["signal_id"].dataType.simpleString()
    return framed.select(*_KEYS, "block", "x").mapInArrow(run, f"{_STATE.format(id=kind)}, y array<double>")


def _cascade(framed: DataFrame, sections: Sections, fan: int, back: bool) -> DataFrame:
    """(signal_id, channel, block, y): channels of any number of blocks, which start from the states that a scan finds; ``back``: from the end."""
    order = slice(None, None, -1 if back else 1)

    @F.pandas_udf("array<double>")
    def end(x: pd.Series) -> pd.Series:
        own = system(sections)
        return pd.Series([own.apply(np.asarray(v, float)[order], np.zeros(own.size))[1].tolist() for v in x], dtype=object)

    @F.pandas_udf("array<double>")
    def through(x: pd.Series, start: pd.Series) -> pd.Series:
        own = system(sections)
        return pd.Series([own.apply(np.asarray(v, float)[order], np.asarray(s, float))[0][order].tolist() for v, s in zip(x, start)], dtype=object)

    ends = stored(framed.select(*_KEYS, "block", F.size("x").cast("long").alias("n"), end("x").alias("c")), "iir-ends")
    starts = _scan(ends, sections, fan, back)
    return framed.join(starts, [*_KEYS, "block"]).select(*_KEYS, "block", through("x", "start").alias("y"))


def _filtered(samples: DataFrame, ways: Sequence[bool], sections: Sections, size: int, fan: int) -> DataFrame:
    """``samples`` through the cascade, from rest, once for each of ``ways``; channels of less than a block need no scan."""
    framed = signals.frames(signals.blocks(samples, size), (*_KEYS, "block")).withColumn("block", F.col("block").cast("long"))
    framed = stored(framed.withColumn("n", F.size("x")), "iir-blocks")
    alone = (F.col("block") == 0) & (F.col("n") < size)
    out, several = _alone(framed.where(alone), ways, sections), framed.where(~alone)
    if not several.isEmpty():
        for i, back in enumerate(ways):
            several = _cascade(several if not i else stored(several.withColumnRenamed("y", "x"), "iir-once"), sections, fan, back)
        out = out.unionByName(several)
    return signals.core(out, size, 0).select(*_KEYS, "seq", "value")


def forward(samples: DataFrame, sections: Sections, size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``samples`` (signal_id, channel, seq from 0 on, value) through the cascade, from rest."""
    return _filtered(samples, (False,), sections, size, fan)


def both_ways(samples: DataFrame, sections: Sections, size: int = BLOCK, fan: int = FAN) -> DataFrame:
    """Forwards and then backwards, each from rest: no shift of phase, the gain squared."""
    return _filtered(samples, (False, True), sections, size, fan)
