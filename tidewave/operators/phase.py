"""Time-frequency coefficients of epochs, and what epochs share.

An epoch is a bounded window of one channel. Its complex coefficients (frequencies
by samples) come from a kernel. Averages over epochs (power, inter-trial coherence)
need sums only: each batch sums its epochs before anything is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Gives coefficients (items by samples), or several such sets (tapers by items by samples).
Kernel = Callable[[np.ndarray], np.ndarray]
#: Below this power a coefficient has no phase.
LEAST_POWER = 1e-12


def _kinds(framed: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in framed.select(*keys).schema)


def coefficients(framed: DataFrame, kernel: Kernel, keys: Sequence[str]) -> DataFrame:
    """(keys, item, place, re, im, power, phase) of each epoch (keys, x: array); several tapers give their mean coefficient and power."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                z = np.asarray(kernel(batch["x"][i].values.to_numpy(zero_copy_only=False).astype(float)))
                z = z if z.ndim == 3 else z[None]
                mean, power = z.mean(0), (np.abs(z) ** 2).mean(0)
                items, places = mean.shape
                own = pa.array(np.full(mean.size, i))
                phase = pa.array(np.angle(mean).ravel(), mask=(power < LEAST_POWER).ravel())
                columns = [*(batch[k].take(own) for k in keys), pa.array(np.repeat(np.arange(items), places)), pa.array(np.tile(np.arange(places), items)), pa.array(mean.real.ravel()), pa.array(mean.imag.ravel()), pa.array(power.ravel()), phase]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "item", "place", "re", "im", "power", "phase"])

    return framed.select(*keys, "x").mapInArrow(run, f"{_kinds(framed, keys)}, item long, place long, re double, im double, power double, phase double")


def averaged(framed: DataFrame, kernel: Kernel, keys: Sequence[str]) -> DataFrame:
    """(keys, item, place, n, avg_power, itc): over the epochs of equal ``keys``, place by place.

    The coherence is the length of the mean of the coefficients' directions (with
    several tapers the mean over them). An epoch counts where it has a sample.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, dict] = {}
            for i, key in enumerate(zip(*(batch[k].to_pylist() for k in keys))):
                z = np.asarray(kernel(batch["x"][i].values.to_numpy(zero_copy_only=False).astype(float)))
                z = z if z.ndim == 3 else z[None]
                size = np.abs(z)
                unit = np.where(size**2 >= LEAST_POWER, z / np.maximum(size, 1e-300), 0)
                own = sums.setdefault((i if not keys else key), {"row": i, "parts": {}})["parts"]
                if z.shape in own:  # epochs of one length are summed
                    for held, new in zip(own[z.shape], (1, unit, size**2)):
                        held += new
                else:
                    own[z.shape] = [np.array(1), unit, size**2]
            for found in sums.values():
                for (tapers, items, places), (n, unit, power) in found["parts"].items():
                    own = pa.array(np.full(items * places, found["row"]))
                    lists = [pa.array(np.ascontiguousarray(u.reshape(tapers, -1).T).tolist(), pa.list_(pa.float64())) for u in (unit.real, unit.imag)]
                    columns = [*(batch[k].take(own) for k in keys), pa.array(np.repeat(np.arange(items), places)), pa.array(np.tile(np.arange(places), items)), pa.array(np.full(items * places, int(n))), pa.array(power.mean(0).ravel()), *lists]
                    yield pa.RecordBatch.from_arrays(columns, names=[*keys, "item", "place", "n", "power", "re", "im"])

    parts = framed.select(*keys, "x").mapInArrow(run, f"{_kinds(framed, keys)}, item long, place long, n long, power double, re array<double>, im array<double>")
    cells = parts.select(*keys, "item", "place", "n", "power", F.posexplode(F.arrays_zip("re", "im")).alias("taper", "z"))
    total = cells.groupBy(*keys, "item", "place", "taper").agg(F.sum("n").alias("n"), F.sum("power").alias("power"), F.sum("z.re").alias("re"), F.sum("z.im").alias("im"))
    itc = F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.col("n")
    return total.groupBy(*keys, "item", "place").agg(F.first("n").alias("n"), (F.first("power") / F.first("n")).alias("avg_power"), F.avg(itc).alias("itc"))
