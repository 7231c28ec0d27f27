"""Bad channels by random sample consensus, and a reference without them.

Each channel is predicted from seeded random subsets of the others by spherical
splines; the median over the subsets is compared with the channel itself, window
by window. A channel that is badly predicted in many windows is bad (Fischler and
Bolles 1981; PREP, Bigdely-Shamlo et al. 2015). A task holds a window of a signal
with its channels; votes are aggregated.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewave.functions import kernels


@dataclass(frozen=True)
class Consensus:
    """Samples of a window, number and share of channels of the subsets, least correlation, most share of bad windows."""

    window: int = 1280
    subsets: int = 50
    share: float = 0.25
    least: float = 0.75
    most_bad: float = 0.4
    seed: int = 97


@lru_cache(maxsize=64)
def _predictors(places: tuple[tuple[float, float, float], ...], subsets: int, share: float, seed: int) -> np.ndarray:
    """(subsets, channels, channels): weights of each channel's prediction; a channel never predicts itself."""
    at, c = np.array(places), len(places)
    size = min(c - 1, max(3, int(round(share * c))))
    rng, out = np.random.default_rng(seed), np.zeros((subsets, c, c))
    for k in range(subsets):
        order = rng.permutation(c)
        for j in range(c):
            others = np.sort(order[order != j][:size])
            out[k, j, others] = kernels.spherical_weights(at[others], at[j : j + 1])[0]
    return out


def correlations(x: np.ndarray, places: tuple[tuple[float, float, float], ...], how: Consensus) -> np.ndarray:
    """Of each channel of a window (samples by channels) the correlation with its prediction; 0 where one is flat."""
    guess = np.median(np.einsum("kjc,nc->knj", _predictors(places, how.subsets, how.share, how.seed), x), axis=0)
    a, b = x - x.mean(0), guess - guess.mean(0)
    scale = np.sqrt((a**2).sum(0) * (b**2).sum(0))
    return np.where(scale > 1e-12, (a * b).sum(0) / np.maximum(scale, 1e-12), 0.0)


def windows(samples: DataFrame, places: Mapping[str, tuple[float, float, float]], how: Consensus = Consensus()) -> DataFrame:
    """(signal_id, window, channel, corr) of the channels in ``places`` that have every sample of a window.

    Windows of fewer than three samples or four such channels give nothing.
    """
    names = sorted(places)
    number = F.create_map(*[F.lit(v) for k, n in enumerate(names) for v in (n, k)])
    cells = samples.select("signal_id", F.floor(F.col("seq") / how.window).alias("window"), number[F.col("channel")].alias("c"), "seq", "value").where("c is not null and value is not null and not isnan(value)")
    framed = cells.groupBy("signal_id", "window").agg(F.array_sort(F.collect_list(F.struct("c", "seq", "value"))).alias("cells"))
    framed = framed.select("signal_id", "window", "cells.c", "cells.seq", "cells.value")
    kind = samples.schema["signal_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c, seq, value = (batch[f][i].values.to_numpy(zero_copy_only=False) for f in ("c", "seq", "value"))
                times = np.unique(seq)
                have = [k for k in np.unique(c) if (c == k).sum() == len(times)]
                if len(times) < 3 or len(have) < 4:
                    continue
                x = np.stack([value[c == k] for k in have], 1).astype(float)
                corr = correlations(x, tuple(places[names[k]] for k in have), how)
                own = pa.array(np.zeros(len(have), np.int64))
                yield pa.record_batch([batch["signal_id"].slice(i, 1).take(own), batch["window"].slice(i, 1).take(own), pa.array([names[k] for k in have]), pa.array(corr)], ["signal_id", "window", "channel", "corr"])

    return framed.mapInArrow(run, f"signal_id {kind}, window long, channel string, corr double")


def bad_channels(samples: DataFrame, places: Mapping[str, tuple[float, float, float]], how: Consensus = Consensus()) -> DataFrame:
    """(signal_id, channel, windows, bad_share, bad) by the votes of all windows."""
    votes = windows(samples, places, how).groupBy("signal_id", "channel").agg(F.count("*").alias("windows"), F.avg((F.col("corr") < how.least).cast("double")).alias("bad_share"))
    return votes.withColumn("bad", F.col("bad_share") > how.most_bad)


def referenced(samples: DataFrame, places: Mapping[str, tuple[float, float, float]], how: Consensus = Consensus()) -> DataFrame:
    """``samples`` minus the mean of the channels that aren't bad, and ``bad``; a signal without a good channel stays as it is."""
    found = bad_channels(samples, places, how).where("bad").select("signal_id", "channel", "bad")
    marked = samples.join(found, ["signal_id", "channel"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    mean = marked.where("not bad").groupBy("signal_id", "seq").agg(F.avg("value").alias("mean"))
    return marked.join(mean, ["signal_id", "seq"], "left").withColumn("value", F.col("value") - F.coalesce("mean", F.lit(0.0))).drop("mean")
