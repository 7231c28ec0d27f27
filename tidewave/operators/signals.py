"""Selections, joins, windows and transforms of recordings, as DataFrame plans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewave.functions import kernels
from tidewave.sources.tables import stored

SIGNAL = ("signal_id", "channel")


def micros(ts: str | Column) -> Column:
    """Microseconds since the epoch of a timestamp without zone."""
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def select_labels(df: DataFrame, labels: Sequence[str], all_labels: Sequence[str], keys: Sequence[str] = ("signal_id", "seq")) -> DataFrame:
    """The named channels of a wide recording; an unknown label is an error."""
    if unknown := [x for x in labels if x not in all_labels]:
        raise ValueError(f"unknown labels: {unknown}")
    return df.select(*keys, *labels)


def label_range(labels: Sequence[str], first: str, last: str) -> list[str]:
    """Labels from ``first`` to ``last``, both included."""
    a, b = labels.index(first), labels.index(last)
    if a >= b:
        raise ValueError("a range of labels must go forwards")
    return list(labels[a : b + 1])


def select_channels(samples: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Samples of the named channels, whatever their case; none named: all."""
    return samples.where(F.lower("channel").isin([x.lower() for x in labels])) if labels else samples


def select_rows(df: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    """Rows ``start:stop:step`` of each signal."""
    out = df.where((F.col("seq") >= start) & (F.col("seq") < stop))
    return out if step == 1 else out.where((F.col("seq") - start) % step == 0)


def mask_hull(long: DataFrame, mask: Column) -> DataFrame:
    """The rows and columns of each signal that hold any masked cell: two semi-joins on the keys of the hits."""
    hit = long.where(mask)
    return long.join(hit.select("signal_id", "seq").distinct(), ["signal_id", "seq"], "left_semi").join(hit.select("signal_id", "channel").distinct(), ["signal_id", "channel"], "left_semi")


def bounds(samples: DataFrame) -> DataFrame:
    return samples.groupBy("signal_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def segment(samples: DataFrame, markers: DataFrame, before: float, after: float) -> DataFrame:
    """Samples within [marker + before, marker + after) of each marker, end exclusive.

    Markers whose edges lie outside the recording are dropped. The join is on
    the signal and a bucket of time as long as a segment, so it stays an
    equi-join however many markers there are.
    """
    x, y = int(before * 1e6), int(after * 1e6)
    size = max(1, y - x)
    inside = markers.join(bounds(samples), "signal_id").where((micros("marker_ts") + x >= micros("first_ts")) & (micros("marker_ts") + y <= micros("last_ts")))
    start = F.floor((micros("marker_ts") + x) / size)
    m = inside.select("signal_id", "marker", "marker_ts", F.explode(F.array(start, start + 1)).alias("bucket"))
    s = samples.withColumn("bucket", F.floor(micros("ts") / size))
    d = micros("ts") - micros("marker_ts")
    return s.join(m, ["signal_id", "bucket"]).where((d >= x) & (d < y)).drop("bucket")


def last_rows(samples: DataFrame, n: int, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last ``n`` rows of each key, in the given order."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))
    return samples.withColumn("__back", back).where(F.col("__back") <= n).drop("__back")


def segment_at(samples: DataFrame, pivots: DataFrame, before: float, after: float) -> DataFrame:
    """Samples of each signal within [pivot_ts + before, pivot_ts + after) of its ``pivot`` (signal_id, pivot_ts); none where an edge lies outside the signal."""
    x, y = int(before * 1e6), int(after * 1e6)
    inside = pivots.join(bounds(samples), "signal_id").where((micros("pivot_ts") + x >= micros("first_ts")) & (micros("pivot_ts") + y <= micros("last_ts"))).select("signal_id", "pivot_ts")
    gap = micros("ts") - micros("pivot_ts")
    return samples.join(inside, "signal_id").where((gap >= x) & (gap < y))


def nearest(samples: DataFrame, targets: DataFrame, tolerance: float) -> DataFrame:
    """For each target (signal_id, target_ts) the nearest sample within ``tolerance`` seconds, the earlier of equals."""
    size = max(1, int(tolerance * 1e6))
    s = samples.select("signal_id", F.floor(micros("ts") / size).alias("bucket"), "ts", "channel", "value", "seq")
    own = F.floor(micros("target_ts") / size)
    t = targets.withColumn("bucket", F.explode(F.sequence(own - 1, own + 1)))  # the targets are fewer
    gap = F.abs(micros("ts") - micros("target_ts"))
    found = t.join(s, ["signal_id", "bucket"]).where(gap <= size)
    best = F.min_by(F.struct("ts", "channel", "seq", "value"), F.struct(gap, F.col("ts"), F.col("channel"), F.col("seq")))
    return found.groupBy("signal_id", "target_ts").agg(best.alias("s")).select("signal_id", "target_ts", "s.*")


def windows(samples: DataFrame, length: float, step: float | None = None, margin: float = 0.0) -> DataFrame:
    """Rows of sliding windows of ``length`` seconds every ``step`` (none: ``length``) from each signal's first sample on.

    A window that ends beyond the last sample by more than ``margin`` is dropped.
    """
    size, hop, slack = int(length * 1e6), int(min(step or length, length) * 1e6), int(margin * 1e6)
    if hop <= 0:
        raise ValueError("a window must move on")
    df = samples.join(bounds(samples), "signal_id")
    at, whole = micros("ts") - micros("first_ts"), micros("last_ts") - micros("first_ts")
    df = df.withColumns({"at": at, "most": F.floor((whole - size + slack) / hop)})
    first = F.greatest(F.lit(0), F.floor((F.col("at") - size) / hop) + 1)
    last = F.least(F.floor(F.col("at") / hop), F.col("most"))
    df = df.where(last >= first).withColumn("window_id", F.explode(F.sequence(first, last)))
    return df.drop("at", "most", "first_ts", "last_ts")


def percent_step(length: float, percent: float) -> float:
    """Step of windows that overlap by ``percent`` (0 to 0.99)."""
    return (1 - min(percent, 0.99)) * length


def fir_columns(taps: Sequence[float], centre: int = 0, keys: Sequence[str] = SIGNAL) -> Column:
    """A short FIR filter as a sum of lags; ``centre`` samples of delay are taken out."""
    w = Window.partitionBy(*keys).orderBy("seq")
    total = F.lit(0.0)
    for k, h in enumerate(taps):
        total = total + F.lit(float(h)) * F.coalesce(F.lag("value", k - centre).over(w) if k >= centre else F.lead("value", centre - k).over(w), F.lit(0.0))
    return total


def reference_average(samples: DataFrame) -> DataFrame:
    """Subtracts the mean over channels at each sample of a signal."""
    return samples.withColumn("value", F.col("value") - F.avg("value").over(Window.partitionBy("signal_id", "seq")))


def reference_robust(samples: DataFrame, rounds: int = 4, limit: float = 3.0) -> tuple[DataFrame, DataFrame]:
    """Average reference without bad channels: (samples, bad channels). Channels of odd spread go, up to ``rounds`` times."""
    bad = samples.select("signal_id", "channel").limit(0)
    out = samples
    for _ in range(rounds):
        good = samples.join(bad, ["signal_id", "channel"], "left_anti")
        mean = good.groupBy("signal_id", "seq").agg(F.avg("value").alias("m"))
        out = samples.join(mean, ["signal_id", "seq"]).withColumn("value", F.col("value") - F.col("m")).drop("m")
        spread = out.groupBy("signal_id", "channel").agg(F.stddev_samp("value").alias("s"))
        middle = spread.groupBy("signal_id").agg(F.percentile("s", 0.5).alias("mid"), (F.percentile("s", 0.75) - F.percentile("s", 0.25)).alias("iqr"))
        found = spread.join(middle, "signal_id").where(F.abs(F.col("s") - F.col("mid")) > limit * 0.7413 * F.col("iqr")).select("signal_id", "channel")
        new = stored(found.join(bad, ["signal_id", "channel"], "left_anti"), "bad-channels")  # a round's plan doesn't hold those before
        if new.isEmpty():
            break
        bad = bad.union(new).distinct()
    return out, bad


def interpolate(samples: DataFrame, weights: DataFrame) -> DataFrame:
    """``samples`` with the channels ``bad`` of ``weights`` (bad, channel, w: a few rows) replaced by weighted sums of others, wherever all of these have a sample."""
    need = F.broadcast(weights.groupBy("bad").agg(F.count("*").alias("need")))  # a row for each bad channel
    parts = samples.join(F.broadcast(weights), "channel").groupBy("signal_id", "seq", "bad").agg(F.sum(F.col("value") * F.col("w")).alias("value"), F.count("*").alias("n"))
    made = parts.join(need, "bad").where("n = need").select("signal_id", "seq", F.col("bad").alias("channel"), "value")
    kept = samples.join(F.broadcast(weights.select(F.col("bad").alias("channel")).distinct()), "channel", "left_anti")
    return kept.select("signal_id", "seq", "channel", "value").unionByName(made)


def monotonic(samples: DataFrame) -> DataFrame:
    """Time stamps of each channel that never go back: the greatest so far."""
    return samples.withColumn("ts", F.max("ts").over(Window.partitionBy(*SIGNAL).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def dejittered(samples: DataFrame) -> DataFrame:
    """Time stamps (microseconds ``us``; ``fit``, before they are rounded) of each channel on the straight line that fits them."""
    start = samples.groupBy(*SIGNAL).agg(F.min(micros("ts")).alias("origin"))
    at = samples.join(start, list(SIGNAL)).withColumn("late", (micros("ts") - F.col("origin")).cast("double"))
    line = at.groupBy(*SIGNAL).agg(F.regr_slope("late", "seq").alias("slope"), F.regr_intercept("late", "seq").alias("base"))
    fit = F.col("origin") + F.coalesce(F.col("base") + F.col("slope") * F.col("seq"), F.col("late"))
    return at.join(line, list(SIGNAL)).select(*SIGNAL, "seq", F.round(fit).cast("long").alias("us"), "value", fit.alias("fit"))


def latest(left: DataFrame, right: DataFrame, value: str) -> DataFrame:
    """``left`` (signal_id, ts, ...) with the last ``value`` of ``right`` at or before each time stamp: one sort of both, no join of ranges."""
    order = Window.partitionBy("signal_id").orderBy("ts", "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = right.select("signal_id", "ts", F.lit(0).alias("__side"), F.col(value)).unionByName(left.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(order)).where("__side = 1").drop("__side")


def noisy_channels(samples: DataFrame, flat: float = 1e-9) -> DataFrame:
    """Whether each channel holds NaN or null, or is flat."""
    v = F.col("value")
    return samples.groupBy(*SIGNAL).agg(F.max(F.isnan(v) | v.isNull()).alias("has_nan"), (F.coalesce(F.stddev_pop(v), F.lit(0.0)) < flat).alias("is_flat"))


def frames(samples: DataFrame, keys: Sequence[str] = SIGNAL) -> DataFrame:
    """One row of each channel (and window, if among ``keys``) with its values in order: ``x``."""
    ordered = F.array_sort(F.collect_list(F.struct("seq", "value")))
    return samples.groupBy(*keys).agg(F.transform(ordered, lambda r: r["value"]).alias("x"))


def blocks(samples: DataFrame, size: int, overlap: int = 0) -> DataFrame:
    """``samples`` with the ``block`` of ``size`` samples of its channel that each is in, and again where it is within ``overlap`` of another."""
    at = lambda shift: F.floor((F.col("seq") + shift) / size)
    return samples.withColumn("block", F.explode(F.sequence(F.greatest(F.lit(0), at(-overlap)), at(overlap))))


def core(framed: DataFrame, size: int, overlap: int, column: str = "y") -> DataFrame:
    """The arrays of ``blocks`` without what overlaps, as rows again."""
    skip = F.least(F.col("block") * size, F.lit(overlap)).cast("int")
    rows = spread(framed.withColumn(column, F.slice(column, skip + 1, size)), column)
    return rows.withColumn("seq", F.col("seq") + F.col("block") * size).drop("block")


def transform(framed: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], out: str = "y") -> DataFrame:
    """``framed`` with the array that ``kernel`` makes of each ``x``, in Arrow batches."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: np.atleast_1d(np.asarray(kernel(np.asarray(v, float)), float)).tolist())

    return framed.withColumn(out, run("x"))


def spread(framed: DataFrame, column: str = "y", value: str = "value", seq: str = "seq") -> DataFrame:
    """Arrays as rows again."""
    keep = [c for c in framed.columns if c not in (column, "x")]
    return framed.select(*keep, F.posexplode(column).alias(seq, value)).withColumn(seq, F.col(seq).cast("long"))


def pairs(framed: DataFrame, diagonal: bool = False, by: Sequence[str] = ("signal_id",)) -> DataFrame:
    """Each two channels of a signal with their arrays ``xa``, ``xb``; the channels of a signal are few."""
    a = framed.select(*by, F.col("channel").alias("a"), F.col("x").alias("xa"))
    b = framed.select(*by, F.col("channel").alias("b"), F.col("x").alias("xb"))
    return a.join(b, list(by)).where(F.col("a") <= F.col("b") if diagonal else F.col("a") < F.col("b"))


def couple(paired: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], float], out: str) -> DataFrame:
    """``kernel`` of the two arrays of each pair, cut to equal length."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):  # noqa: ANN001, ANN202
            n = min(len(x), len(y))
            return float(kernel(np.asarray(x[:n], float), np.asarray(y[:n], float))) if n > 1 else None

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return paired.withColumn(out, run("xa", "xb")).drop("xa", "xb")


def spectrum(samples: DataFrame, fs: float, size: int = 256, segments: int = 64, pick: np.ndarray | None = None) -> DataFrame:
    """(signal_id, channel, bin, freq, power): Welch's density of each channel, a mean over segments of ``size`` samples.

    ``pick`` (rows by bins) gives sums of bins in place of bins, before anything
    is shuffled; ``bin`` then counts its rows, and ``freq`` means nothing.

    A task holds blocks of ``segments`` segments; a channel shorter than one is
    one segment, filled up with zeros, and what a longer one has beyond its last
    whole segment is left out.
    """
    block = F.floor(F.col("seq") / (size * segments)).alias("block")
    framed = frames(samples.select(*SIGNAL, block, "seq", "value"), (*SIGNAL, "block"))

    @F.pandas_udf("array<double>")
    def sums(x: pd.Series, block: pd.Series) -> pd.Series:
        def one(v, b):  # noqa: ANN001, ANN202
            whole = len(v) // size
            if not whole and b:
                return None
            power = kernels.welch(np.asarray(v, float)[: whole * size] if whole else np.asarray(v, float), fs, size)[1] * max(1, whole)
            return (power if pick is None else pick @ power).tolist()

        return pd.Series([one(v, b) for v, b in zip(x, block)], dtype=object)

    parts = F.greatest(F.lit(1), F.floor(F.size("x") / size)).alias("n")
    each = framed.select(*SIGNAL, parts, sums("x", "block").alias("p")).where("p is not null").select(*SIGNAL, "n", F.posexplode("p").alias("bin", "p"))
    mean = each.groupBy(*SIGNAL, "bin").agg((F.sum("p") / F.sum("n")).alias("power"))
    return mean.select(*SIGNAL, F.col("bin").cast("long").alias("bin"), (F.col("bin") * fs / size).alias("freq"), "power")


def without_lines(samples: DataFrame, fitted: DataFrame, fs: float, freq: float) -> DataFrame:
    """``samples`` without the sines of ``freq`` and its harmonics that fit ``fitted`` (the same keys) by least squares.

    The normal equations are sums over each channel, so no channel is gathered.
    A channel of no more samples than unknowns stays as it is.
    """
    waves = [w(F.lit(2 * np.pi * f / fs) * F.col("seq")) for f in np.arange(freq, fs / 2, freq) for w in (F.sin, F.cos)]
    k = len(waves)
    products = [F.sum(waves[i] * waves[j]) for i in range(k) for j in range(k)]
    sums = fitted.groupBy(*SIGNAL).agg(F.count("*").alias("n"), F.array(*products).alias("gram"), F.array(*[F.sum(w * F.col("value")) for w in waves]).alias("right"))

    @F.pandas_udf("array<double>")
    def solve(gram: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([np.linalg.lstsq(np.reshape(g, (k, k)), np.asarray(r, float), rcond=None)[0].tolist() for g, r in zip(gram, right)], dtype=object)

    found = sums.select(*SIGNAL, F.when(F.col("n") > k, solve("gram", "right")).otherwise(F.array_repeat(F.lit(0.0), k)).alias("h"))
    fit = sum((F.col("h")[i] * w for i, w in enumerate(waves)), F.lit(0.0))
    return samples.join(found, list(SIGNAL)).select(*SIGNAL, "seq", F.round(F.col("value") - fit, 6).alias("value"))


def polyphase(samples: DataFrame, taps: Sequence[float], up: int, down: int) -> DataFrame:
    """Rate change by ``up / down``: each sample is dealt out to the few outputs that its taps reach, and these are summed."""
    h, delay = [float(x) for x in taps], (len(taps) - 1) // 2
    n = samples.groupBy(*SIGNAL).agg(F.max("seq").alias("last"))
    reach = samples.join(n, list(SIGNAL))
    first = F.greatest(F.lit(0), F.ceil((F.col("seq") * up - delay) / down))
    last = F.least(F.floor((F.col("seq") * up + len(h) - 1 - delay) / down), F.floor((F.col("last") + 1) * up / down) - 1)
    out = reach.where(last >= first).select(*SIGNAL, "seq", "value", F.explode(F.sequence(first, last)).alias("m"))
    weight = F.element_at(F.array(*map(F.lit, h)), (F.col("m") * down + delay - F.col("seq") * up + 1).cast("int")) * up
    return out.groupBy(*SIGNAL, F.col("m").alias("seq")).agg(F.sum(F.col("value") * weight).alias("value"))
