"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewave.sources.tables import scratch

#: ASCII white space: what separates words (space, tab, LF, VT, FF, CR).
SPACE = r"[\x20\x09-\x0D]+"
NGRAM = 5
SIMILAR_PERCENT = 80
#: Texts are hashed in runs of about so many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of one table, read with Spark's own reader."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``."""
    return scratch(spark, "any").rpartition("/")[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within the block, Python workers get batches of so many rows, so that texts take little memory on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(*frames: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``frames``, once all that reads them has been written itself.

    Spark's cleaner then also frees the shuffle files of plans that nothing refers to any more.
    """
    for df in frames:
        spark = df.sparkSession
        own = shared_dir(spark).partition(":")[2].lstrip("/")
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if own in folder:  # nothing but spent tables
                path = spark._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    frames[0].sparkSession._jvm.System.gc()


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Columns that operators on documents look at.
OWN = ("doc_id", "text", "lang", "source", "n_chars")


def plain_names(docs: DataFrame) -> DataFrame:
    """``docs`` with further columns named by their place, so that none clashes or needs quotes; ``toDF`` gives their names back."""
    return docs.toDF(*[c if c in OWN else f"further{i}" for i, c in enumerate(docs.columns)])


def words(text: Column) -> Column:
    """Array of the words of a text (null: none), cut at ASCII white space only."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, elementwise on uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, *range(9, 14)]] = True
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of an odd base modulo 2^64, kept up to the longest run seen."""

    def __init__(self, base: int):
        self.base, self.known = np.uint64(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.known) < n:
            steps = np.full(n, self.base)
            steps[0] = 1
            self.known = np.cumprod(steps, dtype=np.uint64)
        return self.known[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_INVERSE)


class Run:
    """The words of some consecutive texts: ``hashes`` of all, text ``i`` owning ``ends[i-1]:ends[i]``.

    ``starts`` and ``stops`` are the words' byte positions in ``data``.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        self.data = data
        solid = ~_IS_SPACE[data]
        before = np.zeros(len(data), bool)
        before[1:] = solid[:-1]
        first = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[first] = False
        starts = np.flatnonzero(solid & ~before)
        after = np.zeros(len(data), bool)
        after[:-1] = solid[1:]
        after[offsets[1:][offsets[:-1] < offsets[1:]] - 1] = False
        self.starts, self.stops = starts, np.flatnonzero(solid & ~after) + 1
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _UP.upto(len(data)), out=sums[1:])
        self.hashes = mix((sums[self.stops] - sums[starts]) * _DOWN.upto(len(data) + 1)[starts] + (self.stops - starts).astype(np.uint64))
        self.ends = np.searchsorted(starts, offsets[1:], side="left")

    def of(self, i: int) -> slice:
        return slice(self.ends[i - 1] if i else 0, self.ends[i])

    def ngrams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``n`` words from each word on, and whether they lie in one text."""
        h = ngram_hashes(self.hashes, n)
        text = np.repeat(np.arange(len(self.ends)), np.diff(self.ends, prepend=0))
        return h, text[: len(h)] == text[n - 1 :] if len(h) else np.zeros(0, bool)


def runs(texts: pa.Array, lower: bool) -> Iterator[tuple[int, Run]]:
    """Cut a column of texts (null: empty) into runs; gives the index of the first text and the run."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + RUN_BYTES, side="right")) - 1)
        yield at, Run(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower)
        at = to


def ngram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` word hashes; empty if there are fewer."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(_BASE) + hashes[j : j + len(out)]
    return mix(out)


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(run: Run, n: int = NGRAM) -> list[np.ndarray]:
    """Of each text of a run the sorted distinct shingle hashes.

    A shorter sequence of words is one shingle, no words are none.
    """
    h = ngram_hashes(run.hashes, n)
    out = []
    for i in range(len(run.ends)):
        s = run.of(i)
        size = s.stop - s.start
        out.append(distinct(h[s.start : s.stop - n + 1]) if size >= n else ngram_hashes(run.hashes[s], size) if size else h[:0])
    return out


class Filter:
    """A Bloom filter of bounded size for the 64-bit keys of a DataFrame.

    About 12 bits for a key, 32 MB at most: beyond that it lets more strangers
    through, but it never misses a key.
    """

    LEAST_BITS, MOST_BITS, SEGMENT = 19, 28, 19

    def __init__(self, bits: int):
        self.bits, self.data = bits, np.zeros(1 << (bits - 3), np.uint8)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        h, most = mix(keys), np.uint64((1 << self.bits) - 1)
        return np.concatenate([h & most, (h >> np.uint64(32)) & most]).astype(np.int64)

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = self._at(keys)
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).reshape(2, -1).all(0)

    @classmethod
    def of(cls, keys: DataFrame, column: str) -> Filter:
        """Built in segments on the executors, put together on the driver. ``keys`` is read twice."""
        n = keys.count()
        out = cls(min(cls.MOST_BITS, max(cls.LEAST_BITS, (12 * n).bit_length())))
        mask = (1 << cls.SEGMENT) - 1

        def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shape = cls(out_bits)
            for batch in batches:
                at = np.unique(shape._at(batch[column].to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)))
                yield pa.record_batch([pa.array((at >> cls.SEGMENT).astype(np.int32)), pa.array((at & mask).astype(np.int32))], ["segment", "bit"])

        def build(t: pa.Table) -> pa.Table:
            bits = np.zeros(mask + 1, bool)
            bits[t["bit"].to_numpy()] = True
            return pa.table({"segment": t["segment"][:1], "data": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

        out_bits = out.bits
        made = keys.select(column).mapInArrow(positions, "segment int, bit int").groupBy("segment").applyInArrow(build, "segment int, data binary")
        for row in made.toLocalIterator():  # 2^MOST_BITS bits at most
            part = np.frombuffer(row["data"], np.uint8)
            out.data[row["segment"] * len(part) : (row["segment"] + 1) * len(part)] = part
        return out


#: Edges that one task of a star operation writes, and its least number of tasks.
EDGES_PER_TASK, LEAST_TASKS = 500_000, 12


def _stars(pairs: DataFrame) -> tuple[bool, int]:
    """Whether each node of ``pairs`` (x, y) has one y or is one, never both; and the number of pairs."""
    ends = pairs.select(F.col("x").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into"))
    ends = ends.union(pairs.select("y", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    chained = (F.col("out") > 1) | ((F.col("out") > 0) & (F.col("into") > 0))
    row = nodes.agg(F.count(F.when(chained, 1)).alias("chained"), F.coalesce(F.sum("out"), F.lit(0)).alias("pairs")).first()
    return row["chained"] == 0, row["pairs"]


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): the smallest node that links reach, for all nodes of ``edges``.

    Alternates the two star operations of "Connected Components in MapReduce and
    Beyond" (Kiveris et al. 2014) until only stars are left; each node's smallest
    neighbour is found with partial aggregation, so a hub is no hot group. Files
    and tasks grow with the number of edges.
    """
    pairs = edges.select(F.greatest(a, b).alias("x"), F.least(a, b).alias("y")).where("x <> y").distinct()
    pairs = materialize(pairs, "links")
    while True:
        done, n = _stars(pairs)
        if done:
            break
        tasks = max(LEAST_TASKS, n // EDGES_PER_TASK)
        both = pairs.union(pairs.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").distinct()
        large = materialize(large.coalesce(tasks), "links")
        least = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).where("x <> y").union(least.select("x", F.col("m").alias("y"))).distinct()
        pairs = materialize(small.coalesce(tasks), "links")
    return pairs.select(F.col("x").alias("node"), F.col("y").alias("root")).union(pairs.select("y", "y").distinct())
