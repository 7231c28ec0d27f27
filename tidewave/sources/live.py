"""A streaming source that follows XDF recordings while they are written.

``spark.readStream.format("xdf-live")`` gives the samples of all files below a
folder as their chunks arrive. An offset tells for each file up to which byte its
whole chunks were taken and how many samples of each stream came before, so a
query that starts again from its checkpoint goes on where it stopped: nothing is
lost and nothing comes twice. A chunk that is not whole yet waits. A trigger's
bytes are read in ranges of ``part_bytes``, each by a task; many small ones share a task.

Offsets hold an entry for each file. Clock offsets are not applied, as later ones
would change what was given before; a time stamp that lacks is null where none
comes before it in its range.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewave.sources import xdf

SCHEMA = "file string, stream string, seq long, ts double, channel string, value double, text string"


def _walk(recording: xdf.Recording, at: int, counts: dict[str, int], stop: int) -> Iterator[tuple[int, dict[str, int]]]:
    """(end of a chunk, samples of each stream up to there) of the whole chunks from ``at`` to ``stop``."""
    counts = dict(counts)
    while at < stop:
        head = recording.at(at, 11)
        if len(head) < 2 or len(head) < 1 + head[0] + 2:
            return
        size, begin = xdf._length(head, 0)
        end = at + begin + size
        if end > stop:
            return
        if struct.unpack_from("<H", head, begin)[0] == xdf.SAMPLES:
            body = recording.at(at + begin + 2, 13)
            stream = str(struct.unpack("<I", body[:4])[0])
            counts[stream] = counts.get(stream, 0) + xdf._length(body, 4)[0]
        yield end, dict(counts)
        at = end


def _joined(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    return pa.Table.from_batches(batches).combine_chunks().to_batches() if batches else []


class LiveReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.part_bytes = options["path"], int(options.get("part_bytes", xdf.PART_BYTES))
        self.known: dict[str, dict] = {}

    def _store(self):  # noqa: ANN202
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """The end of the last whole chunk of each file; walks on from what it found the last time."""
        from pyarrow import fs

        store, top = self._store()
        store.create_dir(top, recursive=True)
        for f in store.get_file_info(fs.FileSelector(top, recursive=True)):
            if f.is_file and f.extension == "xdf" and f.size > 4:
                own = self.known.get(f.path, {"at": 4, "counts": {}})
                with store.open_input_file(f.path) as file:
                    recording = xdf.Recording(file)
                    if recording.at(0, 4) != xdf.MAGIC:
                        raise ValueError("not an XDF file")
                    for end, counts in _walk(recording, own["at"], own["counts"], recording.size):
                        own = {"at": end, "counts": counts}
                self.known[f.path] = own
        return {k: self.known[k] for k in sorted(self.known)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        store, _ = self._store()
        out = []
        for path, to in end.items():
            own = start.get(path, {"at": 4, "counts": {}})
            if own["at"] >= to["at"]:
                continue
            if to["at"] - own["at"] <= self.part_bytes:
                out.append((path, own["at"], to["at"], own["counts"]))
                continue
            with store.open_input_file(path) as file:
                begin = own
                for at, counts in _walk(xdf.Recording(file), own["at"], own["counts"], to["at"]):
                    if at - begin["at"] >= self.part_bytes or at == to["at"]:
                        out.append((path, begin["at"], at, begin["counts"]))
                        begin = {"at": at, "counts": counts}
        tasks = xdf.shared([(*r, r[2] - r[1]) for r in out])
        return [InputPartition([r[:4] for r in task]) for task in tasks]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = self._store()
        held, size = [], 0
        for path, start, stop, counts in partition.value:
            for rows in self._range(store, path, start, stop, counts):
                held.append(rows)
                size += rows.num_rows
                if size >= xdf.BATCH_VALUES:
                    yield from _joined(held)
                    held, size = [], 0
        yield from _joined(held)

    def _range(self, store, path: str, start: int, stop: int, counts: dict[str, int]) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
        counts, stamps = dict(counts), {}
        with store.open_input_file(path) as file:
            recording = xdf.Recording(file)
            heads = recording.heads(stop=stop)
            for tag, a, b in recording.chunks(start, stop):
                if tag == xdf.SAMPLES:
                    body = recording.at(a, b - a)
                    if body[:4] not in heads:
                        heads |= recording.heads(body[:4])
                    yield self._rows(path, heads[body[:4]], body, counts, stamps)

    @staticmethod
    def _rows(path: str, head: xdf.Head, body: bytes, counts: dict[str, int], stamps: dict[str, tuple[float, int]]) -> pa.RecordBatch:
        stream = str(struct.unpack("<I", body[:4])[0])
        ts, x = xdf._samples(body, head.labels, head.fmt)
        n, c, at = len(ts), len(head.labels), counts.get(stream, 0)
        counts[stream] = at + n
        ts = xdf._stamps(ts, at, head.rate, *stamps.get(stream, (float("nan"), at - 1)))
        if n and not np.isnan(ts[-1]):
            stamps[stream] = (float(ts[-1]), at + n - 1)
        text, number = (x.ravel().tolist(), None) if head.fmt == "string" else (None, x.ravel())
        values = pa.array(number, pa.float64(), from_pandas=True) if number is not None else pa.nulls(n * c, pa.float64())
        columns = [pa.array([path] * (n * c), pa.string()), pa.array([head.name] * (n * c), pa.string()), pa.array(np.repeat(head.first + at + np.arange(n), c)), pa.array(np.repeat(ts, c), from_pandas=True), pa.array(head.labels * n, pa.string()), values, pa.array(text, pa.string()) if text is not None else pa.nulls(n * c, pa.string())]
        return pa.record_batch(columns, ["file", "stream", "seq", "ts", "channel", "value", "text"])


class LiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xdf-live"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LiveReader:  # noqa: ANN001
        return LiveReader(dict(self.options))


def follow(spark: SparkSession, path: str, part_bytes: int = 0) -> DataFrame:
    """The samples of the recordings below ``path`` as a stream; cells without a value are left out."""
    spark.dataSource.register(LiveSource)
    found = spark.readStream.format("xdf-live").option("part_bytes", part_bytes or xdf.PART_BYTES).load(path)
    return found.where("value is not null or text is not null")
