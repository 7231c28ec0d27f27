"""XDF files: chunked streams of samples, written to and read from a store that all executors reach.

Files are read by a Python data source in ranges of bytes, so a recording may be
larger than a task.

A chunk is a length of variable width, a tag and its content. Tags: 1 file
header, 2 stream header, 3 samples, 4 clock offset, 5 boundary, 6 stream footer.
Streams hold numbers, or text (markers). Where a stream has clock offsets, its
time stamps are corrected by what lies between them.
"""

from __future__ import annotations

import struct
import uuid
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import groupby
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidewave.sources.tables import stored

# Fixed values of the format.
MAGIC = b"XDF:"
FILE_HEADER, STREAM_HEADER, SAMPLES, CLOCK_OFFSET, BOUNDARY, STREAM_FOOTER = range(1, 7)
DTYPES = {"float32": "<f4", "double64": "<f8", "int8": "<i1", "int16": "<i2", "int32": "<i4", "int64": "<i8"}
BOUNDARY_MARK = bytes.fromhex("43a546dccbf5410fb30ed5467383cbe4")

#: Samples in a chunk, between two boundaries.
CHUNK_ROWS = 4096
#: Of what ``read`` gives; ``text`` is for streams of markers, ``value`` for the others.
SCHEMA = "stream string, seq long, ts double, channel string, value double, text string"
#: Samples of a file, bytes of a range that one task reads, bytes in which a boundary mark is searched at once.
FILE_ROWS, PART_BYTES, SEARCH_BYTES = 1 << 20, 64 << 20, 1 << 20
#: Ranges up to whose number each is a task; of more, neighbours share one up to ``PART_BYTES`` or a share of 1 / ``LEAST_TASKS`` of all, with what a file and a range add to their bytes.
MOST_TASKS, LEAST_TASKS, OPEN_BYTES, RANGE_BYTES = 1024, 64, 1 << 18, 1 << 14
#: Rows and values that go to Spark at once.
BATCH_ROWS, BATCH_VALUES = 1024, 1 << 18
#: Ranges and streams up to whose number their places are broadcast.
MOST_PLACES = 100_000


def _sized(n: int) -> bytes:
    for width, kind in ((1, "<B"), (4, "<I"), (8, "<Q")):
        if n < 1 << 8 * width:
            return bytes([width]) + struct.pack(kind, n)
    raise ValueError("too long")


def _chunk(tag: int, content: bytes) -> bytes:
    return _sized(len(content) + 2) + struct.pack("<H", tag) + content


def _tag(name: str, inner: object, plain: bool = True) -> str:
    """An element of XML; ``plain``: what it holds is text, not elements."""
    inner = escape(str(inner)) if plain else inner
    return f"<{name}>{inner}</{name}>" if inner else f"<{name} />"


@lru_cache(maxsize=1024)
def _described(kind: str, rate: float, labels: tuple[str, ...], fmt: str, unit: str, first: int) -> str:
    """What a stream header holds after the name."""
    info = "".join(_tag(k, v) for k, v in (("type", kind), ("channel_count", len(labels)), ("nominal_srate", rate), ("channel_format", fmt)))
    channels = "".join(_tag("channel", _tag("label", label or "") + _tag("unit", unit) + _tag("type", kind), False) for label in labels)
    return info + _tag("desc", (_tag("first_sample", first) if first else "") + _tag("channels", channels, False), False)


def _header(name: str, kind: str, rate: float, labels: list[str], fmt: str, unit: str, first: int = 0) -> bytes:
    info = _tag("info", _tag("name", name) + _described(kind, rate, tuple(labels), fmt, unit, first), False)
    return info.encode("ascii", "xmlcharrefreplace")


@lru_cache(maxsize=256)
def _row(fmt: str, channels: int) -> np.dtype:
    """A sample with its time stamp."""
    return np.dtype([("has", "u1"), ("ts", "<f8"), ("x", DTYPES[fmt], (channels,))])


def encode(name: str, kind: str, rate: float, labels: list[str], ts: np.ndarray, x: np.ndarray, fmt: str = "double64", offsets: list[tuple[float, float]] = (), unit: str = "", first: int = 0) -> bytes:
    """One stream (samples by channels; text where ``fmt`` is string) as a file, with its clock offsets (time, offset).

    ``first`` is the number of its first sample if the recording began in another file.
    """
    if fmt == "string" and rate:
        raise ValueError("a stream of markers has no regular rate")
    footer = _tag("first_timestamp", repr(float(ts[0] if len(ts) else 0))) + _tag("last_timestamp", repr(float(ts[-1] if len(ts) else 0))) + _tag("sample_count", len(ts))
    one = struct.pack("<I", 1)
    out = [MAGIC, _chunk(FILE_HEADER, b"<?xml version='1.0'?><info><version>1.0</version></info>"), _chunk(STREAM_HEADER, one + _header(name, kind, rate, labels, fmt, unit, first))]
    for at in range(0, max(1, len(ts)), CHUNK_ROWS):
        t, part = ts[at : at + CHUNK_ROWS], x[at : at + CHUNK_ROWS]
        if fmt == "string":
            texts = ([str(v).encode() for v in row] for row in part)
            body = b"".join(b"\x08" + struct.pack("<d", when) + b"".join(_sized(len(v)) + v for v in row) for when, row in zip(t, texts))
        else:
            rows = np.empty(len(t), _row(fmt, len(labels)))
            rows["has"], rows["ts"], rows["x"] = 8, t, part
            body = rows.tobytes()
        out += [_chunk(SAMPLES, one + _sized(len(t)) + body), _chunk(BOUNDARY, BOUNDARY_MARK)]
    out += [_chunk(CLOCK_OFFSET, one + struct.pack("<dd", when, by)) for when, by in offsets]
    return b"".join([*out, _chunk(STREAM_FOOTER, one + _tag("info", footer, False).encode())])


def _length(data: bytes, at: int) -> tuple[int, int]:
    width = data[at]
    return int.from_bytes(data[at + 1 : at + 1 + width], "little"), at + 1 + width


def _samples(body: bytes, labels: list[str], fmt: str) -> tuple[np.ndarray, np.ndarray]:
    """Time stamps (NaN where they lack) and values of a chunk."""
    n, p = _length(body, 4)
    if fmt != "string":
        row = _row(fmt, len(labels))
        if len(body) - p == n * row.itemsize:
            rows = np.frombuffer(body, row, n, p)
            if (rows["has"] == 8).all():
                return rows["ts"].astype(float), rows["x"].astype(float)
    ts, x = np.zeros(n), []
    for i in range(n):
        has, p = body[p], p + 1
        ts[i] = struct.unpack_from("<d", body, p)[0] if has else np.nan
        p += has
        if fmt == "string":
            row = []
            for _ in labels:
                size, p = _length(body, p)
                row.append(body[p : p + size].decode())
                p += size
            x.append(row)
        else:
            kind = np.dtype(DTYPES[fmt])
            x.append(np.frombuffer(body, kind, len(labels), p).astype(float))
            p += kind.itemsize * len(labels)
    return ts, np.array(x, object if fmt == "string" else float).reshape(n, len(labels))


@dataclass(frozen=True)
class Head:
    """What a stream header tells."""

    name: str
    labels: list[str]
    fmt: str
    rate: float
    first: int

    @classmethod
    def of(cls, body: bytes) -> Head:
        info = ET.fromstring(body[4:].decode())
        labels = [c.text or "" for c in info.iterfind("desc/channels/channel/label")] or [f"channel_{i}" for i in range(int(info.findtext("channel_count")))]
        return cls(info.findtext("name"), labels, info.findtext("channel_format"), float(info.findtext("nominal_srate")), int(info.findtext("desc/first_sample") or 0))


class Recording:
    """A file in a store that ``pyarrow`` reaches, walked through from chunk to chunk without reading what isn't asked for."""

    def __init__(self, file):  # noqa: ANN001
        self.file, self.size = file, file.size()

    def at(self, where: int, n: int) -> bytes:
        self.file.seek(where)
        return self.file.read(n)

    def after_mark(self, where: int) -> tuple[int, int]:
        """(start, end) of the first boundary mark that starts at ``where`` or later; the end of the file if there is none."""
        while where < self.size:
            data = self.at(where, SEARCH_BYTES)
            if (found := data.find(BOUNDARY_MARK)) >= 0:
                return where + found, where + found + len(BOUNDARY_MARK)
            where += max(1, len(data) - len(BOUNDARY_MARK) + 1)
        return self.size, self.size

    def chunks(self, where: int, stop: int | None = None) -> Iterator[tuple[int, int, int]]:
        """(tag, start, end) of the content of each chunk from ``where``, the start of one, to ``stop``."""
        while where < (self.size if stop is None else stop):
            head = self.at(where, 11)
            size, begin = _length(head, 0)
            tag = struct.unpack_from("<H", head, begin)[0]
            yield tag, where + begin + 2, where + begin + size
            where += begin + size

    def heads(self, wanted: bytes | None = None, stop: int | None = None) -> dict[bytes, Head]:
        """Headers before the first samples, and before ``stop``; with ``wanted`` on to the header of that stream."""
        if self.at(0, 4) != MAGIC:
            raise ValueError("not an XDF file")
        out = {}
        for tag, a, b in self.chunks(4, stop):
            if tag == STREAM_HEADER:
                body = self.at(a, b - a)
                out[body[:4]] = Head.of(body)
            if wanted in out or (wanted is None and tag == SAMPLES):
                break
        return out

    def footers(self, heads: dict[bytes, Head]) -> list[tuple[str, float, float, int]]:
        """From what follows the last boundary mark, which is searched from the end."""
        back = SEARCH_BYTES
        while True:
            begin = max(0, self.size - back)
            found = self.at(begin, self.size - begin).rfind(BOUNDARY_MARK)
            if found >= 0 or not begin:
                break
            back *= 2
        out = []
        for tag, a, b in self.chunks(begin + found + len(BOUNDARY_MARK) if found >= 0 else 4):
            if tag == STREAM_FOOTER:
                body = self.at(a, b - a)
                if body[:4] not in heads:
                    heads |= self.heads(body[:4])
                info = ET.fromstring(body[4:].decode())
                out.append((heads[body[:4]].name, float(info.findtext("first_timestamp")), float(info.findtext("last_timestamp")), int(info.findtext("sample_count"))))
        return out


def decode(data: bytes, lower: bool = False) -> Iterator[pd.DataFrame]:
    """The samples of each stream of a file at hand, chunk by chunk; ``lower``: labels in lower case."""
    for chunk in _decoded(data, lower):
        yield _frame([chunk])


def decode_all(contents: Iterator[bytes], lower: bool = False) -> Iterator[pd.DataFrame]:
    """As ``decode`` for files one after another, those that are small put together."""
    held, size = [], 0
    for data in contents:
        for chunk in _decoded(data, lower):
            held.append(chunk)
            size += chunk[2].size
            if size >= BATCH_VALUES:
                yield _frame(held)
                held, size = [], 0
    if held:
        yield _frame(held)


def _frame(chunks: list[tuple[Head, list[str], np.ndarray, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """Rows of chunks of (head, labels, values or texts, numbers of the samples, time stamps)."""
    sizes = [x.size for _, _, x, _, _ in chunks]
    number = np.concatenate([np.full(x.size, np.nan) if head.fmt == "string" else x.ravel() for head, _, x, _, _ in chunks])
    text = np.concatenate([x.ravel().astype(object) if head.fmt == "string" else np.full(x.size, None, object) for head, _, x, _, _ in chunks])
    spread = lambda k: np.concatenate([np.repeat(c[k], len(c[1])) for c in chunks])
    labels = np.concatenate([np.tile(np.array(c[1], object), len(c[3])) for c in chunks])
    return pd.DataFrame({"stream": np.repeat(np.array([c[0].name for c in chunks], object), sizes), "seq": spread(3), "ts": spread(4), "channel": labels, "value": number, "text": text})


def _walked(data: bytes) -> Iterator[tuple[int, int, int]]:
    """As ``Recording.chunks`` for a file at hand."""
    where = 4
    while where < len(data):
        size, begin = _length(data, where)
        yield int.from_bytes(data[begin : begin + 2], "little"), begin + 2, begin + size
        where = begin + size


def _decoded(data: bytes, lower: bool) -> Iterator[tuple[Head, list[str], np.ndarray, np.ndarray, np.ndarray]]:
    if data[:4] != MAGIC:
        raise ValueError("not an XDF file")
    heads, last, clocks = {}, {}, {}
    chunks = [(tag, data[a:b]) for tag, a, b in _walked(data)]
    for tag, body in chunks:
        if tag == CLOCK_OFFSET:
            clocks.setdefault(body[:4], []).append(dict(zip(("when", "by"), struct.unpack_from("<dd", body, 4))))
    for tag, body in chunks:
        if tag == STREAM_HEADER:
            heads[body[:4]] = Head.of(body)
        elif tag == SAMPLES:
            head = heads[body[:4]]
            labels = [x.lower() for x in head.labels] if lower else head.labels
            seq, stamp, stamp_at = last.get(body[:4], (0, 0.0, -1))
            ts, x = _samples(body, labels, head.fmt)
            ts = _stamps(ts, seq, head.rate, stamp, stamp_at)
            last[body[:4]] = (seq + len(ts), ts[-1], seq + len(ts) - 1) if len(ts) else (seq, stamp, stamp_at)
            ts = _corrected(ts, clocks.get(body[:4]))
            yield head, labels, x, head.first + np.arange(seq, seq + len(ts)), ts


def _stamps(ts: np.ndarray, start: int, rate: float, stamp: float, stamp_at: int) -> np.ndarray:
    """Time stamps of samples from ``start`` on; one that lacks follows from the rate and the last before, at first ``stamp`` of sample ``stamp_at``."""
    known = ~np.isnan(ts)
    if known.all():
        return ts
    last = np.maximum.accumulate(np.where(known, np.arange(len(ts)), -1))
    gone = np.where(last >= 0, np.arange(len(ts)) - last, start + np.arange(len(ts)) - stamp_at)
    return np.where(last >= 0, ts[last], stamp) + gone * (1 / rate if rate else 0)


def _corrected(ts: np.ndarray, clocks: list[dict] | None) -> np.ndarray:
    """Time stamps with what lies between the clock offsets added."""
    if clocks is None or not len(clocks):
        return ts
    when, by = np.array(sorted((c["when"], c["by"]) for c in clocks)).T
    return ts + np.interp(ts, when, by)


_CLOCKS = pa.list_(pa.struct([("when", pa.float64()), ("by", pa.float64())]))


def shared(ranges: list[tuple], file: int = 0, size: int = -1) -> list[list[tuple]]:
    """``ranges`` dealt to tasks in their order: few each by itself, of many as many together as make a task worthwhile. Columns ``file`` and ``size`` tell the file and the bytes of each."""
    if len(ranges) <= MOST_TASKS:
        return [[r] for r in ranges]
    weights = [r[size] + RANGE_BYTES + (OPEN_BYTES if before is None or before[file] != r[file] else 0) for before, r in zip([None, *ranges], ranges)]
    most, out, held = min(PART_BYTES, sum(weights) // LEAST_TASKS), [[]], 0
    for r, w in zip(ranges, weights):
        if out[-1] and held + w > most:
            out.append([])
            held = 0
        out[-1].append(r)
        held += w
    return out


def _batch(rows: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(v), t) for v, t in zip(zip(*rows), kinds.values())], list(kinds))


class Reader(DataSourceReader):
    """Reads files in ranges of ``part_bytes``; a range goes from its first boundary mark to the first one beyond it. Many small ranges share a task."""

    KINDS = {
        "chunks": {"file": pa.string(), "part": pa.int32(), "stream": pa.string(), "labels": pa.list_(pa.string()), "at": pa.int64(), "stamps": pa.list_(pa.float64()), "numbers": pa.list_(pa.float64()), "texts": pa.list_(pa.string())},
        "index": {"file": pa.string(), "part": pa.int32(), "stream": pa.string(), "rate": pa.float64(), "first": pa.int64(), "n": pa.int64(), "stamp": pa.float64(), "stamp_at": pa.int64(), "low": pa.float64(), "clocks": _CLOCKS},
        "footers": {"stream": pa.string(), "first_timestamp": pa.float64(), "last_timestamp": pa.float64(), "sample_count": pa.int64()},
    }

    def __init__(self, options: dict[str, str]):
        self.path, self.what, self.part_bytes = options["path"], options.get("what", "chunks"), int(options.get("part_bytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(self.path)
        found = [f for f in store.get_file_info(fs.FileSelector(top, recursive=True)) if f.is_file and f.extension == "xdf"] if store.get_file_info(top).type == fs.FileType.Directory else [store.get_file_info(top)]
        ranges = [(f.path, i, min(f.size - i * self.part_bytes, self.part_bytes)) for f in sorted(found, key=lambda f: f.path) for i in range(1 if self.what == "footers" else -(-f.size // self.part_bytes))]
        return [InputPartition([(path, [part for _, part, _ in own]) for path, own in groupby(parts, key=lambda r: r[0])]) for parts in shared(ranges)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if partition is None or partition.value is None:
            return
        store, _ = fs.FileSystem.from_uri(self.path)
        kinds = self.KINDS[self.what]
        held, size = [], 0
        for path, parts in partition.value:
            with store.open_input_file(path) as file:
                for row, values in self._rows(Recording(file), path, parts):
                    held.append(row)
                    size += values
                    if len(held) >= BATCH_ROWS or size >= BATCH_VALUES:
                        yield _batch(held, kinds)
                        held, size = [], 0
        if held:
            yield _batch(held, kinds)

    def _rows(self, recording: Recording, path: str, parts: list[int]) -> Iterator[tuple[tuple, int]]:
        """Rows of ranges of a file, with how many values each holds."""
        heads = recording.heads()
        if self.what == "footers":
            yield from ((row, 1) for row in recording.footers(heads))
            return
        for part in parts:
            begin, stop = part * self.part_bytes, (part + 1) * self.part_bytes
            mark, start = recording.after_mark(begin) if part else (0, 4)
            if mark < stop:
                yield from (self._index if self.what == "index" else self._chunks)(recording, heads, path, part, start, stop)

    def _walk(self, recording: Recording, heads: dict[bytes, Head], start: int, stop: int) -> Iterator[tuple[int, bytes, bytes, Head | None]]:
        """(tag, content, stream, its head) of the samples and clock offsets of a range."""
        for tag, a, b in recording.chunks(start):
            if tag in (SAMPLES, CLOCK_OFFSET):
                body = recording.at(a, b - a)
                if body[:4] not in heads:
                    heads |= recording.heads(body[:4])
                yield tag, body, body[:4], heads[body[:4]]
            elif tag == BOUNDARY and b - len(BOUNDARY_MARK) >= stop:
                return

    def _index(self, recording: Recording, heads: dict[bytes, Head], path: str, part: int, start: int, stop: int) -> Iterator[tuple[tuple, int]]:
        """Of each stream in a range: how many samples, the last time stamp written and its sample, the span, the clock offsets."""
        found: dict[bytes, dict] = {}
        for tag, body, stream, head in self._walk(recording, heads, start, stop):
            own = found.setdefault(stream, {"n": 0, "stamp": None, "stamp_at": None, "low": None, "clocks": [], "head": head})
            if tag == CLOCK_OFFSET:
                own["clocks"].append(dict(zip(("when", "by"), struct.unpack_from("<dd", body, 4))))
                continue
            ts, _ = _samples(body, head.labels, head.fmt)
            at = np.flatnonzero(~np.isnan(ts))
            if len(at):
                own["stamp"], own["stamp_at"] = float(ts[at[-1]]), own["n"] + int(at[-1])
                own["low"] = float(ts[at].min()) if own["low"] is None else min(own["low"], float(ts[at].min()))
            own["n"] += len(ts)
        for v in found.values():
            yield (path, part, v["head"].name, v["head"].rate, v["head"].first, v["n"], v["stamp"], v["stamp_at"], v["low"], v["clocks"]), 1 + len(v["clocks"])

    def _chunks(self, recording: Recording, heads: dict[bytes, Head], path: str, part: int, start: int, stop: int) -> Iterator[tuple[tuple, int]]:
        """A row for each chunk of samples; time stamps lack only before the first one of the range."""
        seen: dict[bytes, tuple[int, float | None, int]] = {}
        for tag, body, stream, head in self._walk(recording, heads, start, stop):
            if tag != SAMPLES:
                continue
            ts, x = _samples(body, head.labels, head.fmt)
            at, stamp, stamp_at = seen.get(stream, (0, None, 0))
            if stamp is not None:
                ts = _stamps(ts, at, head.rate, stamp, stamp_at)
            if len(ts) and not np.isnan(ts).all():
                stamp_at = int(np.flatnonzero(~np.isnan(ts))[-1])
                stamp, stamp_at = float(ts[stamp_at]), at + stamp_at
            seen[stream] = (at + len(ts), stamp, stamp_at)
            text = head.fmt == "string"
            yield (path, part, head.name, head.labels, at, ts, None if text else x.ravel(), x.ravel().tolist() if text else None), x.size


class XdfSource(DataSource):
    """``spark.read.format("xdf")``: chunks of samples, or with option ``what`` an ``index`` of ranges or the ``footers``."""

    SCHEMAS = {
        "chunks": "file string, part int, stream string, labels array<string>, at long, stamps array<double>, numbers array<double>, texts array<string>",
        "index": "file string, part int, stream string, rate double, first long, n long, stamp double, stamp_at long, low double, clocks array<struct<when: double, by: double>>",
        "footers": "stream string, first_timestamp double, last_timestamp double, sample_count long",
    }

    @classmethod
    def name(cls) -> str:
        return "xdf"

    def schema(self) -> str:
        return self.SCHEMAS[self.options.get("what", "chunks")]

    def reader(self, schema) -> Reader:  # noqa: ANN001
        return Reader(dict(self.options))


def _source(spark: SparkSession, path: str, what: str, part_bytes: int = 0) -> DataFrame:
    spark.dataSource.register(XdfSource)
    return spark.read.format("xdf").option("what", what).option("part_bytes", part_bytes or PART_BYTES).load(path)


def _stamped(stamps: pd.Series, start: pd.Series, rate: pd.Series, stamp: pd.Series, stamp_at: pd.Series, clocks: pd.Series) -> pd.Series:
    """Time stamps of chunks, filled up and corrected."""
    rows = zip(stamps, start, rate, stamp, stamp_at, clocks)
    return pd.Series([_corrected(_stamps(np.array(ts, float), s, r, t, a), c) for ts, s, r, t, a, c in rows], dtype=object)


def read(spark: SparkSession, path: str, lower: bool = False, part_bytes: int = 0) -> DataFrame:
    """Samples of all streams of all files, cells without a value left out.

    Ranges of ``part_bytes`` are read each by a task. A first pass over the ranges
    tells where each one's samples count on, which time stamp comes before, and
    which clock offsets lie around it.
    """
    index = stored(_source(spark, path, "index", part_bytes), "xdf-index")
    before = Window.partitionBy("file", "stream").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("stamp").isNotNull(), F.struct("stamp", (F.col("start") + F.col("stamp_at")).alias("at"))), ignorenulls=True).over(before)
    parts = index.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("last", last)
    clocks = index.select("file", "stream", F.explode("clocks").alias("c")).select("file", "stream", "c.*")
    order = Window.partitionBy("file", "stream").orderBy("when")
    spans = clocks.select("file", "stream", "when", "by", F.coalesce(F.lag("when").over(order), F.lit(float("-inf"))).alias("previous"), F.coalesce(F.lead("when").over(order), F.lit(float("inf"))).alias("next"))
    # samples without a stamp may lie before the first stamp and beyond the last
    low, high = F.when(F.col("last").isNull(), F.lit(float("-inf"))).otherwise(F.least("low", "last.stamp")), F.coalesce("stamp", F.lit(float("inf")))
    high = F.when(F.col("stamp_at") == F.col("n") - 1, high).otherwise(F.lit(float("inf")))
    near = parts.select("file", "part", "stream", low.alias("low"), high.alias("high")).join(spans, ["file", "stream"]).where("next >= low and previous <= high")
    near = near.groupBy("file", "part", "stream").agg(F.collect_list(F.struct("when", "by")).alias("clocks"))
    placed = parts.drop("clocks").join(near, ["file", "part", "stream"], "left")
    placed = placed.select("file", "part", "stream", "start", "rate", "first", F.coalesce("last.stamp", F.lit(0.0)).alias("stamp"), F.coalesce("last.at", F.lit(-1)).alias("stamp_at"), "clocks")
    if index.count() <= MOST_PLACES:
        placed = F.broadcast(placed)
    rows = _source(spark, path, "chunks", part_bytes).join(placed, ["file", "part", "stream"])
    start = F.col("start") + F.col("at")
    stamps = F.pandas_udf(_stamped, "array<double>")("stamps", start, "rate", "stamp", "stamp_at", "clocks")
    rows = rows.select("stream", F.transform("labels", F.lower).alias("labels") if lower else "labels", (F.col("first") + start).alias("first"), stamps.alias("stamps"), "numbers", "texts")
    cells = F.posexplode(F.arrays_zip(F.coalesce("numbers", F.transform("texts", lambda _: F.lit(None).cast("double"))).alias("value"), F.coalesce("texts", F.transform("numbers", lambda _: F.lit(None).cast("string"))).alias("text")))
    rows = rows.select("stream", "labels", "first", "stamps", cells.alias("pos", "cell"))
    row = F.floor(F.col("pos") / F.size("labels")).cast("int")
    found = rows.select("stream", (F.col("first") + row).alias("seq"), F.get("stamps", row).alias("ts"), F.get("labels", F.col("pos") % F.size("labels")).alias("channel"), F.col("cell")["value"].alias("value"), F.col("cell")["text"].alias("text"))
    return found.withColumn("value", F.when(~F.isnan("value"), F.col("value"))).where("value is not null or text is not null")


def footers(spark: SparkSession, path: str) -> DataFrame:
    """(stream, first_timestamp, last_timestamp, sample_count) from the footer of each stream, without reading the samples."""
    return _source(spark, path, "footers")


def files(samples: DataFrame, rate: float, kind: str = "signal", file_rows: int = 0) -> DataFrame:
    """(stream, first, content): the streams of ``samples`` (stream, seq, ts, channel, and value or text) as contents of files.

    A stream goes on in a further file after ``file_rows`` samples, so a task holds
    so many at most. Cells that a sample of several channels lacks are NaN.
    """
    column, fmt = ("text", "string") if "text" in samples.columns else ("value", "double64")
    size = file_rows or FILE_ROWS
    row = F.dense_rank().over(Window.partitionBy("stream").orderBy("seq")) - 1
    empty = "" if fmt == "string" else np.nan

    def grid(seq: np.ndarray, ts: np.ndarray, channel: np.ndarray, value: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Channels, time stamps and samples by channels of rows in any order."""
        seq, row = np.unique(seq, return_inverse=True)
        names, channel = np.unique(channel, return_inverse=True)
        if len(np.unique(row * len(names) + channel)) < len(row):
            raise ValueError("a channel has several values at a sample")
        x = np.full((len(seq), len(names)), empty, object if fmt == "string" else float)
        x[row, channel] = value
        when = np.full(len(seq), np.nan)
        np.fmin.at(when, row, ts)
        return names.tolist(), when, x

    def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        """A row for each file; ``starts`` are the first rows of the files."""
        seq, ts = rows["seq"].to_numpy(), rows["ts"].to_numpy()
        value = np.array([v or "" for v in rows[column].to_pylist()], object) if fmt == "string" else rows[column].to_numpy()
        channel = np.array(rows["channel"].to_pylist(), object)
        # a channel by itself, in order, needs no grid
        mixed = ~(seq[1:] > seq[:-1]) | (channel[1:] != channel[:-1])
        mixed[starts[1:] - 1] = False
        mixed = np.add.reduceat(np.append(mixed, False), starts) > 0
        firsts, contents = rows["file"].to_numpy()[starts] * size, []
        streams = rows["stream"].take(pa.array(starts))
        for name, first, a, b, several in zip(streams.to_pylist(), firsts.tolist(), starts.tolist(), [*starts[1:].tolist(), len(seq)], mixed.tolist()):
            names, when, x = grid(seq[a:b], ts[a:b], channel[a:b], value[a:b]) if several else ([channel[a]], ts[a:b], value[a:b, None])
            contents.append(encode(name, kind, rate, names, when, x, fmt, first=first))
        return pa.record_batch([pa.array(streams.to_pylist(), pa.string()), pa.array(firsts, pa.int64()), pa.array(contents, pa.binary())], ["stream", "first", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last file, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            stream = batch["stream"].dictionary_encode("encode").indices.to_numpy()
            file = batch["file"].to_numpy()
            starts = np.flatnonzero((stream[1:] != stream[:-1]) | (file[1:] != file[:-1])) + 1
            if not held or any(held[-1][k][-1] != batch[k][0] for k in ("stream", "file")):
                starts = np.concatenate([[0], starts])
            if not len(starts):
                held.append(batch)
                continue
            if held:
                yield made(pa.Table.from_batches([*held, batch.slice(0, starts[0])]), np.zeros(1, int))
            if len(starts) > 1:
                yield made(pa.Table.from_batches([batch.slice(starts[0], starts[-1] - starts[0])]), starts[:-1] - starts[0])
            held = [batch.slice(starts[-1])]
        if held:
            yield made(pa.Table.from_batches(held), np.zeros(1, int))

    typed = samples.select("stream", F.col("seq").cast("long").alias("seq"), F.col("ts").cast("double").alias("ts"), "channel", F.col(column).cast("string" if fmt == "string" else "double").alias(column))
    # the window deals out whole streams in this order, so a task gets the rows of a file one after another
    ordered = typed.withColumn("file", F.floor(row / size)).sortWithinPartitions("stream", "seq")
    return ordered.mapInArrow(run, "stream string, first long, content binary")


def write(samples: DataFrame, path: str, rate: float, kind: str = "signal", file_rows: int = 0) -> DataFrame:
    """Write the files of each stream below ``path``, a URI that all executors reach; gives (stream, file, size).

    A file is named by its stream and first sample, so a task that runs again writes the same one.
    """

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        for batch in batches:
            names = [f"{uuid.uuid5(uuid.NAMESPACE_URL, name)}-{first}.xdf" for name, first in zip(batch["stream"], batch["first"])]
            for name, content in zip(names, batch["content"]):
                with store.open_output_stream(f"{top}/{name}") as out:
                    out.write(content)
            yield pd.DataFrame({"stream": batch["stream"], "file": names, "size": batch["content"].map(len)})

    return files(samples, rate, kind, file_rows).mapInPandas(put, "stream string, file string, size long")
