"""The data source for recordings: files cut into ranges give the rows of the whole, whatever the cuts."""

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewave.sources import xdf


def mixed_file(rng):
    """Three streams whose chunks alternate: stamps that lack, clock offsets, text; a late header."""
    one, two, three = (struct.pack("<I", i) for i in (1, 2, 3))
    out = [xdf.MAGIC, xdf._chunk(xdf.FILE_HEADER, b"<info/>"), xdf._chunk(xdf.STREAM_HEADER, one + xdf._header("eeg", "EEG", 100.0, ["Fp1", "Cz"], "float32", "uV")), xdf._chunk(xdf.STREAM_HEADER, two + xdf._header("marks", "Markers", 0.0, ["M"], "string", ""))]
    t, n = 1000.0, 0
    for i in range(60):
        rows = int(rng.integers(0, 40))
        body = b""
        for k in range(rows):
            stamped = rng.random() < 0.1
            body += (b"\x08" + struct.pack("<d", t + n / 100) if stamped else b"\x00") + struct.pack("<ff", n, -n)
            n += 1
        out.append(xdf._chunk(xdf.SAMPLES, one + xdf._sized(rows) + body))
        if i % 4 == 0:
            out.append(xdf._chunk(xdf.CLOCK_OFFSET, one + struct.pack("<dd", t + n / 100, float(rng.normal()))))
        if i % 5 == 0:
            out.append(xdf._chunk(xdf.SAMPLES, two + xdf._sized(1) + b"\x08" + struct.pack("<d", t + n / 100) + xdf._sized(6) + "é %03d".encode()[:2] + b"%04d" % i))
        if i == 40:
            out.append(xdf._chunk(xdf.STREAM_HEADER, three + xdf._header("late", "x", 1.0, ["a"], "int16", "")))
        if i > 40:
            out.append(xdf._chunk(xdf.SAMPLES, three + xdf._sized(1) + b"\x00" + struct.pack("<h", i)))
        if i % 3 == 0:
            out.append(xdf._chunk(xdf.BOUNDARY, xdf.BOUNDARY_MARK))
    footer = b"<info><first_timestamp>1</first_timestamp><last_timestamp>2</last_timestamp><sample_count>%d</sample_count></info>"
    return b"".join([*out, xdf._chunk(xdf.STREAM_FOOTER, one + footer % n), xdf._chunk(xdf.STREAM_FOOTER, three + footer % 19)])


@pytest.fixture(scope="module")
def mixed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("xdf")
    for i in range(2):
        (folder / f"{i}.xdf").write_bytes(mixed_file(np.random.default_rng(i)))
    return folder


def plain(t):
    t = t.assign(text=t["text"].fillna("")).sort_values(["stream", "seq", "channel", "value", "ts"]).reset_index(drop=True)
    return t[["stream", "seq", "channel", "ts", "value", "text"]]


@pytest.mark.parametrize("part_bytes", [1 << 20, 4000, 700, 64])
def test_ranges_equal_the_whole(spark, mixed, part_bytes, monkeypatch):
    monkeypatch.setattr(xdf, "SEARCH_BYTES", 100)
    expected = plain(pd.concat([pd.concat(xdf.decode(f.read_bytes())) for f in sorted(mixed.iterdir())]))
    found = xdf.read(spark, f"file://{mixed}", part_bytes=part_bytes)
    got = plain(found.toPandas())
    assert len(got) == len(expected) > 2000
    assert (got[["stream", "seq", "channel", "text"]] == expected[["stream", "seq", "channel", "text"]]).all().all()
    assert np.allclose(got["ts"], expected["ts"]) and np.allclose(got["value"].fillna(0), expected["value"].fillna(0))
    parts = xdf._source(spark, f"file://{mixed}", "chunks", part_bytes)
    assert parts.rdd.getNumPartitions() == sum(-(-f.stat().st_size // part_bytes) for f in mixed.iterdir())


def test_each_chunk_is_read_once(spark, mixed):
    chunks = xdf._source(spark, f"file://{mixed}", "chunks", 500)
    whole = xdf._source(spark, f"file://{mixed}", "chunks")
    assert chunks.count() == whole.count() and chunks.select("file", "part").distinct().count() > 20


class Counted:
    """A file that counts what is read of it."""

    def __init__(self, data):
        self.inner, self.taken = pa.BufferReader(data), 0

    def size(self):
        return self.inner.size()

    def seek(self, where):
        self.inner.seek(where)

    def read(self, n):
        out = self.inner.read(n)
        self.taken += len(out)
        return out


def test_footers_without_the_body(monkeypatch):
    monkeypatch.setattr(xdf, "SEARCH_BYTES", 2000)
    data = xdf.encode("s", "EEG", 10.0, ["a", "b"], np.arange(200_000) / 10, np.zeros((200_000, 2)))
    file = Counted(data)
    recording = xdf.Recording(file)
    assert recording.footers(recording.heads()) == [("s", 0.0, 19999.9, 200_000)]
    assert len(data) > 4_000_000 and file.taken < 10_000


def test_footers(spark, mixed):
    found = sorted(map(tuple, xdf.footers(spark, f"file://{mixed}").collect()))
    assert [r[0] for r in found] == ["eeg", "eeg", "late", "late"] and found[2] == ("late", 1.0, 2.0, 19)


def test_recordings_go_on_in_further_files(spark, tmp_path):
    rows = spark.range(1000).select(F.lit("s").alias("stream"), (F.col("id") * 7).alias("seq"), (F.col("id") / 4).alias("ts"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("channel"), F.col("id").cast("double").alias("value"))
    path = f"file://{tmp_path}/out"
    assert xdf.write(rows, path, 4.0, file_rows=130).count() == 8
    found = xdf.read(spark, path, part_bytes=300).drop("text").collect()
    assert sorted(map(tuple, found)) == [("s", i, i / 4, "a" if i % 3 == 0 else "b", float(i)) for i in range(1000)]


def test_not_a_recording(spark, tmp_path):
    (tmp_path / "x.xdf").write_bytes(b"nothing at all")
    with pytest.raises(Exception, match="not an XDF file"):
        xdf.read(spark, f"file://{tmp_path}").count()


@pytest.mark.parametrize("what", ["index", "chunks", "footers"])
def test_many_small_ranges_share_tasks(tmp_path, monkeypatch, what):
    for i in range(40):
        (tmp_path / f"{i}.xdf").write_bytes(mixed_file(np.random.default_rng(i)))
    reader = xdf.Reader({"path": f"file://{tmp_path}", "what": what, "part_bytes": "700"})
    rows = lambda parts: [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    monkeypatch.setattr(xdf, "MOST_TASKS", 10**6)
    alone = reader.partitions()
    monkeypatch.setattr(xdf, "MOST_TASKS", 8)
    monkeypatch.setattr(xdf, "LEAST_TASKS", 5)
    together = reader.partitions()
    assert len(together) <= 8 and len(alone) >= 40
    assert str(rows(together)) == str(rows(alone))


def test_shared_ranges_stay_below_a_tasks_bytes():
    small, large = [(f"s{i}", 0, 4000) for i in range(90_000)], [("l", i, xdf.PART_BYTES) for i in range(2000)]
    assert 300 < len(xdf.shared(small)) < 500 and len(xdf.shared(large)) == 2000
    assert [r for task in xdf.shared(small + large) for r in task] == small + large


def test_a_channel_with_two_values_at_a_sample_is_refused(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0, 0.0, "a", 1.0), ("s", 0, 0.0, "a", 2.0)], "stream string, seq long, ts double, channel string, value double")
    with pytest.raises(Exception, match="several values"):
        xdf.write(rows, f"file://{tmp_path}", 0.0).count()


def test_files_of_many_streams_are_made_together(spark, monkeypatch):
    """No stream is a group of its own in Python; files are the same wherever batches end, names as odd as they are."""
    names = ["a", "b&<c>", "é", "", *map(str, range(40))]
    rows = [(n, 3 * i, i / 4, c, float(i)) for k, n in enumerate(names) for i in range(1 + 7 * k % 23) for c in (["x"] if k % 3 else ["x", "ü>"])]
    samples = spark.createDataFrame(rows, "stream string, seq long, ts double, channel string, value double").repartition(5)
    made = xdf.files(samples, 4.0, file_rows=5)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    whole = {(r["stream"], r["first"]): bytes(r["content"]) for r in made.collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        cut = {(r["stream"], r["first"]): bytes(r["content"]) for r in xdf.files(samples, 4.0, file_rows=5).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert cut == whole and len(whole) == sum(-(-(1 + 7 * k % 23) // 5) for k in range(len(names)))
    found = pd.concat(xdf.decode_all(iter(whole.values()))).fillna({"stream": ""})
    assert sorted(map(tuple, found[["stream", "seq", "ts", "channel", "value"]].values.tolist())) == sorted((n, i // 3, t, c, v) for n, i, t, c, v in rows)
