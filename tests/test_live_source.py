"""The live source: recordings that grow, queries that stop and start again."""

import os
import struct

import numpy as np
import pytest

from tidewave.sources import live, xdf


def taken(spark, folder, part_bytes=0):
    """One run over what is there, from the checkpoint of the last one on."""
    query = live.follow(spark, f"file://{folder}/in", part_bytes).writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


@pytest.mark.parametrize("part_bytes", [0, 300])
def test_stop_and_start_again(spark, tmp_path, part_bytes):
    rng = np.random.default_rng(2)
    files, expected = {}, []
    for name, n in (("a", 500), ("b", 90), ("c", 1)):
        ts = np.arange(n) / 10
        x = rng.normal(size=(n, 2))
        x[n // 2, 1] = np.nan
        old, xdf.CHUNK_ROWS = xdf.CHUNK_ROWS, 7
        files[name] = xdf.encode(name, "EEG", 10.0, ["p", "q"], ts, x)
        xdf.CHUNK_ROWS = old
        expected += [(name, i, ts[i], c, float(x[i, j])) for i in range(n) for j, c in enumerate("pq") if not np.isnan(x[i, j])]
    (tmp_path / "in").mkdir()
    for share in (0.0, 0.3, 0.3, 0.7, 1.0, 1.0):
        for name, data in files.items():
            if name != "b" or share > 0.5:  # one recording starts later
                grown = tmp_path / "in" / f"{name}.xdf"
                have = grown.stat().st_size if grown.exists() else 0
                with open(grown, "ab") as out:  # mostly in the middle of a chunk
                    out.write(data[have : int(len(data) * share)])
        taken(spark, tmp_path, part_bytes)
    found = spark.read.schema(live.SCHEMA).parquet(f"file://{tmp_path}/out").select("stream", "seq", "ts", "channel", "value").collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def test_replay_of_a_failed_trigger(spark, tmp_path):
    """A trigger that fails after its offset was written is done again, with the same rows, though more has come."""
    (tmp_path / "in").mkdir()
    data = xdf.encode("s", "EEG", 10.0, ["p"], np.arange(40) / 10, np.arange(40.0)[:, None])
    (tmp_path / "in" / "s.xdf").write_bytes(data)
    seen = []

    def fails(batch, number):
        seen.append((number, batch.count()))
        if len(seen) == 1:
            raise RuntimeError("lost")

    def run():
        stream = live.follow(spark, f"file://{tmp_path}/in")
        stream.writeStream.option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).foreachBatch(fails).start().awaitTermination()

    with pytest.raises(Exception, match="lost"):
        run()
    more = xdf.encode("t", "EEG", 10.0, ["p"], np.arange(15) / 10, np.arange(15.0)[:, None])
    (tmp_path / "in" / "t.xdf").write_bytes(more)
    run()
    run()
    assert seen == [(0, 40), (0, 40), (1, 15)]


def test_markers_and_stamps(tmp_path):
    one, two = struct.pack("<I", 1), struct.pack("<I", 2)
    body = xdf._chunk(xdf.SAMPLES, one + xdf._sized(3) + b"\x00" + struct.pack("<h", 1) + b"\x08" + struct.pack("<dh", 5.0, 2) + b"\x00" + struct.pack("<h", 3))
    marks = xdf._chunk(xdf.SAMPLES, two + xdf._sized(1) + b"\x08" + struct.pack("<d", 9.0) + xdf._sized(2) + "é".encode())
    file = xdf.MAGIC + xdf._chunk(xdf.STREAM_HEADER, one + xdf._header("s", "x", 10.0, ["c"], "int16", "")) + body + xdf._chunk(xdf.STREAM_HEADER, two + xdf._header("m", "Markers", 0.0, ["M"], "string", "")) + marks + body
    path = os.path.join(tmp_path, "x.xdf")
    with open(path, "wb") as out:
        out.write(file + b"\x01")
    reader = live.LiveReader({"path": f"file://{tmp_path}"})
    end = reader.latestOffset()
    assert end == {path: {"at": len(file), "counts": {"1": 6, "2": 1}}}
    rows = [r for p in reader.partitions({}, end) for b in reader.read(p) for r in b.to_pylist()]
    assert [(r["stream"], r["seq"], r["ts"] and round(r["ts"], 9), r["value"] or r["text"]) for r in rows] == [("s", 0, None, 1), ("s", 1, 5.0, 2), ("s", 2, 5.1, 3), ("m", 0, 9.0, "é"), ("s", 3, 5.2, 1), ("s", 4, 5.0, 2), ("s", 5, 5.1, 3)]
    assert reader.partitions(end, end) == []


def test_many_small_recordings_share_tasks(tmp_path, monkeypatch):
    for i in range(50):
        (tmp_path / f"{i}.xdf").write_bytes(xdf.encode(f"s{i}", "EEG", 10.0, ["p"], np.arange(4) / 10, np.full((4, 1), float(i))))
    reader = live.LiveReader({"path": f"file://{tmp_path}"})
    end = reader.latestOffset()
    assert len(reader.partitions({}, end)) == 50
    monkeypatch.setattr(xdf, "MOST_TASKS", 8)
    monkeypatch.setattr(xdf, "LEAST_TASKS", 5)
    parts = reader.partitions({}, end)
    rows = [(r["stream"], r["seq"], r["value"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert len(parts) <= 8 and sorted(rows) == sorted((f"s{i}", k, float(i)) for i in range(50) for k in range(4))
