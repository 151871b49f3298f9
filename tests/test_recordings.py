"""Recordings by byte ranges, their sink, and a recorder's spool that is read once."""

import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.sources import files, recordings, wav


def waves_of(spark, rows):
    return spark.createDataFrame(rows, "utt string, rate int, samples array<smallint>")


def whole(blocks):
    """Blocks put together: (path's name, rate, samples, error)."""
    out = {}
    for r in sorted(blocks.collect(), key=lambda r: (r.path, r.first or 0)):
        name = os.path.basename(r.path)
        kept = out.setdefault(name, (r.rate, [], r.error))
        assert r.first is None or r.first == len(kept[1])
        kept[1].extend(r.samples or [])
    return out


@pytest.fixture
def folder(spark, tmp_path):
    rng = np.random.default_rng(1)
    path = str(tmp_path / "w")
    recordings.save(waves_of(spark, [(f"u{i}", 8000 + i, rng.integers(-30000, 30000, n).tolist()) for i, n in enumerate((0, 1, 7, 400, 2500))]), path)
    (tmp_path / "w" / "bad.wav").write_bytes(b"RIFFnothing")
    (tmp_path / "w" / "cut.wav").write_bytes(wav.encode([1, 2, 3, 4], 16000)[:-2])
    (tmp_path / "w" / "more.wav").write_bytes(wav.encode([1, 2], 16000) + b"\x05\x00\x06\x00\x07")
    (tmp_path / "w" / "notes.txt").write_text("no recording")
    return path


@pytest.mark.parametrize("trust", [True, False])
def test_ranges_are_the_whole_files(spark, folder, trust):
    want = {os.path.basename(r.path): (r.rate, list(r.samples or []), r.error) for r in wav.read(spark, folder, trust_length=trust).collect()}
    for part, block in ((300, 7), (1 << 20, 1 << 16)):
        blocks = recordings.scan(spark, folder, trustLength=trust, partitionBytes=part, blockSamples=block)
        assert whole(blocks) == want
    schema = blocks.schema
    reader = recordings.WavReader({"path": folder, "trustLength": str(trust).lower(), "partitionBytes": "2", "blockSamples": "1"}, schema)
    parts = reader.partitions()
    assert len(parts) > 1000  # a sample each
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert whole(spark.createDataFrame(rows, schema)) == want


def test_filters_and_columns_are_pushed(spark, folder):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    blocks = recordings.scan(spark, folder, partitionBytes=64)
    some = blocks.where("rate >= 8003 and rate < 9000 and channels = 1")
    assert {os.path.basename(r.path) for r in some.collect()} == {"u3.wav", "u4.wav"}
    reader = recordings.FilteredWavReader({"path": folder, "partitionBytes": "64"}, blocks.schema)
    one = recordings.EqualTo(("path",), f"{folder}/u4.wav")
    rest = recordings.EqualTo(("samples",), None)
    assert list(reader.pushFilters([one, rest])) == [rest]
    assert {p for r in reader.partitions() for p, *_ in r.pieces} == {f"{folder}/u4.wav"}
    heads = recordings.scan(spark, folder, "path string, rate int, declared int, error string", partitionBytes=64)
    assert heads.count() == 8 and heads.where("error is null").agg(F.sum("declared")).first()[0] == 2 * (0 + 1 + 7 + 400 + 2500 + 2)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_one_long_file_is_read_by_many_tasks(spark, tmp_path):
    """300 MB, nearly all of it silence that takes no room on disk."""
    path, n = tmp_path / "long.wav", 150_000_000
    with open(path, "wb") as f:
        f.write(wav.encode([], 16000)[:40] + struct.pack("<I", 2 * n))
        f.truncate(44 + 2 * n)
        for at in (0, 77_777_777, n - 1):
            f.seek(44 + 2 * at)
            f.write(struct.pack("<h", 1 + at % 100))
    blocks = recordings.scan(spark, str(path), partitionBytes=32 << 20)
    got = blocks.select("first", F.size("samples").alias("n"), F.array_max("samples").alias("top"), F.array_position("samples", F.array_max("samples")).alias("at"), F.spark_partition_id().alias("p")).collect()
    assert sum(r.n for r in got) == n and len({r.p for r in got}) == 9
    assert sorted(r.first + r["at"] - 1 for r in got if r.top) == [0, 77_777_777, n - 1]


def test_failed_writes_leave_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    recordings.save(waves_of(spark, [("a", 16000, [1, 2])]), path)
    before = sorted(os.listdir(path))
    for bad in ([("b", 16000, [1]), ("c/d", 16000, [2])], [("b", 16000, [1]), (None, 16000, [2])], [("b", 16000, [1]), ("b", 8000, [2])]):
        with pytest.raises(Exception):
            recordings.save(waves_of(spark, bad).repartition(2), path)
        assert sorted(os.listdir(path)) == before == ["a.wav"]
    recordings.save(waves_of(spark, [("b", 16000, None)]), path)
    assert sorted(os.listdir(path)) == ["a.wav", "b.wav"]
    recordings.save(waves_of(spark, [("c", 16000, [5])]), path, "overwrite")
    assert os.listdir(path) == ["c.wav"] and wav.read(spark, path).first().samples == [5]
    assert files.listed("file:" + path, "*.wav") == [(f"{path}/c.wav", 46)]


def test_recorder_gives_each_chunk_once(spark, tmp_path):
    spool, out, state = tmp_path / "spool", str(tmp_path / "out"), str(tmp_path / "state")
    spool.mkdir()
    rng = np.random.default_rng(2)
    x = {s: rng.integers(-100, 100, 90).astype("<i2") for s in ("a", "b")}

    def append(stream, a, b):
        with open(spool / f"{stream}.pcm", "ab") as f:
            f.write(x[stream].tobytes()[a:b])

    def run():
        rows = recordings.recorder(spark, str(spool), chunk=10, rate=1000, start="2026-01-01T00:00:00", partitionBytes=40)
        q = rows.writeStream.format("parquet").option("checkpointLocation", state).start(out)
        q.processAllAvailable()
        q.stop()

    append("a", 0, 55)  # two chunks and a half
    run()
    append("a", 55, 180)
    append("b", 0, 19)
    run()
    append("b", 19, 180)
    run()  # a new query from the same checkpoint each time
    got = spark.read.parquet(out).collect()
    assert sorted((r.stream, r.seq) for r in got) == [(s, k) for s in ("a", "b") for k in range(9)]
    for r in got:
        assert r.samples == x[r.stream][10 * r.seq : 10 * r.seq + 10].tolist()
        assert r.ts.isoformat() == f"2026-01-01T00:00:00.{10 * r.seq:03d}000".replace(".000000", "")
