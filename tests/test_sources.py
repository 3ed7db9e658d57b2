"""Readers that read what is asked for, by range and in any store, and writers that hold no stream."""

import json
import os
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F
from sparkreel import sources
from sparkreel.schema import AUDIO_FRAMES, FRAMES
from sparkreel.sources import files, ranges, raw, wav, wav_sink, y4m


class Counting:
    """An opened file whose bytes read are counted."""

    total = 0

    def __init__(self, path):
        self.file = open(path.removeprefix("count://"), "rb")
        self.seek, self.tell, self.close = self.file.seek, self.file.tell, self.file.close

    def read(self, n=-1):
        data = self.file.read(n)
        Counting.total += len(data)
        return data


@pytest.fixture
def counted(monkeypatch):
    monkeypatch.setattr(files, "opened", Counting)
    Counting.total = 0
    return Counting


def rows_of(kind, options, **bounds):
    reader = kind(options | {"bounds": json.dumps(bounds)})
    return [r for p in reader.partitions() for r in reader.read(p)]


def test_ten_frames_are_read_as_ten_frames(tmp_path, counted):
    samples = np.zeros((2, 1024 * 5000), np.float32)
    (tmp_path / "a.wav").write_bytes(wav.build(samples, 8000))
    (tmp_path / "b.wav").write_bytes(wav.build(samples[:, :10], 8000))
    found = rows_of(wav.WavReader, {"path": str(tmp_path)}, pts=(1024 * 1000, 1024 * 1010), source=["a.wav"])
    assert [r[2] for r in found] == [1024 * i for i in range(1000, 1010)]
    assert counted.total < 11 * 4096 < os.path.getsize(tmp_path / "a.wav") / 100
    counted.total = 0
    assert rows_of(wav.WavReader, {"path": str(tmp_path)}, stream_index=(1, None)) == [] and counted.total == 0


def test_frames_of_videos_by_number_and_time(tmp_path, counted):
    picture = 32 * 32 * 3
    (tmp_path / "a.rgb").write_bytes(bytes(range(200)) * picture)
    own = {"path": str(tmp_path / "*.rgb"), "width": "32", "height": "32", "fps": "10"}
    assert [r[2] for r in rows_of(raw.RawReader, own, frame_index=(70, 76))] == list(range(70, 76))
    assert counted.total == 6 * picture
    assert {150, 151} <= {r[2] for r in rows_of(raw.RawReader, own, pts_seconds=(15.0, 15.2))} <= set(range(149, 154))
    (tmp_path / "a.y4m").write_bytes(y4m.build(np.zeros((120, 3, 16, 16), np.uint8), 30))
    counted.total = 0
    found = rows_of(y4m.Y4mReader, {"path": str(tmp_path)}, frame_index=(7, 8))
    assert [r[2] for r in found] == [7] and counted.total < 3 * y4m.frame_size(16, 16)


def test_units():
    assert ranges.Ranged({}).units(10, "pts", 4) == range(0, 10)
    assert list(ranges.Ranged({"bounds": '{"pts": [100, null]}'}).units(10, "pts", 4)) == []
    assert ranges.Ranged({"bounds": '{"pts": [7, 9]}'}).units(10, "pts", 4) == range(1, 3)


def test_bounds_leave_other_queries_alone(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "a.wav").write_bytes(wav.build((np.arange(5000, dtype=np.float32) / 5000)[None], 8000))
    few = ranges.read(spark, "wav", str(tmp_path), options={"frame_samples": 100}, pts=(1000, 1250), stream_index=(0, 1))
    assert sorted(r.pts for r in few.collect()) == [1000, 1100, 1200]
    whole = spark.read.format("wav").option("frame_samples", 100).load(str(tmp_path))
    assert (whole.count(), whole.filter("pts >= 1000 and pts < 1250").count(), whole.count(), few.count()) == (50, 3, 50, 3)
    with pytest.raises(ValueError, match="bounds are on"):
        ranges.read(spark, "wav", str(tmp_path), data=(0, 1))


@pytest.mark.parametrize("prefix", ["", "file://"])
def test_paths_and_uris(spark, tmp_path, prefix):
    folder = tmp_path / "a b"
    folder.mkdir()
    (folder / "x.raw").write_bytes(b"12345")
    (folder / "y.other").write_bytes(b"1")
    path = prefix + str(folder)
    assert [os.path.basename(p) for p in files.matching(path, ".raw")] == ["x.raw"]
    assert [os.path.basename(p) for p in files.matching(path + "/*.o*")] == ["y.other"]
    with files.opening(files.matching(path, ".raw")[0]) as f:
        assert files.length_of(f) == 5
    listed = files.listed(spark, path, (".raw",)).collect()
    assert [r.length for r in listed] == [5]
    with files.opening(listed[0].path) as f:
        assert f.read(9) == b"12345"
    assert [(r.start, r.end) for r in files.splits(files.listed(spark, path, (".raw",)), 2).orderBy("start").collect()] == [(0, 2), (2, 4), (4, 5)]


def test_other_stores(monkeypatch, tmp_path):
    from pyarrow import fs

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.wav").write_bytes(wav.build(np.zeros((1, 300), np.float32), 8000))
    store = fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem())
    # a store that only pyarrow reads, in the place of one far away
    monkeypatch.setattr(files.fs, "FileSystem", SimpleNamespace(from_uri=lambda uri: (store, uri.split("://", 1)[1])))
    assert files.matching("s3a://in", ".wav") == ["s3a://in/a.wav"]
    assert files.matching("s3a://in/*.wav") == ["s3a://in/a.wav"]
    assert sum(r[3] for r in rows_of(wav.WavReader, {"path": "s3a://in"})) == 300


def test_streams_are_written_without_being_held(tmp_path):
    block = np.random.default_rng(1).random((1, 4096)).astype(np.float32)
    data = block.tolist()
    n = 1500
    rows = (SimpleNamespace(source=f"s{i % 2}", stream_index=0, pts=i // 2 * 4096, sample_rate=8000, data=data) for i in range(2 * n))
    tracemalloc.start()
    writer = wav_sink.WavWriter({"path": str(tmp_path)})
    writer.commit([writer.write(rows)])
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 6 << 20 < os.path.getsize(tmp_path / "s0.0.wav")
    head = wav.metadata_of(str(tmp_path / "s1.0.wav"))
    assert head["num_samples"] == n * 4096
    assert wav.parse((tmp_path / "s0.0.wav").read_bytes())["samples"].shape == (1, n * 4096)


def test_frames_out_of_order_come_into_order(spark, tmp_path):
    sources.register(spark)
    sound = [("a", 0, p, 4, 8000, [[p / 64 + k / 256 for k in range(4)]]) for p in (8, 0, 12, 4)]
    spark.createDataFrame(sound, AUDIO_FRAMES).coalesce(1).write.format("wav").mode("append").save(str(tmp_path / "w"))
    got = wav.parse((tmp_path / "w" / "a.0.wav").read_bytes())["samples"]
    assert np.allclose(got, np.concatenate([np.array(r[5], np.float32) for r in sorted(sound, key=lambda r: r[2])], 1), atol=1e-4)
    pictures = [("v", 0, i, i / 25, 1 / 25, (2, 2, 3), bytes([i]) * 12) for i in (2, 0, 1)]
    for name in ("rawframes", "y4m"):
        spark.createDataFrame(pictures, FRAMES).coalesce(1).write.format(name).mode("append").save(str(tmp_path / name))
    assert (tmp_path / "rawframes" / "v.0.raw").read_bytes() == b"".join(bytes([i]) * 12 for i in range(3))
    assert [r.frame_index for r in spark.read.format("y4m").load(str(tmp_path / "y4m")).orderBy("frame_index").collect()] == [0, 1, 2]
    assert sorted(os.listdir(tmp_path / "y4m")) == ["v.0.y4m"]


def test_files_are_known_by_their_first_bytes(spark, tmp_path):
    from sparkreel.schema import PACKETS
    from sparkreel.sources import containers, sink

    rows = [("a", 0, "audio", i, i * 10, i * 10, 10, True, False, 1, 8000, b"x" * 200) for i in range(5)]
    for kind in ("mp4", "matroska", "mpegts", "adts"):
        sink.write(spark.createDataFrame(rows, PACKETS + ", data binary"), str(tmp_path), kind)
    (tmp_path / "a.txt").write_bytes(b"no media")
    (tmp_path / "a.flac").write_bytes(b"fLaC")
    (tmp_path / "empty").write_bytes(b"")
    got = {os.path.basename(r.source): r.kind for r in containers.probed(spark, str(tmp_path)).collect()}
    assert got == {"a.mp4": "mp4", "a.mkv": "matroska", "a.ts": "mpegts", "a.aac": "audio", "a.txt": None, "a.flac": "audio"}  # Spark lists no empty files
    found = containers.packets(spark, str(tmp_path)).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in found} == {"mp4": 5, "matroska": 5, "mpegts": 5, "audio": 5}


def test_splits_of_files_are_dealt_out(spark, tmp_path):
    """Rows of a few bytes stand for a file's work each: Spark must not bring them all to one task."""
    for i in range(40):
        (tmp_path / f"{i}.bin").write_bytes(b"x" * 100)
    ranges = files.splits(files.listed(spark, str(tmp_path)), 50)
    met = ranges.select(F.spark_partition_id().alias("p")).collect()
    assert len(met) == 80 and len({r.p for r in met}) > 1
