import pytest

from sparkreel.operators import index
from sparkreel.streaming import cursor

SCHEMA = "stream_index int, seq long, pts long, is_key boolean, is_discard boolean, duration long, dts long"


@pytest.fixture
def stored(spark, tmp_path):
    """Two streams in three files, in order of arrival."""
    rows = [(s, i, 10 * i, i % 4 == 0, i == 5, 10, i) for i in range(30) for s in (1, 2)]
    for k in range(3):
        spark.createDataFrame(rows[20 * k : 20 * k + 20], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    return str(tmp_path / "p")


def run(spark, frame, tmp_path, mode="append"):
    query = frame.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table("out").collect()


def test_micro_batches_give_the_batch_result(spark, stored, tmp_path):
    cursor.use_rocksdb(spark)
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(stored)
    got = run(spark, cursor.frame_index_stream(live), tmp_path)
    want = index.frame_index(spark.read.parquet(stored)).select("stream_index", "frame_index", "pts", "is_key", "gop_id").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_reading_on_hands_out_each_frame_once(spark, stored, tmp_path):
    cursor.use_rocksdb(spark)
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(stored)
    got = sorted((r.stream_index, r.pts) for r in run(spark, cursor.read_on(live, {2: 100}), tmp_path))
    assert got == sorted([(1, 10 * i) for i in range(30) if i != 5] + [(2, 10 * i) for i in range(10, 30)])


def test_bounds_grow(spark, stored, tmp_path):
    live = spark.readStream.schema(SCHEMA).parquet(stored)
    got = run(spark, cursor.stream_bounds_stream(live), tmp_path, "complete")
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in index.stream_bounds(spark.read.parquet(stored)).select("stream_index", "begin_pts", "end_pts", "num_frames").collect())


def test_samples_are_cut_to_frames_and_the_rest_goes_out_at_the_end(spark, tmp_path):
    cursor.use_rocksdb(spark)
    kind = "stream_index int, pos long, samples array<double>, is_last boolean"
    for k in range(4):
        rows = [(s, k, [float(10 * k + i) for i in range(7 + s)], k == 3 and s == 1) for s in (1, 2)]
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
    live = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    got = {}
    for r in sorted(run(spark, cursor.rechunk_stream(live, 5), tmp_path), key=lambda r: (r.stream_index, r.frame)):
        got.setdefault(r.stream_index, []).append(list(r.samples))
    for s, frames in got.items():
        whole = [float(10 * k + i) for k in range(4) for i in range(7 + s)]
        end = len(whole) if s == 1 else len(whole) // 5 * 5  # the second stream goes on
        assert frames == [whole[at : at + 5] for at in range(0, end, 5)]


@pytest.mark.parametrize(("rate", "wanted", "sizes"), [(8000, 16000, [1, 5, 300, 2]), (16000, 6000, [400, 7, 1]), (8000, 8000, [50, 50])])
def test_sound_is_resampled_as_it_comes(spark, tmp_path, rate, wanted, sizes):
    import time

    import numpy as np
    from sparkreel.operators import payload
    from sparkreel.streaming import resample

    cursor.use_rocksdb(spark)
    kind = "stream_index int, pos long, data array<array<double>>, is_last boolean"
    rng = np.random.default_rng(1)
    whole = {s: rng.random((s, 3 * sum(sizes) + s)) for s in (1, 2)}
    at = {1: 0, 2: 0}
    for n in [*sizes, *sizes, *sizes, None]:
        rows = []
        for s, x in whole.items():
            to = x.shape[1] if n is None else at[s] + n
            # stream 2 tells its end without samples, and two parts come the wrong way round
            parts = [(s, at[s], x[:, at[s] : to].tolist(), n is None and s == 1)] if to > at[s] else []
            if len(parts) and to - at[s] > 4:
                m = at[s] + 2
                parts = [(s, m, x[:, m:to].tolist(), n is None and s == 1), (s, at[s], x[:, at[s] : m].tolist(), False)]
            rows, at[s] = rows + parts, to
        spark.createDataFrame(rows + ([(2, at[2], None, True)] if n is None else []), kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "p"))
        time.sleep(0.02)  # files are taken by their age
    live = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p"))
    got = run(spark, resample.resample_stream(live, rate, wanted), tmp_path)
    for s, x in whole.items():
        parts = sorted((r.pos, r.data) for r in got if r.stream_index == s)
        assert [p for p, _ in parts] == [sum(len(d[0]) for _, d in parts[:i]) for i in range(len(parts))]
        joined = np.concatenate([np.array(d) for _, d in parts], 1)
        want = payload.resample_span(x, 0, rate, wanted, 0, payload.resampled_size(x.shape[1], rate, wanted))
        assert joined.shape == want.shape and np.allclose(joined, want, atol=1e-6)
        assert len(parts) > 1


def test_growing_files_are_read_once_whatever_fails(spark, tmp_path):
    import numpy as np
    from sparkreel.sources import growing, wav

    spark.dataSource.register(growing.GrowingSource)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    samples = (np.arange(1050) / 2048).astype(np.float32)
    whole = wav.build(samples[None], 8000)
    offset, failing = len(whole) - 2 * len(samples), []

    def grow(name, n, closed=False):
        head = whole[: offset - 4] + ((2 * n).to_bytes(4, "little") if closed else b"\0\0\0\0")
        (folder / name).write_bytes(head + whole[offset : offset + 2 * n])

    def store(batch, number):
        if failing:
            raise RuntimeError(failing.pop())
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    def go():
        live = spark.readStream.format("growing").option("kind", "wav").option("frame_samples", 100).load(str(folder))
        query = live.writeStream.foreachBatch(store).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    grow("a.wav", 250)
    (folder / "b.wav").write_bytes(b"RIFF")
    go()
    grow("a.wav", 730)
    grow("b.wav", 120)
    failing.append("lost")
    with pytest.raises(Exception, match="lost"):
        go()
    grow("a.wav", 1050, closed=True)  # it goes on meanwhile
    go()
    rows = spark.read.parquet(out).select("source", "pts", "duration", "data").collect()
    assert sorted((r.source, r.pts, r.duration) for r in rows) == [("a.wav", 100 * i, 50 if i == 10 else 100) for i in range(11)] + [("b.wav", 0, 100)]
    got = np.concatenate([np.array(r.data[0]) for r in sorted(rows, key=lambda r: r.pts) if r.source == "a.wav"])
    assert np.allclose(got, samples, atol=1e-4)


def test_growing_raw_frames(spark, tmp_path):
    from sparkreel.sources import growing

    reader = growing.GrowingReader({"path": str(tmp_path / "*.rgb"), "kind": "rawframes", "width": "2", "height": "2"})
    (tmp_path / "a.rgb").write_bytes(bytes(range(12)) * 2 + b"part")
    end = reader.latestOffset()
    assert list(end.values()) == [2]
    assert [r[2] for p in reader.partitions({}, end) for r in reader.read(p)] == [0, 1]
    (tmp_path / "a.rgb").write_bytes(bytes(12))
    with pytest.raises(ValueError, match="now holds 1"):
        reader.latestOffset()
    with pytest.raises(ValueError, match="only wav"):
        growing.GrowingReader({"path": "x", "kind": "mp4"})
