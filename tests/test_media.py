import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreel import api, schema, sources
from sparkreel.frames import AudioSamples, Frame, FrameBatch
from sparkreel.functions import sql
from sparkreel.operators import audio, metadata, payload, samplers, stats
from sparkreel.sources import backends, mappings, raw, wav


def tone(n=4000, channels=2):
    t = np.arange(n) / 8000
    return np.stack([0.5 * np.sin(2 * np.pi * 440 * (k + 1) * t) for k in range(channels)]).astype(np.float32)


@pytest.mark.parametrize("bits, near", [(8, 1e-2), (16, 1e-4), (24, 1e-6), (32, 1e-6)])
def test_wav_round_trip(bits, near):
    got = wav.parse(wav.build(tone(), 8000, bits))
    assert got["sample_rate"] == 8000 and got["num_channels"] == 2 and np.abs(got["samples"] - tone()).max() < near


def test_wav_source_and_sink(spark, tmp_path):
    sources.register(spark)
    for k in range(2):
        (tmp_path / f"in{k}.wav").write_bytes(wav.build(tone(4000 + k), 8000))
    rows = spark.read.format("wav").option("frame_samples", 512).load(str(tmp_path))
    assert rows.groupBy("source").agg(F.sum("duration").alias("n")).orderBy("source").collect() == [("in0.wav", 4000), ("in1.wav", 4001)]
    out = tmp_path / "out"
    rows.repartition(3, "source", "stream_index").write.format("wav").mode("append").save(str(out))
    assert sorted(p.name for p in out.iterdir()) == ["in0.0.wav", "in1.0.wav"]
    assert np.abs(wav.parse((out / "in1.0.wav").read_bytes())["samples"] - tone(4001)).max() < 1e-4


def test_raw_frames(spark, tmp_path):
    sources.register(spark)
    images = np.random.default_rng(0).integers(0, 256, (70, 4, 6, 3), np.uint8)
    (tmp_path / "v.rgb").write_bytes(images.tobytes())
    frames = spark.read.format("rawframes").options(width=6, height=4, pixel="rgb24", fps=10).load(str(tmp_path / "v.rgb"))
    got = frames.orderBy("frame_index").collect()
    assert len(got) == 70 and bytes(got[66].data) == images[66].tobytes() and got[5].pts_seconds == 0.5
    frames.repartition(1).write.format("rawframes").mode("append").save(str(tmp_path / "o"))
    assert (tmp_path / "o" / "v.0.raw").read_bytes() == images.tobytes()
    small = payload.resized(frames, 2, 3).filter("frame_index = 1").head()
    assert len(small.data) == 18 and small["shape"]["h"] == 2
    assert raw.frame_bytes(3, 3, "yuv420p") == 9 + 8
    with pytest.raises(ValueError):
        raw.frame_bytes(3, 3, "x")


@pytest.mark.parametrize("standard", sorted(payload.COLOUR))
@pytest.mark.parametrize("full", [False, True])
def test_colour_round_trip(standard, full):
    flat = np.full((6, 8, 3), (200, 80, 30), np.uint8)
    again = payload.yuv420_to_rgb(payload.rgb_to_yuv420(flat, standard, full), 6, 8, standard, full)
    assert np.abs(again.astype(int) - flat).max() <= 3
    with pytest.raises(ValueError):
        payload.yuv420_to_rgb(b"123", 6, 8)


def test_resize_and_layout():
    x = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert payload.resize_bilinear(x, 4, 4) is x and payload.resize_bilinear(np.full((5, 7, 3), 9, np.uint8), 11, 3).tolist() == np.full((11, 3, 3), 9).tolist()
    assert payload.channels_first(x).shape == (3, 4, 4) and payload.channels_first(x)[1, 2, 3] == x[2, 3, 1]


def test_resample_and_remix():
    x = tone(8000, 1)
    up = payload.resample(x, 8000, 16000)
    want = 0.5 * np.sin(2 * np.pi * 440 * np.arange(16000) / 16000)
    assert up.shape == (1, 16000) and np.abs(up[0, 200:-200] - want[200:-200]).max() < 1e-2
    assert payload.resample(x, 8000, 8000) is x
    assert payload.remix(tone(), 1).shape[0] == 1 and payload.remix(x, 3).shape[0] == 3 and payload.remix(tone(10, 4), 2).shape[0] == 2
    with pytest.raises(ValueError):
        payload.remix(x, 9)


def test_sources_are_told_apart(tmp_path):
    data = wav.build(tone(), 8000)
    path = tmp_path / "a.wav"
    path.write_bytes(data)
    slow = io.BytesIO(data)
    slow.read = lambda n, f=io.BytesIO(data): f.read(min(n, 100))
    for source in (path, str(path), data, np.frombuffer(data, np.uint8), io.BytesIO(data), slow):
        assert api.AudioDecoder(source).get_all_samples().data.shape == (2, 4000)
    with pytest.raises(TypeError, match="binary"):
        wav.open_any(io.StringIO("x"))
    with pytest.raises(TypeError, match="is no source"):
        wav.open_any(123)
    with pytest.raises(ValueError):
        wav.open_any(np.zeros(3, np.float32))
    with pytest.raises(backends.NoBackend):
        api.AudioDecoder(b"\x00\x01")
    with pytest.raises(ValueError, match="were asked for"):
        wav.read_exactly(type("F", (), {"read": lambda self, n: b"x" * (n + 1)})(), 3)


def test_audio_ranges_and_encoder(tmp_path):
    decoder = api.AudioDecoder(api.AudioEncoder(tone(), sample_rate=8000).to_bytes())
    part = decoder.get_samples_played_in_range(0.1, 0.2)
    assert part.data.shape == (2, 800) and part.pts_seconds == 0.1 and part.duration_seconds == 0.1
    assert decoder.get_samples_played_in_range(0.1, 0.1).data.shape == (2, 0)
    with pytest.raises(ValueError):
        decoder.get_samples_played_in_range(2, 1)
    with pytest.raises(RuntimeError):
        decoder.get_samples_played_in_range(9, 10)
    encoder = api.AudioEncoder(tone(), sample_rate=8000)
    encoder.to_file(tmp_path / "x.wav", num_channels=1, sample_rate=16000)
    assert api.AudioDecoder(tmp_path / "x.wav").get_all_samples().data.shape == (1, 8000)
    out = io.BytesIO()
    encoder.to_file_like(out)
    assert out.getvalue() == encoder.to_bytes()
    for bad in (lambda: api.AudioEncoder(np.zeros((1, 1, 1), np.float32), sample_rate=1), lambda: api.AudioEncoder(np.zeros(3), sample_rate=1), lambda: api.AudioEncoder(tone(), sample_rate=0), lambda: encoder.to_bytes(bit_rate=-1)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(RuntimeError):
        encoder.to_bytes("mp3")
    with pytest.raises(RuntimeError):
        encoder.to_file_like(object())


@pytest.fixture(scope="module")
def decoder(spark):
    rows = [(i, i == 0 or i == 240, 1) for i in range(390)]
    return api.VideoDecoder(spark.createDataFrame(rows, "pts long, is_key boolean, duration long").repartition(2), tb=(1001, 30000))


def test_video_decoder(decoder):
    assert len(decoder) == 390 and decoder.key_frame_indices() == [0, 240]
    assert decoder.get_frame_played_at(6.02).pts_seconds == pytest.approx(6.006)
    assert decoder.get_frames_at([35, 25, -1]).pts_seconds == pytest.approx([35 * 1001 / 30000, 25 * 1001 / 30000, 389 * 1001 / 30000])
    assert len(decoder.get_frames_played_in_range(0.0, 13.013)) == 390 and len(decoder.get_frames_played_in_range(1.0, 1.0)) == 0
    assert len(decoder[-4:]) == 4 and decoder[3].shape == (3, 0, 0)
    index, time = decoder.get_frames_in_range(10, 14), decoder.get_frames_played_in_range(10 * 1001 / 30000, 14 * 1001 / 30000)
    assert index.pts_seconds.tolist() == time.pts_seconds.tolist()
    for bad, error in ((lambda: decoder.get_frame_at(390), IndexError), (lambda: decoder.get_frame_at(-391), IndexError), (lambda: decoder.get_frame_played_at(13.013), IndexError), (lambda: decoder.get_frames_played_at([14.0]), RuntimeError), (lambda: decoder["a"], TypeError), (lambda: decoder.get_frames_played_in_range(2, 1), ValueError), (lambda: decoder.get_frames_played_in_range(0, 14), ValueError)):
        with pytest.raises(error):
            bad()


def test_samplers_of_a_decoder(decoder):
    clips = api.clips_at_regular_timestamps(decoder, seconds_between_clip_starts=4.0, num_frames_per_clip=2)
    assert clips.pts_seconds.shape == (4, 2) and np.allclose(np.diff(clips.pts_seconds[:, 0]), 4, atol=0.05)
    assert api.clips_at_random_indices(decoder, num_clips=3, num_frames_per_clip=5, seed=2).pts_seconds.shape == (3, 5)
    assert api.clips_at_regular_indices(decoder, num_clips=2).pts_seconds.shape == (2, 1)
    assert api.clips_at_random_timestamps(decoder, num_clips=2, seed=1).pts_seconds.shape == (2, 1)
    with pytest.raises(ValueError):
        api.clips_at_regular_indices(decoder, sampling_range_start=1000)


def test_decoder_arguments(spark):
    frames = spark.createDataFrame([(0, 1)], "pts long, duration long")
    for options in ({"seek_mode": "x"}, {"dimension_order": "CHWN"}, {"custom_frame_mappings": "{}", "seek_mode": "approximate", "average_fps": 1.0, "num_frames": 1}, {"custom_frame_mappings": "{}"}):
        with pytest.raises(ValueError):
            api.VideoDecoder(frames, **options)
    with pytest.raises(RuntimeError):
        api.VideoDecoder(frames, seek_mode="approximate")
    near = api.VideoDecoder(frames.select((F.col("pts") * 1).alias("pts"), "duration"), seek_mode="approximate", average_fps=10.0, num_frames=20)
    assert near._index_at([0.55]) == [5] and len(near) == 20


def test_mappings(spark):
    good = json.dumps({"frames": [{"pkt_pts": 5, "pkt_duration": 2, "key_frame": 0}, {"pkt_pts": 3, "pkt_duration": 2, "key_frame": 1}]})
    decoder = api.VideoDecoder(spark.createDataFrame([(0, 1)], "pts long, duration long"), custom_frame_mappings=good, tb=(1, 1))
    assert len(decoder) == 2 and decoder.key_frame_indices() == [0] and decoder.get_frame_at(1).pts_seconds == 5
    for bad in ("{}", '{"valid": "json"}', '{"frames": [{"missing": "keys"}]}', "no json", '{"frames": []}'):
        with pytest.raises(ValueError):
            mappings.check(bad)


def test_timing_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"duration_time": "0.040000", "pts_time": f"{k * 0.04:.6f}"} for k in range(5)]))
    rows = mappings.read_timings(spark, str(tmp_path)).orderBy("frame_index").collect()
    assert len(rows) == 5 and rows[4].pts_seconds == pytest.approx(0.16)


def test_containers():
    image = np.zeros((3, 2, 2))
    assert [x for x in Frame(image, 1, 2)][1:] == [1.0, 2.0] and "shape" in repr(Frame(image, 1, 2))
    batch = FrameBatch(np.zeros((4, 3, 2, 2)), np.arange(4), np.ones(4))
    assert len(batch[::2]) == 2 and batch[np.arange(4) > 1].pts_seconds.tolist() == [2, 3] and len(list(batch)) == 4
    for bad in (lambda: Frame(np.zeros(3), 1, 2), lambda: FrameBatch(np.zeros((4, 3, 2, 2)), np.arange(3), np.ones(4)), lambda: AudioSamples(np.zeros(3), 0, 0, 1)):
        with pytest.raises(ValueError):
            bad()


def test_sql_functions(spark):
    sql.register(spark)
    r = spark.sql("SELECT pts_to_seconds(390, 1001, 30000) AS a, seconds_to_pts(2.5D, 1, 1) AS b, wrap_index(-1, 5) AS c, clip_span(5, 2) AS d, sample_offset(2.5D, 1) AS e, pts_or_dts(-9223372036854775808, 4) AS f").head()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (390 * 1001 / 30000, 3, 4, 9, 2, 4)
    got = spark.sql("SELECT s, pos, frame_index FROM VALUES (1), (2) AS t(s), LATERAL clip_indices(s, 5, 5, 2, 'wrap') ORDER BY s, pos").collect()
    assert [x.frame_index for x in got] == [1, 3, 1, 3, 1, 2, 4, 2, 4, 2]
    times = spark.sql("SELECT seconds FROM clip_timestamps(2D, 5D, 5, 1.5D, 'repeat_last')").collect()
    assert [x.seconds for x in times] == [2, 3.5, 3.5, 3.5, 3.5]


def test_a_frame_alone_goes_by_durations(spark):
    """Frames at 0, 0.5 and 1 s that last 0.1 s: in a gap, one frame alone is the next, frames of a list are the ones before."""
    gaps = api.VideoDecoder(spark.createDataFrame([(0, 100_000, True), (500_000, 100_000, False), (1_000_000, 100_000, False)], "pts long, duration long, is_key boolean"))
    assert gaps.get_frame_played_at(0.3).pts_seconds == 0.5 and gaps.get_frame_played_at(0.55).pts_seconds == 0.5 and gaps.get_frame_played_at(0.05).pts_seconds == 0.0
    assert gaps.get_frames_played_at([0.3]).pts_seconds.tolist() == [0.0]


def test_decoder_options_and_iteration(spark):
    images = np.random.default_rng(1).integers(0, 256, (6, 4, 6, 3), np.uint8)
    rows = [(k, 1, i, i * 40_000, 40_000, (4, 6, 3), bytearray(images[i].tobytes())) for k in (0, 1) for i in range(3 * (k + 1))]
    frames = spark.createDataFrame(rows, "stream_index int, source int, seq int, pts long, duration long, shape struct<h:int,w:int,c:int>, data binary")
    decoder = api.VideoDecoder(frames, stream_index=1, width=3, height=2, dimension_order="NHWC")
    assert len(decoder) == 6 and decoder[2].shape == (2, 3, 3) and [x.shape for x in decoder] == [(2, 3, 3)] * 6
    clips = api.VideoClipSampler(api.VideoSize(desired_min_dimension=2), api.ClipPlan(starts="uniform", clips=2, frames_per_clip=2))(decoder)
    assert [c.data.shape for c in clips] == [(2, 2, 3, 3)] * 2 and clips[1].pts_seconds.tolist() == [0.16, 0.2]
    timed = api.VideoClipSampler(plan=api.ClipPlan("time", "random", clips=3, frames_per_clip=2), seed=4)(decoder)
    assert [len(c) for c in timed] == [2, 2, 2] and all(b.pts_seconds[0] >= a.pts_seconds[0] for a, b in zip(timed, timed[1:], strict=False))
    assert len(api.VideoClipSampler(plan=api.ClipPlan(clips=4), seed=1)(decoder)) == 4
    with pytest.raises(NotImplementedError):
        api.VideoClipSampler(plan=api.ClipPlan(starts="periodic"))
    for plan in (api.ClipPlan(frames_per_clip=9), api.ClipPlan("time", frames_per_clip=99)):
        with pytest.raises(ValueError):
            api.VideoClipSampler(plan=plan)(decoder)
    with pytest.raises(ValueError):
        api.VideoDecoder(frames, num_threads=None)
    with pytest.raises(RuntimeError):
        api.VideoDecoder(frames, device="cuda")


def test_reader_of_a_container(spark):
    packets = spark.createDataFrame([("a", s, t, i, i * 40, i * 40, 40, i % 3 == 0, i == 9, 1, 1000) for s, t in ((0, "video"), (1, "audio"), (2, "video")) for i in range(10)], schema.PACKETS)
    blank = dict.fromkeys(spark.createDataFrame([], schema.STREAMS).columns)
    rows = [tuple({**blank, "source": "a", "stream_index": s, "media_type": t, "width": w, "height": w, "average_fps_from_header": 25.0, "num_frames_from_header": 10}.values()) for s, t, w in ((0, "video", 10), (1, "audio", None), (2, "video", 20))]
    streams = spark.createDataFrame(rows, schema.STREAMS)
    reader = api.MediaReader(packets, streams)
    with pytest.raises(RuntimeError):
        reader.next_frame()
    reader.add_video_stream(width=8, height=8)
    assert reader.active == ("video", 2) and reader.key_frame_indices() == [0, 3, 6]
    assert reader.next_frame().pts_seconds == 0 and reader.next_frame().pts_seconds == 0.04
    reader.seek(0.3)
    assert reader.next_frame().pts_seconds == 0.32 and reader.pts_equal(8, 0.32) and not reader.pts_equal(8, 0.32 + 1e-12)
    with pytest.raises(IndexError):
        reader.next_frame()
    assert json.loads(reader.report()) == {"frames": 3, "seeks": 1, "stream": 2}
    assert json.loads(reader.stream_json(1))["mediaType"] == "audio"
    approximate = api.MediaReader(packets, streams, "approximate")
    approximate.add_video_stream()
    sound = api.MediaReader(packets, streams, "approximate")
    sound.add_audio_stream()
    for bad, error in (
        (lambda: reader.stream_json(3), IndexError), (lambda: reader.add_video_stream(), RuntimeError), (lambda: sound.next_frame(), RuntimeError), (lambda: approximate.key_frame_indices(), RuntimeError),
        (lambda: api.MediaReader(packets, streams).add_video_stream(stream_index=1), ValueError), (lambda: api.MediaReader(packets, streams).add_audio_stream(), RuntimeError), (lambda: api.MediaReader(packets, streams, "x"), ValueError),
        (lambda: api.MediaReader(packets, streams, "approximate").add_audio_stream(num_channels=9), RuntimeError), (lambda: api.MediaReader(packets, streams).add_video_stream(color_conversion_library="x"), ValueError),
        (lambda: api.MediaReader(packets, streams, "custom_frame_mappings").add_video_stream(), ValueError),
    ):
        with pytest.raises(error):
            bad()


def test_streams_that_tasks_share_are_not_written(spark, tmp_path):
    sources.register(spark)
    (tmp_path / "a.wav").write_bytes(wav.build(tone(4000), 8000))
    rows = spark.read.format("wav").option("frame_samples", 100).option("frames_per_task", 7).load(str(tmp_path / "a.wav"))
    assert rows.rdd.getNumPartitions() == 6 and rows.count() == 40
    out = tmp_path / "out"
    with pytest.raises(Exception, match="repartition by source"):
        rows.write.format("wav").mode("append").save(str(out))
    assert not list(out.iterdir())
    rows.repartition("source", "stream_index").write.format("wav").mode("append").save(str(out))
    assert [p.name for p in out.iterdir()] == ["a.0.wav"] and np.abs(wav.parse((out / "a.0.wav").read_bytes())["samples"] - tone(4000)).max() < 1e-4


def test_header_without_samples(tmp_path):
    (tmp_path / "a.wav").write_bytes(wav.build(tone(4000), 8000, 24))
    head = wav.metadata_of(tmp_path / "a.wav")
    assert (head["sample_rate"], head["num_channels"], head["num_samples"], head["duration_seconds"], head["codec"]) == (8000, 2, 4000, 0.5, "pcm_s24")
    assert "samples" not in head
    with pytest.raises(ValueError):
        wav.metadata_of(b"RIFF")


@pytest.mark.parametrize("rate, wanted", [(8000, 16000), (44100, 16000), (8000, 8001)])
def test_resampling_in_chunks_equals_the_whole(spark, rate, wanted):
    x = np.random.default_rng(3).standard_normal((2, 5000)).astype(np.float32)
    rows = [(k, at, [c[at : at + 300].tolist() for c in x * (k + 1)]) for k in (0, 1) for at in range(0, 5000, 300)]
    frames = spark.createDataFrame(rows, "stream_index int, pts long, data array<array<double>>").repartition(3)
    out = audio.joined_chunks(audio.resampled(frames, rate, wanted, chunk=700)).orderBy("stream_index").collect()
    for k in (0, 1):
        assert np.allclose(np.array(out[k].data), payload.resample(x * (k + 1), rate, wanted), atol=1e-4)


def test_remixing_columns_equals_arrays(spark):
    x = np.arange(12, dtype=np.float64).reshape(3, 4)
    for have in (1, 2, 3):
        frame = spark.createDataFrame([(0, x[:have].tolist()), (1, [[] for _ in range(have)])], "k int, data array<array<double>>")
        for wanted in (1, 2, 3, 5):
            got = audio.remixed(frame, wanted).orderBy("k").collect()
            assert np.allclose(got[0].data, payload.remix(x[:have], wanted)) and [len(c) for c in got[1].data] == [0] * wanted
    with pytest.raises(ValueError):
        audio.remixed(frame, 9)


def test_strict_samplers_fail(spark):
    streams = spark.createDataFrame([(0, 390, 0.0, 13.0, 30.0), (1, 5, 0.0, 0.2, None)], "stream_index int, num_frames long, begin_stream_seconds double, end_stream_seconds double, average_fps double")
    by_index = lambda **k: samplers.clips_at_regular_indices(streams, sampling_range_start=10, **k)
    by_time = lambda **k: samplers.clips_at_random_timestamps(streams, num_frames_per_clip=2, **k)
    for sample, message in ((by_index, "holds no frame"), (by_time, "rate is unknown")):
        assert {r.stream_index for r in sample().collect()} == {0}
        with pytest.raises(Exception, match=message):
            sample(strict=True).collect()


def test_int_range_and_missing_streams(spark):
    assert spark.range(1).select(metadata.checked_int(F.lit(5).cast("long"), "n"), metadata.checked_int(F.lit(None).cast("long"), "n")).head()[:] == (5, None)
    with pytest.raises(Exception, match="out of an int's range"):
        spark.range(1).select(metadata.checked_int(F.col("id") + (1 << 31), "n")).collect()
    streams = spark.createDataFrame([], schema.STREAMS)
    with pytest.raises(Exception, match="no stream has the index 4"):
        metadata.stream_json_at(streams, spark.createDataFrame([("a", 4)], "source string, stream_index int")).collect()


def test_video_files(spark, tmp_path):
    sources.register(spark)
    flat = np.stack([np.tile(np.array([40 + k, 90, 200 - k], np.uint8)[:, None, None], (1, 5, 7)) for k in range(70)])
    api.VideoEncoder(flat, frame_rate=30000 / 1001).to_file(tmp_path / "v.y4m")
    head = backends.open_bytes((tmp_path / "v.y4m").read_bytes())
    assert (head["width"], head["height"], head["num_frames"], str(head["fps"])) == (7, 5, 70, "30000/1001")
    frames = spark.read.format("y4m").load(str(tmp_path / "v.y4m"))
    got = frames.orderBy("frame_index").collect()
    assert len(got) == 70 and got[30].pts_seconds == pytest.approx(30 * 1001 / 30000)
    for k in (0, 69):
        assert np.abs(np.frombuffer(got[k].data, np.uint8).reshape(5, 7, 3).astype(int) - flat[k].transpose(1, 2, 0)).max() <= 3
    decoder = api.VideoDecoder(frames)
    assert len(decoder) == 70 and decoder[3].shape == (3, 5, 7)
    frames.repartition("source", "stream_index").write.format("y4m").option("fps", "30000/1001").mode("append").save(str(tmp_path / "o"))
    again = backends.open_bytes((tmp_path / "o" / "v.0.y4m").read_bytes())
    assert (again["num_frames"], again["fps"]) == (head["num_frames"], head["fps"])
    for bad in (lambda: api.VideoEncoder(flat.astype(np.float32), frame_rate=1), lambda: api.VideoEncoder(flat[0], frame_rate=1), lambda: api.VideoEncoder(flat, frame_rate=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(backends.NoBackend):
        api.VideoEncoder(flat, frame_rate=1).to_file(tmp_path / "v.mp4")


def test_what_formats_hold(spark, tmp_path):
    for bad, error in ((("mp3", 1, 8000), backends.NoBackend), (("wav", 9, 8000), ValueError), (("wav", 1, 0), ValueError), (("wav", 1, 8000, 12), ValueError)):
        with pytest.raises(error):
            backends.check_audio(*bad)
    stats.write_results(spark.createDataFrame([("q", 1.5)], "name string, seconds double"), str(tmp_path / "r"))
    assert [tuple(r) for r in spark.read.json(str(tmp_path / "r")).select("name", "seconds").collect()] == [("q", 1.5)]
