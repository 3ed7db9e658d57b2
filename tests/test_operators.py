import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sparkreel.functions import arrays, timebase
from sparkreel.operators import audio, index, lookup, metadata, samplers, stats

NUM, DEN = 1001, 30000


@pytest.fixture(scope="module")
def packets(spark):
    """390 frames, 1001/30000 s each, key frames 0 and 240, and a packet that is passed over."""
    rows = [(0, i, i, i, 1, i in (0, 240), False) for i in range(390)] + [(0, 999, 7, 7, 1, True, True)]
    return spark.createDataFrame(rows, "stream_index int, seq long, pts long, dts long, duration long, is_key boolean, is_discard boolean").repartition(3)


@pytest.fixture(scope="module")
def frames(packets):
    return index.frame_index(packets).cache()


def value(spark, column):
    return spark.range(1).select(column.alias("x")).head().x


def test_index_and_bounds(packets, frames):
    assert [r.frame_index for r in index.key_frames(frames).orderBy("pts").collect()] == [0, 240]
    r = index.stream_bounds(packets).head()
    assert (r.begin_pts, r.end_pts, r.num_frames) == (0, 390, 390)
    assert frames.filter("frame_index = 389").head().next_pts == 2**63 - 1
    assert frames.filter("frame_index = 300").head().gop_id == 1


@pytest.mark.parametrize("ticks", [1, 7, 100, 10_000])
def test_bucketed_index_is_the_same(packets, frames, ticks):
    columns = ["stream_index", "frame_index", "pts", "next_pts", "gop_id", "is_key"]
    same = index.frame_index_by_bucket(packets, ticks).select(columns)
    assert sorted(same.collect()) == sorted(frames.select(columns).collect())


def test_played_at_golden_instants(spark, frames):
    asked = [6.006, 6.02, 6.039366, 0.84, 1.17, 0.85, 0.0]
    rows = spark.createDataFrame([(0, k, t) for k, t in enumerate(asked)], "stream_index int, request_id long, t double")
    line = index.timed(frames, NUM, DEN).select("stream_index", F.col("pts_seconds").alias("pts"), F.col("next_pts_seconds").alias("next_pts"), "frame_index")
    for find in (lookup.played_at, lookup.played_at_join, lambda a, b: lookup.played_at_by_bucket(a, b, 1), lambda a, b: lookup.played_at_by_bucket(a, b, 100)):
        got = {r.request_id: r.frame_index for r in find(line, rows).collect()}
        assert [got[k] for k in range(len(asked))] == [180, 180, 180, 25, 35, 25, 0]


def test_two_meanings_of_an_instant(spark):
    rows = [(0, 0, 0, 10, True), (0, 1, 100, 10, False), (0, 2, 200, 10, True)]
    frames = index.frame_index(spark.createDataFrame(rows, "stream_index int, seq long, pts long, duration long, is_key boolean").withColumns({"dts": F.col("pts"), "is_discard": F.lit(False)}))
    asked = spark.createDataFrame([(0, 0, 5), (0, 1, 50), (0, 2, 205), (0, 3, 150)], "stream_index int, request_id long, t long")
    by_next = {r.request_id: r.frame_index for r in lookup.played_at(frames, asked).collect()}
    by_duration = {r.request_id: r.frame_index for r in lookup.played_at_by_duration(frames, asked).collect()}
    assert by_next == {0: 0, 1: 0, 2: 2, 3: 1} and by_duration == {0: 0, 1: 1, 2: 2, 3: 2}


def test_indices_order_repeats_and_errors(spark, frames):
    rows = spark.createDataFrame([(0, k, i) for k, i in enumerate([35, 25, -1, -2, 25])], "stream_index int, pos int, idx long")
    for find in (lookup.at_indices, lookup.distinct_first, lookup.checked_indices):
        assert [r.frame_index for r in find(frames, rows).orderBy("pos").collect()] == [35, 25, 389, 388, 25]
    with pytest.raises(IndexError, match="no frame has the index"):
        lookup.checked_indices(frames, rows.withColumn("idx", F.lit(-391).cast("long")))


@pytest.mark.parametrize("key", [slice(15, 36, 5), slice(-4, None), slice(-3, 10000), slice(5, 5), slice(10000, None), slice(None, None, 100), slice(0, -380)])
def test_slices(frames, key):
    got = lookup.sliced(frames, key.start, key.stop, key.step or 1).orderBy("frame_index").collect()
    assert [r.frame_index for r in got] == list(range(390))[key]


def test_range_errors(frames):
    for a, b, s in ((-1, 3, 1), (0, 3, 0), (5, 3, 1)):
        with pytest.raises(ValueError):
            lookup.in_range(frames, a, b, s)


def test_ranges_and_cursors(spark, frames):
    asked = spark.createDataFrame([(0, 0, 10, 12), (0, 1, 10, 10), (0, 2, 388, 999)], "stream_index int, request_id long, start long, stop long")
    got = sorted((r.request_id, r.frame_index) for r in lookup.played_in_range(frames, asked).collect())
    assert got == [(0, 10), (0, 11), (2, 388), (2, 389)]
    cursors = spark.createDataFrame([(0, 0, -5), (0, 1, 389), (0, 2, 390)], "stream_index int, request_id long, cursor long")
    assert sorted((r.request_id, r.frame_index) for r in lookup.next_frame(frames, cursors).collect()) == [(0, 0), (1, 389)]


def test_seek_planning(spark, frames):
    rows = spark.createDataFrame([(0, k, i) for k, i in enumerate([180, 183, 250, 249])], "stream_index int, pos int, idx long")
    found = lookup.at_indices(frames, rows)
    assert [r.avoidable for r in index.seek_avoidable(found, "pos").orderBy("pos").collect()] == [False, True, False, False]
    plan = stats.decode_plan(frames, found.select("stream_index", "frame_index")).orderBy("gop_id").collect()
    assert [(r.frames_asked, r.frames_decoded) for r in plan] == [(2, 184), (2, 11)]
    assert index.seek_targets(frames).filter("frame_index = 239").head().target_pts == 0


@pytest.mark.parametrize("content, header, fps, duration, want", [(20, 10, None, None, 20), (10, None, None, None, 10), (None, 10, None, None, 10), (None, None, 60.0, 10.0, 600), (None, None, None, 10.0, None), (None, None, 60.0, None, None)])
def test_num_frames(spark, content, header, fps, duration, want):
    c = lambda x, t: F.lit(x).cast(t)
    assert value(spark, metadata.num_frames(c(content, "long"), c(header, "long"), c(fps, "double"), c(duration, "double"))) == want


@pytest.mark.parametrize("header, begin, end, frames, fps, want", [(60, 5, 20, None, None, 15), (60, 1, None, None, None, 60), (60, None, 1, None, None, 60), (None, 0, 10, None, None, 10), (None, None, None, 100, 10, 10), (None, None, None, None, 10, None), (None, None, None, 100, None, None)])
def test_duration(spark, header, begin, end, frames, fps, want):
    d = lambda x: F.lit(x).cast("double")
    assert value(spark, metadata.duration_seconds(d(header), d(begin), d(end), F.lit(frames).cast("long"), d(fps))) == want


def test_aspect_ratio(spark):
    r = lambda a, b: value(spark, metadata.pixel_aspect_ratio(F.lit(a).cast("int"), F.lit(b).cast("int")))
    assert tuple(r(1920, 1080)) == (16, 9) and r(None, 3) is None and r(4, 0) is None and tuple(r(7, 7)) == (1, 1)


def test_policies(spark):
    a = F.array(*[F.lit(x) for x in (1, 2, 3)])
    assert value(spark, arrays.repeat_last(a, 5)) == [1, 2, 3, 3, 3] and value(spark, arrays.wrap(a, 5)) == [1, 2, 3, 1, 2]
    assert value(spark, arrays.repeat_last(a, 3)) == value(spark, arrays.wrap(a, 3)) == [1, 2, 3]


@pytest.mark.parametrize("step, policy, want", [(1, "repeat_last", [[0, 1, 2, 3, 4], [1, 2, 3, 4, 4], [2, 3, 4, 4, 4]]), (2, "repeat_last", [[0, 2, 4, 4, 4], [1, 3, 3, 3, 3], [2, 4, 4, 4, 4]]), (1, "wrap", [[0, 1, 2, 3, 4], [1, 2, 3, 4, 1], [2, 3, 4, 2, 3]]), (2, "wrap", [[0, 2, 4, 0, 2], [1, 3, 1, 3, 1], [2, 4, 2, 4, 2]])])
def test_index_clips(spark, step, policy, want):
    starts = F.array(*[F.lit(x).cast("long") for x in (0, 1, 2)])
    assert value(spark, samplers.index_clips(starts, F.lit(5), 5, step, policy)) == want


@pytest.mark.parametrize("policy, want", [("repeat_last", [[0, 1.5, 3, 4.5, 4.5], [1, 2.5, 4, 4, 4], [2, 3.5, 3.5, 3.5, 3.5]]), ("wrap", [[0, 1.5, 3, 4.5, 0], [1, 2.5, 4, 1, 2.5], [2, 3.5, 2, 3.5, 2]])])
def test_time_clips(spark, policy, want):
    starts = F.array(*[F.lit(float(x)) for x in (0, 1, 2)])
    assert value(spark, samplers.time_clips(starts, F.lit(5.0), 5, F.lit(1.5), policy)) == want


def test_error_policy_fails(spark):
    with pytest.raises(Exception, match="error"):
        value(spark, samplers.index_clips(F.array(F.lit(3).cast("long")), F.lit(5), 5, 1, "error"))


def test_linspace_and_arange(spark):
    assert value(spark, timebase.linspace_int(F.lit(0), F.lit(10), 20)) == [int(i * 10 / 19) for i in range(20)]
    assert value(spark, timebase.linspace_int(F.lit(4), F.lit(9), 1)) == [4]
    assert value(spark, timebase.arange(F.lit(0.0), F.lit(1.0), 1 / 3 - 1e-9))[:3] == pytest.approx([0, 1 / 3, 2 / 3])
    assert value(spark, timebase.arange(F.lit(1.0), F.lit(1.0), 0.5)) == []


def streams(spark):
    return spark.createDataFrame([(0, 390, 0.0, 13.013, 29.97), (1, 5, 0.0, 0.2, 25.0), (2, 0, 0.0, 0.0, 25.0)], "stream_index int, num_frames long, begin_stream_seconds double, end_stream_seconds double, average_fps double")


@pytest.mark.parametrize("clips", [10, 50])
def test_regular_starts_are_distinct_and_ordered_over_a_short_range(spark, clips):
    out = samplers.clips_at_regular_indices(streams(spark), num_clips=clips, sampling_range_start=30, sampling_range_end=40).filter("stream_index = 0")
    got = [r.frame_index for r in out.orderBy("clip_id").collect()]
    assert got == sorted(got) and sorted(set(got)) == list(range(30, 40))


def test_random_samplers_repeat_for_a_seed(spark):
    draw = lambda seed, n: sorted(samplers.clips_at_random_indices(streams(spark).repartition(n), num_clips=20, num_frames_per_clip=3, seed=seed).collect())
    assert draw(1, 1) == draw(1, 5) != draw(2, 1)
    got = [r.frame_index for r in samplers.clips_at_random_indices(streams(spark), num_clips=200, sampling_range_start=-10, seed=3).filter("stream_index = 0").collect()]
    assert set(got) <= set(range(380, 390)) and len(set(got)) > 5
    times = [r.seconds for r in samplers.clips_at_random_timestamps(streams(spark), num_clips=50, num_frames_per_clip=2, seconds_between_frames=0.5).filter("stream_index = 0").collect()]
    assert all(0 <= t < 13.013 for t in times)


@pytest.mark.parametrize("options", [{"num_clips": 0}, {"num_frames_per_clip": 0}, {"num_indices_between_frames": 0}, {"policy": "none"}])
def test_sampler_arguments(spark, options):
    with pytest.raises(ValueError):
        samplers.clips_at_regular_indices(streams(spark), **options)


def test_target_size(spark):
    size = lambda w, h, **k: tuple(value(spark, samplers.target_size(F.lit(w), F.lit(h), **k)))
    assert size(480, 270) == (480, 270)
    assert size(480, 270, desired_height=100) == (177, 100) and size(480, 270, desired_width=100) == (100, 56)
    assert size(480, 270, desired_width=10, desired_height=20) == (10, 20)
    assert size(480, 270, desired_min_dimension=100) == (177, 100) and size(270, 480, desired_min_dimension=100) == (100, 177)
    assert size(480, 270, desired_max_dimension=100) == (100, 56) and size(480, 270, desired_min_dimension=50, desired_max_dimension=100) == (100, 50)


def test_legacy_starts(spark):
    got = spark.range(1).select(samplers.uniform_index_starts(F.lit(390), 4, 3, 2).alias("x"), samplers.uniform_time_starts(F.lit(0.0), F.lit(1.0), F.lit(10.0), 3, 2, 2).alias("y"), samplers.uniform_time_starts(F.lit(0.0), F.lit(0.1), F.lit(10.0), 3, 2, 2).alias("z")).head()
    assert got.x == [0, 128, 256, 384] and got.y == pytest.approx([0, 0.25, 0.5]) and got.z is None


def test_clip_from_reads_on(spark, frames):
    starts = spark.createDataFrame([(0, 0, 99), (0, 1, 386)], "stream_index int, clip_id long, t long")
    got = samplers.clip_from(frames, starts, 3, 2).orderBy("clip_id", "pos").collect()
    assert [(r.clip_id, r.frame_index) for r in got] == [(0, 99), (0, 101), (0, 103), (1, 386), (1, 388)]


def test_audio_starts_late(spark):
    """First pts 0.138125 s at 8 kHz: a millisecond past it is 8 samples, a hundredth of that none."""
    rows = [(0, 138125 + 72000 * k, 72000, [[float(k)] * 576]) for k in range(3)]
    frames = spark.createDataFrame(rows, "stream_index int, pts long, duration long, data array<array<double>>")
    count = lambda stop: audio.samples_played_in_range(frames, 0.0, stop, rate=8000).select(F.size(F.get("data", F.lit(0))).alias("n"), "pts_seconds").head()
    assert (count(0.138125 + 1e-3).n, count(0.138125 + 1e-5).n) == (8, 0)
    assert count(None).n == 3 * 576 and count(None).pts_seconds == pytest.approx(0.138125)
    with pytest.raises(ValueError):
        audio.overlapping(frames, 2.0, 1.0)


def test_metrics_and_rounding(spark):
    a, b = F.array(F.lit(0), F.lit(0)), F.array(F.lit(255), F.lit(0))
    assert value(spark, arrays.psnr(a, b)) == pytest.approx(10 * math.log10(2)) and value(spark, arrays.psnr(a, a)) == math.inf
    assert value(spark, arrays.within(a, b, 3)) == 50.0
    assert value(spark, timebase.closest_pts(F.lit(2.5), 1, 1)) == 3 and value(spark, timebase.closest_pts(F.lit(-2.5), 1, 1)) == -3
    assert value(spark, timebase.sample_offset(F.lit(2.5), 1)) == 2


def test_single_lookups_against_brute_force(spark):
    """Frames of any length, overlapping and with gaps, with key frames anywhere or nowhere; instants on, between and outside of them."""
    rnd = random.Random(2)
    frames, asked, want, first, ranges, between = [], [], {}, {}, [], set()
    for s in range(6):
        pts = sorted(rnd.sample(range(200), 25)) if s else [5, 5, 9, 9, 9, 20]
        own = [(s, i, p, i, rnd.randrange(1, 40), s != 3 and rnd.random() < 0.2, (pts[i + 1] if i + 1 < len(pts) else 2**62)) for i, p in enumerate(pts)]
        frames += own
        for k, t in enumerate(range(-3, 260, 4)):
            asked.append((s, k, t))
            keys = [f[2] for f in own if f[5]]
            key = max([x for x in keys if x <= t], default=min(keys, default=None))
            met = [f for f in own if (key is None or f[2] >= key) and (f[2] > t or f[2] <= t < f[2] + f[4])]
            if met:
                want[s, k] = min(met)[1]
            later = [f[1] for f in own if f[2] >= t]
            if later:
                first[s, k] = later[0]
            ranges.append((s, k, t, t + k % 9))
            between |= {(s, k, f[1]) for f in own if t < t + k % 9 and f[6] > t and f[2] < t + k % 9}
    index_ = spark.createDataFrame(frames, "stream_index int, frame_index long, pts long, seq long, duration long, is_key boolean, next_pts long").repartition(3)
    at = spark.createDataFrame(asked, "stream_index int, request_id long, t long")
    key = lambda r: (r.stream_index, r.request_id)
    assert {key(r): r.frame_index for r in lookup.played_at_by_duration(index_, at).collect()} == want
    assert {key(r): r.frame_index for r in lookup.next_frame(index_, at.withColumnRenamed("t", "cursor")).collect()} == first
    found = lookup.played_in_range(index_, spark.createDataFrame(ranges, "stream_index int, request_id long, start long, stop long")).collect()
    assert sorted((*key(r), r.frame_index) for r in found) == sorted(between)


def test_ranges_beyond_the_end_fail_where_they_are_checked(spark):
    frames = spark.createDataFrame([(1, i, 10 * i) for i in range(6)], "stream_index int, frame_index long, pts long")
    assert sorted(r.frame_index for r in lookup.checked_range(frames, 1, 6, 2).collect()) == [1, 3, 5]
    with pytest.raises(Exception, match="no frames up to 7: a stream has 6"):
        lookup.checked_range(frames, 1, 7).count()


def test_mappings_go_by_their_first_frame(spark):
    from sparkreel.sources import mappings

    def pts(*frames):
        return [(r.pts, r.duration, r.is_key) for r in mappings.exploded(spark.createDataFrame([(json.dumps({"frames": frames}),)], "mapping string")).orderBy("pos").collect()]

    assert pts({"pts": 5, "pkt_pts": 6, "pkt_duration": 2, "key_frame": 1}, {"pts": 7, "pkt_duration": 3, "key_frame": 0}) == [(5, 2, True), (7, 3, False)]
    for second in ({"pkt_pts": 7, "pkt_duration": 3, "key_frame": 0}, {"pts": 7, "duration": 3, "key_frame": 0}, {"pts": 7, "pkt_duration": 3}):
        with pytest.raises(Exception, match="in frame mappings"):
            pts({"pts": 5, "pkt_duration": 2, "key_frame": 1}, second)


def test_counters_begin_anew_with_each_request(spark):
    rows = [(1, i, 10 * i, 10 * i, 10, i in (2, 6), False) for i in range(9)]
    frames = index.frame_index(spark.createDataFrame(rows, "stream_index int, seq long, pts long, dts long, duration long, is_key boolean, is_discard boolean"))
    asked = spark.createDataFrame([(1, p, i) for p, i in enumerate([4, 5, 5, 3, 8, 1])], "stream_index int, pos int, idx long")
    found = index.seek_avoidable(lookup.at_indices(frames, asked), "pos")
    got = stats.request_counters(found, frames, "pos").orderBy("pos").collect()
    assert [(r.seeks_done, r.seeks_skipped, r.packets_read) for r in got] == [(1, 0, 3), (0, 1, 1), (0, 1, 0), (1, 0, 2), (1, 0, 3), (1, 0, 2)]
    assert all(r.seeks_attempted == 1 and r.flushes == r.seeks_done and r.packets_sent == r.frames_received == r.packets_read for r in got)
