"""Lookups and audio ranges by bucket: the same as by stream, and no row of a stream meets another but by bucket."""

import random
import re

import pytest
from pyspark.sql import functions as F
from sparkreel.operators import audio, index, lookup
from sparkreel.plans import catalogue

PACKETS = "stream_index int, seq long, pts long, dts long, duration long, is_key boolean, is_discard boolean"


def frames_of(spark, seed):
    rng = random.Random(seed)
    rows = []
    for s in range(6):
        at = rng.randrange(-50, 50)
        for i in range(rng.choice([1, 5, 60])):
            at += rng.choice([0, 1, 7, 40])
            # streams without a key frame, with late ones, frames that last over others and frames with gaps behind them
            rows.append((s, i, at, at, rng.choice([0, 1, 5, 30, 90]), s != 2 and rng.random() < 0.2 and i > s, False))
    return index.frame_index(spark.createDataFrame(rows, PACKETS))


def asked_of(spark, seed, lo=-80, hi=1200):
    rng = random.Random(seed)
    rows = [(s, i, rng.randrange(lo, hi)) for s in range(7) for i in range(60)]
    return spark.createDataFrame(rows, "stream_index int, request_id long, t long")


def plain(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("ticks", [1, 13, 100, 10_000])
def test_lookups_are_those_by_stream(spark, ticks):
    frames, asked = frames_of(spark, 5).cache(), asked_of(spark, 6).cache()
    columns = ("stream_index", "request_id", "t", "frame_index", "pts")
    want = plain(lookup.played_at_by_duration(frames, asked), *columns)
    assert len(want) > 100
    assert plain(lookup.played_at_by_duration_by_bucket(frames, asked, ticks), *columns) == want
    cursors = asked.withColumnRenamed("t", "cursor")
    columns = ("stream_index", "request_id", "cursor", "frame_index", "pts")
    assert plain(lookup.next_frame_by_bucket(frames, cursors, ticks), *columns) == plain(lookup.next_frame(frames, cursors), *columns)
    columns = ("stream_index", "request_id", "t", "key_pts")
    by = lambda rows: sorted(rows, key=str)
    assert by(tuple(r[c] for c in columns) for r in lookup.key_pts_by_bucket(frames, asked, ticks).collect()) == by(tuple(r[c] for c in columns) for r in lookup.key_pts_at(frames, asked).collect())
    ranges = asked.select("stream_index", "request_id", F.col("t").alias("start"), (F.col("t") + F.col("request_id") % 5 * 30).alias("stop"))
    columns = ("stream_index", "request_id", "frame_index", "pts", "start", "stop")
    assert plain(lookup.played_in_range_by_bucket(frames, ranges, ticks), *columns) == plain(lookup.played_in_range(frames, ranges), *columns)


def windows_by_stream_alone(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [w for w in re.findall(r"windowspecdefinition\(([^)]*)", plan) if "bucket" not in w and "request" not in w]


def test_one_long_stream(spark):
    n = 200_000
    packets = spark.range(n).select(F.lit(1).alias("stream_index"), F.col("id").alias("seq"), (F.col("id") * 40).alias("pts"), (F.col("id") * 40).alias("dts"), F.lit(40).cast("long").alias("duration"), (F.col("id") % 250 == 0).alias("is_key"), F.lit(False).alias("is_discard"))
    frames = index.frame_index_by_bucket(packets, 400_000)
    asked = spark.range(1000).select(F.lit(1).alias("stream_index"), F.col("id").alias("request_id"), (F.col("id") * 7919 % n * 40 + 13).alias("t"))
    played = lookup.played_at_by_duration_by_bucket(frames, asked, 400_000)
    assert windows_by_stream_alone(played) == []
    assert sorted((r.request_id, r.frame_index) for r in played.collect()) == [(i, i * 7919 % n) for i in range(1000)]
    ranges = spark.createDataFrame([(1, 0, 1000, n * 40), (1, 1, 79, 81), (1, 2, 5, 5)], "stream_index int, request_id long, start long, stop long")
    met = lookup.played_in_range_by_bucket(frames, ranges, 400_000)
    assert windows_by_stream_alone(met) == []
    assert {r.request_id: (r.n, r.lo, r.hi) for r in met.groupBy("request_id").agg(F.count("*").alias("n"), F.min("frame_index").alias("lo"), F.max("frame_index").alias("hi")).collect()} == {0: (n - 25, 25, n - 1), 1: (2, 1, 2)}


@pytest.mark.parametrize(("start", "stop"), [(0.0, None), (0.013, 0.2), (0.05, 0.05), (0.5, 0.7), (9.0, None)])
@pytest.mark.parametrize(("ticks", "chunk"), [(1, 7), (50_000, 64), (10**9, 10**6)])
def test_audio_ranges_in_chunks(spark, start, stop, ticks, chunk):
    rng = random.Random(4)
    rows = []
    for s in (1, 2):
        at = 0
        for _ in range(60):
            n = rng.choice([0, 1, 16, 33])
            rows.append((s, at, n * 1000, [[float(at + k + c) for k in range(n)] for c in range(s)]))
            at += n * 1000
    frames = spark.createDataFrame(rows, "stream_index int, pts long, duration long, data array<array<double>>")
    whole = {r.stream_index: r for r in audio.samples_played_in_range(frames, start, stop, rate=1000).collect()}
    parts = {}
    for r in audio.samples_in_chunks(frames, start, stop, rate=1000, ticks=ticks, chunk=chunk).orderBy("stream_index", "chunk").collect():
        parts.setdefault(r.stream_index, []).append(r)
    for s in (1, 2):
        want = whole[s].data if s in whole else []
        own = parts.get(s, [])
        if not want or not want[0]:
            assert own == []
            continue
        assert [r.chunk for r in own] == list(range(-(-len(want[0]) // chunk)))
        assert [sum((r.data[c] for r in own), []) for c in range(s)] == want
        assert own[0].pts_seconds == pytest.approx(whole[s].pts_seconds) and all(len(r.data[0]) == chunk for r in own[:-1])


def test_chunks_are_numbered_once_and_dealt_out(spark, tmp_path):
    """However many chunks, frames are sorted once: a task never holds a sort for each chunk."""
    rows = [(i, 1_704_067_200_000_000 + 1000 * (i * 7919 % 500), i % 3, "signup" if i % 5 == 0 else "error" if i % 7 == 0 else "view", 0.5) for i in range(500)]
    events = spark.createDataFrame(rows, "event_id long, us long, user_id long, event_type string, value double").withColumn("ts", F.timestamp_micros("us"))
    events.write.parquet(str(tmp_path / "events.parquet"))
    found = catalogue.QUERIES["chunks_concatenated"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 1 and "Union" not in plan
    kept = sorted(((u, us - 1_704_067_200_000_000, i) for i, us, u, kind, _ in rows if kind != "error"))
    number = {u: iter(range(500)) for u in range(3)}
    assert sorted(map(tuple, found.collect())) == sorted((u, next(number[u]), pts) for u, pts, _ in kept)
