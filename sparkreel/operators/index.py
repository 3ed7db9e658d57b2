"""From packets to the frame index: scan, bounds, numbering, key frames, seek planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreel.functions.timebase import pts_or_dts, seconds_of
from sparkreel.schema import LAST_PTS

KEYS = ("stream_index",)


def scan(packets: DataFrame) -> DataFrame:
    """Packets that hold frames, timed by dts where pts is missing."""
    return packets.filter(~F.col("is_discard")).withColumn("pts", pts_or_dts(F.col("pts"), F.col("dts")))


def of_stream(packets: DataFrame, stream_index: int) -> DataFrame:
    """The one active stream; the filter reaches the file scan."""
    return packets.filter(F.col("stream_index") == stream_index)


def stream_bounds(packets: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Begin, end and number of frames of each stream, from content."""
    return scan(packets).groupBy(*keys).agg(F.min("pts").alias("begin_pts"), F.max(F.col("pts") + F.col("duration")).alias("end_pts"), F.count(F.lit(1)).alias("num_frames"))


def frame_index(packets: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Frames numbered by pts in each stream, with the next frame's pts and the group of pictures (-1 before a key frame).

    One exchange and one sort by stream. For streams too long for a task see frame_index_by_bucket.
    """
    by_pts = Window.partitionBy(*keys).orderBy("pts", "seq")
    return scan(packets).select("*",
        (F.row_number().over(by_pts) - 1).cast("long").alias("frame_index"),
        F.coalesce(F.lead("pts").over(by_pts), F.lit(LAST_PTS)).alias("next_pts"),
        (F.sum(F.col("is_key").cast("long")).over(by_pts.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("gop_id"),
    )


def frame_index_by_bucket(packets: DataFrame, ticks: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same index for streams of any length: numbered within buckets of ticks, then moved on by what earlier buckets hold.

    Only the counts of buckets, not frames, come together by stream, so one stream with most of the frames is spread out.
    """
    frames = scan(packets).withColumn("bucket", F.floor(F.col("pts") / F.lit(ticks)))
    inside = Window.partitionBy(*keys, "bucket").orderBy("pts", "seq")
    counts = frames.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("is_key").cast("long")).alias("k"), F.min("pts").alias("first"))
    before = Window.partitionBy(*keys).orderBy("bucket")
    past = before.rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select(*keys, "bucket",
        F.coalesce(F.sum("n").over(past), F.lit(0)).alias("n_before"), F.coalesce(F.sum("k").over(past), F.lit(0)).alias("k_before"),
        F.coalesce(F.lead("first").over(before), F.lit(LAST_PTS)).alias("then"),
    )
    numbered = frames.select("*",
        (F.row_number().over(inside) - 1).alias("i"), F.lead("pts").over(inside).alias("own_next"),
        F.sum(F.col("is_key").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("k"),
    )
    out = numbered.join(moved, [*keys, "bucket"])
    columns = [c for c in frames.columns if c != "bucket"]
    return out.select(*columns, (F.col("i") + F.col("n_before")).alias("frame_index"), F.coalesce("own_next", "then").alias("next_pts"), (F.col("k") + F.col("k_before") - 1).alias("gop_id"))


def key_frames(index: DataFrame) -> DataFrame:
    """Key frames with their number among all frames."""
    return index.filter("is_key")


def seek_targets(index: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """index with target_pts: the key frame before each frame, or the first one where there is none."""
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy("pts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    key_pts = F.when(F.col("is_key"), F.col("pts"))
    return index.withColumn("target_pts", F.coalesce(F.last(key_pts, ignorenulls=True).over(so_far), F.min(key_pts).over(whole)))


def seek_avoidable(frames: DataFrame, order: str, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """frames asked for in order, with avoidable: in the same group of pictures as the one before, and not behind it."""
    w = Window.partitionBy(*keys).orderBy(order)
    same = (F.lag("gop_id").over(w) == F.col("gop_id")) & (F.lag("frame_index").over(w) <= F.col("frame_index"))
    return frames.withColumn("avoidable", F.coalesce(same, F.lit(False)))


def from_mappings(parsed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A frame index from custom mappings (pts, duration, is_key, pos by stream)."""
    return frame_index(parsed.withColumns({"seq": F.col("pos"), "dts": F.col("pts"), "is_discard": F.lit(False)}), keys)


def timed(index: DataFrame, num: Column | int = 1, den: Column | int = 1_000_000) -> DataFrame:
    """index with its times in seconds."""
    last = F.col("next_pts") == LAST_PTS
    return index.withColumns({
        "pts_seconds": seconds_of(F.col("pts"), num, den),
        "next_pts_seconds": F.when(last, F.lit(float("inf"))).otherwise(seconds_of(F.col("next_pts"), num, den)),
        "duration_seconds": seconds_of(F.col("duration"), num, den),
    })


def limits(mode: str, begin_content: Column, end_content: Column, n_content: Column, duration_header: Column, n_header: Column) -> tuple[Column, Column, Column]:
    """Begin, end and number of frames that a seek mode goes by: content, or for 'approximate' zero and the header."""
    if mode == "approximate":
        return F.lit(0.0), duration_header, n_header
    return begin_content, end_content, n_content


def pts_differences(index: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """index with step: ticks since the frame before, null for the first."""
    return index.withColumn("step", F.col("pts") - F.lag("pts").over(Window.partitionBy(*keys).orderBy("frame_index")))


def mapping_bounds(parsed: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of custom mappings as they were given: begin (first row's pts), end (last row's pts + duration), number of frames."""
    return parsed.groupBy(*keys).agg(F.min_by("pts", "pos").alias("begin_pts"), F.max_by(F.col("pts") + F.col("duration"), "pos").alias("end_pts"), F.count(F.lit(1)).alias("num_frames"))
