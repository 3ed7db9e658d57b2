"""The functions by name in SQL: scalar ones as SQL functions that Catalyst inlines, clip generators as table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkreel.workers import importable

SCALARS = {
    "pts_to_seconds": ("pts BIGINT, num INT, den INT", "DOUBLE", "CAST(pts AS DOUBLE) * num / den"),
    "seconds_to_pts": ("seconds DOUBLE, num INT, den INT", "BIGINT", "CAST(round(seconds * den / num) AS BIGINT)"),
    "pts_or_dts": ("pts BIGINT, dts BIGINT", "BIGINT", "coalesce(nullif(pts, -9223372036854775808), dts)"),
    "wrap_index": ("i BIGINT, n BIGINT", "BIGINT", "CASE WHEN i < 0 THEN i + n ELSE i END"),
    "clip_span": ("frames INT, step INT", "INT", "step * (frames - 1) + 1"),
    "sample_offset": ("seconds DOUBLE, rate INT", "BIGINT", "CAST(bround(seconds * rate) AS BIGINT)"),
}


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    importable(spark)
    for name, (arguments, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("clip_indices", ClipIndices)
    spark.udtf.register("clip_timestamps", ClipTimestamps)


def filled(values: list, size: int, policy: str) -> list:
    """values made size long by policy."""
    if len(values) >= size or not values:
        return values
    if policy == "repeat_last":
        return values + values[-1:] * (size - len(values))
    if policy == "wrap":
        return [values[i % len(values)] for i in range(size)]
    raise ValueError("the clip is too short, and the policy is 'error'")


@udtf(returnType="pos int, frame_index long")
class ClipIndices:
    """clip_indices(start, num_frames, frames_per_clip, step, policy)."""

    def eval(self, start: int, num_frames: int, frames_per_clip: int, step: int, policy: str):
        reach = range(start, min(start + step * (frames_per_clip - 1) + 1, num_frames), step)
        yield from enumerate(filled(list(reach), frames_per_clip, policy))


@udtf(returnType="pos int, seconds double")
class ClipTimestamps:
    """clip_timestamps(start, end_stream, frames_per_clip, seconds_between, policy)."""

    def eval(self, start: float, end_stream: float, frames_per_clip: int, seconds_between: float, policy: str):
        instants = [t for i in range(frames_per_clip) if (t := start + i * seconds_between) < end_stream]
        yield from enumerate(filled(instants, frames_per_clip, policy))
