"""Custom frame mappings: JSON that lists every frame's pts, duration and whether it is a key frame."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "struct<frames: array<map<string, string>>>"
WANTED = "in frame mappings each frame has pts or pkt_pts, duration or pkt_duration, and key_frame"


def check(text: str | bytes) -> None:
    """Fails as a decoder would on JSON that is no mapping."""
    try:
        frames = json.loads(text)["frames"]
        first = frames[0]
    except (ValueError, TypeError, KeyError, IndexError) as e:
        raise ValueError("frame mappings are JSON with a list of frames, one at least") from e
    if not ({"pts", "pkt_pts"} & first.keys() and {"duration", "pkt_duration"} & first.keys() and "key_frame" in first):
        raise ValueError(WANTED)


def exploded(rows: DataFrame, column: str = "mapping") -> DataFrame:
    """A row for each frame: the other columns, pos, pts, duration, is_key.

    The names of a mapping's members are those of its first frame; a later one that lacks them fails the query.
    """
    rest = [c for c in rows.columns if c != column]
    parsed = rows.select(*rest, F.from_json(column, SCHEMA)["frames"].alias("_frames"))
    first = F.get("_frames", F.lit(0))
    named = parsed.select(*rest, *(F.when(F.map_contains_key(first, n), F.lit(n)).otherwise(F.lit(f"pkt_{n}")).alias(f"_{n}") for n in ("pts", "duration")), F.posexplode("_frames").alias("pos", "f"))

    def member(name) -> Column:
        return F.coalesce(F.try_element_at("f", name), F.raise_error(F.lit(WANTED)))

    key = member(F.lit("key_frame"))
    return named.select(*rest, "pos", member(F.col("_pts")).cast("long").alias("pts"), member(F.col("_duration")).cast("long").alias("duration"), ((F.lower(key) == "true") | F.coalesce(key.try_cast("int") != 0, F.lit(False))).alias("is_key"))


def built(frames: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The other way: a mapping column for each stream."""
    entry = F.struct("pts", "duration", F.col("is_key").cast("int").alias("key_frame"))
    return frames.groupBy(*keys).agg(F.to_json(F.struct(F.array_sort(F.collect_list(entry)).alias("frames"))).alias("mapping"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """source, pos, pts, duration, is_key of every mapping file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("mapping"))
    return exploded(files)


def read_timings(spark: SparkSession, path: str) -> DataFrame:
    """Per-frame timing files (arrays of duration_time, pts_time as decimal strings): source, frame_index, pts_seconds, duration_seconds."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("source"), F.col("value").alias("json"))
    each = files.select("source", F.posexplode(F.from_json("json", "array<struct<duration_time: string, pts_time: string>>")).alias("frame_index", "f"))
    return each.select("source", F.col("frame_index").cast("long").alias("frame_index"), F.col("f.pts_time").cast("double").alias("pts_seconds"), F.col("f.duration_time").cast("double").alias("duration_seconds"))
