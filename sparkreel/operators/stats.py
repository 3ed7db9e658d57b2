"""Figures of timed runs, and chunks of work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def run_stats(runs: DataFrame, by: str, value: str, frames: int = 1) -> DataFrame:
    """Median, quartiles, interquartile range, mean, deviation, extremes and frames per second of each group. Exact percentiles: groups are benchmark runs."""
    q = {p: F.percentile(F.col(value), F.lit(p / 100)) for p in (25, 50, 75)}
    out = runs.groupBy(by).agg(q[50].alias("median"), q[25].alias("p25"), q[75].alias("p75"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    return out.withColumns({"iqr": F.col("p75") - F.col("p25"), "fps": F.when(F.col("median") != 0, frames / F.when(F.col("median") != 0, F.col("median")))})


def chunk_of(position: Column, total: Column, chunks: int) -> Column:
    """Contiguous chunks of total // chunks positions; the last one takes the rest."""
    size = F.greatest(F.floor(total / chunks).cast("long"), F.lit(1).cast("long"))
    return F.least(F.floor(position / size).cast("long"), F.lit(chunks - 1).cast("long"))


def decode_plan(index: DataFrame, requests: DataFrame, keys: tuple[str, ...] = ("stream_index",)) -> DataFrame:
    """requests: keys, frame_index. By group of pictures: how many frames are asked for, and how many must be decoded if each group is decoded once, from its key frame to the last frame asked for."""
    asked = requests.distinct().join(index, [*keys, "frame_index"])
    first = index.groupBy(*keys, "gop_id").agg(F.min("frame_index").alias("first_frame"))
    needed = asked.groupBy(*keys, "gop_id").agg(F.count(F.lit(1)).alias("frames_asked"), F.max("frame_index").alias("last_frame"))
    return needed.join(first, [*keys, "gop_id"]).withColumn("frames_decoded", F.col("last_frame") - F.col("first_frame") + 1)


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """The rows of parts of the same columns, one after the other."""
    return reduce(DataFrame.unionByName, parts)


def stacked(frames: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """A row for each group (a clip: few frames): its values in order, and n, how many there are."""
    held = frames.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("held"))
    return held.select(*by, F.col(f"held.{value}").alias("values"), F.size("held").cast("long").alias("n"))


def seek_counters(frames: DataFrame, keys: tuple[str, ...] = ("stream_index",)) -> DataFrame:
    """frames with avoidable (index.seek_avoidable): by stream, how many frames were asked for, and how often that takes a seek or none."""
    once = lambda c: F.sum(c.cast("long"))
    return frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("frames_asked"), once(~F.col("avoidable")).alias("seeks"), once(F.col("avoidable")).alias("seeks_avoided"))


def request_counters(frames: DataFrame, index: DataFrame, order: str, keys: tuple[str, ...] = ("stream_index",)) -> DataFrame:
    """frames asked for in order, with avoidable (index.seek_avoidable): a row for each request, whose counters begin at zero.

    seeks_attempted, seeks_done, seeks_skipped, flushes (one a seek), packets_read, packets_sent and frames_received: on from the
    frame before where no seek is needed, else from the key frame, or from the first frame where there is none before.
    """
    groups = index.groupBy(*keys, "gop_id").agg(F.min("frame_index").alias("_first"))
    before = F.lag("frame_index").over(Window.partitionBy(*keys).orderBy(order))
    known = frames.withColumn("_prev", before).join(groups, [*keys, "gop_id"])
    n = F.when(F.col("avoidable"), F.col("frame_index") - F.col("_prev")).otherwise(F.col("frame_index") - F.col("_first") + 1)
    sought = (~F.col("avoidable")).cast("long")
    return known.select(*keys, order, F.lit(1).cast("long").alias("seeks_attempted"), sought.alias("seeks_done"), (1 - sought).alias("seeks_skipped"), sought.alias("flushes"), *(n.alias(c) for c in ("packets_read", "packets_sent", "frames_received")))


def placed(table: DataFrame, by: list[str]) -> DataFrame:
    """A printed table's rows (few) in order, with their place from 1."""
    return table.withColumn("place", F.row_number().over(Window.orderBy(*by)).cast("long")).orderBy(*by)


def write_results(results: DataFrame, path: str) -> None:
    """Figures of runs as JSON lines, a file for each task, for charts made elsewhere."""
    results.write.mode("overwrite").json(path)
