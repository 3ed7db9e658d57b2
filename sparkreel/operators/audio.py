"""Audio ranges: which frames overlap, cutting to exact samples, joining and mixing channels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sparkreel.functions.timebase import closest_pts, sample_offset, seconds_of
from sparkreel.operators import layouts, payload
from sparkreel.workers import importable

KEYS = ("stream_index",)


def overlapping(frames: DataFrame, start_seconds: float, stop_seconds: float | None, num: int = 1, den: int = 1_000_000) -> DataFrame:
    """Frames that share time with [start, stop), on ticks rounded to the nearest; none if the two are equal."""
    if stop_seconds is not None and start_seconds > stop_seconds:
        raise ValueError(f"the range starts at {start_seconds} s, after its stop at {stop_seconds} s")
    start = closest_pts(F.lit(float(start_seconds)), num, den)
    met = frames.filter(start < F.col("pts") + F.col("duration"))
    if stop_seconds is None:
        return met
    if start_seconds == stop_seconds:
        return met.filter(F.lit(False))
    return met.filter(closest_pts(F.lit(float(stop_seconds)), num, den) > F.col("pts"))


def concatenated(frames: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """frames: keys, pts, data (channels of samples). Per stream: first_pts and each channel's samples in order of pts."""
    parts = frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pts", "data"))).alias("parts"))
    channels = F.size(F.get("parts", F.lit(0))["data"])
    joined = F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.flatten(F.transform("parts", lambda p: F.get(p["data"], c))))
    return parts.select(*keys, F.get("parts", F.lit(0))["pts"].alias("first_pts"), joined.alias("data"))


def cut(start_seconds: float, stop_seconds: float | None, first_seconds: Column, samples: Column, rate: Column | int) -> tuple[Column, Column, Column]:
    """First and end sample of [start, stop) in joined frames, and the time of the first."""
    rate_c = rate if isinstance(rate, Column) else F.lit(rate)
    begins_before = first_seconds < start_seconds
    begin = F.when(begins_before, sample_offset(F.lit(float(start_seconds)) - first_seconds, rate_c)).otherwise(F.lit(0).cast("long"))
    last = first_seconds + samples / rate_c
    end = samples.cast("long")
    if stop_seconds is not None:
        end = F.when(F.lit(float(stop_seconds)) < last, end - sample_offset(last - float(stop_seconds), rate_c)).otherwise(end)
    return begin, end, F.when(begins_before, F.lit(float(start_seconds))).otherwise(first_seconds)


def samples_played_in_range(frames: DataFrame, start_seconds: float = 0.0, stop_seconds: float | None = None, *, rate: int, num: int = 1, den: int = 1_000_000, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Per stream: the samples in [start, stop) by channel, pts_seconds, duration_seconds."""
    joined = concatenated(overlapping(frames, start_seconds, stop_seconds, num, den), keys)
    n = F.size(F.get("data", F.lit(0)))
    begin, end, at = cut(start_seconds, stop_seconds, seconds_of(F.col("first_pts"), num, den), n, rate)
    sliced = joined.withColumns({"_b": begin, "_e": F.greatest(begin, end), "pts_seconds": at})
    out = F.transform("data", lambda c: F.slice(c, (F.col("_b") + 1).cast("int"), (F.col("_e") - F.col("_b")).cast("int")))
    return sliced.select(*keys, "pts_seconds", ((F.col("_e") - F.col("_b")) / F.lit(float(rate))).alias("duration_seconds"), out.alias("data"))


def samples_in_chunks(frames: DataFrame, start_seconds: float = 0.0, stop_seconds: float | None = None, *, rate: int, ticks: int, num: int = 1, den: int = 1_000_000, chunk: int = 1 << 16, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The samples of samples_played_in_range() in rows of chunk samples: keys, chunk (from 0), pts_seconds, data. For streams of any length.

    Where a frame's samples go is a sum over the frames before it: within buckets of ticks, and of whole buckets, a row each.
    Nothing comes together by stream but that; a task makes a chunk of the frames that reach into it.
    """
    met = overlapping(frames, start_seconds, stop_seconds, num, den).withColumn("_n", F.coalesce(F.size(F.get("data", F.lit(0))), F.lit(0)).cast("long"))
    own = met.select(*keys, "pts", "data", "_n", F.floor(F.col("pts") / F.lit(ticks)).alias("_bucket"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("pts").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(*keys, "_bucket").agg(F.sum("_n").alias("n"), F.min("pts").alias("first"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    moved = sums.select(*keys, "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"), F.sum("n").over(whole).alias("_all"), F.min("first").over(whole).alias("_first"))
    begin, end, at = cut(start_seconds, stop_seconds, seconds_of(F.col("_first"), num, den), F.col("_all"), rate)
    placed = own.withColumn("_own", F.coalesce(F.sum("_n").over(inside), F.lit(0))).join(moved, [*keys, "_bucket"])
    spread = placed.select(*keys, "data", (F.col("_own") + F.col("_before")).alias("_at"), "_n", begin.alias("_b"), end.alias("_e"), at.alias("_pts"))
    some = spread.filter("_n > 0 and _at < _e and _at + _n > _b").withColumns({"_lo": F.greatest(F.col("_at"), F.col("_b")), "_hi": F.least(F.col("_at") + F.col("_n"), F.col("_e"))})
    dealt = some.withColumn("chunk", F.explode(F.expr(f"sequence((_lo - _b) div {chunk}, (_hi - 1 - _b) div {chunk})")))
    low, high = F.greatest(F.col("_lo"), F.col("_b") + F.col("chunk") * chunk), F.least(F.col("_hi"), F.col("_b") + (F.col("chunk") + 1) * chunk)
    part = F.transform("data", lambda c: F.slice(c, (low - F.col("_at") + 1).cast("int"), (high - low).cast("int")))
    parts = dealt.select(*keys, "chunk", "_pts", F.struct(low.alias("at"), part.alias("data")).alias("part")).groupBy(*keys, "chunk").agg(F.first("_pts").alias("_pts"), F.array_sort(F.collect_list("part")).alias("parts"))
    channels = F.size(F.get("parts", F.lit(0))["data"])
    joined = F.transform(F.sequence(F.lit(0), channels - 1), lambda c: F.flatten(F.transform("parts", lambda p: F.get(p["data"], c))))
    return parts.select(*keys, "chunk", (F.col("_pts") + F.col("chunk") * chunk / F.lit(float(rate))).alias("pts_seconds"), joined.alias("data"))


def all_samples(frames: DataFrame, **options) -> DataFrame:
    return samples_played_in_range(frames, **options)


def rechunked(samples: DataFrame, frame_size: int, position: str = "pos") -> DataFrame:
    """samples numbered from 0: the frame of frame_size each falls into; only the last frame may be short."""
    return samples.withColumns({"frame": F.floor(F.col(position) / frame_size).cast("long"), "offset": F.col(position) % frame_size})


def resampled(frames: DataFrame, rate: int, wanted: int, position: str = "pts", keys: tuple[str, ...] = KEYS, chunk: int = 1 << 16) -> DataFrame:
    """frames: keys, position (of the first sample), data (channels of samples). The stream at another rate: keys, position, data in frames of chunk samples.

    A sample depends on few around it, so chunks are made each by itself, from the frames that reach into it: a stream
    of any length is spread out, and the result is that of resampling it whole.
    """
    reach, ratio = payload.reach_of(rate, wanted), rate / wanted
    n = F.size(F.get("data", F.lit(0)))
    ends = frames.groupBy(*keys).agg(F.max(F.col(position) + n).alias("_n"))
    last = F.ceil(F.col("_n") * wanted / rate).cast("long")
    lowest = F.greatest(F.floor((F.col(position) - reach) / ratio / chunk), F.lit(0)).cast("long")
    highest = F.least(F.floor((F.col(position) + n + reach) / ratio / chunk), F.floor((last - 1) / chunk)).cast("long")
    dealt = frames.join(ends, list(keys)).filter(n > 0).select(*keys, F.col(position).cast("long").alias("_at"), "data", last.alias("_last"), F.explode(F.sequence(lowest, F.greatest(lowest, highest))).alias("_chunk"))

    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group.column("_at").to_pylist(), group.column("data").to_pylist(), strict=True), key=lambda r: r[0])
        first, end = rows[0][0], max(a + len(d[0]) for a, d in rows)
        part = np.zeros((max(len(d) for _, d in rows), end - first))
        for a, d in rows:
            part[: len(d), a - first : a - first + len(d[0])] = d
        k, size = group.column("_chunk")[0].as_py(), group.column("_last")[0].as_py()
        out = payload.resample_span(part, first, rate, wanted, k * chunk, max(k * chunk, min(size, (k + 1) * chunk)))
        return pa.table({**{c: group.column(c).slice(0, 1) for c in keys}, position: pa.array([k * chunk]), "data": pa.array([out.tolist()], pa.list_(pa.list_(pa.float32())))})

    importable(frames.sparkSession)
    schema = dealt.select(*keys).schema.add(position, "long").add("data", ArrayType(ArrayType(FloatType())))
    return dealt.groupBy(*keys, "_chunk").applyInArrow(run, schema)


def times(level: float):
    return lambda x: x * level


def summed(parts: list[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = F.zip_with(out, part, lambda a, b: a + b)
    return out


def weighted(data: str, row: tuple[float, ...], loudest: float) -> Column:
    """One channel: the sum of the channels, each as loud as the row tells, by loudest. Channels of one level are added first and scaled once, and the sum is divided once: no level is rounded before."""
    channel = lambda k: F.transform(F.get(data, F.lit(k)), lambda x: x.cast("double"))
    alike: dict[float, list[Column]] = {}
    for k, level in enumerate(row):
        if level:
            alike.setdefault(level, []).append(channel(k))
    if not alike:
        return F.transform(channel(0), times(0.0))
    out = summed([summed(parts) if level == 1 else F.transform(summed(parts), times(level)) for level, parts in alike.items()])
    return out if loudest == 1 else F.transform(out, lambda x: x / loudest)


def mixed(frames: DataFrame, source: str | int, target: str | int, data: str = "data") -> DataFrame:
    """frames whose channels are those of the layout source, in the layout target; frames of another number of channels are an error."""
    (rows, loudest), n = layouts.levels(source, target), len(layouts.speakers(source))
    wrong = F.raise_error(F.concat(F.lit(f"{source} has {n} channels, not "), F.size(data).cast("string")))
    made = F.array(*[weighted(data, row, loudest) for row in rows])
    return frames.withColumn(data, F.when(F.size(data) == n, made).otherwise(F.when(F.col(data).isNotNull(), wrong.cast("array<array<double>>"))))


def remixed(frames: DataFrame, wanted: int, data: str = "data") -> DataFrame:
    """frames with as many channels as wanted: one is the mean, one is copied to many, else the layouts that so many channels have are mixed."""
    if not 1 <= wanted <= 8:
        raise ValueError(f"1 to 8 channels can be made, not {wanted}")
    have, first = F.size(data), F.get(data, F.lit(0))
    mean = F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.aggregate(data, F.lit(0.0), lambda s, c: s + F.get(c, i).cast("double")) / have)
    mean = F.when(F.size(first) > 0, F.array(mean)).otherwise(F.array(F.array().cast("array<double>")))
    made = F.when(have == wanted, F.col(data)).when(have == 1, F.array_repeat(first, wanted))
    if wanted == 1:
        return frames.withColumn(data, made.otherwise(mean))
    for n in range(2, 9):
        if n != wanted:
            rows, loudest = layouts.levels(n, wanted)
            made = made.when(have == n, F.array(*[weighted(data, row, loudest) for row in rows]))
    return frames.withColumn(data, made)


def joined_chunks(frames: DataFrame, position: str = "pts", keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Channels of each stream joined in order: keys, data."""
    return concatenated(frames.withColumnRenamed(position, "pts") if position != "pts" else frames, keys).drop("first_pts")
