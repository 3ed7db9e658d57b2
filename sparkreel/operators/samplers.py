"""Clip samplers: where clips start, which frames they hold, and what fills them up.

Each works on every stream of a table at once. Arguments that are wrong whatever the data fail at the call. What only a
stream's length can show (a range outside it, an unknown length or rate) leaves that stream out, or, with strict, fails the
query; clips that reach past a stream's end fail it with the 'error' policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkreel.functions.arrays import POLICIES
from sparkreel.functions.timebase import arange, clip_span, linspace_int, uniform

KEYS = ("stream_index",)


def _common(num_frames_per_clip: int, policy: str, num_clips: int = 1) -> None:
    if num_frames_per_clip <= 0:
        raise ValueError(f"a clip needs a frame at least, not num_frames_per_clip={num_frames_per_clip}")
    if num_clips <= 0:
        raise ValueError(f"num_clips={num_clips} asks for no clip")
    if policy not in POLICIES:
        raise ValueError(f"{policy!r} is no policy; there are {sorted(POLICIES)}")


def index_range(n: Column, start: int, end: int | None, span: int) -> tuple[Column, Column]:
    """Where clips may start: negative ends count from the last frame; by default no clip needs filling up."""
    a = F.lit(start).cast("long") + (n if start < 0 else F.lit(0).cast("long"))
    if end is None:
        b = F.greatest(n - span + 1, F.lit(1).cast("long"))
    else:
        b = F.least(F.lit(end).cast("long") + (n if end < 0 else F.lit(0).cast("long")), n)
    return a, b


def index_clips(starts: Column, n: Column, num_frames_per_clip: int, step: int, policy: str) -> Column:
    """For every start, num_frames_per_clip indices below n, filled up by policy."""
    reach = F.sequence(F.lit(0), F.lit(num_frames_per_clip - 1))
    return F.transform(starts, lambda s: POLICIES[policy](F.filter(F.transform(reach, lambda i: s + i * F.lit(step)), lambda x: x < n), num_frames_per_clip))


def time_clips(starts: Column, end_stream: Column, num_frames_per_clip: int, seconds: Column, policy: str) -> Column:
    """For every start, num_frames_per_clip instants before the stream's end, filled up by policy."""
    reach = F.sequence(F.lit(0), F.lit(num_frames_per_clip - 1))
    return F.transform(starts, lambda s: POLICIES[policy](F.filter(F.transform(reach, lambda i: s + i * seconds), lambda x: x < end_stream), num_frames_per_clip))


def _exploded(streams: DataFrame, clips: Column, name: str, keys: tuple[str, ...]) -> DataFrame:
    each = streams.select(*keys, F.posexplode(clips).alias("clip_id", "clip"))
    return each.select(*keys, "clip_id", F.posexplode("clip").alias("pos", name))


def _fitting(streams: DataFrame, fits: Column, strict: bool, message: str) -> DataFrame:
    """The streams that fit; with strict, any other one fails the query."""
    fits = F.coalesce(fits, F.lit(False))
    return streams.filter(F.when(fits, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")) if strict else fits)


def _index_sampler(streams: DataFrame, starts, num_frames_per_clip: int, step: int, start: int, end: int | None, policy: str, strict: bool, keys: tuple[str, ...]) -> DataFrame:
    _common(num_frames_per_clip, policy)
    if step <= 0:
        raise ValueError(f"num_indices_between_frames={step} does not move on")
    n = F.col("num_frames").cast("long")
    a, b = index_range(n, start, end, clip_span(num_frames_per_clip, step))
    bounded = streams.withColumns({"_a": a, "_b": b})
    fits = _fitting(bounded, (n > 0) & (F.col("_a") >= 0) & (F.col("_a") < n) & (F.col("_a") < F.col("_b")), strict, f"the sampling range from {start} to {end} holds no frame of a stream")
    return _exploded(fits, index_clips(starts(F.col("_a"), F.col("_b")), n, num_frames_per_clip, step, policy), "frame_index", keys)


def clips_at_regular_indices(streams: DataFrame, *, num_clips: int = 1, num_frames_per_clip: int = 1, num_indices_between_frames: int = 1, sampling_range_start: int = 0, sampling_range_end: int | None = None, policy: str = "repeat_last", strict: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """streams: keys, num_frames. keys, clip_id, pos, frame_index of clips evenly spread over the range."""
    _common(num_frames_per_clip, policy, num_clips)
    return _index_sampler(streams, lambda a, b: linspace_int(a, b - 1, num_clips), num_frames_per_clip, num_indices_between_frames, sampling_range_start, sampling_range_end, policy, strict, keys)


def clips_at_random_indices(streams: DataFrame, *, num_clips: int = 1, num_frames_per_clip: int = 1, num_indices_between_frames: int = 1, sampling_range_start: int = 0, sampling_range_end: int | None = None, policy: str = "repeat_last", seed: int = 0, strict: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same at starts drawn evenly from the range: the same for a seed, however rows are dealt out."""
    _common(num_frames_per_clip, policy, num_clips)
    draw = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(num_clips - 1)), lambda c: a + F.floor(uniform(seed, *[F.col(k) for k in keys], c) * (b - a)).cast("long"))
    return _index_sampler(streams, draw, num_frames_per_clip, num_indices_between_frames, sampling_range_start, sampling_range_end, policy, strict, keys)


def _time_sampler(streams: DataFrame, starts, num_frames_per_clip: int, seconds: float | None, start: float | None, end: float | None, policy: str, strict: bool, keys: tuple[str, ...]) -> DataFrame:
    _common(num_frames_per_clip, policy)
    if seconds is not None and seconds <= 0:
        raise ValueError(f"seconds_between_frames={seconds} does not move on")
    begin, finish = F.col("begin_stream_seconds"), F.col("end_stream_seconds")
    dt = F.lit(float(seconds)) if seconds is not None else 1.0 / F.col("average_fps")
    a = begin if start is None else F.lit(float(start))
    b = F.least(finish - (num_frames_per_clip - 1) * dt if end is None else F.lit(float(end)), finish)
    bounded = streams.withColumns({"_a": a, "_b": b, "_dt": dt})
    inside = (F.col("_a") >= begin) & (F.col("_a") < finish) & (F.col("_a") < F.col("_b"))
    fits = _fitting(bounded, finish.isNotNull() & F.col("_dt").isNotNull() & inside, strict, f"the sampling range from {start} to {end} s holds no instant of a stream, or its end or rate is unknown")
    return _exploded(fits, time_clips(starts(F.col("_a"), F.col("_b")), finish, num_frames_per_clip, F.col("_dt"), policy), "seconds", keys)


def clips_at_regular_timestamps(streams: DataFrame, *, seconds_between_clip_starts: float, num_frames_per_clip: int = 1, seconds_between_frames: float | None = None, sampling_range_start: float | None = None, sampling_range_end: float | None = None, policy: str = "repeat_last", strict: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """streams: keys, begin_stream_seconds, end_stream_seconds, average_fps. keys, clip_id, pos, seconds of clips that start at even intervals."""
    if seconds_between_clip_starts <= 0:
        raise ValueError(f"seconds_between_clip_starts={seconds_between_clip_starts} does not move on")
    return _time_sampler(streams, lambda a, b: arange(a, b, seconds_between_clip_starts), num_frames_per_clip, seconds_between_frames, sampling_range_start, sampling_range_end, policy, strict, keys)


def clips_at_random_timestamps(streams: DataFrame, *, num_clips: int = 1, num_frames_per_clip: int = 1, seconds_between_frames: float | None = None, sampling_range_start: float | None = None, sampling_range_end: float | None = None, policy: str = "repeat_last", seed: int = 0, strict: bool = False, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same at instants drawn evenly from the range."""
    _common(num_frames_per_clip, policy, num_clips)
    draw = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(num_clips - 1)), lambda c: a + uniform(seed, *[F.col(k) for k in keys], c) * (b - a))
    return _time_sampler(streams, draw, num_frames_per_clip, seconds_between_frames, sampling_range_start, sampling_range_end, policy, strict, keys)


# The older sampler.


class VideoTooShort(ValueError):
    """No clip of the wanted length fits."""


def uniform_index_starts(n: Column, num_clips: int, num_frames_per_clip: int, dilation: int, end: int | None = None) -> Column:
    """Starts from 0 to the last one that fits, both included."""
    last = (n if end is None else F.least(F.lit(end + 1).cast("long"), n)) - dilation * num_frames_per_clip
    return linspace_int(F.lit(0).cast("long"), last, num_clips)


def uniform_time_starts(begin: Column, end: Column, fps: Column, num_clips: int, num_frames_per_clip: int, dilation: int) -> Column:
    """Evenly spaced starts, the last one a clip's length before the end; null where none fits."""
    last = end - (num_frames_per_clip * dilation + 1) / fps
    steps = F.transform(F.sequence(F.lit(0), F.lit(num_clips - 1)), lambda i: begin + i * ((last - begin) / max(1, num_clips - 1)))
    return F.when(last >= begin, steps)


def sorted_random_time_starts(begin: Column, end: Column, fps: Column, num_clips: int, num_frames_per_clip: int, dilation: int, seed: int, *keys: Column) -> Column:
    last = end - (num_frames_per_clip * dilation + 1) / fps
    return F.when(last >= begin, F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(num_clips - 1)), lambda c: begin + uniform(seed, *keys, c) * (last - begin))))


def clip_from(index: DataFrame, starts: DataFrame, num_frames_per_clip: int, dilation: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """starts: keys, clip_id, t. Frames read on from the first at or after t, every dilation-th of them."""
    from sparkreel.operators.lookup import next_frame

    first = next_frame(index, starts.select(*keys, F.col("clip_id").alias("request_id"), F.col("t").alias("cursor")), keys)
    span = clip_span(num_frames_per_clip, dilation)
    asked = first.select(*keys, F.col("request_id").alias("clip_id"), F.posexplode(F.sequence(F.col("frame_index"), F.col("frame_index") + span - 1, F.lit(dilation).cast("long"))).alias("pos", "frame_index"))
    return asked.join(index, [*keys, "frame_index"])


def target_size(width: Column, height: Column, *, desired_width: int = 0, desired_height: int = 0, desired_min_dimension: int = 0, desired_max_dimension: int = 0) -> Column:
    """Size of resized frames, struct(w, h). A side that isn't given keeps the aspect ratio, cut to whole pixels; 0 means not given."""
    w_of = lambda h: ((width.cast("double") / height) * h).cast("int")
    h_of = lambda w: ((height.cast("double") / width) * w).cast("int")
    wide, small, large = width > height, F.lit(desired_min_dimension), F.lit(desired_max_dimension)
    if desired_width or desired_height:
        w = F.lit(desired_width) if desired_width else w_of(F.lit(desired_height))
        h = F.lit(desired_height) if desired_height else h_of(F.lit(desired_width))
    elif desired_min_dimension and desired_max_dimension:
        w, h = F.when(wide, large).otherwise(small), F.when(wide, small).otherwise(large)
    elif desired_min_dimension:
        w, h = F.when(wide, w_of(small)).otherwise(small), F.when(wide, small).otherwise(h_of(small))
    elif desired_max_dimension:
        w, h = F.when(wide, large).otherwise(w_of(large)), F.when(wide, h_of(large)).otherwise(large)
    else:
        w, h = width, height
    return F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"))
