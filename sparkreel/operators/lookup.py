"""Frame lookups: by index, by range, by instant (as-of) and by time range, for many streams at once.

No lookup makes more rows than there are frames, requests and answers: instants and ranges are found on a time line of
frames and requests, sorted once by stream, and answers by equality join. Which side of a join is broadcast is left to
Spark, which knows the sizes when it gets there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkreel.functions.timebase import slice_bounds, wrapped_index

KEYS = ("stream_index",)
#: Frames of a block by which long ranges are fetched.
BLOCK = 1 << 12


class FrameIndexError(IndexError):
    """No such frame."""


def at_indices(index: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """requests: keys, pos, idx (negative from the end). A row for each request, repeats too, in no order but with pos; requests out of range give none."""
    sizes = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = requests.join(sizes, list(keys)).select(*keys, "pos", wrapped_index(F.col("idx"), F.col("n")).alias("frame_index"))
    return index.join(asked, [*keys, "frame_index"])


def checked_indices(index: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """at_indices, but a request out of range fails the call."""
    sizes = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    at = wrapped_index(F.col("idx"), F.col("n"))
    wrong = requests.join(sizes, list(keys), "left").filter(F.col("n").isNull() | (at < 0) | (at >= F.col("n"))).select("idx").head()
    if wrong:
        raise FrameIndexError(f"no frame has the index {wrong.idx}")
    return at_indices(index, requests, keys)


def distinct_first(index: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """As at_indices, but each frame is looked up once, however often it is asked for, then handed to all who asked."""
    sizes = index.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    asked = requests.join(sizes, list(keys)).select(*keys, "pos", wrapped_index(F.col("idx"), F.col("n")).alias("frame_index"))
    found = index.join(asked.select(*keys, "frame_index").distinct(), [*keys, "frame_index"])
    return asked.join(found, [*keys, "frame_index"])


def in_range(index: DataFrame, start: int, stop: int, step: int = 1) -> DataFrame:
    """Frames start, start + step, ... before stop."""
    if start < 0 or step <= 0:
        raise ValueError(f"start={start} must not be negative and step={step} must be positive")
    if stop < start:
        raise ValueError(f"stop={stop} must not be less than start={start}")
    i = F.col("frame_index")
    return index.filter((i >= start) & (i < stop) & ((i - start) % step == 0))


def checked_range(index: DataFrame, start: int, stop: int, step: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """in_range, but a stream of fewer than stop frames fails the query."""
    ends = index.groupBy(*keys).agg((F.max("frame_index") + 1).alias("_n"))
    short = F.raise_error(F.concat(F.lit(f"no frames up to {stop}: a stream has "), F.col("_n").cast("string")))
    # a filter may read this column alone, and so may a count: the check is part of what is kept
    known = ends.filter(F.when(F.col("_n") < stop, short.cast("boolean")).otherwise(F.lit(True)))
    return in_range(index, start, stop, step).join(known, list(keys)).drop("_n")


def sliced(index: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """What index[start:stop:step] means for each stream."""
    if step <= 0:
        raise ValueError("step must be positive")
    n = F.max("frame_index").over(Window.partitionBy(*keys)) + 1
    a, b = slice_bounds(start, stop, F.col("n"))
    i = F.col("frame_index")
    return index.withColumn("n", n).filter((i >= a) & (i < b) & ((i - a) % step == 0)).drop("n")


def played_at(index: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """requests: keys, request_id, t (ticks). The frame on screen at t: pts <= t < next pts.

    Requests and frames are laid on one time line by stream and the last frame is carried forward: one exchange, one
    sort, no rows but these, however many requests a stream has.
    """
    columns = [c for c in index.columns if c not in keys]
    nothing = [F.lit(None).cast(index.schema[c].dataType).alias(c) for c in columns]
    frame = F.struct(*columns)
    line = (
        index.select(*keys, F.col("pts").alias("at"), F.lit(0).alias("kind"), F.col("frame_index").alias("tie"), frame.alias("frame"), F.lit(None).cast("long").alias("request_id"))
        .unionByName(requests.select(*keys, F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), F.when(F.lit(False), F.struct(*nothing)).alias("frame"), F.col("request_id").cast("long").alias("request_id")))
    )
    w = Window.partitionBy(*keys).orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = line.withColumn("frame", F.last("frame", ignorenulls=True).over(w)).filter("kind = 1 and frame is not null")
    return carried.select(*keys, "request_id", F.col("at").alias("t"), "frame.*")


def played_at_by_bucket(index: DataFrame, requests: DataFrame, ticks: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same for streams of any length: the time line is cut into buckets of ticks, and each bucket knows the last frame before it.

    Only buckets, not frames or requests, come together by stream.
    """
    columns = [c for c in index.columns if c not in keys]
    frame = F.struct(*columns)
    cut = lambda c: F.floor(F.col(c) / F.lit(ticks))
    own = index.select(*keys, cut("pts").alias("bucket"), F.col("pts").alias("at"), F.lit(0).alias("kind"), F.col("frame_index").alias("tie"), frame.alias("frame"), F.lit(None).cast("long").alias("request_id"))
    kind = own.schema["frame"].dataType
    asked = requests.select(*keys, cut("t").alias("bucket"), F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(kind).alias("frame"), F.col("request_id").cast("long").alias("request_id"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("at", "kind", "tie").rowsBetween(Window.unboundedPreceding, 0)
    carried = own.unionByName(asked).withColumn("frame", F.last("frame", ignorenulls=True).over(inside)).filter("kind = 1")
    lasts = own.groupBy(*keys, "bucket").agg(F.max_by("frame", F.struct("at", "tie")).alias("last"))
    buckets = lasts.unionByName(asked.select(*keys, "bucket").distinct().withColumn("last", F.lit(None).cast(kind))).groupBy(*keys, "bucket").agg(F.first("last", ignorenulls=True).alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = buckets.select(*keys, "bucket", F.last("last", ignorenulls=True).over(earlier).alias("before"))
    found = carried.join(before, [*keys, "bucket"]).withColumn("frame", F.coalesce("frame", "before")).filter("frame is not null")
    return found.select(*keys, "request_id", F.col("at").alias("t"), "frame.*")


def carried(line: DataFrame, value: str, order: tuple[str, ...], ticks: int, keys: tuple[str, ...] = KEYS, backwards: bool = False) -> DataFrame:
    """line (keys, at, the columns of order and others) with value replaced by the last one that isn't null up to each row, by order; backwards: from the end.

    For streams of any length: rows come together by bucket of ticks, and by stream only what each bucket hands on, a row each.
    """
    own = line.withColumn("_bucket", F.floor(F.col("at") / F.lit(ticks)))
    by = [F.desc(c) if backwards else F.asc(c) for c in order]
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.struct(*order)
    pick = F.min_by if backwards else F.max_by
    held = F.col(value).isNotNull()
    handed = own.groupBy(*keys, "_bucket").agg(pick(F.when(held, F.col(value)), F.when(held, rank)).alias("_last"))
    before = Window.partitionBy(*keys).orderBy(F.desc("_bucket") if backwards else F.asc("_bucket")).rowsBetween(Window.unboundedPreceding, -1)
    moved = handed.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(before).alias("_before"))
    seen = own.withColumn(value, F.last(value, ignorenulls=True).over(inside))
    return seen.join(moved, [*keys, "_bucket"]).withColumn(value, F.coalesce(F.col(value), F.col("_before"))).drop("_bucket", "_before")


def highest(line: DataFrame, value: str, order: tuple[str, ...], ticks: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """line with _high: the greatest value before each row, by order; made of buckets as in carried()."""
    own = line.withColumn("_bucket", F.floor(F.col("at") / F.lit(ticks)))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    handed = own.groupBy(*keys, "_bucket").agg(F.max(value).alias("_most"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    moved = handed.select(*keys, "_bucket", F.max("_most").over(before).alias("_before"))
    return own.withColumn("_own", F.max(value).over(inside)).join(moved, [*keys, "_bucket"]).withColumn("_high", F.greatest("_own", "_before")).drop("_bucket", "_own", "_before")


def played_at_join(index: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The same by an equality join with a range residual; the better plan for a few requests a stream."""
    return index.join(requests, list(keys)).filter((F.col("pts") <= F.col("t")) & (F.col("t") < F.col("next_pts")))


def played_at_by_duration(index: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The single-frame lookup of a decoder that has just sought the key frame for t.

    By pts from that key frame (the first one where t lies before), the first frame that has begun and not ended at t,
    by its own duration, or that begins after t.

    From a key frame on, the first frame that ends after t is one that ends later than all before it. Such a frame
    answers for the instants from their latest end to its own, so it is found as of t; where it begins after t, or there
    is none, the answer is the stream's first frame after t.
    """
    end = F.col("pts") + F.col("duration")
    key = F.when(F.col("is_key"), F.col("pts"))
    so_far = Window.partitionBy(*keys).orderBy("pts").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    known = index.withColumns({"key_pts": F.max(key).over(so_far), "any_key": F.max(key).over(Window.partitionBy(*keys))}).filter("any_key is null or key_pts is not null")
    before = Window.partitionBy(*keys, "key_pts").orderBy("pts", "seq").rowsBetween(Window.unboundedPreceding, -1)
    frame = F.struct("pts", "seq", "frame_index").alias("frame")
    latest = known.select(*keys, "key_pts", frame, end.alias("end"), F.max(end).over(before).alias("at")).filter("at is null or end > at")
    asked = key_pts_at(index, requests, keys)
    line = latest.select(*keys, "key_pts", "at", F.lit(0).alias("kind"), F.struct("frame", "end").alias("held"), F.lit(None).cast("long").alias("request_id"))
    line = line.unionByName(asked.select(*keys, "key_pts", F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(line.schema["held"].dataType).alias("held"), F.col("request_id").cast("long").alias("request_id")))
    w = Window.partitionBy(*keys, "key_pts").orderBy(F.asc_nulls_first("at"), "kind").rowsBetween(Window.unboundedPreceding, 0)
    here = line.withColumn("held", F.last("held", ignorenulls=True).over(w)).filter("kind = 1")
    shown = F.when((F.col("held.frame.pts") <= F.col("at")) & (F.col("at") < F.col("held.end")), F.col("held.frame"))
    after = _first_from(known, here.select(*keys, "request_id", F.col("at").alias("t"), shown.alias("shown")), "t", keys, strict=True)
    found = after.withColumn("frame", F.coalesce("shown", "frame")).filter("frame is not null")
    return found.select(*keys, "request_id", "t", "frame.frame_index", "frame.pts")


def played_at_by_duration_by_bucket(index: DataFrame, requests: DataFrame, ticks: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """played_at_by_duration for streams, and groups of pictures, of any length: every time line is cut into buckets of ticks."""
    frame = F.struct("pts", "seq", "frame_index")
    kind = index.select(frame.alias("f")).schema["f"].dataType
    line = index.select(*keys, F.col("pts").alias("at"), "seq", "frame_index", (F.col("pts") + F.col("duration")).alias("end"), F.when(F.col("is_key"), F.col("pts")).alias("key_pts"))
    any_key = line.groupBy(*keys).agg(F.max("key_pts").alias("any_key"))
    # a key frame counts for all that begin when it does
    keyed = carried(line.withColumn("_late", F.col("key_pts").isNull()), "key_pts", ("at", "_late", "seq"), ticks, keys)
    known = keyed.join(any_key, list(keys)).filter("any_key is null or key_pts is not null")
    # without a key frame the whole stream is one group
    group = F.coalesce("key_pts", F.lit(-(2**63))).alias("key_pts")
    parts = known.select(*keys, group, "at", "seq", "end", F.struct(F.col("at").alias("pts"), "seq", "frame_index").alias("frame"))
    inner = (*keys, "key_pts")
    latest = highest(parts, "end", ("at", "seq"), ticks, inner).filter("_high is null or end > _high")
    held = F.struct("frame", "end").alias("held")
    ends = latest.select(*inner, F.coalesce("_high", "frame.pts").alias("at"), F.lit(0).alias("kind"), F.col("frame.seq").alias("tie"), held, F.lit(None).cast("long").alias("request_id"))
    asked = key_pts_by_bucket(index, requests, ticks, keys).withColumn("key_pts", F.coalesce("key_pts", F.lit(-(2**63))))
    both = ends.unionByName(asked.select(*inner, F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast(ends.schema["tie"].dataType).alias("tie"), F.lit(None).cast(ends.schema["held"].dataType).alias("held"), F.col("request_id").cast("long").alias("request_id")))
    here = carried(both, "held", ("at", "kind", "tie"), ticks, inner).filter("kind = 1")
    shown = F.when((F.col("held.frame.pts") <= F.col("at")) & (F.col("at") < F.col("held.end")), F.col("held.frame").cast(kind))
    begun = known.select(*keys, F.col("at").alias("pts"), "seq", "frame_index")
    after = first_from_by_bucket(begun, here.select(*keys, "request_id", F.col("at").alias("t"), shown.alias("shown")), "t", ticks, keys, strict=True)
    found = after.withColumn("frame", F.coalesce("shown", "frame")).filter("frame is not null")
    return found.select(*keys, "request_id", "t", "frame.frame_index", "frame.pts")


def first_from_by_bucket(index: DataFrame, requests: DataFrame, at: str, ticks: int, keys: tuple[str, ...], strict: bool) -> DataFrame:
    """requests with frame, as _first_from() gives it, for streams of any length."""
    frame, asked = F.struct("pts", "seq", "frame_index"), F.struct(*[c for c in requests.columns if c not in keys])
    # read backwards: at one instant a request comes before (strict) or after the frames that begin there
    kind = 1 if strict else -1
    frames = index.select(*keys, F.col("pts").alias("at"), F.lit(0).alias("kind"), F.col("seq").cast("long").alias("tie"), frame.alias("frame"))
    line = requests.select(*keys, F.col(at).alias("at"), F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("tie"), F.lit(None).cast(frames.schema["frame"].dataType).alias("frame"), asked.alias("_asked"))
    met = carried(frames.unionByName(line, allowMissingColumns=True), "frame", ("at", "kind", "tie"), ticks, keys, backwards=True)
    return met.filter(f"kind = {kind}").select(*keys, "_asked.*", "frame")


def key_pts_by_bucket(index: DataFrame, requests: DataFrame, ticks: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """requests with key_pts, as key_pts_at() gives it, for streams of any length."""
    keyed = index.filter("is_key")
    first = keyed.groupBy(*keys).agg(F.min("pts").alias("first_key"))
    frames = keyed.select(*keys, F.col("pts").alias("at"), F.lit(0).alias("kind"), F.col("pts").alias("key_pts"), F.lit(None).cast("long").alias("request_id"))
    line = frames.unionByName(requests.select(*keys, F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("key_pts"), F.col("request_id").cast("long").alias("request_id")))
    met = carried(line, "key_pts", ("at", "kind"), ticks, keys).filter("kind = 1")
    return met.join(first, list(keys), "left").select(*keys, "request_id", F.col("at").alias("t"), F.coalesce("key_pts", "first_key").alias("key_pts"))


def next_frame_by_bucket(index: DataFrame, cursors: DataFrame, ticks: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """next_frame for streams of any length."""
    met = first_from_by_bucket(index, cursors, "cursor", ticks, keys, strict=False).filter("frame is not null")
    return met.select(*keys, "request_id", "cursor", "frame.frame_index", "frame.pts")


def played_in_range_by_bucket(index: DataFrame, ranges: DataFrame, ticks: int, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """played_in_range for streams of any length, and ranges of any: the frames of a range are fetched by bucket, not from one list."""
    some = ranges.filter("start < stop")
    mark = lambda at, kind: some.select(*keys, F.col(at).alias("at"), F.lit(kind).alias("kind"), F.col("request_id").cast("long").alias("request_id"), "start", "stop")
    frames = index.select(*keys, F.col("pts").alias("at"), F.lit(1).alias("kind"), "frame_index", F.col("frame_index").alias("tie"))
    line = frames.unionByName(mark("stop", 0).unionByName(mark("start", 2)), allowMissingColumns=True).withColumn("tie", F.coalesce("tie", F.lit(0)))
    seen = carried(line, "frame_index", ("at", "kind", "tie"), ticks, keys).filter("kind != 1")
    ends = seen.groupBy(*keys, "request_id", "start", "stop").agg(F.coalesce(F.max(F.when(F.col("kind") == 2, F.col("frame_index"))), F.lit(0)).alias("first"), F.max(F.when(F.col("kind") == 0, F.col("frame_index"))).alias("last"))
    blocks = ends.filter("first <= last").withColumn("_block", F.explode(F.expr(f"sequence(first div {BLOCK}, last div {BLOCK})")))
    return index.withColumn("_block", F.expr(f"frame_index div {BLOCK}")).join(blocks, [*keys, "_block"]).filter("frame_index between first and last").drop("_block", "first", "last")


def _first_from(index: DataFrame, requests: DataFrame, at: str, keys: tuple[str, ...], strict: bool) -> DataFrame:
    """requests with frame, struct(pts, seq, frame_index): the first frame at or after the column at (strict: after it), or null. One time line read backwards."""
    frame, asked = F.struct("pts", "seq", "frame_index"), F.struct(*[c for c in requests.columns if c not in keys])
    frames = index.select(*keys, F.col("pts").alias("_at"), F.lit(0).alias("_kind"), F.col("seq").alias("_tie"), frame.alias("frame"))
    line = requests.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(index.schema["seq"].dataType).alias("_tie"), asked.alias("_asked"))
    line = frames.unionByName(line, allowMissingColumns=True)
    kind = F.desc("_kind") if strict else F.asc("_kind")
    w = Window.partitionBy(*keys).orderBy(F.desc("_at"), kind, F.desc("_tie")).rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("frame", F.last("frame", ignorenulls=True).over(w)).filter("_kind = 1").select(*keys, "_asked.*", "frame")


def key_pts_at(index: DataFrame, requests: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """requests with key_pts: the last key frame at or before t, or the stream's first."""
    keyed = index.filter("is_key")
    first = keyed.groupBy(*keys).agg(F.min("pts").alias("first_key"))
    line = keyed.select(*keys, F.col("pts").alias("at"), F.lit(0).alias("kind"), F.col("pts").alias("key_pts"), F.lit(None).cast("long").alias("request_id")).unionByName(
        requests.select(*keys, F.col("t").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("key_pts"), F.col("request_id").cast("long").alias("request_id"))
    )
    w = Window.partitionBy(*keys).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = line.withColumn("key_pts", F.last("key_pts", ignorenulls=True).over(w)).filter("kind = 1")
    return carried.join(first, list(keys), "left").select(*keys, "request_id", F.col("at").alias("t"), F.coalesce("key_pts", "first_key").alias("key_pts"))


def index_at_approximate(seconds: Column, fps: Column) -> Column:
    """The frame at an instant, from the average rate alone."""
    return F.floor(seconds * fps).cast("long")


def index_bound_approximate(seconds: Column, fps: Column) -> Column:
    """The first frame that begins at an instant or later, from the average rate alone."""
    return F.ceil(seconds * fps).cast("long")


def pts_approximate(i: Column, fps: Column, num: int = 1, den: int = 1_000_000) -> Column:
    return F.round(i / fps * den / num).cast("long")


def played_in_range(index: DataFrame, ranges: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """ranges: keys, request_id, start, stop (ticks). Frames on screen at any time in [start, stop); none if they are equal.

    Both ends are found on the time line, as numbers of frames; the frames between are fetched by number.
    """
    some = ranges.filter("start < stop")
    mark = lambda at, kind: some.select(*keys, F.col(at).alias("at"), F.lit(kind).alias("kind"), F.col("request_id").cast("long").alias("request_id"), "start", "stop")
    frames = index.select(*keys, F.col("pts").alias("at"), F.lit(1).alias("kind"), "frame_index")
    # at one instant: the stop, which doesn't reach a frame that begins there; the frame; the start, which does
    line = frames.unionByName(mark("stop", 0).unionByName(mark("start", 2)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("at", "kind", "frame_index").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("frame_index", F.max("frame_index").over(w)).filter("kind != 1")
    ends = seen.groupBy(*keys, "request_id", "start", "stop").agg(F.coalesce(F.max(F.when(F.col("kind") == 2, F.col("frame_index"))), F.lit(0)).alias("first"), F.max(F.when(F.col("kind") == 0, F.col("frame_index"))).alias("last"))
    asked = ends.filter("first <= last").select(*keys, "request_id", "start", "stop", F.explode(F.sequence("first", "last")).alias("frame_index"))
    return index.join(asked, [*keys, "frame_index"])


def next_frame(index: DataFrame, cursors: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """cursors: keys, request_id, cursor. The first frame at or after the cursor; none past the last."""
    met = _first_from(index, cursors, "cursor", keys, strict=False).filter("frame is not null")
    return met.select(*keys, "request_id", "cursor", "frame.frame_index", "frame.pts")


def pts_equal(index: DataFrame, claims: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """claims: keys, frame_index, seconds. Whether that frame's pts_seconds is exactly this number."""
    return index.join(claims, [*keys, "frame_index"]).select(*keys, "frame_index", "seconds", (F.col("pts_seconds") == F.col("seconds")).alias("equal"))
