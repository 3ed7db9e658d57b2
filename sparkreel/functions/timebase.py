"""Time and index arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkreel.schema import NO_PTS


def seconds_of(pts: Column, num: Column | int = 1, den: Column | int = 1_000_000) -> Column:
    """Ticks in seconds: multiplied first, as a double."""
    return pts.cast("double") * _c(num) / _c(den)


def closest_pts(seconds: Column, num: Column | int = 1, den: Column | int = 1_000_000) -> Column:
    """The nearest tick; halves go away from zero."""
    return F.round(seconds * _c(den) / _c(num)).cast("long")


def pts_or_dts(pts: Column, dts: Column) -> Column:
    return F.coalesce(F.when(pts != NO_PTS, pts), dts)


def wrapped_index(index: Column, n: Column) -> Column:
    """A negative index counts from the end, once."""
    return F.when(index < 0, index + n).otherwise(index)


def slice_bounds(start: int | None, stop: int | None, n: Column) -> tuple[Column, Column]:
    """First index and end of a slice of n frames, with step > 0: negative ends wrap, then both are clamped."""

    def clamp(x: int | None, missing: Column) -> Column:
        if x is None:
            return missing
        return F.least(F.greatest(F.lit(x).cast("long") + (n if x < 0 else 0), F.lit(0).cast("long")), n)

    return clamp(start, F.lit(0).cast("long")), clamp(stop, n.cast("long"))


def range_size(start: Column, stop: Column, step: Column) -> Column:
    return F.ceil((stop - start).cast("double") / step).cast("long")


def clip_span(frames: int, step: int) -> int:
    """Indices from a clip's first frame to its last."""
    return step * (frames - 1) + 1


def sample_offset(seconds: Column, rate: Column | int) -> Column:
    """Samples in a span of time; halves go to even."""
    return F.bround(seconds * _c(rate)).cast("long")


def linspace_int(start: Column, stop: Column, count: int) -> Column:
    """count integers from start to stop, both included, cut to whole numbers; one is start."""
    steps = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: (start.cast("double") + i * ((stop - start).cast("double") / max(1, count - 1))).cast("long"))
    return steps


def arange(start: Column, stop: Column, step: float) -> Column:
    """start, start + step, ... below stop."""
    most = F.greatest(F.ceil((stop - start) / step).cast("int"), F.lit(0))
    return F.filter(F.transform(F.sequence(F.lit(0), most), lambda i: start + i * F.lit(float(step))), lambda x: x < stop)


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) that depends on seed and keys alone, not on how rows are dealt out: ten hexadecimal digits of an MD5, which any SQL engine has."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary")), 1, 10)
    return F.conv(digits, 16, 10).cast("double") / float(1 << 40)


def _c(x: Column | int) -> Column:
    return x if isinstance(x, Column) else F.lit(x)
