"""Array expressions: clip policies, layouts, sample arithmetic, image metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def repeat_last(values: Column, size: int) -> Column:
    """values filled up to size with the last one."""
    short = F.concat(values, F.array_repeat(F.try_element_at(values, F.lit(-1)), F.greatest(size - F.size(values), F.lit(0))))
    return F.when(F.size(values) >= size, values).otherwise(short)


def wrap(values: Column, size: int) -> Column:
    """values from the start again, up to size."""
    again = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(values, i % F.greatest(F.size(values), F.lit(1))))
    return F.when(F.size(values) >= size, values).otherwise(again)


def error(values: Column, size: int) -> Column:
    """values, or a failure of the query where they are too few."""
    return F.when(F.size(values) >= size, values).otherwise(F.raise_error(F.lit("a clip reaches past the end of its stream, which the 'error' policy forbids; the default sampling_range_end leaves room")).cast("array<double>"))


POLICIES: dict[str, Callable[[Column, int], Column]] = {"repeat_last": repeat_last, "wrap": wrap, "error": error}


def rounded(x: Column, places: int) -> Column:
    """x to so many places as SQL engines round doubles: scaled, halves away from zero, the sign kept by a zero. F.round() goes by the shortest decimal and drops it."""
    return F.signum(x) * F.round(F.abs(x) * 10.0**places) / 10.0**places


def permute_hwc(values: Column, h: int, w: int, c: int) -> Column:
    """Values laid out row, column, channel as channel, row, column."""
    return F.transform(F.sequence(F.lit(0), F.lit(h * w * c - 1)), lambda i: F.get(values, (i % (h * w)) * c + F.floor(i / (h * w)).cast("int")))


def trim(samples: Column, begin: Column, end: Column) -> Column:
    """samples from begin to before end."""
    return F.slice(samples, (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))


def mix_down(left: Column, right: Column) -> Column:
    """The mean of two channels, sample by sample."""
    return F.zip_with(left, right, lambda a, b: (a.cast("double") + b.cast("double")) / 2)


def squared_error(a: Column, b: Column) -> Column:
    """The mean squared difference of two arrays."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return total / F.size(a)


def psnr(a: Column, b: Column, peak: float = 255.0) -> Column:
    """Peak signal to noise ratio in decibels; infinite for equal arrays."""
    mse = squared_error(a, b)
    return F.when(mse == 0, F.lit(float("inf"))).otherwise(20 * F.log10(peak / F.sqrt(mse)))


def within(a: Column, b: Column, tolerance: float) -> Column:
    """Per cent of values that differ by tolerance at most."""
    near = F.zip_with(a, b, lambda x, y: (F.abs(x.cast("double") - y.cast("double")) <= tolerance).cast("int"))
    return 100.0 * F.aggregate(near, F.lit(0), lambda s, x: s + x) / F.size(a)
