"""What is asked for of a file, as ranges of bytes: readers turn bounds on source, stream, frame and time into the parts they read.

    ranges.read(spark, "wav", "/dir", pts=(0, 8000))

Spark can push a query's filters into a Python reader, but keeps what it pushed for later queries on the same frame, which
then lack rows; so bounds go to readers as options here, and the same bounds are a filter on what comes back.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that bounds may be on.
BOUNDED = ("stream_index", "frame_index", "pts", "pts_seconds")
INF = math.inf


class Ranged:
    """For a DataSourceReader: the bounds among its options."""

    def __init__(self, options: dict):
        told = json.loads(options.get("bounds", "{}"))
        self.sources = told.get("source")
        self.bounds = {c: (-INF if told[c][0] is None else told[c][0], INF if told[c][1] is None else told[c][1]) for c in BOUNDED if c in told}

    def wanted(self, source: str, stream: int = 0) -> bool:
        """Whether the bounds admit a stream."""
        lo, hi = self.bounds.get("stream_index", (-INF, INF))
        return (self.sources is None or source in self.sources) and lo <= stream < hi

    def units(self, n: int, column: str, size: float, slack: int = 0) -> range:
        """Of n units, size of the column each, those that may hold what is asked for of it; slack: units more at either end."""
        lo, hi = self.bounds.get(column, (-INF, INF))
        first = 0 if lo == -INF else n if lo == INF else max(0, math.floor(lo / size) - slack)
        return range(min(first, n), n if hi == INF else 0 if hi == -INF else max(0, min(n, math.ceil(hi / size) + slack)))


def cut(units: range, task: int) -> list[tuple[int, int]]:
    """Units dealt out to tasks: (first, end)."""
    return [(a, min(units.stop, a + task)) for a in range(units.start, units.stop, task)]


def read(spark: SparkSession, format: str, path: str, source: list[str] | None = None, options: dict | None = None, **bounds: tuple) -> DataFrame:
    """Rows of 'wav', 'y4m' or 'rawframes' files within bounds, each (from, until), the end left out and None where it is open: nothing else is read.

    bounds: stream_index, frame_index, pts (ticks) or pts_seconds; source: names of files.
    """
    if unknown := set(bounds) - set(BOUNDED):
        raise ValueError(f"bounds are on {', '.join(BOUNDED)}, not {', '.join(sorted(unknown))}")
    told = {c: list(b) for c, b in bounds.items()} | ({} if source is None else {"source": list(source)})
    rows = spark.read.format(format).options(**(options or {}), bounds=json.dumps(told)).load(path)
    for c, (lo, hi) in bounds.items():
        rows = rows if lo is None else rows.filter(F.col(c) >= lo)
        rows = rows if hi is None else rows.filter(F.col(c) < hi)
    return rows if source is None else rows.filter(F.col("source").isin(list(source)))
