"""Uncompressed frames in files: a Python data source for packed RGB and planar 4:2:0 pictures.

    spark.read.format("rawframes").options(width=64, height=48, pixel="rgb24", fps=25).load("/dir/*.rgb")
    frames.write.format("rawframes").mode("append").save("/dir")
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkreel.schema import FRAMES
from sparkreel.sources import files
from sparkreel.sources.files import local
from sparkreel.sources.ranges import Ranged, cut
from sparkreel.sources.spool import StreamWriter
from sparkreel.sources.wav import read_exactly

FRAMES_PER_TASK = 64


def frame_bytes(width: int, height: int, pixel: str) -> int:
    if pixel == "rgb24":
        return 3 * width * height
    if pixel == "yuv420p":
        return width * height + 2 * ((width + 1) // 2) * ((height + 1) // 2)
    raise ValueError(f"pixel must be rgb24 or yuv420p, not {pixel}")


class _Span(InputPartition):
    def __init__(self, path: str, first: int, count: int):
        self.path, self.first, self.count = path, first, count


class RawReader(Ranged, DataSourceReader):
    """A task seeks to its own frames and reads them alone."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.path = options["path"]
        self.width, self.height, self.pixel = int(options["width"]), int(options["height"]), options.get("pixel", "rgb24")
        self.fps, self.size = float(options.get("fps", 25)), frame_bytes(int(options["width"]), int(options["height"]), options.get("pixel", "rgb24"))

    def partitions(self):
        spans = []
        for p in files.matching(self.path):
            if self.wanted(os.path.basename(p)):
                with files.opening(p) as f:
                    n = files.length_of(f) // self.size
                own, timed = self.units(n, "frame_index", 1), self.units(n, "pts_seconds", 1 / self.fps, slack=1)
                spans += [_Span(p, a, b - a) for a, b in cut(range(max(own.start, timed.start), min(own.stop, timed.stop)), FRAMES_PER_TASK)]
        return spans

    def read(self, span):
        shape = (self.height, self.width, 3 if self.pixel == "rgb24" else 1)
        with files.opening(span.path) as f:
            f.seek(span.first * self.size)
            for i in range(span.first, span.first + span.count):
                yield os.path.basename(span.path), 0, i, i / self.fps, 1 / self.fps, shape, read_exactly(f, self.size)


class RawWriter(StreamWriter):
    """Each (source, stream) a task is dealt becomes one file, its frames in order."""

    suffix = "raw"

    def __init__(self, options: dict):
        self.path = local(options["path"])

    def frame(self, row) -> tuple[float, bytes]:
        return row.frame_index, bytes(row.data)


class RawFramesSource(DataSource):
    @classmethod
    def name(cls):
        return "rawframes"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return RawReader(self.options)

    def writer(self, schema, overwrite):
        return RawWriter(self.options)
