"""Uncompressed video files: YUV4MPEG2, planar 4:2:0 pictures after a line of text that tells size and rate.

    sources.register(spark)
    spark.read.format("y4m").load("/dir/*.y4m")                          # schema FRAMES, packed RGB
    frames.write.format("y4m").option("fps", 25).mode("append").save("/dir")   # a file for each (source, stream)

Every frame has the same size in bytes, so a task seeks to its own frames and reads them alone.
"""

from __future__ import annotations

import os
from fractions import Fraction

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkreel.operators.payload import rgb_to_yuv420, yuv420_to_rgb
from sparkreel.schema import FRAMES
from sparkreel.sources import backends, files
from sparkreel.sources.files import local
from sparkreel.sources.ranges import Ranged, cut
from sparkreel.sources.spool import StreamWriter
from sparkreel.sources.wav import read_exactly

#: Words of the format.
MAGIC, FRAME = b"YUV4MPEG2", b"FRAME\n"
FRAMES_PER_TASK = 64


def frame_size(width: int, height: int) -> int:
    return width * height + 2 * ((width + 1) // 2) * ((height + 1) // 2)


def header(file) -> dict:
    """Size, rate, number of frames and where they begin, of a file open for reading; no frame is read."""
    line = b""
    while not line.endswith(b"\n"):
        c = file.read(1)
        if not c or len(line) > 1 << 12:
            raise ValueError("not a YUV4MPEG2 file")
        line += c
    words = line.split()
    if not words or words[0] != MAGIC:
        raise ValueError("not a YUV4MPEG2 file")
    tags = {w[:1]: w[1:].decode() for w in words[1:]}
    if not tags.get(b"C", "420").startswith("420") or "p1" in tags.get(b"C", ""):
        raise ValueError(f"only 8-bit 4:2:0 pictures can be read, not {tags[b'C']}")
    width, height, rate = int(tags[b"W"]), int(tags[b"H"]), Fraction(tags.get(b"F", "25:1").replace(":", "/"))
    size = len(FRAME) + frame_size(width, height)
    n = (file.seek(0, os.SEEK_END) - len(line)) // size
    return {"media_type": "video", "codec": "rawvideo", "width": width, "height": height, "fps": rate, "num_frames": n, "duration_seconds": float(n / rate), "offset": len(line), "size": size}


def build(frames: np.ndarray, rate: Fraction | float | int, standard: str = "bt601") -> bytes:
    """A file of frames (N x 3 x H x W, uint8)."""
    frames = np.asarray(frames)
    if frames.dtype != np.uint8:
        raise ValueError(f"frames must be uint8, not {frames.dtype}")
    if frames.ndim != 4 or frames.shape[1] != 3:
        raise ValueError(f"frames are N x 3 x height x width, not {frames.shape}")
    if rate <= 0:
        raise ValueError(f"a frame rate of {rate} is none")
    rate = Fraction(rate).limit_denominator(1001)
    first = MAGIC + f" W{frames.shape[3]} H{frames.shape[2]} F{rate.numerator}:{rate.denominator} Ip A1:1 C420jpeg\n".encode()
    return first + b"".join(FRAME + rgb_to_yuv420(x.transpose(1, 2, 0), standard) for x in frames)


class _Span(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class Y4mReader(Ranged, DataSourceReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.path, self.standard = options["path"], options.get("standard", "bt601")

    def partitions(self):
        spans = []
        for p in files.matching(self.path, ".y4m"):
            if not self.wanted(os.path.basename(p)):
                continue
            with files.opening(p) as f:
                head = header(f)
            n = head["num_frames"]
            own, timed = self.units(n, "frame_index", 1), self.units(n, "pts_seconds", float(1 / head["fps"]), slack=1)
            spans += [_Span(p, a, b) for a, b in cut(range(max(own.start, timed.start), min(own.stop, timed.stop)), FRAMES_PER_TASK)]
        return spans

    def read(self, span):
        with files.opening(span.path) as f:
            head = header(f)
            w, h, step = head["width"], head["height"], 1 / head["fps"]
            f.seek(head["offset"] + span.first * head["size"])
            for i in range(span.first, span.end):
                picture = yuv420_to_rgb(read_exactly(f, head["size"])[len(FRAME) :], h, w, self.standard)
                yield os.path.basename(span.path), 0, i, float(i * step), float(step), (h, w, 3), picture.tobytes()


class Y4mWriter(StreamWriter):
    """Each (source, stream) a task is dealt becomes one file, its frames in order."""

    suffix = "y4m"

    def __init__(self, options: dict):
        self.path, self.rate, self.standard = local(options["path"]), Fraction(options.get("fps", "25")), options.get("standard", "bt601")

    def image(self, row) -> np.ndarray:
        return np.frombuffer(bytes(row.data), np.uint8).reshape(row.shape["h"], row.shape["w"], row.shape["c"])

    def head(self, row) -> bytes:
        return build(self.image(row).transpose(2, 0, 1)[None][:0], self.rate, self.standard)

    def frame(self, row) -> tuple[float, bytes]:
        return row.frame_index, FRAME + rgb_to_yuv420(self.image(row), self.standard)


class Y4mSource(DataSource):
    @classmethod
    def name(cls):
        return "y4m"

    def schema(self):
        return FRAMES

    def reader(self, schema):
        return Y4mReader(self.options)

    def writer(self, schema, overwrite):
        return Y4mWriter(self.options)


def parse(data: bytes) -> dict:
    import io

    return header(io.BytesIO(data))


backends.register("y4m", parse)
