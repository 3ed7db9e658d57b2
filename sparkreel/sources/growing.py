"""Files that others are still writing, as a stream: offsets are frames by file, so each frame is read once, restarts included.

    spark.dataSource.register(growing.GrowingSource)
    spark.readStream.format("growing").option("kind", "wav").option("frame_samples", 1024).load("/dir")

kind: "wav" (schema AUDIO_FRAMES) or "rawframes" (schema FRAMES, with its options). A batch takes the whole frames that files
have gained, by range, in tasks of so many frames at most. A WAV file's last frame may be short; it is read once the header's
size agrees with the file's, which says that its writer has closed it. Offsets stand in Spark's checkpoint: a batch that
failed is read again from the same ranges, which don't change, since files only grow.

Defined results: files that are new, empty or too short for a header wait; a file that shrinks fails the query; a file that vanishes
after its frames were read is of no concern.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sparkreel.schema import AUDIO_FRAMES, FRAMES
from sparkreel.sources import files
from sparkreel.sources.ranges import cut
from sparkreel.sources.raw import RawReader
from sparkreel.sources.wav import header, read_exactly, samples_of

FRAMES_PER_TASK = 4096


class _Range(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class GrowingReader(DataSourceStreamReader):
    """Offsets: frames of each file read so far."""

    def __init__(self, options: dict):
        self.options, self.kind, self.path = dict(options), options.get("kind", "wav"), options["path"]
        if self.kind not in ("wav", "rawframes"):
            raise ValueError(f"only wav and rawframes files can be read while they grow, not {self.kind}")
        self.frame = int(options.get("frame_samples", 1024))
        self.raw = RawReader(options) if self.kind == "rawframes" else None
        self.last: dict[str, int] = {}

    def initialOffset(self):  # noqa: N802
        return {}

    def held(self, path: str) -> int:
        """Whole frames that a file holds, with the short one at the end of a closed file."""
        with files.opening(path) as f:
            length = files.length_of(f)
            if self.raw:
                return length // self.raw.size
            f.seek(0)
            try:
                head = header(f)
            except (ValueError, TypeError):
                return 0
            there = max(0, length - head["offset"]) // head["align"]
            f.seek(head["offset"] - 4)
            told = int.from_bytes(f.read(4), "little")
            closed = told > 0 and told + told % 2 in (length - head["offset"], length - head["offset"] + told % 2)
            return -(-there // self.frame) if closed else there // self.frame

    def latestOffset(self):  # noqa: N802
        out = dict(self.last)
        for p in files.matching(self.path, ".wav" if self.kind == "wav" else ""):
            n = self.held(p)
            if n < self.last.get(p, 0):
                raise ValueError(f"{p} held {self.last[p]} frames and now holds {n}")
            if n:
                out[p] = n
        return out

    def partitions(self, start, end):
        self.last = dict(end)
        return [_Range(p, a, b) for p, n in end.items() for a, b in cut(range(start.get(p, 0), n), FRAMES_PER_TASK)]

    def commit(self, end):
        """Nothing is kept that a later batch could not read again."""

    def read(self, partition):
        name = os.path.basename(partition.path)
        with files.opening(partition.path) as f:
            if self.raw:
                shape = (self.raw.height, self.raw.width, 3 if self.raw.pixel == "rgb24" else 1)
                f.seek(partition.first * self.raw.size)
                for i in range(partition.first, partition.end):
                    yield name, 0, i, i / self.raw.fps, 1 / self.raw.fps, shape, read_exactly(f, self.raw.size)
                return
            head = header(f)
            f.seek(head["offset"] + partition.first * self.frame * head["align"])
            for i in range(partition.first, partition.end):
                data = read_exactly(f, self.frame * head["align"])
                x = samples_of(data[: len(data) // head["align"] * head["align"]], head)
                yield name, 0, i * self.frame, x.shape[1], head["sample_rate"], [c.tolist() for c in x]


class GrowingSource(DataSource):
    @classmethod
    def name(cls):
        return "growing"

    def schema(self):
        return AUDIO_FRAMES if self.options.get("kind", "wav") == "wav" else FRAMES

    def streamReader(self, schema):  # noqa: N802
        return GrowingReader(self.options)
