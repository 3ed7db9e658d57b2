"""PCM WAV files: parsing, building, and a Python data source that reads and writes them.

    sources.register(spark)
    spark.read.format("wav").option("frame_samples", 1024).load("/dir")     # schema AUDIO_FRAMES
    frames.write.format("wav").mode("append").save("/dir")                  # a file for each (source, stream)
"""

from __future__ import annotations

import io
import os
import struct
import uuid
import wave
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from sparkreel.operators.payload import to_float
from sparkreel.schema import AUDIO_FRAMES
from sparkreel.sources import backends, files
from sparkreel.sources.ranges import Ranged, cut

#: Tags of the WAVE format.
PCM, IEEE_FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
MOST_CHANNELS = 8
MOST_BYTES = 320 << 20
FRAMES_PER_TASK = 4096


def header(file) -> dict:
    """Rate, channels, sample format and place of the samples of a WAV file open for reading, none of which is read."""
    if (start := read_exactly(file, 12))[:4] != b"RIFF" or start[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    fmt, at = None, 12
    while len(head := read_exactly(file, 8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        at += 8
        if name == b"fmt ":
            body = read_exactly(file, size)
            fmt = struct.unpack_from("<HHIIHH", body)
            tag = struct.unpack_from("<H", body, 24)[0] if fmt[0] == EXTENSIBLE and len(body) >= 26 else fmt[0]
        elif name == b"data":
            break
        at += size + size % 2
        file.seek(at)
    if fmt is None or len(head) < 8:
        raise ValueError("a WAV file needs a format and data")
    _, channels, rate, _, align, bits = fmt
    if not 1 <= channels <= MOST_CHANNELS:
        raise ValueError(f"1 to {MOST_CHANNELS} channels are supported, not {channels}")
    n = min(size, max(0, file.seek(0, io.SEEK_END) - at)) // align
    return {
        "media_type": "audio", "codec": f"pcm_{'f' if tag == IEEE_FLOAT else 's' if bits > 8 else 'u'}{bits}", "sample_rate": rate, "num_channels": channels,
        "num_samples": n, "duration_seconds": n / rate, "bit_rate": float(rate * align * 8), "offset": at, "align": align, "bits": bits, "float": tag == IEEE_FLOAT,
    }


def samples_of(raw: bytes, head: dict) -> np.ndarray:
    """Bytes of whole samples as channels x samples, float32."""
    bits = head["bits"]
    if head["float"]:
        x = np.frombuffer(raw, {32: "<f4", 64: "<f8"}[bits]).astype(np.float32)
    elif bits == 24:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = to_float(wide.view("<i4").ravel())
    else:
        x = to_float(np.frombuffer(raw, {8: np.uint8, 16: "<i2", 32: "<i4"}[bits]))
    return x.reshape(-1, head["num_channels"]).T


def parse(data: bytes) -> dict:
    """What header() tells of a WAV file, and its samples (channels x samples, float32)."""
    file = io.BytesIO(data)
    head = header(file)
    file.seek(head["offset"])
    return head | {"samples": samples_of(file.read(head["num_samples"] * head["align"]), head)}


def metadata_of(source) -> dict:
    """Header-only metadata of a path, bytes or object with read and seek."""
    if isinstance(source, (str, os.PathLike)):
        with open(source, "rb") as f:
            return header(f)
    return header(source if hasattr(source, "seek") else io.BytesIO(open_any(source)))


def pcm(samples: np.ndarray, bits: int) -> bytes:
    """Samples (channels x samples, in [-1, 1]) as a file holds them."""
    top = 2 ** (bits - 1)
    whole = np.clip(np.rint(samples.T.astype(np.float64) * top), -top, top - 1).astype(np.int64)
    if bits == 8:
        return (whole + 128).astype(np.uint8).tobytes()
    if bits == 24:
        return np.ascontiguousarray(whole).astype("<i4", order="C").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return whole.astype({16: "<i2", 32: "<i4"}[bits]).tobytes()


def build(samples: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A WAV file of samples (channels x samples, or one channel) in [-1, 1]."""
    samples = np.atleast_2d(np.asarray(samples))
    if samples.ndim != 2:
        raise ValueError(f"samples are one channel or channels x samples, not {samples.ndim}-dimensional")
    if samples.dtype != np.float32:
        raise ValueError(f"samples must be float32, not {samples.dtype}")
    if rate <= 0:
        raise ValueError(f"a sample rate of {rate} is none")
    if not 1 <= samples.shape[0] <= MOST_CHANNELS:
        raise ValueError(f"{samples.shape[0]} channels are not 1 to {MOST_CHANNELS}")
    body = pcm(samples, bits)
    if len(body) > MOST_BYTES:
        raise ValueError(f"the file would pass {MOST_BYTES} bytes")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(samples.shape[0])
        f.setsampwidth(bits // 8)
        f.setframerate(rate)
        f.writeframes(body)
    return out.getvalue()


def read_exactly(file, size: int) -> bytes:
    """size bytes of a file-like object that may hand out less at a time; fewer only at its end."""
    parts, left = [], size
    while left > 0:
        part = file.read(left)
        if len(part) > left:
            raise ValueError(f"the file gave {len(part)} bytes where {left} were asked for")
        if not part:
            break
        parts.append(part)
        left -= len(part)
    return b"".join(parts)


def open_any(source) -> bytes:
    """Bytes of a path, bytes, array of uint8 or object with read and seek."""
    if isinstance(source, (str, os.PathLike)):
        with open(source, "rb") as f:
            return f.read()
    if isinstance(source, (bytes, bytearray, memoryview)):
        return bytes(source)
    if isinstance(source, np.ndarray):
        if source.dtype != np.uint8 or source.ndim != 1 or not source.flags["C_CONTIGUOUS"]:
            raise ValueError("an array of encoded bytes must be one-dimensional, contiguous and uint8")
        return source.tobytes()
    if isinstance(source, io.TextIOBase):
        raise TypeError("the file is open in text mode; open it in binary mode ('rb')")
    if hasattr(source, "read") and hasattr(source, "seek"):
        size = source.seek(0, io.SEEK_END)
        source.seek(0)
        return read_exactly(source, size)
    raise TypeError(f"{type(source).__name__} is no source; a path, bytes, a uint8 array or an object with read and seek is")


class _Part(InputPartition):
    def __init__(self, path: str, first: int, end: int):
        self.path, self.first, self.end = path, first, end


class WavReader(Ranged, DataSourceReader):
    """A task reads the header and the samples of its own frames, by range."""

    def __init__(self, options: dict):
        super().__init__(options)
        self.path, self.frame, self.task = options["path"], int(options.get("frame_samples", 1024)), int(options.get("frames_per_task", FRAMES_PER_TASK))

    def partitions(self):
        parts = []
        for p in files.matching(self.path, ".wav"):
            if self.wanted(os.path.basename(p)):
                with files.opening(p) as f:
                    n = header(f)["num_samples"]
                frames = self.units(-(-n // self.frame), "pts", self.frame)
                parts += [_Part(p, a * self.frame, min(n, b * self.frame)) for a, b in cut(frames, self.task)]
        return parts

    def read(self, partition):
        with files.opening(partition.path) as f:
            head = header(f)
            f.seek(head["offset"] + partition.first * head["align"])
            for at in range(partition.first, partition.end, self.frame):
                n = min(self.frame, partition.end - at)
                x = samples_of(read_exactly(f, n * head["align"]), head)
                yield os.path.basename(partition.path), 0, at, n, head["sample_rate"], [c.tolist() for c in x]


class _Written(WriterCommitMessage):
    """parts: (file of this attempt, the path it is for)."""

    def __init__(self, parts: list[tuple[str, str]]):
        self.parts = parts


def part_path(path: str) -> str:
    """A name that no other attempt of any task writes."""
    return f"{path}.{uuid.uuid4().hex}.part"


class FileWriter(DataSourceWriter):
    """Whole files by name. Tasks write files of their own attempt, which commit moves to their names; a stream that two tasks hold parts of is refused."""

    def commit(self, messages):
        parts = [p for m in messages if m for p in m.parts]
        wanted = Counter(path for _, path in parts)
        split = sorted(path for path, n in wanted.items() if n > 1)
        if split:
            self.abort(messages)
            raise ValueError(f"tasks hold parts of one stream each, of {split[0]} among others: repartition by source and stream_index before writing")
        for own, path in parts:
            os.replace(own, path)

    def abort(self, messages):
        for own, _ in (p for m in messages if m for p in m.parts):
            if os.path.exists(own):
                os.remove(own)


class WavSource(DataSource):
    @classmethod
    def name(cls):
        return "wav"

    def schema(self):
        return AUDIO_FRAMES

    def reader(self, schema):
        return WavReader(self.options)

    def writer(self, schema, overwrite):
        from sparkreel.sources.wav_sink import WavWriter

        return WavWriter(self.options)


backends.register("wav", parse)
