"""Payload bytes: colour conversion, scaling, layouts and resampling in Arrow batches with numpy.

Look frames up first and fetch their bytes last: rows here are large, so nothing in this module shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkreel.operators import layouts
from sparkreel.workers import mapped

#: How red, green and blue follow from luma and chroma: kr, kb of each standard.
COLOUR = {"bt601": (0.299, 0.114), "bt709": (0.2126, 0.0722), "bt2020": (0.2627, 0.0593)}


#: Pixel formats, by how many pixels share chroma (down, across), bits of a sample, and how planes are laid down.
FORMATS = {
    "yuv420p": (2, 2, 8, "planar"), "yuv422p": (1, 2, 8, "planar"), "yuv444p": (1, 1, 8, "planar"), "nv12": (2, 2, 8, "pairs"), "nv21": (2, 2, 8, "swapped"), "yuyv422": (1, 2, 8, "packed"),
    "yuv420p10le": (2, 2, 10, "planar"), "yuv422p10le": (1, 2, 10, "planar"), "yuv444p10le": (1, 1, 10, "planar"), "p010le": (2, 2, 10, "high pairs"),
}


def chroma_size(h: int, w: int, format: str) -> tuple[int, int]:
    if format not in FORMATS:
        raise ValueError(f"pixels are {', '.join(FORMATS)}, not {format}")
    down, across, _, _ = FORMATS[format]
    return -(-h // down), -(-w // across)


def picture_bytes(h: int, w: int, format: str) -> int:
    ch, cw = chroma_size(h, w, format)
    _, _, bits, laid = FORMATS[format]
    return (h * cw * 4 if laid == "packed" else h * w + 2 * ch * cw) * (2 if bits > 8 else 1)


def unpack(data: bytes, h: int, w: int, format: str = "yuv420p") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Luma and the two chroma planes, each of its own size, as they are stored."""
    ch, cw = chroma_size(h, w, format)
    _, _, bits, laid = FORMATS[format]
    if len(data) != picture_bytes(h, w, format):
        raise ValueError(f"expected {picture_bytes(h, w, format)} bytes for {w}x{h} {format}, got {len(data)}")
    flat = np.frombuffer(data, np.uint8 if bits == 8 else "<u2")
    if laid == "packed":
        both = flat.reshape(h, cw, 4)
        return both[:, :, (0, 2)].reshape(h, -1)[:, :w], both[:, :, 1], both[:, :, 3]
    y, rest = flat[: h * w].reshape(h, w), flat[h * w :]
    if laid == "planar":
        return y, rest[: ch * cw].reshape(ch, cw), rest[ch * cw :].reshape(ch, cw)
    pairs = rest.reshape(ch, cw, 2)
    if laid == "high pairs":  # ten bits stand at the top of sixteen
        y, pairs = y >> 6, pairs >> 6
    return (y, pairs[:, :, 1], pairs[:, :, 0]) if laid == "swapped" else (y, pairs[:, :, 0], pairs[:, :, 1])


def pack(y: np.ndarray, u: np.ndarray, v: np.ndarray, format: str = "yuv420p") -> bytes:
    """The other way."""
    h, w = y.shape
    ch, cw = chroma_size(h, w, format)
    _, _, bits, laid = FORMATS[format]
    kind = np.uint8 if bits == 8 else "<u2"
    y, u, v = (x.astype(kind) for x in (y, u, v))
    if laid == "packed":
        wide = np.pad(y, ((0, 0), (0, 2 * cw - w)), "edge").reshape(h, cw, 2)
        return np.stack([wide[:, :, 0], u, wide[:, :, 1], v], -1).tobytes()
    if laid == "planar":
        return y.tobytes() + u.tobytes() + v.tobytes()
    pairs = np.stack([v, u] if laid == "swapped" else [u, v], -1)
    if laid == "high pairs":
        y, pairs = y << 6, pairs << 6
    return y.tobytes() + pairs.tobytes()


def yuv_to_rgb(data: bytes, h: int, w: int, standard: str = "bt601", full_range: bool = False, format: str = "yuv420p") -> np.ndarray:
    """Bytes of a picture as rows x columns x 3, uint8. Chroma is repeated for the pixels that share it."""
    kr, kb = COLOUR[standard]
    y, u, v = unpack(data, h, w, format)
    down, across, bits, _ = FORMATS[format]
    scale = 1 << (bits - 8)
    y = y.astype(np.float32) / scale
    u, v = (c.repeat(down, 0).repeat(across, 1)[:h, :w].astype(np.float32) / scale - 128 for c in (u, v))
    if not full_range:
        y, u, v = (y - 16) * (255 / 219), u * (255 / 224), v * (255 / 224)
    kg = 1 - kr - kb
    rgb = np.stack([y + 2 * (1 - kr) * v, y - 2 * kb * (1 - kb) / kg * u - 2 * kr * (1 - kr) / kg * v, y + 2 * (1 - kb) * u], -1)
    return np.clip(np.rint(rgb), 0, 255).astype(np.uint8)


def rgb_to_yuv(rgb: np.ndarray, standard: str = "bt601", full_range: bool = False, format: str = "yuv420p") -> bytes:
    """The other way, chroma averaged over the pixels that share it."""
    kr, kb = COLOUR[standard]
    x = rgb.astype(np.float32)
    y = kr * x[..., 0] + (1 - kr - kb) * x[..., 1] + kb * x[..., 2]
    u, v = (x[..., 2] - y) / (2 * (1 - kb)), (x[..., 0] - y) / (2 * (1 - kr))
    (h, w), (ch, cw) = y.shape, chroma_size(*y.shape, format)
    down, across, bits, _ = FORMATS[format]

    def shared(c: np.ndarray) -> np.ndarray:
        return np.pad(c, ((0, ch * down - h), (0, cw * across - w)), "edge").reshape(ch, down, cw, across).mean((1, 3))

    u, v = shared(u), shared(v)
    if not full_range:
        y, u, v = y * (219 / 255) + 16, u * (224 / 255), v * (224 / 255)
    scale = 1 << (bits - 8)
    return pack(*(np.clip(np.rint(p * scale), 0, 256 * scale - 1) for p in (y, u + 128, v + 128)), format)


def yuv420_to_rgb(data: bytes, h: int, w: int, standard: str = "bt601", full_range: bool = False) -> np.ndarray:
    """Planar 4:2:0 bytes as rows x columns x 3, uint8."""
    return yuv_to_rgb(data, h, w, standard, full_range)


def rgb_to_yuv420(rgb: np.ndarray, standard: str = "bt601", full_range: bool = False) -> bytes:
    return rgb_to_yuv(rgb, standard, full_range)


@lru_cache(maxsize=256)
def bank(n: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each of m samples made of n: which ones it is made of, and their weights. Linear between two; on reduction the filter is as much wider, so that every sample counts."""
    wide = max(1.0, n / m)
    center = (np.arange(m) + 0.5) * n / m - 0.5
    taps = int(np.ceil(wide)) * 2
    at = np.floor(center).astype(int)[:, None] + np.arange(1 - taps // 2, taps // 2 + 1)
    weight = np.maximum(0, 1 - np.abs(at - center[:, None]) / wide)
    return np.clip(at, 0, n - 1), (weight / weight.sum(1, keepdims=True)).astype(np.float32)


def resize_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Rows x columns x channels at another size, pixel centres aligned, by a bank of filters for rows and one for columns; the same size is handed back as it is."""
    h, w = image.shape[:2]
    if (h, w) == (height, width):
        return image
    (rows, row_weights), (columns, column_weights) = bank(h, height), bank(w, width)
    x, tall = image.astype(np.float32), np.zeros((height, *image.shape[1:]), np.float32)
    for k in range(rows.shape[1]):
        tall += x[rows[:, k]] * row_weights[:, k, None, None]
    out = np.zeros((height, width, image.shape[2]), np.float32)
    for k in range(columns.shape[1]):
        out += tall[:, columns[:, k]] * column_weights[None, :, k, None]
    return np.clip(np.rint(out), 0, 255).astype(image.dtype) if image.dtype == np.uint8 else out.astype(image.dtype)


def to_float(samples: np.ndarray) -> np.ndarray:
    """Samples of any PCM type as float32 in [-1, 1]."""
    if samples.dtype == np.uint8:
        return (samples.astype(np.float32) - 128) / 128
    if samples.dtype.kind == "i":
        return (samples.astype(np.float64) / float(2 ** (8 * samples.dtype.itemsize - 1))).astype(np.float32)
    return samples.astype(np.float32)


def reach_of(rate: int, wanted: int, taps: int = 32) -> int:
    """Samples on either side that a resampled one is made of."""
    return int(np.ceil(taps / min(1.0, wanted / rate)))


def resampled_size(n: int, rate: int, wanted: int) -> int:
    return -(-n * wanted // rate)


def resample_span(part: np.ndarray, first: int, rate: int, wanted: int, begin: int, end: int, taps: int = 32) -> np.ndarray:
    """Samples begin to end at the wanted rate, by a windowed sinc. part: channels x samples of the stream from first on; what it doesn't hold is silent."""
    ratio, cut, reach = rate / wanted, min(1.0, wanted / rate), reach_of(rate, wanted, taps)
    out = np.zeros((part.shape[0], end - begin), np.float64)
    for a in range(begin, end, 1 << 14):
        t = np.arange(a, min(end, a + (1 << 14))) * ratio
        k = np.floor(t).astype(int)[:, None] + np.arange(-reach + 1, reach + 1)
        x = t[:, None] - k
        weight = cut * np.sinc(cut * x) * np.where(np.abs(x) <= reach, 0.5 + 0.5 * np.cos(np.pi * x / reach), 0)
        at = k - first
        there = (at >= 0) & (at < part.shape[1])
        held = part[:, np.where(there, at, 0)] * there
        out[:, a - begin : a - begin + len(t)] = np.einsum("cij,ij->ci", held, weight / weight.sum(1, keepdims=True))
    return out.astype(np.float32)


def resample(channels: np.ndarray, rate: int, wanted: int, taps: int = 32) -> np.ndarray:
    """channels x samples of a whole stream at another rate."""
    if rate == wanted or channels.shape[1] == 0:
        return channels
    return resample_span(channels.astype(np.float64), 0, rate, wanted, 0, resampled_size(channels.shape[1], rate, wanted), taps)


def remix(channels: np.ndarray, wanted: int) -> np.ndarray:
    """As many channels as wanted: one is the mean, one is copied to many, else layouts.matrix() mixes the layouts that so many channels have."""
    have = channels.shape[0]
    if not 1 <= wanted <= 8:
        raise ValueError(f"num_channels must be between 1 and 8, got {wanted}")
    if have == wanted:
        return channels
    if wanted == 1:
        return channels.mean(0, keepdims=True).astype(channels.dtype)
    if have == 1:
        return np.repeat(channels, wanted, 0)
    return mix(channels, have, wanted)


def mix(channels: np.ndarray, source: str | int, target: str | int) -> np.ndarray:
    """Channels of one layout in another."""
    return (np.array(layouts.matrix(source, target)) @ channels).astype(channels.dtype)


def map_frames(frames: DataFrame, change: Callable[[np.ndarray], np.ndarray], data: str = "data", shape: str = "shape") -> DataFrame:
    """frames with change applied to every image (rows x columns x channels, uint8), batch by batch."""
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            images = [change(np.frombuffer(d, np.uint8).reshape(s["h"], s["w"], s["c"])) if d is not None else None for d, s in zip(batch.column(names.index(data)).to_pylist(), batch.column(names.index(shape)).to_pylist(), strict=True)]
            new = {data: pa.array([None if x is None else x.tobytes() for x in images], pa.binary()), shape: pa.array([None if x is None else dict(zip("hwc", x.shape, strict=True)) for x in images], batch.column(names.index(shape)).type)}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names)

    return mapped(frames, run, frames.schema)


def resized(frames: DataFrame, height: int, width: int) -> DataFrame:
    return map_frames(frames, lambda x: resize_bilinear(x, height, width))


def converted(frames: DataFrame, standard: str = "bt601", full_range: bool = False, format: str = "yuv420p") -> DataFrame:
    """Rows of a pixel format's bytes (shape: h, w of the picture) as RGB."""
    chroma_size(1, 1, format)
    names = frames.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column(names.index("data")).to_pylist(), batch.column(names.index("shape")).to_pylist(), strict=True)
            images = [yuv_to_rgb(d, s["h"], s["w"], standard, full_range, format) for d, s in rows]
            new = {"data": pa.array([x.tobytes() for x in images], pa.binary()), "shape": pa.array([dict(zip("hwc", x.shape, strict=True)) for x in images], batch.column(names.index("shape")).type)}
            yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names)

    return mapped(frames, run, frames.schema)


def channels_first(image: np.ndarray) -> np.ndarray:
    """Rows x columns x channels as channels x rows x columns."""
    return np.ascontiguousarray(image.transpose(2, 0, 1))
