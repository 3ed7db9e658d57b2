"""Bare audio streams (ADTS, MPEG layers I to III, FLAC): packets from frame headers, files cut into splits anywhere.

A split takes the frames that begin in it. They are chained: a frame's length leads to the next header of the same kind
(FLAC, whose headers tell no length: its number and block size lead to the next one's, checksums right). The chain begins
a little before the split, so that every split sees the frames that its neighbours see, and again where something else stands. ADTS and MPEG frames tell no time: Spark sums the samples of
earlier splits, a row each, and adds them; FLAC frames tell their own.

Defined results: a file without frames gives nothing; tags before, between and behind frames are passed over; a first
MPEG frame that holds only an index (Xing, Info, VBRI) is marked as discarded and lasts no time; a frame that the file's end
cuts off counts if its header is whole and right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkreel.sources import files, sink

SUFFIXES = (".aac", ".adts", ".mp3", ".mp2", ".mp1", ".flac")
SPLIT = 32 << 20
#: Headers of a chain; bytes read at once; bytes before a split in which its chain is begun.
CHAIN, WINDOW, BACK = 4, 1 << 20, 1 << 16
#: Sample rates and bit rates by their codes.
ADTS_RATES = (96000, 88200, 64000, 48000, 44100, 32000, 24000, 22050, 16000, 12000, 11025, 8000, 7350)
MPEG_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
BIT_RATES = {
    (True, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (True, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384), (True, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256), (False, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160), (False, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
FLAC_RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}


def adts(data: bytes, at: int) -> tuple[int, int, int, tuple] | None:
    """Bytes, samples, rate and what all frames of a stream share, of the header at a place."""
    if len(data) < at + 7 or data[at] != 0xFF or data[at + 1] & 0xF6 != 0xF0:
        return None
    code, size = data[at + 2] >> 2 & 15, (data[at + 3] & 3) << 11 | data[at + 4] << 3 | data[at + 5] >> 5
    if code >= len(ADTS_RATES) or size < 7:
        return None
    return size, 1024 * ((data[at + 6] & 3) + 1), ADTS_RATES[code], (data[at + 1] & 0xF8, data[at + 2] & 0xFD, data[at + 3] & 0xC0)


def mpeg(data: bytes, at: int) -> tuple[int, int, int, tuple] | None:
    if len(data) < at + 4 or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, bits, code = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), data[at + 2] >> 4, data[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or code == 3:
        return None
    first = version == 3
    rate, pad = MPEG_RATES[version][code], data[at + 2] >> 1 & 1
    bps = 1000 * BIT_RATES[first, layer][bits - 1]
    samples = {1: 384, 2: 1152, 3: 1152 if first else 576}[layer]
    size = (12 * bps // rate + pad) * 4 if layer == 1 else samples // 8 * bps // rate + pad
    return size, samples, rate, (version, layer, code)


def only_index(data: bytes, at: int) -> bool:
    """Whether an MPEG frame holds an index of the file, not sound."""
    first, mono = data[at + 1] >> 3 & 3 == 3, data[at + 3] >> 6 == 3
    place = at + 4 + ((17 if mono else 32) if first else (9 if mono else 17))
    return data[place : place + 4] in (b"Xing", b"Info") or data[at + 36 : at + 40] == b"VBRI"


def tag_end(file) -> int:
    """Where a tag at the file's beginning ends."""
    at = 0
    while True:
        file.seek(at)
        head = file.read(10)
        if len(head) < 10 or head[:3] != b"ID3":
            return at
        at += 10 + (head[6] << 21 | head[7] << 14 | head[8] << 7 | head[9]) + 10 * bool(head[5] & 0x10)


class Held:
    """A file read in windows, as if all of it were held."""

    def __init__(self, file, length: int):
        self.file, self.length, self.at, self.data = file, length, 0, b""

    def part(self, at: int, size: int) -> tuple[bytes, int]:
        """Bytes that hold the part from a place on, and where in them it begins."""
        if at < self.at or at + size > self.at + len(self.data):
            self.file.seek(at)
            self.at, self.data = at, self.file.read(max(size, WINDOW))
        return self.data, at - self.at


def chained(held: Held, parse, at: int, kind: tuple | None) -> bool:
    """Whether a frame begins at a place: CHAIN headers of a kind follow one another, or fewer up to the file's end."""
    for _ in range(CHAIN):
        if at >= held.length:
            return True
        own = parse(*held.part(at, 16))
        if own is None:
            return held.length - at < 16 and kind is not None
        if kind not in (None, own[3]):
            return False
        kind, at = own[3], at + own[0]
    return True


def next_frame(held: Held, parse, start: int, stop: int, kind: tuple | None) -> int | None:
    at = start
    while at < stop:
        data, p = held.part(at, min(WINDOW, held.length - at))
        found = data.find(b"\xff", p, p + stop - at)
        if found < 0:
            at += len(data) - p
            continue
        place = held.at + found
        if parse(*held.part(place, 16)) and chained(held, parse, place, kind):
            return place
        at = place + 1
    return None


FRAME = "source string, split long, seq long, before long, samples long, rate int, size long, is_discard boolean, told boolean"


def chain_rows(file, path: str, length: int, start: int, end: int, parse) -> Iterator[tuple]:
    held, first = Held(file, length), tag_end(file)
    top = next_frame(held, parse, first, length, None)
    if top is None:
        return
    kind = parse(*held.part(top, 16))[3]
    at, before = next_frame(held, parse, max(start - BACK, top), end, kind), 0
    while at is not None and at < end:
        own = parse(*held.part(at, 256))
        if own is None or own[3] != kind:
            at = next_frame(held, parse, at + 1, end, kind)
            continue
        size, samples, rate, _ = own
        index = parse is mpeg and at == top and only_index(*held.part(at, 256))
        if at >= start:
            yield path, start, at, before, 0 if index else samples, rate, min(size, length - at), index, False
            before += 0 if index else samples
        at += size


def crc8(data: bytes) -> int:
    """Of a FLAC header: polynomial 0x07."""
    crc = 0
    for byte in data:
        crc ^= byte
        for _ in range(8):
            crc = (crc << 1 ^ (0x07 if crc & 0x80 else 0)) & 0xFF
    return crc


def flac_info(file) -> dict | None:
    """What the stream's first metadata block tells, and where frames begin."""
    at = tag_end(file)
    file.seek(at)
    if file.read(4) != b"fLaC":
        return None
    at, out = at + 4, None
    while True:
        file.seek(at)
        head = file.read(4)
        if len(head) < 4:
            return out
        size = int.from_bytes(head[1:], "big")
        if head[0] & 0x7F == 0:
            data = file.read(34)
            if len(data) < 34:
                return None
            out = {"block": int.from_bytes(data[:2], "big"), "rate": int.from_bytes(data[10:13], "big") >> 4, "most": int.from_bytes(data[7:10], "big")}
        at += 4 + size
        if head[0] & 0x80:
            return out and out | {"first": at}


def flac(data: bytes, at: int, info: dict) -> tuple[int, int, int] | None:
    """First sample, samples and rate of the frame whose header is at a place."""
    head = data[at : at + 16]
    if len(head) < 6 or head[0] != 0xFF or head[1] & 0xFE != 0xF8 or head[3] & 1:
        return None
    block, code, channels, bits = head[2] >> 4, head[2] & 15, head[3] >> 4, head[3] >> 1 & 7
    if not block or code == 15 or channels > 10 or bits == 3:
        return None
    lead = 8 - (~head[4] & 0xFF).bit_length()
    if lead == 1 or lead > 7:
        return None
    n, p = (head[4] & (0x7F >> lead), 5) if lead else (head[4], 5)
    for byte in head[5 : 5 + max(lead - 1, 0)]:
        if byte >> 6 != 2:
            return None
        n, p = n << 6 | byte & 0x3F, p + 1
    wide = {6: 1, 7: 2}.get(block, 0)
    samples = int.from_bytes(head[p : p + wide], "big") + 1 if wide else 192 if block == 1 else 576 << (block - 2) if block < 6 else 256 << (block - 8)
    p += wide
    wide = {12: 1, 13: 2, 14: 2}.get(code, 0)
    rate = int.from_bytes(head[p : p + wide], "big") * {12: 1000, 13: 1, 14: 10}[code] if wide else FLAC_RATES.get(code, info["rate"])
    p += wide
    if len(head) <= p or crc8(head[:p]) != head[p] or rate != info["rate"]:
        return None
    return (n if head[1] & 1 else n * info["block"]), samples, rate


def flac_rows(file, path: str, length: int, start: int, end: int) -> Iterator[tuple]:
    info = flac_info(file)
    if info is None or "first" not in info:
        return
    begin = max(start - BACK, info["first"])

    def headers() -> Iterator[tuple]:
        """Of what may be frames, from the begin on, past the split's end as long as they are asked for."""
        for at in range(begin, length, WINDOW):
            file.seek(at)
            data = file.read(WINDOW + 16)
            raw = np.frombuffer(data, np.uint8)
            marks = np.nonzero((raw[:-1] == 0xFF) & (raw[1:] & 0xFE == 0xF8))[0] if len(raw) > 1 else np.zeros(0, int)
            for p in marks[marks < WINDOW].tolist():
                own = flac(data, p, info)
                if own:
                    yield at + p, *own

    rest, ahead, sure = headers(), [], False
    while True:
        if not ahead:
            ahead = [x for x in [next(rest, None)] if x]
        if not ahead or ahead[0][0] >= end:
            return
        own = ahead.pop(0)
        # the header whose number is where this frame ends follows it, if it is among the next few
        i, over = 0, False
        while i < 2 * CHAIN:
            if i == len(ahead):
                more = next(rest, None)
                if more is None:
                    over = True
                    break
                ahead.append(more)
            if ahead[i][1] == own[1] + own[2]:
                break
            i += 1
        follows = i < min(len(ahead), 2 * CHAIN)
        right = follows or sure or own[0] == info["first"]
        if right and own[0] >= start:
            yield path, start, own[0], own[1], own[2], own[3], (ahead[i][0] if follows else length if over else ahead[0][0]) - own[0], False, True
        # what stands between a frame and the one that follows it is data
        ahead, sure = (ahead[i:], True) if follows else (ahead, False)


def split_rows(file, path: str, length: int, start: int, end: int) -> Iterator[tuple]:
    name = path.lower()
    if name.endswith(".flac"):
        return flac_rows(file, path, length, start, end)
    return chain_rows(file, path, length, start, end, adts if name.endswith((".aac", ".adts")) else mpeg)


def packets(spark: SparkSession, path, split: int = SPLIT) -> DataFrame:
    """source, stream_index, media_type, seq (where the frame stands), pts, dts, duration (in samples), is_key, is_discard, tb_num, tb_den and size of every frame."""
    ranges = files.splits(files.listed(spark, path, SUFFIXES), split)
    # one exchange, which counting and joining share
    frames = files.scanned(ranges, split_rows, FRAME, ("length", "start", "end")).repartition("source", "split")
    counts = frames.groupBy("source", "split").agg(F.sum("samples").alias("n"))
    earlier = Window.partitionBy("source").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select("source", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("moved"))
    timed = frames.join(moved, ["source", "split"]).withColumn("pts", F.col("before") + F.when(F.col("told"), 0).otherwise(F.col("moved")))
    return timed.select("source", F.lit(0).alias("stream_index"), F.lit("audio").alias("media_type"), "seq", "pts", F.col("pts").alias("dts"), F.col("samples").alias("duration"), F.lit(True).alias("is_key"), "is_discard", F.lit(1).alias("tb_num"), F.col("rate").alias("tb_den"), "size")


class AdtsFile(sink.OpenFile):
    """A header of seven bytes before each packet of 1,024 samples; the file has one stream, and no times."""

    def __init__(self, file):
        self.file, self.stream = file, None

    def add(self, row) -> None:
        data = bytes(row.data or b"")
        if self.stream not in (None, row.stream_index):
            raise ValueError("a bare stream's file holds one stream")
        if row.tb_num != 1 or row.tb_den not in ADTS_RATES or len(data) > (1 << 13) - 8:
            raise ValueError("a frame has a standard sample rate, as its time base, and 8,184 bytes at most")
        self.stream, size = row.stream_index, len(data) + 7
        head = 0xFFF1 << 40 | 1 << 38 | ADTS_RATES.index(row.tb_den) << 34 | 2 << 30 | size << 13 | 0x7FF << 2
        self.file.write(head.to_bytes(7, "big") + data)


sink.FORMATS["adts"] = (".aac", AdtsFile)
