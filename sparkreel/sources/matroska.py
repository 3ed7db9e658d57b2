"""Matroska and WebM: packets from block headers, files cut into splits anywhere.

A split begins with the first cluster that starts in it. It is found by its identifier and taken for one only if what
follows is a cluster's first element and what stands at its end is another element of that level, or the segment's end.
Every split reads the file's head for its tracks and clock, then the headers of its blocks; frames are passed over. Where
the file has cues, a range of time reads only the splits between the cues around it.

Defined results: a file that is no Matroska gives nothing; what follows a damaged element is found again at the next
cluster of another split; clusters of unknown size end where the next element of their level begins; a block of several
laced frames is as many packets, timed by the track's default duration; a duration that nothing tells is the track's
default, else zero.
"""

from __future__ import annotations

import math
import struct
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkreel.sources import files, sink

SUFFIXES = (".mkv", ".webm", ".mka", ".mk3d")
SPLIT = 64 << 20
#: Identifiers of elements, and kinds of tracks.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0x1254C367, 0x1043A770, 0x1941A469
VOID, CRC, TIMESTAMP, POSITION, PREVIOUS, SIMPLE_BLOCK, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xEC, 0xBF, 0xE7, 0xA7, 0xAB, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
SCALE, DURATION, ENTRY, NUMBER, KIND, CODEC, DEFAULT, VIDEO, WIDTH, HEIGHT, AUDIO, RATE, CHANNELS = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86, 0x23E383, 0xE0, 0xB0, 0xBA, 0xE1, 0xB5, 0x9F
SEEK, SEEK_ID, SEEK_POSITION, CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0x4DBB, 0x53AB, 0x53AC, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = (SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS, VOID, CRC)
FIRST_IN_CLUSTER = (TIMESTAMP, POSITION, PREVIOUS, VOID, CRC)
KINDS = {1: "video", 2: "audio"}
WINDOW = 1 << 20


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int | None, int]:
    """A number of variable length and where it ends; None where its bits are all ones (unknown). keep: with the bit that tells the length."""
    if at >= len(data) or data[at] == 0:
        raise ValueError("no number of variable length")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError("a number of variable length is cut off")
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (None if value == (1 << 7 * n) - 1 else value), at + n


def element(file, at: int) -> tuple[int, int, int | None]:
    """Identifier, first byte of the body and end of the element at a place; the end is None where the size is unknown."""
    file.seek(at)
    data = file.read(12)
    kind, p = vint(data, 0, True)
    size, p = vint(data, p)
    return kind, at + p, None if size is None else at + p + size


def children(file, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        try:
            kind, body, stop = element(file, at)
        except ValueError:
            return
        stop = end if stop is None else stop
        yield kind, body, min(stop, end)
        at = stop


def content(file, body: int, stop: int) -> bytes:
    file.seek(body)
    return file.read(min(stop - body, WINDOW))


def whole(file, body: int, stop: int) -> int:
    return int.from_bytes(content(file, body, min(stop, body + 8)), "big")


def real(file, body: int, stop: int) -> float:
    data = content(file, body, stop)
    return struct.unpack(">d" if len(data) == 8 else ">f", data)[0] if len(data) in (4, 8) else 0.0


def track_of(file, body: int, stop: int) -> dict:
    own = {"number": 0, "kind": 0, "codec": None, "default": None, "width": None, "height": None, "rate": None, "channels": None}
    for kind, a, b in children(file, body, stop):
        if kind in (NUMBER, KIND, DEFAULT):
            own[{NUMBER: "number", KIND: "kind", DEFAULT: "default"}[kind]] = whole(file, a, b)
        elif kind == CODEC:
            own["codec"] = content(file, a, b).rstrip(b"\0").decode("latin-1")
        elif kind in (VIDEO, AUDIO):
            for inner, x, y in children(file, a, b):
                if inner in (WIDTH, HEIGHT, CHANNELS):
                    own[{WIDTH: "width", HEIGHT: "height", CHANNELS: "channels"}[inner]] = whole(file, x, y)
                elif inner == RATE:
                    own["rate"] = int(real(file, x, y))
    return own


def head_of(file, length: int) -> dict | None:
    """Clock, tracks, where clusters begin, where cues stand and where the segment ends; None for another kind of file."""
    try:
        kind, _, stop = element(file, 0)
        if kind != EBML or stop is None:
            return None
        kind, base, end = element(file, stop)
    except ValueError:
        return None
    if kind != SEGMENT:
        return None
    head = {"scale": 1_000_000, "duration": None, "tracks": [], "first": None, "cues": None, "base": base, "end": min(end or length, length)}
    at = base
    while at < head["end"] and head["first"] is None:
        try:
            kind, body, stop = element(file, at)
        except ValueError:
            break
        if kind == CLUSTER:
            head["first"] = at
            break
        if stop is None:
            break
        if kind == INFO:
            for inner, a, b in children(file, body, stop):
                if inner == SCALE:
                    head["scale"] = whole(file, a, b)
                elif inner == DURATION:
                    head["duration"] = real(file, a, b)
        elif kind == TRACKS:
            head["tracks"] = [track_of(file, a, b) for inner, a, b in children(file, body, stop) if inner == ENTRY]
        elif kind == CUES:
            head["cues"] = at
        elif kind == SEEK_HEAD:
            for inner, a, b in children(file, body, stop):
                places = {k: whole(file, x, y) for k, x, y in children(file, a, b)} if inner == SEEK else {}
                if places.get(SEEK_ID) == CUES and SEEK_POSITION in places:
                    head["cues"] = base + places[SEEK_POSITION]
        at = stop
    return head


def is_cluster(file, at: int, end: int) -> bool:
    try:
        kind, body, stop = element(file, at)
        if kind != CLUSTER or element(file, body)[0] not in (FIRST_IN_CLUSTER if stop else (TIMESTAMP,)):
            return False
        return stop is None or stop == end or (stop < end and element(file, stop)[0] in TOP)
    except ValueError:
        return False


def next_cluster(file, start: int, stop: int, end: int) -> int | None:
    """The first cluster that begins from start on and before stop."""
    mark = CLUSTER.to_bytes(4, "big")
    for at in range(start, stop, WINDOW):
        file.seek(at)
        data = file.read(min(WINDOW, stop - at) + 3)
        found = data.find(mark)
        while found >= 0:
            if is_cluster(file, at + found, end):
                return at + found
            found = data.find(mark, found + 1)
    return None


def laces(data: bytes, at: int, flags: int, left: int) -> list[int | None]:
    """Sizes of the frames in a block, of which left bytes stand from at on."""
    kind = flags >> 1 & 3
    if not kind:
        return [left]
    n = data[at] + 1 if at < len(data) else 1
    at, left, sizes = at + 1, left - 1, []
    if kind == 2:
        return [left // n] * n
    try:
        for i in range(n - 1):
            if kind == 1:
                size = 0
                while True:
                    size, at, left = size + data[at], at + 1, left - 1
                    if data[at - 1] != 255:
                        break
            else:
                raw, p = vint(data, at)
                size = raw if i == 0 else sizes[-1] + raw - ((1 << 7 * (p - at) - 1) - 1)
                left, at = left - (p - at), p
            sizes.append(size)
    except (IndexError, ValueError, TypeError):
        return [None] * n
    return [*sizes, left - sum(sizes)]


def block_rows(file, head: dict, tracks: dict, body: int, stop: int, time: int, key: bool | None, duration: int | None, at: int) -> Iterator[tuple]:
    file.seek(body)
    data = file.read(min(stop - body, 64))
    try:
        number, p = vint(data, 0)
    except ValueError:
        return
    if number not in tracks or p + 3 > len(data):
        return
    i, track = tracks[number]
    flags = data[p + 2]
    if flags >> 1 & 3 not in (0, 2):
        file.seek(body)
        data = file.read(min(stop - body, 256 * 16))
    sizes = laces(data, p + 3, flags, stop - body - p - 3)
    default = track["default"] / head["scale"] if track["default"] else 0
    pts = time + int.from_bytes(data[p : p + 2], "big", signed=True)
    each = round(default) if duration is None else duration // len(sizes)
    for k, size in enumerate(sizes):
        yield i, KINDS.get(track["kind"], "other"), at + k, pts + round(k * (default or each)), each, bool(flags & 0x80) if key is None else key, size


def cluster_rows(file, head: dict, tracks: dict, at: int) -> Iterator[tuple]:
    """stream_index, media_type, place, pts, duration, is_key, size of every frame of a cluster."""
    _, place, stop = element(file, at)
    time, end = 0, stop or head["end"]
    while place < end:
        try:
            kind, body, to = element(file, place)
        except ValueError:
            return
        if to is None or to > end or (stop is None and kind in TOP[:-2]):
            return
        if kind == TIMESTAMP:
            time = whole(file, body, to)
        elif kind == SIMPLE_BLOCK:
            yield from block_rows(file, head, tracks, body, to, time, None, None, place)
        elif kind == GROUP:
            parts = {k: (a, b) for k, a, b in children(file, body, to)}
            if BLOCK in parts:
                duration = whole(file, *parts[BLOCK_DURATION]) if BLOCK_DURATION in parts else None
                yield from block_rows(file, head, tracks, *parts[BLOCK], time, REFERENCE not in parts, duration, place)
        place = to


PACKET = "source string, stream_index int, media_type string, seq long, pts long, duration long, is_key boolean, size long, tb_num int, tb_den int"


def split_rows(file, path: str, length: int, start: int, end: int) -> Iterator[tuple]:
    """The packets of a split: of the clusters that begin in it."""
    head = head_of(file, length)
    if head is None or head["first"] is None or end <= head["first"]:
        return
    num = math.gcd(head["scale"], 1_000_000_000)
    base = head["scale"] // num, 1_000_000_000 // num
    tracks = {t["number"]: (i, t) for i, t in enumerate(head["tracks"])}
    at = next_cluster(file, max(start, head["first"]), min(end, head["end"]), head["end"])
    while at is not None:
        for row in cluster_rows(file, head, tracks, at):
            yield path, *row, *base
        _, body, stop = element(file, at)
        # most clusters follow one another: the next is looked for only where something else stands
        at = stop if stop and stop < end and is_cluster(file, stop, head["end"]) else next_cluster(file, stop or body, min(end, head["end"]), head["end"])


def cue_rows(file, path: str) -> Iterator[tuple]:
    head = head_of(file, files.length_of(file))
    if head is None or head["cues"] is None:
        return
    try:
        kind, body, stop = element(file, head["cues"])
    except ValueError:
        return
    tracks = {t["number"]: i for i, t in enumerate(head["tracks"])}
    for point, a, b in children(file, body, stop or head["end"]) if kind == CUES else ():
        time, places = None, []
        for inner, x, y in children(file, a, b) if point == CUE_POINT else ():
            if inner == CUE_TIME:
                time = whole(file, x, y)
            elif inner == CUE_PLACES:
                places.append({k: whole(file, p, q) for k, p, q in children(file, x, y)})
        for own in places:
            if time is not None and own.get(CUE_TRACK) in tracks and CUE_CLUSTER in own:
                yield path, tracks[own[CUE_TRACK]], time, time * head["scale"] / 1e9, head["base"] + own[CUE_CLUSTER]


def cues(spark: SparkSession, path) -> DataFrame:
    """The index that files bring along: source, stream_index, pts, seconds, position (of the cluster)."""
    return files.scanned(files.listed(spark, path, SUFFIXES), cue_rows, "source string, stream_index int, pts long, seconds double, position long", ())


def stream_rows(file, path: str) -> Iterator[tuple]:
    head = head_of(file, files.length_of(file))
    for i, t in enumerate(head["tracks"] if head else ()):
        seconds = None if head["duration"] is None else head["duration"] * head["scale"] / 1e9
        yield path, i, KINDS.get(t["kind"], "other"), t["codec"], seconds, 1e9 / t["default"] if t["default"] and t["kind"] == 1 else None, t["width"], t["height"], t["rate"], t["channels"]


def streams(spark: SparkSession, path) -> DataFrame:
    """A row for each track, from headers alone."""
    schema = "source string, stream_index int, media_type string, codec string, duration_seconds_from_header double, average_fps_from_header double, width int, height int, sample_rate int, num_channels int"
    return files.scanned(files.listed(spark, path, SUFFIXES), stream_rows, schema, ())


def packets(spark: SparkSession, path, between: tuple[float, float] | None = None, split: int = SPLIT) -> DataFrame:
    """source, stream_index, media_type, seq (where the packet stands), pts, dts, duration, is_key, is_discard, tb_num, tb_den and size of every packet.

    between: of those on from start and before stop, in seconds; cues, where there are any, tell which splits hold them.
    """
    ranges = files.splits(files.listed(spark, path, SUFFIXES), split)
    if between is not None:
        start, stop = map(float, between)
        # a picture may be stored after a later key frame: the second cue after the range ends it
        later = F.array_sort(F.collect_set(F.when(F.col("seconds") > stop, F.col("position"))))
        around = cues(spark, path).groupBy(F.col("source").alias("path")).agg(F.max(F.when(F.col("seconds") <= start, F.col("position"))).alias("lo"), F.get(later, F.lit(1)).alias("hi"))
        near = ranges.join(around, "path", "left").filter("(lo is null or end > lo) and (hi is null or start < hi)")
        ranges = near.select("path", "length", F.greatest("start", F.coalesce("lo", F.lit(0))).alias("start"), F.least("end", F.coalesce("hi", F.lit((1 << 63) - 1))).alias("end"))
    found = files.scanned(ranges, split_rows, PACKET, ("length", "start", "end"))
    if between is not None:
        at = F.col("pts") * F.col("tb_num") / F.col("tb_den")
        found = found.filter((at >= start) & (at < stop))
    return found.select("source", "stream_index", "media_type", "seq", "pts", F.col("pts").alias("dts"), "duration", "is_key", F.lit(False).alias("is_discard"), "tb_num", "tb_den", "size")


def written(kind: int, *parts: bytes) -> bytes:
    data = b"".join(parts)
    return kind.to_bytes(-(-kind.bit_length() // 8), "big") + (1 << 56 | len(data)).to_bytes(8, "big") + data


def uint(kind: int, value: int) -> bytes:
    return written(kind, value.to_bytes(max(1, -(-value.bit_length() // 8)), "big"))


#: Bytes left for the head, bytes and ticks after which a cluster ends.
HEAD, CLUSTER_BYTES, CLUSTER_TICKS = 1 << 16, 1 << 20, 30_000


class MatroskaFile(sink.OpenFile):
    """Clusters as packets come, each one's size patched in at its end; the head, for which room is left, and the cues at the file's end."""

    def __init__(self, file):
        self.file, self.tracks, self.scale, self.open, self.last = file, {}, None, None, 0
        self.cues = [array("q"), array("q"), array("q")]
        start = written(EBML, uint(0x4286, 1), uint(0x42F7, 1), uint(0x42F2, 4), uint(0x42F3, 8), written(0x4282, b"matroska"), uint(0x4287, 4), uint(0x4285, 2))
        file.write(start + SEGMENT.to_bytes(4, "big") + (1 << 56).to_bytes(8, "big"))
        self.base = file.tell()
        file.write(written(VOID, b"\0" * (HEAD - 9)))

    def end_cluster(self) -> None:
        if self.open:
            at, end = self.open[0], self.file.tell()
            self.file.seek(at + 4)
            self.file.write((1 << 56 | (end - at - 12)).to_bytes(8, "big"))
            self.file.seek(end)
            self.open = None

    def add(self, row) -> None:
        scale, rest = divmod(1_000_000_000 * row.tb_num, row.tb_den)
        if rest or self.scale not in (None, scale):
            raise ValueError("streams of a file share one time base of whole nanoseconds")
        self.scale = scale
        if row.stream_index not in self.tracks:
            self.tracks[row.stream_index] = (len(self.tracks) + 1, row.media_type)
        if row.pts < 0:
            raise ValueError("no packet stands before zero")
        number, data = self.tracks[row.stream_index][0], bytes(row.data or b"")
        if self.open and (self.file.tell() - self.open[0] >= CLUSTER_BYTES or not -CLUSTER_TICKS <= row.pts - self.open[1] <= CLUSTER_TICKS):
            self.end_cluster()
        if not self.open:
            self.open = (self.file.tell(), row.pts)
            self.file.write(CLUSTER.to_bytes(4, "big") + (1 << 56).to_bytes(8, "big") + uint(TIMESTAMP, row.pts))
        if row.is_key:
            for column, value in zip(self.cues, (row.pts, number, self.open[0] - self.base), strict=True):
                column.append(value)
        block = (0x4000 | number).to_bytes(2, "big") + (row.pts - self.open[1]).to_bytes(2, "big", signed=True) + b"\0" + data
        parts = [written(BLOCK, block), uint(BLOCK_DURATION, max(row.duration or 0, 0))] + ([] if row.is_key else [written(REFERENCE, b"\0")])
        self.file.write(written(GROUP, *parts))
        self.last = max(self.last, row.pts + max(row.duration or 0, 0))

    def close(self) -> None:
        self.end_cluster()
        at, order = self.file.tell(), sorted(self.tracks)
        for i in range(len(self.cues[0])):
            if i == 0:
                self.file.write(CUES.to_bytes(4, "big") + (1 << 56).to_bytes(8, "big"))
            time, number, place = (c[i] for c in self.cues)
            self.file.write(written(CUE_POINT, uint(CUE_TIME, time), written(CUE_PLACES, uint(CUE_TRACK, number), uint(CUE_CLUSTER, place))))
        end = self.file.tell()
        if end > at:
            self.file.seek(at + 4)
            self.file.write((1 << 56 | (end - at - 12)).to_bytes(8, "big"))
        entries = [written(ENTRY, uint(NUMBER, self.tracks[k][0]), uint(0x73C5, self.tracks[k][0]), uint(KIND, {"video": 1, "audio": 2}.get(self.tracks[k][1], 17)), written(CODEC, b"V_UNCOMPRESSED" if self.tracks[k][1] == "video" else b"A_PCM/INT/LIT")) for k in order]
        seek = written(SEEK_HEAD, written(SEEK, uint(SEEK_ID, CUES), uint(SEEK_POSITION, at - self.base))) if end > at else b""
        head = seek + written(INFO, uint(SCALE, self.scale), written(DURATION, struct.pack(">d", self.last))) + written(TRACKS, *entries)
        if len(head) > HEAD - 9:
            raise ValueError("too many streams for a file's head")
        self.file.seek(self.base)
        self.file.write(head + written(VOID, b"\0" * (HEAD - 9 - len(head))))
        self.file.seek(self.base - 8)
        self.file.write((1 << 56 | (end - self.base)).to_bytes(8, "big"))


sink.FORMATS["matroska"] = (".mkv", MatroskaFile)


def write(packets: DataFrame, path: str) -> None:
    """A file for each source: source, stream_index, media_type, dts, pts, duration, is_key, tb_num, tb_den, data."""
    sink.write(packets, path, "matroska")
