"""MPEG transport streams: packets from PES headers, files cut into splits anywhere.

A split takes the transport packets that begin in it. It finds its first by CHAIN sync bytes a packet apart, with a stream
that it knows among them, and again where sync is lost. Which programme's streams there are is read from the tables at the file's head. Times have 33 bits: Spark
counts their wraps inside each split, and a running sum over splits (one row for each stream and split) tells how many came
before, so one long file is unwrapped by many tasks.

Defined results: a file without programme tables gives nothing; a PES packet without a time is marked as discarded, since
it has no place in the index; its header may reach over several transport packets, and over a split's end; transport
errors and scrambled payloads are passed over; a step of over 2 ** 32 ticks is taken for a wrap; a stream's last packet has a
duration of zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkreel.sources import files, sink

SUFFIXES = (".ts", ".m2t", ".mts")
SPLIT = 64 << 20
SIZE, SYNC, CHAIN = 188, 0x47, 5
#: Transport packets read at once.
WINDOW = 4096
WRAP, HALF = 1 << 33, 1 << 32
#: Stream types, and PES streams whose packets have no header of times.
VIDEO, AUDIO = (0x01, 0x02, 0x10, 0x1B, 0x24, 0x33, 0x42, 0xD1, 0xEA), (0x03, 0x04, 0x0F, 0x11, 0x1C, 0x81, 0x82, 0x83, 0x84, 0x87)
BARE = (0xBC, 0xBE, 0xBF, 0xF0, 0xF1, 0xF2, 0xF8, 0xFF)
#: Of a PES header, bytes up to the end of its times.
TIMES = 19


def aligned(file, start: int, stop: int, length: int, known: np.ndarray | None = None) -> int | None:
    """The first place from start on and before stop at which a transport packet begins. Sync bytes may be data, too: where known pids are told, one must be among the packets."""
    at = start
    while at < stop:
        file.seek(at)
        data = np.frombuffer(file.read(WINDOW + SIZE * CHAIN), np.uint8)
        n = min(WINDOW, stop - at, len(data))
        ok = data[:n] == SYNC
        for i in range(1, CHAIN):
            # the file may end before the chain does, behind at least one whole packet
            follow = np.full(n, True)
            there = np.arange(n) + i * SIZE < len(data)
            follow[there] = data[np.arange(n)[there] + i * SIZE] == SYNC
            ok &= follow
        ok &= at + np.arange(n) + SIZE <= length
        for found in np.nonzero(ok)[0].tolist():
            chain = data[found : found + (len(data) - found) // SIZE * SIZE][: CHAIN * SIZE].reshape(-1, SIZE)
            if known is None or np.isin(pids(chain), known).any():
                return at + found
        at += n
    return None


def payload(packet: bytes) -> tuple[bytes, bool]:
    """What a transport packet carries, and whether it is marked as a point of random access."""
    kind, at, random = packet[3] >> 4 & 3, 4, False
    if kind & 2:
        random = packet[4] > 0 and bool(packet[5] & 0x40)
        at = 5 + packet[4]
    return (packet[at:] if kind & 1 and at < SIZE else b""), random


def packets_at(file, at: int, stop: int, length: int, known: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first, packets x SIZE) of the packets that begin from at on and before stop; sync is found again where it is lost."""
    at = aligned(file, at, stop, length, known)
    while at is not None and at < stop:
        file.seek(at)
        want = min(WINDOW, -(-(stop - at) // SIZE))
        data = np.frombuffer(file.read(want * SIZE), np.uint8)
        rows = data[: len(data) // SIZE * SIZE].reshape(-1, SIZE)
        lost = np.nonzero(rows[:, 0] != SYNC)[0]
        n = int(lost[0]) if len(lost) else len(rows)
        if n:
            yield at, rows[:n]
        if len(lost):
            # the last one before may be no packet, but have the sync byte by chance
            at = aligned(file, at + max(0, (n - 1) * SIZE) + 1, stop, length, known)
        elif not n:
            return
        else:
            at += n * SIZE


def pids(rows: np.ndarray) -> np.ndarray:
    return (rows[:, 1].astype(np.int64) & 0x1F) << 8 | rows[:, 2]


def section(held: bytes) -> bytes | None:
    """The first section of a payload that begins with a pointer, once it is whole."""
    if not held or len(held) < 4 + held[0]:
        return None
    own = held[1 + held[0] :]
    size = 3 + (int.from_bytes(own[1:3], "big") & 0xFFF)
    return own[:size] if len(own) >= size else None


def programme(file, length: int) -> list[tuple[int, int]]:
    """(pid, stream type) of the streams that the first tables name, in their order."""
    maps, held, found = None, {}, {}
    for _, rows in packets_at(file, 0, length, length):
        for pid, row in zip(pids(rows).tolist(), rows, strict=True):
            if pid != 0 and (maps is None or pid not in maps or pid in found):
                continue
            data, _ = payload(row.tobytes())
            held[pid] = data if row[1] & 0x40 else held.get(pid, b"") + data if pid in held else b""
            own = section(held[pid])
            if own is None:
                continue
            if pid == 0 and maps is None:
                maps = [int.from_bytes(own[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(own) - 4, 4) if own[i] or own[i + 1]]
            elif pid != 0:
                at, streams = 12 + (int.from_bytes(own[10:12], "big") & 0xFFF), []
                while at + 5 <= len(own) - 4:
                    streams.append((int.from_bytes(own[at + 1 : at + 3], "big") & 0x1FFF, own[at]))
                    at += 5 + (int.from_bytes(own[at + 3 : at + 5], "big") & 0xFFF)
                found[pid] = streams
            if maps is not None and len(found) == len(set(maps)):
                return [s for pid in maps for s in found[pid]]
    return [s for pid in maps or () for s in found.get(pid, ())]


def stamp(data: bytes, at: int) -> int:
    return (data[at] >> 1 & 7) << 30 | int.from_bytes(data[at + 1 : at + 3], "big") >> 1 << 15 | int.from_bytes(data[at + 3 : at + 5], "big") >> 1


def times(head: bytes) -> tuple[int | None, int | None]:
    """pts and dts of a PES header, where it has them."""
    if len(head) < 9 or head[3] in BARE:
        return None, None
    which = head[7] >> 6
    pts = stamp(head, 9) if which & 2 and len(head) >= 14 else None
    return pts, stamp(head, 14) if which == 3 and len(head) >= TIMES else pts


def rest_of_head(file, head: bytes, at: int, pid: int, length: int) -> bytes:
    """A PES header that its first transport packet holds in part, with what follows in the next ones of its pid."""
    for place, rows in packets_at(file, at, length, length):
        for row in rows[pids(rows) == pid]:
            if row[1] & 0x40 or len(head) >= TIMES:
                return head
            head += payload(row.tobytes())[0]
        if len(head) >= TIMES or place - at > 64 << 20:
            break
    return head


RAW = "source string, split long, stream_index int, media_type string, seq long, raw_pts long, raw_dts long, is_key boolean"


def split_rows(file, path: str, length: int, start: int, end: int) -> Iterator[tuple]:
    known = {pid: (i, kind) for i, (pid, kind) in enumerate(programme(file, length))}
    if not known:
        return
    wanted = np.array(list(known))
    for place, rows in packets_at(file, start, end, length, wanted):
        own = pids(rows)
        # no transport error, a PES packet's beginning, not scrambled, with a payload
        begins = (rows[:, 1] & 0xC0 == 0x40) & (rows[:, 3] & 0xC0 == 0) & (rows[:, 3] & 0x10 != 0) & np.isin(own, wanted)
        for i in np.nonzero(begins)[0].tolist():
            head, random = payload(rows[i].tobytes())
            at = place + i * SIZE
            if len(head) < TIMES:
                head = rest_of_head(file, head, at + SIZE, int(own[i]), length)
            if head[:3] != b"\0\0\1":
                continue
            index, kind = known[int(own[i])]
            media = "video" if kind in VIDEO else "audio" if kind in AUDIO else "other"
            yield path, start, index, media, at, *times(head), random or media == "audio"


def wraps(step: Column) -> Column:
    return F.when(step < -HALF, 1).when(step > HALF, -1).otherwise(0)


def unwrapped(raw: DataFrame) -> DataFrame:
    """raw (RAW) with pts, dts and duration in ticks that don't wrap."""
    keys = ["source", "stream_index"]
    inside = Window.partitionBy(*keys, "split").orderBy("seq")
    timed = raw.withColumn("t", F.coalesce("raw_dts", "raw_pts"))
    before = F.last("t", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    own = timed.withColumn("wrap", F.coalesce(wraps(F.col("t") - before), F.lit(0))).withColumn("local", F.sum("wrap").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # a row a stream and split: what comes together by stream is that, not packets
    ends = own.filter("t is not null").groupBy(*keys, "split").agg(F.min_by("t", "seq").alias("first"), F.max_by("t", "seq").alias("last"), F.sum("wrap").alias("wraps"))
    order = Window.partitionBy(*keys).orderBy("split")
    entry = ends.withColumn("entry", F.coalesce(wraps(F.col("first") - F.lag("last").over(order)), F.lit(0)))
    epoch = F.sum("entry").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("wraps").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = entry.withColumn("epoch", epoch).select(*keys, "split", "epoch", F.lead(F.col("first") + F.col("epoch") * WRAP).over(order).alias("then"))
    joined = own.join(moved, [*keys, "split"], "left")
    dts = F.col("t") + (F.col("local") + F.col("epoch")) * WRAP
    placed = joined.withColumn("dts", dts).withColumn("pts", F.col("dts") + F.pmod(F.col("raw_pts") - F.col("t") + HALF, F.lit(WRAP)) - HALF)
    after = F.first("dts", ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing))
    return placed.withColumn("duration", F.coalesce(F.coalesce(after, F.col("then")) - F.col("dts"), F.lit(0)))


def packets(spark: SparkSession, path, split: int = SPLIT) -> DataFrame:
    """source, stream_index, media_type, seq (where the packet stands), pts, dts, duration, is_key, is_discard, tb_num, tb_den of every packet, in ticks of 90 kHz."""
    raw = files.scanned(files.splits(files.listed(spark, path, SUFFIXES), split), split_rows, RAW, ("length", "start", "end"))
    return unwrapped(raw).select("source", "stream_index", "media_type", "seq", "pts", "dts", "duration", "is_key", F.col("dts").isNull().alias("is_discard"), F.lit(1).alias("tb_num"), F.lit(90_000).alias("tb_den"))


def crc32(data: bytes) -> int:
    """Of a table: polynomial 0x04C11DB7, highest bit first."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def table_packets(pid: int, table: int, body: bytes, room: int) -> bytes:
    """A section in room transport packets."""
    own = bytes([table]) + (0xB000 | len(body) + 4).to_bytes(2, "big") + body
    data = b"\0" + own + crc32(own).to_bytes(4, "big")
    if len(data) > room * 184:
        raise ValueError("too many streams for a programme's table")
    parts = [data[i : i + 184].ljust(184, b"\xff") for i in range(0, room * 184, 184)]
    return b"".join(bytes([SYNC, (0x40 if i == 0 else 0) | pid >> 8, pid & 0xFF, 0x10 | i & 15]) + x for i, x in enumerate(parts))


def stamped(prefix: int, ticks: int) -> bytes:
    t = ticks % WRAP
    return bytes([prefix << 4 | t >> 30 << 1 | 1]) + ((t >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((t & 0x7FFF) << 1 | 1).to_bytes(2, "big")


#: Where tables and streams stand; transport packets left for the programme's table.
MAP_PID, FIRST_PID, ROOM = 0x1000, 0x100, 5


class TsFile(sink.OpenFile):
    """Transport packets as they come; the tables, for which room is left, at the end."""

    def __init__(self, file):
        self.file, self.streams = file, {}
        file.write(b"\0" * SIZE * (1 + ROOM))

    def add(self, row) -> None:
        if row.stream_index not in self.streams:
            self.streams[row.stream_index] = [FIRST_PID + len(self.streams), row.media_type, 0]
        own = self.streams[row.stream_index]
        ticks = [(2 * t * 90_000 * row.tb_num + row.tb_den) // (2 * row.tb_den) for t in (row.pts, row.dts)]
        both = ticks[0] != ticks[1]
        stamps = stamped(3 if both else 2, ticks[0]) + (stamped(1, ticks[1]) if both else b"")
        data = bytes(row.data or b"")
        size = len(data) + 3 + len(stamps)
        pes = b"\0\0\1" + bytes([0xE0 if own[1] == "video" else 0xC0]) + (size if size < 1 << 16 else 0).to_bytes(2, "big") + bytes([0x80, 0xC0 if both else 0x80, len(stamps)]) + stamps + data
        at = 0
        while at < len(pes):
            flags = b"\x40" if at == 0 and row.is_key else None
            room = 184 - (2 if flags else 0)
            part = pes[at : at + room]
            if flags or len(part) < 184:
                fill = 183 - len(part)
                field = bytes([fill]) + ((flags or b"\0") + b"\xff" * (fill - 1) if fill else b"")
            else:
                field = b""
            self.file.write(bytes([SYNC, (0x40 if at == 0 else 0) | own[0] >> 8, own[0] & 0xFF, (0x30 if field else 0x10) | own[2]]) + field + part)
            own[2] = own[2] + 1 & 15
            at += len(part)

    def close(self) -> None:
        rows = [self.streams[k] for k in sorted(self.streams)]
        body = b"".join(bytes([0x1B if media == "video" else 0x0F if media == "audio" else 0x06]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\0" for pid, media, _ in rows)
        self.file.seek(0)
        self.file.write(table_packets(0, 0, b"\0\1\xc1\0\0\0\1" + (0xE000 | MAP_PID).to_bytes(2, "big"), 1))
        self.file.write(table_packets(MAP_PID, 2, b"\0\1\xc1\0\0" + (0xE000 | FIRST_PID).to_bytes(2, "big") + b"\xf0\0" + body, ROOM))


sink.FORMATS["mpegts"] = (".ts", TsFile)


def write(packets: DataFrame, path: str) -> None:
    """A file for each source: source, stream_index, media_type, dts, pts, is_key, tb_num, tb_den, data."""
    sink.write(packets, path, "mpegts")
