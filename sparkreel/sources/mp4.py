"""MP4 and MOV: the packets of a file from its sample tables, without reading a sample.

Tasks walk the boxes by range and read the tables of the movie header (and of fragments) in pieces, as runs: so many
samples of this duration, of that composition offset, and so on. Spark does the rest: what earlier pieces hold is a
running sum over pieces, runs are cut at blocks of BLOCK samples, the tables' runs of a block meet by grouping, and each
block is expanded to its packets by array expressions. What is shuffled is run lengths, and no task holds more than a
block, however long the file.

Edit lists move packets in time; samples that lie in none of the edits are there to be decoded but not shown and are
marked as discarded. A sample that two edits show is a packet twice.

`write` makes such files of packets: samples are written as they come, streams interleaved by time, and tables, which are
all that a task holds, at the end.

Defined results: a file without a movie header, or with tables that are cut off, gives what can be read of it; tracks
without samples give no packets; a missing composition offset is zero; without a sync sample table every sample is a key.
"""

from __future__ import annotations

import json
import math
import struct
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkreel.sources import files, sink

SUFFIXES = (".mp4", ".mov", ".m4a", ".m4v")
#: Table entries of a piece; samples of a block.
ENTRIES, BLOCK = 1 << 14, 1 << 12
RUNS = "path string, track int, kind string, piece long, head string, base long, total_n long, total_t long, runs array<struct<first:long,n:long,t:long,d:long>>"
#: Boxes that hold boxes.
NESTED = ("moov", "trak", "mdia", "minf", "stbl", "edts", "moof", "traf", "mvex")
#: Flags of track fragment headers and runs.
BASE_OFFSET, DESCRIPTION, DURATION, SIZE, FLAGS = 0x1, 0x2, 0x8, 0x10, 0x20
DATA_OFFSET, FIRST_FLAGS, RUN_DURATION, RUN_SIZE, RUN_FLAGS, RUN_OFFSET = 0x1, 0x4, 0x100, 0x200, 0x400, 0x800
NOT_SYNC = 0x10000


def number(data: bytes, at: int, size: int, signed: bool = False) -> int:
    return int.from_bytes(data[at : at + size], "big", signed=signed)


def boxes(file, start: int, end: int) -> Iterator[tuple[str, int, int]]:
    """kind, first byte of the body, end, of the boxes from start on. Only their headers are read."""
    while start + 8 <= end:
        file.seek(start)
        head = file.read(16)
        if len(head) < 8:
            return
        size, body = number(head, 0, 4), start + 8
        if size == 1:
            size, body = number(head, 8, 8), start + 16
        stop = end if size == 0 else start + size
        if stop < body:
            return
        yield head[4:8].decode("latin-1"), body, min(stop, end)
        start = stop


def body(file, start: int, end: int, most: int = 1 << 16) -> bytes:
    file.seek(start)
    return file.read(min(end - start, most))


def entries(file, start: int, end: int, n: int, kind: str) -> Iterator[tuple[int, np.ndarray]]:
    """(number of the first, entries x fields) of a table of n entries, in pieces."""
    dtype = np.dtype(kind)
    n = min(n, max(0, end - start) // dtype.itemsize)
    for at in range(0, n, ENTRIES):
        file.seek(start + at * dtype.itemsize)
        yield at, np.frombuffer(file.read(min(ENTRIES, n - at) * dtype.itemsize), dtype)


def sample_entry(data: bytes, handler: str) -> dict:
    """Of a sample description: codec and what the first entry tells of pictures or samples."""
    if len(data) < 16:
        return {}
    out = {"codec": data[12:16].decode("latin-1").strip()}
    if handler == "vide" and len(data) >= 8 + 36:
        out |= {"width": number(data, 8 + 32, 2), "height": number(data, 8 + 34, 2)}
    if handler == "soun" and len(data) >= 8 + 36:
        out |= {"num_channels": number(data, 8 + 24, 2), "sample_rate": number(data, 8 + 32, 4) >> 16}
    return out


def edits_of(data: bytes, movie: int, own: int) -> list[tuple[int, int, int]]:
    """(instant on the time line, media time, duration) of each edit that shows media, in the track's ticks; the duration is -1 where it is open."""
    wide, at, out = data[0] == 1, 0, []
    for i in range(min(number(data, 4, 4), (len(data) - 8) // (20 if wide else 12))):
        p = 8 + i * (20 if wide else 12)
        length, media = (number(data, p, 8), number(data, p + 8, 8, True)) if wide else (number(data, p, 4), number(data, p + 4, 4, True))
        ticks = (length * own + movie // 2) // movie if movie else 0
        if media >= 0:
            out.append((at, media, ticks or -1))
        at += ticks
    return out


def movie_of(file, start: int, end: int) -> tuple[dict, list[dict]]:
    """What the movie header tells: the movie, and its tracks with their tables (kind: body, end)."""
    movie, tracks, defaults, edit = {"timescale": 0}, [], {}, {}

    def walk(a: int, b: int) -> None:
        for kind, at, to in boxes(file, a, b):
            if kind == "trak":
                tracks.append({"handler": "", "timescale": 0, "tables": {}, "id": 0})
            own = tracks[-1] if tracks else None
            if kind in NESTED:
                walk(at, to)
            elif kind == "mvhd":
                data = body(file, at, to)
                wide = data[0] == 1
                movie.update(timescale=number(data, 20 if wide else 12, 4), duration=number(data, 24 if wide else 16, 8 if wide else 4))
            elif kind == "trex":
                data = body(file, at, to)
                defaults[number(data, 4, 4)] = {"duration": number(data, 12, 4), "size": number(data, 16, 4), "flags": number(data, 20, 4)}
            elif own is None:
                continue
            elif kind == "tkhd":
                data = body(file, at, to)
                own["id"] = number(data, 20 if data[0] == 1 else 12, 4)
            elif kind == "mdhd":
                data = body(file, at, to)
                wide = data[0] == 1
                own.update(timescale=number(data, 20 if wide else 12, 4), duration=number(data, 24 if wide else 16, 8 if wide else 4))
            elif kind == "hdlr" and not own["handler"]:
                own["handler"] = body(file, at, to)[8:12].decode("latin-1")
            elif kind == "stsd":
                own.update(sample_entry(body(file, at, to), own["handler"]))
            elif kind == "elst":
                edit[len(tracks) - 1] = body(file, at, to, 1 << 20)
            elif kind in ("stts", "ctts", "stss", "stsz", "stz2"):
                own["tables"][kind] = (at, to)

    walk(start, end)
    for i, t in enumerate(tracks):
        t["edits"] = edits_of(edit[i], movie["timescale"], t["timescale"]) if i in edit else []
        t["default"] = defaults.get(t["id"], {})
    return movie, tracks


def head_of(movie: dict, track: dict) -> str:
    return json.dumps({k: track.get(k) for k in ("handler", "timescale", "duration", "codec", "width", "height", "num_channels", "sample_rate", "edits")} | {"movie_timescale": movie["timescale"], "movie_duration": movie.get("duration"), "all_keys": "stss" not in track["tables"]})


def runs_of(first: np.ndarray, n: np.ndarray, t: np.ndarray, d: np.ndarray) -> list[tuple[int, int, int, int]]:
    return list(zip(first.tolist(), n.tolist(), t.tolist(), d.tolist(), strict=True))


def merged(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and how long they are."""
    begins = np.concatenate(([0], np.nonzero(np.diff(values))[0] + 1))
    return begins, np.diff(np.append(begins, len(values)))


def counted(kind: str, counts: np.ndarray, values: np.ndarray) -> tuple[int, int, list]:
    """Samples, ticks and runs of entries (how many, value): t is the ticks before the run, where values are durations."""
    counts, values = counts.astype(np.int64), values.astype(np.int64)
    ticks = counts * values if kind == "stts" else np.zeros_like(counts)
    return int(counts.sum()), int(ticks.sum()), runs_of(np.cumsum(counts) - counts, counts, np.cumsum(ticks) - ticks, values)


def table_runs(file, kind: str, start: int, end: int, samples: int) -> Iterator[tuple[int, int, int, list]]:
    """piece, samples, ticks and runs of a track's table. stss: runs of consecutive sync samples, of which the last piece counts the track's samples."""
    data = body(file, start, end, 12)
    n = number(data, 8 if kind in ("stsz", "stz2") else 4, 4)
    if kind in ("stts", "ctts"):
        for at, x in entries(file, start + 8, end, n, [("n", ">u4"), ("v", ">u4" if kind == "stts" else ">i4")]):
            yield (at // ENTRIES, *counted(kind, x["n"], x["v"]))
    elif kind == "stsz" and number(data, 4, 4):
        yield 0, n, 0, [(0, n, 0, number(data, 4, 4))]
    elif kind == "stsz":
        for at, x in entries(file, start + 12, end, n, ">u4"):
            begins, lengths = merged(x)
            yield at // ENTRIES, len(x), 0, runs_of(begins, lengths, 0 * begins, x[begins].astype(np.int64))
    elif kind == "stss":
        pieces = max(1, -(-min(n, max(0, end - start - 8) // 4) // ENTRIES))
        if not n:
            yield 0, samples, 0, []
        for at, x in entries(file, start + 8, end, n, ">u4"):
            begins, lengths = merged(x.astype(np.int64) - np.arange(len(x)))
            yield at // ENTRIES, samples if at // ENTRIES == pieces - 1 else 0, 0, runs_of(x[begins].astype(np.int64) - 1, lengths, 0 * begins, 0 * begins)


def sample_count(file, tables: dict) -> int:
    if "stsz" not in tables and "stz2" not in tables:
        return 0
    at, to = tables.get("stsz") or tables["stz2"]
    return number(body(file, at, to, 12), 8, 4)


def fragment_runs(file, start: int, end: int, tracks: dict[int, dict]) -> Iterator[tuple[int, str, int | None, int, int, list]]:
    """track, kind, base (the fragment's first instant, where it is told), samples, ticks and runs of a movie fragment."""
    for kind, at, to in boxes(file, start, end):
        if kind != "traf":
            continue
        own, base, parts = None, None, []
        for inner, a, b in boxes(file, at, to):
            if inner == "tfhd":
                data = body(file, a, b)
                flags, p = number(data, 1, 3), 8
                track = tracks.get(number(data, 4, 4))
                if track is None:
                    break
                own = dict(track["default"], index=track["index"])
                p += 8 * bool(flags & BASE_OFFSET) + 4 * bool(flags & DESCRIPTION)
                for bit, name in ((DURATION, "duration"), (SIZE, "size"), (FLAGS, "flags")):
                    if flags & bit:
                        own[name], p = number(data, p, 4), p + 4
            elif inner == "tfdt":
                data = body(file, a, b)
                base = number(data, 4, 8 if data[0] == 1 else 4)
            elif inner == "trun" and own is not None:
                data = body(file, a, b, 20)
                flags, n, p = number(data, 1, 3), number(data, 4, 4), 8
                p += 4 * bool(flags & DATA_OFFSET)
                first = number(data, p, 4) if flags & FIRST_FLAGS else None
                p += 4 * bool(flags & FIRST_FLAGS)
                fields = [(name, ">i4" if bit == RUN_OFFSET else ">u4") for bit, name in ((RUN_DURATION, "duration"), (RUN_SIZE, "size"), (RUN_FLAGS, "flags"), (RUN_OFFSET, "offset")) if flags & bit]
                if fields:
                    x = np.frombuffer(body(file, a + p, b, n * 4 * len(fields)), np.dtype(fields))
                    n = len(x)
                column = lambda name, x=x if fields else None, n=n, fields=fields: x[name].astype(np.int64) if any(f == name for f, _ in fields) else np.full(n, own.get(name, 0), np.int64)
                marks = column("flags").copy()
                if first is not None and n:
                    marks[0] = first
                parts.append((column("duration"), column("offset") if any(f == "offset" for f, _ in fields) else np.zeros(n, np.int64), marks & NOT_SYNC == 0, column("size")))
        if own is None or not parts:
            continue
        durations, offsets, keys, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(durations):
            continue
        n = len(durations)
        for name, values in (("stts", durations), ("ctts", offsets), ("stsz", sizes)):
            begins, lengths = merged(values)
            count, ticks, runs = counted(name, lengths, values[begins])
            yield own["index"], name, base if name == "stts" else None, count, ticks, runs
        begins, lengths = merged(keys)
        yield own["index"], "stss", None, n, 0, [(int(a), int(m), 0, 0) for a, m in zip(begins, lengths, strict=True) if keys[a]]


def file_runs(file, path: str) -> Iterator[tuple]:
    """The rows of RUNS of a file."""
    end, movie, tracks, fragments = files.length_of(file), {}, [], 0
    for kind, at, to in boxes(file, 0, end):
        if kind == "moov" and not tracks:
            movie, tracks = movie_of(file, at, to)
            for i, t in enumerate(tracks):
                t["index"], head = i, head_of(movie, t)
                yield path, i, "head", 0, head, None, 0, 0, []
                samples = sample_count(file, t["tables"])
                for name, (a, b) in t["tables"].items():
                    for piece, n, ticks, runs in table_runs(file, name, a, b, samples):
                        yield path, i, name, piece, head if name == "stts" else None, 0 if piece == 0 and name == "stts" else None, n, ticks, runs
                if "stss" not in t["tables"] and samples:
                    yield path, i, "stss", 0, None, None, samples, 0, [(0, samples, 0, 0)]
        elif kind == "moof" and tracks:
            fragments += 1
            by_id = {t["id"]: t for t in tracks}
            for i, name, base, n, ticks, runs in fragment_runs(file, at, to, by_id):
                yield path, i, name, (fragments << 32), head_of(movie, tracks[i]) if name == "stts" else None, base, n, ticks, runs


def runs(spark: SparkSession, path) -> DataFrame:
    return files.scanned(files.listed(spark, path, SUFFIXES), file_runs, RUNS, (), held=64)


HEAD = "handler string, timescale long, duration long, codec string, width int, height int, num_channels int, sample_rate int, edits array<array<long>>, movie_timescale long, movie_duration long, all_keys boolean"


def media_type() -> Column:
    return F.when(F.col("h.handler") == "vide", "video").when(F.col("h.handler") == "soun", "audio").otherwise("other")


def streams(spark: SparkSession, path) -> DataFrame:
    """A row for each track, from headers alone: source, stream_index, media_type, codec, duration_seconds_from_header, num_frames_from_header, average_fps_from_header, width, height, sample_rate, num_channels."""
    rows = runs(spark, path).filter("kind = 'head' or kind = 'stsz'")
    heads = rows.groupBy("path", "track").agg(F.max(F.when(F.col("kind") == "head", F.col("head"))).alias("head"), F.sum("total_n").alias("n"))
    own = heads.withColumn("h", F.from_json("head", HEAD))
    seconds = F.col("h.duration") / F.col("h.timescale")
    return own.select(
        F.col("path").alias("source"), F.col("track").alias("stream_index"), media_type().alias("media_type"), F.col("h.codec").alias("codec"), seconds.alias("duration_seconds_from_header"), F.col("n").alias("num_frames_from_header"),
        F.when((F.col("h.handler") == "vide") & (seconds > 0), F.col("n") / seconds).alias("average_fps_from_header"), "h.width", "h.height", "h.sample_rate", "h.num_channels",
    )


def packets(spark: SparkSession, path) -> DataFrame:
    """source, stream_index, media_type, seq, pts, dts, duration, is_key, is_discard, tb_num, tb_den and size of every packet."""
    pieces = runs(spark, path).filter("kind != 'head'")
    before = Window.partitionBy("path", "track", "kind").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    # a fragment that tells its first instant begins a new sum of ticks
    epoch = F.count("base").over(Window.partitionBy("path", "track", "kind").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    since = Window.partitionBy("path", "track", "kind", "epoch").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    start = F.max("base").over(Window.partitionBy("path", "track", "kind", "epoch"))
    carried = pieces.withColumns({"samples": F.coalesce(F.sum("total_n").over(before), F.lit(0)), "epoch": epoch}).withColumn("ticks", F.coalesce(F.sum("total_t").over(since), F.lit(0)) + F.coalesce(start, F.lit(0)))
    each = carried.select("path", "track", "kind", "head", "samples", "ticks", F.explode("runs").alias("r"))
    placed = each.select("path", "track", "kind", "head", (F.col("samples") + F.col("r.first")).alias("first"), F.col("r.n").alias("n"), (F.col("ticks") + F.col("r.t")).alias("t"), F.col("r.d").alias("d")).filter("n > 0")
    # a run of very many samples reaches over many blocks: each gets its part
    cut = placed.select("*", F.explode(F.expr(f"sequence(first div {BLOCK}, (first + n - 1) div {BLOCK})")).alias("block"))
    skipped = F.greatest(F.col("block") * BLOCK - F.col("first"), F.lit(0).cast("long"))
    part = cut.select("path", "track", "block", "kind", "head", F.struct(
        (F.col("first") + skipped).alias("first"), (F.least(F.col("first") + F.col("n"), (F.col("block") + 1) * BLOCK) - F.col("first") - skipped).alias("n"),
        (F.col("t") + F.when(F.col("kind") == "stts", skipped * F.col("d")).otherwise(0)).alias("t"), F.col("d").alias("d"),
    ).alias("r"))
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("r")))).alias(kind)
    blocks = part.groupBy("path", "track", "block").agg(F.max("head").alias("head"), *map(of, ("stts", "ctts", "stss", "stsz"))).filter("size(stts) > 0")
    ticks = F.flatten(F.transform("stts", lambda r: F.transform(F.sequence(F.lit(0).cast("long"), r["n"] - 1), lambda i: F.struct((r["first"] + i).alias("seq"), (r["t"] + i * r["d"]).alias("dts"), r["d"].alias("duration")))))
    # the other tables may begin after a block's first sample, or end before its last
    late = lambda kind: F.array_repeat(F.lit(None).cast("long"), F.greatest(F.get(kind, F.lit(0))["first"] - F.get("stts", F.lit(0))["first"], F.lit(0)).cast("int"))
    values = lambda kind: F.concat(late(kind), F.flatten(F.transform(kind, lambda r: F.array_repeat(r["d"], r["n"].cast("int")))))
    key = lambda x: F.exists("stss", lambda r: (x["seq"] >= r["first"]) & (x["seq"] < r["first"] + r["n"]))
    offset, size = (F.when(F.size(k) > 0, values(k)).otherwise(F.array().cast("array<bigint>")) for k in ("ctts", "stsz"))
    laid = blocks.select("path", "track", F.from_json("head", HEAD).alias("h"), F.explode(F.arrays_zip(ticks.alias("a"), offset.alias("offset"), size.alias("size"), F.transform(ticks, key).alias("is_key"))).alias("s"))
    rows = laid.filter("s.a is not null").select("path", "track", "h", "s.a.*", "s.is_key", "s.size", (F.col("s.a.dts") + F.coalesce("s.offset", F.lit(0))).alias("at"))
    edit = F.transform("h.edits", lambda e: F.struct(e[0].alias("at"), e[1].alias("media"), e[2].alias("length")))
    shown = F.filter(edit, lambda e: (F.col("at") >= e["media"]) & ((e["length"] < 0) | (F.col("at") < e["media"] + e["length"])))
    shift = F.transform(shown, lambda e: F.struct((e["at"] - e["media"]).alias("shift"), F.lit(False).alias("is_discard")))
    hidden = F.array(F.struct(F.coalesce(F.get(edit, F.lit(0))["at"] - F.get(edit, F.lit(0))["media"], F.lit(0).cast("long")).alias("shift"), (F.size("h.edits") > 0).alias("is_discard")))
    timed = rows.select("*", F.inline(F.when(F.size(shown) > 0, shift).otherwise(hidden)))
    return timed.select(
        F.col("path").alias("source"), F.col("track").alias("stream_index"), media_type().alias("media_type"), "seq", (F.col("at") + F.col("shift")).alias("pts"), (F.col("dts") + F.col("shift")).alias("dts"),
        "duration", "is_key", "is_discard", F.lit(1).alias("tb_num"), F.col("h.timescale").cast("int").alias("tb_den"), "size",
    )


class Track:
    """The sample tables of a track as they grow: run lengths, sizes and chunks, never a sample."""

    def __init__(self, row):
        self.media, self.den, self.num, self.first = row.media_type, row.tb_den, row.tb_num, None
        self.stts, self.ctts, self.stsc, self.keys, self.sizes, self.chunks = [], [], [], array("I"), array("I"), array("Q")
        self.last, self.n, self.end = None, 0, 0

    def step(self, ticks: int) -> None:
        if not 0 <= ticks < 1 << 32:
            raise ValueError(f"{ticks} ticks between two packets don't fit a sample table: packets of a stream are written by dts, in a time base that holds their distance in 32 bits")
        if self.stts and self.stts[-1][1] == ticks:
            self.stts[-1][0] += 1
        else:
            self.stts.append([1, ticks])

    def add(self, dts: int, pts: int, duration: int, is_key: bool, size: int, at: int, fresh: bool) -> None:
        if self.last is None:
            self.first = dts
        else:
            self.step(dts - self.last[0])
        self.last, offset = (dts, duration), pts - dts
        self.end = max(self.end, pts + max(duration or 0, 0))
        if self.ctts and self.ctts[-1][1] == offset:
            self.ctts[-1][0] += 1
        else:
            self.ctts.append([1, offset])
        self.n += 1
        if is_key:
            self.keys.append(self.n)
        self.sizes.append(size)
        if fresh or not self.chunks:
            self.chunks.append(at)
            self.stsc.append(0)
        self.stsc[-1] += 1

    def close(self) -> None:
        self.step(max(self.last[1] or 0, 0))


def box(kind: str, *parts: bytes) -> bytes:
    data = b"".join(parts)
    return struct.pack(">I4s", len(data) + 8, kind.encode()) + data


def full(kind: str, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def table(kind: str, rows: list, form: str, version: int = 0) -> bytes:
    return full(kind, version, 0, struct.pack(">I", len(rows)), b"".join(struct.pack(form, *r) for r in rows))


def wide(kind: str, values: array) -> bytes:
    big = np.array(values).astype({"stco": ">u4", "co64": ">u8", "stss": ">u4", "stsz": ">u4"}[kind]).tobytes()
    return full(kind, 0, 0, struct.pack(">II", 0, len(values)) if kind == "stsz" else struct.pack(">I", len(values)), big)


MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
ENTRY = {"video": b"\0" * 16 + struct.pack(">HHIIIH", 0, 0, 0x480000, 0x480000, 0, 1) + b"\0" * 32 + struct.pack(">Hh", 24, -1), "audio": b"\0" * 8 + struct.pack(">HHHHI", 1, 16, 0, 0, 0)}
KIND = {"video": (b"vide", "vmhd", b"\0" * 8), "audio": (b"soun", "smhd", b"\0" * 4)}


def track_box(number: int, t: Track, scale: int) -> bytes:
    """A track's header with its tables. scale: ticks of the movie's clock a second."""
    ticks = sum(n * d for n, d in t.stts)
    handler, name, head = KIND.get(t.media, (b"meta", "nmhd", b""))
    length = -(-max(t.end, 0) * scale // t.den)
    shift = [] if not t.first else [(length, -t.first)] if t.first < 0 else [(t.first * scale // t.den, -1), (0, 0)]
    edit = box("edts", full("elst", 1, 0, struct.pack(">I", len(shift)), b"".join(struct.pack(">QqI", d, m, 0x10000) for d, m in shift))) if shift else b""
    entry = box("raw ", b"\0" * 6 + struct.pack(">H", 1), ENTRY.get(t.media, b""))
    chunks = [[i + 1, n, 1] for i, n in enumerate(t.stsc) if i == 0 or n != t.stsc[i - 1]]
    tables = [full("stsd", 0, 0, struct.pack(">I", 1), entry), table("stts", t.stts, ">II")]
    tables += [table("ctts", t.ctts, ">Ii", 1)] if any(o for _, o in t.ctts) else []
    tables += [wide("stss", t.keys)] if len(t.keys) < t.n else []
    tables += [table("stsc", chunks, ">III"), wide("stsz", t.sizes), wide("co64", t.chunks)]
    info = box("minf", full(name, 0, 1, head), box("dinf", full("dref", 0, 0, struct.pack(">I", 1), full("url ", 0, 1))), box("stbl", *tables))
    media = box("mdia", full("mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, t.den, ticks, 0x55C4, 0)), full("hdlr", 0, 0, b"\0" * 4 + handler + b"\0" * 13), info)
    return box("trak", full("tkhd", 1, 7, struct.pack(">QQIIQQHHHH", 0, 0, number, 0, length, 0, 0, 0, 0, 0), MATRIX, struct.pack(">II", 0, 0)), edit, media)


#: Bytes after which a chunk of a stream ends.
CHUNK = 1 << 20


class Mp4File(sink.OpenFile):
    """Samples first, chunk by chunk, the movie header at the end, the size of the samples patched in."""

    def __init__(self, file):
        self.file, self.tracks, self.open = file, {}, None
        self.file.write(box("ftyp", b"isom", struct.pack(">I", 0x200), b"isom") + struct.pack(">I4sQ", 1, b"mdat", 0))
        self.at = self.start = self.file.tell()

    def add(self, row) -> None:
        t = self.tracks.get(row.stream_index)
        if t is None:
            t = self.tracks[row.stream_index] = Track(row)
        if (t.num, t.den) != (row.tb_num, row.tb_den) or t.num != 1:
            raise ValueError("a stream has one time base, of one over a whole number")
        data, fresh = bytes(row.data or b""), self.open is None or self.open[0] != row.stream_index or self.open[1] >= CHUNK
        if fresh:
            self.open = [row.stream_index, 0]
        t.add(row.dts, row.pts, row.duration, row.is_key, len(data), self.at, fresh)
        self.file.write(data)
        self.at, self.open[1] = self.at + len(data), self.open[1] + len(data)

    def close(self) -> None:
        scale = math.lcm(*(t.den for t in self.tracks.values()))
        scale = scale if scale < 1 << 32 else max(t.den for t in self.tracks.values())
        for t in self.tracks.values():
            t.close()
        order = sorted(self.tracks)
        longest = max(-(-sum(n * d for n, d in t.stts) * scale // t.den) for t in self.tracks.values())
        head = full("mvhd", 1, 0, struct.pack(">QQIQIHHQ", 0, 0, scale, longest, 0x10000, 0x100, 0, 0), MATRIX, b"\0" * 24, struct.pack(">I", len(order) + 1))
        self.file.write(box("moov", head, *(track_box(i + 1, self.tracks[k], scale) for i, k in enumerate(order))))
        self.file.seek(self.start - 8)
        self.file.write(struct.pack(">Q", self.at - self.start + 16))


sink.FORMATS["mp4"] = (".mp4", Mp4File)


def write(packets: DataFrame, path: str) -> None:
    """A file for each source: source, stream_index, media_type, dts, pts, duration, is_key, tb_num (1), tb_den, data."""
    sink.write(packets, path, "mp4")
