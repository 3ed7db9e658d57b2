"""MP4: packets from sample tables against what was stored, files made by the sink and by hand."""

import struct

import pytest
from sparkreel.schema import PACKETS
from sparkreel.sources import mp4, sink


class Counting:
    """A file that counts what is read of it."""

    def __init__(self, path):
        self.file, self.read_bytes = open(path, "rb"), 0

    def read(self, n=-1):
        data = self.file.read(n)
        self.read_bytes += len(data)
        return data

    def seek(self, *a):
        return self.file.seek(*a)

    def tell(self):
        return self.file.tell()


def plain(rows):
    return sorted((r.stream_index, r.seq, r.pts, r.dts, r.duration, r.is_key, r.is_discard, r.tb_den, r["size"]) for r in rows)


def box(kind, *parts):
    data = b"".join(parts)
    return struct.pack(">I", 8 + len(data)) + kind.encode() + data


def full(kind, version, flags, *parts):
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def movie(tables=(), edits=(), timescale=100, extra=(), handler=b"vide", movie_timescale=1000):
    elst = box("edts", full("elst", 0, 0, struct.pack(">I", len(edits)), *(struct.pack(">IiI", d, m, 0x10000) for d, m in edits))) if edits else b""
    mdhd = full("mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, timescale, 0, 0, 0))
    trak = box("trak", full("tkhd", 0, 7, struct.pack(">III", 0, 0, 7), b"\0" * 68), elst, box("mdia", mdhd, full("hdlr", 0, 0, b"\0" * 4 + handler + b"\0" * 13), box("minf", box("stbl", *tables))))
    return box("moov", full("mvhd", 0, 0, struct.pack(">IIII", 0, 0, movie_timescale, 0), b"\0" * 80), trak, *extra)


def table(kind, form, *rows, version=0):
    return full(kind, version, 0, struct.pack(">I", len(rows)), *(struct.pack(form, *r) for r in rows))


def packets_of(spark, tmp_path, data, name="a.mp4"):
    (tmp_path / name).write_bytes(data)
    return mp4.packets(spark, str(tmp_path / name)).collect()


@pytest.mark.parametrize("off", [0, 30, -20])
def test_what_is_written_is_read(spark, tmp_path, off):
    rows = [(c, s, ("video", "audio")[s], i, i * 10 + i % 4 * 20 + off, i * 10 + off, 10, s == 1 or i % 12 == 0, False, 1, (1000, 600)[s], bytes([i % 256]) * (i % 5)) for c in "ab" for s in (0, 1) for i in range(9000 if c == "a" else 3)]
    sink.write(spark.createDataFrame(rows, PACKETS + ", data binary"), str(tmp_path), "mp4")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.mp4", "b.mp4"]
    found = mp4.packets(spark, str(tmp_path)).collect()
    for c in "ab":
        # what lies before zero is stored, but not shown
        want = sorted((r[1], r[3], r[4], r[5], r[6], r[7], r[4] < 0, r[10], len(r[11])) for r in rows if r[0] == c)
        assert plain(r for r in found if r.source.endswith(f"{c}.mp4")) == want
    heads = {(r.source[-5], r.stream_index): r for r in mp4.streams(spark, str(tmp_path)).collect()}
    assert heads["a", 0].num_frames_from_header == 9000 and heads["a", 0].media_type == "video" and heads["a", 0].duration_seconds_from_header == 90.0


def test_samples_are_not_read(spark, tmp_path):
    rows = [("a", 0, "video", i, i, i, 1, True, False, 1, 25, b"x" * 3000) for i in range(1000)]
    sink.write(spark.createDataFrame(rows, PACKETS + ", data binary"), str(tmp_path), "mp4")
    file = Counting(tmp_path / "a.mp4")
    assert sum(n for _, _, kind, _, _, _, n, _, _ in mp4.file_runs(file, "a") if kind == "stts") == 1000
    assert file.read_bytes < 6000 < 3_000_000 < (tmp_path / "a.mp4").stat().st_size
    assert b"".join(r[11] for r in rows) in (tmp_path / "a.mp4").read_bytes()


def test_runs_longer_than_blocks_and_constant_sizes(spark, tmp_path):
    n = 3 * mp4.BLOCK + 17
    data = movie([table("stts", ">II", (n - 1, 2), (1, 5)), table("ctts", ">II", (mp4.BLOCK + 1, 4), (5, 1)), full("stsz", 0, 0, struct.pack(">II", 9, n)), table("stss", ">I", (1,), (mp4.BLOCK + 1,), (mp4.BLOCK + 2,), (n,))])
    found = sorted(packets_of(spark, tmp_path, data), key=lambda r: r.seq)
    offsets = [4] * (mp4.BLOCK + 1) + [1] * 5 + [0] * (n - mp4.BLOCK - 6)
    assert [(r.seq, r.dts, r.pts, r.duration, r["size"]) for r in found] == [(i, 2 * i, 2 * i + offsets[i], 5 if i == n - 1 else 2, 9) for i in range(n)]
    assert [r.seq for r in found if r.is_key] == [0, mp4.BLOCK, mp4.BLOCK + 1, n - 1]


def test_edits(spark, tmp_path):
    tables = [table("stts", ">II", (10, 10)), full("stsz", 0, 0, struct.pack(">II", 1, 10))]
    shifted = sorted(packets_of(spark, tmp_path, movie(tables, [(500, -1), (600, 20)])), key=lambda r: r.seq)  # waits 50 ticks, then shows 60 from 20 on
    assert [(r.pts, r.is_discard) for r in shifted] == [(10 * i + 30, not 20 <= 10 * i < 80) for i in range(10)]
    twice = packets_of(spark, tmp_path, movie(tables, [(300, 0), (200, 10)]), "b.mp4")
    assert sorted((r.pts, r.seq) for r in twice if not r.is_discard) == [(0, 0), (10, 1), (20, 2), (30, 1), (40, 2)]
    assert all(r.is_key for r in twice)


def fragment(base, fields, flags, track=7, defaults=b"", bits=0, first=b""):
    tfdt = [] if base is None else [full("tfdt", 1, 0, struct.pack(">Q", base))]
    return box("moof", full("mfhd", 0, 0, b"\0\0\0\1"), box("traf", full("tfhd", 0, bits, struct.pack(">I", track), defaults), *tfdt, full("trun", 1, flags, struct.pack(">I", len(fields)), first, *(struct.pack(">" + "I" * len(f), *f) for f in fields)))) + box("mdat", b"zz")


def test_fragments(spark, tmp_path):
    trex = box("mvex", full("trex", 0, 0, struct.pack(">IIIII", 7, 1, 5, 3, mp4.NOT_SYNC)))
    data = movie(extra=[trex]) + fragment(1000, [(7, 11), (8, 12)], mp4.RUN_DURATION | mp4.RUN_SIZE | mp4.FIRST_FLAGS, first=struct.pack(">I", 0))
    data += fragment(None, [(20,), (30,)], mp4.RUN_OFFSET) + fragment(2000, [()] * 3, 0, defaults=struct.pack(">I", 9), bits=mp4.DURATION) + fragment(5, [()], 0, track=99)
    found = sorted(packets_of(spark, tmp_path, data), key=lambda r: r.seq)
    assert [(r.seq, r.dts, r.pts, r.duration, r["size"], r.is_key) for r in found] == [
        (0, 1000, 1000, 7, 11, True), (1, 1007, 1007, 8, 12, False), (2, 1015, 1035, 5, 3, False), (3, 1020, 1050, 5, 3, False),
        (4, 2000, 2000, 9, 3, False), (5, 2009, 2009, 9, 3, False), (6, 2018, 2018, 9, 3, False),
    ]


def test_odd_files(spark, tmp_path):
    good = movie([table("stts", ">II", (4, 1)), full("stsz", 0, 0, struct.pack(">II", 1, 4))])
    assert packets_of(spark, tmp_path, b"") == []
    assert packets_of(spark, tmp_path, b"no boxes at all") == []
    assert packets_of(spark, tmp_path, movie()) == []
    wide = struct.pack(">I4sQ", 1, b"mdat", 16 + 5) + b"12345" + good
    assert len(packets_of(spark, tmp_path, wide)) == 4
    cut = movie([table("stts", ">II", (4, 1), (4, 1))[:-8]])
    assert len(packets_of(spark, tmp_path, cut)) in (0, 4)
    assert len(packets_of(spark, tmp_path, good[: len(good) - 3])) >= 0


def test_packets_that_dont_fit_are_refused(spark, tmp_path):
    rows = [("a", 0, "video", i, t, t, 1, True, False, 1, 25, b"") for i, t in enumerate([0, 1 << 33])]
    with pytest.raises(Exception, match="32 bits"):
        sink.write(spark.createDataFrame(rows, PACKETS + ", data binary"), str(tmp_path), "mp4")
    with pytest.raises(ValueError, match="none of"):
        sink.write(spark.createDataFrame(rows, PACKETS + ", data binary"), str(tmp_path), "avi")
