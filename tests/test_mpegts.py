"""Transport streams: the same packets at any split, across wraps, junk and headers in pieces."""

import pytest
from sparkreel.schema import PACKETS
from sparkreel.sources import mpegts as ts
from sparkreel.sources import sink

BEGIN = ts.WRAP - 1_000_000


def stored(spark, tmp_path, n=600, step=300_000_000):
    """Two streams, whose times wrap several times."""
    rows = [("a", s, ("video", "audio")[s], i, BEGIN + i * step + i % 3 * 3000, BEGIN + i * step, 0, s == 1 or i % 12 == 0, False, 1, 90_000, bytes([ts.SYNC]) * (i * 37 % 900)) for s in (0, 1) for i in range(n)]
    sink.write(spark.createDataFrame(rows, PACKETS + ", data binary"), str(tmp_path), "mpegts")
    want = sorted((r[1], r[4], r[5], step if r[3] < n - 1 else 0, r[7], r[2]) for r in rows)
    return tmp_path / "a.ts", want


def plain(found):
    return sorted((r.stream_index, r.pts, r.dts, r.duration, r.is_key, r.media_type) for r in found.collect())


@pytest.mark.parametrize("split", [1009, 18_800, 1 << 26])
def test_any_split_gives_the_same(spark, tmp_path, split):
    path, want = stored(spark, tmp_path)
    assert path.stat().st_size % ts.SIZE == 0
    assert plain(ts.packets(spark, str(path), split)) == want


@pytest.mark.parametrize("split", [5000, 1 << 26])
def test_sync_is_found_again(spark, tmp_path, split):
    path, want = stored(spark, tmp_path, 200)
    data = path.read_bytes()
    at = len(data) // ts.SIZE // 2 * ts.SIZE
    path.write_bytes(b"junk" * 5 + data[:at] + b"\x47" * 3 + b"\0" * 100 + data[at:] + b"\x47tail")
    assert plain(ts.packets(spark, str(path), split)) == want


def packet(pid, payload, start=False, field=None, count=0, scrambled=0):
    room = 184 - (0 if field is None else 1 + len(field))
    assert len(payload) <= room
    if field is None and len(payload) < 184:
        field = b"\0" + b"\xff" * (182 - len(payload)) if len(payload) < 183 else b""
    elif field is not None:
        field = field + b"\xff" * (room - len(payload))
    head = bytes([ts.SYNC, (0x40 if start else 0) | pid >> 8, pid & 0xFF, scrambled << 6 | (0x30 if field is not None else 0x10) | count])
    out = head + (b"" if field is None else bytes([len(field)]) + field) + payload
    assert len(out) == ts.SIZE
    return out


def tables(*streams):
    body = b"".join(bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + b"\xf0\3abc" for pid, kind in streams)
    return ts.table_packets(0, 0, b"\0\1\xc1\0\0\0\1\xf0\0", 1) + ts.table_packets(0x1000, 2, b"\0\1\xc1\0\0\xe1\0\xf0\2xy" + body, 3)


def pes(pts=None, dts=None, stream=0xE0):
    stamps = b"" if pts is None else ts.stamped(3 if dts is not None else 2, pts) + (b"" if dts is None else ts.stamped(1, dts))
    return b"\0\0\1" + bytes([stream]) + b"\0\0" + bytes([0x80, 0 if pts is None else 0xC0 if dts is not None else 0x80, len(stamps)]) + stamps


@pytest.mark.parametrize("split", [188, 200, 1 << 26])
def test_headers_in_pieces_and_packets_without_times(spark, tmp_path, split):
    whole = pes(5000, 2000)
    data = tables((0x101, 0x1B), (0x102, 0x06)) + b"".join([
        packet(0x101, whole[:4], True, b"\x40"), packet(0x102, pes(100) + b"x" * 30, True), packet(0x1FFF, b""), packet(0x101, whole[4:11]), packet(0x101, whole[11:] + b"data"),
        packet(0x101, pes() + b"no time " * 5, True), packet(0x101, pes(9000) + b"y" * 9, True, scrambled=2), packet(0x101, pes(8000) + b"z" * 9, True), packet(0x102, pes(400, stream=0xBE) + b"w" * 30, True), packet(0x555, pes(1), True),
    ])
    (tmp_path / "a.ts").write_bytes(data)
    found = ts.packets(spark, str(tmp_path), split).orderBy("seq").collect()
    assert [(r.stream_index, r.pts, r.dts, r.duration, r.is_key, r.is_discard) for r in found] == [
        (0, 5000, 2000, 6000, True, False), (1, 100, 100, 0, False, False), (0, None, None, 0, False, True), (0, 8000, 8000, 0, False, False), (1, None, None, 0, False, True),
    ]
    assert [r.media_type for r in found[:2]] == ["video", "other"]


def test_odd_files(spark, tmp_path):
    for name, data in (("a.ts", b""), ("b.ts", b"\x47" * 1000), ("c.ts", b"\0" * 1000), ("d.ts", tables((0x101, 0x1B))), ("e.ts", tables((0x101, 0x1B))[:-100])):
        (tmp_path / name).write_bytes(data)
    assert ts.packets(spark, str(tmp_path)).count() == 0
