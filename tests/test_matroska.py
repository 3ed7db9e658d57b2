"""Matroska: packets of split files against what was stored."""

import pytest
from sparkreel.schema import PACKETS
from sparkreel.sources import matroska as mkv
from sparkreel.sources import sink


def stored(spark, tmp_path, rows):
    sink.write(spark.createDataFrame(rows, PACKETS + ", data binary"), str(tmp_path), "matroska")


def plain(found):
    return sorted((r.stream_index, r.pts, r.duration, r.is_key, r["size"], r.media_type) for r in found.collect())


MARK = mkv.CLUSTER.to_bytes(4, "big")


@pytest.mark.parametrize("split", [1 << 9, 4001, 1 << 26])
def test_any_split_gives_the_same(spark, tmp_path, split):
    # payloads that hold a cluster's identifier, and one that looks like a cluster
    fake = MARK + mkv.written(mkv.TIMESTAMP, b"\1")
    rows = [("a", s, ("video", "audio")[s], i, i * 40 + i % 3 * 80, i * 40, 40, s == 1 or i % 25 == 0, False, 1, 1000, [b"", b"x" * 300, MARK + MARK, fake][i % 4]) for s in (0, 1) for i in range(1500)]
    stored(spark, tmp_path, rows)
    found = mkv.packets(spark, str(tmp_path), split=split)
    assert plain(found) == sorted((r[1], r[4], 40, r[7], len(r[11]), r[2]) for r in rows)
    assert found.select("source", "seq").distinct().count() == len(rows)
    heads = sorted((r.stream_index, r.media_type, r.duration_seconds_from_header) for r in mkv.streams(spark, str(tmp_path)).collect())
    assert [h[:2] for h in heads] == [(0, "video"), (1, "audio")] and heads[0][2] == max(r[4] + 40 for r in rows) / 1000


def test_cues_tell_which_splits_hold_a_range(spark, tmp_path):
    rows = [("a", 0, "video", i, i * 1000, i * 1000, 1000, i % 10 == 0, False, 1, 1000, b"y" * 2000) for i in range(2000)]
    stored(spark, tmp_path, rows)
    found = mkv.packets(spark, str(tmp_path), between=(500.0, 530.0), split=1 << 15)
    assert sorted(r.pts for r in found.collect()) == list(range(500_000, 530_000, 1000))
    assert [r.pts for r in mkv.cues(spark, str(tmp_path)).orderBy("pts").collect()] == list(range(0, 2_000_000, 10_000))

    class Counting:
        def __init__(self, file):
            self.file, self.n = file, 0
            self.seek, self.tell = file.seek, file.tell

        def read(self, n):
            self.n += n
            return self.file.read(n)

    path = str(tmp_path / "a.mkv")
    with open(path, "rb") as f:
        size = mkv.files.length_of(f)
        f.seek(0)
        counting = Counting(f)
        assert sum(1 for _ in mkv.split_rows(counting, path, size, 0, size)) == 2000
        assert counting.n < size


def head(tracks, scale=1_000_000):
    entries = [mkv.written(mkv.ENTRY, mkv.uint(mkv.NUMBER, n), mkv.uint(mkv.KIND, kind), *([mkv.uint(mkv.DEFAULT, d)] if d else [])) for n, kind, d in tracks]
    return mkv.written(mkv.INFO, mkv.uint(mkv.SCALE, scale)) + mkv.written(mkv.TRACKS, *entries)


def simple(track, time, flags, payload):
    return mkv.written(mkv.SIMPLE_BLOCK, bytes([0x80 | track]) + time.to_bytes(2, "big", signed=True) + bytes([flags]) + payload)


def unknown(kind, *parts):
    return kind.to_bytes(4, "big") + b"\xff" + b"".join(parts)


def test_lacing_unknown_sizes_and_other_elements(spark, tmp_path):
    ebml = mkv.written(mkv.EBML, b"")
    fixed = simple(1, 5, 0x84, bytes([2]) + b"abcdef")
    xiph = simple(2, -3, 0x82, bytes([2, 255, 1, 2]) + b"x" * 256 + b"yy" + b"zzz")
    signed = simple(2, 0, 0x06, bytes([2]) + bytes([0x80 | 4]) + bytes([0x80 | (63 - 1)]) + b"x" * 4 + b"y" * 3 + b"z")
    first = unknown(mkv.CLUSTER, mkv.uint(mkv.TIMESTAMP, 100), fixed, xiph)
    second = mkv.written(mkv.CLUSTER, mkv.uint(mkv.TIMESTAMP, 200), mkv.written(mkv.VOID, b"1234"), signed, simple(9, 0, 0x80, b"none"))
    for name, segment in (("a.mkv", unknown(mkv.SEGMENT, head([(1, 1, 0), (2, 2, 20_000_000)]), first, second, mkv.written(mkv.TAGS, b"t"))),):
        (tmp_path / name).write_bytes(ebml + segment)
    got = sorted((r.stream_index, r.pts, r.duration, r.is_key, r["size"]) for r in mkv.packets(spark, str(tmp_path)).collect())
    assert got == [(0, 105, 0, True, 2)] * 3 + [(1, 97, 20, True, 256), (1, 117, 20, True, 2), (1, 137, 20, True, 3), (1, 200, 20, False, 4), (1, 220, 20, False, 3), (1, 240, 20, False, 1)]


def test_odd_files(spark, tmp_path):
    for name, data in (("a.mkv", b""), ("b.mkv", b"\0" * 100), ("c.mkv", mkv.written(mkv.EBML, b"")), ("d.mkv", mkv.written(mkv.EBML, b"") + mkv.written(mkv.SEGMENT, head([(1, 1, 0)])))):
        (tmp_path / name).write_bytes(data)
    assert mkv.packets(spark, str(tmp_path)).count() == 0
    assert mkv.packets(spark, str(tmp_path), between=(0, 9)).count() == 0
    whole = mkv.written(mkv.EBML, b"") + mkv.written(mkv.SEGMENT, head([(1, 1, 0)]), mkv.written(mkv.CLUSTER, mkv.uint(mkv.TIMESTAMP, 0), simple(1, 0, 0x80, b"abc"), simple(1, 9, 0x80, b"abcdef")))
    (tmp_path / "e.mkv").write_bytes(whole[:-3])
    assert mkv.packets(spark, str(tmp_path)).count() <= 2
    with pytest.raises(Exception, match="time base"):
        stored(spark, tmp_path, [("z", 0, "video", 0, 0, 0, 1, True, False, 1, 3, b"")])
