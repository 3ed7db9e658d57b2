"""Bare audio streams: the same frames at any split, by headers alone."""

import random

import pytest
from sparkreel.sources import elementary as el


def plain(spark, path, split=el.SPLIT):
    return sorted((r.seq, r.pts, r.duration, r.tb_den, r["size"], r.is_discard) for r in el.packets(spark, str(path), split).collect())


def adts_frame(payload, rate=3, blocks=1, channels=2):
    size = len(payload) + 7
    head = 0xFFF1 << 40 | 1 << 38 | rate << 34 | channels << 30 | size << 13 | 0x7FF << 2 | blocks - 1
    return head.to_bytes(7, "big") + payload


def mpeg_frame(version=3, layer=3, bits=9, code=0, pad=0, fill=b"", rng=None):
    head = bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1 | 1, bits << 4 | code << 2 | pad << 1, 0x44])
    size = el.mpeg(head, 0)[0]
    body = fill + (rng.randbytes(size - 4 - len(fill)) if rng else b"\0" * (size - 4 - len(fill)))
    return head + body


def utf8(n):
    if n < 128:
        return bytes([n])
    parts = []
    while n >= 1 << (6 - len(parts)) if parts else True:
        parts.append(0x80 | n & 0x3F)
        n >>= 6
        if n < 1 << (6 - len(parts)):
            break
    lead = (0xFF << (7 - len(parts))) & 0xFF
    return bytes([lead | n, *reversed(parts)])


def flac_file(rng, frames, block=4096, last=1000, fixed=True, fake=False):
    info = block.to_bytes(2, "big") * 2 + (0).to_bytes(6, "big") + (44100 << 44 | 1 << 41 | 15 << 36 | 0).to_bytes(8, "big") + b"\0" * 16
    data, rows, at = b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info, [], 0
    for i in range(frames):
        n = last if i == frames - 1 else block
        code = 12 if n == 4096 else 7
        head = bytes([0xFF, 0xF8 | (not fixed), code << 4 | 9, 0x18]) + utf8(i if fixed else at) + (b"" if code == 12 else (n - 1).to_bytes(2, "big"))
        head += bytes([el.crc8(head)])
        body = rng.randbytes(rng.randrange(20, 900))
        if fake:  # a right header in the middle of the data, of another frame
            own = bytes([0xFF, 0xF8, 0xC9, 0x18]) + utf8(77 + i * 7919 % 5000)
            body = body[:10] + own + bytes([el.crc8(own)]) + body[10:]
        rows.append((len(data), at, n, 44100, len(head) + len(body), False))
        data, at = data + head + body, at + n
    return data, rows


@pytest.mark.parametrize("split", [61, 5000, 1 << 25])
def test_adts(spark, tmp_path, split):
    rng = random.Random(1)
    data, rows, at = b"ID3\4\0\0\0\0\0\5" + b"\xff\xf1xyz", [], 0
    for i in range(400):
        frame = adts_frame(rng.randbytes(rng.randrange(0, 60)) + (adts_frame(b"") if i % 50 == 7 else b""), blocks=1 + i % 2)
        if i == 200:
            data += b"\xff\xf1 junk that is no frame" * 3
        rows.append((len(data), at, 1024 * (1 + i % 2), 48000, len(frame), False))
        data, at = data + frame, at + 1024 * (1 + i % 2)
    (tmp_path / "a.aac").write_bytes(data + b"TAG" + b"\0" * 125)
    assert plain(spark, tmp_path, split) == rows


@pytest.mark.parametrize(("version", "layer", "samples"), [(3, 3, 1152), (2, 3, 576), (3, 2, 1152), (0, 1, 384)])
def test_mpeg(spark, tmp_path, version, layer, samples):
    rng = random.Random(2)
    index = mpeg_frame(version, layer, fill=b"\0" * (32 if version == 3 else 17) + b"Xing")
    data, rows, at = index, [(0, 0, 0, el.MPEG_RATES[version][0], len(index), True)], 0
    for i in range(150):
        frame = mpeg_frame(version, layer, bits=5 + i % 5, pad=i % 2, rng=rng)
        rows.append((len(data), at, samples, el.MPEG_RATES[version][0], len(frame), False))
        data, at = data + frame, at + samples
    (tmp_path / "a.mp3").write_bytes(data)
    for split in (777, 1 << 25):
        assert plain(spark, tmp_path, split) == rows


@pytest.mark.parametrize("fixed", [True, False])
def test_flac(spark, tmp_path, fixed):
    data, rows = flac_file(random.Random(3), 300, fixed=fixed, fake=fixed)
    (tmp_path / "a.flac").write_bytes(data)
    for split in (999, 1 << 25):
        assert plain(spark, tmp_path, split) == rows


def test_odd_files(spark, tmp_path):
    for name, data in (("a.aac", b""), ("b.mp3", b"\xff" * 500), ("c.flac", b"fLaC"), ("d.flac", b"\0" * 99), ("e.mp3", b"ID3\4\0\0\x7f\x7f\x7f\x7f"), ("f.flac", b"fLaC\x80\0\0\x22" + b"\0" * 34)):
        (tmp_path / name).write_bytes(data)
    assert plain(spark, tmp_path) == []
    (tmp_path / "g.aac").write_bytes(adts_frame(b"abc") + adts_frame(b"abcdef")[:-2])
    assert [r[1:3] for r in plain(spark, tmp_path)] == [(0, 1024), (1024, 1024)]


def test_codes():
    assert [utf8(n) for n in (0, 127)] == [b"\0", b"\x7f"]
    for n in (128, 2047, 2048, 65535, 65536, 1 << 20):
        assert utf8(n) == chr(n).encode("utf-8", "surrogatepass")
    assert el.mpeg(bytes([0xFF, 0xFB, 0x90, 0x44]), 0)[:3] == (417, 1152, 44100)
    assert el.adts(adts_frame(b"abc"), 0)[:3] == (10, 1024, 48000)
