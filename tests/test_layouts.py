"""Channel layouts, pixel formats and filters of scaling."""

import duckdb
import numpy as np
import pytest
from sparkreel.operators import audio, layouts, payload
from sparkreel.plans import catalogue

HALF = 0.5**0.5


def test_known_matrices():
    assert layouts.matrix("stereo", "mono") == ((0.5, 0.5),)
    assert layouts.matrix("mono", "stereo") == ((HALF,), (HALF,))
    full = 1 + 2 * HALF
    left, right = layouts.matrix("5.1(side)", "stereo")
    assert np.allclose(left, np.array([1, 0, HALF, 0, HALF, 0]) / full) and np.allclose(right, np.array([0, 1, HALF, 0, 0, HALF]) / full)
    assert layouts.matrix("5.1", "5.1(side)") == tuple(tuple(float(i == j) for j in range(6)) for i in range(6))
    for a in layouts.LAYOUTS:
        assert np.array_equal(layouts.matrix(a, a), np.eye(len(layouts.speakers(a))))
        for b in layouts.LAYOUTS:
            m = np.array(layouts.matrix(a, b))
            assert m.shape == (len(layouts.speakers(b)), len(layouts.speakers(a))) and m.sum(1).max() <= 1 + 1e-9 and (m >= 0).all()
            lost = {layouts.LFE} if not layouts.mask_of(b) & layouts.LFE else set()
            assert all(m[:, i].any() for i, s in enumerate(layouts.speakers(a)) if s not in lost)
    for bad in ("9.9", 0, 1 << 11, True, None):
        with pytest.raises(ValueError):
            layouts.mask_of(bad)


def test_mixed_by_spark(spark):
    rng = np.random.default_rng(1)
    x = rng.random((6, 5))
    frames = spark.createDataFrame([(1, x.tolist()), (2, [[] for _ in range(6)]), (3, None)], "k int, data array<array<double>>")
    for target in ("stereo", "mono", "7.1", layouts.FL | layouts.FR | layouts.FC):
        got = {r.k: r.data for r in audio.mixed(frames, "5.1", target).collect()}
        assert np.allclose(got[1], payload.mix(x, "5.1", target)) and got[2] == [[]] * len(layouts.speakers(target)) and got[3] is None
    with pytest.raises(Exception, match="has 2 channels, not 6"):
        audio.mixed(frames, "stereo", "mono").collect()
    six = audio.remixed(frames.filter("k = 1"), 2).head().data
    assert np.allclose(six, payload.remix(x, 2)) and not np.allclose(six, x[:2])


def test_downmix_equals_its_sql_bit_for_bit(spark, tmp_path):
    """Zeros keep their sign, ties round as the SQL's do, and short or missing vectors give ten nulls."""
    h = float(np.float32(0.5))
    tiny = [[-1e-7 if i % 2 else 2.5e-6 * i for i in range(64)], [h * 1e-6 * i for i in range(64)], [0.1] * 52, None, [None, *[0.25] * 63], [float("nan"), float("inf"), *[1.0] * 62]]
    rows = [*tiny, *np.random.default_rng(3).normal(size=(3000, 64)).astype(np.float32).tolist()]
    spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<float>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {k: repr((left, right)) for k, left, right in con.execute(catalogue.SQL["audio_downmix"]).fetchall()}
    assert {r.vec_id: repr((r.l, r.r)) for r in catalogue.QUERIES["audio_downmix"](spark, str(tmp_path)).collect()} == want


@pytest.mark.parametrize("size", [(4, 6), (5, 7)])
@pytest.mark.parametrize("format", payload.FORMATS)
def test_formats_round_trip(format, size):
    h, w = size
    rng = np.random.default_rng(2)
    top = 1 << payload.FORMATS[format][2]
    y, u, v = (rng.integers(0, top, s) for s in (size, payload.chroma_size(h, w, format), payload.chroma_size(h, w, format)))
    data = payload.pack(y, u, v, format)
    assert len(data) == payload.picture_bytes(h, w, format)
    assert all(np.array_equal(a, b) for a, b in zip(payload.unpack(data, h, w, format), (y, u, v), strict=True))
    flat = np.tile(np.array([200, 60, 90], np.uint8), (h, w, 1))
    assert np.abs(payload.yuv_to_rgb(payload.rgb_to_yuv(flat, format=format), h, w, format=format).astype(int) - flat).max() <= 2
    with pytest.raises(ValueError, match="expected"):
        payload.unpack(data[1:], h, w, format)


def test_a_format_of_frames(spark):
    picture = np.tile(np.array([30, 140, 220], np.uint8), (4, 4, 1))
    rows = [((4, 4, 1), payload.rgb_to_yuv(picture, "bt709", True, "p010le"))]
    frames = spark.createDataFrame(rows, "shape struct<h:int,w:int,c:int>, data binary")
    got = payload.converted(frames, "bt709", True, "p010le").head()
    assert got.shape["c"] == 3 and np.abs(np.frombuffer(got.data, np.uint8).reshape(4, 4, 3).astype(int) - picture).max() <= 1
    with pytest.raises(ValueError, match="pixels are"):
        payload.converted(frames, format="rgb48")


def test_a_fine_checkerboard_reduced_is_grey():
    board = (np.indices((64, 64)).sum(0) % 2 * 255).astype(np.uint8)[..., None].repeat(3, 2)
    small = payload.resize_bilinear(board, 16, 8)
    # at the edges the outermost pixels stand for what isn't there
    assert np.abs(small[1:-1, 1:-1].astype(int) - 127).max() <= 1 and np.abs(small.astype(int) - 127).max() <= 4
    odd = payload.resize_bilinear(board, 21, 13)
    assert np.abs(odd.astype(int) - 127).max() <= 12
    ramp = np.arange(60, dtype=np.uint8)[None, :, None].repeat(3, 0).repeat(3, 2)
    assert np.abs(payload.resize_bilinear(ramp, 3, 20)[0, 1:-1, 0].astype(int) - (np.arange(20)[1:-1] * 3 + 1)).max() <= 1
    assert payload.bank(60, 20) is payload.bank(60, 20)
