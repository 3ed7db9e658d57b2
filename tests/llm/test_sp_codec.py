import random

import numpy as np
import pytest

from sparkreel.llm import sp_codec, token_counts

ALPHABET = ["a", "b", " ", "  ", "é", "\n", "世", "😀", "the", "ing", " t", "\t", "0", "tion", "   ", "\0", "representation", " international"]


@pytest.fixture(scope="module")
def encoder():
    return sp_codec.encoder_of(token_counts.model_bytes())


def texts(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(n)]


def test_ids_equal_the_library(encoder):
    x = [*texts(2000, 1), "▁a▁▁b", "a" * 5000, "", " ", "\n\n"]
    assert [i.tolist() for i in encoder.encode(x)] == encoder.model.sp.encode(x)


def test_many_distinct_characters(encoder):
    x = ["".join(chr(c) for c in range(0x4E00 + k, 0x4E00 + k + 700)) for k in (0, 400)] + ["".join(map(chr, range(1, 700)))]
    assert [i.tolist() for i in encoder.encode(x)] == encoder.model.sp.encode(x)


def test_round_trip(encoder):
    machine, x = sp_codec.Decoder(encoder.model), texts(500, 2)
    assert [machine.decode(i.tolist()) for i in encoder.encode(x)] == x


def test_pair_table_is_bounded(encoder):
    small = sp_codec.PairTable(encoder.model)
    
    a, b = np.array(sorted(encoder.model.pieces))[300:420], np.array(sorted(encoder.model.pieces))[500:620]
    want = [encoder.model.stable(int(p), int(q)) for p, q in zip(a, b, strict=True)]
    assert small.stable(a, b).tolist() == want == small.stable(a, b).tolist()
    small.used = small.SLOTS // 2
    assert small.stable(b, a).tolist() == [encoder.model.stable(int(p), int(q)) for p, q in zip(b, a, strict=True)] and small.used <= 120


def test_frames(spark):
    rows = spark.createDataFrame([(1, "Hello  world", "x"), (1, None, None), (None, "", "y"), (4, "z " * 9000, "")], "doc_id long, text string, ids_of string")
    ids = sp_codec.encode(rows)
    assert ids.columns == ["doc_id", "ids_of", "ids"]
    assert [len(r.ids) for r in ids.collect()][:3] == [3, 0, 0]
    assert [r.text for r in sp_codec.decode(ids).collect()] == ["Hello  world", "", "", "z " * 9000]
    assert sp_codec.encode(rows.limit(0)).collect() == []


def test_round_trip_column(spark):
    rows = spark.createDataFrame([(1, "Hello  world"), (2, None), (3, "a▁b"), (4, "é😀")], "doc_id long, text string").coalesce(1)
    out = sp_codec.encode(rows, to="t", round_trip="back")
    assert out.columns == ["doc_id", "t", "back"]
    assert [r.back for r in out.collect()] == [True, True, False, True]
