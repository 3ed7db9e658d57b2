import random

import pytest

from sparkreel.llm import bpe, token_counts

ALPHABET = ["a", "b", " ", "  ", "é", "\n", "▁", "世", "😀", "the", "ing", " t", "\t", "0", "tion", "   ", " ", "%"]


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter_of(token_counts.model_bytes())


def texts(n, seed=0):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40))) for _ in range(n)]


@pytest.mark.parametrize("chunk", [1, 3, 7, 1 << 16])
def test_counts_equal_the_library_at_any_chunk(counter, chunk):
    for x in texts(800, chunk):
        assert bpe.count_tokens(x, counter, chunk) == len(counter.model.sp.encode(x)), repr(x)


def test_chunk_maps_compose_in_any_grouping(counter):
    for x in texts(300, 9):
        s = bpe.SPACE + x.replace(" ", bpe.SPACE)
        maps = [bpe.chunk_map(s[i : i + 4], counter) for i in range(0, len(s), 4)]
        left = maps[0]
        for m in maps[1:]:
            left = left.then(m, counter)
        right = maps[-1]
        for m in maps[-2::-1]:
            right = m.then(right, counter)
        assert left.total(counter) == right.total(counter) == bpe.scan(maps, counter).total(counter)


def test_tables_are_bounded(counter):
    small = bpe.Counter(counter.model)
    small.STATES, small.WORDS = 20, 5
    for x in texts(100, 3):
        assert bpe.count_tokens(x, small) == len(counter.model.sp.encode(x))
    assert len(small.words) <= 7


def test_merge_equals_the_library(counter):
    m = counter.model
    for x in texts(300, 4):
        if x:
            s = bpe.SPACE + x.replace(" ", bpe.SPACE)
            assert m.ids_of(m.merge(list(s))) == m.sp.encode(x)


def test_report(spark):
    rows = spark.createDataFrame([(1, "Hello  world", 7), (2, None, 8), (None, "", 9), (1, "x " * 5000, 7)], "doc_id long, text string, n_tokens_old long")
    got = token_counts.report(rows).collect()
    assert [(r.doc_id, r.n_bytes, r.over_limit) for r in got] == [(1, 12, False), (2, 0, False), (None, 0, False), (1, 10000, True)]
    assert [r.n_tokens for r in got][:3] == [3, 0, 0]
    assert token_counts.count(rows, to="n").columns == ["doc_id", "n_tokens_old", "n"]
    assert token_counts.report(rows.limit(0)).collect() == []
