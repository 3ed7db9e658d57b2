import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from sparkreel.llm import quality


def texts_of(n, seed):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choice(["ta", "no", "ri", "el"]) for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(3, 30))) + "." for _ in range(n)]


def symbols(text):
    own = quality.OWN_CLASSES
    return [x for c in text for x in ([ord(c)] if ord(c) < own else [own + ord(c) // own - 1, ord(c) % own])]


def brute_model(texts):
    """log p of a character after four others, by the textbook's recursion."""
    pad = [quality.START] * 4
    seqs = [pad + symbols(t) for t in texts]
    counts = {5: Counter(tuple(s[i : i + 5]) for s in seqs for i in range(len(s) - 4))}
    for k in (4, 3, 2, 1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off = {}
    for k, c in counts.items():
        n = Counter(c.values())
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            off[k] = [min(max(i - (i + 1) * y * n[i + 1] / n[i], 0.05 * i), 0.98 * i) for i in (1, 2, 3)]
        else:
            off[k] = quality.PLAIN
    follow = {k: defaultdict(list) for k in counts}
    for k, c in counts.items():
        for g, n in c.items():
            follow[k][g[:-1]].append(n)

    def p(g):
        if not g:
            return 1 / quality.CLASSES
        k, rest = len(g), p(g[1:])
        ns = follow[k].get(g[:-1])
        if not ns:
            return rest
        n = counts[k].get(g, 0)
        d = off[k]
        return (n - (d[min(n, 3) - 1] if n else 0)) / sum(ns) + sum(d[min(m, 3) - 1] for m in ns) / sum(ns) * rest

    return lambda t: sum(math.log(p(tuple(s[i : i + 5]))) for s in [pad + symbols(t)] for i in range(len(s) - 4))


@pytest.mark.parametrize("shard_rows", [300, 3_000_000])
def test_sums_equal_the_textbook_at_any_number_of_shards(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(quality, "SHARD_ROWS", shard_rows)
    train, new = [*texts_of(60, 1), "汉字漢字 한글 한국 汉字", "ไทย ภาษาไทย 😀"], [*texts_of(10, 2), "xyz 12!", "tano", "é", "", "汉字 漢 글", "한글 ภาษา 😀😁 \U0010ffff"]
    rows = spark.createDataFrame([("aa", t) for t in train], "lang string, text string").repartition(3)
    whole = quality.model(rows)
    docs = spark.createDataFrame([(i, "aa" if i % 2 else "unknown", t) for i, t in enumerate(new)], "k int, lang string, text string")
    got = {r.k: (r.model, r.total, r.n) for r in quality.sums(docs, whole, whole.count()).collect()}
    want = brute_model(train)
    assert set(got) == set(range(len(new)))
    for i, t in enumerate(new):
        assert got[i][0] == "aa" and got[i][2] == len(symbols(t))
        assert abs(got[i][1] - want(t)) < 1e-3 * max(1, len(t)), t


def test_junk_goes_and_clean_text_stays(spark):
    good, rnd = texts_of(200, 3), random.Random(4)
    junk = [" ".join(rnd.choice("#$%&*@") * rnd.randrange(2, 9) for _ in range(20)) for _ in range(20)]
    docs = [*((i, t, "aa", i) for i, t in enumerate(good)), *((1000 + i, t, "aa", i) for i, t in enumerate(junk)), (2000, None, "aa", 0), (2001, " \n", None, 0), (2002, good[0], None, 0), (2003, good[1], "zz", 0), (None, good[2], "aa", 0), (5, good[5], "aa", 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, n long")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200) if i % 2 == 0 or zlib.crc32(str(i).encode()) % 5 == 0], "doc_id long, quality int, toxic int")
    got = quality.classify(frame, labels).collect()
    assert len(got) == len(docs)
    kept = {r.doc_id for r in got if r.kept}
    assert not kept & {*range(1000, 1020), 2000, 2001} and {2002, 2003, None} <= kept
    assert len(kept & set(range(200))) >= 196
    out = quality.accepted(frame, labels)
    assert out.columns == frame.columns and out.count() == sum(r.kept for r in got)


def test_no_trusted_text_and_empty_table(spark):
    frame = spark.createDataFrame([(1, "abc", "aa"), (2, "", "aa")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.kept for r in quality.classify(frame, labels).collect()} == {1: True, 2: False}
    assert quality.classify(frame.limit(0), labels).collect() == []


def test_thresholds_and_what_is_kept_against_brute_force(spark):
    """Each language's quantile over its held-out trusted costs; one with few of them goes by the quantile over all."""
    good = texts_of(400, 7)
    docs = [(i, t, "aa" if i < 300 else "bb" if i < 380 else "cc") for i, t in enumerate(good)] + [(1000 + i, "#$% &*@ " * (i + 1), "bb") for i in range(5)] + [(2000, "汉字" * 9, "cc")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(frame, labels).collect()}
    assert len(got) == len(docs)
    wide = lambda r: quality.SPREAD / math.sqrt(r.n)
    held = defaultdict(list)
    for i in range(400):
        if zlib.crc32(str(i).encode()) % 5 == 0:
            for key in (got[i].model, None):
                held[key].append((math.log(got[i].perplexity) - wide(got[i]), math.log(got[i].perplexity), got[i].n))
    assert len(held["bb"]) < quality.LEAST_HELD <= len(held["aa"])
    for r in got.values():
        costs = sorted(held[r.model] if len(held[r.model]) >= quality.LEAST_HELD else held[None])
        mean = sum(c * n for _, c, n in costs) / sum(n for _, _, n in costs)
        limit = max(costs[math.ceil(quality.QUANTILE * len(costs)) - 1][0], mean) + quality.SLACK + wide(r)
        assert math.log(r.threshold) == pytest.approx(limit, abs=1e-6), r
        assert r.kept == (math.log(r.perplexity) <= math.log(r.threshold)), r
    assert not any(got[1000 + i].kept for i in range(5)) and not got[2000].kept


def test_long_text_clashing_columns_and_string_ids(spark):
    rows = [(str(i), t, "aa", 1, 2.0, "k") for i, t in enumerate(texts_of(120, 5))] + [("long", " ".join(t[:-1] for t in texts_of(2000, 6)), "aa", 1, 2.0, "k")]
    frame = spark.createDataFrame(rows, "doc_id string, text string, lang string, n int, total double, kept string")
    labels = spark.createDataFrame([(str(i), 1, 0) for i in range(120)], "doc_id string, quality int, toxic int")
    out = quality.accepted(frame, labels)
    assert out.columns == frame.columns and "long" in {r.doc_id for r in out.collect()}
