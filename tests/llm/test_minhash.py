"""op12: stars of one-permutation buckets against all pairs."""

import random

import numpy as np
import pytest
from sparkreel.llm import minhash

TYPES = "doc_id long, text string"


def exact(rows):
    """(doc_id, size, component) of each row, by all pairs."""
    sets = []
    for _, text in rows:
        words = "".join(c.lower() if c.isascii() else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
        words = [w for w in words if w]
        sets.append({" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 85 * len(a | sets[j]):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (doc_id, _), x in zip(rows, label, strict=True):
        if doc_id is not None:
            least[x] = min(doc_id, least.get(x, doc_id))
    return sorted(((d, len(s), d if not s else least.get(x)) for (d, _), s, x in zip(rows, sets, label, strict=True)), key=str)


def found(spark, rows, **options):
    out = minhash.classify(spark.createDataFrame(rows, TYPES), **options).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


def corpus(seed, n=40, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        own = rng.choices(vocabulary, k=rng.choice([4, 12, words, 2 * words]))
        texts.append(own)
        for _ in range(rng.choice([0, 1, 3])):
            own = list(own)
            for _ in range(rng.choice([0, 1, 2, 5])):
                at = rng.randrange(len(own))
                own[at : at + rng.choice([0, 1])] = rng.choices(vocabulary, k=rng.choice([0, 1]))
                own = own or ["w0"]
            texts.append(own)
    rng.shuffle(texts)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == exact(rows)
    assert len({c for _, _, c in exact(rows)}) < len(rows)


def test_nulls_blanks_short_and_repeated(spark):
    text = "One two three four five six seven eight nine ten"
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "Ab"), (9, "aB"), (5, "x y"), (6, "x\ty"), (7, "x y"), (8, text), (8, text.upper()), (None, text), (None, None), (10, "É é é"), (11, "é é é")]
    assert found(spark, rows) == exact(rows)
    assert found(spark, [(None, "a b c"), (None, "a b c")]) == [(None, 1, None)] * 2
    assert found(spark, []) == []


def test_a_chain_whose_ends_are_not_alike_is_one_component(spark):
    """A star around one end holds no link to the other: the rest of the bucket is compared too."""
    base = [f"c{i}" for i in range(100)]
    rows = [(i, " ".join(base[3 * i : 3 * i + 70])) for i in range(8)]
    expected = exact(rows)
    assert {c for _, _, c in expected} == {0}
    assert found(spark, rows, block=2) == expected


def test_long_texts_and_other_columns(spark):
    words = [f"w{i % 7919}" for i in range(120_000)]
    rows = [(1, " ".join(words), "x", 0.5), (2, " ".join([*words[:60_000], "new", *words[60_000:]]), "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, _metadata double")
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.classify(docs).collect()}
    assert got == {1: (1, True), 2: (1, False)}


def test_densified_bins_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for n, similarity in [(7, 6 / 7), (40, 0.9), (2000, 0.85)]:
        agree = []
        for _ in range(40):
            union = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2)
            shared = round(n * similarity)
            a = np.sort(np.concatenate([union[:shared], union[shared : shared + (n - shared) // 2]]))
            b = np.sort(np.concatenate([union[:shared], union[shared + (n - shared) // 2 :]]))
            agree.append((minhash.signature(a) == minhash.signature(b)).mean())
        assert abs(np.mean(agree) - similarity) < 0.06
    assert (minhash.signature(np.array([5], np.uint64)) == 5).all()
