import random
from itertools import combinations

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkreel.llm import simhash

WORDS = ["ada", "bo", "cle", "dor", "É", "fin", "gau", "hiM", "i", "jot"]


def brute_print(text):
    words = simhash.words_of(text)
    if not words:
        return 0
    n = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + n]), 42) for i in range(len(words) - n + 1)]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hs) > len(hs))


def brute_components(prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def corpus():
    rnd = random.Random(5)
    texts = [" ".join(rnd.choice(WORDS) for _ in range(rnd.choice([0, 1, 2, 3, 8, 200]))) for _ in range(60)]
    for t in list(texts[:40]):
        w = t.split()
        if w:
            w[rnd.randrange(len(w))] = "changed"
        texts += [" ".join(w), t.upper(), "  " + t.replace(" ", "\t")]
    return [*texts, None, "", " \n "]


def test_query_against_brute_force(spark):
    texts = corpus()
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, component_id long").repartition(5)
    got = {r.doc_id: (r.node % (1 << 64), r.component_id) for r in simhash.classify(rows).collect()}
    prints = [brute_print(t) for t in texts]
    assert got == {i: (p, c) for i, (p, c) in enumerate(zip(prints, brute_components(prints), strict=True))}


def found_components(spark, nodes, distance, block=simhash.BLOCK):
    """nodes: numbers without a sign."""
    frame = spark.createDataFrame([(n - (n >> 63 << 64),) for n in nodes], "node long")
    return {r.node % (1 << 64): r.root % (1 << 64) for r in simhash.components(frame, distance, block).collect()}


def test_thousands_of_fingerprints_that_share_all_segments(spark):
    """5,000 near copies of one text: their fingerprints crowd round one, in islands of which some touch."""
    rnd = random.Random(9)
    nodes = sorted({sum(1 << x for x in rnd.sample(range(64), rnd.choice([1, 2, 3, 3, 4, 4, 4, 5]))) for _ in range(5000)})
    masks = [sum(1 << x for x in c) for n in (1, 2) for c in combinations(range(64), n)]
    known, root = set(nodes), {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for n in nodes:
        for m in masks:
            if n ^ m in known:
                a, b = find(n), find(n ^ m)
                root[max(a, b)] = min(a, b)
    got = found_components(spark, nodes, 2, 64)
    groups = lambda of: {frozenset(v) for v in by(of).values()}
    assert groups(got) == groups({n: find(n) for n in nodes})


def by(of):
    out = {}
    for k, v in of.items():
        out.setdefault(v, []).append(k)
    return out


def test_distances_that_segments_do_not_cover(spark):
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "node long"), 4)


@pytest.mark.parametrize("block", [3, 1024])
def test_links_find_every_pair_at_any_block(spark, block):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(12)]
    nodes = set(base)
    for b in base[:3]:
        for _ in range(25):
            nodes.add(b ^ sum(1 << x for x in rnd.sample(range(64), rnd.choice([1, 2, 2, 3, 4]))))
    nodes = sorted(nodes)
    got = found_components(spark, nodes, 2, block)
    want = brute_components(nodes)
    groups = lambda of: {frozenset(k for k in of if of[k] == v) for v in of.values()}
    assert groups(got) == groups({n: nodes[w] for n, w in zip(nodes, want, strict=True)})


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.classify(empty).collect() == []
    rows = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "x y")], "doc_id long, text string")
    got = sorted((r.component_id for r in simhash.classify(rows).collect()), key=str)
    assert got == [4, 4, 4, None]


def test_near_dedup_keeps_one_of_each_group(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    docs, near = [], []
    for i in range(30):
        w = [word() for _ in range(300)]
        docs.append((i, " ".join(w), "en", i))
        for k in range(3):
            v = list(w)
            for at in rnd.sample(range(300), 3):
                v[at] = word()
            near.append((100 + 3 * i + k, " ".join(v), "en", i))
    frame = spark.createDataFrame([*docs, *near, (900, None, None, 0), (901, "", "x", 0)], "doc_id long, text string, lang string, __llm_x long")
    out = simhash.near_dedup(frame)
    assert out.columns == frame.columns
    kept = {r.doc_id for r in out.collect()}
    assert {i for i in range(30)} <= kept and 900 in kept and 901 not in kept
    assert len(kept) <= 33
    assert simhash.near_dedup(frame.limit(0)).collect() == []


def shingles(words):
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def block_edits(rnd, n):
    """Pairs of texts of similarity 0.8 to 0.9: a passage added, cut or replaced in one block."""
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    out = []
    while len(out) < n:
        a = [word() for _ in range(rnd.randrange(60, 300))]
        at, m = rnd.randrange(len(a)), rnd.randrange(1, len(a) // 5)
        new = [word() for _ in range(m)]
        b = [a + new, a[:at] + a[at + m :], a[:at] + new + a[at + m :]][len(out) % 3]
        x, y = shingles(a), shingles(b)
        if 5 * len(x & y) >= 4 * len(x | y) and 10 * len(x & y) < 9 * len(x | y):
            out.append((a, b))
    return out


def test_near_dedup_meets_block_edits(spark):
    pairs = block_edits(random.Random(3), 150)
    far = [(a, a[: len(a) * 7 // 10]) for a, _ in block_edits(random.Random(4), 50)]
    rows = [(2 * i + j, " ".join(p[j])) for i, p in enumerate(pairs + far) for j in (0, 1)]
    kept = {r.doc_id for r in simhash.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    missed = [i for i in range(len(pairs)) if 2 * i + 1 in kept]
    assert len(missed) <= 2, len(missed)
    # similarity 0.7: compared exactly, so never taken for near
    assert all(2 * i + j in kept for i in range(len(pairs), len(pairs) + len(far)) for j in (0, 1))


def test_near_dedup_is_the_same_at_any_block(spark):
    """Chains of windows that move on: neighbours are near, the ends and the bucket's first aren't; buckets are hot at block=4."""
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    chains = [[word() for _ in range(400)] for _ in range(3)]
    texts = [w[at : at + 120] for w in chains for at in range(0, 280, 9)]
    rnd.shuffle(texts)
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    sets, root = [shingles(w) for w in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    for block in (4, simhash.BLOCK):
        assert {r.doc_id for r in simhash.near_dedup(frame, block=block).collect()} == set(root)


def test_near_dedup_joins_by_fingerprints(spark, monkeypatch):
    """Without bands, what lies within two bits and is alike goes, and nothing else: fingerprints and their variants do work of their own."""
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    texts = []
    for _ in range(12):
        w = [word() for _ in range(1500)]
        for at in (None, 3, 700, 1499):
            texts.append([x if i != at else word() for i, x in enumerate(w)])
    sets = [shingles(w) for w in texts]
    prints = [simhash.majority([simhash.shingle_set(" ".join(w))]) % (1 << 64) for w in texts]
    met = [(i, j) for i, j in combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    assert len(met) >= 12
    monkeypatch.setattr(simhash, "band_keys", lambda nodes: nodes.select("node", "k", F.lit(0).cast("long").alias("key")).limit(0))
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_dedup(frame).collect()}
    gone = set(range(len(texts))) - kept
    assert gone and gone <= {j for _, j in met}
    assert len(gone) >= len({j for _, j in met}) - 2  # a forest's link may lie just below the similarity
