"""op13: radix selection against sorting all scores."""

import math
import random

import pytest
from sparkreel.llm import hard_negatives

TYPES = "vec_id long, embedding array<float>, label int"


def exact(rows, every=50, positives=5, negatives=3, least=50, most=95):
    kept = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if vec_id is not None and vec_id % 7 == 0:
            label = (label + 1) % 10
        kept.append((vec_id, [math.floor(256 * x) for x in v], label))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, (a, v, label) in enumerate(kept):
        if a is None or a % every:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=False)), b, m == label) for j, (b, w, m) in enumerate(kept) if j != i]
        for ps, p, _ in sorted((s for s in scores if s[2]), key=order)[:positives]:
            fits = sorted((s for s in scores if not s[2] and least * ps <= 100 * s[0] <= most * ps), key=order)[:negatives]
            out += [(a, p, rank, b, ps, ns) for rank, (ns, b, _) in enumerate(fits, 1)]
    return sorted(out, key=str)


def found(spark, rows, types=TYPES, **options):
    got = hard_negatives.mine(spark.createDataFrame(rows, types), **options).collect()
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got), key=str)


def quarters(seed, n, dims, top=8):
    """Vectors of quarters, exact as floats; many tie."""
    rng = random.Random(seed)
    return [(i, [rng.randrange(-top, top) / 4 for _ in range(dims)], rng.randrange(3)) for i in range(n)]


@pytest.mark.parametrize(("digit", "block", "anchors"), [(12, 4096, 2048), (3, 16, 2)])
def test_equals_sorting(spark, monkeypatch, digit, block, anchors):
    monkeypatch.setattr(hard_negatives, "DIGIT", digit)
    rows = quarters(3, 90, 4)
    expected = exact(rows, every=9)
    assert len(expected) > 50
    assert found(spark, rows, every=9, block=block, anchors=anchors) == expected


def test_ties_repeats_nulls_and_lengths(spark):
    nan, inf = float("nan"), float("inf")
    same = [(i, [1.0, 0.0], 1) for i in range(1, 20)]
    rows = [(0, [1.0, 0.5], 0), (0, [1.0, 0.5], 0), (50, [1.0], 1), (50, [1.0, 0.25], 1), (100, [], 2), (150, None, 1), (200, [1.0, None], 1), (250, [nan, 1.0], 1), (300, [inf, 1.0], 1), (350, [1.0, 1.0], None), (None, [1.0, 0.5], 1), (None, [0.75, 0.0], 3), *same]
    expected = exact(rows)
    assert expected
    assert found(spark, rows, block=8, anchors=2) == expected


def test_empty_alone_and_large(spark):
    assert found(spark, []) == []
    assert found(spark, [(0, [1.0], 0)]) == []
    assert found(spark, [(0, None, 0)]) == []
    rows = [(i, [float(2**k), 1.0, float(i)], i % 2) for i in range(8) for k in (12, 14, 19)]
    for scale in (1, 64, 1024):
        big = [(i, [x * scale for x in v], label) for i, v, label in rows]
        assert found(spark, big, every=2) == exact(big, every=2)


def test_columns_of_other_names(spark):
    rows = [(*r, "x", i, 0.5) for i, r in enumerate(quarters(5, 60, 3))]
    types = TYPES + ", file string, wid long, _metadata double"
    assert found(spark, rows, types, every=10) == exact([r[:3] for r in rows], every=10)
