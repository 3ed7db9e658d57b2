import random

from sparkreel.llm.components import connected_components


def brute(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_against_union_find(spark):
    rnd = random.Random(6)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(2000 + i, 3000) for i in range(30)] + [(4000, 4000 + i) for i in range(30)]
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(90)] + chain + star + [(7, 7), (5000, 5000)] + chain[:5]
    frame = spark.createDataFrame(edges, "a long, b long").repartition(3)
    assert {r.node: r.root for r in connected_components(frame).collect()} == brute(edges)
    assert connected_components(frame.limit(0)).collect() == []
