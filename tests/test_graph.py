import random

from fluvia.operators.graph import connected_components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = sorted((root(a), root(b)))
            parent[rb] = ra
    return {x: root(x) for x in parent}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(500, x) for x in range(501, 560)]
    out = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(out) == len({r.node for r in out})
    assert {r.node: r.component for r in out} == brute(edges)


def test_no_edges(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
