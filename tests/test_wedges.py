"""Bent paths on rasters and the polygons between strips."""

import math
import random

import pytest

from fluvia.operators import lines, raster, reaches


def walked(path, va, vb, size):
    total = sum(map(math.dist, path, path[1:]))
    n = max(1, math.ceil(total / (size / 2)))
    out = {}
    for k in range(n + 1):
        left = k / n * total
        for a, b in zip(path, path[1:]):
            d = math.dist(a, b)
            if left <= d or b is path[-1]:
                t = min(1, left / d)
                break
            left -= d
        x, y = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
        out.setdefault((math.floor(y / size), math.floor(x / size)), []).append(va + k / n * (vb - va))
    return out


def test_bent_paths_are_walked(spark):
    rng = random.Random(4)
    paths = {k: [(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(rng.randrange(2, 6))] for k in range(20)}
    ends = [(k, rng.uniform(0, 9), rng.uniform(0, 9)) for k in paths] + [(77, 1.0, 2.0), (88, None, 1.0)]
    vertices = [(k, i, *p) for k, v in paths.items() for i, p in enumerate(v)] + [(77, 0, 5.0, 5.0), (77, 1, 5.0, 5.0), (88, 0, 0.0, 0.0), (88, 1, 9.0, 9.0)]
    got = lines.burn_paths(spark.createDataFrame(vertices, "line long, seq int, x double, y double"), "line", spark.createDataFrame(ends, "line long, va double, vb double"), 10.0).collect()
    want = {}
    for k, va, vb in ends[:20]:
        for cell, values in walked(paths[k], va, vb, 10.0).items():
            want.setdefault(cell, []).extend(values)
    assert {(r.r, r.c) for r in got} == want.keys()
    for r in got:
        values = want[r.r, r.c]
        assert (r.value, r.mean, r.n) == (pytest.approx(min(values)), pytest.approx(sum(values) / len(values)), len(values))


def test_straight_paths_burn_like_strips(spark):
    strips = spark.createDataFrame([(1, 0.3, 0.7, 33.1, 41.9, 5.0, 9.0), (2, 30.2, 3.1, 2.9, 8.8, 7.0, 1.0)], "line long, ax double, ay double, bx double, by double, va double, vb double")
    vertices = strips.selectExpr("line", "0 AS seq", "ax AS x", "ay AS y").unionByName(strips.selectExpr("line", "1 AS seq", "bx AS x", "by AS y"))
    one = {(r.r, r.c): (r.value, r.n) for r in raster.burn(strips, 5.0).collect()}
    two = {(r.r, r.c): (r.value, r.n) for r in lines.burn_paths(vertices, "line", strips, 5.0).collect()}
    assert one.keys() == two.keys() and all(two[k] == (pytest.approx(v), n) for k, (v, n) in one.items())


def test_wedges_add_up_and_cross(spark):
    ray = "k long, side string, station int, hit_type string, target long, x double, y double, ex double, ey double"
    rows = [(1, "l", i, "naked", None, 10.0 * i, 0.0, 10.0 * i, 5.0 + i) for i in range(5)]
    rows += [(2, "l", 0, "naked", None, 0.0, 0.0, 4.0, 4.0), (2, "l", 1, "naked", None, 4.0, 0.0, 0.0, 4.0)]
    rows += [(3, "l", 0, "interreach", 7, 0.0, 0.0, 0.0, 4.0), (3, "l", 1, "interreach", 8, 4.0, 0.0, 4.0, 4.0), (3, "l", 2, "edge", None, 8.0, 0.0, 8.0, 4.0)]
    rows += [(4, "l", 0, "edge", None, 0.0, 0.0, 0.0, 0.0), (4, "l", 1, "edge", None, 0.0, 0.0, 0.0, 0.0)]
    got = {(r.k, r.station): r for r in reaches.wedge_rings(spark.createDataFrame(rows, ray), "k").collect()}
    assert set(got) == {(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)}
    assert sum(r.area for (k, _), r in got.items() if k == 1) == pytest.approx(sum(10 * (5 + i + 6 + i) / 2 for i in range(4)))
    assert got[2, 0].area == pytest.approx(8) and len(got[2, 0].rings) == 2 and all(len(x) == 3 for x in got[2, 0].rings)
    assert [(p.x, p.y) for p in got[1, 0].rings[0]] == [(0, 0), (0, 5), (10, 6), (10, 0)] and got[1, 0].next_station == 1
