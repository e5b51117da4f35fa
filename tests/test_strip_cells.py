"""Strips meet lines in raster cells: no side is broadcast for seeming small, and segments may have any length."""

import math
import random

import pytest

from fluvia.operators import reaches
from fluvia.plans import registry

SF = "/root/testdata/sf0.001"


def met(ray, segment):
    (x, y, dx, dy), ((ax, ay), (bx, by)) = ray, segment
    det = dx * (by - ay) - dy * (bx - ax)
    if not det:
        return None
    t, u = ((ax - x) * (by - ay) - (ay - y) * (bx - ax)) / det, ((ax - x) * dy - (ay - y) * dx) / det
    return round(t, 9) if -1e-9 <= t <= 1 + 1e-9 and -1e-9 <= u <= 1 + 1e-9 else None


def test_strips_meet_long_and_short_segments(spark):
    rng = random.Random(11)
    paths = {k: [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(3)] for k in range(12)}
    paths |= {k: [(x := rng.randrange(60), y := rng.randrange(60)), (x + 2, y), (x + 2, y + 1)] for k in range(12, 60)}
    paths[60] = [(-900.0, -880.0), (930.0, 950.0)]
    rows = [(k, [(float(x), float(y)) for x, y in v]) for k, v in paths.items()]
    parts = reaches.segments(spark.createDataFrame(rows, "k long, points array<struct<x double, y double>>"), "k")
    at = reaches.stations(parts, "k", 3.0)
    got = {(r.k, r.station, r.side): r for r in reaches.strips(at, parts, "k", (-2000.0, -2000.0, 2000.0, 2000.0), 5.0).collect()}
    places = {}
    for r in at.orderBy("k", "s").collect():
        places.setdefault(r.k, []).append(r)
    assert len(got) == 2 * sum(map(len, places.values()))
    for (k, station, side), r in got.items():
        p = places[k][station]
        hits = [(t, o) for o, v in paths.items() if o != k for s in zip(v, v[1:]) if (t := met((p.x, p.y, p.nx * side * 5, p.ny * side * 5), s)) is not None and t * 5 >= 1e-6]
        best = min(hits, default=None)
        assert (r.hit_type, r.target) == (("interreach", best[1]) if best else ("naked", None))
        assert math.isclose(r.hit_m, best[0] * 5 if best else 5.0, abs_tol=1e-9)


@pytest.mark.parametrize("name", ["strips", "wedges", "wedge_polygons"])
def test_exploded_sides_are_not_broadcast(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "NestedLoop" not in plan


def test_only_depths_are_broadcast(spark):
    plan = registry.queries()["lowered_strips"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") <= 2 and "NestedLoop" not in plan
