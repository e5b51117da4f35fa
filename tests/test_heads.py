"""Channel heads against plain sweeps, reach by reach."""

import math
import random

import pytest

from fluvia.operators import heads, solvers
from fluvia.operators.heads import HeadRules, solve_channel_heads

SCHEMA = "stream_id long, down_id long, up_elev_m double, down_elev_m double, length_m double, wetness double, support_fraction double, strahler int, drainage_km2 double, r_target_m double, r_max_m double"


def swept(rows, rules):
    """Sweeps in rising bed order, in place, until nothing moves by more than a hundredth of the tolerance."""
    beds = {r[0]: (r[2] + r[3]) / 2 for r in rows if r[2] is not None and r[3] is not None}
    at = {r[0]: r for r in rows if r[0] in beds}
    pinned, upper, res = {}, {}, {}
    for i, r in at.items():
        support = r[6] is not None and r[6] >= rules.support_fraction_threshold
        order = rules.strahler_pin_min is not None and r[7] is not None and r[7] >= rules.strahler_pin_min and (rules.area_pin_km2 is None or (r[8] is not None and r[8] >= rules.area_pin_km2))
        pinned[i] = support or order
        upper[i] = beds[i] - (0 if support else rules.below_bed_offset_m if order else rules.d_min_off_support_m)
        res[i] = 0.0 if pinned[i] else max(0.0, min(r[9], r[10]))
    near = {i: [] for i in at}
    for i, r in at.items():
        if r[1] in at:
            length = (r[4] + at[r[1]][4]) / 2
            near[i].append((r[1], length, True))
            near[r[1]].append((i, length, False))
    for _ in range(20_000):
        moved = 0.0
        for i in sorted(at, key=lambda i: beds[i]):
            if pinned[i]:
                continue
            wet = at[i][5]
            top, base = rules.target_weight_base * (1 - wet) * at[i][9], rules.target_weight_base * (1 - wet) + rules.zero_weight_base * wet
            for j, length, _ in near[i]:
                w = rules.smoothness_weight / max(length, rules.neighbor_length_floor_m)
                top, base = top + w * res[j], base + w
            new = top / base if base > 1e-12 else res[i]
            for j, length, below in near[i]:
                if below:
                    new = max(new, res[j] + upper[i] - upper[j] - rules.max_hydraulic_slope * length / max(1 - wet, 1e-6))
            new = max(0.0, min(new, at[i][10]))
            moved, res[i] = max(moved, abs(new - res[i])), new
        if moved <= rules.tolerance / 100:
            break
    return {i: upper[i] - res[i] for i in at}, pinned


def network(seed, n, wide=3):
    rng = random.Random(seed)
    rows, elev = [], {0: 100.0}
    for i in range(n):
        down = None if i == 0 else rng.randrange(max(0, i - wide), i)
        low = elev[down] if down is not None else 100.0
        elev[i] = low + rng.choice([0.5, 5, 40, 120]) * rng.random()
        most = rng.uniform(0.5, 60)
        rows.append((i, down, elev[i] + 1, elev[i] - 1, rng.uniform(20, 900), rng.choice([0.0, 0.0, 0.3, 0.9, 1.0]), rng.choice([0.0, 0.0, 0.1, 0.4, None]), rng.randrange(1, 6), rng.uniform(0, 300), rng.uniform(0, 20), most))
    return rows


def solved(spark, rows, rules):
    return {r.stream_id: r for r in solve_channel_heads(spark.createDataFrame(rows, SCHEMA).repartition(3), rules).collect()}


@pytest.mark.parametrize("rules", [HeadRules(), HeadRules(smoothness_weight=400.0, strahler_pin_min=5, area_pin_km2=150.0, below_bed_offset_m=1.5)])
@pytest.mark.parametrize("levels", [2, 1000])
def test_equal_to_plain_sweeps(spark, monkeypatch, rules, levels):
    monkeypatch.setattr(solvers, "BLOCK_LEVELS", levels if levels < 100 else 64)
    rows = network(7, 90)
    # a reach without a bed takes no part, and parts what it lies between
    rows[40] = (*rows[40][:2], None, *rows[40][3:])
    want, pinned = swept(rows, rules)
    got = solved(spark, rows, rules)
    assert len(got) == len(rows) and got[40].channel_head_m is None
    assert all(got[i].hard_pin == pinned[i] for i in want) and 3 < sum(pinned.values()) < 80
    for i, head in want.items():
        assert got[i].channel_head_m == pytest.approx(head, abs=rules.tolerance), i


def test_pins_and_offsets(spark):
    flat = lambda i, down, **more: tuple({"stream_id": i, "down_id": down, "up_elev_m": 10.0, "down_elev_m": 10.0, "length_m": 500.0, "wetness": 0.0, "support_fraction": 0.0, "strahler": 1, "drainage_km2": 1.0, "r_target_m": 3.0, "r_max_m": 5.0, **more}.values())
    rows = [flat(1, None, support_fraction=0.25), flat(2, 1), flat(3, 2, strahler=5, drainage_km2=90.0), flat(4, 3, strahler=5, drainage_km2=10.0)]
    got = solved(spark, rows, HeadRules(strahler_pin_min=4, area_pin_km2=50.0, below_bed_offset_m=1.25))
    assert [got[i].hard_pin for i in (1, 2, 3, 4)] == [True, False, True, False]
    assert got[1].head_depth_m == 0 and got[3].head_depth_m == 1.25 and 3 < got[2].head_depth_m < 3.5 and got[4].head_depth_m > 3
    assert got[2].target_weight == 2 and got[2].zero_weight == 0


def test_slopes_are_bounded_from_above_unless_wet(spark):
    top = lambda wet: (2, 1, 140.0, 140.0, 100.0, wet, 0.0, 1, 1.0, 1.0, 100.0)
    low = (1, None, 100.0, 100.0, 100.0, 1.0, 1.0, 1, 1.0, 0.0, 1.0)
    dry, wet = (solved(spark, [low, top(w)], HeadRules()) for w in (0.0, 1.0))
    assert dry[2].channel_head_m == pytest.approx(100 + 0.05 * 100, abs=0.01)
    assert wet[2].head_depth_m < 0.6


def test_missing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, 5.0, 3.0, 10.0, None), (2, 1, 9.0, math.nan, 10.0, 0.5)], "stream_id long, down_id long, up_elev_m double, down_elev_m double, length_m double, wetness double")
    got = {r.stream_id: r for r in heads.solve_channel_heads(df).collect()}
    assert got[1].head_depth_m == pytest.approx(1.0) and got[2].channel_head_m is None
    assert heads.solve_channel_heads(df.limit(0)).count() == 0
