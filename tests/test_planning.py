"""Shift packing against a plain sequential fold."""

import datetime as dt

import numpy as np
import pytest

from fieldrecon.operators import planning


def fold(minutes, capacity, clock):
    shift, out = 0, []
    for w in minutes:
        if clock >= capacity or (clock + w > capacity and clock != 0):
            shift, clock = shift + 1, 0
        out.append((shift, clock))
        clock += w
    return shift, min(clock, capacity), out


def test_segment_functions():
    rng = np.random.default_rng(7)
    for _ in range(300):
        capacity = int(rng.integers(5, 50))
        minutes = rng.integers(1, int(capacity * 1.3) + 1, int(rng.integers(1, 25)))
        after, opened = planning.segment_table(minutes, capacity)
        for clock in range(capacity + 1):
            shift, end, out = fold(minutes, capacity, clock)
            assert (opened[clock], after[clock]) == (shift, end)
            got = planning.place_segment(minutes, capacity, clock)
            assert list(zip(*map(list, got))) == out


@pytest.mark.parametrize("segment, group", [(20_000, 256), (25, 3), (7, 2)])
def test_pack_shifts_equals_sequential_plan(spark, segment, group):
    """Also where a day spans many segments and several groups of them."""
    rng = np.random.default_rng(1)
    base = dt.date(2025, 1, 1)
    rows = [
        ("BTP BD" if i % 3 else "BTP JAK", base + dt.timedelta(days=int(rng.integers(0, 6))), f"p{i:05d}", i, int(rng.integers(5, 800)))
        for i in range(600)
    ]
    items = spark.createDataFrame(rows, "region string, plan_date date, path string, ord bigint, minutes int")
    got = {r["path"]: (r["plan_day"], r["team"], r["t0"]) for r in planning.pack_shifts(items, segment=segment, group=group).collect()}
    assert len(got) == len(rows)
    for region in ("BTP BD", "BTP JAK"):
        shift, clock = None, 0
        for _, day, path, _, w in sorted((r for r in rows if r[0] == region), key=lambda r: (r[1], r[2])):
            first = (day - dt.date(1970, 1, 1)).days * 2
            if shift is None or shift < first:
                shift, clock = first, 0
            elif clock >= 660 or (clock + w > 660 and clock != 0):
                shift, clock = shift + 1, 0
            plan_day = dt.date(1970, 1, 1) + dt.timedelta(days=shift // 2)
            start = dt.datetime.combine(plan_day, dt.time()) + dt.timedelta(minutes=420 + clock)
            assert got[path] == (plan_day, shift % 2 + 1, start)
            clock += w


def test_overlaps_are_seen_behind_a_long_entry(spark):
    at = lambda h: dt.datetime(2025, 1, 1, h)
    rows = [("r", dt.date(2025, 1, 1), team, at(a), at(b), "p", 1) for team, a, b in ((1, 7, 12), (1, 8, 9), (1, 10, 11), (1, 12, 13), (2, 7, 8), (2, 8, 9))]
    plan = spark.createDataFrame(rows, "region string, plan_day date, team int, t0 timestamp, t100 timestamp, path string, ord int")
    found = planning.overlapping_slots(plan).collect()
    assert sorted((r["team"], r["t0"].hour, r["previous_end"].hour) for r in found) == [(1, 8, 12), (1, 10, 12)]
