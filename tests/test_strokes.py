"""Sequences of strokes against a replay, stroke by stroke over the whole list."""

import random

import pytest

from folio.operators.strokes import IntervalSet, apply_strokes


def replayed(ranges, strokes):
    """Every step over all ranges, without any search for those that a stroke can reach."""
    for a, b, ink in strokes:
        a, b = sorted((a, b))
        if a == b:
            continue
        covered = all(any(s <= p < e for s, e, _ in ranges) for p in range(a, b))
        cut = [piece for s, e, c in ranges for piece in ([(s, e, c)] if e <= a or s >= b else [(s, min(e, a), c), (max(s, b), e, c)])]
        cut = [r for r in cut if r[0] < r[1]] + [(a, b, ink)] * (not covered)
        ranges = []
        for s, e, c in sorted(cut, key=lambda r: r[0]):
            if ranges and ranges[-1][2] == c and ranges[-1][1] >= s:
                ranges[-1] = (ranges[-1][0], max(e, ranges[-1][1]), c)
            else:
                ranges.append((s, e, c))
    return ranges


def some(rng, n, width=60):
    out = []
    for _ in range(n):
        s = rng.randrange(width)
        out.append((s, s + rng.randrange(-2, 14), rng.choice(["red", "blue", None])))
    return out


def test_two_strokes_in_one_range():
    held = IntervalSet([(0, 100, "yellow")])
    held.stroke(10, 20, "red")
    held.stroke(60, 50, "red")
    # Each lies in one range whole, so it erases.
    assert held.ranges == [(0, 10, "yellow"), (20, 50, "yellow"), (60, 100, "yellow")]
    held.stroke(0, 100, "blue")
    assert held.ranges == [(0, 100, "blue")]
    held.stroke(0, 100, "blue")
    assert held.ranges == []


@pytest.mark.parametrize("seed", range(40))
def test_interval_set_equals_replay(seed):
    rng = random.Random(seed)
    ranges = sorted(some(rng, rng.randrange(12)), key=lambda r: r[:2])
    strokes = some(rng, rng.randrange(30))
    held = IntervalSet(list(ranges))
    for s in strokes:
        held.stroke(*s)
    assert held.ranges == replayed(ranges, strokes)


def test_chapters_of_a_table(spark):
    rng = random.Random(9)
    keys = [("a", 1), ("a", 2), ("b", 1), ("b", 3), ("c", None), ("only ranges", 1)]
    old = {k: sorted(some(rng, 8), key=lambda r: (*r[:2], r[2] or "")) for k in keys if k != ("b", 3)}
    drawn = {k: some(rng, 25) for k in keys if k[0] != "only ranges"} | {("only strokes", 1): [(5, 9, "red")], ("empty strokes", 1): [(5, 5, "red")]}
    schema = "k string, n int, start long, end long, color string"
    ranges = spark.createDataFrame([(*k, *r) for k, rs in old.items() for r in rs], schema).repartition(3)
    strokes = spark.createDataFrame([(*k, *r, i) for k, rs in drawn.items() for i, r in enumerate(rs)], schema + ", at int").repartition(3)
    got = apply_strokes(ranges, strokes, ["k", "n"], ["at"])
    want = [(*k, *r) for k in {**old, **drawn} for r in replayed(old.get(k, []), drawn.get(k, []))]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert sorted(map(tuple, apply_strokes(ranges, strokes.limit(0), ["k", "n"]).collect()), key=str) == sorted((tuple(r) for r in ranges.collect()), key=str)
