"""Greedy suppression by rounds, against the greedy loop."""

import random

import pytest

from cairnfield.operators import sites

COLUMNS = "map string, label string, px double, py double, conf double"


def greedy(rows, reach=20.0):
    kept = {}
    for m, label, x, y, conf in sorted(set(rows), key=lambda r: (-r[4], r[2], r[3])):
        mine = kept.setdefault((m, label), [])
        if all(abs(x - a) > reach or abs(y - b) > reach for a, b, _ in mine):
            mine.append((x, y, conf))
    return sorted(((*k, *p) for k, ps in kept.items() for p in ps), key=repr)


def found(spark, rows, reach=20.0):
    return sorted(map(tuple, sites.suppressed(spark.createDataFrame(rows, COLUMNS), ["map", "label"], reach).collect()), key=repr)


def test_one_label_on_two_maps(spark):
    rows = [("A", "12", 100.0, 100.0, 90.0), ("B", "12", 101.0, 100.0, 80.0), ("A", "12", 103.0, 100.0, 70.0), (None, "12", 100.0, 100.0, 60.0)]
    assert sorted((r["map"] or "", r["conf"]) for r in sites.cluster(spark.createDataFrame(rows, COLUMNS)).collect()) == [("", 60.0), ("A", 90.0), ("B", 80.0)]
    fragments = spark.createDataFrame([("A", "14", 10.0, 10.0, 90.0), ("A", "144", 12.0, 11.0, 80.0), ("B", "14", 10.0, 10.0, 90.0)], COLUMNS)
    assert sorted((r["map"], r["label"]) for r in sites.without_fragments(fragments).collect()) == [("A", "144"), ("B", "14")]


@pytest.mark.parametrize("seed", range(3))
def test_greedy(spark, seed):
    rng = random.Random(seed)
    wide = [60, 300, 2000][seed]
    rows = [(rng.choice(["A", "B", None]), rng.choice(["1", "2e"]), float(rng.randrange(wide)), float(rng.randrange(wide)), float(rng.randrange(30, 99))) for _ in range(400)]
    rows += rows[:20]  # repeated detections, ties of confidence, places on the cells' borders
    assert found(spark, rows) == greedy(rows)


def test_crowd(spark):
    """A label of which a third of all detections lie in one place."""
    rng = random.Random(9)
    rows = [("A", "7", 500 + rng.random(), 500 + rng.random(), rng.uniform(30, 99)) for _ in range(3000)] + [("A", "7", rng.uniform(0, 3000), rng.uniform(0, 3000), rng.uniform(30, 99)) for _ in range(1500)]
    assert found(spark, rows) == greedy(rows)


def test_nothing(spark):
    assert found(spark, [("A", "1", None, 3.0, 50.0)]) == []
    assert sites.cluster(spark.createDataFrame([("A", "x", 1.0, 1.0, 90.0)], COLUMNS)).count() == 0


def joins(df):
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return [name for name in ("BroadcastHashJoin", "BroadcastNestedLoopJoin", "SortMergeJoin") if name in plan]


@pytest.mark.parametrize(("merge", "wide"), [(20.0, 400), (20.0, 60), (13.0, 300), (27.3, 300)])
def test_fragments(spark, merge, wide):
    """Crowded and sparse maps, reaches that are no power of two, null and empty digits; nothing is broadcast."""
    rng, reach = random.Random(wide), max(merge * 1.6, 22.0)
    rows = [(rng.choice(["A", "B", None]), rng.choice(["1", "12", "12e", "123", "2", "23", "e", "", None]), float(rng.randrange(-50, wide)), rng.randrange(wide * 4) / 4, 50.0) for _ in range(700)]
    rows += [("A", "1", None, 5.0, 1.0), ("A", "12", None, 5.0, 1.0), ("B", "1", float("nan"), 5.0, 1.0), ("B", "12", float("nan"), 5.0, 1.0)]
    bare = lambda label: None if label is None else label.removesuffix("e")
    near = lambda a, b: None not in (a[2], b[2]) and abs(a[2] - b[2]) <= reach and abs(a[3] - b[3]) <= reach
    hidden = lambda a: any(a[0] == b[0] and None not in (a[1], b[1]) and len(bare(b[1])) > len(bare(a[1])) and bare(b[1]).startswith(bare(a[1])) and near(a, b) for b in rows)
    out = sites.without_fragments(spark.createDataFrame(rows, COLUMNS), merge)
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(r) for r in rows if not hidden(r))
    assert joins(out) == ["SortMergeJoin"]


def test_fragments_of_a_crowd(spark):
    """Of a crowded cell only its outermost points are met."""
    rng = random.Random(4)
    rows = [("A", "12", 500 + rng.random(), 500 + rng.random()) for _ in range(3000)]
    left = sites._outermost(spark.createDataFrame(rows, "m string, d string, px double, py double"), ["m", "d"])
    assert 4 <= left.count() < 100
