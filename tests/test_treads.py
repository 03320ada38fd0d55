"""Doubled treads by rounds over a grid, long ways back, gaps of long series."""

import random

import numpy as np
from pyspark.sql import functions as F

from cairnfield.functions import geo
from cairnfield.operators import elevation, graph, loops


def greedy(rows):
    """The loop over each group's lines: (group, pos, eid, points)."""
    kept, out = {}, []
    for g, _, eid, line in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        xy = np.array(line, float)
        size = np.hypot(*(xy[1:] - xy[:-1]).T)
        total, before = size.sum(), kept.setdefault(g, [])
        if not total:
            continue
        n = max(2, int(total // 2) * 2)
        marks, upto = np.arange(1, n, 2) * total / n, np.concatenate([[0], np.cumsum(size)])
        x, y = np.interp(marks, upto, xy[:, 0]), np.interp(marks, upto, xy[:, 1])
        close = np.zeros(len(marks), bool)
        for (x0, y0), (x1, y1) in before:
            t = np.clip(((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / max((x1 - x0) ** 2 + (y1 - y0) ** 2, 1e-12), 0, 1)
            close |= np.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)) <= loops.TREAD_M
        if close.mean() < loops.TREAD_SHARE:
            out.append((g, eid))
            before += zip(xy[:-1].tolist(), xy[1:].tolist(), strict=True)
    return sorted(out, key=str)


def test_treads_of_many_lines(spark):
    """Groups of lines that run beside, across and partly along each other, in a line of parallels and at random."""
    rng = random.Random(6)
    rows = []
    for k in range(45):
        x, y, a = rng.uniform(0, 300), rng.uniform(0, 40), rng.uniform(-0.2, 0.2)
        rows.append(("g", rng.randrange(100), k, [(x, y), (x + 60, y + 60 * a), (x + rng.uniform(70, 200), y + 100 * a)]))
    rows += [("h", k, 1000 + k, [(0.0, 3.0 * k), (50.0 + k, 3.0 * k)]) for k in range(14)] + [(None, 1, 2000, [(0.0, 0.0), (9.0, 0.0)]), (None, 2, 2001, [(0.0, 1.0), (9.0, 1.0)]), ("g", 1, 3000, [(5.0, 5.0), (5.0, 5.0)])]
    df, want = spark.createDataFrame(rows, f"g string, pos int, eid long, line {geo.LINE}"), greedy(rows)
    for few in (0, 60, 10**6):  # all groups over the grid, some, none
        assert sorted(((r["g"], r["eid"]) for r in loops.drop_doubled(df, "g", few).collect()), key=str) == want and 15 < len(want) < 60


def test_long_ways(spark):
    """A way of 10,000 steps takes rounds by its logarithm."""
    n = 10_000
    reached = spark.range(n + 1).select(F.lit("s").alias("source"), F.col("id").cast("string").alias("node"), F.col("id").cast("double").alias("dist"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("prev"), F.when(F.col("id") > 0, F.col("id")).alias("via"))
    pairs = spark.createDataFrame([("s", str(n)), ("s", "3"), ("s", "0"), ("s", "nowhere"), ("t", "3")], "source string, target string")
    made = graph.paths(reached, pairs)
    got = {r["target"]: (r["n"], r["vias"], r["far"]) for r in made.groupBy("target").agg(F.count("*").alias("n"), F.sum("via").alias("vias"), F.max("back").alias("far")).collect()}
    assert got == {str(n): (n + 1, n * (n + 1) // 2, n), "3": (4, 6, 3), "0": (1, None, 0)}
    assert made.filter(f"target = '{n}' and node <> cast({n} - back as string)").count() == 0


def test_gaps(spark):
    rng = random.Random(3)
    rows = [[None if rng.random() < 0.4 else rng.uniform(0, 9) for _ in range(rng.randint(0, 30))] for _ in range(80)] + [[None] * 4, [5.0], [], None, [None, 2.0], [2.0, None], [1.0] + [None] * 5000 + [2.0]]
    got = {r["k"]: r["s"] for r in spark.createDataFrame(list(enumerate(rows)), "k int, s array<double>").select("k", elevation.fill(F.col("s")).alias("s")).collect()}
    for k, row in enumerate(rows):
        there = [i for i, x in enumerate(row or []) if x is not None]
        want = row if not there else np.interp(range(len(row)), there, [row[i] for i in there]).tolist()
        assert got[k] is None and want is None or all(a is None and b is None or abs(a - b) < 1e-9 for a, b in zip(got[k], want, strict=True))
