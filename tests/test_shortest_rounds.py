"""Shortest paths in rounds: against Dijkstra, and how long the plan of a round gets."""

import heapq
import random

from cairnfield.operators import graph


def brute(edges, starts, cap):
    around, best, queue = {}, {}, [(d, n) for n, d in starts.items()]
    for _, a, b, size in edges:
        if size is not None:
            around.setdefault(a, []).append((b, size))
            around.setdefault(b, []).append((a, size))
    heapq.heapify(queue)
    while queue:
        d, n = heapq.heappop(queue)
        if n in best:
            continue
        best[n] = d
        for m, size in around.get(n, ()):
            if m not in best and d + size <= cap:
                heapq.heappush(queue, (d + size, m))
    return best


def test_distances_and_ways(spark, monkeypatch):
    """With edges of no length, parallel ones, self-loops and ones of unknown length; small and large fronts; a round's plan has one join, whichever round it is."""
    rng = random.Random(7)
    edges = [(k, f"n{rng.randrange(60)}", f"n{rng.randrange(60)}", rng.choice([0.0, 0.5, 1.0, 2.5, rng.uniform(0, 9), None])) for k in range(130)]
    df = spark.createDataFrame(edges, "eid long, a string, b string, len double")
    sources = spark.createDataFrame([("s", "n1", 0.0), ("t", "n2", 1.5), ("t", "n9", 0.25)], "source string, node string, dist0 double")
    want = {(s, n): d for s, starts in (("s", {"n1": 0.0}), ("t", {"n2": 1.5, "n9": 0.25})) for n, d in brute(edges, starts, 7.0).items()}
    joins, cut = [], graph.cut

    def watched(frame):
        joins.append(frame._jdf.queryExecution().analyzed().toString().count("Join"))
        return cut(frame)

    monkeypatch.setattr(graph, "cut", watched)
    for few in (0, 1000):
        monkeypatch.setattr(graph, "FEW", few)
        got = {(r["source"], r["node"]): r["dist"] for r in graph.distances(df, sources, 7.0).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert max(joins) <= 1
    reached = graph.shortest(df, sources, 7.0)
    rows = {(r["source"], r["node"]): r for r in reached.collect()}
    assert {k: r["dist"] for k, r in rows.items()} == got
    size = {k: (a, b, n) for k, a, b, n in edges}
    for r in rows.values():
        if r["prev"] is None:
            assert r["via"] is None and r["node"] in ("n1", "n2", "n9")
            continue
        a, b, n = size[r["via"]]
        assert {a, b} == {r["prev"], r["node"]} and rows[r["source"], r["prev"]]["dist"] + n == r["dist"]
    ways = graph.paths(reached, reached.select("source", reached["node"].alias("target"))).collect()
    total = {}
    for w in ways:
        total[w["source"], w["target"]] = total.get((w["source"], w["target"]), 0.0) + (size[w["via"]][2] if w["via"] is not None else {"n1": 0.0, "n2": 1.5, "n9": 0.25}[w["node"]])
    assert all(abs(total[k] - want[k]) < 1e-9 for k in want)
