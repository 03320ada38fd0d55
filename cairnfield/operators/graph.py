"""Trail graphs as DataFrames: edges (eid, a, b, len, ...), nodes as text keys of rounded coordinates.

Iterative operators are frontier loops over DataFrames; each round ends in files of the shared folder, so lineage stays short
and a lost executor costs a round at most.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import geo
from cairnfield.operators import components as stars
from cairnfield.session import cut

#: Fixed value: decimal places of a node's coordinates.
SNAP = 6
#: Prunings, or links of a halo, between two checkpoints.
HOPS = 4
#: Nodes of a round's front that are sent to all edges.
FEW = 50_000


def node(p: Column) -> Column:
    """A point's node: its coordinates rounded half to even."""
    part = lambda v: F.format_string("%.6f", F.bround(v, SNAP) + F.lit(0.0))
    return F.concat_ws(",", part(p["x"]), part(p["y"]))


def build(lines: DataFrame, self_loops: bool = True) -> DataFrame:
    """Edges from lines (eid, line, and whatever else); parallel edges stay."""
    edges = lines.filter(F.size("line") > 1).withColumns({"a": node(geo.start(F.col("line"))), "b": node(geo.end(F.col("line"))), "len": geo.length(F.col("line"))})
    return edges if self_loops else edges.filter("a <> b")


def build_segments(lines: DataFrame) -> DataFrame:
    """Edges between the consecutive points of lines (eid, line, and whatever else): eid and part, the segment's place in its line."""
    parts = lines.select(*lines.columns, F.posexplode(geo.segments(F.col("line"))).alias("part", "s"))
    return parts.withColumns({"a": node(F.col("s.a")), "b": node(F.col("s.b")), "len": geo.metres(F.col("s.a.x"), F.col("s.a.y"), F.col("s.b.x"), F.col("s.b.y"))}).drop("s", "line")


def ends(edges: DataFrame) -> DataFrame:
    """node, eid of both ends of every edge."""
    return edges.select("eid", F.explode(F.array("a", "b")).alias("node"))


def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, kind: dead_end (1), junction (3 and more) or through."""
    d = ends(edges).groupBy("node").agg(F.count("*").alias("degree"))
    return d.withColumn("kind", F.when(F.col("degree") == 1, "dead_end").when(F.col("degree") >= 3, "junction").otherwise("through"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node reachable, also of nodes that only have loops."""
    joined = stars.components(edges, "a", "b")
    alone = edges.filter("a = b").select(F.col("a").alias("node")).distinct().join(joined.select("node"), "node", "left_anti")
    return joined.select("node", F.col("label").alias("component")).unionByName(alone.select("node", F.col("node").alias("component")))


def stats(edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, length, names, dead_ends, junctions, components, largest (nodes of the largest component)."""
    d = degrees(edges).agg(F.count("*").alias("nodes"), F.count(F.when(F.col("kind") == "dead_end", 1)).alias("dead_ends"), F.count(F.when(F.col("kind") == "junction", 1)).alias("junctions"))
    e = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("len"), F.lit(0.0)).alias("length"), F.countDistinct(F.nullif("name", F.lit(""))).alias("names"))
    c = components(edges).groupBy("component").count().agg(F.count("*").alias("components"), F.coalesce(F.max("count"), F.lit(0)).alias("largest"))
    one = lambda df: df.withColumn("_one", F.lit(1))
    return one(d).join(one(e), "_one").join(one(c), "_one").drop("_one")


def two_core(edges: DataFrame) -> DataFrame:
    """The edges left when dead ends are pruned until there are none. A self-loop counts twice at its node. A round prunes HOPS times, and is gone only if there is a dead end.
    A dead end is the one edge of its node, so edges are dealt by their own key once a round, without what they carry."""
    every, key = cut(edges), ["eid", "a", "b"]
    now = every.select(*key)

    def dead(left: DataFrame) -> DataFrame:
        met = left.select(F.explode(F.array("a", "b")).alias("node"), F.struct(*key).alias("e"))
        return met.groupBy("node").agg(F.count("*").alias("n"), F.min("e").alias("e")).filter("n = 1").select("e.*").distinct()

    pruned = False
    while not dead(now).isEmpty():
        for _ in range(HOPS):
            now = now.join(dead(now), key, "left_anti")
        now, pruned = cut(now), True
    return every.join(now.distinct(), key, "left_semi") if pruned else every


def _least(ways: DataFrame) -> DataFrame:
    return ways.groupBy("source", "node").agg(F.min(F.struct("dist", "prev", "via")).alias("s")).select("source", "node", "s.*")


def _hop(front: DataFrame, both: DataFrame, best: DataFrame, cap: float | None) -> DataFrame:
    """The least ways one edge on from a front, where they are nearer than the best known ones: a hop with its ways, which _relaxed() takes many of without them."""
    step = front.join(both, F.col("node") == F.col("a")).select("source", F.col("b").alias("node"), (F.col("dist") + F.col("len")).alias("dist"), F.col("a").alias("prev"), F.col("eid").alias("via"))
    known = best.select("source", "node", F.col("dist").alias("known"))
    step = (step if cap is None else step.filter(F.col("dist") <= cap)).join(known, ["source", "node"], "left")
    return _least(step.filter(F.col("known").isNull() | (F.col("dist") < F.col("known") - 1e-9)))


def _both(edges: DataFrame) -> DataFrame:
    """Both directions (a, b, len, eid) of all edges that lead anywhere."""
    turned = edges.select("eid", F.col("b").alias("a"), F.col("a").alias("b"), "len")
    return cut(edges.select("eid", "a", "b", "len").unionByName(turned).filter("a <> b and len is not null"))


def _relaxed(both: DataFrame, sources: DataFrame, cap: float | None) -> Iterator[DataFrame]:
    """source, node, dist, round (the last in which the node got nearer, 0 for sources), as it is after each round; the last one is what holds.
    A round goes one edge from the nodes that got nearer in the one before, and meets what is known by one sum over source and node: the plan of a round is no longer than the first one's. Few
    such nodes are sent to the edges, which stay where they are; many are met by shuffling both."""
    now = cut(sources.groupBy("source", "node").agg(F.min(F.col("dist0").cast("double")).alias("dist")).withColumn("round", F.lit(0)))
    fresh, k, none = now.count(), 0, lambda kind: F.lit(None).cast(kind)
    yield now
    while fresh:
        k += 1
        front = now.filter(F.col("round") == k - 1).select("source", F.col("node").alias("a"), "dist")
        step = both.join(F.broadcast(front) if fresh <= FEW else front.hint("shuffle_hash"), "a").select("source", F.col("b").alias("node"), (F.col("dist") + F.col("len")).alias("new"))
        step = step if cap is None else step.filter(F.col("new") <= cap)
        met = now.select("*", none("double").alias("new")).unionByName(step.select("source", "node", none("double").alias("dist"), none("int").alias("round"), "new"))
        least = met.groupBy("source", "node").agg(F.min("dist").alias("dist"), F.min("round").alias("round"), F.min("new").alias("new"))
        nearer = F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))
        now = cut(least.select("source", "node", F.when(nearer, F.col("new")).otherwise(F.col("dist")).alias("dist"), F.when(nearer, F.lit(k)).otherwise(F.col("round")).alias("round")))
        fresh = now.filter(F.col("round") == k).count()
        yield now


def distances(edges: DataFrame, sources: DataFrame, cap: float | None = None) -> DataFrame:
    """source, node, dist of all nodes within `cap` of each source (source, node, dist0)."""
    return _last(_relaxed(_both(edges), sources, cap)).select("source", "node", "dist")


def _last(states: Iterator[DataFrame]) -> DataFrame:
    return deque(states, maxlen=1).pop()


def shortest(edges: DataFrame, sources: DataFrame, cap: float | None = None) -> DataFrame:
    """source, node, dist, prev (node before), via (edge) of all nodes within `cap` of each source (source, node, dist0).
    Frontier relaxation: only nodes that got nearer relax their edges in the next round. The node before is one that got nearer in the round before, by the same sum; of several
    the least, so that ways never lead round."""
    both = _both(edges)
    states = list(_relaxed(both, sources, cap))
    steps = reduce(DataFrame.unionByName, [s.filter(F.col("round") == k) for k, s in enumerate(states)])
    before = steps.select("source", F.col("node").alias("a"), F.col("dist").alias("upto"), (F.col("round") + 1).alias("round"))
    held = states[-1]
    came = held.select("source", F.col("node").alias("b"), "dist", "round").filter("round > 0").join(both.select("b", "a", "len", "eid"), "b").join(before, ["source", "a", "round"])
    last = came.filter(F.col("upto") + F.col("len") == F.col("dist")).groupBy("source", "b").agg(F.min(F.struct(F.col("a").alias("prev"), F.col("eid").alias("via"))).alias("s")).select("source", F.col("b").alias("node"), "s.prev", "s.via")
    return cut(held.select("source", "node", "dist").join(last, ["source", "node"], "left"))


def farthest_pair(edges: DataFrame, start: str) -> tuple[str, str, float]:
    """Two nodes far apart, by a double sweep from `start`: exact on trees, a lower bound elsewhere."""
    spark, both = edges.sparkSession, _both(edges)

    def sweep(n: str) -> tuple[str, float]:
        row = _last(_relaxed(both, spark.createDataFrame([("s", n, 0.0)], "source string, node string, dist0 double"), None)).orderBy(F.desc("dist"), "node").first()
        return row["node"], row["dist"]

    one, _ = sweep(start)
    two, dist = sweep(one)
    return one, two, dist


def paths(reached: DataFrame, pairs: DataFrame) -> DataFrame:
    """source, target, back (0 at the target), node, via of the way to each target (pairs: source, target), from `shortest`'s rows, all ways at
    once. Targets that were not reached have no rows. A round knows of every node the one so many steps before it, and doubles both that number and the stretches found, so
    that rounds follow the logarithm of the longest way."""
    steps = cut(reached.select("source", "node", "prev", "via"))
    before = steps.filter("prev is not null").select("source", "node", F.col("prev").alias("far"))
    found, reach = cut(pairs.select("source", "target", F.col("target").alias("node"), F.lit(0).alias("back")).join(steps.select("source", "node"), ["source", "node"]).distinct()), 1
    while True:
        more = cut(found.join(before, ["source", "node"]).select("source", "target", F.col("far").alias("node"), (F.col("back") + reach).alias("back")))
        if more.isEmpty():
            return found.join(steps, ["source", "node"]).select("source", "target", "back", "node", "via")
        found = cut(found.unionByName(more.select(*found.columns)))
        after = before.select("source", F.col("node").alias("far"), F.col("far").alias("next"))
        before, reach = cut(before.join(after, ["source", "far"]).select("source", "node", F.col("next").alias("far"))), reach * 2


def path(reached: DataFrame, source: str, target: str) -> list[tuple[str, object]]:
    """(node, edge before it) from the source to one target."""
    pair = reached.sparkSession.createDataFrame([(source, target)], "source string, target string")
    return [(r["node"], r["via"]) for r in paths(reached, pair).orderBy(F.desc("back")).collect()]


def exported(edges: DataFrame) -> DataFrame:
    """id, kind, line, properties: nodes (with their degree) and edges (with name and metres) of a graph (eid, line, a, b, len, name) as features to write."""
    at = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), geo.start(F.col("line")).alias("p")), F.struct(F.col("b").alias("node"), geo.end(F.col("line")).alias("p")))).alias("e")).select("e.*").groupBy("node").agg(F.min("p").alias("p"))
    nodes = at.join(degrees(edges), "node").select(F.col("node").alias("id"), F.lit("node").alias("kind"), F.array("p").alias("line"), F.to_json(F.struct("degree", F.col("kind").alias("class"))).alias("properties"))
    lines = edges.select(F.col("eid").cast("string").alias("id"), F.lit("edge").alias("kind"), "line", F.to_json(F.struct("a", "b", "name", F.round("len", 1).alias("len_m"))).alias("properties"))
    return nodes.unionByName(lines)


def legs(steps: DataFrame) -> DataFrame:
    """route, leg, name, miles: consecutive steps (route, pos, name, len) of one name put together."""
    w = Window.partitionBy("route").orderBy("pos")
    marked = steps.withColumn("_new", F.when(F.lag("pos").over(w).isNull() | ~F.lag("name").over(w).eqNullSafe(F.col("name")), 1).otherwise(0))
    numbered = marked.withColumn("leg", F.sum("_new").over(w).cast("int"))
    return numbered.groupBy("route", "leg").agg(F.first("name").alias("name"), (F.sum("len") / geo.MILE_METRES).alias("miles"))
