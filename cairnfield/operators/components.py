"""Connected components of a graph given by its edges, with nothing collected: alternating stars.

Large stars tie a node's larger neighbours to its least neighbour, small stars the smaller ones; both shrink the graph to stars
around each component's least node in a logarithmic number of rounds. Minima are aggregated before they are
shuffled, so nodes of many edges are not gathered anywhere. Each round ends in files of the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnfield.session import cut


def _tied(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges a > b."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("of"), F.least("u", "m").alias("m"))
    around = both.join(least, F.col("u") == F.col("of"))
    if large:
        out = around.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = around.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """node, label of every node of an edge; the label is the component's least node. Edges may repeat and run either way."""
    now = cut(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = None
    while True:
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == was or not state[0]:
            break
        now = cut(_tied(_tied(now, True), False))
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
