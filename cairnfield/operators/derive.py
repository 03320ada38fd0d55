"""Derived layers: snaps, spurs, street-view cameras, parking names, footprints. Pure functions of their inputs.

Nearest neighbours are chosen by planar degrees and then tested in metres, in that order: the nearest in
degrees need not be the nearest in metres.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import geo
from cairnfield.operators import spatial

#: Thresholds in metres.
SNAP, SPUR, STREET_PARKING, TOUCH, STUB, AIMED = 5.0, 5.0, 30.0, 2.0, 80.0, 1.0


def snap_to_ends(points: DataFrame, lines: DataFrame, most: float = SNAP) -> DataFrame:
    """id, x, y, metres, moved of points (id, x, y): those over 0 and at most `most` metres from the nearest line end move there."""
    ends = lines.select(F.explode(F.array(F.struct("rid", F.lit(0).alias("side"), geo.start(F.col("line")).alias("p")), F.struct("rid", F.lit(1).alias("side"), geo.end(F.col("line")).alias("p")))).alias("e"))
    targets = ends.select((F.col("e.rid") * 2 + F.col("e.side")).alias("rid"), F.col("e.p.x").alias("rx"), F.col("e.p.y").alias("ry"))
    near = spatial.nearest(points.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly")), targets)
    d = geo.metres(F.col("lx"), F.col("ly"), F.col("rx"), F.col("ry"))
    moved = (d > 0) & (d <= most)
    return near.select(F.col("lid").alias("id"), F.when(moved, F.col("rx")).otherwise(F.col("lx")).alias("x"), F.when(moved, F.col("ry")).otherwise(F.col("ly")).alias("y"), d.alias("metres"), moved.alias("moved"))


def spurs(points: DataFrame, roads: DataFrame, least: float = SPUR) -> DataFrame:
    """id, road, line, len_m: the shortest line from each point (id, x, y) to its nearest road (rid, line), where over `least` metres."""
    near = spatial.nearest_on_lines(points.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly")), roads)
    d = geo.metres(F.col("lx"), F.col("ly"), F.col("px"), F.col("py"))
    line = F.array(geo.point(F.col("lx"), F.col("ly")), geo.point(F.col("px"), F.col("py")))
    return near.filter(d > least).select(F.col("lid").alias("id"), F.col("rid").alias("road"), line.alias("line"), F.round(d.cast("decimal(20,6)"), 1).cast("double").alias("len_m"))


def cameras(sites: DataFrame, spur: DataFrame, roads: DataFrame) -> DataFrame:
    """id, sv_lng, sv_lat, sv_heading of sites (id, x, y): the camera stands at the far end of the site's spur (id, line), else at
    the far end of the shortest stub (a road of under STUB metres that starts or ends within TOUCH metres of the site), else at the
    closest road point; it looks at the site, if over AIMED metres away."""
    at_spur = spur.select(F.col("id").alias("_s"), geo.end(F.col("line")).alias("spur_end"))
    stubs = roads.withColumn("len", geo.length(F.col("line"))).filter(F.col("len") < STUB)
    both = stubs.select("rid", "len", F.explode(F.array(F.struct(geo.start(F.col("line")).alias("near"), geo.end(F.col("line")).alias("far")), F.struct(geo.end(F.col("line")).alias("near"), geo.start(F.col("line")).alias("far")))).alias("e"))
    touching = spatial.within(sites.select("id", F.col("x").alias("lx"), F.col("y").alias("ly")), both.select("rid", "len", F.col("e.near.x").alias("rx"), F.col("e.near.y").alias("ry"), "e.far"), TOUCH)
    first = Window.partitionBy("id").orderBy("len", "rid")
    stub = touching.select(F.col("id").alias("_t"), F.first_value("far").over(first).alias("stub_end"), F.row_number().over(first).alias("_rank")).filter("_rank = 1").drop("_rank")
    on_road = spatial.nearest_on_lines(sites.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly")), roads).select(F.col("lid").alias("_r"), geo.point(F.col("px"), F.col("py")).alias("road_point"))
    placed = sites.join(at_spur, F.col("id") == F.col("_s"), "left").join(stub, F.col("id") == F.col("_t"), "left").join(on_road, F.col("id") == F.col("_r"), "left")
    placed = placed.withColumn("cam", F.coalesce("spur_end", "stub_end", "road_point")).filter("cam is not null")
    cx, cy = F.col("cam.x"), F.col("cam.y")
    exact = lambda c, n: F.round(c.cast("decimal(24,12)"), n).cast("double")
    heading = F.when(geo.metres(cx, cy, F.col("x"), F.col("y")) > AIMED, exact(geo.azimuth(cx, cy, F.col("x"), F.col("y")), 1))
    return placed.select("id", exact(cx, 7).alias("sv_lng"), exact(cy, 7).alias("sv_lat"), heading.alias("sv_heading"))


def name_street_parking(lots: DataFrame, roads: DataFrame, most: float = STREET_PARKING) -> DataFrame:
    """id, name of unnamed lots (id, x, y, name): the nearest named road (rid, line, name), if at most `most` metres away."""
    unnamed = lots.filter(F.coalesce("name", F.lit("")) == "")
    named = roads.filter(F.coalesce("name", F.lit("")) != "")
    near = spatial.nearest_on_lines(unnamed.select(F.col("id").alias("lid"), F.col("x").alias("lx"), F.col("y").alias("ly")), named)
    close = near.filter(geo.metres(F.col("lx"), F.col("ly"), F.col("px"), F.col("py")) <= most)
    return close.join(named.select("rid", "name"), "rid").select(F.col("lid").alias("id"), F.col("name"))
