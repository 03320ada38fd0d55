"""Trees given by materialised paths: flattening, roll-ups, hulls, re-rooting, splitting.

An area's path leaves the area itself out; a climb's path ends with its area.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import docs, geo, hulls, texts
from cairnfield.session import ship

#: The shift of a split-off wall in degrees of latitude; kilometres a degree; the extent from which a group is split.
SHIFT, KM_LON, KM_LAT, SPLIT_KM = 0.00009, 81.0, 111.0, 1.8


def subtree_counts(climbs: DataFrame) -> DataFrame:
    """area_id, climb_count: each climb (area_path) counts once for every area of its path."""
    return climbs.select(F.explode(F.array_distinct("area_path")).alias("area_id")).groupBy("area_id").agg(F.count("*").alias("climb_count"))


def subtree_kinds(climbs: DataFrame) -> DataFrame:
    """area_id, n_routes, n_boulders, extent_km, kind from climbs (area_path, kind, x, y)."""
    spread = climbs.select(F.explode(F.array_distinct("area_path")).alias("area_id"), "kind", "x", "y")
    boulder = F.col("kind") == "boulder"
    out = spread.groupBy("area_id").agg(
        F.count(F.when(~boulder, 1)).alias("n_routes"), F.count(F.when(boulder, 1)).alias("n_boulders"),
        F.when(F.count("x") < 2, 0.0).otherwise(F.greatest((F.max("x") - F.min("x")) * KM_LON, (F.max("y") - F.min("y")) * KM_LAT)).alias("extent_km"),
    )
    return out.withColumn("kind", F.when(F.col("n_boulders") >= F.col("n_routes"), "boulder").otherwise("route"))


def parents_with_children(areas: DataFrame) -> DataFrame:
    children = areas.select(F.col("parent_id").alias("area_id")).distinct()
    return areas.join(children, "area_id", "left_semi")


def flatten_tree(areas: DataFrame, depth: int = 5) -> tuple[DataFrame, DataFrame]:
    """Areas and climbs of nested area structs (uuid, area_name, metadata{lat,lng,mp_id}, climbs, children), level by level.

    Coordinates are inherited from the nearest ancestor that has them; 0 counts as missing. Leaf structs may lack `children`.
    """
    have = lambda m, k: F.nullif(m[k], F.lit(0.0))
    level = areas.select(F.struct("*").alias("a"), F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit(None).cast("double").alias("lng"), F.lit(None).cast("double").alias("lat"))
    areas_out, climbs_out = None, None
    for k in range(depth):
        level = level.withColumns({"lng": F.coalesce(have(F.col("a.metadata"), "lng"), "lng"), "lat": F.coalesce(have(F.col("a.metadata"), "lat"), "lat")})
        here = level.select(F.col("a.uuid").alias("area_id"), F.col("a.area_name").alias("name"), F.col("parent").alias("parent_id"), F.col("path").alias("area_path"), F.size("path").alias("depth"), "lng", "lat", F.col("a.metadata.mp_id").alias("mp_id"))
        areas_out = here if areas_out is None else areas_out.unionByName(here)
        inner = F.concat("path", F.array("a.uuid"))
        climbs = level.select(F.col("a.uuid").alias("area_id"), F.col("a.area_name").alias("area_name"), inner.alias("area_path"), F.col("lng").alias("area_lng"), F.col("lat").alias("area_lat"), F.explode("a.climbs").alias("c"))
        found = climbs.select(
            F.col("c.uuid").alias("climb_id"), F.col("c.name").alias("name"), "area_id", "area_name", "area_path", F.coalesce(have(F.col("c.metadata"), "lng"), "area_lng").alias("lng"), F.coalesce(have(F.col("c.metadata"), "lat"), "area_lat").alias("lat"),
            F.col("c.grade").alias("grade"), F.col("c.kind").alias("kind"), F.col("c.length_m").alias("length_m"),
        )
        climbs_out = found if climbs_out is None else climbs_out.unionByName(found)
        kind = level.schema["a"].dataType
        if "children" not in kind.names:
            break
        level = level.select(F.explode("a.children").alias("child"), inner.alias("path"), F.col("a.uuid").alias("parent"), "lng", "lat").withColumnRenamed("child", "a")
    return areas_out, climbs_out


def first_by_id(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key, in the given order."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_row")).select(key, "_row.*")


def climb_feature(climbs: DataFrame) -> DataFrame:
    """Feature rows of climbs: a layer by kind, a composite id, and the document. Lengths are feet as text, '' for none."""
    feet = F.bround(F.coalesce("length_m", F.lit(0.0)) * 3.281).cast("int")
    properties = docs.build(_draw_id=F.concat(F.lit("ob-"), "climb_id"), name=F.col("name"), grade=F.col("grade"), route_type=F.col("kind"), length_ft=F.when(feet > 0, feet.cast("string")).otherwise(""), area_name=F.col("area_name"), area_id=F.col("area_id"), area_path=F.col("area_path"))
    source = F.when(F.col("kind") == "boulder", "climbing_boulders").otherwise("climbing_routes")
    return climbs.select(source.alias("source"), "name", geo.geometry("Point", F.array(geo.point(F.col("lng"), F.col("lat")))).alias("geometry"), docs.text(properties).alias("properties"))


def reroot(areas: DataFrame, root_id: str, root_name: str, groups: dict[str, tuple[str, Column]]) -> DataFrame:
    """Hangs flat roots below a synthetic root and its groups.

    groups: id -> (name, which roots go there). Synthetic nodes of an earlier run are dropped first, also from paths, so a second run gives
    the same. Paths get the root's and the group's id in front, depth is the path's length, roots take their group as parent;
    the synthetic nodes carry climb counts and the mean point of what is below them.
    """
    synthetic = [root_id, *groups]
    old = areas.filter(~F.col("area_id").isin(synthetic))
    old = old.withColumn("area_path", F.filter("area_path", lambda p: ~p.isin(synthetic))).withColumn("parent_id", F.when(~F.col("parent_id").isin(synthetic), F.col("parent_id")))
    group = F.coalesce(*[F.when(test, F.lit(g)) for g, (_, test) in groups.items()])
    roots = old.filter(F.size("area_path") == 0).select(F.col("area_id").alias("_root"), group.alias("_group"))
    top = F.coalesce(F.get("area_path", F.lit(0)), F.col("area_id"))
    placed = old.withColumn("_top", top).join(roots, F.col("_top") == F.col("_root"), "left")
    prefix = F.array_compact(F.array(F.lit(root_id), F.col("_group")))
    moved = placed.withColumns({"parent_id": F.when(F.size("area_path") == 0, F.coalesce("_group", F.lit(root_id))).otherwise(F.col("parent_id")), "area_path": F.concat(prefix, "area_path")}).withColumn("depth", F.size("area_path"))
    below = moved.filter(F.col("area_id") == F.col("_root"))
    names = {root_id: root_name} | {g: n for g, (n, _) in groups.items()}
    node = below.select(F.explode(prefix).alias("area_id"), "climb_count", "lng", "lat").groupBy("area_id").agg(F.sum("climb_count").alias("climb_count"), F.avg("lng").alias("lng"), F.avg("lat").alias("lat"))
    label = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    made = node.withColumns({"name": label[F.col("area_id")], "parent_id": F.when(F.col("area_id") != root_id, F.lit(root_id)), "area_path": F.when(F.col("area_id") == root_id, F.array().cast("array<string>")).otherwise(F.array(F.lit(root_id)))}).withColumn("depth", F.size("area_path"))
    return moved.select(*areas.columns).unionByName(made.select(*areas.columns))


def mixed_walls(climbs: DataFrame) -> DataFrame:
    """area_id, n_routes, n_boulders, minority, split_id of areas that hold both kinds (climbs: area_id, kind).
    Routes keep the area on a tie."""
    boulder = F.col("kind") == "boulder"
    both = climbs.groupBy("area_id").agg(F.count(F.when(~boulder, 1)).alias("n_routes"), F.count(F.when(boulder, 1)).alias("n_boulders")).filter("n_routes > 0 and n_boulders > 0")
    minority = F.when(F.col("n_routes") >= F.col("n_boulders"), "boulder").otherwise("route")
    return both.withColumn("minority", minority).withColumn("split_id", texts.uuid_of(F.concat("area_id", F.lit(":"), "minority")))


def split_walls(areas: DataFrame, climbs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Splits mixed walls: the minority kind moves to a duplicate of the area; the boulders' side is shifted north a little.
    No climb is lost, and a second run finds nothing mixed."""
    mixed = mixed_walls(climbs)
    twins = areas.join(mixed, "area_id")
    boulders_move = F.col("minority") == "boulder"
    twin = twins.withColumns({"split_of": F.col("area_id"), "area_id": F.col("split_id"), "lat": F.col("lat") + F.when(boulders_move, SHIFT).otherwise(0.0), "name": F.concat("name", F.when(boulders_move, F.lit(" (boulders)")).otherwise(F.lit(" (routes)")))})
    kept = areas.join(mixed.select("area_id", "minority"), "area_id", "left").withColumns({"split_of": F.lit(None).cast("string"), "lat": F.col("lat") + F.when(F.col("minority") == "route", SHIFT).otherwise(0.0)})
    columns = [*areas.columns, "split_of"]
    moved = climbs.join(mixed.select("area_id", "minority", "split_id"), "area_id", "left")
    is_boulder = F.col("kind") == "boulder"
    moves = F.when(F.col("minority") == "boulder", is_boulder).when(F.col("minority") == "route", ~is_boulder).otherwise(False)
    out = moved.withColumn("area_id", F.when(moves, F.col("split_id")).otherwise(F.col("area_id")))
    if "area_path" in climbs.columns:
        last = F.col("area_path")
        out = out.withColumn("area_path", F.when(moves, F.concat(F.slice(last, 1, F.greatest(F.size(last) - 1, F.lit(0))), F.array("split_id"))).otherwise(last))
    if "lat" in climbs.columns:
        out = out.withColumn("lat", F.col("lat") + F.when(F.col("minority").isNotNull() & is_boulder, SHIFT).otherwise(0.0))
    return kept.select(*columns).unionByName(twin.select(*columns)), out.select(*climbs.columns)


#: Points of one group in a batch beyond which only their corners go on.
CORNERS = 32


def _corners(points: DataFrame, key: str) -> DataFrame:
    """The points (key, x, y, n) with those left out that are inside the convex hull of others of their group and batch; what is left
    carries the counts, the number and the latitudes of all."""
    kind = points.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            code = table[key].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            xy = np.stack([table["x"].to_numpy(), table["y"].to_numpy()], 1)
            n, m, sy, keep = table["n"].to_numpy().copy(), np.ones(len(code), np.int64), xy[:, 1].copy(), np.ones(len(code), bool)
            order = np.argsort(code, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if len(rows) <= CORNERS:
                    continue
                outline = {tuple(p) for p in hulls.convex(xy[rows]).tolist()}
                on = np.array([tuple(p) in outline for p in xy[rows].tolist()])
                inner, first = rows[~on], rows[on][0]
                for column in (n, m, sy):
                    column[first] += column[inner].sum()
                keep[inner] = False
            left = table.filter(pa.array(keep)).select([key, "x", "y"])
            for name, column in (("n", n), ("m", m), ("sy", sy)):
                left = left.append_column(name, pa.array(column[keep]))
            yield from left.to_batches()

    return points.mapInArrow(run, f"{key} {kind}, x double, y double, n long, m long, sy double")


def hull_of_groups(points: DataFrame, key: str, metres: float, shape: str = "convex", **options) -> DataFrame:
    """key, ring, n_points: a footprint around each group's points (x, y). Distinct corners are made before the shuffle, and for convex
    footprints points inside of others are left out before it, so a group of all points is no more than some corners a batch; rows without
    coordinates are left out."""
    ship(points.sparkSession)
    kind = points.schema[key].dataType.simpleString()
    distinct = points.filter("x is not null and y is not null").select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).groupBy(key, "x", "y").agg(F.count("*").alias("n"))
    few = _corners(distinct, key) if shape == "convex" else distinct.withColumns({"m": F.lit(1).cast("long"), "sy": F.col("y")})

    def ring(table: pa.Table) -> pa.Table:
        xy = np.stack([table["x"].to_numpy(), table["y"].to_numpy()], 1)
        mean = float(table["sy"].to_numpy().sum() / table["m"].to_numpy().sum())
        outline = hulls.footprint(xy[np.lexsort((xy[:, 1], xy[:, 0]))], metres, shape, **({"latitude": mean} | options))
        made = pa.array([[{"x": float(x), "y": float(y)} for x, y in outline]], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))
        return pa.table({key: table[key].slice(0, 1), "ring": made, "n_points": pa.array([int(np.sum(table["n"].to_numpy()))], pa.int64())})

    return few.groupBy(key).applyInArrow(ring, f"{key} {kind}, ring {geo.LINE}, n_points long")


def area_hulls(areas: DataFrame, climbs: DataFrame, metres: float = 30.0, shape: str = "convex", exclude: Sequence[str] = (), **options) -> DataFrame:
    """Footprints of all areas that have children, over the climbs below them; areas named in `exclude` get none."""
    parents = parents_with_children(areas).filter(~F.coalesce(F.col("name").isin(list(exclude)), F.lit(False)))
    spread = climbs.select(F.explode(F.array_distinct("area_path")).alias("area_id"), "x", "y").join(parents.select("area_id"), "area_id", "left_semi")
    return hull_of_groups(spread, "area_id", metres, shape, **options).join(parents.select("area_id", "parent_id", "name", "depth"), "area_id")


def sectors(areas: DataFrame, kinds: DataFrame, most_km: float = SPLIT_KM) -> DataFrame:
    """area_id, kind of the top-level groups; one wider than most_km that has children is replaced by these."""
    parents = areas.select(F.col("parent_id").alias("_p")).distinct()
    known = areas.join(kinds.select("area_id", "kind", "extent_km"), "area_id").join(parents, F.col("area_id") == F.col("_p"), "left")
    wide = known.filter((F.col("depth") == 0) & (F.col("extent_km") > most_km) & F.col("_p").isNotNull()).select(F.col("area_id").alias("_wide"))
    whole = known.filter(F.col("depth") == 0).join(wide, F.col("area_id") == F.col("_wide"), "left_anti")
    parts = known.join(wide, F.col("parent_id") == F.col("_wide"), "left_semi")
    return whole.select("area_id", "kind").unionByName(parts.select("area_id", "kind"))
