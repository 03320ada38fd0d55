"""Roll-ups, hulls and rewrites of the area tree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import geo
from cairnfield.operators import hierarchy
from cairnfield.plans import views as v


def subtree_climb_counts(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.subtree_counts(v.climbs(spark, sf))


def subtree_kinds(spark: SparkSession, sf: str) -> DataFrame:
    k = hierarchy.subtree_kinds(v.climbs(spark, sf))
    return k.withColumn("extent_km", F.round("extent_km", 4))


def parents_with_children(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.parents_with_children(v.areas(spark, sf)).select("area_id", "depth")


def mixed_walls(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.mixed_walls(v.climbs(spark, sf))


def mixed_wall_split(spark: SparkSession, sf: str) -> DataFrame:
    """Climbs by area after the split."""
    a = v.areas(spark, sf).withColumn("lat", F.lit(43.4))
    _, c = hierarchy.split_walls(a, v.climbs(spark, sf))
    return c.groupBy("area_id", "kind").agg(F.count("*").alias("n"))


def mixed_wall_areas(spark: SparkSession, sf: str) -> DataFrame:
    a = v.areas(spark, sf).withColumn("lat", F.lit(43.4))
    areas, _ = hierarchy.split_walls(a, v.climbs(spark, sf))
    return areas.groupBy("depth").agg(F.count("*").alias("n"), F.count("split_of").alias("n_split"), F.count(F.when(F.col("lat") > 43.4, 1)).alias("n_shifted"))


def reroot_paths(spark: SparkSession, sf: str) -> DataFrame:
    counts = hierarchy.subtree_counts(v.climbs(spark, sf))
    a = v.areas(spark, sf).join(counts, "area_id", "left").withColumns({"climb_count": F.coalesce("climb_count", F.lit(0)), "lng": F.lit(-89.7), "lat": F.lit(43.4)})
    out = hierarchy.reroot(a, "top", "Everything", {"east": ("East", F.col("area_id").isin("r0", "r1")), "west": ("West", F.lit(True))})
    return out.select("area_id", "parent_id", F.array_join("area_path", "/").alias("path"), "depth", "climb_count")


def first_names(spark: SparkSession, sf: str) -> DataFrame:
    """The first order of every customer and priority, by date and key."""
    o = v.table(spark, sf, "orders").select(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority").alias("k"), "o_orderdate", "o_orderkey")
    return hierarchy.first_by_id(o, "k", ["o_orderdate", "o_orderkey"]).select("k", "o_orderkey")


def campground_footprint_stats(spark: SparkSession, sf: str) -> DataFrame:
    c = v.campgrounds(spark, sf)
    return c.groupBy("nation").agg(
        F.initcap(F.lower(F.min("source"))).alias("first_source"), F.count("*").alias("n"), F.count(F.when(F.col("source") == "BUILDING", 1)).alias("n_building"), F.round(F.min("x"), 6).alias("minx"), F.round(F.max("x"), 6).alias("maxx"),
        F.round(F.min("y"), 6).alias("miny"), F.round(F.max("y"), 6).alias("maxy"), F.round(F.avg("x"), 6).alias("cx"), F.round(F.avg("y"), 6).alias("cy"),
    )


def _area(h: DataFrame, key: str) -> DataFrame:
    return h.select(key, "n_points", F.size("ring").alias("corners"), F.round(geo.shoelace(F.col("ring")) * 1e6, 3).alias("area"))


def hull_convex(spark: SparkSession, sf: str) -> DataFrame:
    """Footprints of campgrounds by nation."""
    return _area(hierarchy.hull_of_groups(v.campgrounds(spark, sf), "nation", 25.0), "nation")


def hull_area_parents(spark: SparkSession, sf: str) -> DataFrame:
    return _area(hierarchy.area_hulls(v.areas(spark, sf), v.climbs(spark, sf)), "area_id")


def hull_concave(spark: SparkSession, sf: str) -> DataFrame:
    return _area(hierarchy.hull_of_groups(v.campgrounds(spark, sf), "nation", 55.0, "concave", ratio=0.45, tolerance=6.0, digits=6), "nation")


def sector_classes(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.sectors(v.areas(spark, sf), hierarchy.subtree_kinds(v.climbs(spark, sf)))


QUERIES = {f.__name__: f for f in (
    subtree_climb_counts, subtree_kinds, parents_with_children, mixed_walls, mixed_wall_split, mixed_wall_areas, reroot_paths, first_names, campground_footprint_stats, hull_convex, hull_area_parents, hull_concave, sector_classes,
)}

_SPREAD = f"(SELECT unnest(area_path) AS area_id, kind, x, y FROM {v.CLIMBS})"
_KINDS = f"(SELECT area_id, count(*) FILTER (kind <> 'boulder') AS n_routes, count(*) FILTER (kind = 'boulder') AS n_boulders, CASE WHEN count(*) < 2 THEN 0.0::DOUBLE ELSE greatest((max(x) - min(x)) * 81.0::DOUBLE, (max(y) - min(y)) * 111.0::DOUBLE) END AS extent FROM {_SPREAD} GROUP BY area_id)"
_UUID = "regexp_replace(md5(area_id || ':' || minority), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"
_MIXED = f"(SELECT *, {_UUID} AS split_id FROM (SELECT area_id, count(*) FILTER (kind <> 'boulder') AS n_routes, count(*) FILTER (kind = 'boulder') AS n_boulders, CASE WHEN n_routes >= n_boulders THEN 'boulder' ELSE 'route' END AS minority FROM {v.CLIMBS} GROUP BY area_id HAVING n_routes > 0 AND n_boulders > 0))"
_COUNTS = f"(SELECT area_id, count(*) AS n FROM {_SPREAD} GROUP BY area_id)"
ORACLES = {
    "subtree_climb_counts": f"SELECT area_id, count(*) AS climb_count FROM {_SPREAD} GROUP BY area_id",
    "subtree_kinds": f"SELECT area_id, n_routes, n_boulders, round(extent, 4) AS extent_km, CASE WHEN n_boulders >= n_routes THEN 'boulder' ELSE 'route' END AS kind FROM {_KINDS}",
    "parents_with_children": f"SELECT area_id, depth FROM {v.AREAS} AS a WHERE EXISTS (SELECT 1 FROM {v.AREAS} AS b WHERE b.parent_id = a.area_id)",
    "mixed_walls": f"SELECT area_id, n_routes, n_boulders, minority, split_id FROM {_MIXED}",
    "mixed_wall_split": f"SELECT CASE WHEN minority = kind THEN split_id ELSE c.area_id END AS area_id, kind, count(*) AS n FROM {v.CLIMBS} AS c LEFT JOIN {_MIXED} AS m ON c.area_id = m.area_id GROUP BY ALL",
    "mixed_wall_areas": f"SELECT depth, count(*) AS n, count(split_of) AS n_split, count(*) FILTER (shifted) AS n_shifted FROM (SELECT depth, NULL AS split_of, coalesce(minority = 'route', false) AS shifted FROM {v.AREAS} AS a LEFT JOIN {_MIXED} AS m ON a.area_id = m.area_id UNION ALL SELECT depth, a.area_id, minority = 'boulder' FROM {v.AREAS} AS a JOIN {_MIXED} AS m ON a.area_id = m.area_id) GROUP BY depth",
    "reroot_paths": f"""SELECT a.area_id, CASE WHEN depth = 0 THEN g ELSE parent_id END AS parent_id, array_to_string(list_concat(['top', g], area_path), '/') AS path, depth + 2 AS depth, coalesce(n, 0) AS climb_count
      FROM (SELECT *, CASE WHEN coalesce(area_path[1], area_id) IN ('r0', 'r1') THEN 'east' ELSE 'west' END AS g FROM {v.AREAS}) AS a LEFT JOIN {_COUNTS} AS c ON a.area_id = c.area_id
      UNION ALL SELECT CASE WHEN r IN ('r0', 'r1') THEN 'east' ELSE 'west' END, 'top', 'top', 1, sum(n)::BIGINT FROM (SELECT 'r' || r_regionkey AS r FROM region) JOIN {_COUNTS} ON r = area_id GROUP BY 1
      UNION ALL SELECT 'top', NULL, '', 0, sum(n)::BIGINT FROM {_COUNTS} WHERE area_id LIKE 'r%'""",
    "first_names": "SELECT o_custkey || '|' || o_orderpriority AS k, first(o_orderkey ORDER BY o_orderdate, o_orderkey) AS o_orderkey FROM orders GROUP BY 1",
    "campground_footprint_stats": f"SELECT nation, upper(min(source)[1]) || lower(min(source)[2:]) AS first_source, count(*) AS n, count(*) FILTER (source = 'BUILDING') AS n_building, round(min(x), 6) AS minx, round(max(x), 6) AS maxx, round(min(y), 6) AS miny, round(max(y), 6) AS maxy, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM {v.CAMPGROUNDS} GROUP BY nation",
    "sector_classes": f"""WITH k AS (SELECT a.*, n_routes, n_boulders, extent FROM {v.AREAS} AS a JOIN {_KINDS} AS k ON a.area_id = k.area_id), w AS (SELECT area_id FROM k WHERE depth = 0 AND extent > 1.8)
      SELECT area_id, CASE WHEN n_boulders >= n_routes THEN 'boulder' ELSE 'route' END AS kind FROM k WHERE depth = 0 AND area_id NOT IN (FROM w) OR parent_id IN (FROM w)""",
}
