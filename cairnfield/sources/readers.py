"""Readers of saved payloads: map elements, GeoJSON, area trees, paged services, keyed documents, statements.

All of them are Spark scans with explicit schemas; malformed records go to a quarantine instead of stopping a load. Live
fetching belongs in front of these: a payload saved once can be read again by any executor.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from cairnfield.functions import docs, geo
from cairnfield.operators import classify

COORD = "struct<lon:double,lat:double>"
ELEMENTS = f"elements array<struct<type:string,id:long,lon:double,lat:double,center:{COORD},tags:map<string,string>,geometry:array<{COORD}>,members:array<struct<type:string,role:string,geometry:array<{COORD}>>>>>, _bad string"
FEATURES = "features array<struct<type:string,geometry:string,properties:string>>, _bad string"
PAGE = FEATURES


def _json(spark: SparkSession, paths: str | list[str], schema: str | StructType, lines: bool = False) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(paths)


def _line(coords: Column) -> Column:
    return F.transform(coords, lambda c: geo.point(c["lon"], c["lat"]))


def elements(spark: SparkSession, paths: str | list[str], lines: bool = False) -> DataFrame:
    """One row an element of saved map responses, each a file or, if asked, a line."""
    return _json(spark, paths, ELEMENTS, lines).filter("_bad is null").select(F.explode("elements").alias("e")).select("e.*")


def rejected(spark: SparkSession, paths: str | list[str], schema: str = ELEMENTS, lines: bool = False) -> DataFrame:
    """path, record of files (or lines, if asked) that did not parse."""
    text = spark.read.text(paths, wholetext=not lines).select(F.input_file_name().alias("path"), "value")
    parsed = F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return text.filter(parsed["_bad"].isNotNull()).select("path", F.col("value").alias("record"))


def assemble(segments: Column) -> Column:
    """One closed ring from open segments, joined end to end as far as they go: at each step the first segment that continues the ring, as it
    is or reversed. What does not fit is dropped; the ring is closed by force; null under four points."""
    first = F.struct(F.get(segments, F.lit(0)).alias("ring"), F.slice(segments, 2, F.greatest(F.size(segments) - 1, F.lit(0))).alias("left"))

    def step(s: Column, _: Column) -> Column:
        tail = geo.end(s["ring"])
        numbered = F.transform(s["left"], lambda x, i: F.struct(i.alias("i"), x.alias("x")))
        fits = F.filter(numbered, lambda n: (geo.start(n["x"]) == tail) | (geo.end(n["x"]) == tail))
        n = F.get(fits, F.lit(0))
        way = F.when(geo.start(n["x"]) == tail, n["x"]).otherwise(F.reverse(n["x"]))
        grown = F.struct(F.concat(s["ring"], F.slice(way, 2, F.greatest(F.size(way) - 1, F.lit(0)))).alias("ring"), F.transform(F.filter(numbered, lambda m: m["i"] != n["i"]), lambda m: m["x"]).alias("left"))
        return F.when(F.size(fits) > 0, grown).otherwise(s)

    ring = F.aggregate(segments, first, step)["ring"]
    closed = F.when(geo.start(ring) == geo.end(ring), ring).otherwise(F.concat(ring, F.slice(ring, 1, 1)))
    return F.when(F.size(closed) >= 4, closed)


def features(elems: DataFrame) -> DataFrame:
    """Feature rows of tagged elements: source (bucket), fid, osm_id, name, geometry, properties. Closed ways of areas are polygons;
    relations are polygons of their closed outer rings, with the closed inner ones if there is one outer; others are left out."""
    tags = F.col("tags")
    line = _line(F.col("geometry"))
    closed = (F.size(line) >= 4) & (geo.start(line) == geo.end(line))
    one = F.array(F.lit(0))
    shape = lambda kind, parts, ring_of: F.struct(F.lit(kind).alias("type"), parts.alias("parts"), ring_of.alias("ring_of")).cast(geo.GEOMETRY)
    node = F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), shape("Point", F.array(F.array(geo.point(F.col("lon"), F.col("lat")))), one))
    way = F.when(F.size(line) > 0, F.when(closed & classify.is_area(tags), shape("Polygon", F.array(line), one)).otherwise(shape("LineString", F.array(line), one)))
    ways = F.filter(F.coalesce("members", F.array().cast(f"array<struct<type:string,role:string,geometry:array<{COORD}>>>")), lambda m: (m["type"] == "way") & (F.coalesce(F.size(m["geometry"]), F.lit(0)) > 0))
    ring_closed = lambda r: (geo.start(r) == geo.end(r)) & (F.size(r) >= 4)
    outer = F.transform(F.filter(ways, lambda m: ~F.coalesce(m["role"] == "inner", F.lit(False))), lambda m: _line(m["geometry"]))
    inner = F.filter(F.transform(F.filter(ways, lambda m: m["role"] == "inner"), lambda m: _line(m["geometry"])), ring_closed)
    whole, open_ = F.filter(outer, ring_closed), F.filter(outer, lambda r: ~ring_closed(r))
    joined = F.when(F.size(open_) > 0, assemble(open_))
    rings = F.when(joined.isNotNull(), F.concat(whole, F.array(joined))).otherwise(whole)
    relation = F.when(F.size(rings) == 1, shape("Polygon", F.concat(rings, inner), F.transform(F.concat(rings, inner), lambda _: F.lit(0)))).when(F.size(rings) > 1, shape("MultiPolygon", rings, F.transform(rings, lambda _, i: i)))
    geometry = F.when(F.col("type") == "node", node).when(F.col("type") == "way", way).when(F.col("type") == "relation", relation)
    properties = docs.merge(F.from_json(F.to_json(tags), "map<string,variant>"), docs.build(_osm_type=F.col("type"), _osm_id=F.col("id")))
    made = elems.filter(F.coalesce(F.size("tags"), F.lit(0)) > 0).select(
        classify.bucket(tags).alias("source"), F.concat_ws("/", "type", "id").alias("fid"), F.col("id").alias("osm_id"), tags.getItem("name").alias("name"), geometry.alias("geometry"), docs.text(properties).alias("properties")
    )
    return made.filter("geometry is not null")


def points(elems: DataFrame) -> DataFrame:
    """Elements as points: their own place or their centre; untagged ones stay, those without a place are left out."""
    at = elems.withColumns({"x": F.coalesce("lon", "center.lon"), "y": F.coalesce("lat", "center.lat")}).filter("x is not null and y is not null")
    return at.select(F.concat_ws("/", "type", "id").alias("fid"), F.col("id").alias("osm_id"), F.col("tags").getItem("name").alias("name"), "x", "y", "tags")


def geojson_geometry(text: Column) -> Column:
    """A GeoJSON geometry as a geometry struct; null, and collections, as null."""
    kind = F.get_json_object(text, "$.type")
    coords = F.get_json_object(text, "$.coordinates")
    pt = lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))
    line = lambda c: F.transform(c, pt)
    c1, c2, c3, c4 = (F.from_json(coords, "array<" * n + "double" + ">" * n) for n in (1, 2, 3, 4))
    zero = lambda a: F.transform(a, lambda _: F.lit(0))
    shape = lambda parts, of: F.struct(kind.alias("type"), parts.alias("parts"), of.alias("ring_of")).cast(geo.GEOMETRY)
    lines = F.transform(c3, line)
    rings = F.flatten(F.transform(c4, lambda p: F.transform(p, line)))
    of = F.flatten(F.transform(c4, lambda p, i: F.transform(p, lambda _: i)))
    return (
        F.when(kind == "Point", shape(F.array(F.array(pt(c1))), F.array(F.lit(0)))).when(kind.isin("LineString", "MultiPoint"), shape(F.array(line(c2)), F.array(F.lit(0))))
        .when(kind.isin("Polygon", "MultiLineString"), shape(lines, zero(lines))).when(kind == "MultiPolygon", shape(rings, of))
    )


def to_geojson(g: Column) -> Column:
    """A geometry struct as GeoJSON text."""
    pt = lambda p: F.array(p["x"], p["y"])
    lines = F.transform(g["parts"], lambda r: F.transform(r, pt))
    polygons = F.transform(F.array_distinct(g["ring_of"]), lambda k: F.transform(F.filter(F.arrays_zip(g["parts"].alias("r"), g["ring_of"].alias("k")), lambda z: z["k"] == k), lambda z: F.transform(z["r"], pt)))
    body = lambda coords: F.to_json(F.struct(g["type"].alias("type"), coords.alias("coordinates")))
    first = F.get(lines, F.lit(0))
    return F.when(g["type"] == "Point", body(F.get(first, F.lit(0)))).when(g["type"].isin("LineString", "MultiPoint"), body(first)).when(g["type"] == "MultiPolygon", body(polygons)).when(g.isNotNull(), body(lines))


def geojson(spark: SparkSession, paths: str | list[str], skip: list[str] | None = None, include: list[str] | None = None, lines: bool = False) -> DataFrame:
    """source (the stem of the file, or of the folder that it is a part of), geometry, properties of every feature of GeoJSON files, each a collection or, if asked, a line; rows
    without a geometry stay."""
    read = _json(spark, paths, FEATURES, lines).filter("_bad is null").select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:geo)?json(?:/[^/]*)?$", 1).alias("source"), F.explode("features").alias("f"))
    if skip:
        read = read.filter(~F.col("source").isin(skip))
    if include:
        read = read.filter(F.col("source").isin(include))
    return read.select("source", geojson_geometry(F.col("f.geometry")).alias("geometry"), F.coalesce("f.properties", F.lit("{}")).alias("properties"))


def layer_files(spark: SparkSession, folder: str, include: list[str] | None = None, skip: list[str] | None = None) -> dict[str, str]:
    """layer -> path of the GeoJSON files of a folder (a layer is a file's stem), those asked for; a layer that was written in parts is a folder. Names only are listed, by Hadoop's
    file system, so that folders in any store can be read."""
    return {k: path for k, (path, _) in _layers(spark, folder, include, skip).items()}


def _layers(spark: SparkSession, folder: str, include: list[str] | None, skip: list[str] | None) -> dict[str, tuple[str, bool]]:
    """layer -> path of its file, and whether that is a folder of parts."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    found = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(folder, "*.{geojson,json}")) or []
    named = {re.sub(r"\.(geo)?json$", "", f.getPath().getName()): (f.getPath().toString(), f.isDirectory()) for f in found}
    return {k: p for k, p in sorted(named.items()) if (not include or k in include) and k not in (skip or ())}


def geojson_folder(spark: SparkSession, folder: str, include: list[str] | None = None, skip: list[str] | None = None) -> DataFrame:
    """source (the layer), geometry, properties of the layers of a folder of GeoJSON files; files that are not asked for are not opened."""
    found = _layers(spark, folder, include, skip).values()
    read = [geojson(spark, paths, lines=parts) for parts in (False, True) if (paths := [p for p, in_parts in found if in_parts == parts])]
    if read:
        return reduce(DataFrame.unionByName, read)
    return spark.createDataFrame([], f"source string, geometry {geo.GEOMETRY}, properties string")


def pages(spark: SparkSession, paths: str | list[str], rename: dict[str, str]) -> DataFrame:
    """geometry, properties of a paged feature service's saved pages: fields renamed, null and empty ones and features without a geometry dropped."""
    read = _json(spark, paths, PAGE).filter("_bad is null").select(F.explode("features").alias("f")).filter("f.geometry is not null and f.geometry <> 'null'")
    document = docs.compact(docs.doc(F.col("f.properties")))
    for old, new in rename.items():
        document = docs.rename(document, old, new)
    return read.select(geojson_geometry(F.col("f.geometry")).alias("geometry"), docs.text(document).alias("properties"))


def area_schema(depth: int = 5) -> StructType:
    """Nested areas to a fixed depth."""
    climb = StructType.fromDDL("uuid string, name string, grade string, kind string, length_m double, metadata struct<lat:double,lng:double,mp_id:string>")
    fields = [StructField("uuid", StringType()), StructField("area_name", StringType()), StructField("metadata", StructType.fromDDL("lat double, lng double, mp_id string")), StructField("climbs", ArrayType(climb))]
    schema = StructType(fields)
    for _ in range(depth - 1):
        schema = StructType([*fields, StructField("children", ArrayType(schema))])
    return schema


def area_tree(spark: SparkSession, paths: str | list[str], depth: int = 5) -> DataFrame:
    """Top-level areas of saved trees, one JSON object a file or line, for hierarchy.flatten_tree()."""
    return spark.read.schema(area_schema(depth)).json(paths)


def backfill(rows: DataFrame, looked_up: DataFrame, key: str, column: str) -> DataFrame:
    """A column's missing values from a second lookup, by key."""
    return rows.join(looked_up.select(key, F.col(column).alias("_found")), key, "left").withColumn(column, F.coalesce(column, "_found")).drop("_found")


def keyed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """key, document of files that hold one JSON object of objects by id."""
    text = spark.read.text(paths, wholetext=True).select(F.from_json("value", "map<string,variant>").alias("m"))
    return text.select(F.explode("m").alias("key", "v")).select("key", F.to_json("v").alias("document"))


def statements(spark: SparkSession, paths: str | list[str], table: str) -> DataFrame:
    """properties (JSON) of rows inserted by generated SQL statements into a table; doubled quotes are one."""
    text = spark.read.text(paths).filter(F.lower("value").contains(f"insert into {table.lower()}") | F.col("value").rlike(r"^\s*\("))
    body = F.regexp_extract("value", r"'(\{(?:[^']|'')*\})'", 1)
    return text.select(F.regexp_replace(body, "''", "'").alias("properties")).filter("properties <> ''")


def status_of(status: Column) -> Column:
    """An imagery lookup's status: ok, none, or null for what should be asked again."""
    return F.when(status == "OK", "ok").when(status.isin("ZERO_RESULTS", "NOT_FOUND"), "none")


def feature_lines(spark: SparkSession, path: str) -> DataFrame:
    """source (a partition folder), geometry, properties of line-delimited features, as writers.geojson_lines() leaves them."""
    read = spark.read.schema("geometry string, properties string, source string").json(path)
    return read.select("source", geojson_geometry(F.col("geometry")).alias("geometry"), F.coalesce("properties", F.lit("{}")).alias("properties"))


def dem_tiles(boxes: DataFrame, have: DataFrame, misses: DataFrame) -> DataFrame:
    """tile, state (cached, none or fetch) of the height windows asked for (x0, y0, x1, y1, width, height): a tile's name is the digest of its box and size, so
    windows asked for twice are one; those known to have no coverage are not asked for again."""
    box = F.concat_ws(",", *[F.format_string("%.6f", c) for c in ("x0", "y0", "x1", "y1")], F.col("width").cast("string"), F.col("height").cast("string"))
    named = boxes.select(F.md5(box).alias("tile")).distinct()
    known = have.select("tile", F.lit("cached").alias("state")).unionByName(misses.select("tile", F.lit("none").alias("state"))).groupBy("tile").agg(F.min("state").alias("state"))
    return named.join(known, "tile", "left").select("tile", F.coalesce("state", F.lit("fetch")).alias("state"))


def within_budget(calls: DataFrame, most: int) -> DataFrame:
    """The calls of an outside service, if they are no more than the budget; none is made beyond it."""
    if (n := calls.count()) > most:
        raise ValueError(f"{n} calls are over the budget of {most}")
    return calls
