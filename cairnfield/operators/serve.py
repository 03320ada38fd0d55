"""Serving queries: experience configuration, layers, radius search, staleness, availability, storage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnfield.functions import docs, geo, texts

#: Layers of the radius search, its radius in metres and its number of rows; nights of a stay; days until data is stale.
SEARCHED = ["campsites", "campsite_sites", "climbing_areas", "climbing_routes", "climbing_boulders"]
RADIUS, FOUND, NIGHTS, STALE_DAYS = 300.0, 20, 60, 30
OPEN, UNKNOWN = ["available", "first-come-first-serve"], ["unknown", "not-yet-released"]


def experience_layers(experiences: DataFrame, layers: DataFrame, templates: DataFrame, slug: str) -> DataFrame:
    """The layers of a public experience with their overrides, ordered; templates are a small dimension."""
    chosen = experiences.filter((F.col("slug") == slug) & F.col("is_public")).select(F.col("id").alias("_experience"))
    t = templates.select(F.col("slug").alias("_slug"), F.col("label").alias("_label"), "geom_type", F.col("layer_group").alias("_group"))
    joined = layers.join(F.broadcast(chosen), F.col("experience_id") == F.col("_experience"), "left_semi").join(t, F.col("template_slug") == F.col("_slug"))
    return joined.select(
        "id", "template_slug", F.coalesce("label_override", "_label").alias("label"), "geom_type", F.coalesce("layer_group_override", "_group").alias("layer_group"), "visible_by_default", "sort_order"
    ).orderBy("sort_order", "id")


def experience_config(experiences: DataFrame, layers: DataFrame, templates: DataFrame, slug: str) -> DataFrame:
    """One row, slug and config (JSON of the experience and its layers in order); no row for a private or unknown one."""
    rows = experience_layers(experiences, layers, templates, slug)
    packed = rows.agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", F.struct(*rows.columns).alias("layer")))).alias("l")).withColumn("layers", F.transform("l", lambda x: x["layer"]))
    chosen = experiences.filter((F.col("slug") == slug) & F.col("is_public"))
    return chosen.withColumn("_one", F.lit(1)).join(packed.withColumn("_one", F.lit(1)), "_one").select("slug", F.to_json(F.struct(F.struct(*[F.col(c) for c in experiences.columns]).alias("experience"), "layers")).alias("config"))


def layer(features: DataFrame, source: str) -> DataFrame:
    """A layer's rows; with a table partitioned by source, only its partition is read."""
    return features.filter(F.col("source") == source)


def served(features: DataFrame) -> DataFrame:
    """id, geometry, properties: the document as it is served, with id, photos and custom_data from their columns."""
    doc = docs.merge(docs.doc("properties"), docs.build(id=F.col("id"), photos=F.coalesce("photos", F.array().cast("array<string>")), custom_data=F.coalesce(F.try_parse_json("custom_data"), F.parse_json(F.lit("{}")))))
    return features.select("id", "geometry", docs.text(doc).alias("properties"))


def legacy_trails(trails: DataFrame) -> DataFrame:
    """Rows of the old trail table (osm_id, name, highway, surface, access, incline, line) as features; null tags are left out."""
    properties = docs.strip_nulls(docs.build(**{k: F.col(k) for k in ("name", "highway", "surface", "access", "incline")}, _osm_id=F.col("osm_id")))
    return trails.select(F.lit("trails").alias("source"), "osm_id", "name", geo.geometry("LineString", F.col("line")).alias("geometry"), docs.text(properties).alias("properties"))


def nearby(points: DataFrame, x: float, y: float, radius: float = RADIUS, sources: Sequence[str] | None = None, limit: int | None = FOUND) -> DataFrame:
    """id, source, name, distance_m of points (id, source, name, x, y) within a radius in metres, nearest first by the distance
    rounded to 0.1 m, then by id. A box in degrees goes to the scan, the exact distance after it."""
    import math

    dy = radius / 110_500.0
    dx = dy / max(math.cos(math.radians(min(89.0, abs(y) + dy))), 1e-6)
    some = points if sources is None else points.filter(F.col("source").isin(list(sources)))
    box = some.filter(F.col("x").between(x - dx, x + dx) & F.col("y").between(y - dy, y + dy))
    d = geo.metres(F.col("x"), F.col("y"), F.lit(x), F.lit(y))
    out = box.withColumn("d", d).filter(F.col("d") <= radius).select("id", "source", "name", F.round("d", 1).alias("distance_m")).orderBy("distance_m", "id")
    return out if limit is None else out.limit(limit)


def stale(rows: DataFrame, fetched: str, as_of: Column, days: int = STALE_DAYS) -> DataFrame:
    """Rows never fetched, or fetched over `days` days before `as_of`."""
    return rows.filter(F.col(fetched).isNull() | (F.col(fetched) < as_of - F.make_dt_interval(F.lit(days))))


def storage_used(objects: DataFrame, size: str) -> DataFrame:
    return objects.agg(F.coalesce(F.sum(F.col(size).cast("long")), F.lit(0)).alias("bytes"))


def nights(start: Column, end: Column, most: int = NIGHTS) -> Column:
    """Dates slept: from start to the day before end, one at least, `most` at most."""
    return F.slice(F.sequence(start, F.greatest(F.date_sub(end, 1), start)), 1, most)


def roll_up(statuses: Column) -> Column:
    """A stay's status from its nights' statuses."""
    is_open = F.size(F.filter(statuses, lambda s: s.isin(OPEN)))
    known = F.size(F.filter(statuses, lambda s: ~s.isin(UNKNOWN)))
    return F.when(F.size(statuses) == 0, "unknown").when(is_open == F.size(statuses), "available").when(is_open > 0, "partial").when(known > 0, "unavailable").otherwise("unknown")


def availability(site_nights: DataFrame, start: str, end: str) -> DataFrame:
    """site, status of each site (site, night, status) over a stay; a night without a row is unknown. One shuffle, by site."""
    stay = nights(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    grouped = site_nights.withColumn("_in", F.array_contains(stay, F.col("night"))).groupBy("site").agg(F.map_from_entries(F.collect_list(F.when(F.col("_in"), F.struct("night", "status")))).alias("m"))
    return grouped.select("site", roll_up(F.transform(stay, lambda n: F.coalesce(F.col("m").getItem(n), F.lit("unknown")))).alias("status"))


def latest(audit: DataFrame, limit: int = FOUND) -> DataFrame:
    """The last audit rows, newest first, ties by entity."""
    return audit.orderBy(F.desc("occurred_at"), "entity_id").limit(limit)


def longest(rows: DataFrame, length: str, key: str, limit: int) -> DataFrame:
    """The longest rows, ties by key (a report)."""
    return rows.orderBy(F.desc(length), key).limit(limit)


#: The keys by which layer_order() has rows in order.
LAYER_ORDER = ("other_layer", "through_trail", "pos")


def layer_order(rows: DataFrame, primary: str) -> DataFrame:
    """The rows with their keys LAYER_ORDER: whether they are of another layer than the primary one, whether they are through-trails, and their place."""
    return rows.withColumns({"other_layer": (F.col("source") != primary).cast("int"), "through_trail": F.col("through").cast("int")})


def ordered_layers(rows: DataFrame, primary: str) -> DataFrame:
    """Rows (source, through, pos): of the primary layer first, through-trails last, each in the order that they came in."""
    return layer_order(rows, primary).orderBy(*LAYER_ORDER).select(*rows.columns)


def upper_median(values: Column) -> Column:
    """The middle value of an array, of two the larger; null for none. Nulls do not count."""
    known = F.array_sort(F.array_compact(values))
    return F.get(known, F.floor(F.size(known) / 2).cast("int"))


def availability_response(request: DataFrame, site_nights: DataFrame) -> DataFrame:
    """request, status code, body of availability requests (request, campgrounds array, start, end as texts) over site_nights (campground, site, night, status):
    400 for dates that are none or stays that end before they start, else the sites' roll-ups as JSON."""
    start, end = texts.iso_date(F.col("start")), texts.iso_date(F.col("end"))
    asked = request.withColumns({"_from": start, "_to": end})
    good = asked.filter((F.col("_from") <= F.col("_to")) & (F.size("campgrounds") > 0))
    stays = good.select("request", nights(F.col("_from"), F.col("_to")).alias("stay"), F.explode("campgrounds").alias("campground"))
    sites = site_nights.select("campground", "site").distinct()
    each = stays.join(sites, "campground").select("request", "campground", "site", F.explode("stay").alias("night"))
    known = each.join(site_nights, ["campground", "site", "night"], "left").groupBy("request", "campground", "site").agg(F.collect_list(F.coalesce("status", F.lit("unknown"))).alias("s"))
    rolled = known.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("site", roll_up(F.col("s")).alias("status")))).alias("sites"))
    joined = asked.select("request", F.coalesce((F.col("_from") <= F.col("_to")) & (F.size("campgrounds") > 0), F.lit(False)).alias("_good")).join(rolled, "request", "left")
    none = F.array().cast("array<struct<site:" + site_nights.schema["site"].dataType.simpleString() + ",status:string>>")
    return joined.select("request", F.when(F.col("_good"), 200).otherwise(400).alias("code"), F.when(F.col("_good"), F.to_json(F.struct(F.coalesce("sites", none).alias("sites")))).alias("body"))
