"""Entity matching and enrichment merges against outside catalogues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import docs, texts

#: Entries taken of a list, and characters of a review.
PHOTOS, PLACE_PHOTOS, REVIEWS, REVIEW_CHARS = 3, 5, 3, 280


def by_site_key(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """id, their_id of our sites (id, group, label) and theirs (their_id, group, label, pos): equal keys; on a collision the first of theirs wins."""
    key = texts.site_key(F.col("label"))
    first = theirs.withColumn("key", key).groupBy("group", "key").agg(F.min_by("their_id", F.struct("pos", "their_id")).alias("their_id"))
    return ours.withColumn("key", key).join(first, ["group", "key"], "left").select("id", "their_id")


def unmatched(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """side, group, prefix, number of the keys that only one side has."""
    key = texts.site_key(F.col("label"))
    a, b = ours.select("group", key.alias("key")).distinct(), theirs.select("group", key.alias("key")).distinct()
    only = lambda x, y, side: x.join(y, ["group", "key"], "left_anti").select(F.lit(side).alias("side"), "group", "key.prefix", "key.number")
    return only(a, b, "ours").unionByName(only(b, a, "theirs"))


def first_match(wanted: DataFrame, hits: DataFrame, top: int = 5) -> DataFrame:
    """id, hit_id of wanted (id, name): the first of the top hits (id, hit_id, pos, hit_name) whose name fits. Neither side is broadcast: packed files look much smaller than their rows are."""
    w = Window.partitionBy("id").orderBy("pos", "hit_id")
    ranked = hits.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= top)
    fits = wanted.hint("merge").join(ranked, "id").filter(texts.same_place(F.col("name"), F.col("hit_name")))
    return fits.groupBy("id").agg(F.min_by("hit_id", "_rank").alias("hit_id"))


def inside_first(hits: DataFrame, inside: Column) -> DataFrame:
    """id, hit_id: the first hit inside the area, else the first of all."""
    return hits.groupBy("id").agg(F.min_by("hit_id", F.struct((~F.coalesce(inside, F.lit(False))).cast("int"), "pos", "hit_id")).alias("hit_id"))


def by_map_id(places: DataFrame, catalogue: DataFrame) -> DataFrame:
    """id, their_id: the place (id, url) whose URL holds the catalogue's (their_id, map_id, pos) map id; the first of several."""
    found = places.select("id", F.regexp_extract("url", r"[?&]mapId=(-?\d+)", 1).alias("map_id")).filter("map_id <> ''")
    # one row a map: places and entries of one map are not multiplied
    firsts = catalogue.groupBy(F.col("map_id").cast("string").alias("map_id")).agg(F.min(F.struct("pos", "their_id")).alias("first"))
    return found.join(firsts, "map_id").groupBy("id").agg(F.min("first").alias("first")).select("id", "first.their_id")


def patch_by_id(features: DataFrame, values: DataFrame, allowed: list[str]) -> tuple[DataFrame, DataFrame]:
    """Features with allowed fields of a JSON document by _osm_id put into their properties; and the ids without a feature."""
    own = docs.field(docs.doc("properties"), "_osm_id")
    joined = features.join(values.select(F.col("osm_id").cast("string").alias("_v"), F.col("document").alias("_d")), own == F.col("_v"), "left")
    patched = joined.withColumn("properties", F.when(F.col("_v").isNotNull(), docs.text(docs.patch(docs.doc("properties"), docs.doc("_d"), allowed))).otherwise(F.col("properties"))).select(*features.columns)
    missing = values.select(F.col("osm_id").cast("string").alias("osm_id")).join(features.select(own.alias("osm_id")), "osm_id", "left_anti")
    return patched, missing


def travel_minutes(seconds: Column) -> Column:
    return F.bround(seconds / 60).cast("int")


def place_properties(p: Column) -> Column:
    """Document fields of a place (rating, userRatingCount, allowsDogs, accessibilityOptions, reviews): flags are 'Yes' or left out."""
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "Yes")
    reviews = F.transform(F.slice(F.coalesce(p["reviews"], F.array().cast("array<struct<author:string,rating:int,text:string>>")), 1, REVIEWS), lambda r: F.struct(r["author"].alias("author"), r["rating"].alias("rating"), F.substring(r["text"], 1, REVIEW_CHARS).alias("text")))
    return docs.compact(docs.build(google_rating=p["rating"], google_rating_count=p["userRatingCount"], google_dogs=yes(p["allowsDogs"]), google_wheelchair_parking=yes(p["accessibilityOptions"]["wheelchairAccessibleParking"]), google_reviews=reviews))


def site_properties(s: Column) -> Column:
    """Document fields of a catalogue's site (id, name, kind, amenities, price, schedule, photos); false amenities are left out."""
    photos = F.transform(F.slice(s["photos"], 1, PHOTOS), lambda p: F.coalesce(p["large_url"], p["medium_url"], p["original_url"]))
    inner = docs.compact(docs.build(name=s["name"], kind=s["kind"], firepit=s["firepit"], price_per_night=s["price"]["per_night"], check_in=s["schedule"]["check_in_time"], check_out=s["schedule"]["check_out_time"], photos=photos), drop_false=True)
    return docs.build(campflare_id=s["id"], campflare=docs.text(inner))
