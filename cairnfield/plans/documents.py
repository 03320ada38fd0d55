"""Document algebra, photos, labels and other scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import docs, geo, texts
from cairnfield.operators import enrich, merge, serve
from cairnfield.plans import views as v
from cairnfield.sources import readers


def _events(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events")
    other = F.to_json(F.struct(F.when(F.col("event_id") % 3 == 0, F.col("user_id")).alias("k"), F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("t"), F.when(F.col("event_id") % 7 == 0, F.lit("")).alias("e")))
    return e.select("event_id", "user_id", "event_type", F.col("props").alias("a"), other.alias("b"))


def doc_merge(spark: SparkSession, sf: str) -> DataFrame:
    m = docs.merge(docs.doc("a"), docs.doc("b"))
    return _events(spark, sf).withColumn("m", m).select("event_id", docs.field(F.col("m"), "k", "long").alias("k"), docs.field(F.col("m"), "t").alias("t"), F.size(F.map_keys("m")).alias("n_keys"))


def doc_patch(spark: SparkSession, sf: str) -> DataFrame:
    m = docs.patch(docs.doc("a"), docs.doc("b"), ["k"])
    return _events(spark, sf).withColumn("m", m).select("event_id", docs.field(F.col("m"), "k", "long").alias("k"), docs.has(F.col("m"), "t").alias("has_t"))


def doc_set_key(spark: SparkSession, sf: str) -> DataFrame:
    m = docs.without(docs.put(docs.doc("a"), "u", F.col("user_id")), "k")
    return _events(spark, sf).withColumn("m", m).select("event_id", docs.field(F.col("m"), "u", "long").alias("u"), docs.has(F.col("m"), "k", "t").alias("has_k_or_t"))


def doc_strip_nulls(spark: SparkSession, sf: str) -> DataFrame:
    built = docs.build(k=F.when(F.col("event_id") % 3 == 0, F.col("user_id")), t=F.when(F.col("event_id") % 2 == 0, F.col("event_type")), e=F.lit(""))
    return _events(spark, sf).select("event_id", F.size(F.map_keys(built)).alias("n_built"), F.size(F.map_keys(docs.strip_nulls(built))).alias("n_stripped"), F.size(F.map_keys(docs.compact(built))).alias("n_compact"))


def doc_rename_key(spark: SparkSession, sf: str) -> DataFrame:
    m = docs.rename(docs.doc("b"), "t", "kind")
    return _events(spark, sf).withColumn("m", m).select("event_id", docs.field(F.col("m"), "kind").alias("kind"), docs.has(F.col("m"), "t").alias("has_t"))


def doc_promote(spark: SparkSession, sf: str) -> DataFrame:
    top, custom = docs.promote(docs.doc("a"), docs.doc("b"), ["k", "t"])
    return _events(spark, sf).withColumns({"top": top, "custom": custom}).select("event_id", docs.field(F.col("top"), "k", "long").alias("k"), docs.field(F.col("top"), "t").alias("t"), F.size(F.map_keys("custom")).alias("n_custom"))


def json_sum(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "events").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k_sum"))


def array_contains_object(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a line of quantity over 45 from an even supplier, asked of an array of objects."""
    lines = v.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct((F.col("l_quantity") > 45).alias("big"), (F.col("l_suppkey") % 2).alias("odd"))).alias("l"))
    return lines.filter(docs.contains_object(F.col("l"), big=F.lit(True), odd=F.lit(0))).select("l_orderkey")


def array_register(spark: SparkSession, sf: str) -> DataFrame:
    """A field registered twice is there once, at the end."""
    lines = v.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("name"), F.col("l_partkey").alias("part")))).alias("l"))
    new = F.struct(F.lit(3).alias("name"), F.lit(-1).cast("long").alias("part"))
    twice = docs.registered(docs.registered(F.col("l"), "name", new), "name", new)
    return lines.select("l_orderkey", F.size(twice).alias("n"), F.element_at(twice, -1)["part"].alias("last_part"))


def photo_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Galleries of users' events (views are ours, others a community's), with a fresh photo for even users."""
    e = v.table(spark, sf, "events")
    source = F.when(F.col("event_type") == "view", "google").otherwise("community")
    meta = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", F.struct(F.concat(F.lit("u"), F.col("event_id").cast("string")).alias("url"), F.col("event_type").alias("caption"), source.alias("source")).alias("m")))).alias("s"))
    fresh = F.when(F.col("user_id") % 2 == 0, F.array(F.struct(F.lit("new").alias("url"), F.lit("").alias("caption"), F.lit("google").alias("source"))))
    merged = merge.merge_photos(F.transform("s", lambda x: x["m"]), fresh)
    return meta.select("user_id", F.array_join(F.transform(merged, lambda m: m["url"]), ",").alias("urls"))


def enrichment_applied(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as campgrounds, enriched from suppliers of the same key."""
    c = v.table(spark, sf, "customer")
    table = c.select(
        F.col("c_custkey").alias("id"), F.concat(F.lit('{"rating":1,"name":"'), "c_name", F.lit('"}')).alias("properties"), F.lit('{"note":1}').alias("custom_data"), F.array(F.lit("old"), F.lit("ours")).alias("photos"),
        F.array(F.struct(F.lit("old").alias("url"), F.lit("").alias("caption"), F.lit("google").alias("source")), F.struct(F.lit("ours").alias("url"), F.lit("").alias("caption"), F.lit("community").alias("source"))).alias("photo_meta"),
    )
    k = F.col("s_suppkey")
    fresh = F.when(k % 2 == 0, F.array(F.struct(F.concat(F.lit("g"), k.cast("string")).alias("url"), F.lit("").alias("caption"), F.lit("google").alias("source"))))
    values = v.table(spark, sf, "supplier").select(k.alias("id"), F.concat(F.lit('{"rating":'), (k % 5).cast("string"), F.lit("}")).alias("props"), fresh.alias("fresh"), F.concat(F.lit("p"), k.cast("string")).alias("place_id"))
    out = merge.apply_enrichment(table, values, F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return out.select("id", docs.field(docs.doc("properties"), "rating", "long").alias("rating"), F.array_join("photos", ",").alias("photos"), F.get_json_object("custom_data", "$.google.place_id").alias("place_id"), F.get_json_object("custom_data", "$.note").alias("note"))


def top_photos(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("s"))
    return e.select("user_id", F.array_join(F.transform(F.slice("s", 1, 5), lambda x: x["event_id"].cast("string")), ",").alias("first_five"))


def route_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels from each user's event types, as trail names."""
    e = v.table(spark, sf, "events").filter("value > 250").groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat(F.initcap("event_type"), F.when(F.col("event_type") == "view", " Loop").otherwise(" Trail")))).alias("names"))
    return e.select("user_id", texts.route_label(F.col("names")).alias("label"))


def climb_kinds(spark: SparkSession, sf: str) -> DataFrame:
    p, k = v.table(spark, sf, "part"), F.col("p_partkey")
    return p.select("p_partkey", texts.climb_kind(k % 5 == 0, trad=k % 2 == 0, sport=k % 3 == 0, alpine=k % 7 == 0).alias("kind"))


def travel_minutes(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders")
    seconds = F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey") % 7200)
    return o.select("o_orderkey", enrich.travel_minutes(seconds).alias("minutes"))


def stay_nights(spark: SparkSession, sf: str) -> DataFrame:
    o = v.table(spark, sf, "orders")
    start = F.to_date("o_orderdate")
    n = serve.nights(start, F.date_add(start, (F.col("o_orderkey") % 80 - 5).cast("int")))
    return o.select("o_orderkey", F.size(n).alias("n"), F.date_format(F.element_at(n, -1), "yyyy-MM-dd").alias("last"))


def geojson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Trails written as GeoJSON and read again."""
    t = v.trails(spark, sf).select("id", geo.geometry("LineString", F.col("line")).alias("g"))
    again = readers.geojson_geometry(readers.to_geojson(F.col("g")))
    return t.select("id", F.size(F.get(again["parts"], F.lit(0))).alias("n"), F.round(geo.start(F.get(again["parts"], F.lit(0)))["x"], 6).alias("x"), (again == F.col("g").cast(geo.GEOMETRY)).alias("same"))


QUERIES = {f.__name__: f for f in (
    doc_merge, doc_patch, doc_set_key, doc_strip_nulls, doc_rename_key, doc_promote, json_sum, array_contains_object, array_register, photo_merge, enrichment_applied, top_photos, route_labels, climb_kinds, travel_minutes, stay_nights, geojson_round_trip,
)}

_B = "CASE WHEN event_id % 3 = 0 THEN user_id ELSE (props::JSON->>'k')::BIGINT END"
ORACLES = {
    "doc_merge": f"SELECT event_id, {_B} AS k, CASE WHEN event_id % 2 = 0 THEN event_type END AS t, (1 + (event_id % 2 = 0)::INTEGER + (event_id % 7 = 0)::INTEGER)::INTEGER AS n_keys FROM events",
    "doc_patch": f"SELECT event_id, {_B} AS k, false AS has_t FROM events",
    "doc_set_key": "SELECT event_id, user_id AS u, false AS has_k_or_t FROM events",
    "doc_strip_nulls": "SELECT event_id, 3 AS n_built, (1 + (event_id % 3 = 0)::INTEGER + (event_id % 2 = 0)::INTEGER)::INTEGER AS n_stripped, ((event_id % 3 = 0)::INTEGER + (event_id % 2 = 0)::INTEGER)::INTEGER AS n_compact FROM events",
    "doc_rename_key": "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type END AS kind, false AS has_t FROM events",
    "doc_promote": "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, CASE WHEN event_id % 2 = 0 THEN event_type END AS t, (event_id % 7 = 0)::INTEGER AS n_custom FROM events",
    "json_sum": "SELECT sum((props::JSON->>'k')::BIGINT)::BIGINT AS k_sum FROM events",
    "array_contains_object": "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45 AND l_suppkey % 2 = 0",
    "array_register": "SELECT l_orderkey, (count(*) FILTER (l_linenumber <> 3) + 1)::INTEGER AS n, -1::BIGINT AS last_part FROM lineitem GROUP BY l_orderkey",
    "photo_merge": "SELECT user_id, CASE WHEN user_id % 2 = 0 THEN concat_ws(',', string_agg('u' || event_id, ',' ORDER BY event_id) FILTER (event_type <> 'view'), 'new') ELSE string_agg('u' || event_id, ',' ORDER BY event_id) END AS urls FROM events GROUP BY user_id",
    "enrichment_applied": "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN 1 ELSE s_suppkey % 5 END::BIGINT AS rating, CASE WHEN s_suppkey % 2 = 0 THEN 'ours,g' || s_suppkey ELSE 'old,ours' END AS photos, 'p' || s_suppkey AS place_id, '1' AS note FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey",
    "top_photos": "SELECT user_id, array_to_string(list_slice(list(event_id ORDER BY ts, event_id), 1, 5), ',') AS first_five FROM events GROUP BY user_id",
    "route_labels": "SELECT user_id, CASE WHEN contains(lower(s), 'loop') THEN s ELSE s || ' Loop' END AS label FROM (SELECT user_id, array_to_string(list_transform(list_slice(list(name ORDER BY name), 1, 3), lambda n: replace(n, ' Trail', '')), ' + ') AS s FROM (SELECT DISTINCT user_id, upper(event_type[1]) || event_type[2:] || CASE WHEN event_type = 'view' THEN ' Loop' ELSE ' Trail' END AS name FROM events WHERE value > 250) GROUP BY user_id)",
    "climb_kinds": "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'boulder' ELSE coalesce(nullif(concat_ws('/', CASE WHEN p_partkey % 2 = 0 THEN 'trad' END, CASE WHEN p_partkey % 3 = 0 THEN 'sport' END, CASE WHEN p_partkey % 7 = 0 THEN 'alpine' END), ''), 'unknown') END AS kind FROM part",
    "travel_minutes": "SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN round_even((o_orderkey % 7200) / 60.0, 0)::INTEGER END AS minutes FROM orders",
    "stay_nights": "SELECT o_orderkey, least(60, greatest(1, o_orderkey % 80 - 5))::INTEGER AS n, strftime(o_orderdate::DATE + (least(60, greatest(1, o_orderkey % 80 - 5)) - 1)::INTEGER, '%Y-%m-%d') AS last FROM orders",
    "geojson_round_trip": f"SELECT id, count(*)::INTEGER AS n, round(first(x ORDER BY pos), 6) AS x, true AS same FROM {v.VERTICES} GROUP BY id",
}
