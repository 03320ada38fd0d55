"""Serving, layers, filters, availability."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import docs, texts
from cairnfield.operators import classify, serve
from cairnfield.plans import views as v

CENTRE = (-89.73, 43.42)
FROM_SEGMENTS = ["BUILDING", "MACHINERY", "FURNITURE"]


def nearby_radius(spark: SparkSession, sf: str) -> DataFrame:
    return serve.nearby(v.campgrounds(spark, sf), *CENTRE, radius=4000.0, sources=FROM_SEGMENTS)


def _experiences(spark: SparkSession, sf: str) -> DataFrame:
    r = v.table(spark, sf, "region")
    return r.select(F.col("r_regionkey").cast("long").alias("id"), F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("slug"), F.col("r_name").alias("title"), (F.col("r_regionkey") != 4).alias("is_public"))


def _templates(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(7).select(F.concat(F.lit("t"), k.cast("string")).alias("slug"), F.concat(F.lit("Template "), k.cast("string")).alias("label"), F.element_at(F.array(F.lit("line"), F.lit("polygon"), F.lit("point")), (k % 3 + 1).cast("int")).alias("geom_type"), F.concat(F.lit("group "), (k % 2).cast("string")).alias("layer_group"))


def _layers(spark: SparkSession, sf: str) -> DataFrame:
    n = v.table(spark, sf, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.cast("long").alias("id"), F.col("n_regionkey").cast("long").alias("experience_id"), F.concat(F.lit("t"), (k % 7).cast("string")).alias("template_slug"), F.when(k % 3 == 0, F.col("n_name")).alias("label_override"),
        F.when(k % 4 == 0, F.lit("Other")).alias("layer_group_override"), (k % 2 == 0).alias("visible_by_default"), (k % 5).cast("int").alias("sort_order"),
    )


def experience_config_layers(spark: SparkSession, sf: str) -> DataFrame:
    return serve.experience_layers(_experiences(spark, sf), _layers(spark, sf), _templates(spark), "r1")


def experience_config_json(spark: SparkSession, sf: str) -> DataFrame:
    return serve.experience_config(_experiences(spark, sf), _layers(spark, sf), _templates(spark), "r1")


def layers_missing(spark: SparkSession, sf: str) -> DataFrame:
    """Public experiences that lack one of three layers."""
    wanted = spark.createDataFrame([("t0",), ("t3",), ("t6",)], "template_slug string")
    public = _experiences(spark, sf).filter("is_public").select(F.col("id").alias("experience_id"))
    pairs = public.join(F.broadcast(wanted), F.lit(True))
    return pairs.join(_layers(spark, sf).select("experience_id", "template_slug"), ["experience_id", "template_slug"], "left_anti")


def layer_features(spark: SparkSession, sf: str) -> DataFrame:
    """The served documents of one layer, read back field by field."""
    e = v.table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.struct(F.lit("Point")).alias("geometry"), F.col("props").alias("properties"), F.array(F.concat(F.lit("p"), F.col("user_id").cast("string"))).alias("photos"), F.lit('{"note":"x"}').alias("custom_data"))
    doc = docs.doc("properties")
    out = serve.served(serve.layer(e, "click"))
    return out.select(docs.field(doc, "id", "long").alias("id"), docs.field(doc, "k", "long").alias("k"), F.get_json_object("properties", "$.photos[0]").alias("photo"), F.get_json_object("properties", "$.custom_data.note").alias("note"))


def layer_feature_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = v.table(spark, sf, "events")
    return e.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("n"), F.count(F.when(F.col("value") > 100, 1)).alias("n_high"), F.coalesce(F.sum(F.get_json_object("props", "$.k").cast("long")), F.lit(0)).alias("k_sum"), F.round(F.min("value"), 2).alias("low"), F.round(F.max("value"), 2).alias("high"))


def storage_usage(spark: SparkSession, sf: str) -> DataFrame:
    return serve.storage_used(v.table(spark, sf, "documents"), "n_chars")


def stale_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Users whose last purchase is over 30 days (or never) before a fixed day."""
    e = v.table(spark, sf, "events")
    last = e.groupBy(F.col("user_id").alias("id")).agg(F.max(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("fetched_at"))
    return serve.stale(last, "fetched_at", F.lit("2024-02-26 12:00:00").cast("timestamp_ntz")).select("id")


def availability_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return serve.availability(v.site_nights(spark, sf), "2024-01-10", "2024-01-13")


def classify_tags(spark: SparkSession, sf: str) -> DataFrame:
    t = v.tags(spark, sf)
    return t.select("id", classify.bucket(F.col("tags")).alias("bucket"), classify.is_area(F.col("tags")).alias("is_area"))


def bucket_counts(spark: SparkSession, sf: str) -> DataFrame:
    return classify_tags(spark, sf).groupBy("bucket").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_area"), 1)).alias("n_areas")).orderBy(F.desc("n"), "bucket")


CONDITIONS = [{"field": "p_size", "op": "<", "value": 20}, {"field": "p_retailprice", "op": ">=", "value": 500}, {"field": "p_name", "op": "contains", "value": "e"}, {"field": "p_brand", "op": "exists"}]


def saved_filter_all(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "part").filter(classify.preset(CONDITIONS, "all", F.col)).select("p_partkey")


def saved_filter_any(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "part").filter(classify.preset(CONDITIONS[:3], "any", F.col)).select("p_partkey")


def style_filter(spark: SparkSession, sf: str) -> DataFrame:
    e = ["any", ["all", ["==", ["get", "c_mktsegment"], "BUILDING"], [">", ["get", "c_acctbal"], 0]], ["in", ["get", "c_nationkey"], ["literal", [3, 5, 7]]]]
    return v.table(spark, sf, "customer").filter(classify.expression(e, F.col)).select("c_custkey")


def in_box(spark: SparkSession, sf: str) -> DataFrame:
    c = v.campgrounds(spark, sf)
    return c.filter(classify.in_box(F.col("x").cast("string"), F.col("y").cast("string"), 43.35, -89.85, 43.45, -89.65)).select("id")


def popup_text(spark: SparkSession, sf: str) -> DataFrame:
    source = "{{name}}{{#if price}} from ${{price}}{{#if big}} (big){{/if}}{{/if}}."
    p = v.table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.when(F.col("p_size") > 10, F.col("p_size").cast("string")).alias("price"), (F.col("p_size") > 40).cast("string").alias("big"))
    return p.select("p_partkey", texts.template(source, F.col).alias("html"))


def deterministic_uuid(spark: SparkSession, sf: str) -> DataFrame:
    return v.table(spark, sf, "customer").select("c_custkey", texts.uuid_of(F.concat(F.lit("ob-"), F.col("c_name"), F.lit(":boulder"))).alias("uuid"))


QUERIES = {f.__name__: f for f in (
    nearby_radius, experience_config_layers, experience_config_json, layers_missing, layer_features, layer_feature_counts, storage_usage, stale_enrichment, availability_rollup,
    classify_tags, bucket_counts, saved_filter_all, saved_filter_any, style_filter, in_box, popup_text, deterministic_uuid,
)}

_D = v.sql_haversine("x", "y", str(CENTRE[0]) + "::DOUBLE", str(CENTRE[1]) + "::DOUBLE")
_EXPERIENCES = "(SELECT r_regionkey::BIGINT AS id, 'r' || r_regionkey AS slug, r_regionkey <> 4 AS is_public FROM region)"
_TEMPLATES = "(SELECT 't' || k AS slug, 'Template ' || k AS label, ['line', 'polygon', 'point'][k % 3 + 1] AS geom_type, 'group ' || k % 2 AS layer_group FROM range(7) AS r(k))"
_LAYERS = "(SELECT n_nationkey::BIGINT AS id, n_regionkey::BIGINT AS experience_id, 't' || n_nationkey % 7 AS template_slug, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS label_override, CASE WHEN n_nationkey % 4 = 0 THEN 'Other' END AS layer_group_override, n_nationkey % 2 = 0 AS visible_by_default, (n_nationkey % 5)::INTEGER AS sort_order FROM nation)"


def _first(cases: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN '{name}'" for name, test in cases) + " ELSE 'other' END"


def _is(key: str, values: list[str] | None = None) -> str:
    test = lambda v_: f"{v_} <> ''" if values is None else f"{v_} IN ({', '.join(repr(x) for x in values)})"
    return f"(key1 = '{key}' AND {test('value1')} OR key2 = '{key}' AND {test('value2')})"


_BUCKET = _first([
    ("routes", _is("route", classify.ROUTES)), ("trails", _is("highway", classify.TRAILS)), ("roads", _is("highway", classify.ROADS + classify.CROSSINGS)), ("water", _is("natural", classify.WATERS) + " OR " + _is("waterway") + " OR " + _is("water")),
    ("natural", _is("natural")), ("parks", _is("leisure", classify.PARKS) + " OR " + _is("boundary")), ("landuse", _is("landuse")), ("buildings", _is("building")), ("parking", _is("amenity", ["parking"]) + " OR " + _is("parking")),
    ("pois", " OR ".join(_is(k) for k in ("leisure", "amenity", "tourism", "sport"))), ("infrastructure", _is("power")), ("barriers", _is("barrier")),
])
_AREA = " OR ".join(f"(key1 = '{k}' OR key2 = '{k}')" if vals is None else _is(k, vals) for k, vals in classify.AREAS.items())
_STATUS = "FROM (SELECT site, [coalesce(max(status) FILTER (night = DATE '2024-01-10'), 'unknown'), coalesce(max(status) FILTER (night = DATE '2024-01-11'), 'unknown'), coalesce(max(status) FILTER (night = DATE '2024-01-12'), 'unknown')] AS s FROM " + v.SITE_NIGHTS + " GROUP BY site)"

ORACLES = {
    "nearby_radius": f"SELECT id, source, name, round({_D}, 1) AS distance_m FROM {v.CAMPGROUNDS} WHERE source IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND {_D} <= 4000 ORDER BY distance_m, id LIMIT 20",
    "experience_config_layers": f"SELECT l.id, template_slug, coalesce(label_override, label) AS label, geom_type, coalesce(layer_group_override, layer_group) AS layer_group, visible_by_default, sort_order FROM {_LAYERS} AS l JOIN {_TEMPLATES} AS t ON t.slug = template_slug JOIN {_EXPERIENCES} AS e ON e.id = experience_id WHERE e.slug = 'r1' AND is_public",
    "layers_missing": f"SELECT e.id AS experience_id, w.slug AS template_slug FROM {_EXPERIENCES} AS e, (VALUES ('t0'), ('t3'), ('t6')) AS w(slug) WHERE is_public AND NOT EXISTS (SELECT 1 FROM {_LAYERS} AS l WHERE l.experience_id = e.id AND l.template_slug = w.slug)",
    "layer_features": "SELECT event_id AS id, (props::JSON->>'k')::BIGINT AS k, 'p' || user_id AS photo, 'x' AS note FROM events WHERE event_type = 'click'",
    "layer_feature_counts": "SELECT event_type AS source, count(*) AS n, count(*) FILTER (value > 100) AS n_high, coalesce(sum((props::JSON->>'k')::BIGINT), 0)::BIGINT AS k_sum, round(min(value), 2) AS low, round(max(value), 2) AS high FROM events GROUP BY event_type",
    "storage_usage": "SELECT coalesce(sum(n_chars), 0)::BIGINT AS bytes FROM documents",
    "stale_enrichment": "SELECT id FROM (SELECT user_id AS id, max(ts) FILTER (event_type = 'purchase') AS f FROM events GROUP BY user_id) WHERE f IS NULL OR f < TIMESTAMP '2024-02-26 12:00:00' - INTERVAL 30 DAY",
    "availability_rollup": "SELECT site, CASE WHEN len(list_filter(s, lambda x: x IN ('available', 'first-come-first-serve'))) = 3 THEN 'available' WHEN len(list_filter(s, lambda x: x IN ('available', 'first-come-first-serve'))) > 0 THEN 'partial' WHEN len(list_filter(s, lambda x: x NOT IN ('unknown', 'not-yet-released'))) > 0 THEN 'unavailable' ELSE 'unknown' END AS status " + _STATUS,
    "classify_tags": f"SELECT id, {_BUCKET} AS bucket, {_AREA} AS is_area FROM {v.TAGS}",
    "bucket_counts": f"SELECT bucket, count(*) AS n, count(*) FILTER (is_area) AS n_areas FROM (SELECT {_BUCKET} AS bucket, {_AREA} AS is_area FROM {v.TAGS}) GROUP BY bucket",
    "saved_filter_all": "SELECT p_partkey FROM part WHERE p_size < 20 AND p_retailprice >= 500 AND contains(p_name, 'e') AND p_brand IS NOT NULL",
    "saved_filter_any": "SELECT p_partkey FROM part WHERE p_size < 20 OR p_retailprice >= 500 OR contains(p_name, 'e')",
    "style_filter": "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 OR c_nationkey IN (3, 5, 7)",
    "in_box": f"SELECT id FROM {v.CAMPGROUNDS} WHERE x BETWEEN -89.85 AND -89.65 AND y BETWEEN 43.35 AND 43.45",
    "popup_text": "SELECT p_partkey, p_name || CASE WHEN p_size > 10 THEN ' from $' || p_size || CASE WHEN p_size > 40 THEN ' (big)' ELSE '' END ELSE '' END || '.' AS html FROM part",
    "deterministic_uuid": "SELECT c_custkey, regexp_replace(md5('ob-' || c_name || ':boulder'), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS uuid FROM customer",
}
