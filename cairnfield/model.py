"""Schemas of the feature store and checks that Spark tables do not make themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairnfield.functions import geo

PHOTO_META = "array<struct<url:string,caption:string,source:string>>"
FEATURE = f"id long, source string, osm_id long, name string, geometry {geo.GEOMETRY}, properties string, photos array<string>, custom_data string, photo_meta {PHOTO_META}, updated_at timestamp"
FIELD_SCHEMA = "array<struct<name:string,label:string,type:string,options:array<string>,base:boolean,hidden:boolean>>"
LAYER_TEMPLATE = f"slug string, label string, geom_type string, default_style string, layer_group string, is_custom boolean, sort_order int, field_schema {FIELD_SCHEMA}, popup_template string, popup_css string"
EXPERIENCE = "id long, slug string, title string, description string, initial_center array<double>, initial_zoom decimal(6,2), is_public boolean, primary_layer string, saved_filters string"
EXPERIENCE_LAYER = (
    "id long, experience_id long, template_slug string, instance_type string, static_source string, style_overrides string, filter_expr string, visible_by_default boolean, sort_order int, label_override string, layer_group_override string"
)
AUDIT = "occurred_at timestamp, actor_email string, entity_type string, action string, source string, entity_id string, detail string"
PENDING_IMAGE = "id long, feature_source string, feature_key string, url string, caption string, submitter_email string, submitted_at timestamp, status string, exif_lat double, exif_lng double, exif_raw string"
LOOP = f"id long, geometry {geo.GEOMETRY}, distance_mi decimal(5,2), num_segments int, trail_names array<string>, start_lon double, start_lat double, properties string"

GEOMETRY_TYPES = ["line", "polygon", "point", "mixed"]


def struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def broken_layers(layers: DataFrame, experiences: DataFrame, templates: DataFrame) -> DataFrame:
    """id, problem: what foreign keys and checks would refuse."""
    e, t = experiences.select(F.col("id").alias("_e")), templates.select(F.col("slug").alias("_t"), "geom_type")
    joined = layers.join(e, F.col("experience_id") == F.col("_e"), "left").join(t, F.col("template_slug") == F.col("_t"), "left")
    problem = (
        F.when(F.col("_e").isNull(), "no such experience").when(F.col("_t").isNull(), "no such template").when(~F.col("instance_type").isin("live", "static"), "unknown instance type")
        .when((F.col("instance_type") == "static") & F.col("static_source").isNull(), "static without source").when(~F.col("geom_type").isin(GEOMETRY_TYPES), "unknown geometry type")
    )
    return joined.select("id", problem.alias("problem")).filter("problem is not null")


def typed(features: DataFrame, fields: list[dict]) -> DataFrame:
    """Features with a typed column for every field of a layer's schema: from properties if base, else from custom_data."""
    from cairnfield.functions import docs

    kinds = {"number": "double", "text": "string", "select": "string"}
    columns = {f["name"]: docs.field(docs.doc("properties" if f.get("base") else "custom_data"), f["name"], kinds.get(f["type"], "string")) for f in fields}
    return features.withColumns(columns)
