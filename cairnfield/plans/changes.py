"""Upserts, replacements, deletes, forks and audits: results are the tables after the change."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.operators import merge
from cairnfield.plans import views as v
from cairnfield.session import shared_dir
from cairnfield.sources import layers, writers


def _features(spark: SparkSession, sf: str) -> DataFrame:
    c = v.table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("source"), F.concat(F.lit("k"), (F.col("c_custkey") % 1200).cast("string")).alias("key"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))


def _incoming(spark: SparkSession, sf: str) -> DataFrame:
    s = v.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    return s.select((k + 1_000_000).alias("id"), F.lit("BUILDING").alias("source"), F.when(k % 10 > 0, F.concat(F.lit("k"), (k * 17 % 2400).cast("string"))).otherwise("").alias("key"), F.col("s_name").alias("name"), F.round("s_acctbal", 2).alias("balance"))


def _merged(spark: SparkSession, sf: str) -> DataFrame:
    rows = merge.last_of(_incoming(spark, sf).filter("key <> ''"), ["source", "key"], [F.col("id")]).unionByName(_incoming(spark, sf).filter("key = ''"))
    kept = [c for c in rows.columns if c != "id"]
    return merge.upsert(_features(spark, sf), rows.select("id", *kept[0:]), ["source", "key"], action="action")


def append_import(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers appended to the customers' features, under new ids behind the greatest one; columns that the batch lacks are null, and a second import appends again."""
    table, rows = _features(spark, sf), _incoming(spark, sf).drop("id", "balance")
    once = merge.append(table, merge.numbered_behind(table, rows, "source", "key", "name"))
    twice = merge.append(once, merge.numbered_behind(once, rows, "source", "key", "name"))
    return twice.select("id", "source", "key", "name", "balance")


def upsert_by_key(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).select("source", "key", "name", "balance")


def upsert_committed(spark: SparkSession, sf: str) -> DataFrame:
    """The same upsert on a store of layers, which holds it as a whole: only the layer that it names is read and written."""
    path, schema = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}", "id long, source string, key string, name string, balance double"
    features, rows = _features(spark, sf), merge.last_of(_incoming(spark, sf).filter("key <> ''"), ["source", "key"], [F.col("id")]).unionByName(_incoming(spark, sf).filter("key = ''"))
    names = [r[0] for r in features.select("source").distinct().collect()]  # the layers
    layers.change(spark, path, schema, names, lambda was: merge.append(was, features))
    layers.change(spark, path, schema, ["BUILDING"], lambda was: merge.upsert(was, rows, ["source", "key"]))
    return layers.read(spark, path, schema).select("source", "key", "name", "balance")


def upsert_actions(spark: SparkSession, sf: str) -> DataFrame:
    return _merged(spark, sf).groupBy("action").agg(F.count("*").alias("n"))


def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    rows = merge.last_of(_incoming(spark, sf).filter("key <> ''"), ["source", "key"], [F.col("id")])
    return merge.upsert(_features(spark, sf), rows, ["source", "key"], replace=False).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum(F.col("balance").cast("decimal(18,2)")), 2).cast("double").alias("balance"))


def replace_layer(spark: SparkSession, sf: str) -> DataFrame:
    return merge.replace_layer(_features(spark, sf), "BUILDING", _incoming(spark, sf)).groupBy("source").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def delete_predicate(spark: SparkSession, sf: str) -> DataFrame:
    """Rows where the predicate is null stay."""
    f = _features(spark, sf).withColumn("score", F.when(F.col("id") % 4 > 0, F.col("balance")))
    return merge.delete(f, F.col("score") < 0).select("id")


def delete_using(spark: SparkSession, sf: str) -> DataFrame:
    return merge.delete_using(_features(spark, sf), _incoming(spark, sf), ["source", "key"]).select("id")


def update_from_values(spark: SparkSession, sf: str) -> DataFrame:
    n = v.table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("nation"), F.col("n_name").alias("nation_name"))
    c = v.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_name").alias("name"))
    return merge.update_from(c, n, ["nation"], {"name": "nation_name"})


def fork_layer(spark: SparkSession, sf: str) -> DataFrame:
    layers = v.table(spark, sf, "region").select(F.col("r_regionkey").cast("long").alias("id"), F.element_at(F.array(*[F.lit(s) for s in ("BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD", "FURNITURE")]), F.col("r_regionkey") + 1).alias("template_slug"), F.lit("live").alias("instance_type"), F.lit(None).cast("string").alias("static_source"))
    table, _, _ = merge.fork(_features(spark, sf), layers, 2)
    return table.groupBy("source").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def audit_schema_diff(spark: SparkSession, sf: str) -> DataFrame:
    before = v.table(spark, sf, "part").select(F.col("p_partkey").alias("slug"), F.col("p_brand").alias("schema"))
    after = before.withColumn("schema", F.when(F.col("slug") % 9 == 0, None).when(F.col("slug") % 5 == 0, F.concat("schema", F.lit("+"))).otherwise(F.col("schema")))
    return merge.audit_of_changes(before, after, "slug", "schema")


def layer_changes(spark: SparkSession, sf: str) -> DataFrame:
    before = _features(spark, sf)
    after = merge.delete(before, F.col("id") % 50 == 0).withColumn("name", F.when(F.col("id") % 7 == 0, F.upper("source")).otherwise(F.col("name"))).unionByName(_incoming(spark, sf))
    return writers.changes(before, after, "id").groupBy("change").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (append_import, upsert_committed, upsert_by_key, upsert_actions, insert_if_absent, replace_layer, delete_predicate, delete_using, update_from_values, fork_layer, audit_schema_diff, layer_changes)}

_F = "(SELECT c_custkey AS id, c_mktsegment AS source, 'k' || c_custkey % 1200 AS key, c_name AS name, round(c_acctbal, 2) AS balance FROM customer)"
_I = "(SELECT s_suppkey + 1000000 AS id, 'BUILDING' AS source, CASE WHEN s_suppkey % 10 > 0 THEN 'k' || s_suppkey * 17 % 2400 ELSE '' END AS key, s_name AS name, round(s_acctbal, 2) AS balance FROM supplier)"
_L = f"(SELECT * FROM {_I} WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY id DESC) = 1 UNION ALL SELECT * FROM {_I} WHERE key = '')"
_KEYED = f"(SELECT * FROM {_I} WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY source, key ORDER BY id DESC) = 1)"
ORACLES = {
    "append_import": f"""WITH f AS (SELECT * FROM {_F}), i AS (SELECT source, key, name, row_number() OVER (ORDER BY source, key, name) AS k FROM {_I}), m AS (SELECT coalesce(max(id), 0) AS top FROM f), n AS (SELECT count(*) AS n FROM i)
      SELECT id, source, key, name, balance FROM f UNION ALL SELECT (top + k + n * again)::BIGINT, source, key, name, NULL FROM i, m, n, (VALUES (0), (1)) AS a(again)""",
    "upsert_by_key": f"SELECT f.source, f.key, coalesce(i.name, f.name) AS name, coalesce(i.balance, f.balance) AS balance FROM {_F} AS f LEFT JOIN {_KEYED} AS i ON f.source = i.source AND f.key = i.key UNION ALL SELECT source, key, name, balance FROM {_L} AS l WHERE key = '' OR NOT EXISTS (SELECT 1 FROM {_F} AS f WHERE f.source = l.source AND f.key = l.key)",
    "upsert_actions": f"SELECT action, count(*) AS n FROM (SELECT CASE WHEN i.id IS NULL THEN 'kept' ELSE 'updated' END AS action FROM {_F} AS f LEFT JOIN {_KEYED} AS i ON f.source = i.source AND f.key = i.key UNION ALL SELECT 'inserted' FROM {_L} AS l WHERE key = '' OR NOT EXISTS (SELECT 1 FROM {_F} AS f WHERE f.source = l.source AND f.key = l.key)) GROUP BY action",
    "insert_if_absent": f"SELECT source, count(*) AS n, round(sum(balance::DECIMAL(18,2)), 2)::DOUBLE AS balance FROM (SELECT source, balance FROM {_F} UNION ALL SELECT source, balance FROM {_KEYED} AS l WHERE NOT EXISTS (SELECT 1 FROM {_F} AS f WHERE f.source = l.source AND f.key = l.key)) GROUP BY source",
    "replace_layer": f"SELECT source, count(*) AS n, min(id) AS first_id FROM (SELECT source, id FROM {_F} WHERE source <> 'BUILDING' UNION ALL SELECT source, id FROM {_I}) GROUP BY source",
    "delete_predicate": f"SELECT id FROM {_F} WHERE NOT coalesce(CASE WHEN id % 4 > 0 THEN balance END < 0, false)",
    "delete_using": f"SELECT id FROM {_F} AS f WHERE NOT EXISTS (SELECT 1 FROM {_I} AS i WHERE i.source = f.source AND i.key = f.key)",
    "update_from_values": "SELECT c_custkey AS id, c_nationkey AS nation, CASE WHEN n_regionkey < 3 THEN n_name ELSE c_name END AS name FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "fork_layer": f"SELECT source, count(*) AS n, sum(id)::BIGINT AS ids FROM (SELECT source, id FROM {_F} UNION ALL SELECT 'static_2', id FROM {_F} WHERE source = 'MACHINERY') GROUP BY source",
    "audit_schema_diff": "SELECT p_partkey AS slug, p_brand AS before, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_brand || '+' END AS after FROM part WHERE p_partkey % 9 = 0 OR p_partkey % 5 = 0",
    "layer_changes": f"SELECT change, count(*) AS n FROM (SELECT CASE WHEN id % 50 = 0 THEN 'delete' WHEN id % 7 = 0 AND name <> upper(source) THEN 'update' END AS change FROM {_F} UNION ALL SELECT 'insert' FROM {_I}) WHERE change IS NOT NULL GROUP BY change",
}
ORACLES["upsert_committed"] = ORACLES["upsert_by_key"]
