"""Entity matching, and the clean-up of digitised maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import texts
from cairnfield.operators import enrich, sites
from cairnfield.plans import views as v

GENERIC = ["steel", "small"]


def _ours(spark: SparkSession, sf: str) -> DataFrame:
    s, k = v.table(spark, sf, "supplier"), F.col("s_suppkey")
    label = F.when(k % 3 == 0, F.concat(F.lit("Site "), k.cast("string"), F.lit("E"))).when(k % 3 == 1, F.concat(F.lit("A"), (k % 40).cast("string"))).otherwise(k.cast("string"))
    return s.select(k.alias("id"), (k % 2).alias("group"), label.alias("label"))


def _theirs(spark: SparkSession, sf: str) -> DataFrame:
    c, k = v.table(spark, sf, "customer"), F.col("c_custkey")
    return c.select(k.alias("their_id"), (k % 2).alias("group"), F.when(k % 4 == 0, F.concat(F.lit("a-"), (k % 50).cast("string"))).otherwise((k % 700).cast("string")).alias("label"), (k * 31 % 1009).alias("pos"))


def site_key_match(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.by_site_key(_ours(spark, sf), _theirs(spark, sf))


def unmatched_sites(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.unmatched(_ours(spark, sf), _theirs(spark, sf))


def fuzzy_name_match(spark: SparkSession, sf: str) -> DataFrame:
    """Each part's hits are the parts whose keys follow; the first of five that shares a distinctive word."""
    p = v.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))
    steps = p.select("id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("pos")).withColumn("hit_id", F.col("id") + F.col("pos"))
    hits = steps.hint("merge").join(p.select(F.col("id").alias("hit_id"), F.col("name").alias("hit_name")), "hit_id")
    return enrich.first_match(p, hits, 5)


def name_tokens(spark: SparkSession, sf: str) -> DataFrame:
    d = v.table(spark, sf, "part")
    return d.select("p_partkey", F.array_join(F.array_sort(texts.tokens(F.concat("p_name", F.lit(" & Park's the 12 345")), texts.GENERIC_WORDS)), ",").alias("tokens"))


def map_id_match(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose URL names a map, against a catalogue of map ids."""
    p = v.table(spark, sf, "pages")
    places = p.select(F.col("page_id").alias("id"), F.concat("url", F.lit("?x=1&mapId=-"), (F.col("page_id") % 90).cast("string")).alias("url"))
    s = v.table(spark, sf, "supplier")
    catalogue = s.select(F.col("s_suppkey").alias("their_id"), (-(F.col("s_suppkey") % 60)).alias("map_id"), (F.col("s_suppkey") * 17 % 101).alias("pos"))
    return enrich.by_map_id(places, catalogue)


def inside_first(spark: SparkSession, sf: str) -> DataFrame:
    """Of each customer's orders as hits, by date: the first dear one, else the first."""
    o = v.table(spark, sf, "orders")
    hits = o.select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("hit_id"), F.col("o_orderdate").alias("pos"), "o_totalprice")
    return enrich.inside_first(hits, F.col("o_totalprice") > 300000)


def _detections(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    n = F.col("l_partkey") % 260
    label = F.concat(n.cast("string"), F.when(F.col("l_suppkey") % 5 == 0, "e").otherwise(""))
    return v.table(spark, sf, "lineitem").select((F.col("l_suppkey") % 7).alias("map"), label.alias("label"), ((k * 7919) % 10007 / 10.0).alias("px"), ((k * 104729) % 10009 / 12.5).alias("py"), ((k * 31 % 1000) / 10.0).alias("conf"))


def token_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Detections on seven maps, each label's near ones merged."""
    c = sites.plausible(sites.cluster(_detections(spark, sf)))
    return c.select("map", "label", F.round("px", 1).alias("px"), F.round("py", 1).alias("py"), F.round("conf", 1).alias("conf"))


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    p, k = v.table(spark, sf, "part"), F.col("p_partkey")
    return p.select((k % 250 + 1).cast("string").alias("label"), (k * 7919 % 10007 / 10.0).alias("px"), (k * 104729 % 10009 / 12.5).alias("py"))


def misreads_dropped(spark: SparkSession, sf: str) -> DataFrame:
    return sites.plausible(_parts(spark, sf)).select("label", F.round("px", 1).alias("px"), F.round("py", 2).alias("py"))


def fragment_suppression(spark: SparkSession, sf: str) -> DataFrame:
    return sites.without_fragments(_parts(spark, sf)).select("label", F.round("px", 1).alias("px"), F.round("py", 2).alias("py"))


def merged_inventory(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    inventory = v.table(spark, sf, "supplier").select(F.concat(F.when(k % 2 == 0, "0").otherwise(""), (k * 4).cast("string"), F.when(k % 3 == 0, "E").otherwise("")).alias("name"), F.lit("north").alias("campground"), (k * 53 % 1000).cast("double").alias("px"), (k * 71 % 800).cast("double").alias("py"))
    return sites.merge_inventory(inventory, _parts(spark, sf)).select("name", F.round("x", 1).alias("x"), F.round("y", 2).alias("y"), "origin")


def nearest_duplicate_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as placed sites: of one customer's, the one nearest to the customer's place."""
    o = v.table(spark, sf, "orders")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ref"), (F.col("o_orderkey") * 7919 % 1000).alias("px"), (F.col("o_orderkey") * 104729 % 800).alias("py"), (F.col("o_custkey") * 13 % 1000).alias("ref_x"), (F.col("o_custkey") * 29 % 800).alias("ref_y"))
    return sites.nearest_duplicate(rows, ["ref"]).select("id", "kept", "far")


def site_number_collisions(spark: SparkSession, sf: str) -> DataFrame:
    return sites.number_collisions(sites.plausible(_parts(spark, sf)))


QUERIES = {f.__name__: f for f in (
    site_key_match, unmatched_sites, fuzzy_name_match, name_tokens, map_id_match, inside_first, token_clusters, misreads_dropped, fragment_suppression, merged_inventory, nearest_duplicate_kept, site_number_collisions,
)}

_OURS = "(SELECT s_suppkey AS id, s_suppkey % 2 AS grp, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE '' END AS prefix, CASE s_suppkey % 3 WHEN 1 THEN (s_suppkey % 40)::VARCHAR ELSE s_suppkey::VARCHAR END AS number FROM supplier)"
_THEIRS = "(SELECT c_custkey AS id, c_custkey % 2 AS grp, CASE WHEN c_custkey % 4 = 0 THEN 'A' ELSE '' END AS prefix, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey % 50)::VARCHAR ELSE (c_custkey % 700)::VARCHAR END AS number, c_custkey * 31 % 1009 AS pos FROM customer)"
_KEY = "a.grp = b.grp AND a.prefix = b.prefix AND a.number = b.number"
_PARTS = "(SELECT (p_partkey % 250 + 1)::VARCHAR AS label, p_partkey * 7919 % 10007 / 10.0::DOUBLE AS px, p_partkey * 104729 % 10009 / 12.5::DOUBLE AS py FROM part)"
_WORDS = ", ".join(f"'{w}'" for w in texts.GENERIC_WORDS)


def _tokens(name: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(replace(replace(lower({name}), '&', ' and '), '''', ''), '[a-z0-9]+'), lambda t: len(t) >= 3 AND t NOT IN ({_WORDS})))"


ORACLES = {
    "site_key_match": f"SELECT a.id, first(b.id ORDER BY b.pos, b.id) AS their_id FROM {_OURS} AS a LEFT JOIN {_THEIRS} AS b ON {_KEY} GROUP BY a.id",
    "unmatched_sites": f'SELECT DISTINCT \'ours\' AS side, grp AS "group", prefix, number FROM {_OURS} AS a WHERE NOT EXISTS (SELECT 1 FROM {_THEIRS} AS b WHERE {_KEY}) UNION ALL SELECT DISTINCT \'theirs\', grp, prefix, number FROM {_THEIRS} AS b WHERE NOT EXISTS (SELECT 1 FROM {_OURS} AS a WHERE {_KEY})',
    "fuzzy_name_match": f"SELECT a.p_partkey AS id, min(b.p_partkey) AS hit_id FROM part AS a JOIN part AS b ON b.p_partkey BETWEEN a.p_partkey + 1 AND a.p_partkey + 5 WHERE len({_tokens('a.p_name')}) = 0 OR list_has_any({_tokens('a.p_name')}, {_tokens('b.p_name')}) GROUP BY a.p_partkey",
    "name_tokens": "SELECT p_partkey, array_to_string(list_sort(" + _tokens("p_name || ' & Park''s the 12 345'") + "), ',') AS tokens FROM part",
    "map_id_match": "SELECT p.page_id AS id, first(s_suppkey ORDER BY s_suppkey * 17 % 101, s_suppkey) AS their_id FROM pages AS p JOIN supplier AS s ON p.page_id % 90 = s_suppkey % 60 AND p.page_id % 90 > 0 GROUP BY p.page_id",
    "inside_first": "SELECT o_custkey AS id, first(o_orderkey ORDER BY o_totalprice <= 300000, o_orderdate, o_orderkey) AS hit_id FROM orders GROUP BY o_custkey",
    "misreads_dropped": f"SELECT label, round(px, 1) AS px, round(py, 2) AS py FROM {_PARTS} WHERE NOT (label::INTEGER <= 100 AND px > 490 OR label::INTEGER >= 104 AND px < 440) AND label::INTEGER <= 250",
    "site_number_collisions": f"SELECT label::INTEGER AS n, count(*) AS places FROM {_PARTS} WHERE NOT (label::INTEGER <= 100 AND px > 490 OR label::INTEGER >= 104 AND px < 440) AND label::INTEGER <= 250 GROUP BY 1 HAVING count(*) > 1",
    "fragment_suppression": f"SELECT label, round(px, 1) AS px, round(py, 2) AS py FROM {_PARTS} AS a WHERE NOT EXISTS (SELECT 1 FROM {_PARTS} AS b WHERE len(b.label) > len(a.label) AND starts_with(b.label, a.label) AND abs(a.px - b.px) <= 32 AND abs(a.py - b.py) <= 32)",
    "merged_inventory": f"""SELECT name, round(coalesce(struct_extract(m, 2), px), 1) AS x, round(coalesce(struct_extract(m, 3), py), 2) AS y, CASE WHEN m IS NULL THEN 'vision' ELSE 'ocr' END AS origin FROM (SELECT name, i.px, i.py, min(CASE WHEN d.px IS NOT NULL THEN ((d.px - i.px) * (d.px - i.px) + (d.py - i.py) * (d.py - i.py), d.px, d.py) END) AS m
      FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN '0' ELSE '' END || s_suppkey * 4 || CASE WHEN s_suppkey % 3 = 0 THEN 'E' ELSE '' END AS name, s_suppkey * 4 AS n, (s_suppkey * 53 % 1000)::DOUBLE AS px, (s_suppkey * 71 % 800)::DOUBLE AS py FROM supplier) AS i LEFT JOIN {_PARTS} AS d ON d.label = i.n::VARCHAR GROUP BY ALL)""",
    "nearest_duplicate_kept": "SELECT id, rank = 1 AS kept, rank = 1 AND d2 > 10000 AS far FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY d2, id) AS rank FROM (SELECT o_orderkey AS id, o_custkey AS ref, pow(o_orderkey * 7919 % 1000 - o_custkey * 13 % 1000, 2) + pow(o_orderkey * 104729 % 800 - o_custkey * 29 % 800, 2) AS d2 FROM orders))",
}
