"""Views that read the test tables as map data. Spark columns and DuckDB SQL are written side by side.

lon and lat spread keys over a county; campgrounds are customers, road points are suppliers, trails are the vertices of orders,
elevation series are a user's event values, nights are a user's days, climbs are orders below region, nation, customer.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnfield.functions import geo
from cairnfield.operators import graph


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lon(k: Column) -> Column:
    return F.lit(-89.95) + F.lit(0.4) * (k * 7919 % 10007).cast("double") / F.lit(10007.0)


def lat(k: Column) -> Column:
    return F.lit(43.3) + F.lit(0.2) * (k * 104729 % 10009).cast("double") / F.lit(10009.0)


def sql_lon(k: str) -> str:
    return f"(-89.95::DOUBLE + 0.4::DOUBLE * (({k}) * 7919 % 10007)::DOUBLE / 10007::DOUBLE)"


def sql_lat(k: str) -> str:
    return f"(43.3::DOUBLE + 0.2::DOUBLE * (({k}) * 104729 % 10009)::DOUBLE / 10009::DOUBLE)"


def sql_haversine(x1: str, y1: str, x2: str, y2: str, radius: float = geo.EARTH_METRES) -> str:
    return f"(2 * {radius}::DOUBLE * asin(sqrt(least(pow(sin((radians({y2}) - radians({y1})) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians(({x2}) - ({x1})) / 2), 2), 1.0::DOUBLE))))"


def sql_utm(rows: str, keep: str, x: str = "x", y: str = "y") -> str:
    """Rows with their kept columns and their place in zone 16 (ux, uy), by the series of geo.utm() from its definition."""
    n = (1 / 298.257223563) / (2 - 1 / 298.257223563)
    radius, e = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * n**0.5 / (1 + n)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    f = lambda v: f"{v!r}::DOUBLE"
    east = " + ".join(f"{f(a)} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    north = " + ".join(f"{f(a)} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(alpha, 1))
    t = f"(SELECT {keep}, radians({x} + 87) AS d_, sinh(atanh(sin(radians({y}))) - {f(e)} * atanh({f(e)} * sin(radians({y})))) AS t_ FROM {rows})"
    return f"(SELECT {keep}, 500000 + {f(0.9996 * radius)} * (eta + {east}) AS ux, {f(0.9996 * radius)} * (xi + {north}) AS uy FROM (SELECT {keep}, atan2(t_, cos(d_)) AS xi, atanh(sin(d_) / sqrt(1 + t_ * t_)) AS eta FROM {t}))"


def campgrounds(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("source"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), lon(F.col("c_custkey")).alias("x"), lat(F.col("c_custkey")).alias("y"))


CAMPGROUNDS = f"(SELECT c_custkey AS id, c_mktsegment AS source, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, {sql_lon('c_custkey')} AS x, {sql_lat('c_custkey')} AS y FROM customer)"


def lots(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"), lon(F.col("s_suppkey") * 13).alias("x"), lat(F.col("s_suppkey") * 13).alias("y"))


LOTS = f"(SELECT s_suppkey AS id, s_name AS name, s_nationkey AS nation, s_acctbal AS balance, {sql_lon('s_suppkey * 13')} AS x, {sql_lat('s_suppkey * 13')} AS y FROM supplier)"


def roads(spark: SparkSession, sf: str) -> DataFrame:
    """rid, name, line: one road a nation through its lots, in order of their ids."""
    packed = lots(spark, sf).groupBy("nation").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("v"))
    return packed.select(F.col("nation").cast("long").alias("rid"), F.when(F.col("nation") % 4 > 0, F.concat(F.lit("Road "), F.col("nation").cast("string"))).alias("name"), F.transform("v", lambda p: geo.point(p["x"], p["y"])).alias("line"))


SEGMENTS = f"""(SELECT nation::BIGINT AS rid, x AS ax, y AS ay, coalesce(lead(x) OVER w, CASE WHEN count(*) OVER (PARTITION BY nation) = 1 THEN x END) AS bx, coalesce(lead(y) OVER w, CASE WHEN count(*) OVER (PARTITION BY nation) = 1 THEN y END) AS by_
  FROM {LOTS} WINDOW w AS (PARTITION BY nation ORDER BY id) QUALIFY bx IS NOT NULL)"""


def trails(spark: SparkSession, sf: str) -> DataFrame:
    """id, name, line: a trail an order; its vertices are its parts, ordered by line number, part and supplier."""
    v = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("v"))
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("status"))
    return v.join(o, "id").select("id", "name", "status", F.transform("v", lambda p: geo.point(lon(p["l_partkey"]), lat(p["l_partkey"]))).alias("line"))


VERTICES = f"(SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, {sql_lon('l_partkey')} AS x, {sql_lat('l_partkey')} AS y FROM lineitem)"


def climbs(spark: SparkSession, sf: str) -> DataFrame:
    """climb, area_id, area_path, kind, x, y: an order below its customer, nation and region; status F is a boulder."""
    o, c, n = table(spark, sf, "orders"), table(spark, sf, "customer"), table(spark, sf, "nation")
    joined = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    area = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    path = F.array(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), area)
    return joined.select(F.col("o_orderkey").alias("climb"), area.alias("area_id"), path.alias("area_path"), F.when(F.col("o_orderstatus") == "F", "boulder").otherwise("route").alias("kind"), lon(F.col("o_orderkey")).alias("x"), lat(F.col("o_orderkey")).alias("y"))


CLIMBS = f"""(SELECT o_orderkey AS climb, 'c' || o_custkey AS area_id, ['r' || n_regionkey, 'n' || n_nationkey, 'c' || o_custkey] AS area_path, CASE WHEN o_orderstatus = 'F' THEN 'boulder' ELSE 'route' END AS kind, {sql_lon('o_orderkey')} AS x, {sql_lat('o_orderkey')} AS y
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def areas(spark: SparkSession, sf: str) -> DataFrame:
    """area_id, name, parent_id, area_path, depth of regions, nations and customers."""
    r, n, c = table(spark, sf, "region"), table(spark, sf, "nation"), table(spark, sf, "customer")
    rid, nid, cid = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    none = F.array().cast("array<string>")
    top = r.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("area_id"), F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent_id"), none.alias("area_path"))
    mid = n.select(nid.alias("area_id"), F.col("n_name").alias("name"), rid.alias("parent_id"), F.array(rid).alias("area_path"))
    low = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(cid.alias("area_id"), F.col("c_name").alias("name"), nid.alias("parent_id"), F.array(rid, nid).alias("area_path"))
    return top.unionByName(mid).unionByName(low).withColumn("depth", F.size("area_path"))


AREAS = """(SELECT 'r' || r_regionkey AS area_id, r_name AS name, NULL::VARCHAR AS parent_id, []::VARCHAR[] AS area_path, 0 AS depth FROM region
  UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, ['r' || n_regionkey], 1 FROM nation
  UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey, ['r' || n_regionkey, 'n' || c_nationkey], 2 FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


def series(spark: SparkSession, sf: str) -> DataFrame:
    """id, series: a user's event values in order of time."""
    e = table(spark, sf, "events")
    packed = e.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("v"))
    return packed.select("id", F.transform("v", lambda p: p["value"]).alias("series"))


SERIES = "(SELECT user_id AS id, list(value ORDER BY ts, event_id) AS series FROM events GROUP BY user_id)"


def site_nights(spark: SparkSession, sf: str) -> DataFrame:
    """site, night, status: a user's last event of each day as a status."""
    e = table(spark, sf, "events").withColumn("night", F.to_date("ts"))
    last = e.groupBy(F.col("user_id").alias("site"), "night").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"))
    status = F.when(F.col("kind") == "view", "available").when(F.col("kind") == "click", "first-come-first-serve").when(F.col("kind") == "error", "unknown").when(F.col("kind") == "signup", "not-yet-released").otherwise("reserved")
    return last.select("site", "night", status.alias("status"))


SITE_NIGHTS = """(SELECT site, night, CASE kind WHEN 'view' THEN 'available' WHEN 'click' THEN 'first-come-first-serve' WHEN 'error' THEN 'unknown' WHEN 'signup' THEN 'not-yet-released' ELSE 'reserved' END AS status
  FROM (SELECT user_id AS site, ts::DATE AS night, last(event_type ORDER BY ts, event_id) AS kind FROM events GROUP BY user_id, ts::DATE))"""


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """eid, a, b, len, name, road: a graph over all customers, an edge an order from its customer to another."""
    o, customers = table(spark, sf, "orders"), table(spark, sf, "customer").count()
    b = (F.col("o_orderkey") * 7919) % max(customers, 1) + 1
    return o.select(F.col("o_orderkey").alias("eid"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("a"), F.concat(F.lit("c"), b.cast("string")).alias("b"), (F.floor(F.col("o_totalprice") / 10) / 100).alias("len"), F.concat(F.lit("Way "), (F.col("o_orderkey") % 9).cast("string")).alias("name"), (F.col("o_orderkey") % 5 == 0).alias("road"))


EDGES = "(SELECT o_orderkey AS eid, 'c' || o_custkey AS a, 'c' || (o_orderkey * 7919 % (SELECT count(*) FROM customer) + 1) AS b, floor(o_totalprice / 10) / 100 AS len, 'Way ' || o_orderkey % 9 AS name, o_orderkey % 5 = 0 AS road FROM orders)"


def trail_edges(spark: SparkSession, sf: str) -> DataFrame:
    """eid, line, a, b, len, name, road: the graph of all trails, an edge a trail; every fifth is a road."""
    lines = trails(spark, sf).select(F.col("id").alias("eid"), "line", "name", (F.col("id") % 5 == 0).alias("road"))
    return graph.build(lines)


def _corner(k: Column, wide: Column) -> tuple[Column, Column]:
    """Where a customer's street corner is, in a town as wide as it is high."""
    turn = lambda m: (k * m % 101).cast("double") / F.lit(101.0)
    return F.lit(-89.95) + F.lit(0.07) * (k % wide).cast("double") + F.lit(0.012) * turn(7919), F.lit(43.3) + F.lit(0.05) * F.floor(k / wide).cast("double") + F.lit(0.012) * turn(5101)


def _wide(spark: SparkSession, sf: str) -> Column:
    return F.lit(max(math.ceil(math.sqrt(table(spark, sf, "customer").count())), 1)).cast("long")


def streets(spark: SparkSession, sf: str) -> DataFrame:
    """eid, line, a, b, len, name, road: a town with a corner a customer, some three miles apart, and streets to the next ones east (but
    for customers in debt) and north. Streets of the building segment are roads."""
    c, wide = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", "c_mktsegment"), _wide(spark, sf)
    here, there = [dict(zip("xy", _corner(F.col(k), wide), strict=True)) for k in ("k", "t")]
    middle = geo.point((here["x"] + there["x"]) / 2 + F.lit(0.002), (here["y"] + there["y"]) / 2 + F.lit(0.001))
    east = c.filter((F.col("c_acctbal") >= 0) & ((F.col("k") + 1) % wide > 0)).withColumns({"t": F.col("k") + 1, "eid": F.col("k") * 2, "name": F.concat(F.lit("Row Trail "), F.floor(F.col("k") / wide).cast("string"))})
    north = c.withColumns({"t": F.col("k") + wide, "eid": F.col("k") * 2 + 1, "name": F.concat(F.lit("Column Trail "), (F.col("k") % wide).cast("string"))})
    # a small file is read by few tasks, and lengths and nodes take longer than reading
    both = east.unionByName(north).join(c.select(F.col("k").alias("t")), "t").repartition("eid")
    return graph.build(both.select("eid", F.array(geo.point(here["x"], here["y"]), middle, geo.point(there["x"], there["y"])).alias("line"), "name", (F.col("c_mktsegment") == "BUILDING").alias("road")))


def street_lots(spark: SparkSession, sf: str) -> DataFrame:
    """lot, name, kind, x, y: a lot a supplier, near a corner."""
    customers = table(spark, sf, "customer").count()
    x, y = _corner((F.col("s_suppkey") * 13) % max(customers, 1), _wide(spark, sf))
    kind = F.when(F.col("s_suppkey") % 3 == 0, "polygon").otherwise("point")
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("lot"), F.col("s_name").alias("name"), kind.alias("kind"), (x + F.lit(0.0011)).alias("x"), (y + F.lit(0.0007)).alias("y"))


_WIDE = "(SELECT greatest(ceil(sqrt(count(*))), 1)::BIGINT FROM customer)"
_SQL_X, _SQL_Y = (f"({at}::DOUBLE + {step}::DOUBLE * ({cell})::DOUBLE + 0.012::DOUBLE * (({{0}}) * {m} % 101)::DOUBLE / 101.0::DOUBLE)" for at, step, cell, m in ((-89.95, 0.07, "({0}) % {1}", 7919), (43.3, 0.05, "floor(({0})::DOUBLE / {1})", 5101)))
CORNER_X, CORNER_Y = (lambda k: _SQL_X.format(k, _WIDE)), (lambda k: _SQL_Y.format(k, _WIDE))
_TO = "(SELECT c.c_custkey AS k, c.c_custkey + 1 AS t, c.c_custkey * 2 AS eid, 'Row Trail ' || floor(c.c_custkey / " + _WIDE + ")::BIGINT AS name, c.c_mktsegment AS seg FROM customer AS c WHERE c.c_acctbal >= 0 AND (c.c_custkey + 1) % " + _WIDE + " > 0 UNION ALL SELECT c_custkey, c_custkey + " + _WIDE + ", c_custkey * 2 + 1, 'Column Trail ' || c_custkey % " + _WIDE + ", c_mktsegment FROM customer)"
_MX, _MY = f"(({CORNER_X('k')} + {CORNER_X('t')}) / 2 + 0.002::DOUBLE)", f"(({CORNER_Y('k')} + {CORNER_Y('t')}) / 2 + 0.001::DOUBLE)"
_KEY = "printf('%.6f', round_even({0}, 6)) || ',' || printf('%.6f', round_even({1}, 6))"
#: Segments of the streets, and the lots.
STREET_PARTS = f"(SELECT eid, {CORNER_X('k')} AS ax, {CORNER_Y('k')} AS ay, {_MX} AS bx, {_MY} AS by_ FROM {_TO} AS s JOIN customer AS o ON s.t = o.c_custkey UNION ALL SELECT eid, {_MX}, {_MY}, {CORNER_X('t')}, {CORNER_Y('t')} FROM {_TO} AS s JOIN customer AS o ON s.t = o.c_custkey)"
_AT = "(s_suppkey * 13 % (SELECT greatest(count(*), 1) FROM customer))"
STREET_LOTS = f"(SELECT s_suppkey AS lot, {CORNER_X(_AT)} + 0.0011::DOUBLE AS x, {CORNER_Y(_AT)} + 0.0007::DOUBLE AS y FROM supplier)"
STREETS = f"""(SELECT eid, {_KEY.format(CORNER_X('k'), CORNER_Y('k'))} AS a, {_KEY.format(CORNER_X('t'), CORNER_Y('t'))} AS b, {sql_haversine(CORNER_X('k'), CORNER_Y('k'), _MX, _MY)} + {sql_haversine(_MX, _MY, CORNER_X('t'), CORNER_Y('t'))} AS len, name, seg = 'BUILDING' AS road
  FROM {_TO} AS s JOIN customer AS o ON s.t = o.c_custkey)"""


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """id, tags: parts as tagged elements; the tag key and value follow from the part's key."""
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    key = F.element_at(F.array(*[F.lit(x) for x in TAG_KEYS]), (k % len(TAG_KEYS) + 1).cast("int"))
    value = F.element_at(F.array(*[F.lit(x) for x in TAG_VALUES]), (k * 7 % len(TAG_VALUES) + 1).cast("int"))
    second = F.element_at(F.array(*[F.lit(x) for x in TAG_KEYS]), (k * 3 % len(TAG_KEYS) + 1).cast("int"))
    return p.select(k.alias("id"), F.map_from_entries(F.array_distinct(F.array(F.struct(key.alias("key"), value.alias("value")), F.struct(F.when(second == key, key).otherwise(second).alias("key"), F.when(second == key, value).otherwise(F.when(k % 5 == 0, "").otherwise("yes")).alias("value"))))).alias("tags"))


TAG_KEYS = ["highway", "natural", "leisure", "waterway", "route", "water", "boundary", "landuse", "building", "amenity", "parking", "tourism", "sport", "power", "barrier", "foo"]
TAG_VALUES = ["path", "service", "crossing", "water", "tree", "park", "hiking", "parking", "pitch", "gate", "bus_stop"]
_pick = lambda values, i: "[" + ", ".join(f"'{v}'" for v in values) + f"][{i}]"
TAGS = f"""(SELECT id, key1, value1, key2, CASE WHEN key2 = key1 THEN value1 WHEN id % 5 = 0 THEN '' ELSE 'yes' END AS value2 FROM
  (SELECT p_partkey AS id, {_pick(TAG_KEYS, f'p_partkey % {len(TAG_KEYS)} + 1')} AS key1, {_pick(TAG_VALUES, f'p_partkey * 7 % {len(TAG_VALUES)} + 1')} AS value1, {_pick(TAG_KEYS, f'p_partkey * 3 % {len(TAG_KEYS)} + 1')} AS key2 FROM part))"""
