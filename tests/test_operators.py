"""Operators on small tables: readers, merges, trees, graphs, loops, streams."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from cairnfield import model
from cairnfield.functions import docs, geo
from cairnfield.operators import enrich, graph, hierarchy, loops, merge, sites, spatial
from cairnfield.sources import readers, writers


def test_elements(spark, tmp_path):
    way = lambda k, pts, **t: {"type": "way", "id": k, "tags": t, "geometry": [{"lon": x, "lat": y} for x, y in pts]}
    ring = [(0, 0), (1, 0), (1, 1), (0, 0)]
    rel = {"type": "relation", "id": 9, "tags": {"landuse": "forest"}, "members": [{"type": "way", "role": "outer", "geometry": [{"lon": 0, "lat": 0}, {"lon": 1, "lat": 0}]}, {"type": "way", "role": "outer", "geometry": [{"lon": 1, "lat": 1}, {"lon": 1, "lat": 0}]}]}
    body = {"elements": [{"type": "node", "id": 1, "lon": 5.0, "lat": 6.0, "tags": {"natural": "spring", "name": "S"}}, way(2, ring, building="yes"), way(3, ring, highway="path"), way(4, [(0, 0), (1, 1)], highway="service"), {"type": "node", "id": 5, "lon": 1.0, "lat": 1.0}, rel]}
    (tmp_path / "a.json").write_text(json.dumps(body))
    (tmp_path / "bad.json").write_text("{oops")
    got = {r["fid"]: r for r in readers.features(readers.elements(spark, str(tmp_path))).collect()}
    assert {k: (r["source"], r["geometry"]["type"]) for k, r in got.items()} == {"node/1": ("water", "Point"), "way/2": ("buildings", "Polygon"), "way/3": ("trails", "LineString"), "way/4": ("roads", "LineString"), "relation/9": ("landuse", "Polygon")}
    assert json.loads(got["node/1"]["properties"]) == {"natural": "spring", "name": "S", "_osm_type": "node", "_osm_id": 1}
    assert [(p["x"], p["y"]) for p in got["relation/9"]["geometry"]["parts"][0]] == [(0, 0), (1, 0), (1, 1), (0, 0)]
    assert readers.rejected(spark, str(tmp_path)).count() == 1


def test_geojson_and_keyed_and_statements(spark, tmp_path):
    multi = {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]], [[5.1, 5.1], [5.2, 5.1], [5.2, 5.2], [5.1, 5.1]]]]}
    body = {"type": "FeatureCollection", "features": [{"type": "Feature", "geometry": multi, "properties": {"NAME": "A", "x": None, "e": ""}}, {"type": "Feature", "geometry": None, "properties": {"NAME": "B"}}]}
    (tmp_path / "trails.geojson").write_text(json.dumps(body))
    df = readers.geojson(spark, str(tmp_path / "trails.geojson"))
    rows = df.orderBy(F.col("geometry").isNull()).collect()
    assert rows[0]["source"] == "trails" and rows[0]["geometry"]["ring_of"] == [0, 1, 1] and rows[1]["geometry"] is None
    assert json.loads(df.filter("geometry is not null").select(readers.to_geojson(F.col("geometry"))).first()[0]) == json.loads(json.dumps(multi), parse_int=float)
    page = readers.pages(spark, str(tmp_path / "trails.geojson"), {"NAME": "name"}).collect()
    assert [json.loads(r["properties"]) for r in page] == [{"name": "A"}]
    (tmp_path / "k.json").write_text('{"7": {"min_price": 3}, "8": {"website": "w"}}')
    assert sorted((r["key"], json.loads(r["document"])) for r in readers.keyed(spark, str(tmp_path / "k.json")).collect()) == [("7", {"min_price": 3}), ("8", {"website": "w"})]
    (tmp_path / "s.sql").write_text("insert into t (a) values ('x', '{\"name\": \"O''Neil\"}');\n")
    assert json.loads(readers.statements(spark, str(tmp_path / "s.sql"), "t").first()[0]) == {"name": "O'Neil"}
    assert writers.collection(df.withColumn("properties", F.lit("{}"))).count() == 1


def test_tree(spark, tmp_path):
    climb = lambda k, kind, lat=0: {"uuid": k, "name": k, "grade": "5.7", "kind": kind, "length_m": 10.0, "metadata": {"lat": lat, "lng": 0.0, "mp_id": None}}
    wall = lambda k, cs: {"uuid": k, "area_name": k, "metadata": {"lat": 0.0, "lng": 0.0}, "climbs": cs, "children": []}
    root = {"uuid": "r", "area_name": "Root", "metadata": {"lat": 43.0, "lng": -89.0}, "climbs": [], "children": [{"uuid": "a", "area_name": "A", "metadata": {"lat": 0, "lng": 0}, "climbs": [], "children": [wall("w1", [climb("c1", "sport"), climb("c2", "boulder", 44.0)])]}]}
    (tmp_path / "t.json").write_text(json.dumps(root))
    areas, climbs = hierarchy.flatten_tree(readers.area_tree(spark, str(tmp_path / "t.json")))
    assert sorted((r["area_id"], r["parent_id"], r["depth"], r["lat"]) for r in areas.collect()) == [("a", "r", 1, 43.0), ("r", None, 0, 43.0), ("w1", "a", 2, 43.0)]
    assert areas.filter(F.col("depth") != F.size("area_path")).count() == 0
    got = {r["climb_id"]: r for r in climbs.collect()}
    assert got["c1"]["area_path"] == ["r", "a", "w1"] and got["c1"]["lat"] == 43.0 and got["c2"]["lat"] == 44.0
    f = hierarchy.climb_feature(climbs).collect()
    assert {r["source"] for r in f} == {"climbing_routes", "climbing_boulders"} and json.loads(f[0]["properties"])["length_ft"] == "33"
    counts = {r["area_id"]: r["climb_count"] for r in hierarchy.subtree_counts(climbs).collect()}
    assert counts == {"r": 2, "a": 2, "w1": 2}


def test_merges_twice(spark):
    t = spark.createDataFrame([(1, "s", "k1", "a"), (2, "s", "k1", "b"), (3, "s", "k2", "c"), (4, "s", None, "d")], "id long, source string, key string, name string")
    new = spark.createDataFrame([("s", "k1", "A"), ("s", "k9", "N"), ("s", "", "E")], "source string, key string, name string")
    once = merge.upsert(t, new, ["source", "key"], action="action")
    assert sorted((r["key"] or "", r["name"], r["action"]) for r in once.collect()) == [("", "E", "inserted"), ("", "d", "kept"), ("k1", "A", "updated"), ("k1", "A", "updated"), ("k2", "c", "kept"), ("k9", "N", "inserted")]
    keyed = new.filter("key <> ''")
    twice = merge.upsert(merge.upsert(t, keyed, ["source", "key"]), keyed, ["source", "key"])
    assert twice.count() == 5
    assert merge.delete(t, F.col("key") == "k1").count() == 2  # a null key stays


def test_drawn_and_photos(spark):
    t = spark.createDataFrame([(1, "s", "a", '{"_draw_id":"d1"}', "{}", ["p"], [("p", "", "google")]), (2, "s", "b", "{}", '{"z":1}', None, None)], f"id long, source string, name string, properties string, custom_data string, photos array<string>, photo_meta {model.PHOTO_META}")
    drawn = spark.createDataFrame([("s", 2, "B", '{"q":1}', None), ("s", None, "A", '{"_draw_id":"d1"}', '{"n":2}'), ("s", None, "C", '{"v":1}', None)], "source string, id long, name string, properties string, custom_data string")
    table, audit = merge.upsert_drawn(t, drawn)
    got = {r["id"]: r for r in table.collect()}
    assert got[2]["name"] == "B" and json.loads(got[2]["properties"]) == {"q": 1, "_draw_id": "2"} and json.loads(got[2]["custom_data"]) == {"z": 1}
    assert got[1]["name"] == "A" and json.loads(got[1]["custom_data"]) == {"n": 2} and got[3]["name"] == "C"
    assert sorted(r["action"] for r in audit.collect()) == ["insert", "update", "update"]
    assert merge.upsert_drawn(table, drawn)[0].count() == 3
    pending = spark.createDataFrame([(7, "s", "d1", "u", "cap", "pending")], "id long, feature_source string, feature_key string, url string, caption string, status string")
    out, after = merge.approve(t, pending, 7)
    row = out.filter("id = 1").first()
    assert row["photos"] == ["p", "u"] and [m["source"] for m in row["photo_meta"]] == ["google", "community"] and after.first()["status"] == "approved"
    again, _ = merge.approve(out, after, 7)
    assert again.filter("id = 1").first()["photos"] == ["p", "u"]
    images = spark.createDataFrame([("s", "d1", " u2 ", " ", "m"), ("s", "d1", "", "x", "m"), ("s", "d1", "u2", "again", "m")], "feature_source string, feature_key string, url string, caption string, submitter_email string")
    more = merge.submit_pending(merge.submit_pending(after, images.limit(1)), images.limit(1))
    assert sorted((r["url"], r["caption"], r["status"]) for r in more.collect()) == [("u", "cap", "approved"), ("u2", None, "pending")]
    assert merge.set_photos(t, "s", "d1", ["x"]).filter("id = 1").first()["photos"] == ["x"]
    set_ = merge.set_fields(t, spark.createDataFrame([(1, '{"sv":"ok"}')], "id long, patch string"), "id")
    assert json.loads(set_.filter("id = 1").first()["properties"]) == {"_draw_id": "d1", "sv": "ok"}
    typed = model.typed(t, [{"name": "z", "type": "number"}]).filter("id = 2").first()
    assert typed["z"] == 1.0


def test_split_and_reroot_are_stable(spark):
    areas = spark.createDataFrame([("w", "Wall", "r", ["r"], 1, 43.0), ("r", "Root", None, [], 0, 43.0)], "area_id string, name string, parent_id string, area_path array<string>, depth int, lat double")
    climbs = spark.createDataFrame([(k, "w", ["r", "w"], "route" if k < 3 else "boulder") for k in range(6)], "climb long, area_id string, area_path array<string>, kind string")
    a, c = hierarchy.split_walls(areas, climbs)
    assert c.count() == 6 and a.count() == 3 and hierarchy.mixed_walls(c).count() == 0
    assert a.filter("split_of is not null").first()["lat"] == pytest.approx(43.0 + hierarchy.SHIFT)
    flat = areas.withColumns({"climb_count": F.lit(1).cast("long"), "lng": F.lit(1.0)})
    groups = {"e": ("East", F.lit(True))}
    once = hierarchy.reroot(flat, "top", "Top", groups)
    rows = {r["area_id"]: r for r in once.collect()}
    assert rows["r"]["area_path"] == ["top", "e"] and rows["r"]["depth"] == 2 and rows["w"]["area_path"] == ["top", "e", "r"] and rows["e"]["parent_id"] == "top"
    twice = {r["area_id"]: r for r in hierarchy.reroot(once, "top", "Top", groups).collect()}
    assert {k: r["area_path"] for k, r in twice.items()} == {k: r["area_path"] for k, r in rows.items()}


@pytest.mark.parametrize("n", [40, 700])
def test_nearest_is_brute_force(spark, n):
    rng = random.Random(n)
    left = [(i, rng.uniform(-2, 3), rng.uniform(-2, 3)) for i in range(60)] + [(99, None, 1.0)]
    right = [(i, rng.random(), rng.random()) for i in range(n)]
    got = spatial.nearest(spark.createDataFrame(left, "lid int, lx double, ly double"), spark.createDataFrame(right, "rid int, rx double, ry double"))
    want = {i: min(right, key=lambda r: ((r[1] - x) ** 2 + (r[2] - y) ** 2, r[0]))[0] for i, x, y in left[:-1]}
    assert {r["lid"]: r["rid"] for r in got.filter("lid <> 99").collect()} == want
    lines = [(k, [(rng.random(), rng.random()), (rng.random(), rng.random())]) for k in range(n)]
    on = spatial.nearest_on_lines(spark.createDataFrame(left[:-1], "lid int, lx double, ly double"), spark.createDataFrame(lines, f"rid int, line {geo.LINE}"))

    def d2(p, a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        t = max(0, min(1, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / (dx * dx + dy * dy)))
        return (a[0] + t * dx - p[0]) ** 2 + (a[1] + t * dy - p[1]) ** 2

    assert {r["lid"]: r["rid"] for r in on.collect()} == {i: min(lines, key=lambda s: (d2((x, y), *s[1]), s[0]))[0] for i, x, y in left[:-1]}


def town(spark, rows):
    return spark.createDataFrame([(k, a, b, 1000.0, f"T{k % 3}", False) for k, (a, b) in enumerate(rows)], "eid long, a string, b string, len double, name string, road boolean")


def test_core_of_a_triangle_with_a_tail(spark):
    e = town(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")])
    assert sorted(r["eid"] for r in graph.two_core(e).collect()) == [0, 1, 2]
    found = loops.enumerate_loops(e, 1.0, 5.0).collect()
    assert len(found) == 1 and sorted(found[0]["edges"]) == [0, 1, 2] and found[0]["dist"] == 3000.0
    reached = graph.shortest(e, spark.createDataFrame([("s", "a", 0.0)], "source string, node string, dist0 double"))
    assert {r["node"]: r["dist"] for r in reached.collect()} == {"a": 0.0, "b": 1000.0, "c": 1000.0, "d": 2000.0, "e": 3000.0}
    assert [n for n, _ in graph.path(reached, "s", "e")] == ["a", "c", "d", "e"]
    assert set(graph.farthest_pair(e, "a")[:2]) in ({"e", "a"}, {"e", "b"})


@pytest.mark.parametrize("seed", range(4))
def test_cycles_are_brute_force(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{i}" for i in range(7)]
    pairs = sorted({tuple(sorted(rng.sample(nodes, 2))) for _ in range(12)})
    want = set()
    for size in range(3, 8):
        for ring in itertools.permutations(nodes, size):
            if ring[0] == min(ring) and ring[1] < ring[-1]:
                steps = [tuple(sorted((ring[i], ring[(i + 1) % size]))) for i in range(size)]
                if all(s in pairs for s in steps):
                    want.add(frozenset(pairs.index(s) for s in steps))
    got = loops.enumerate_loops(town(spark, pairs), 0.1, 30.0)
    assert {frozenset(r["edges"]) for r in got.collect()} == want


def test_distinct_loops_are_greedy(spark):
    rows = [([1, 2, 3, 4], 1.0), ([1, 2, 3, 5], 2.0), ([1, 2, 3, 4, 6], 3.0), ([9], 4.0)]
    df = spark.createDataFrame([(e, [True] * len(e), d) for e, d in rows], loops.LOOP)
    assert sorted(sorted(r["edges"]) for r in loops.distinct_loops(df).collect()) == [[1, 2, 3, 4], [1, 2, 3, 5], [9]]


def test_figure_eight(spark):
    edge = {k: ab for k, ab in enumerate([("o", "a"), ("a", "b"), ("b", "o"), ("o", "c"), ("c", "d"), ("d", "o")])}
    walk = loops.eulerian(range(6), edge)
    assert len(walk) == 6 and {e for e, _ in walk} == set(range(6))
    ends = [(edge[e] if f else edge[e][::-1]) for e, f in walk]
    assert all(x[1] == y[0] for x, y in zip(ends, ends[1:], strict=False)) and ends[0][0] == ends[-1][1]
    assert loops.eulerian([0, 1], edge) is None
    mile = geo.MILE_METRES
    base = spark.createDataFrame([(1, [0, 1, 2], ["o", "a", "b"], 3 * mile, 0.0), (2, [3, 4, 5], ["o", "c", "d"], 3 * mile, 0.0)], "id int, edges array<long>, nodes array<string>, dist double, road double")
    made = loops.compose(base)
    assert [(r["loops"], r["type"], r["dist"]) for r in made.collect()] == [([1, 2], "figure8", 6 * mile)]
    ends_ = spark.createDataFrame([(k, a, b) for k, (a, b) in edge.items()], "eid long, a string, b string")
    walked = loops.routed(made.withColumn("id", F.lit(7)), ends_).first()
    assert sorted(walked["edges"]) == list(range(6)) and len(walked["forward"]) == 6


def test_composition_is_brute_force(spark):
    """All unions of edge-disjoint loops that hang together, within the limits, where the beam holds all."""
    rng = random.Random(3)
    base = [(i, sorted(rng.sample(range(30), 3)), sorted(rng.sample([f"n{k}" for k in range(9)], 3)), rng.uniform(2, 9) * geo.MILE_METRES, rng.choice([0.0, 3000.0])) for i in range(9)]
    touch = lambda x, y: not set(x[1]) & set(y[1]) and bool(set(x[2]) & set(y[2]))
    want, front = {}, [(frozenset([b[0]]), [b]) for b in base]
    for size in range(2, 6):
        grown = {}
        for key, members in front:
            for b in base:
                if b[0] not in key and any(touch(m, b) for m in members) and all(not set(m[1]) & set(b[1]) for m in members) and sum(m[3] for m in [*members, b]) <= 30 * geo.MILE_METRES:
                    grown[key | {b[0]}] = [*members, b]
        front = list(grown.items())
        for key, members in front:
            d, road = sum(m[3] for m in members), sum(m[4] for m in members)
            if d >= 4 * geo.MILE_METRES and road <= 0.4 * d:
                want[tuple(sorted(key))] = ("figure8" if size == 2 else "composite", round(d, 6))
    got = loops.compose(spark.createDataFrame(base, "id int, edges array<long>, nodes array<string>, dist double, road double"), combine=5, beam=10_000)
    assert {tuple(r["loops"]): (r["type"], round(r["dist"], 6)) for r in got.collect()} == want and want


def test_super_edges(spark):
    """A chain between junctions, one from a junction to itself, a ring of its own, parallel edges."""
    e = town(spark, [("j", "x"), ("x", "y"), ("y", "k"), ("j", "k"), ("j", "k"), ("k", "p"), ("p", "q"), ("q", "k"), ("r", "s"), ("s", "t"), ("t", "r"), ("u", "v"), ("u", "v")])
    got = {tuple(r["edges"]): (r["a"], r["b"], r["len"]) for r in loops.super_edges(e).collect()}
    assert got == {(0, 1, 2): ("j", "k", 3000.0), (3,): ("j", "k", 1000.0), (4,): ("j", "k", 1000.0), (5, 6, 7): ("k", "k", 3000.0), (8, 9, 10): (None, None, 3000.0), (11, 12): (None, None, 2000.0)}
    found = {frozenset(r["edges"]) for r in loops.enumerate_loops(e, 0.1, 30.0).collect()}
    assert found == {frozenset(x) for x in ([3, 4], [0, 1, 2, 3], [0, 1, 2, 4], [5, 6, 7], [8, 9, 10], [11, 12])}


def test_limits_of_loops(spark):
    pairs = [("j", "k")] * 6
    e = town(spark, pairs)
    assert loops.enumerate_loops(e, 0.1, 30.0).filter("capped").count() == 0
    few = loops.enumerate_loops(e, 0.1, 30.0, per_start=4)
    assert few.count() == 4 and few.filter("not capped").count() == 0
    near = spark.createDataFrame([(2,)], "eid long")
    assert all(2 in r["edges"] for r in loops.enumerate_loops(e, 0.1, 30.0, anchors=near).collect())
    assert loops.enumerate_loops(e, 0.1, 30.0, anchors=near.limit(0)).count() == 15
    assert loops.shortest_of_names(loops.enumerate_loops(e, 0.1, 30.0), e).count() == 6


def test_unions_of_lines(spark):
    rows = [(1, [(0, 0), (10, 0), (4, 0)]), (2, [(0, 0), (10, 10), (10, 0)]), (3, [(0, 0), (3, 4), (0, 0), (6, 8)]), (4, [(1, 1)])]
    got = {r["id"]: (round(r["total"], 6), round(r["union"], 6)) for r in loops.union_length(spark.createDataFrame([(k, [(float(x), float(y)) for x, y in pts]) for k, pts in rows], f"id int, line {geo.LINE}")).collect()}
    assert got == {1: (16.0, 10.0), 2: (round(200**0.5 + 10, 6),) * 2, 3: (20.0, 10.0)}
    there = [(0.0, 0.0), (0.0, 0.01)]
    routes = spark.createDataFrame([(1, [*there, there[0]], 2200.0), (2, [*there, (0.01, 0.0)], 3000.0)], f"id int, line {geo.LINE}, dist double")
    assert [r["id"] for r in loops.unretraced(routes).collect()] == [2] == [r["id"] for r in loops.round_enough(routes).collect()]


def test_parking(spark):
    g = lambda kind, *pts: (kind, [[(float(x), float(y)) for x, y in pts]], [0])
    rows = [(1, "a", g("Point", (-89.7, 43.4))), (2, "b", g("Polygon", (-89.7, 43.4), (-89.6, 43.4), (-89.6, 43.5), (-89.7, 43.4))), (3, "c", g("LineString", (-80, 40), (-80, 41))), (4, "d", None)]
    lots = loops.parking(spark.createDataFrame(rows, f"id int, name string, geometry {geo.GEOMETRY}"))
    assert sorted((r["lot"], r["kind"]) for r in lots.collect()) == [(1, "point"), (2, "polygon"), (3, "line")]
    assert loops.parking(spark.createDataFrame(rows, f"id int, name string, geometry {geo.GEOMETRY}"), (-89.7, 43.4), 10.0).count() == 2
    lines = spark.createDataFrame([(1, [(-89.702, 43.39), (-89.702, 43.41)]), (2, [(-89.69, 43.39), (-89.69, 43.41)])], f"eid long, line {geo.LINE}")
    assert [r["eid"] for r in loops.near_lots(lines, lots, 200.0).collect()] == [1]


def test_start_lots_in_cells(spark, monkeypatch):
    rng = random.Random(7)
    lots = [(k, rng.uniform(-90, -89), rng.uniform(43, 44)) for k in range(40)] + [(99, None, 1.0)]
    routes = [(k, [(rng.uniform(-91, -88), rng.uniform(42, 45)) for _ in range(3)]) for k in range(12)]
    args = spark.createDataFrame(routes, f"route int, line {geo.LINE}"), spark.createDataFrame(lots, "lot int, x double, y double")
    want = sorted((r["route"], r["lot"], round(r["miles"], 9)) for r in loops.start_lot(*args).collect())
    monkeypatch.setattr(loops, "FEW_LOTS", 5)
    assert sorted((r["route"], r["lot"], round(r["miles"], 9)) for r in loops.start_lot(*args).collect()) == want and len(want) == 12


@pytest.mark.parametrize("n", [0, 300])
def test_nearest_without_coordinates(spark, n):
    left = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0)], "lid int, lx double, ly double")
    none = spark.createDataFrame([(k, None, 1.0) for k in range(n)], "rid int, rx double, ry double")
    assert spatial.nearest(left, none).count() == 0
    assert spatial.nearest_on_lines(left, spark.createDataFrame([(k, [(None, 1.0)]) for k in range(n)], f"rid int, line {geo.LINE}")).count() == 0
    both = spatial.nearest(left, none.unionByName(spark.createDataFrame([(7, 1.0, 1.0), (5, 1.0, 1.0)], "rid int, rx double, ry double")))
    assert [(r["lid"], r["rid"], r["d2"]) for r in both.collect()] == [(1, 5, 2.0)]


def test_nearest_in_a_crowd(spark):
    """A dense town among far places."""
    rng = random.Random(2)
    right = [(k, rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for k in range(3000)] + [(5000 + k, rng.uniform(-9, 9), rng.uniform(-9, 9)) for k in range(30)]
    left = [(k, rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for k in range(20)] + [(50 + k, rng.uniform(-20, 20), rng.uniform(-20, 20)) for k in range(20)]
    got = spatial.nearest(spark.createDataFrame(left, "lid int, lx double, ly double"), spark.createDataFrame(right, "rid int, rx double, ry double"))
    assert {r["lid"]: r["rid"] for r in got.collect()} == {i: min(right, key=lambda r: ((r[1] - x) ** 2 + (r[2] - y) ** 2, r[0]))[0] for i, x, y in left}


def test_lines_within(spark):
    rng = random.Random(4)
    points = [(k, rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(80)]
    lines = [(k, [(rng.uniform(0, 10), rng.uniform(0, 10)) for _ in range(rng.choice([1, 2, 3]))]) for k in range(60)]

    def d2(p, line):
        best = 1e9
        for a, b in zip(line, line[1:] or line, strict=False):
            dx, dy = b[0] - a[0], b[1] - a[1]
            t = max(0, min(1, ((p[1] - a[0]) * dx + (p[2] - a[1]) * dy) / ((dx * dx + dy * dy) or 1)))
            best = min(best, (a[0] + t * dx - p[1]) ** 2 + (a[1] + t * dy - p[2]) ** 2)
        return best

    got = spatial.lines_within(spark.createDataFrame(points, "lid int, lx double, ly double"), spark.createDataFrame(lines, f"rid int, line {geo.LINE}"), 0.4)
    assert sorted(map(tuple, got.collect())) == sorted((p[0], line[0]) for p in points for line in lines if d2(p, line[1]) <= 0.16)


def test_atoms_and_distinct_loops_are_brute_force(spark):
    rng = random.Random(11)
    sets = {tuple(sorted(rng.sample(range(12), rng.choice([2, 3, 4, 6, 8])))): round(rng.uniform(100, 9000), 2) for _ in range(120)}
    df = spark.createDataFrame([(list(e), [True] * len(e), d) for e, d in sets.items()], loops.LOOP)
    small = [set(e) for e, d in sets.items() if d <= 4 * geo.MILE_METRES]
    want = sorted(sorted(e) for e in small if not any(x < e for x in small))
    assert sorted(sorted(r["edges"]) for r in loops.atoms(df).collect()) == want
    kept = []
    for e, _ in sorted(sets.items(), key=lambda x: (x[1], ",".join(map(str, x[0])))):
        if all(len(set(e) & k) / len(set(e) | k) < 0.5 for k in kept):
            kept.append(set(e))
    got = loops.distinct_loops(df, jaccard=0.5).orderBy("rank").collect()
    assert [set(r["edges"]) for r in got] == kept


def test_session_needs_a_shared_folder():
    from types import SimpleNamespace as N

    from cairnfield.session import shared_dir

    context = N(getCheckpointDir=lambda: None, master="spark://somewhere:7077")
    with pytest.raises(RuntimeError):
        shared_dir(N(sparkContext=context, conf=N(get=lambda key, default: default)))


@pytest.mark.parametrize("seed", range(2))
def test_two_core_is_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.choice("abcdefghij"), rng.choice("abcdefghij")) for _ in range(11)]
    left = dict(enumerate(pairs))
    while True:
        degree: dict = {}
        for a, b in left.values():
            for v in (a, b):
                degree[v] = degree.get(v, 0) + 1
        dead = {k for k, (a, b) in left.items() if degree[a] == 1 or degree[b] == 1}
        if not dead:
            break
        left = {k: v for k, v in left.items() if k not in dead}
    assert {r["eid"] for r in graph.two_core(town(spark, pairs)).collect()} == set(left)


def test_doubled_treads(spark):
    rows = [("g", 1, 10, [(0.0, 0.0), (100.0, 0.0)]), ("g", 2, 11, [(0.0, 5.0), (100.0, 5.0)]), ("g", 3, 12, [(0.0, 50.0), (100.0, 50.0)])]
    assert sorted(r["eid"] for r in loops.drop_doubled(spark.createDataFrame(rows, f"g string, pos int, eid long, line {geo.LINE}"), "g").collect()) == [10, 12]


def test_sites(spark):
    d = spark.createDataFrame([("14", 10.0, 10.0, 90.0), ("14", 15.0, 12.0, 95.0), ("144", 12.0, 11.0, 80.0), ("x", 1.0, 1.0, 99.0), ("150", 500.0, 1.0, 10.0)], "label string, px double, py double, conf double")
    c = sites.cluster(d)
    assert sorted((r["label"], r["px"]) for r in c.collect()) == [("14", 15.0), ("144", 12.0)]
    assert [r["label"] for r in sites.without_fragments(c).collect()] == ["144"]


def test_place_document(spark):
    kind = "struct<rating:double,userRatingCount:int,allowsDogs:boolean,accessibilityOptions:struct<wheelchairAccessibleParking:boolean>,reviews:array<struct<author:string,rating:int,text:string>>>"
    row = spark.createDataFrame([((4.5, 10, True, (None,), [("a", 5, "x" * 400)] * 5),)], f"p {kind}")
    got = json.loads(row.select(docs.text(enrich.place_properties(F.col("p")))).first()[0])
    assert got["google_dogs"] == "Yes" and "google_wheelchair_parking" not in got and len(got["google_reviews"]) == 3 and len(got["google_reviews"][0]["text"]) == 280


def test_stream_of_upserts(spark, tmp_path):
    from cairnfield.streaming import incremental

    schema = "k string, v int, n int"
    inbox = str(tmp_path / "in")
    for rows in ([("a", 1, 1), ("b", 2, 2), ("a", 3, 3)], [("a", 9, 4), ("c", 5, 5)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema(schema).parquet(inbox)
        incremental.upserts(stream, str(tmp_path / "t"), str(tmp_path / "cp"), ["k"], [F.col("n")]).awaitTermination()
    assert sorted((r["k"], r["v"]) for r in incremental.current(spark, str(tmp_path / "t")).collect()) == [("a", 9), ("b", 2), ("c", 5)]


def test_layers_checked(spark):
    e = spark.createDataFrame([(1,)], "id long")
    t = spark.createDataFrame([("a", "line")], "slug string, geom_type string")
    rows = spark.createDataFrame([(1, 1, "a", "live", None), (2, 2, "a", "live", None), (3, 1, "a", "static", None)], "id long, experience_id long, template_slug string, instance_type string, static_source string")
    assert sorted((r["id"], r["problem"]) for r in model.broken_layers(rows, e, t).collect()) == [(2, "no such experience"), (3, "static without source")]


def test_hulls_of_a_crowd(spark):
    """A group of many points: corners before the shuffle, the same outline after."""
    import numpy as np

    from cairnfield.functions import hulls

    rng = np.random.default_rng(1)
    xy = np.round(rng.normal([-89.7, 43.4], 0.01, (3000, 2)), 5)
    rows = [("a", float(x), float(y)) for x, y in xy] + [("b", -89.0, 43.0), ("b", None, 43.0), (None, -89.0, 43.0)]
    got = {r["k"]: r for r in hierarchy.hull_of_groups(spark.createDataFrame(rows, "k string, x double, y double").repartition(3), "k", 25.0).collect()}
    want = hulls.footprint(np.unique(xy, axis=0), 25.0)
    assert got["a"]["n_points"] == 3000 and got["b"]["n_points"] == 1 and got[None]["n_points"] == 1
    assert np.allclose([(p["x"], p["y"]) for p in got["a"]["ring"]], want, atol=1e-9)


def test_delaunay_is_empty_of_points():
    import numpy as np

    from cairnfield.functions import hulls

    pts = np.random.default_rng(5).uniform(0, 1, (60, 2))
    triangles = hulls.delaunay(pts)
    for t in triangles:
        cx, cy, r2 = hulls._circle(pts, t)
        inside = (pts[:, 0] - cx) ** 2 + (pts[:, 1] - cy) ** 2 < r2 * (1 - 1e-9)
        assert not inside[[k for k in range(60) if k not in t]].any()
    hull = hulls.convex(pts)
    assert sum(abs(hulls._turn(*pts[list(t)])) / 2 for t in triangles) == pytest.approx(hulls.area(hull), rel=1e-3)


def test_upserts_of_repeated_keys(spark):
    t = spark.createDataFrame([(1, "k1", "a"), (2, "k2", "b")], "id long, key string, name string")
    new = spark.createDataFrame([(5, "k1", "A"), (6, "k1", "B"), (7, "k9", "N"), (8, "k9", "M")], "id long, key string, name string")
    assert sorted(map(tuple, merge.upsert(t, new, ["key"]).collect())) == [(2, "k2", "b"), (6, "k1", "B"), (8, "k9", "M")]
    many = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    assert sorted(map(tuple, merge.numbered(many, "n", "v").collect())) == [(v, k + 1) for k, v in enumerate(sorted(i * 7919 % 1009 for i in range(1000)))]


def test_stream_touches_its_buckets_only(spark, tmp_path):
    from cairnfield.streaming import incremental

    schema = "k string, v int, n int"
    inbox, out = str(tmp_path / "in"), str(tmp_path / "t")
    for rows in ([(f"k{i}", i, 1) for i in range(200)], [("k7", -7, 2)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(inbox)
        incremental.upserts(spark.readStream.schema(schema).parquet(inbox), out, str(tmp_path / "cp"), ["k"], [F.col("n")]).awaitTermination()
    now = {r["k"]: r["v"] for r in incremental.current(spark, out).collect()}
    assert now == {f"k{i}": i for i in range(200)} | {"k7": -7}
    assert len(list((tmp_path / "t" / "data" / "number=1").glob("bucket=*"))) == 1
    assert incremental.current(spark, out, before=1).filter("k = 'k7'").first()["v"] == 7


def test_budget_and_scripts(spark):
    calls = spark.range(5)
    assert readers.within_budget(calls, 5).count() == 5
    with pytest.raises(ValueError):
        readers.within_budget(calls, 4)
    rows = spark.createDataFrame([(1, "O'Neil", None)], "a int, b string, c string")
    assert writers.insert_statements(rows, "t", ["a", "b", "c"]).first()[0] == "insert into t (a, b, c) values ('1', 'O''Neil', null);"


def test_heights_along_lines_are_brute_force(spark):
    """Samples every ten metres over a grid with holes: the gaps between valid samples are filled linearly, the ends by the nearest."""
    from cairnfield.operators import elevation

    rng = random.Random(9)
    grid = {(i, j): float(rng.randint(0, 300)) for i in range(8) for j in range(8) if rng.random() < 0.6}
    lines = [(k, [(rng.uniform(0, 800), rng.uniform(0, 800)) for _ in range(rng.choice([2, 3, 4]))]) for k in range(10)] + [(99, [(5000.0, 5000.0), (5100.0, 5000.0)])]
    df = spark.createDataFrame(lines, f"id int, line {geo.LINE}")
    got = {r["id"]: r["series"] for r in elevation.sample(df, spark.createDataFrame([(i, j, z) for (i, j), z in grid.items()], "cx long, cy long, z double"), 100.0).collect()}
    points = {r["id"]: [(p["x"], p["y"]) for p in r["p"]] for r in df.select("id", geo.densify(F.col("line"), elevation.EVERY).alias("p")).collect()}
    for k, pts in points.items():
        z = [grid.get((int(x // 100), int(y // 100))) for x, y in pts]
        known = [i for i, v in enumerate(z) if v is not None]
        if not known:
            assert got[k] is None
            continue
        want = []
        for i, v in enumerate(z):
            before, after = [j for j in known if j <= i], [j for j in known if j >= i]
            if v is not None or not before or not after:
                want.append(v if v is not None else z[(before or after)[-1 if before else 0]])
            else:
                a, b = before[-1], after[0]
                want.append(z[a] + (z[b] - z[a]) * (i - a) / (b - a))
        assert got[k] == pytest.approx(want)


def test_stitching_is_greedy(spark):
    from cairnfield.operators import elevation

    rng = random.Random(3)
    rows = [(t, p, [(rng.uniform(0, 9), rng.uniform(0, 9)) for _ in range(2)], [float(10 * p + k) for k in range(3)]) for t in range(6) for p in range(rng.randint(1, 6))]
    got = {r["trail"]: r["series"] for r in elevation.stitch(spark.createDataFrame(rows, f"trail int, piece int, line {geo.LINE}, series array<double>")).collect()}
    for t in range(6):
        left = {p: (line[0], line[-1], series) for trail, p, line, series in rows if trail == t}
        ends = [e for a, b, _ in left.values() for e in (a, b)]
        cx, cy = sum(x for x, _ in ends) / len(ends), sum(y for _, y in ends) / len(ends)
        d2 = lambda p, q: (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2
        both = lambda: [(p, a, b, s) for p, (a, b, s) in left.items()] + [(p, b, a, s[::-1]) for p, (a, b, s) in left.items()]  # noqa: E731, B023
        p, _, at, series = max(both(), key=lambda q: d2(q[1], (cx, cy)))  # noqa: B023
        del left[p]
        while left:
            p, _, at, more = min(both(), key=lambda q: d2(q[1], at))  # noqa: B023
            series = series + more
            del left[p]
        assert got[t] == series


def test_clusters_are_greedy(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["1", "2", "33e"]), rng.uniform(0, 200), rng.uniform(0, 200), round(rng.uniform(20, 99), 3)) for _ in range(300)]
    kept = {}
    for label, x, y, conf in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
        if conf >= 30 and all(abs(x - a) > 20 or abs(y - b) > 20 for a, b in kept.get(label, [])):
            kept.setdefault(label, []).append((x, y))
    got = sites.cluster(spark.createDataFrame(rows, "label string, px double, py double, conf double"))
    assert sorted((r["label"], r["px"], r["py"]) for r in got.collect()) == sorted((k, *p) for k, ps in kept.items() for p in ps)
