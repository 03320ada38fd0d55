"""Steps that failed, or grew too fast, on tables sixty times as large: what their plans and rows must keep to."""

import json
import random
import re
from time import monotonic

import pytest
from pyspark.sql import functions as F
from test_clusters import joins

from cairnfield.functions import geo
from cairnfield.operators import elevation, enrich, graph, loops, merge, spatial
from cairnfield.plans import feeds
from cairnfield.queries import QUERIES
from cairnfield.sources import readers, writers


@pytest.mark.parametrize("name", ["fuzzy_name_match"])
def test_nothing_is_broadcast(spark, sf, name):
    """Files of keys look small to the optimizer, whatever their rows come to."""
    assert not [j for j in joins(QUERIES[name](spark, sf)) if j.startswith("Broadcast")]


def test_a_vertex_meets_few_lots(spark, monkeypatch):
    """A town of 900 lots: no vertex is met with all of them, and the nearest is found."""
    met, within = [], spatial.within
    monkeypatch.setattr(spatial, "within", lambda *a: met.append(within(*a)) or met[-1])
    lots = spark.createDataFrame([(i, -89.9 + i % 30 * 0.01, 43.3 + i // 30 * 0.01) for i in range(900)], "lot long, x double, y double")
    routes = spark.createDataFrame([(r, [(-89.9 + r * 0.00307, 43.3 + r * 0.00283)]) for r in range(80)], "route long, line array<struct<x:double,y:double>>")
    got = {r["route"]: r["lot"] for r in loops.start_lot(routes, lots).collect()}
    assert got == {r: round(r * 0.283) * 30 + round(r * 0.307) for r in range(80)}
    assert 0 < sum(m.count() for m in met) < 80 * 20


def longest(spark, monkeypatch, query, sf):
    """The rows of a query, and the length of the longest text that it saves."""
    sizes, saved = [], feeds._saved

    def watched(texts, *args, **kwargs):
        sizes.append(texts.agg(F.max(F.length("value"))).first()[0])
        return saved(texts, *args, **kwargs)

    monkeypatch.setattr(feeds, "_saved", watched)
    return sorted(map(repr, query(spark, sf).collect())), max(sizes)


@pytest.mark.parametrize(("query", "per"), [(feeds.tree_climbs, "PER_TREE"), (feeds.tree_areas, "PER_TREE"), (feeds.paged_features, "PER_PAGE")])
def test_no_document_grows_with_the_table(spark, sf, monkeypatch, query, per):
    """With a few rows a document the rows are the same, and the documents are shorter."""
    rows, whole = longest(spark, monkeypatch, query, sf)
    monkeypatch.undo()
    monkeypatch.setattr(feeds, per, 1)
    again, part = longest(spark, monkeypatch, query, sf)
    assert rows == again and part * 2 < whole


def test_no_file_a_payload(spark, sf, monkeypatch):
    """Small payloads are lines of files, not files."""
    paths, saved = [], feeds._saved
    monkeypatch.setattr(feeds, "_saved", lambda *a, **k: paths.append(saved(*a, **k)) or paths[-1])
    state = {r["state"]: r["n"] for r in feeds.rejected_payloads(spark, sf).collect()}
    text = spark.read.text(paths[0])
    assert text.count() == sum(state.values()) > text.select(F.input_file_name()).distinct().count()


def test_no_file_a_response(spark, sf, monkeypatch):
    """Saved map responses are lines of files too."""
    paths, saved = [], feeds._saved
    monkeypatch.setattr(feeds, "PER_FILE", 5)
    monkeypatch.setattr(feeds, "_saved", lambda *a, **k: paths.append(saved(*a, **k)) or paths[-1])
    assert feeds.element_points(spark, sf).count() == feeds.element_points(spark, sf).select("fid").distinct().count() > 0
    text = spark.read.text(paths[0])
    assert text.count() > 2 * text.select(F.input_file_name()).distinct().count()


def test_a_long_trail_is_stitched(spark):
    """1,500 pieces of one trail, in a row: the work of a step does not grow with the square of what is left."""
    rows = [(1, i * 7 % 1500, [(float(i), 0.0), (i + 0.5, 0.0)], [float(i)]) for i in range(1500)]
    began = monotonic()
    got = elevation.stitch(spark.createDataFrame(rows, "trail int, piece int, line array<struct<x:double,y:double>>, series array<double>")).first()["series"]
    assert got in ([float(i) for i in range(1500)], [float(i) for i in range(1499, -1, -1)])
    assert monotonic() - began < 20


def crossing(spark, n, places, seed=5):
    """Lines that cross the whole of a square, every third of them twice, and points in it, a few of them far outside."""
    rng = random.Random(seed)
    ends = [(k, [(rng.random(), rng.random()), (rng.random(), rng.random())]) for k in range(n)]
    lines = ends + [(k + n, line) for k, line in ends[::3]]
    at = [(i, rng.random() * (1 if i % 50 else 40), rng.random()) for i in range(places)]
    return lines, at, spark.createDataFrame(lines, "rid long, line array<struct<x:double,y:double>>"), spark.createDataFrame(at, "lid long, lx double, ly double")


@pytest.mark.parametrize(("n", "block"), [(400, 1), (400, 30), (40_000, spatial.BLOCK)])
def test_points_meet_few_of_many_long_lines(spark, monkeypatch, n, block):
    """Blocks of any size give what all pairs give. Long lines that cross each other are not laid out cell by cell: the 40,000 took hundreds of millions of cells."""
    import numpy as np

    monkeypatch.setattr(spatial, "BLOCK", block)
    lines, at, df, points = crossing(spark, n, 300)
    began = monotonic()
    got = {r["lid"]: (r["rid"], r["d2"]) for r in spatial.nearest_on_lines(points, df).collect()}
    assert monotonic() - began < 40
    s = np.array([[*a, *b] for _, (a, b) in lines]).T
    want = {}
    for lid, x, y in at:
        d2 = spatial._on_segments(s, np.array([x]), np.array([y]))[0][0]
        want[lid] = (int(d2.argmin()), d2.min())
    assert got == want


def test_a_hop_goes_on_with_nearer_nodes_only(spark):
    """Nodes known to be nearer are not walked from again: a dense graph was relaxed whole with every hop."""
    both = spark.createDataFrame([(1, "a", "b", 1.0), (1, "b", "a", 1.0), (2, "b", "c", 1.0), (2, "c", "b", 1.0), (3, "b", "d", 1.0)], "eid long, a string, b string, len double")
    kind = "source string, node string, dist double, prev string, via long"
    best = spark.createDataFrame([("s", "a", 0.0, None, None), ("s", "b", 1.0, "a", 1), ("s", "d", 9.0, "a", 4)], kind)
    front = best.filter("node = 'b'")
    assert sorted((r["node"], r["dist"], r["prev"]) for r in graph._hop(front, both, best, None).collect()) == [("c", 2.0, "b"), ("d", 2.0, "b")]
    assert [r["node"] for r in graph._hop(front, both, best, 1.5).collect()] == []


def test_no_collection_grows_with_its_layer(spark, tmp_path):
    """A layer of many features is written as many collections, in parts; files of one collection beside them are read too."""
    rows = spark.range(9000).select(F.when(F.col("id") % 9 == 0, "few").otherwise("many").alias("source"), geo.geometry("Point", F.array(geo.point(F.col("id") / 100, F.lit(1.0)))).alias("geometry"), F.to_json(F.struct("id")).alias("properties"))
    for _ in range(2):
        assert writers.geojson_files(rows, str(tmp_path / "layers")) == ["few", "many"]
    (tmp_path / "layers" / "other.json").write_text('{"type": "FeatureCollection",\n "features": [{"type": "Feature", "geometry": null, "properties": {"id": 1}}]}')
    assert spark.read.text(str(tmp_path / "layers" / "many.geojson")).agg(F.max(F.length("value"))).first()[0] < 300_000
    ids = F.sum(F.get_json_object("properties", "$.id").cast("long"))
    count = lambda **how: {r[0]: tuple(r[1:]) for r in readers.geojson_folder(spark, str(tmp_path / "layers"), **how).groupBy("source").agg(F.count("*"), ids, F.max(F.get(geo.start(F.col("geometry.parts")), F.lit(0))["x"])).collect()}
    assert count() == {"few": (1000, sum(range(0, 9000, 9)), 89.91), "many": (8000, sum(i for i in range(9000) if i % 9), 89.99), "other": (1, 1, None)}
    assert list(count(include=["other", "few"], skip=["few"])) == ["other"]


def test_a_concave_hull_of_many_points():
    """12,000 points with a notch: a point meets the triangles of its column, not all of them, which took half a minute."""
    import numpy as np

    from cairnfield.functions import hulls

    at = np.random.default_rng(3).random((14_000, 2)) * 1000
    at = at[~((abs(at[:, 0] - 500) < 100) & (at[:, 1] > 300))][:12_000]
    began = monotonic()
    ring = hulls.concave(at, 0.02)
    assert monotonic() - began < 12
    assert hulls.area(ring) < hulls.area(hulls.convex(at)) - 100_000
    inside = hulls.contains(ring, at)
    assert inside.sum() + len(ring) - 1 >= len(at)


def test_a_long_line_is_sampled(spark):
    """A line of 6,000 segments: a mark meets its own segment, not all of them, and stretches are as one series."""
    at = [(float(i * 7), float(i % 2)) for i in range(6001)]
    line = spark.createDataFrame([(1, at)], f"id int, line {geo.LINE}")
    dem = spark.createDataFrame([(i, 0, float(i)) for i in range(0, 43_000 // 100, 90)], "cx long, cy long, z double")
    began = monotonic()
    got = elevation.sample(line, dem, 100.0).first()["series"]
    assert monotonic() - began < 20
    length = 6000 * (49 + 1) ** 0.5
    assert len(got) == int(length / 10) + 2 and got == sorted(got) and (got[0], got[-1]) == (0.0, 360.0)
    assert max(b - a for a, b in zip(got, got[1:], strict=False)) < 1


def test_candidates_of_a_point_are_not_sorted(spark, monkeypatch):
    """Even targets come to a point as one row: no aggregate over all pairs, which sorted 36 rows a point in one task."""
    seen, cut = [], spatial.cut
    monkeypatch.setattr(spatial, "cut", lambda df: seen.append(df) or cut(df))
    rng = random.Random(4)
    targets = [(i, i % 30 / 7, i // 30 / 7) for i in range(900)]
    at = [(i, rng.random() * 4.2 if i % 40 else 50.0, rng.random() * 4.2) for i in range(400)] + [(400, 1 / 14, 1 / 14)]
    got = spatial.nearest(spark.createDataFrame(at, "lid long, lx double, ly double"), spark.createDataFrame(targets, "rid long, rx double, ry double")).collect()
    want = {lid: min(((x - a) * (x - a) + (y - b) * (y - b), rid) for rid, a, b in targets) for lid, x, y in at}
    assert {r["lid"]: (r["d2"], r["rid"]) for r in got} == want and len(got) == len(at)
    rounds = [df for df in seen if "_best" in df.columns]
    assert len(rounds) > 1 and "SortAggregate" not in rounds[0]._jdf.queryExecution().executedPlan().toString()


def test_crowded_cells_are_parted(spark, monkeypatch):
    """Pairs of one crowded cell are tried in several tasks, and each pair is found once; points in one place are dealt apart too."""
    monkeypatch.setattr(spatial, "PAIRS", 50)
    rng = random.Random(8)
    left = [(i, rng.choice([0.0, 0.001, 0.5]), rng.random() / 1000) for i in range(300)]
    right = [(i, 0.0, rng.random() / 1000) for i in range(40)]
    near = spatial.within(spark.createDataFrame(left, "id long, lx double, ly double"), spark.createDataFrame(right, "rid long, rx double, ry double"), 5000.0)
    got = near.select("id", "rid", F.spark_partition_id().alias("task")).collect()
    assert sorted((r["id"], r["rid"]) for r in got) == [(i, j) for i, x, _ in left if x < 0.5 for j in range(40)]
    assert len({r["task"] for r in got}) > 1
    assert len({r["task"] for r in got if left[r["id"]][1] == 0.0}) > 1


def test_drawn_of_one_layer(spark):
    """Drawn features meet the table by id or by drawing id, as a loop over all pairs finds them; no join is on the layer alone."""
    rng = random.Random(26)
    text = lambda d: "{}" if d is None else json.dumps({"_draw_id": d})
    rows = [(k, rng.choice("st"), f"n{k}", rng.choice([None, f"d{rng.randrange(12)}", str(rng.randrange(40))])) for k in range(40)]
    drawn = [(rng.choice("st"), rng.choice([None, rng.randrange(60)]), f"m{k}", rng.choice([None, f"d{rng.randrange(20)}"])) for k in range(40)]
    drawn = [(s, k, n, d or f"e{n}") for s, k, n, d in drawn]
    table = spark.createDataFrame([(k, s, n, text(d), "{}") for k, s, n, d in rows], "id long, source string, name string, properties string, custom_data string")
    after, audit = merge.upsert_drawn(table, spark.createDataFrame([(s, k, n, text(d), None) for s, k, n, d in drawn], "source string, id long, name string, properties string, custom_data string"))
    known = {(s, k) for k, s, *_ in rows}
    fits = lambda r, d: r[1] == d[0] and (r[0] == d[1] if (d[0], d[1]) in known else r[3] == d[3])
    shown = lambda d: str(d[1]) if (d[0], d[1]) in known else d[3]
    want = [(r[0], r[1], d[2], shown(d)) for r in rows for d in drawn if fits(r, d)] + [r for r in rows if not any(fits(r, d) for d in drawn)]
    done = {(d[0], shown(d)) for r in rows for d in drawn if fits(r, d)}
    want += [(None, d[0], d[2], shown(d)) for d in drawn if (d[0], shown(d)) not in done]
    got = [(r["id"] if r["id"] < 40 else None, r["source"], r["name"], json.loads(r["properties"]).get("_draw_id")) for r in after.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(done) > 5
    assert {(r["source"], r["entity_id"]) for r in audit.filter("action = 'update'").collect()} == done
    keys = re.findall(r"(?:SortMergeJoin|HashJoin) \[([^\]]*)\]", after._jdf.queryExecution().sparkPlan().toString())
    assert keys and all("," in k for k in keys if "_part" not in k)


def test_map_ids_of_many_entries(spark):
    """Places and entries of one map meet once a place, not in all pairs; the first entry wins."""
    places = spark.range(3000).select("id", F.concat(F.lit("u?mapId=-"), (F.col("id") % 3).cast("string")).alias("url"))
    catalogue = spark.range(3000).select(F.col("id").alias("their_id"), (-(F.col("id") % 2)).alias("map_id"), (-F.floor(F.col("id") / 10)).alias("pos"))
    out = enrich.by_map_id(places, catalogue.repartition(2))
    assert {(r["id"] % 3, r["their_id"]) for r in out.collect()} == {(1, 2991)} and out.count() == 1000
    # the catalogue is grouped below the join
    join = re.search(r"Join[^\n]*\n(.*)", out._jdf.queryExecution().optimizedPlan().toString(), re.S).group(1)
    assert "Aggregate" in join


def test_utm_of_lines(spark):
    """A line in metres is utm() of its points, and each step's value is worked out once a point."""
    line = [(-89.9 + 0.01 * k, 43.3 + 0.003 * k) for k in range(30)]
    df = spark.createDataFrame([(line,)], f"line {geo.LINE}")
    apart = df.select(F.explode("line").alias("p")).select(geo.utm(F.col("p.x"), F.col("p.y")).alias("u"))
    whole = df.select(F.explode(geo.utm_line(F.col("line"))).alias("u"))
    assert whole.collect() == apart.collect()
    plan = loops.near_lots(df.select(F.lit(1).alias("eid"), "line"), df.select(F.lit(-89.9).alias("x"), F.lit(43.3).alias("y")).limit(1))._jdf.queryExecution().analyzed().toString()
    assert all(step.count("ATANH") < 4 for step in plan.split("\n") if "transform(" in step)


def test_pieces_without_points_are_not_met(spark, monkeypatch):
    """A long line is cut to the cells of its width only where points are near."""
    lines = spark.createDataFrame([(1, [(0.0, 0.0), (30_000.0, 20_000.0)])], f"rid int, line {geo.LINE}")
    points = spark.createDataFrame([(1, 15_000.0, 10_005.0), (2, 15_000.0, 10_900.0)], "lid int, lx double, ly double")
    dealt, passed = [], spatial._passed
    monkeypatch.setattr(spatial, "_passed", lambda segs, size: dealt.append(passed(segs, size)) or dealt[-1])
    assert [tuple(r) for r in spatial.lines_within(points, lines, 10.0).collect()] == [(1, 1)]
    assert dealt[0].count() < 100


def test_small_groups_share_calls(spark):
    """Groups of few lines are worked on many a call, and stay apart from each other."""
    rows = [(g, p, 2 * g + p, [(float(g), 3.0 * p), (g + 40.0, 3.0 * p)]) for g in range(300) for p in range(2)]
    out = loops.drop_doubled(spark.createDataFrame(rows, f"g long, pos int, eid long, line {geo.LINE}"), "g")
    assert sorted(r["eid"] for r in out.collect()) == [2 * g for g in range(300)]
    assert re.search(r"FlatMapGroupsInArrow \[call", out._jdf.queryExecution().optimizedPlan().toString())


def test_two_core_moves_keys_only(spark, monkeypatch):
    """What edges carry is not dealt about while dead ends are pruned, and a graph without any is not gone through."""
    ring = [(k, f"n{k}", f"n{(k + 1) % 9}", "x" * 50) for k in range(9)]
    tail = [(9, "n0", "t0", "y"), (10, "t0", "t1", "y"), (11, "z0", "z1", "y"), (12, "s", "s", "loop"), (12, "n0", "n4", "same id")]
    made, through = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: made.append(df.columns) or through(df))
    of = lambda rows: sorted(map(tuple, graph.two_core(spark.createDataFrame(rows, "eid long, a string, b string, name string")).collect()))
    assert of(ring) == ring and made == [["eid", "a", "b", "name"]]
    assert of(ring + tail) == sorted(ring + tail[3:])
    assert made[1:] == [["eid", "a", "b", "name"], ["eid", "a", "b"]]
