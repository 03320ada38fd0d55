"""Closed-form cases of column functions and numpy kernels."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairnfield.functions import docs, geo, hulls, texts
from cairnfield.operators import classify, elevation, serve, sites


def one(spark, column, **values):
    row = spark.range(1).select(*[v.alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


def line(*points):
    return F.array(*[geo.point(F.lit(x), F.lit(y)) for x, y in points])


def numbers(*v):
    return F.array(*[F.lit(float(x)) if x is not None else F.lit(None).cast("double") for x in v])


def test_utm_of_the_meridian_and_of_a_known_place(spark):
    p = one(spark, geo.utm(F.lit(-87.0), F.lit(0.0)))
    assert (round(p["x"], 6), round(p["y"], 6)) == (500000, 0)
    q = one(spark, geo.utm(F.lit(-87.0), F.lit(43.4)))
    assert q["x"] == pytest.approx(500000) and q["y"] == pytest.approx(4805276, abs=50)


def test_distances_and_bearings(spark):
    assert one(spark, geo.metres(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(math.radians(1) * geo.EARTH_METRES)
    assert one(spark, geo.azimuth(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(0)
    assert one(spark, geo.azimuth(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0))) == pytest.approx(90)
    c = one(spark, geo.closest_on(line((0, 0), (3, 0), (3, 4)), F.lit(2.0), F.lit(1.0)))
    assert (c["d2"], c["x"], c["y"]) == (1.0, 2.0, 0.0) or (c["d2"], c["x"], c["y"]) == (1.0, 3.0, 1.0)
    assert one(spark, geo.planar_length(line((0, 0), (3, 0), (3, 4)))) == 7.0
    assert one(spark, geo.planar_length(line((0, 0)))) == 0.0


def test_areas(spark):
    square = line((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))
    assert one(spark, geo.shoelace(square)) == 1.0
    assert one(spark, geo.compactness(square)) == pytest.approx(math.pi / 4)
    c = one(spark, geo.centroid(F.struct(F.lit("Polygon").alias("type"), F.array(square).alias("parts"), F.array(F.lit(0)).alias("ring_of"))))
    assert (c["x"], c["y"]) == (pytest.approx(0.5), pytest.approx(0.5))
    holed = F.array(line((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), line((2, 2), (3, 2), (3, 3), (2, 3), (2, 2)))
    c = one(spark, geo.centroid(F.struct(F.lit("Polygon").alias("type"), holed.alias("parts"), F.array(F.lit(0), F.lit(0)).alias("ring_of"))))
    assert c["x"] == pytest.approx((16 * 2 - 2.5) / 15)


def test_densify(spark):
    d = one(spark, geo.densify(line((0, 0), (25, 0)), 10.0))
    assert [p["x"] for p in d] == [0.0, 10.0, 20.0, 25.0]
    assert [p["x"] for p in one(spark, geo.densify(line((0, 0), (20, 0)), 10.0))] == [0.0, 10.0, 20.0]
    assert len(one(spark, geo.densify(line((1, 1), (1, 1)), 10.0))) == 1


def test_elevation(spark):
    assert one(spark, elevation.smooth(numbers(3, 6, 9))) == [4.0, 6.0, 8.0]
    assert one(spark, elevation.smooth(numbers(3, 6))) == [3.0, 6.0]
    g = one(spark, elevation.gain_loss(numbers(0, 1.5, 3, 2, 0)))
    assert (g["gain"], g["loss"]) == (3.0, 3.0)
    assert one(spark, elevation.fill(numbers(None, 2, None, None, 8, None))) == [2.0, 2.0, 4.0, 6.0, 8.0, 8.0]
    assert one(spark, elevation.fill(numbers(None, None))) == [None, None]
    assert one(spark, elevation.resample(numbers(*range(79)))) == pytest.approx(np.interp(np.linspace(0, 78, 40), np.arange(79), np.arange(79)).tolist())
    assert one(spark, elevation.resample(numbers(5))) == [5.0]


@pytest.mark.parametrize(
    ("statuses", "want"),
    [(["available", "first-come-first-serve"], "available"), (["available", "reserved"], "partial"), (["reserved", "unknown"], "unavailable"), (["unknown", "not-yet-released"], "unknown"), ([], "unknown")],
)
def test_roll_up(spark, statuses, want):
    assert one(spark, serve.roll_up(F.array(*map(F.lit, statuses)).cast("array<string>"))) == want


@pytest.mark.parametrize(("start", "end", "n"), [("2026-07-01", "2026-07-04", 3), ("2026-07-01", "2026-07-01", 1), ("2026-07-04", "2026-07-01", 1), ("2026-01-01", "2026-04-01", 60)])
def test_nights(spark, start, end, n):
    assert len(one(spark, serve.nights(F.to_date(F.lit(start)), F.to_date(F.lit(end))))) == n


@pytest.mark.parametrize(
    ("tags", "bucket", "area"),
    [
        ({"route": "hiking", "highway": "path"}, "routes", False), ({"highway": "bus_stop", "amenity": "x"}, "pois", False), ({"natural": "spring"}, "water", False), ({"boundary": "y", "landuse": "z"}, "parks", True),
        ({"barrier": "gate"}, "barriers", False), ({"foo": "bar"}, "other", False), ({"area": "no", "building": "yes"}, "buildings", False), ({"building": "no"}, "buildings", True), ({"natural": "tree"}, "natural", False), ({"area": "yes"}, "other", True),
    ],
)
def test_classifier(spark, tags, bucket, area):
    m = F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])
    assert (one(spark, classify.bucket(m)), one(spark, classify.is_area(m))) == (bucket, area)


@pytest.mark.parametrize(("label", "key"), [("Site 60E", ("", "60")), ("60", ("", "60")), ("A2", ("A", "2")), ("2", ("", "2")), ("Walk-in", ("WALKIN", "")), (None, ("", ""))])
def test_site_key(spark, label, key):
    assert tuple(one(spark, texts.site_key(F.lit(label).cast("string")))) == key


def test_names(spark):
    assert one(spark, texts.same_place(F.lit("X Family Campground"), F.lit("Y Campground"))) is False
    assert one(spark, texts.same_place(F.lit("The RV Park"), F.lit("anything"))) is True
    assert one(spark, texts.route_label(F.array(F.lit("Oak Trail"), F.lit("Pine Loop")))) == "Oak + Pine Loop"
    assert one(spark, texts.route_label(F.array().cast("array<string>"))) == "Unnamed loop"
    assert one(spark, texts.climb_kind(F.lit(False), trad=F.lit(True), sport=F.lit(True))) == "trad/sport"


def test_template(spark):
    field = lambda k: {"a": F.lit("A"), "b": F.lit(None).cast("string"), "c": F.lit("0")}[k]
    assert one(spark, texts.template("{{a}}{{#if a}}[{{#if b}}x{{/if}}{{a}}]{{/if}}{{#if c}}no{{/if}}!", field)) == "A[A]!"
    with pytest.raises(ValueError):
        texts.template("{{#if a}}", field)


def test_documents(spark):
    d = docs.doc(F.lit('{"a":1,"b":{"c":[1,2]},"n":null,"e":""}'))
    assert one(spark, docs.text(docs.merge(d, docs.doc(F.lit('{"a":"x"}'))))) == '{"b":{"c":[1,2]},"e":"","n":null,"a":"x"}'
    assert one(spark, docs.text(docs.strip_nulls(d))) == '{"a":1,"b":{"c":[1,2]},"e":""}'
    assert one(spark, docs.text(docs.compact(d))) == '{"a":1,"b":{"c":[1,2]}}'
    assert one(spark, docs.text(docs.doc(F.lit("[1]")))) == "{}"
    assert one(spark, docs.text(docs.doc(F.lit("{broken")))) == "{}"
    assert one(spark, docs.field(d, "a", "int")) == 1
    assert one(spark, docs.text(docs.rename(d, "a", "z"))) == '{"b":{"c":[1,2]},"e":"","n":null,"z":1}'


def test_hulls():
    rng = np.random.default_rng(1)
    pts = rng.random((200, 2))
    ring = hulls.convex(pts)
    assert hulls.contains(ring * 1.0001 - 0.00005, pts).all() and hulls.area(ring) > 0
    assert hulls.area(hulls.convex(np.array([[0, 0], [1, 0], [1, 1], [0, 1], [0.5, 0.5]]))) == 1.0
    # a U shape: its concave hull leaves the notch out
    u = np.array([[x, y] for x in range(10) for y in range(10) if not (3 <= x <= 6 and y > 2)], float)
    inner = hulls.concave(u, 0.2)
    assert hulls.area(inner) < hulls.area(hulls.convex(u)) - 10
    grown = hulls.offset(inner, 0.3)
    assert hulls.area(grown) > hulls.area(inner)
    assert abs(hulls.area(hulls.buffer(np.array([[0.0, 0.0]]), 1.0, 32)) - math.pi) < 0.01
    assert len(hulls.simplify(np.array([[0, 0], [1, 0.01], [2, 0]]), 0.1)) == 2


def test_georeference():
    fit = sites.affine([(0, 0), (10, 0), (0, 10)], [(1, 2), (2, 2), (1, 1)])
    assert np.allclose(np.array([10, 10, 1]) @ fit, [2, 1])
    assert sites.residuals([(0, 0), (10, 0), (0, 10)], [(1, 2), (2, 2), (1, 1)], fit, 43.0)[1] < 1e-6
    assert sites.tiles(100, 50, (60, 50), (40, 50)) == [(0, 0, 60, 50), (40, 0, 100, 50)]
