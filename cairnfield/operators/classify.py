"""Tag classification and predicates of layers: buckets, areas, filter presets and client expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tag values that decide buckets, and keys and values that make a closed way an area (None: any value).
ROUTES = ["hiking", "foot", "bicycle", "mtb", "canoe"]
TRAILS = ["path", "footway", "track", "steps", "bridleway", "cycleway"]
ROADS = [
    "motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link",
    "unclassified", "residential", "service", "living_street", "road",
]
CROSSINGS = ["crossing", "traffic_signals", "stop", "give_way"]
WATERS = ["water", "wetland", "spring"]
PARKS = ["park", "nature_reserve", "common", "dog_park"]
BUCKETS = ["trails", "roads", "water", "natural", "parks", "landuse", "buildings", "parking", "pois", "routes", "barriers", "infrastructure", "other"]
AREAS: dict[str, list[str] | None] = {
    "natural": ["water", "wetland", "wood", "forest", "grassland", "heath", "scrub", "rock", "bare_rock", "sand", "beach", "glacier", "fell"],
    "landuse": None,
    "building": None,
    "leisure": ["park", "nature_reserve", "garden", "pitch", "camp_site", "campsite", "common", "dog_park", "golf_course"],
    "amenity": ["parking", "school", "university", "hospital", "place_of_worship", "marketplace"],
    "boundary": None,
}


def bucket(tags: Column) -> Column:
    """The layer of a map<string, string> of tags: the first rule that holds. Empty values count as missing."""
    tag = lambda k: F.coalesce(tags.getItem(k), F.lit(""))
    any_of = lambda *keys: reduce(lambda a, b: a | b, [tag(k) != "" for k in keys])
    rules = [
        ("routes", tag("route").isin(ROUTES)),
        ("trails", tag("highway").isin(TRAILS)),
        ("roads", tag("highway").isin(ROADS + CROSSINGS)),
        ("water", tag("natural").isin(WATERS) | any_of("waterway", "water")),
        ("natural", any_of("natural")),
        ("parks", tag("leisure").isin(PARKS) | any_of("boundary")),
        ("landuse", any_of("landuse")),
        ("buildings", any_of("building")),
        ("parking", (tag("amenity") == "parking") | any_of("parking")),
        ("pois", any_of("leisure", "amenity", "tourism", "shop", "historic", "information", "emergency", "sport")),
        ("infrastructure", any_of("man_made", "power", "railway")),
        ("barriers", any_of("barrier")),
    ]
    return reduce(lambda out, rule: out.when(rule[1], rule[0]), rules[1:], F.when(rules[0][1], rules[0][0])).otherwise("other")


def is_area(tags: Column) -> Column:
    """Whether a closed way with these tags is an area: area=yes/no decides, else any key of AREAS with a value of its list."""
    rules = [F.map_contains_key(tags, k) if values is None else F.coalesce(tags.getItem(k).isin(values), F.lit(False)) for k, values in AREAS.items()]
    area = F.coalesce(tags.getItem("area"), F.lit(""))
    return F.when(area == "yes", True).when(area == "no", False).otherwise(reduce(lambda a, b: a | b, rules))


def preset(conditions: list[dict], match: str, field) -> Column:
    """A saved filter as a Column: match is all or any; a condition has field, op, value. `field` gives a Column for a field's name.
    Comparisons with a number cast the field; a field that is missing, or no number, fails them."""

    def one(c: dict) -> Column:
        f, op, v = field(c["field"]), c["op"], c.get("value")
        if op in ("exists", "not_exists"):
            return f.isNotNull() if op == "exists" else f.isNull()
        if op == "contains":
            return F.coalesce(f.contains(str(v)), F.lit(False))
        left = f.try_cast("double") if isinstance(v, (int, float)) and not isinstance(v, bool) else f
        test = {"<": left < v, "<=": left <= v, ">": left > v, ">=": left >= v, "=": left == v, "!=": left != v}[op]
        return F.coalesce(test, F.lit(False))

    tests = [one(c) for c in conditions]
    if not tests:
        return F.lit(match == "all")
    return reduce((lambda a, b: a & b) if match == "all" else (lambda a, b: a | b), tests)


def expression(e: list | str | float | bool | None, field) -> Column:
    """A client's style expression (nested lists) as a Column: all, any, !, get, has, in and comparisons."""
    if not isinstance(e, list):
        return F.lit(e)
    op, rest = e[0], e[1:]
    if op == "literal":
        return F.array(*map(F.lit, rest[0])) if isinstance(rest[0], list) else F.lit(rest[0])
    if op in ("get", "has"):
        return field(rest[0]) if op == "get" else field(rest[0]).isNotNull()
    if op in ("all", "any"):
        parts = [F.coalesce(expression(x, field), F.lit(False)) for x in rest]
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), parts, F.lit(op == "all"))
    if op == "!":
        return ~F.coalesce(expression(rest[0], field), F.lit(False))
    left, right = (expression(x, field) for x in rest)
    if op == "in":
        return F.array_contains(right, left)
    if any(isinstance(x, (int, float)) and not isinstance(x, bool) for x in rest):
        left, right = left.try_cast("double"), right.try_cast("double")
    return {"==": left == right, "!=": ~left.eqNullSafe(right), "<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]


def in_box(lon: Column, lat: Column, south: float, west: float, north: float, east: float) -> Column:
    """Inside a box; false for anything that is no number."""
    x, y = lon.try_cast("double"), lat.try_cast("double")
    return F.coalesce(x.between(west, east) & y.between(south, north), F.lit(False))
