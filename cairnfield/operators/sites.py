"""Campground map digitisation: georeferencing, label detections, inventories."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnfield.functions import texts
from cairnfield.session import cut

#: Least confidence, merge distance (pixels), the map's dividing line and number ranges, far survivors (pixels).
CONFIDENCE, MERGE_PX, SPLIT_X, LOW_LAST, HIGH_FIRST, LAST_SITE, FAR_PX = 30.0, 20.0, 470.0, 100, 104, 250, 100.0


def affine(pixels: Sequence[tuple[float, float]], places: Sequence[tuple[float, float]]) -> np.ndarray:
    """Least-squares coefficients (3 x 2) from pixel to lon/lat; three control points at least."""
    a = np.hstack([np.asarray(pixels, float), np.ones((len(pixels), 1))])
    return np.linalg.lstsq(a, np.asarray(places, float), rcond=None)[0]


def georeference(x: Column, y: Column, coefficients: np.ndarray) -> Column:
    """struct<lon, lat> of a pixel as a linear expression."""
    (a, d), (b, e), (c, f) = coefficients.tolist()
    return F.struct((x * a + y * b + c).alias("lon"), (x * d + y * e + f).alias("lat"))


def to_pixel(lon: Column, lat: Column, coefficients: np.ndarray) -> Column:
    (a, d), (b, e), (c, f) = coefficients.tolist()
    det = a * e - b * d
    return F.struct((((lon - c) * e - (lat - f) * b) / det).alias("px"), (((lat - f) * a - (lon - c) * d) / det).alias("py"))


def residuals(pixels, places, coefficients: np.ndarray, latitude: float) -> tuple[float, float]:
    """Mean and greatest residual of the fit, in metres."""
    got = np.hstack([np.asarray(pixels, float), np.ones((len(pixels), 1))]) @ coefficients
    off = (got - np.asarray(places, float)) * [111_320.0 * np.cos(np.radians(latitude)), 111_320.0]
    d = np.hypot(*off.T)
    return float(d.mean()), float(d.max())


def tiles(width: int, height: int, tile: tuple[int, int], step: tuple[int, int]) -> list[tuple[int, int, int, int]]:
    """Overlapping windows over an image, the last ones flush with its edges."""

    def starts(size: int, t: int, s: int) -> list[int]:
        last = max(size - t, 0)
        return [*range(0, last, s), last]

    return [(x, y, min(x + tile[0], width), min(y + tile[1], height)) for y in starts(height, tile[1], step[1]) for x in starts(width, tile[0], step[0])]


def _near_cells(points: DataFrame, reach: float, columns: Sequence[str | Column], rings: int = 1) -> DataFrame:
    """Points (cx, cy) once for their own cell and each of the cells around it, so many rings of them."""
    steps = F.sequence(F.lit(-rings), F.lit(rings))
    spread = points.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return spread.select(*columns, (F.col("cx") + F.col("_i")).alias("cx"), (F.col("cy") + F.col("_j")).alias("cy"))


def suppressed(points: DataFrame, keys: Sequence[str], reach: float) -> DataFrame:
    """Of points (keys, px, py, conf) those that greedy suppression keeps: by falling conf (ties to the lesser px, then py), a point stays if none that stayed
    before, of its keys, is within `reach` of it each way.

    Nothing is gathered by key. Points are dealt to cells as wide as the reach, so that any two of a cell are in each other's way and only the surest
    left of each cell can stay next. It does if no surer one is left near it; then what is near it goes. Rounds end when no point
    is left; each meets every point with at most nine others, however crowded a cell is. Null keys are keys of their own; points without coordinates are left out."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    keyed = points.filter("px is not null and py is not null").distinct().withColumns({"_key": F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), "cx": cell("px"), "cy": cell("py")})
    left, kept = cut(keyed), []
    at, rank = ["_key", "cx", "cy"], F.struct((-F.col("conf")).alias("order"), F.col("px").alias("x"), F.col("py").alias("y"))
    close = (F.abs(F.col("px") - F.col("_best.x")) <= reach) & (F.abs(F.col("py") - F.col("_best.y")) <= reach)
    while not left.isEmpty():
        tops = left.groupBy(*at).agg(F.min(rank).alias("_best")).withColumn("_id", F.monotonically_increasing_id())
        tops = cut(tops)
        beaten = left.join(_near_cells(tops, reach, ["_key", "_best", "_id"]), at).filter(close & (rank < F.col("_best"))).select("_id").distinct()
        stay = cut(tops.join(beaten, "_id", "left_anti").select(*at, "_best"))
        same = (F.col("conf") == -F.col("_best.order")) & (F.col("px") == F.col("_best.x")) & (F.col("py") == F.col("_best.y"))
        kept.append(left.join(stay, at).filter(same).drop("_best"))
        around = _near_cells(stay, reach, ["_key", "_best"]).withColumnsRenamed({c: f"_{c}" for c in at})
        left = cut(left.join(around, (F.col("_key") == F.col("__key")) & (F.col("cx") == F.col("_cx")) & (F.col("cy") == F.col("_cy")) & close, "left_anti"))
    return reduce(DataFrame.unionByName, kept, keyed.limit(0)).drop(*at)


def cluster(detections: DataFrame, merge: float = MERGE_PX, least: float = CONFIDENCE) -> DataFrame:
    """label, px, py, conf (and map, where there is one): detections of one label on one map within `merge` pixels (each way) of a surer one are dropped, surest first."""
    keys = [c for c in ("map", "label") if c in detections.columns]
    number_ = lambda c: F.col(c).cast("double").alias(c)
    sure = detections.filter((F.col("conf") >= least) & texts.is_site_label(F.col("label")))
    return suppressed(sure.select(*keys, number_("px"), number_("py"), number_("conf")), keys, merge)


def number(label: Column) -> Column:
    return F.regexp_replace(label, "[eE]$", "").cast("int")


def plausible(sites: DataFrame) -> DataFrame:
    """Without numbers out of range, and without those stranded in the other half of the map."""
    n = number(F.col("label"))
    stranded = (n <= LOW_LAST) & (F.col("px") > SPLIT_X + 20) | (n >= HIGH_FIRST) & (F.col("px") < SPLIT_X - 30)
    return sites.filter(n.between(1, LAST_SITE) & ~stranded)


def without_fragments(sites: DataFrame, merge: float = MERGE_PX) -> DataFrame:
    """Without labels whose digits begin those of a longer label close by, on the same map where there is one.

    Every label is listed under each beginning of its digits, in cells of a power of two at most as wide as the reach. Whatever cell a shorter label asks, its square holds all of
    that cell or begins at the side or corner towards it, so of each beginning and cell only the points that no other one beats towards some corner can be needed: `_outermost`
    leaves those few, however crowded the cell is."""
    reach = max(merge * 1.6, 22.0)
    wide = 2.0 ** math.floor(math.log2(reach))
    digits = F.regexp_replace("label", "[eE]$", "")
    cell = lambda c: F.floor(F.col(c) / wide).cast("long")
    own = sites.withColumns({"d": digits, "cx": cell("px"), "cy": cell("py"), "om": F.col("map") if "map" in sites.columns else F.lit(0)})
    begins = F.transform(F.sequence(F.lit(0), F.length("d") - 1), lambda k: F.substring(F.col("d"), F.lit(1), k))
    longer = own.filter((F.length("d") > 0) & ~F.isnan("px") & ~F.isnan("py")).select("om", F.explode(begins).alias("d"), "px", "py", "cx", "cy")
    spread = _near_cells(_outermost(longer, ["om", "d", "cx", "cy"]), reach, ["om", "d", F.col("px").alias("ox"), F.col("py").alias("oy")], math.ceil(reach / wide))
    close = (F.abs(F.col("px") - F.col("ox")) <= reach) & (F.abs(F.col("py") - F.col("oy")) <= reach)
    # never broadcast: by the size of its file a table of keys looks much smaller than its rows are
    met = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("d", "cx", "cy")]
    return own.alias("a").join(spread.hint("merge").alias("b"), reduce(Column.__and__, met) & F.col("a.om").eqNullSafe(F.col("b.om")) & close, "left_anti").select(*sites.columns)


def _outermost(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of the points (keys, px, py) of each key those that no other one beats towards some corner: none is both as far that way in px and farther in py."""
    rows = points.groupBy(*keys, "px").agg(F.min("py").alias("low"), F.max("py").alias("high"))
    earlier = lambda order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    sides = [earlier(F.asc("px")), earlier(F.desc("px"))]
    marked = rows.withColumns({f"{f.__name__}{k}": f(c).over(w) for k, w in enumerate(sides) for f, c in ((F.min, "low"), (F.max, "high"))})
    beyond = lambda test: test("min0", "max0") | test("min1", "max1")
    low = F.when(beyond(lambda least, _: F.col(least).isNull() | (F.col("low") < F.col(least))), F.col("low"))
    high = F.when(beyond(lambda _, most: F.col(most).isNull() | (F.col("high") > F.col(most))), F.col("high"))
    return marked.select(*keys, "px", F.explode(F.array_distinct(F.array_compact(F.array(low, high)))).alias("py"))


def merge_inventory(inventory: DataFrame, found: DataFrame) -> DataFrame:
    """name, campground, px, py, origin of an inventory (name, campground, px, py): the detection (label, px, py) of the same number
    nearest to the expected place, else that place. Leading zeros and a trailing e do not count."""
    bare = lambda c: F.coalesce(F.nullif(F.regexp_replace(F.regexp_replace(F.col(c), "[eE]$", ""), "^0+", ""), F.lit("")), F.lit("0"))
    got = found.select(bare("label").alias("n"), F.col("px").alias("ox"), F.col("py").alias("oy"))
    d2 = (F.col("ox") - F.col("px")) * (F.col("ox") - F.col("px")) + (F.col("oy") - F.col("py")) * (F.col("oy") - F.col("py"))
    joined = inventory.withColumn("n", bare("name")).join(got, "n", "left")
    best = joined.groupBy("name", "campground", "px", "py").agg(F.min(F.when(F.col("ox").isNotNull(), F.struct(d2.alias("d2"), "ox", "oy"))).alias("b"))
    return best.select("name", "campground", F.coalesce("b.ox", "px").alias("x"), F.coalesce("b.oy", "py").alias("y"), F.when(F.col("b").isNotNull(), "ocr").otherwise("vision").alias("origin"))


def number_collisions(found: DataFrame) -> DataFrame:
    """n, places: numbers that are left at two places or more, for a reviewer."""
    return found.groupBy(number(F.col("label")).alias("n")).agg(F.count("*").alias("places")).filter("places > 1")


def nearest_duplicate(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows (id, px, py, ref_x, ref_y) with kept and far: of each key's rows the one nearest to its reference place is kept; survivors
    over FAR_PX away are marked."""
    d2 = (F.col("px") - F.col("ref_x")) * (F.col("px") - F.col("ref_x")) + (F.col("py") - F.col("ref_y")) * (F.col("py") - F.col("ref_y"))
    w = Window.partitionBy(*keys).orderBy("d2", "id")
    ranked = rows.withColumn("d2", d2).withColumn("kept", F.row_number().over(w) == 1)
    return ranked.withColumn("far", F.col("kept") & (F.col("d2") > FAR_PX * FAR_PX))


def hit(points: DataFrame, x: float, y: float, reach: float) -> DataFrame:
    """The point nearest to a click, within reach."""
    d2 = (F.col("px") - x) * (F.col("px") - x) + (F.col("py") - y) * (F.col("py") - y)
    return points.withColumn("d2", d2).filter(F.col("d2") <= reach * reach).orderBy("d2", "id").limit(1)


def tile_grid(images: DataFrame, tile: tuple[int, int], step: tuple[int, int]) -> DataFrame:
    """image, x0, y0, x1, y1 of overlapping windows over images (image, width, height), the last ones flush with the edges."""
    starts = lambda size, t, s: F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), F.greatest(size - t, F.lit(0)), F.lit(s)), lambda v: v < F.greatest(size - t, F.lit(0))), F.array(F.greatest(size - t, F.lit(0)).cast("int"))))
    w, h = F.col("width").cast("int"), F.col("height").cast("int")
    at = images.withColumn("x0", F.explode(starts(w, tile[0], step[0]))).withColumn("y0", F.explode(starts(h, tile[1], step[1])))
    return at.select("image", "x0", "y0", F.least(F.col("x0") + tile[0], w).alias("x1"), F.least(F.col("y0") + tile[1], h).alias("y1"))


def fit_errors(points: DataFrame, coefficients: np.ndarray, latitude: float) -> DataFrame:
    """One row, mean and greatest distance in metres between control points (px, py, lon, lat) and where the fit puts them."""
    at = georeference(F.col("px"), F.col("py"), coefficients)
    d = F.hypot((at["lon"] - F.col("lon")) * float(111_320.0 * np.cos(np.radians(latitude))), (at["lat"] - F.col("lat")) * 111_320.0)
    return points.agg(F.avg(d).alias("mean_m"), F.max(d).alias("max_m"))
