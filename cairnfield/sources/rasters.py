"""Height windows as files: Esri ASCII grids of cells, a file a window, with a negative cache among them.

A window is a box of size x size cells of the plane on a grid of its own size: x0, y0 are the cell coordinates of its lower left cell. Its file lies in
`state=cached/x0=<x0>/y0=<y0>` and is a grid with the usual header, the upper row first, NODATA where there is no height; a window without any coverage is an empty
grid under `state=none`. Folders are partitions, so readers choose windows before any file is opened, and Spark's commit puts whole files in place: rewriting a window replaces its
folder alone.

Writing groups cells by row, then rows by window; reading is a `binaryFile` scan of the windows that are asked for, decoded row by row in generators: a task holds the text of one window.
Files whose rows or columns are not as many as their header says raise an error. A null or not finite height is NODATA; cells given twice keep the least; cells outside of the
windows asked for are not written; no windows write no file.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NODATA = "-9999"
#: Windows up to which a scan names its partitions; for more it is given ranges of them, and a join leaves out the others' cells.
NAMED = 1000
FIELDS = ("ncols", "nrows", "xllcorner", "yllcorner", "cellsize")


def window_of(column: Column, size: int) -> Column:
    """The least coordinate of the window that a cell's coordinate lies in."""
    return (F.floor(column / size) * size).cast("long")


def windows_of(cells: DataFrame, size: int) -> DataFrame:
    """x0, y0 of the windows that cells (cx, cy) lie in."""
    return cells.select(window_of(F.col("cx"), size).alias("x0"), window_of(F.col("cy"), size).alias("y0")).distinct()


def _filled(entries: str, size: int, void: str, between: str) -> Column:
    """Texts v at ordered places i, joined, with `void` at the places up to `size` that have none."""
    before = lambda k: F.coalesce(F.get(entries, k - 1)["i"], F.lit(-1))
    parts = F.transform(entries, lambda x, k: F.concat(F.repeat(F.lit(void + between), (x["i"] - before(k) - 1).cast("int")), x["v"]))
    return F.concat(F.array_join(parts, between), F.repeat(F.lit(between + void), (size - 1 - F.element_at(entries, -1)["i"]).cast("int")))


def grids(windows: DataFrame, cells: DataFrame, size: int, cell: float) -> DataFrame:
    """state, x0, y0, value: the text of each window's file, from cells (cx, cy, z). Cells are of `cell` metres."""
    z = F.col("z").cast("double")
    there = z.isNotNull() & ~F.isnan(z) & (F.abs(z) < F.lit(float("inf")))
    one = cells.filter(there).groupBy("cx", "cy").agg(F.min(z).alias("z"))
    placed = one.select(window_of(F.col("cx"), size).alias("x0"), window_of(F.col("cy"), size).alias("y0"), F.col("cy"), (F.col("cx") - window_of(F.col("cx"), size)).alias("i"), "z")
    by_row = placed.groupBy("x0", "y0", "cy").agg(F.array_sort(F.collect_list(F.struct("i", F.col("z").cast("string").alias("v")))).alias("row"))
    void = " ".join([NODATA] * size)
    upper_first = F.struct((F.col("y0") + size - 1 - F.col("cy")).alias("i"), _filled("row", size, NODATA, " ").alias("v"))
    rows = by_row.select("x0", "y0", upper_first.alias("line")).groupBy("x0", "y0").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    body = _filled("lines", size, void, "\n")
    n = F.when(F.col("lines").isNull(), 0).otherwise(size)
    header = [f"{k} " for k in FIELDS]
    values = [n, n, F.col("x0") * F.lit(cell), F.col("y0") * F.lit(cell), F.lit(cell)]
    head = F.concat(*[F.concat(F.lit(k), v.cast("string"), F.lit("\n")) for k, v in zip(header, values, strict=True)], F.lit(f"NODATA_value {NODATA}\n"))
    out = windows.select("x0", "y0").distinct().join(rows, ["x0", "y0"], "left")
    return out.select(F.when(F.col("lines").isNull(), "none").otherwise("cached").alias("state"), "x0", "y0", F.concat(head, F.coalesce(body, F.lit(""))).alias("value"))


def write(windows: DataFrame, cells: DataFrame, folder: str, size: int, cell: float) -> None:
    """The windows' files, over those of the same windows and states; others stay."""
    made = grids(windows, cells, size, cell)
    made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("state", "x0", "y0").text(folder)


def _scan(spark: SparkSession, folder: str) -> DataFrame:
    """The files as binaryFile has them, with state, x0, y0. A folder that is not there or empty has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hadoop.Path(folder, "state=*/x0=*/y0=*")):
        return spark.createDataFrame([], "content binary, state string, x0 long, y0 long")
    return spark.read.format("binaryFile").load(folder).select("content", "state", F.col("x0").cast("long").alias("x0"), F.col("y0").cast("long").alias("y0"))


def states(spark: SparkSession, folder: str, windows: DataFrame) -> DataFrame:
    """x0, y0, state of the windows: cached, none (known to have no coverage), or fetch. No file is opened."""
    known = _scan(spark, folder).groupBy("x0", "y0").agg(F.min("state").alias("state"))  # cached before none
    return windows.select("x0", "y0").distinct().join(known, ["x0", "y0"], "left").select("x0", "y0", F.coalesce("state", F.lit("fetch")).alias("state"))


def _partitions(windows: DataFrame) -> Column | None:
    """A condition on x0 and y0 that the scan can choose its partitions by; none if there are no windows."""
    few = windows.limit(NAMED + 1).collect()
    if not few:
        return None
    if len(few) <= NAMED:
        by_x: dict[int, list[int]] = {}
        for x0, y0 in few:
            by_x.setdefault(x0, []).append(y0)
        return reduce(Column.__or__, [(F.col("x0") == x) & F.col("y0").isin(ys) for x, ys in sorted(by_x.items())])
    r = windows.agg(F.min("x0"), F.max("x0"), F.min("y0"), F.max("y0")).first()
    return F.col("x0").between(r[0], r[1]) & F.col("y0").between(r[2], r[3])


def cells(spark: SparkSession, folder: str, windows: DataFrame) -> DataFrame:
    """cx, cy, z of the cells that have a height in the files of the windows (x0, y0); others are not opened, as long as windows are few enough to be named."""
    wanted = windows.select("x0", "y0").distinct()
    chosen = _partitions(wanted)
    files = _scan(spark, folder).filter((F.col("state") == "cached") & (F.lit(False) if chosen is None else chosen)).join(wanted, ["x0", "y0"], "left_semi")
    lines = files.select("x0", "y0", F.split(F.col("content").cast("string"), "\r?\n").alias("lines"))
    number = lambda k: F.regexp_extract(F.get("lines", F.lit(FIELDS.index(k))), rf"(?i)^{k}\s+(\S+)", 1).cast("double")
    head = lines.select(
        *[number(k).cast("long").alias(k) for k in FIELDS[:2]], *[F.round(number(k) / number("cellsize")).cast("long").alias(c) for k, c in (("xllcorner", "left"), ("yllcorner", "low"))],
        F.regexp_extract(F.get("lines", F.lit(5)), r"(\S+)\s*$", 1).cast("double").alias("void"), F.filter(F.slice("lines", 7, F.greatest(F.size("lines") - 6, F.lit(0))), lambda x: x != "").alias("body"), "x0", "y0",
    )
    wrong = lambda what: F.raise_error(F.concat(F.lit(f"{what} of window "), F.concat_ws(",", F.col("x0").cast("string"), F.col("y0").cast("string")), F.lit(" are not as its header says")))
    whole = head.withColumn("body", F.when(F.size("body") == F.col("nrows"), F.col("body")).otherwise(wrong("rows")))
    row = whole.select("x0", "y0", "left", "ncols", "void", (F.col("low") + F.col("nrows") - 1).alias("top"), F.posexplode("body").alias("j", "line"))
    values = row.withColumn("values", F.split(F.trim("line"), r"\s+")).withColumn("values", F.when(F.size("values") == F.col("ncols"), F.col("values")).otherwise(wrong("columns")))
    cell = values.select("left", "void", (F.col("top") - F.col("j")).alias("cy"), F.posexplode("values").alias("i", "v"))
    z = F.col("v").cast("double")
    return cell.filter(z != F.col("void")).select((F.col("left") + F.col("i")).alias("cx"), "cy", z.alias("z"))
