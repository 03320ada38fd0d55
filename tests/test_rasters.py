"""Windows of heights as files: round trips, what is opened, what is missing, what is broken, and lines sampled over them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairnfield.operators import elevation
from cairnfield.sources import rasters

SIZE = 4


@pytest.fixture
def grid(spark):
    """Cells of both signs, with a hole, a null, a NaN and a cell given twice."""
    rows = [(x, y, float(10 * x + y) + 0.25) for x in range(-6, 7) for y in range(-5, 9) if (x, y) not in ((1, 1), (2, 2), (3, 3))]
    return spark.createDataFrame([*rows, (2, 2, None), (3, 3, float("nan")), (0, 0, 99.0)], "cx long, cy long, z double")


def known(df):
    return {(r["cx"], r["cy"]): r["z"] for r in df.collect()}


def test_round_trip(spark, grid, tmp_path):
    windows = rasters.windows_of(grid, SIZE).unionByName(spark.createDataFrame([(400, 400)], "x0 long, y0 long"))
    rasters.write(windows, grid, str(tmp_path / "r"), SIZE, 30.0)
    want = {k: z for k, z in known(grid.groupBy("cx", "cy").agg(F.min("z").alias("z"))).items() if z is not None and z == z}
    assert known(rasters.cells(spark, str(tmp_path / "r"), windows)) == want
    asked = spark.createDataFrame([(0, 0), (400, 400), (800, 0)], "x0 long, y0 long")
    assert {(r["x0"], r["y0"]): r["state"] for r in rasters.states(spark, str(tmp_path / "r"), asked).collect()} == {(0, 0): "cached", (400, 400): "none", (800, 0): "fetch"}
    head = next(Path(tmp_path, "r/state=cached/x0=-8/y0=-8").glob("part-*")).read_text().splitlines()
    assert head[:6] == ["ncols 4", "nrows 4", "xllcorner -240.0", "yllcorner -240.0", "cellsize 30.0", "NODATA_value -9999"] and len(head) == 10


@pytest.mark.parametrize("named", [1000, 1])
def test_other_windows_are_not_opened(spark, grid, tmp_path, monkeypatch, named):
    monkeypatch.setattr(rasters, "NAMED", named)
    folder = str(tmp_path / "r")
    rasters.write(rasters.windows_of(grid, SIZE), grid, folder, SIZE, 30.0)
    for file in Path(folder, "state=cached/x0=-8/y0=4").glob("part-*"):
        file.write_text("ncols 4\nnrows 4\nxllcorner 0\nyllcorner 0\ncellsize 30\nNODATA_value -9999\n1 2 3\n")
    for file in Path(folder).rglob(".*.crc"):
        file.unlink()
    good, bad = (spark.createDataFrame(x, "x0 long, y0 long") for x in ([(0, 0), (4, 0)], [(-8, 4)]))
    assert set(known(rasters.cells(spark, folder, good))) == {(x, y) for x in range(0, 7) for y in range(4)} - {(1, 1), (2, 2), (3, 3)}
    with pytest.raises(Exception, match="rows of window -8,4"):
        rasters.cells(spark, folder, bad).collect()


def test_a_window_is_replaced_alone(spark, grid, tmp_path):
    folder = str(tmp_path / "r")
    rasters.write(rasters.windows_of(grid, SIZE), grid, folder, SIZE, 30.0)
    before = known(rasters.cells(spark, folder, rasters.windows_of(grid, SIZE)))
    one = spark.createDataFrame([(0, 4)], "x0 long, y0 long")
    rasters.write(one, grid.withColumn("z", F.lit(7.0)), folder, SIZE, 30.0)
    after = known(rasters.cells(spark, folder, rasters.windows_of(grid, SIZE)))
    inside = {k for k in before if 0 <= k[0] < 4 and 4 <= k[1] < 8}
    assert inside and {k for k in after if after[k] != before[k]} == inside and set(after) == set(before)
    rasters.write(one.limit(0), grid, folder, SIZE, 30.0)
    assert known(rasters.cells(spark, folder, one.limit(0))) == {} and known(rasters.cells(spark, str(tmp_path / "none"), one)) == {}
    assert rasters.states(spark, str(tmp_path / "none"), one).first()["state"] == "fetch"


def test_lines_over_windows(spark, grid, tmp_path):
    """Profiles over files are those over the cells themselves."""
    folder = str(tmp_path / "r")
    lines = spark.createDataFrame([(1, [(-150.0, -100.0), (170.0, 200.0)]), (2, [(0.0, 0.0), (900.0, 900.0)]), (3, [(5000.0, 5000.0), (5050.0, 5000.0)])], "id long, line array<struct<x: double, y: double>>")
    cells = lines.select(F.explode("line").alias("p")).select(F.floor(F.col("p.x") / 30).cast("long").alias("cx"), F.floor(F.col("p.y") / 30).cast("long").alias("cy"))
    windows = rasters.windows_of(cells.unionByName(grid.select("cx", "cy")), SIZE)
    rasters.write(windows, grid, folder, SIZE, 30.0)
    plain = grid.filter("not isnan(z)").groupBy("cx", "cy").agg(F.min("z").alias("z"))
    got, want = ({r["id"]: r["series"] for r in elevation.sample(lines, dem, 30.0).collect()} for dem in (rasters.cells(spark, folder, windows), plain))
    assert got == want and got[3] is None and got[1]
