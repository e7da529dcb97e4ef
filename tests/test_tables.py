import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from isograd import Cube, ValidationError
from isograd.operators import pyramid, select, tables
from isograd.operators.normalize import GeoExtent
from isograd.streaming.temporal import stream_aggregation

TIMES = [dt.datetime(2000, m, 1) for m in (1, 2, 3)]


@pytest.fixture(scope="module")
def cube(make):
    values = np.arange(24.0).reshape(3, 2, 4)
    return make([-45, 45], [-135, -45, 45, 135], TIMES, first=values, second=-values)


def test_tseries_point(make):
    cube = make(np.linspace(-67.5, 67.5, 4), np.linspace(-157.5, 157.5, 8), TIMES, abs=1.0, bbs=2.0)
    out = tables.tseries_point(cube.with_attrs(geospatial_lat_min=1, title="x"), "10, 5", "a*")
    row = out.df.first()
    assert out.df.count() == 3 and (row.lat, row.lon) == (22.5, 22.5)
    assert out.variables == ("abs",) and "geospatial_lat_min" not in out.attrs


def test_line_series(cube):
    rows = tables.line_series(cube, "first, second", "time", "lat=45, lon=45").collect()
    assert {(r.variable, r.x.month, r.value) for r in rows} >= {("first", 1, 6.0),
                                                                ("second", 3, -22.0)}
    with pytest.raises(ValidationError, match="more than one"):
        tables.line_series(cube, "first", None, "lat=45")
    with pytest.raises(ValidationError, match="names"):
        tables.line_series(cube, "")


def test_slices(cube):
    assert select.slice_for(cube, {"lat": 40}, ["time"], "first").df.count() == 3
    assert tables.slice_table(cube, "first").agg(F.max("first")).first()[0] == 7
    for bad in (dict(indexers="depth=3"), dict(indexers="lat=3", dims=("lat",)),
                dict(indexers="lat=3", dims=("depth",))):
        with pytest.raises(ValidationError):
            tables.slice_table(cube, "first", **bad)


def test_histogram_matches_numpy(cube):
    counts, edges = np.histogram(np.arange(24.0), bins=10)
    rows = tables.histogram(cube, "first").orderBy("bin").collect()
    assert [r["count"] for r in rows] == list(counts)
    np.testing.assert_allclose([r.low for r in rows], edges[:-1])
    flat = tables.histogram(cube, "first", "time='2000-01-01', lat=45, lon=45").collect()
    assert [(r.bin, r["count"]) for r in flat] == [(5, 1)]


def test_pairs_and_2d_histogram(cube):
    pairs = tables.scatter_pairs(cube, cube, "first", "second")
    assert pairs.where("x <> -y").count() == 0 and pairs.count() == 24
    rows = tables.histogram_2d(pairs, (3, 4)).collect()
    counts, _, _ = np.histogram2d(np.arange(24.0), -np.arange(24.0), bins=(3, 4))
    assert {(r.bx, r.by): r["count"] for r in rows} == {
        (x, y): counts[x, y] for x in range(3) for y in range(4) if counts[x, y]}
    assert tables.hexbin(pairs).agg(F.sum("count")).first()[0] == 24


def test_pair_checks(cube, make):
    with pytest.raises(ValidationError, match="dimensions"):
        tables.scatter_pairs(cube, cube, "first", "second", "time='2000-01-01'")
    other = make([-45, 0, 45], [-135, -45, 45, 135], TIMES, first=1.0)
    with pytest.raises(ValidationError, match="shapes"):
        tables.scatter_pairs(cube, other, "first", "first")
    with pytest.raises(ValidationError, match="subset"):
        tables.scatter_pairs(cube, cube, "first", "second", "depth=1")


def test_hovmoeller(cube):
    out = tables.hovmoeller(cube)
    assert out.columns == ["time", "lat", "first"] and out.count() == 6
    low = tables.hovmoeller(cube, "first", "lat", "lon", "median").orderBy("lat", "lon").first()
    assert low["first"] == 8
    for bad in (dict(x_axis="lat", y_axis="lat"), dict(method="mode"), dict(x_axis="depth")):
        with pytest.raises(ValidationError):
            tables.hovmoeller(cube, "first", **bad)


def test_animation(cube, make):
    assert tables.animation_frames(cube, "first").count() == 24
    assert tuple(tables.animation_range(cube, "first").first()) == (0, 7)
    assert tuple(tables.animation_range(cube, "first", true_range=True).first()) == (0, 23)
    empty = make([0], [0], TIMES, first=np.nan)
    with pytest.raises(PySparkException, match="missing values"):
        tables.animation_range(empty, "first", true_range=True).collect()


@pytest.mark.parametrize("low, high, kwargs, expected", [
    (1, 5, {}, (1, 5, False, "neither")),
    (-1, 5, {}, (-5, 5, True, "neither")),
    (-1, 5, {"center": False}, (-1, 5, False, "neither")),
    (1, 5, {"center": 3}, (1, 5, True, "neither")),
    (-1, 5, {"vmin": 0, "vmax": 4}, (0, 4, False, "both")),
    (1, 5, {"vmin": 2}, (2, 5, False, "min")),
    (-1, 5, {"vmax": 4}, (-4, 4, True, "max")),
])
def test_colour_range(spark, low, high, kwargs, expected):
    columns = tables.colour_range(F.lit(float(low)), F.lit(float(high)), **kwargs)
    assert tuple(spark.range(1).select(*columns).first()) == expected


def test_statistics(make):
    cube = make([0, 1], [0, 1], first=np.array([[0.012345, 0.2], [12.3456, np.nan]]))
    assert tuple(tables.variable_statistics(cube, "first").first()) == (0.01, 12.35)


GLOBE = GeoExtent(-180, -90, 180, 90, inv_y=True)


def growths(size, tile):
    """By how much an axis may grow, over all subdivisions that could be taken."""
    found = {0} if size == tile else set()
    for edge in range(min(size, tile // 2) or 1, min(size, 2 * tile) + 1):
        for tiles in range(1, 8):
            found |= {edge * tiles * 2 ** k - size for k in range(1, 15)
                      if 0 <= edge * tiles * 2 ** k - size < edge}
    return found or {0}


REGIONAL = GeoExtent(-11, 33, 29, 61, True)


@pytest.mark.parametrize("size, tile, extent", [
    ((2160, 1080), 310, GLOBE), ((640, 384), 150, GLOBE), ((50400, 25200), 480, GLOBE), ((96, 48), 48, GLOBE),
    ((941, 673), 128, REGIONAL), ((77, 31), 6, REGIONAL), ((40, 28), 333, REGIONAL),
    ((1301, 977), 211, GeoExtent(165, -20, -150, 25, True)),
])
def test_tiling(size, tile, extent):
    out = pyramid.tiling_scheme(*size, extent, tile, tile)
    full = [tiles * edge * 2 ** (out.levels - 1) for tiles, edge in (
        (out.tiles_x, out.tile_width), (out.tiles_y, out.tile_height))]
    assert out.levels >= 1 and all(f >= n for f, n in zip(full, size))  # the tiles cover the image
    grown = [f - n for f, n in zip(full, size)]
    if extent is GLOBE:
        assert grown[0] == 0 and (out.extent.west, out.extent.east) == (-180, 180)
    else:
        assert grown[0] <= min(growths(size[0], min(tile, size[0])))
    assert grown[1] <= min(growths(size[1], min(tile, size[1])))
    assert out.tile_width <= 2 * tile and out.tile_height <= 2 * tile
    # pixels keep their size; an axis grows at its far end
    high = (extent.north - extent.south) / size[1]
    assert out.extent.north == extent.north
    assert out.extent.south == pytest.approx(extent.north - full[1] * high)
    wide = (extent.east - extent.west) % 360 or 360
    assert ((out.extent.east - out.extent.west) % 360 or 360) == pytest.approx(full[0] * wide / size[0])


def test_tiling_may_not_leave_the_globe():
    with pytest.raises(ValueError):
        pyramid.tiling_scheme(77, 31, GeoExtent(-11, 59, 29, 90), 6, 6)


def test_pyramid(make):
    values = np.arange(32.0).reshape(4, 8)
    cube = make([-67.5, -22.5, 22.5, 67.5], np.linspace(-157.5, 157.5, 8), first=values)
    scheme = pyramid.TilingScheme(3, 1, 1, 2, 1, GLOBE)
    north_up = values[::-1]

    def level(df, z):
        rows = {(r.py, r.px): r.value for r in df.where(F.col("z") == z).collect()}
        size = max(k[0] for k in rows) + 1, max(k[1] for k in rows) + 1
        return np.array([[rows[y, x] for x in range(size[1])] for y in range(size[0])])

    out = pyramid.nearest_pyramid(cube, "first", scheme)
    for z, s in ((2, 1), (1, 2), (0, 4)):
        np.testing.assert_array_equal(level(out, z), north_up[::s, ::s])
    blocks = north_up.reshape(2, 2, 4, 2)
    for method, expected in (("mean", blocks.mean((1, 3))), ("sum", blocks.sum((1, 3))),
                             ("min", blocks.min((1, 3))), ("max", blocks.max((1, 3))),
                             ("first", north_up[::2, ::2])):
        out = pyramid.aggregated_pyramid(cube, "first", scheme, method)
        np.testing.assert_array_equal(level(out, 1), expected)
    assert out.where("z = 2 and px = 5").first().tile_x == 2
    with pytest.raises(ValidationError):
        pyramid.aggregated_pyramid(cube, "first", scheme, "median")


@pytest.mark.parametrize("method", pyramid.AGGREGATORS)
def test_pyramid_levels_with_gaps(spark, method):
    """Three levels of pixels with fractions and missing values against blocks level by level."""
    rng = np.random.default_rng(7)
    values = np.where(rng.random((10, 16)) < 0.1, np.nan, rng.normal(size=(10, 16)))
    rows = [(float(y), float(x), None if np.isnan(values[y, x]) else float(values[y, x]))
            for y in range(10) for x in range(16)]
    cube = Cube.of(spark.createDataFrame(rows, "lat double, lon double, first double"), ("lat", "lon"))
    out = pyramid.aggregated_pyramid(cube, "first", pyramid.TilingScheme(3, 1, 1, 4, 3, GLOBE), method,
                                     north_up=False)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and plan.count("Exchange ") == 1
    level = {(y, x): values[y, x] for y in range(10) for x in range(16)}
    got = {(r.z, r.py, r.px): r.value for r in out.collect()}
    for z in (2, 1, 0):
        for (y, x), v in level.items():
            value = got.pop((z, y, x))
            assert value is None if np.isnan(v) else value == pytest.approx(v, rel=1e-12)
        blocks = {}
        for (y, x), v in level.items():
            blocks.setdefault((y // 2, x // 2), {})[y % 2, x % 2] = v
        level = {k: combined(method, b) for k, b in blocks.items()}
    assert not got


def combined(method, block):
    there = [v for v in block.values() if not np.isnan(v)]
    if method == "first":
        return block[0, 0]
    if method in ("min", "max"):
        return getattr(np, method)(there) if there else np.nan
    return getattr(np, method)(there) if len(there) == 4 else np.nan


def test_stream(spark, tmp_path):
    rows = [(dt.datetime(2024, 1, d, h), 1.0, 2.0, float(d)) for d in range(1, 6)
            for h in (0, 12)]
    cells = spark.createDataFrame(rows, "time timestamp, lat double, lon double, v double")
    cells.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).parquet(str(tmp_path / "in"))
    out = stream_aggregation(stream, ("time", "lat", "lon"), ["v"], "1D", "sum", "1 hour")
    query = (out.writeStream.format("memory").queryName("bins").outputMode("append")
             .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True)
             .start())
    query.awaitTermination(120)
    found = {r.time.day: r.v for r in spark.table("bins").collect()}
    assert found == {1: 2.0, 2: 4.0, 3: 6.0, 4: 8.0}
    with pytest.raises(ValidationError):
        stream_aggregation(stream, ("time",), ["v"], "MS")


def test_cube_of_missing_columns(spark):
    with pytest.raises(ValidationError):
        Cube.of(spark.range(1), ["nowhere"])
