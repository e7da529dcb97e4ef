import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isograd import Cube, ValidationError, literals
from isograd.functions.geo import crosses_antimeridian
from isograd.operators import axis, select, subset

KITE = [(-33.3, -12.7), (4.4, 31.2), (52.6, 8.9), (17.1, -40.3)]
DATELINE = [(171.2, -21.4), (-167.3, -19.8), (-168.9, 14.6), (172.5, 13.1)]


def wkt(ring):
    return "POLYGON((" + ", ".join(f"{x} {y}" for x, y in [*ring, ring[0]]) + "))"


def inside(ring, x, y):
    """Even-odd rule."""
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


@pytest.fixture(scope="module")
def globe(spark):
    """One-degree cells of a single layer."""
    i = F.col("id")
    cells = spark.range(360 * 180).select((F.floor(i / 360) - 89.5).alias("lat"),
                                          (i % 360 - 179.5).alias("lon"), F.lit(1.0).alias("first"))
    return Cube.of(cells, ("lat", "lon"))


@pytest.fixture(scope="module")
def coarse(make):
    return make(np.linspace(-75, 75, 6), np.linspace(-165, 165, 12), first=1.0)


def labels(cube, dim):
    return sorted(r[0] for r in cube.df.where("first is not null").select(dim).distinct().collect())


def test_box_is_padded_by_half_a_pixel(globe):
    out = subset.subset_spatial(globe, "-20, -10, 20, 10")
    assert out.df.count() == 22 * 42
    assert labels(out, "lat")[0] == -10.5 and labels(out, "lon")[-1] == 20.5


def test_polygon_mask(globe):
    out = subset.subset_spatial(globe, wkt(KITE))
    got = {(r.lat, r.lon) for r in out.df.where("first is not null").collect()}
    cells = [(y, x) for y in np.arange(-89.5, 90) for x in np.arange(-179.5, 180)]
    # a pixel belongs to the region if one of its corners does
    assert got == {(y, x) for y, x in cells if any(
        inside(KITE, x + dx, y + dy) for dx in (-.5, .5) for dy in (-.5, .5))} and len(got) > 1000
    corner = select.sel(subset.subset_spatial(globe, wkt(KITE), mask=False), point="-30.5, 25.5")
    assert corner.df.first()["first"] == 1 and (25.5, -30.5) not in got


def test_antimeridian_box(globe):
    out = subset.subset_spatial(globe, "170, -5, -170, 5")
    assert out.df.select("lon").distinct().count() == 360
    assert select.sel(out, point="0, 0").df.first()["first"] is None
    short = subset.subset_spatial(globe, "170, -5, -170, 5", keep_axis=False)
    assert short.df.count() == out.df.where("first is not null").count()


def test_antimeridian_polygon(globe):
    assert crosses_antimeridian(literals.polygon(wkt(DATELINE)))
    assert not crosses_antimeridian(literals.polygon(wkt(KITE)))
    with pytest.raises(NotImplementedError, match="anti-meridian"):
        subset.subset_spatial(globe, wkt(DATELINE))


def test_regions_of_several_polygons(globe):
    """A ring that falls apart, and two polygons given as one region, mask the cells of both."""
    fan = [(-30.2, -10.3), (-30.2, 20.4), (0.3, 5.1), (40.7, 30.2), (40.7, -20.9), (0.3, 5.1)]
    parts = [[(-30.2, -10.3), (-30.2, 20.4), (0.3, 5.1)], [(0.3, 5.1), (40.7, 30.2), (40.7, -20.9)]]
    both = "MULTIPOLYGON(" + ", ".join(wkt(p).removeprefix("POLYGON") for p in parts) + ")"
    cells = [(y, x) for y in np.arange(-89.5, 90) for x in np.arange(-179.5, 180)]
    want = {(y, x) for y, x in cells if any(inside(p, x + dx, y + dy) for p in parts
                                            for dx in (-.5, .5) for dy in (-.5, .5))}
    for region in (wkt(fan), both):
        out = subset.subset_spatial(globe, region)
        assert {(r.lat, r.lon) for r in out.df.where("first is not null").collect()} == want


def test_antimeridian_of_rings_that_break_when_shifted():
    # over Greenwich: shifted by 360 degrees its edges cross
    assert not crosses_antimeridian(literals.polygon([(-20, -10), (30, 12), (-25, 20), (28, -15), (40, 0)]))
    assert crosses_antimeridian(literals.polygon([(170, -10), (-170, -12), (-168, 10), (171, 12)]))


def around(lats, lons):
    """A slightly tilted ring about the cells of 30 degrees with these centres."""
    south, north, west, east = min(lats) - 9, max(lats) + 9, min(lons) - 10, max(lons) + 10
    return ((west, south), (west + 1, north), (east, north + 1), (east - 2, south - 1))


@pytest.mark.parametrize("lats, lons", [
    ([-45], [75]), ([-15, 15], [-105, -75]), ([45, 75], [135]), ([-75], [-45, -15, 15])])
def test_small_polygons(coarse, lats, lons):
    ring = around(lats, lons)
    for mask in (True, False):
        out = subset.subset_spatial(coarse, ring, mask=mask)
        assert labels(out, "lat") == lats and labels(out, "lon") == lons


def test_region_outside(make, globe):
    single = make([-45], [75], first=1.0)
    for mask in (True, False):
        with pytest.raises(ValueError, match="can not select"):
            subset.subset_spatial(single, around([-15], [105]), mask=mask)
        kept = subset.subset_spatial(single, around([-45], [75]), mask=mask)
        assert kept.df.count() == 1
    with pytest.raises(ValidationError, match="bounds"):
        subset.subset_spatial(globe, "-20, -100, 20, 10")


def test_variables_without_space_are_left_alone(make, spark):
    cube = make([-45, 45], [-90, 90], first=1.0)
    line = Cube.of(spark.createDataFrame([(1, 2.0)], "time int, second double"), ["time"])
    both = Cube((*cube.parts, *line.parts))
    out = subset.subset_spatial(both, "-100, 50, -95, 60")
    assert out.part_of("second").df.count() == 1 and out.part_of("first").df.count() == 1


def test_temporal(make):
    times = [dt.datetime(2000, m, 1) for m in range(1, 7)]
    cube = make([0], [0], times, first=1.0)
    assert subset.subset_temporal(cube, "2000-01-10, 2000-04-01").df.count() == 3
    by_index = subset.subset_temporal_index(cube, 2, 4).df.orderBy("time").collect()
    assert [r.time.month for r in by_index] == [3, 4, 5]
    assert subset.subset_temporal_index(cube, 4, 99).df.count() == 2
    with pytest.raises(ValidationError):
        subset.subset_temporal(make([0], [0], [1, 2], first=1.0), "2000-01-01, 2000-04-01")


def test_scan_gets_the_filters(spark, globe, tmp_path):
    path = str(tmp_path / "globe")
    globe.df.write.parquet(path)
    stored = Cube.of(spark.read.parquet(path), ("lat", "lon"))
    out = subset.subset_spatial(stored, "-20, -10, 20, 10")
    plan = spark._jvm.PythonSQLUtils.explainString(out.df._jdf.queryExecution(), "formatted")
    assert "GreaterThanOrEqual(lat,-10.5)" in plan and "LessThanOrEqual(lon,20.5)" in plan


def test_extract_point(spark):
    cells = [(x, y, d, float(10 * y + x + d / 1000)) for x in (12, 13, 14) for y in (22, 23, 24)
             for d in (1, 2)]
    cube = Cube.of(spark.createDataFrame(cells, "lon int, lat int, d1 int, v1 double"),
                   ("lon", "lat", "d1"))
    row = select.extract_point(cube, (13.2, 22.6), "d1=2").first()
    assert (row.lat, row.lon, row.v1) == (23, 13, 243.002)
    assert select.extract_point(cube, (17, 23), "d1=2").count() == 0
    assert select.extract_point(cube, (13, 23), "d1=7").count() == 0


def test_sel_ties_go_up(make):
    cube = make([-10, 0, 10], [0, 20], first=1.0)
    row = select.sel(cube, point="10, 5").df.first()
    assert (row.lat, row.lon) == (10, 20)
    assert select.sel(cube, indexers="lat=5", method="ffill").df.first().lat == 0
    assert select.sel(cube, indexers="lat=5", method="bfill").df.first().lat == 10
    with pytest.raises(ValidationError):
        select.sel(cube, indexers="lat=50", method="bfill").df.count()


@pytest.mark.parametrize("broadcast", [True, False])
def test_long_rings_mask_as_short_ones_do(make, monkeypatch, broadcast):
    """The crossings of a ring with the latitudes and the test of every edge give the same cells."""
    lats, lons = np.arange(-39.5, 40), np.arange(-59.5, 60)
    values = np.arange(lats.size * lons.size, dtype=float).reshape(1, lats.size, lons.size)
    turns = np.linspace(0, 2 * np.pi, 200, endpoint=False)
    far = 25 + 9 * np.sin(5 * turns) + np.where(np.arange(200) % 3, 2.0, -1.5)
    ring = [(float(np.round(1.4 * r * np.cos(t), 2)), float(np.round(r * np.sin(t), 2)))
            for r, t in zip(far, turns)] + [(0.5, 0.5)]  # a corner on a pixel corner
    cells = {}
    for limit in (16, 10_000):
        monkeypatch.setattr(subset, "SCANNED_EDGES", limit)
        monkeypatch.setattr(axis, "BROADCAST_ROWS", 1_000_000 if broadcast else 0)
        out = subset.subset_spatial(make(lats, lons, [dt.datetime(2000, 1, 1)], first=values), ring)
        cells[limit] = {(r.lat, r.lon): r.first for r in out.df.collect()}
    assert cells[16] == cells[10_000]
    assert 1000 < sum(v is not None for v in cells[16].values()) < len(cells[16])
