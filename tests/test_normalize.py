import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from isograd import Cube, ValidationError
from isograd.operators import normalize
from isograd.operators.axis import axis_info, lat_dim, lon_dim


def months(n=12):
    return [dt.datetime(2000, m, 1) for m in range(1, n + 1)]


@pytest.fixture(scope="module")
def globe(make):
    """Cells of 6 by 5 degrees."""
    return make(np.arange(-87.0, 90, 6), np.arange(-177.5, 180, 5), first=1.0)


def test_spatial_attributes(globe):
    out = normalize.adjust_spatial_attrs(globe).attrs
    edges = {k: out[f"geospatial_{k}"] for k in ("lat_min", "lat_max", "lon_min", "lon_max")}
    assert edges == {"lat_min": -90, "lat_max": 90, "lon_min": -180, "lon_max": 180}
    assert (out["geospatial_lat_resolution"], out["geospatial_lon_resolution"]) == (6, 5)
    assert out["geospatial_bounds"] == ("POLYGON((-180.0 -90.0, -180.0 90.0, 180.0 90.0, "
                                        "180.0 -90.0, -180.0 -90.0))")
    part = globe.where_label("lat", F.col("lat") > -28).where_label("lon", F.col("lon") < 33)
    out = normalize.adjust_spatial_attrs(part).attrs
    assert (out["geospatial_lat_min"], out["geospatial_lon_max"]) == (-30, 35)
    assert "geospatial_lat_min" not in globe.attrs


def test_single_cell_has_no_extent(make):
    cube = make([10], [20], first=1.0)
    assert normalize.adjust_spatial_attrs(cube).attrs == {}
    assert normalize.adjust_spatial_attrs(cube, allow_point=True).attrs["geospatial_lat_min"] == 10


def test_temporal_attributes(make):
    cube = normalize.adjust_temporal_attrs(make([0], [0], months(), first=1.0))
    assert cube.attrs == {"time_coverage_start": "2000-01-01T00:00:00",
                          "time_coverage_end": "2000-12-01T00:00:00",
                          "time_coverage_duration": "P336D", "time_coverage_resolution": "P1M"}
    part = cube.where_label("time", F.month("time").between(3, 6))
    out = normalize.adjust_temporal_attrs(part).attrs
    assert out["time_coverage_duration"] == "P93D"
    single = cube.where_label("time", F.month("time") == 3)
    out = normalize.adjust_temporal_attrs(single).attrs
    assert "time_coverage_resolution" not in out and "time_coverage_duration" not in out
    numbers = make([0], [0], [1, 2], first=1.0)
    assert normalize.adjust_temporal_attrs(numbers) is numbers


def test_temporal_bounds(spark):
    rows = [(d, d, d + dt.timedelta(days=30)) for d in months()]
    cube = Cube.of(spark.createDataFrame(
        rows, "time timestamp_ntz, time_bnds_start timestamp_ntz, time_bnds_end timestamp_ntz"),
        ["time"])
    out = normalize.adjust_temporal_attrs(cube).attrs
    assert out["time_coverage_end"] == "2000-12-31T00:00:00"
    assert out["time_coverage_duration"] == "P366D"


def test_wrap_360(make):
    cube = make([-12, 31], np.arange(5.0, 360, 10), first=np.arange(36.0))
    named = replace(cube, attrs={"geospatial_lon_min": 0.0, "geospatial_lon_max": 360.0})
    out = normalize.normalize(named)
    rows = out.df.where("lat = 31").orderBy("lon").collect()
    np.testing.assert_allclose([r.lon for r in rows], np.arange(-175.0, 180, 10))
    assert [r["first"] for r in rows] == [*range(18, 36), *range(18)]
    assert out.attrs["geospatial_lon_min"] == -180 and out.attrs["geospatial_lon_max"] == 180
    plain = normalize.normalize(make([0], [90, 270], first=1.0))
    assert sorted(r.lon for r in plain.df.collect()) == [-90, 90]


def test_names_time_and_order(spark):
    df = spark.range(4).select(F.lit(1.0).alias("latitude"), F.col("id").cast("double").alias(
        "longitude"), F.lit(dt.datetime(2005, 7, 2)).cast("timestamp_ntz").alias("t"),
        F.lit(2).alias("layer"), F.lit(5.0).alias("first"))
    cube = Cube.of(df, ["latitude", "longitude", "layer"])
    assert (lat_dim(cube), lon_dim(cube)) == ("latitude", "longitude")
    out = normalize.normalize(cube)
    assert out.dims == ("time", "layer", "lat", "lon") and out.variables == ("first",)


def test_missing_time(globe):
    first, last = dt.datetime(2009, 3, 5), dt.datetime(2010, 4, 26)
    attrs = {"time_coverage_start": "20090305", "time_coverage_end": "20100426"}
    out = normalize.normalize(replace(globe, attrs=attrs))
    assert out.dims == ("time", "lat", "lon")
    assert out.df.first().time == first + (last - first) / 2
    assert out.attrs["time_bnds"] == (first, last)


def test_julian_days(spark):
    cube = Cube.of(spark.createDataFrame([(2451544.5, 1.0), (2451575.5, 2.0)],
                                         "time double, first double"), ["time"],
                   var_attrs={"time": {"long_name": normalize.JULIAN_NAME}})
    out = normalize.normalize(cube)
    assert sorted(r.time for r in out.df.collect()) == months(2)
    assert out.var_attrs["time"]["long_name"] == "time"


def test_two_dimensional_coordinates(spark):
    rows = [(y, x, 10.0 * y, 20.0 * x + 0.0, 1.0) for y in range(2) for x in range(3)]
    schema = "y int, x int, lat double, lon double, first double"
    out = normalize.normalize(Cube.of(spark.createDataFrame(rows, schema), ["y", "x"]))
    assert out.dims == ("lat", "lon") and out.variables == ("first",)
    skewed = [(y, x, a + x, o, v) for y, x, a, o, v in rows]
    with pytest.raises(ValidationError, match="equirectangular"):
        normalize.normalize(Cube.of(spark.createDataFrame(skewed, schema), ["y", "x"]))


def test_geo_extent(make):
    out = normalize.geo_extent(make([10, 20, 30], [100, 110], first=1.0))
    assert (out.west, out.south, out.east, out.north) == (95, 5, 115, 35)
    across = normalize.geo_extent(make([10, 20], [-175, 165, 175, -165], first=1.0))
    assert (across.west, across.east) == (160, -160)
    with pytest.raises(ValueError, match="lat"):
        normalize.geo_extent(make([10, 20, 35], [100, 110], first=1.0))
    with pytest.raises(ValueError, match="lon"):
        normalize.geo_extent(make([10, 20], [100, 110, 125], first=1.0))


def test_axis_info(make, spark):
    cube = make([0, 1, 2.5], [5], months(3), first=1.0)
    info = axis_info(cube, "lat", "lon", "time")
    assert (info["lat"].size, info["lat"].step, info["lat"].equidistant()) == (3, 1, False)
    assert info["lon"].step is None and info["time"].second == dt.datetime(2000, 2, 1)
    text = Cube.of(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, v double"), ["k"])
    assert axis_info(text, "k")["k"].size == 2
    regular = axis_info(make(np.arange(10) * 10.0, [5], first=1.0), "lat")["lat"]
    cut = regular.between(20, 44)
    assert (cut.size, cut.first, cut.last) == (3, 20, 40)
    long = replace(regular, labels=None)
    cut = long.between(15, 44)
    assert (cut.size, cut.first, cut.last) == (3, 20, 40)
    assert long.between(20, 44) is None
    assert replace(info["lat"], labels=None).between(0.5, 2) is None


def test_history(make):
    cube = make([0], [0], first=1.0).stamped("a", x=1).stamped("b")
    assert cube.attrs["history"] == "a(x=1)\nb()"
