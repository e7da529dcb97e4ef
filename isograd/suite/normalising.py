"""Normalisation of coordinates and derived metadata."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from isograd.model import Cube
from isograd.operators import aggregate, normalize
from isograd.operators.arithmetic import ds_arithmetics
from isograd.operators.axis import axis_info
from isograd.operators.regrid import index_cells
from isograd.operators.select import select_var
from isograd.plans.views import cube_coarse, cube_fine, points, table
from isograd.sources import cubes
from isograd.suite.registry import case

COARSE = ("cube_coarse",)
SAME = "SELECT * FROM cube_coarse"


@case("n1_rename_coordinates", SAME, COARSE)
def renamed(spark, sf_dir):
    raw = cube_coarse(spark, sf_dir).df.withColumnsRenamed({"lat": "latitude", "lon": "long"})
    return normalize.normalize(Cube.of(raw, ("time", "latitude", "long"))).df


@case("n2_two_dimensional_coordinates", SAME, COARSE)
def flattened(spark, sf_dir):
    raw = cube_coarse(spark, sf_dir).df.withColumns({
        "y": (F.col("lat") + 75) / 30, "x": (F.col("lon") + 165) / 30})
    return normalize.normalize(Cube.of(raw, ("time", "y", "x"))).df


@case("n3_decreasing_latitude", """SELECT time, CAST(round((lat + 75) / 30) AS BIGINT) AS iy,
  CAST(round((lon + 165) / 30) AS BIGINT) AS ix, price, qty FROM cube_coarse""", COARSE)
def southward(spark, sf_dir):
    raw = cube_coarse(spark, sf_dir).df.orderBy(F.col("lat").desc())
    cube = normalize.normalize(Cube.of(raw, ("time", "lat", "lon")))
    info = axis_info(cube, "lat", "lon")
    return index_cells(cube.only_part, info["lat"], info["lon"])


@case("n4_longitudes_to_180", SAME, COARSE)
def wrapped(spark, sf_dir):
    lon = F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon"))
    raw = cube_coarse(spark, sf_dir).df.withColumn("lon", lon)
    return normalize.normalize(Cube.of(raw, ("time", "lat", "lon"))).df


@case("n4_longitudes_half_cell", SAME, COARSE)
def shifted(spark, sf_dir):
    lon = F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")) + 15
    raw = cube_coarse(spark, sf_dir).df.withColumn("lon", lon)
    attrs = {"geospatial_lon_min": 0.0, "geospatial_lon_max": 360.0}
    return normalize.normalize(Cube.of(raw, ("time", "lat", "lon"), attrs=attrs)).df


@case("n5_missing_time", """SELECT TIMESTAMP '2012-07-01 12:00:00' AS time, lat, lon,
  max(price) AS price, max(qty) AS qty FROM cube_coarse GROUP BY 2, 3""", COARSE)
def timeless(spark, sf_dir):
    flat = aggregate.reduce(cube_coarse(spark, sf_dir), dim="time", method="max")
    attrs = {"time_coverage_start": "20120101", "time_coverage_end": "20121231"}
    return normalize.normalize(replace(flat, attrs=attrs)).df


@case("n6_time_called_t", SAME, COARSE)
def time_called_t(spark, sf_dir):
    raw = cube_coarse(spark, sf_dir).df.withColumnRenamed("time", "t")
    return normalize.normalize(Cube.of(raw, ("t", "lat", "lon"))).df


@case("n7_julian_days", SAME, COARSE)
def julian(spark, sf_dir):
    days = F.unix_seconds(F.col("time").cast("timestamp")) / 86400 + normalize.JULIAN_EPOCH
    raw = cube_coarse(spark, sf_dir).df.withColumn("time", days)
    attrs = {"time": {"long_name": normalize.JULIAN_NAME}}
    return normalize.normalize(Cube.of(raw, ("time", "lat", "lon"), var_attrs=attrs)).df


@case("n8_dimension_order", SAME, COARSE)
def reordered(spark, sf_dir):
    raw = cube_coarse(spark, sf_dir).df
    return normalize.normalize(Cube.of(raw, ("lon", "lat", "time"))).df


def _row(spark, attrs: dict, names: list[str]):
    """The derived attributes as one row."""
    return spark.range(1).select(*(F.lit(attrs[n]).alias(n) for n in names))


@case("n9_temporal_attributes", """SELECT strftime(a, '%Y-%m-%dT%H:%M:%S') AS time_coverage_start,
  strftime(b, '%Y-%m-%dT%H:%M:%S') AS time_coverage_end,
  'P' || (date_diff('day', a, b) + 1) || 'D' AS time_coverage_duration,
  'P1M' AS time_coverage_resolution
FROM (SELECT min(time) AS a, max(time) AS b FROM cube_coarse)""", COARSE)
def temporal(spark, sf_dir):
    cube = normalize.adjust_temporal_attrs(cube_coarse(spark, sf_dir))
    return _row(spark, cube.attrs, ["time_coverage_start", "time_coverage_end",
                                    "time_coverage_duration", "time_coverage_resolution"])


@case("n10_spatial_attributes", """SELECT min(lon) - 15 AS geospatial_lon_min,
  max(lon) + 15 AS geospatial_lon_max, 30.0::DOUBLE AS geospatial_lon_resolution,
  min(lat) - 15 AS geospatial_lat_min, max(lat) + 15 AS geospatial_lat_max,
  30.0::DOUBLE AS geospatial_lat_resolution, 'degrees_east' AS geospatial_lon_units
FROM cube_coarse""", COARSE)
def spatial(spark, sf_dir):
    cube = normalize.adjust_spatial_attrs(cube_coarse(spark, sf_dir))
    return _row(spark, cube.attrs, [
        "geospatial_lon_min", "geospatial_lon_max", "geospatial_lon_resolution",
        "geospatial_lat_min", "geospatial_lat_max", "geospatial_lat_resolution",
        "geospatial_lon_units"])


@case("n12_geo_extent", """SELECT min(lon) - 7.5 AS west, min(lat) - 7.5 AS south,
  max(lon) + 7.5 AS east, max(lat) + 7.5 AS north FROM cube_fine""", ("cube_fine",))
def extent(spark, sf_dir):
    found = normalize.geo_extent(cube_fine(spark, sf_dir))
    return _row(spark, vars(found), ["west", "south", "east", "north"])


@case("n13_history", """SELECT time, lat, lon, price,
  'ds_arithmetics(op=''*2'')' AS history
FROM (SELECT time, lat, lon, price * 2 AS price FROM cube_coarse)""", COARSE)
def history(spark, sf_dir):
    cube = ds_arithmetics(select_var(cube_coarse(spark, sf_dir), "price"), "*2")
    return cube.df.withColumn("history", F.lit(cube.attrs["history"]))


@case("n14_from_data_frame", "SELECT id, value, kind FROM points", ("points",))
def from_table(spark, sf_dir):
    rows = points(spark, sf_dir).select("id", "value", "kind")
    return normalize.from_data_frame(rows, ["id"]).df


@case("s3_describe", """SELECT min(lon) AS lon_min, max(lon) AS lon_max,
  count(DISTINCT lon) AS lon_size, min(lat) AS lat_min, max(lat) AS lat_max,
  count(DISTINCT lat) AS lat_size, min(time) AS time_min, max(time) AS time_max,
  count(DISTINCT time) AS time_size FROM cube_coarse""", COARSE)
def described(spark, sf_dir):
    return cubes.extent(cube_coarse(spark, sf_dir).df)


@case("s3_describe_axes", """SELECT 'time' AS dim, count(DISTINCT time) AS size FROM cube_coarse
UNION ALL SELECT 'lat', count(DISTINCT lat) FROM cube_coarse
UNION ALL SELECT 'lon', count(DISTINCT lon) FROM cube_coarse""", COARSE)
def described_axes(spark, sf_dir):
    return cubes.describe(cube_coarse(spark, sf_dir)).select("dim", "size")


@case("s7_read_cube_table", """SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem""")
def read_table(spark, sf_dir):
    names = table(spark, sf_dir, "lineitem").columns
    keep = ("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return cubes.read_table_as_cube(spark, f"{sf_dir}/lineitem.parquet", ("l_orderkey", "l_linenumber"),
                              drop_variables=[n for n in names if n not in keep]).df
