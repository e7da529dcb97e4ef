"""Normalisation of coordinates, and metadata derived from axes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd import literals
from isograd.model import TEMPORAL, Cube, Part, ValidationError, ntz
from isograd.operators.axis import AxisInfo, axis_info, lat_dim, lon_dim

JULIAN_EPOCH = 2440587.5
JULIAN_NAME = "time in julian days"


def normalize(cube: Cube) -> Cube:
    """Bring coordinates into the common form.

    Longitude and latitude get short names, longitudes run from -180 to 180, a time column is
    called ``time`` and is a timestamp, and a dataset without time gets one label from its
    coverage attributes.  Dims are ordered time, other dims, lat, lon.  Rows have no order, so a
    decreasing latitude axis needs no reversal.
    """
    cube = _rename_coords(cube)
    cube = _drop_grid_indices(cube)
    cube = _wrap_lon(cube)
    cube = _julian_days(cube)
    cube = _add_time(cube)
    return _order_dims(cube)


def _renamed(cube: Cube, old: str, new: str) -> Cube:
    def apply(part: Part) -> Part:
        return Part(part.df.withColumnRenamed(old, new),
                    tuple(new if d == old else d for d in part.dims),
                    tuple(new if v == old else v for v in part.variables))

    axes = {new if d == old else d: a.withColumnRenamed(old, new) if d == old else a
            for d, a in cube.axes.items()}
    attrs = {new if k == old else k: v for k, v in cube.var_attrs.items()}
    return replace(cube.map(apply), axes=axes, known={}, var_attrs=attrs)


def _rename_coords(cube: Cube) -> Cube:
    columns = (*cube.dims, *cube.variables)
    for long_names, short in ((("longitude", "long"), "lon"), (("latitude",), "lat"),
                              (("t",), "time")):
        for name in long_names:
            if name in columns and short not in columns:
                cube = _renamed(cube, name, short)
                columns = (*cube.dims, *cube.variables)
    if "time" in cube.variables and "time" not in cube.dims:
        cube = cube.with_parts(tuple(
            Part(p.df, (*p.dims, "time"), tuple(v for v in p.variables if v != "time"))
            if "time" in p.variables else p for p in cube.parts))
    return cube


def _drop_grid_indices(cube: Cube) -> Cube:
    """2-D lat(y, x), lon(y, x) become the axes when lat is constant per y and lon per x."""
    if not {"lat", "lon"} <= set(cube.variables) or not {"y", "x"} <= set(cube.dims):
        return cube
    part = cube.part_of("lat")
    spread = [part.df.groupBy(index).agg((F.max(coord) - F.min(coord)).alias("s")).agg(F.max("s"))
              .first()[0] for index, coord in (("y", "lat"), ("x", "lon"))]
    if any(s is None or s > 1e-9 for s in spread):
        raise ValidationError("lat/lon are not equirectangular")
    def apply(p: Part) -> Part:
        dims = (*(d for d in p.dims if d not in ("y", "x")), "lat", "lon")
        names = tuple(v for v in p.variables if v not in ("lat", "lon"))
        return Part(p.df.select(*dims, *names), dims, names)

    return cube.map(apply, having=["y", "x"])


def _wrap_lon(cube: Cube) -> Cube:
    if "lon" not in cube.dims:
        return cube
    info = axis_info(cube, "lon")["lon"]
    if info.last is None or info.last <= 180:
        return cube
    # labels 1..360 of cells that the attributes place at 0..360 stand half a cell too far east
    attrs, shift = cube.attrs, 0.0
    if info.step and attrs.get("geospatial_lon_min") == 0 and attrs.get("geospatial_lon_max") == 360 \
            and info.last == 360:
        shift = info.step / 2
    lon = F.col("lon") - F.lit(shift)
    wrapped = F.when(lon > 180, lon - 360).otherwise(lon)
    cube = cube.map(lambda p: replace(p, df=p.df.withColumn("lon", wrapped)), having=["lon"],
                    keep=[d for d in cube.dims if d != "lon"])
    if "geospatial_lon_min" in attrs and "geospatial_lon_max" in attrs:
        if float(attrs["geospatial_lon_max"]) > 180:
            cube = cube.with_attrs(geospatial_lon_min=-180.0, geospatial_lon_max=180.0)
    return cube


def _julian_days(cube: Cube) -> Cube:
    named = cube.var_attrs.get("time", {}).get("long_name") == JULIAN_NAME
    if "time" not in cube.dims or not named:
        return cube
    stamp = F.timestamp_seconds((F.col("time") - JULIAN_EPOCH) * 86400).cast("timestamp_ntz")
    cube = cube.map(lambda p: replace(p, df=p.df.withColumn("time", stamp)), having=["time"])
    return replace(cube, var_attrs={**cube.var_attrs,
                                    "time": {**cube.var_attrs["time"], "long_name": "time"}})


def _coverage(value) -> dt.datetime | None:
    text = str(value).strip()
    if text.isdigit() and len(text) == 8:
        text = f"{text[:4]}-{text[4:6]}-{text[6:]}"
    return literals.time(text.removesuffix("Z"))


def _add_time(cube: Cube) -> Cube:
    if "time" in cube.dims or not {"time_coverage_start", "time_coverage_end"} <= set(cube.attrs):
        return cube
    start = _coverage(cube.attrs["time_coverage_start"])
    end = _coverage(cube.attrs["time_coverage_end"])
    middle = start + (end - start) / 2

    def apply(part: Part) -> Part:
        df = part.df.select(ntz(middle).alias("time"), *part.dims, *part.variables)
        return Part(df, ("time", *part.dims), part.variables)

    return cube.map(apply, having=["lat", "lon"], keep=cube.dims).with_attrs(
        time_bnds=(start, end))


def _order_dims(cube: Cube) -> Cube:
    rank = {"time": 0, "lat": 2, "lon": 3}

    def apply(part: Part) -> Part:
        dims = tuple(sorted(part.dims, key=lambda d: rank.get(d, 1)))
        return Part(part.df.select(*dims, *part.variables), dims, part.variables)

    return cube.map(apply, keep=cube.dims)


def _iso(value: dt.datetime) -> str:
    return value.isoformat(timespec="seconds")


def temporal_attrs(time: AxisInfo, bounds: tuple[dt.datetime, dt.datetime] | None = None) -> dict:
    """Coverage, duration and resolution of a time axis; None stands for "remove"."""
    if not time.size or not time.temporal:
        return {}
    start, end = bounds or (time.first, time.last)
    several = start < end
    resolution = None
    if several and time.second is not None:
        days = (time.second - time.first).days
        resolution = "P1M" if 27 < days < 32 else f"P{days}D"
    return {"time_coverage_start": _iso(start), "time_coverage_end": _iso(end),
            "time_coverage_duration": f"P{(end - start).days + 1}D" if several else None,
            "time_coverage_resolution": resolution}


def adjust_temporal_attrs(cube: Cube) -> Cube:
    """Refresh the temporal attributes from the time axis, or from its bounds when present.

    Bounds are variables ``time_bnds_start`` and ``time_bnds_end`` over time, or the attribute
    ``time_bnds``.
    """
    if "time" not in cube.dims or not isinstance(cube.dim_type("time"), TEMPORAL):
        return cube
    bounds = cube.attrs.get("time_bnds")
    if {"time_bnds_start", "time_bnds_end"} <= set(cube.variables):
        row = cube.part_of("time_bnds_start").df.agg(F.min("time_bnds_start"),
                                                     F.max("time_bnds_end")).first()
        bounds = (row[0], row[1])
    return cube.with_attrs(**temporal_attrs(axis_info(cube, "time")["time"], bounds))


def spatial_attrs(lon: AxisInfo, lat: AxisInfo, allow_point: bool = False) -> dict:
    """Extent at the cell edges, resolution, units and the outline as WKT."""
    if not lon.size or not lat.size:
        return {}
    if not allow_point and (lon.size == 1 or lat.size == 1):
        return {}
    dx, dy = (lon.step or 0.0) / 2, (lat.step or 0.0) / 2
    west, east = lon.first - dx, lon.last + dx
    south, north = lat.first - dy, lat.last + dy
    outline = (f"POLYGON(({west} {south}, {west} {north}, {east} {north}, {east} {south}, "
               f"{west} {south}))")
    return {"geospatial_lon_min": west, "geospatial_lon_max": east,
            "geospatial_lon_resolution": lon.step, "geospatial_lon_units": "degrees_east",
            "geospatial_lat_min": south, "geospatial_lat_max": north,
            "geospatial_lat_resolution": lat.step, "geospatial_lat_units": "degrees_north",
            "geospatial_bounds": outline}


def adjust_spatial_attrs(cube: Cube, allow_point: bool = False) -> Cube:
    lon, lat = lon_dim(cube), lat_dim(cube)
    if lon is None or lat is None:
        return cube
    info = axis_info(cube, lon, lat)
    return cube.with_attrs(**spatial_attrs(info[lon], info[lat], allow_point))


def from_data_frame(df: DataFrame, dims, variables=None) -> Cube:
    """A table becomes a cube by naming its dims; temporal attributes are added."""
    return adjust_temporal_attrs(Cube.of(df, dims, variables))


@dataclass(frozen=True)
class GeoExtent:
    """Outer cell edges; ``west > east`` runs over the antimeridian; ``inv_y``: rows go north."""

    west: float
    south: float
    east: float
    north: float
    inv_y: bool = False


def geo_extent(cube: Cube, eps: float = 1e-4, inv_y: bool = True) -> GeoExtent:
    """Extent of equidistant axes; western labels are shifted once if that closes a gap."""
    info = axis_info(cube, "lon", "lat")
    lon, lat = info["lon"], info["lat"]
    if lat.size > 1 and lat.max_step - lat.min_step >= eps:
        raise ValueError('coordinate variable "lat" is not equi-distant')
    shifted = False
    if lon.size > 1 and lon.max_step - lon.min_step >= eps:
        turned = cube.axis("lon").select(
            F.when(F.col("lon") < 0, F.col("lon") + 360).otherwise(F.col("lon")).alias("lon"))
        lon = axis_info(Cube((Part(turned, ("lon",), ()),)), "lon")["lon"]
        shifted = True
        if lon.max_step - lon.min_step >= eps:
            raise ValueError('coordinate variable "lon" is not equi-distant')
    steps = [i.step for i in (lon, lat) if i.step is not None]
    if not steps:
        raise ValueError("cannot determine cell size")
    dx, dy = lon.step or steps[0], lat.step or steps[0]
    east = lon.last + dx / 2
    if shifted and east > 180:
        east -= 360
    return GeoExtent(lon.first - dx / 2, lat.first - dy / 2, east, lat.last + dy / 2, inv_y)
