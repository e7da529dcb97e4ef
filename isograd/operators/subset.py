"""Temporal and spatial subsets."""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd import literals
from isograd.functions.geo import (
    SCANNED_EDGES,
    crosses_antimeridian,
    inside_rings,
    right_of_odd,
    ring_crossings,
)
from isograd.model import TEMPORAL, Cube, Part, ValidationError, literal
from isograd.operators.axis import AxisInfo, axis_info, hint_small, label_at
from isograd.session import checkpoint


def subset_temporal(cube: Cube, time_range) -> Cube:
    """Cells with time in the closed range; variables without time are left alone."""
    found = literals.time_range(time_range)
    if found is None:
        return cube
    if "time" not in cube.dims or not isinstance(cube.dim_type("time"), TEMPORAL):
        raise ValidationError("a temporal subset needs a time coordinate of a timestamp type")
    low, high = found
    known = cube.known.get("time")
    return cube.where_label("time", F.col("time").between(literal(low), literal(high)),
                            known.between(low, high) if known is not None else None)


def subset_temporal_index(cube: Cube, time_ind_min: int, time_ind_max: int) -> Cube:
    """Cells whose time stands at the positions min..max (inclusive) of the time axis."""
    axis_info(cube, "time")
    low, high = label_at(cube, "time", time_ind_min), label_at(cube, "time", time_ind_max)
    if low is None:
        return cube.where_label("time", F.lit(False))
    condition = F.col("time") >= literal(low)
    if high is not None:
        condition = condition & (F.col("time") <= literal(high))
    return cube.where_label("time", condition)


@dataclass(frozen=True)
class Box:
    """A padded bounding box; ``west > east`` means it runs over the antimeridian."""

    west: float
    south: float
    east: float
    north: float

    @property
    def lat_test(self) -> Column:
        return F.col("lat").between(F.lit(self.south), F.lit(self.north))

    @property
    def lon_test(self) -> Column:
        lon = F.col("lon")
        if self.west > self.east:
            return (lon >= F.lit(self.west)) | (lon <= F.lit(self.east))
        return lon.between(F.lit(self.west), F.lit(self.east))


def _pad(bounds, lon: AxisInfo, lat: AxisInfo) -> tuple[float, float, float, float]:
    """Half a pixel on each side, so that crossed pixels are kept; clamped to the globe."""
    dx, dy = (lon.step or 0.0) / 2, (lat.step or 0.0) / 2
    west, south, east, north = bounds
    return (max(west - dx, -180.0), max(south - dy, -90.0),
            min(east + dx, 180.0), min(north + dy, 90.0))


def _four_numbers(region) -> bool:
    if isinstance(region, str):
        return region.count(",") == 3 and "(" not in region
    if isinstance(region, (list, tuple)):
        return len(region) == 4 and all(isinstance(v, (int, float)) for v in region)
    return False


def subset_spatial(cube: Cube, region, mask: bool = True, keep_axis: bool = True) -> Cube:
    """Cells of a region: an explicit box, or a polygon whose outside cells are masked.

    Over the antimeridian the whole longitude axis is kept and cells outside become NULL;
    ``keep_axis=False`` leaves those rows out instead, which lets the scan skip them.  Only the
    exterior rings of polygons are looked at; invalid ones are healed before.
    """
    if "lon" not in cube.dims or "lat" not in cube.dims:
        raise ValidationError("cannot apply a regional subset: no valid geocoding found")
    shape = literals.polygon(region)
    explicit = _four_numbers(region)
    bounds = tuple(shape.box) if explicit else shape.bounds
    west, south, east, north = bounds
    if not all(-90 <= v <= 90 for v in (south, north)) or not all(
            -180 <= v <= 180 for v in (west, east)):
        raise ValidationError("the region extends outside of the geo-spatial bounds")
    info = axis_info(cube, "lon", "lat")
    padded = _pad(bounds, info["lon"], info["lat"])
    crossing = padded[0] > padded[2] if explicit else crosses_antimeridian(shape)
    simple = explicit or shape.is_box
    if crossing:
        if mask and not simple:
            raise NotImplementedError("spatial subsets crossing the anti-meridian need a "
                                      "rectangular region or no masking")
        west, south, east, north = padded
        # bounds of a polygon list the eastern part first; their padding is not turned around
        box = Box(west, south, east, north) if explicit else Box(east, south, west, north)
        return _over_antimeridian(cube, box, keep_axis)
    box = Box(*padded)
    _require_labels(cube, info, box)
    inside = cube.where_label("lat", box.lat_test, info["lat"].between(box.south, box.north))
    inside = inside.where_label("lon", box.lon_test, info["lon"].between(box.west, box.east))
    if simple or not mask:
        return inside
    left = axis_info(inside, "lon", "lat")
    single = 1 in (left["lon"].size, left["lat"].size)
    outlines = shape.exteriors
    if single:
        keep = inside_rings(F.col("lon"), F.col("lat"), outlines)
        return inside.map(lambda p: p.where(keep), having=("lon", "lat"))
    if sum(map(len, outlines)) > SCANNED_EDGES:
        table, keep = _scanned_corners(inside, info["lon"].step, info["lat"].step, outlines)
    else:
        table, keep = None, any_corner_inside(info["lon"].step, info["lat"].step, outlines)

    def masked(part: Part) -> Part:
        if table is not None:
            part = replace(part, df=part.df.join(table, "lat", "left"))
        return part.select({v: F.when(keep, F.col(v)) for v in part.variables})

    return inside.map(masked, having=("lon", "lat"), keep=cube.dims)


def _corner(name: str, offset: float) -> Column:
    return (F.col(name) + F.lit(offset)).cast("float").cast("double")


def _scanned_corners(cube: Cube, dx: float, dy: float, ring) -> tuple[DataFrame, Column]:
    """Crossings of the ring with the upper and lower sides of the pixels, by latitude, and the test.

    The table is written, then broadcast if the crossings it holds are few enough, and joined else.
    """
    sides = {"__south": _corner("lat", -dy / 2), "__north": _corner("lat", dy / 2)}
    table = checkpoint(ring_crossings(cube.axis("lat"), "lat", ring, sides))
    held = table.agg(F.coalesce(F.sum(sum(F.size(k) for k in sides)), F.lit(0))).first()[0]
    tests = [right_of_odd(_corner("lon", s * dx / 2), F.col(k)) for k in sides for s in (-1, 1)]
    return hint_small(table, max(held, 1) * 16), reduce(Column.__or__, tests)


def any_corner_inside(dx: float, dy: float, ring) -> Column:
    """Whether any of the pixel's four corners lies in the ring."""
    tests = [inside_rings(_corner("lon", sx * dx / 2), _corner("lat", sy * dy / 2), ring)
             for sx in (-1, 1) for sy in (-1, 1)]
    return tests[0] | tests[1] | tests[2] | tests[3]


def _over_antimeridian(cube: Cube, box: Box, keep_axis: bool) -> Cube:
    lat = axis_info(cube, "lat")["lat"].between(box.south, box.north)
    rows = cube.where_label("lat", box.lat_test, lat)
    if not keep_axis:
        return rows.where_label("lon", box.lon_test)
    return rows.map(lambda p: p.select({v: F.when(box.lon_test, F.col(v)) for v in p.variables}),
                    having=("lon", "lat"), keep=cube.dims)


def _require_labels(cube: Cube, info: dict[str, AxisInfo], box: Box) -> None:
    """Fail when no axis label lies in the box; regular axes are judged by arithmetic."""
    for axis, low, high, test in ((info["lat"], box.south, box.north, box.lat_test),
                                  (info["lon"], box.west, box.east, box.lon_test)):
        if axis.size and axis.equidistant(1e-6):
            step = (axis.last - axis.first) / (axis.size - 1)
            nearest = min(max(round(((low + high) / 2 - axis.first) / step), 0), axis.size - 1)
            near = [axis.first + step * k for k in (nearest - 1, nearest, nearest + 1)
                    if 0 <= k < axis.size]
            found = any(low <= v <= high for v in near)
        else:
            found = bool(cube.axis(axis.name).where(test).limit(1).count())
        if not found:
            raise ValueError("can not select a region outside dataset boundaries")
