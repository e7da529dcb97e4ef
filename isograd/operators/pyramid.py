"""Overview pyramids of gridded variables as tables keyed by level and tile."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd.model import Cube, ValidationError
from isograd.operators.axis import AxisInfo, axis_info
from isograd.operators.normalize import GeoExtent

AGGREGATORS = ("first", "min", "max", "sum", "mean")
DEFAULT_TILE = 512


@dataclass(frozen=True)
class Split:
    """One axis as tiles: full size, tile size, tiles on level 0, number of levels."""

    size: int
    tile: int
    tiles: int
    levels: int


def split_axis(size: int, tile: int | None = None, exact: bool = True) -> Split:
    """The power-of-two subdivision that fits best.

    In this order: least growth of the axis (none when ``exact``), fewest tiles on level 0, tile
    size next to the wanted one, most levels.
    """
    if size < 1:
        raise ValidationError("invalid size")
    if size == tile:
        return Split(size, size, 1, 1)
    # Tile sizes, level-0 tiles and levels that are considered.
    smallest = min(size, tile // 2 if tile else 200) or 1
    largest = min(size, tile * 2 if tile else 1200)
    best, best_rank = Split(size, size, 1, 1), None
    for edge in range(smallest, largest + 1):
        for tiles in range(1, 8):
            for levels in range(2, 16):
                full = edge * tiles * 2 ** (levels - 1)
                if full > size and (exact or full - size >= edge):
                    break
                if full < size:
                    continue
                rank = (full - size, tiles, abs(edge - tile) if tile else 0, -levels)
                if best_rank is None or rank < best_rank:
                    best, best_rank = Split(full, edge, tiles, levels), rank
    return best


@dataclass(frozen=True)
class TilingScheme:
    levels: int
    tiles_x: int
    tiles_y: int
    tile_width: int
    tile_height: int
    extent: GeoExtent


def tiling_scheme(width: int, height: int, extent: GeoExtent, tile_width: int = DEFAULT_TILE,
                  tile_height: int = DEFAULT_TILE) -> TilingScheme:
    """Tiles for an image; a global axis keeps its size, another one may grow at its far end."""
    around = extent.west == -180 and extent.east == 180
    x = split_axis(width, min(width, tile_width), exact=around)
    y = split_axis(height, min(height, tile_height), exact=False)
    levels = min(x.levels, y.levels)
    tiles_x, tiles_y = x.tiles, y.tiles
    if x.levels > levels:
        tiles_x = x.size // 2 ** (levels - 1) // x.tile
    if y.levels > levels:
        tiles_y = y.size // 2 ** (levels - 1) // y.tile
    span_x = extent.east - extent.west + (360 if extent.west >= extent.east else 0)
    east = extent.east
    if x.size > width:
        east = extent.west + x.size * span_x / width
        east = east - 360 if east > 180 else east
    south, north = extent.south, extent.north
    if y.size > height:
        grown = y.size * (extent.north - extent.south) / height
        south, north = (north - grown, north) if extent.inv_y else (south, south + grown)
        if south < -90 or north > 90:
            raise ValueError("the grown latitude axis leaves the globe")
    return TilingScheme(levels, tiles_x, tiles_y, x.tile, y.tile,
                        replace(extent, east=east, south=south, north=north))


def _pixels(cube: Cube, var: str, north_up: bool) -> tuple[DataFrame, list[str]]:
    info = axis_info(cube, "lat", "lon")
    part = cube.part_of(var)
    keys = [d for d in part.dims if d not in ("lat", "lon")]

    def index(axis: AxisInfo, turned: bool) -> Column:
        if axis.size == 1:
            return F.lit(0).cast("bigint")
        step = (axis.last - axis.first) / (axis.size - 1)
        away = F.lit(axis.last) - F.col(axis.name) if turned else F.col(axis.name) - F.lit(axis.first)
        return F.round(away / F.lit(step)).cast("bigint")

    return part.df.select(*keys, index(info["lat"], north_up).alias("py"),
                          index(info["lon"], False).alias("px"), F.col(var).alias("value")), keys


def _tiled(rows: DataFrame, keys: list[str], scheme: TilingScheme) -> DataFrame:
    w, h = F.lit(scheme.tile_width), F.lit(scheme.tile_height)
    return rows.select(*keys, "z", F.floor(F.col("px") / w).cast("bigint").alias("tile_x"),
                       F.floor(F.col("py") / h).cast("bigint").alias("tile_y"), "px", "py",
                       "value")


def _edge(z: Column, top: int) -> Column:
    """Pixels along a block of a level; the finest level, the top one, has blocks of one."""
    return F.pow(F.lit(2.0), F.lit(top) - z).cast("bigint")


def nearest_pyramid(cube: Cube, var: str, scheme: TilingScheme, north_up: bool = True) -> DataFrame:
    """Every level keeps each 2^k-th pixel; (keys, z, tile_x, tile_y, px, py, value).

    Level 0 is the coarsest.  A pixel is repeated only for the levels it appears on.
    """
    rows, keys = _pixels(cube, var, north_up)
    top = scheme.levels - 1
    levels = F.filter(F.sequence(F.lit(0), F.lit(top)), lambda z: (
        F.col("px") % _edge(z, top) == 0) & (F.col("py") % _edge(z, top) == 0))
    spread = rows.withColumn("z", F.explode(levels))
    s = _edge(F.col("z"), top)
    scaled = spread.select(*keys, F.col("z").cast("bigint").alias("z"),
                           F.floor(F.col("px") / s).cast("bigint").alias("px"),
                           F.floor(F.col("py") / s).cast("bigint").alias("py"), "value")
    return _tiled(scaled, keys, scheme)


def _block(method: str, edge: Column) -> Column:
    """Combine a block of pixels; min and max skip missing values, sum and mean need all of them."""
    value = F.col("value")
    if method == "first":
        return F.max(F.when(F.col("corner"), value))
    if method in ("min", "max"):
        return F.min(value) if method == "min" else F.max(value)
    whole = (edge * edge).cast("double")
    return F.when(F.count(value) == edge * edge, F.sum(value) if method == "sum" else F.sum(value) / whole)


def aggregated_pyramid(cube: Cube, var: str, scheme: TilingScheme, method: str = "mean",
                       north_up: bool = True) -> DataFrame:
    """Every level combines blocks of 2×2 pixels of the level below it.

    Blocks of all levels are prefixes of a pixel's place, and their states merge, so the source is read
    once and all levels come from one aggregation: a partition sends a row per block that it meets.
    """
    if method not in AGGREGATORS:
        raise ValidationError(f"unknown aggregator '{method}'")
    pixels, keys = _pixels(cube, var, north_up)
    top = scheme.levels - 1
    first, last = F.lit(0).cast("bigint"), F.lit(top).cast("bigint")
    spread = pixels.withColumn("z", F.explode(F.sequence(first, last)))
    edge = _edge(F.col("z"), top)
    blocks = spread.select(
        *keys, "z", F.floor(F.col("py") / edge).cast("bigint").alias("py"),
        F.floor(F.col("px") / edge).cast("bigint").alias("px"), "value",
        ((F.col("px") % edge == 0) & (F.col("py") % edge == 0)).alias("corner"))
    found = blocks.groupBy(*keys, "z", "py", "px").agg(_block(method, edge).alias("value"))
    return _tiled(found, keys, scheme)
