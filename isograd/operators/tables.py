"""The data tables behind charts: series, slices, histograms, pairs, frames and value ranges."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd import literals
from isograd.functions.rounding import round_range
from isograd.model import Cube, ValidationError
from isograd.operators.aggregate import REDUCERS, medians, reducer
from isograd.operators.axis import axis_info, label_at
from isograd.operators.select import fix_labels, select_var, sel, slice_for
from isograd.operators.stats import one_table, positional_pairs

# Attributes that no longer hold for a series at one point.
SPATIAL_ATTRS = (
    "geospatial_bounds_crs", "geospatial_bounds_vertical_crs", "geospatial_vertical_min",
    "geospatial_vertical_max", "geospatial_vertical_positive", "geospatial_vertical_units",
    "geospatial_vertical_resolution", "geospatial_lon_min", "geospatial_lat_min",
    "geospatial_lon_max", "geospatial_lat_max")

# Fixed value: padding of the hexagon lattice as a share of the value range.
HEX_PADDING = 1e-9


def tseries_point(cube: Cube, point, var=None, method: str = "nearest") -> Cube:
    """Series at a point; dims other than lon and lat stay."""
    out = sel(select_var(cube, var), point=point, method=method)
    attrs = {k: v for k, v in out.attrs.items() if k not in SPATIAL_ATTRS}
    return replace(out, attrs=attrs).stamped("tseries_point", point=point, var=var)


def line_series(cube: Cube, var_names, label: str | None = None, indexers=None) -> DataFrame:
    """(variable, x, value) rows of 1-D series; x is the label dim, else time."""
    names = literals.names(var_names)
    if not names:
        raise ValidationError("missing names of variables")
    cut = slice_for(select_var(cube, names), indexers, [label] if label else None)
    frames = None
    for part in cut.parts:
        if len(part.dims) > 1:
            raise ValidationError(f"{part.variables} has more than one dimension: {part.dims}; "
                                  "use the indexers")
        x = F.col(part.dims[0]) if part.dims else F.lit(None)
        rows = part.df.select(F.inline(F.array(*[
            F.struct(F.lit(v).alias("variable"), x.alias("x"), F.col(v).alias("value"))
            for v in part.variables])))
        frames = rows if frames is None else frames.unionByName(rows)
    return frames


def slice_table(cube: Cube, var: str, indexers=None, dims=("lat", "lon")) -> DataFrame:
    """The 1-D or 2-D slice a plot shows: the given dims remain, others take their first label."""
    return slice_for(cube, indexers, list(dims), var).df


def _span(df: DataFrame, *names: str) -> Column:
    """(lo_<name>, hi_<name>) of columns as a one-row subquery; a single value gets a width of 1."""
    ends = []
    for name in names:
        low, high = F.min(name), F.max(name)
        half = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
        ends += [(low - half).alias(f"lo_{name}"), (high + half).alias(f"hi_{name}")]
    return df.agg(F.struct(*ends)).scalar()


def _widened(span: DataFrame) -> Column:
    """A one-row span as a subquery; a single value gets a width of 1."""
    ends = []
    for name in ("x", "y"):
        low, high = F.col(f"lo_{name}"), F.col(f"hi_{name}")
        half = F.when(low == high, F.lit(0.5)).otherwise(F.lit(0.0))
        ends += [(low - half).alias(f"lo_{name}"), (high + half).alias(f"hi_{name}")]
    return span.select(F.struct(*ends)).scalar()


def _bin(name: str, bins: int) -> Column:
    """0-based bin of equal width over the column's span; the last bin is closed."""
    low, high = F.col(f"span.lo_{name}"), F.col(f"span.hi_{name}")
    place = F.floor((F.col(name) - low) / ((high - low) / bins))
    return F.least(place, F.lit(bins - 1)).cast("bigint")


def histogram(cube: Cube, var: str, indexers=None, bins: int = 10) -> DataFrame:
    """(bin, low, high, count) of a slice's values over [min, max]; empty bins have no row."""
    rows = slice_for(cube, indexers, None, var).df.where(F.col(var).isNotNull())
    spread = rows.select(F.col(var).cast("double").alias("v"))
    low = F.col("span.lo_v")
    width = (F.col("span.hi_v") - low) / bins
    counted = spread.withColumn("span", _span(spread, "v")).groupBy(_bin("v", bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("count"), F.min(low).alias("lo"), F.min(width).alias("width"))
    return counted.select("bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("low"),
                          (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("high"),
                          "count")


def scatter_pairs(x: Cube, y: Cube, var_x: str, var_y: str, indexers_x=None,
                  indexers_y=None) -> DataFrame:
    """(dims, x, y) of two variables' cells at equal axis positions.

    After the indexers both variables must have the same dims and the same lengths. Variables of one
    table that are cut alike are paired as they stand.
    """
    cubes, infos = [], []
    alike = (literals.dictionary(indexers_x) or {}) == (literals.dictionary(indexers_y) or {})
    if alike and one_table(x, y, var_x, var_y) is not None:
        part = x.part_of(var_x)
        wanted = literals.dictionary(indexers_x) or {}
        if wanted and not set(wanted) < set(part.dims):
            raise ValidationError(f'indexers must be a subset of the dimensions of "{var_x}"')
        only = replace(x, parts=(part.select(variables=list(dict.fromkeys((var_x, var_y)))),))
        cut = slice_for(only, wanted)
        return one_table(cut, cut, var_x, var_y)
    for cube, var, indexers in ((x, var_x, indexers_x), (y, var_y, indexers_y)):
        wanted = literals.dictionary(indexers) or {}
        part = cube.part_of(var)
        if wanted and not set(wanted) < set(part.dims):
            raise ValidationError(f'indexers must be a subset of the dimensions of "{var}"')
        cut = slice_for(cube, wanted, None, var)
        cubes.append(cut)
        infos.append(axis_info(cut, *cut.only_part.dims))
    dims = [set(c.only_part.dims) for c in cubes]
    if dims[0] != dims[1] or not dims[0]:
        raise ValidationError(f"remaining dimensions differ: {dims[0]} and {dims[1]}; "
                              "you may need to use the indexers")
    if any(infos[0][d].size != infos[1][d].size for d in dims[0]):
        raise ValidationError("remaining shapes differ; you may need to coregister first")
    return positional_pairs(*cubes, *infos, var_x, var_y)


def pair_range(x: Cube, y: Cube, var_x: str, var_y: str, indexers_x=None,
               indexers_y=None) -> DataFrame:
    """One row with the span of each side, read from the variables without pairing them."""
    sides = []
    for cube, var, indexers in ((x, var_x, indexers_x), (y, var_y, indexers_y)):
        rows = slice_for(cube, literals.dictionary(indexers) or {}, None, var).df
        sides.append(rows.agg(F.min(var).cast("double").alias("lo"),
                              F.max(var).cast("double").alias("hi")))
    spark = x.parts[0].df.sparkSession
    return spark.range(1).select(*(side.select(end).scalar().alias(f"{end}_{name}")
                                   for side, name in zip(sides, "xy") for end in ("lo", "hi")))


def _complete(pairs: DataFrame) -> DataFrame:
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    return pairs.where(both).select("x", "y")


def histogram_2d(pairs: DataFrame, bins: tuple[int, int] = (256, 256),
                 span: DataFrame | None = None) -> DataFrame:
    """(bx, by, count) of pairs over the range of each side's own values.

    ``span`` (see ``pair_range``) saves a second pairing just to find the range.
    """
    span = _span(pairs, "x", "y") if span is None else _widened(span)
    rows = _complete(pairs).withColumn("span", span)
    return rows.groupBy(_bin("x", bins[0]).alias("bx"), _bin("y", bins[1]).alias("by")).agg(
        F.count(F.lit(1)).alias("count"))


def hexbin(pairs: DataFrame, grid: tuple[int, int] = (64, 64),
           span: DataFrame | None = None) -> DataFrame:
    """(lattice, hx, hy, count): each pair belongs to the nearer centre of two shifted lattices.

    ``span`` (see ``pair_range``) saves a second pairing just to find the range.
    """
    rows = _complete(pairs)
    if span is None:
        ends = rows.agg(F.struct(F.min("x").alias("x0"), F.max("x").alias("x1"),
                                 F.min("y").alias("y0"), F.max("y").alias("y1")).alias("s"))
    else:
        ends = span.select(F.struct(F.col("lo_x").alias("x0"), F.col("hi_x").alias("x1"),
                                    F.col("lo_y").alias("y0"), F.col("hi_y").alias("y1")).alias("s"))
    spans = ends.scalar()
    s = rows.withColumn("s", spans)
    pad = (F.col("s.x1") - F.col("s.x0")) * HEX_PADDING
    x0, x1 = F.col("s.x0") - pad, F.col("s.x1") + pad
    ix = (F.col("x") - x0) / ((x1 - x0) / grid[0])
    iy = (F.col("y") - F.col("s.y0")) / ((F.col("s.y1") - F.col("s.y0")) / grid[1])
    placed = s.select(ix.alias("ix"), iy.alias("iy"))
    ix, iy = F.col("ix"), F.col("iy")
    centre = (F.rint(ix), F.rint(iy))
    shifted = (F.floor(ix) + 0.5, F.floor(iy) + 0.5)

    def away(point) -> Column:
        return (ix - point[0]) * (ix - point[0]) + 3 * (iy - point[1]) * (iy - point[1])

    first = away(centre) < away(shifted)
    return placed.groupBy(
        F.when(first, F.lit(1)).otherwise(F.lit(2)).cast("bigint").alias("lattice"),
        F.when(first, centre[0]).otherwise(F.floor(ix)).cast("bigint").alias("hx"),
        F.when(first, centre[1]).otherwise(F.floor(iy)).cast("bigint").alias("hy")).agg(
        F.count(F.lit(1)).alias("count"))


def hovmoeller(cube: Cube, var: str | None = None, x_axis: str | None = None,
               y_axis: str | None = None, method: str = "mean") -> DataFrame:
    """(x, y, var) with all other dims reduced; the first two dims by default."""
    if method not in REDUCERS:
        raise ValidationError(f"unknown reduction method '{method}'")
    var = var or cube.variables[0]
    part = cube.part_of(var)
    if len(part.dims) < 2:
        raise ValidationError("the variable should have at least two dimensions")
    x_axis, y_axis = x_axis or part.dims[0], y_axis or part.dims[1]
    if x_axis == y_axis:
        raise ValidationError("dimensions should differ between plot axes")
    if not {x_axis, y_axis} <= set(part.dims):
        raise ValidationError(f"{var} does not feature the dimensions {x_axis}, {y_axis}")
    gone = [d for d in part.dims if d not in (x_axis, y_axis)]
    if method == "median" and gone:
        return medians(cube, part.df, [x_axis, y_axis], gone, [var])
    aggregate = F.percentile(var, F.lit(0.5)) if method == "median" else reducer(method, F.col(var))
    return part.df.groupBy(x_axis, y_axis).agg(aggregate.alias(var))


def animation_frames(cube: Cube, var: str, animate_dim: str = "time", indexers=None) -> DataFrame:
    """(frame, lat, lon, var) for every label of a dim; further dims take their first label."""
    wanted = {k: v for k, v in (literals.dictionary(indexers) or {}).items() if k != animate_dim}
    cut = slice_for(cube, wanted, [animate_dim, "lat", "lon"], var)
    return cut.df.select(F.col(animate_dim).alias("frame"), "lat", "lon", var)


def animation_range(cube: Cube, var: str, animate_dim: str = "time", true_range: bool = False,
                    indexers=None) -> DataFrame:
    """(data_min, data_max) over all cells, or over the first frame; fails when all are missing."""
    part = cube.part_of(var)
    if true_range:
        rows = part.df
    else:
        chosen = cube.with_parts((part,), keep=cube.dims)
        first = fix_labels(chosen, {animate_dim: label_at(chosen, animate_dim, 0)})
        wanted = {k: v for k, v in (literals.dictionary(indexers) or {}).items()
                  if k != animate_dim}
        rows = slice_for(first, wanted, ["lat", "lon"], var).df
    low = F.min(var)
    checked = F.when(low.isNull(), F.raise_error(F.lit(
        "can not animate a dataset with only missing values")).cast("double")).otherwise(low)
    return rows.agg(checked.alias("data_min"), F.max(var).alias("data_max"))


def variable_statistics(cube: Cube, var: str, indexers=None) -> DataFrame:
    """One row (min, max) of a slice, rounded to two more digits than the range needs."""
    rows = slice_for(cube, indexers, None, var).df.agg(F.min(var).alias("lo"),
                                                       F.max(var).alias("hi"))
    low, high = round_range(F.col("lo"), F.col("hi"), 2)
    return rows.select(low.alias("min"), high.alias("max"))


def colour_range(low: Column, high: Column, vmin: float | None = None, vmax: float | None = None,
                 center: float | bool | None = None) -> list[Column]:
    """Columns vmin, vmax, divergent and extend for a value range.

    Values on both sides of zero, or a given centre, make a symmetric range, unless both limits
    are given or ``center`` is False.
    """
    middle = F.lit(float(center)) if center not in (None, False) else F.lit(0.0)
    open_ended = center is not False and (vmin is None or vmax is None)
    lo = F.lit(float(vmin)) if vmin is not None else low
    hi = F.lit(float(vmax)) if vmax is not None else high
    if not open_ended:
        divergent = F.lit(False)
    elif center is not None:
        divergent = F.lit(True)
    else:
        divergent = (lo < 0) & (hi > 0)
    if open_ended and vmax is not None:
        reach = F.abs(hi - middle)
    elif open_ended and vmin is not None:
        reach = F.abs(lo - middle)
    else:
        reach = F.greatest(F.abs(lo - middle), F.abs(hi - middle))
    first = F.when(divergent, -reach).otherwise(lo) + middle
    last = F.when(divergent, reach).otherwise(hi) + middle
    below, above = low < first, high > last
    extend = (F.when(below & above, "both").when(below, "min").when(above, "max")
              .otherwise("neither"))
    return [first.alias("vmin"), last.alias("vmax"), divergent.alias("divergent"),
            extend.alias("extend")]
