"""Selection: variables, label lookup and slices."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd import literals
from isograd.functions.rounding import round_significant
from isograd.model import TEMPORAL, Cube, Part, ValidationError, literal
from isograd.operators.axis import axis_info, label_at, nearest_label


def select_var(cube: Cube, var: str | Iterable[str] | None = None) -> Cube:
    """Keep variables that match any wildcard pattern; coordinates stay; blank keeps all."""
    if literals.names(var) is None:
        return cube
    keep = set(literals.match(var, cube.variables))
    parts = tuple(p.select(variables=[v for v in p.variables if v in keep])
                  for p in cube.parts if keep & set(p.variables))
    if not parts:
        parts = tuple(p.select(variables=()) for p in cube.parts)
    return cube.with_parts(parts, keep=cube.dims)


def select_features(table: DataFrame, var: dict) -> DataFrame:
    """Rows where any of the given columns equals its value."""
    if not var:
        return table
    return table.where(reduce(Column.__or__, [F.col(k) == literal(v) for k, v in var.items()]))


def _typed(cube: Cube, dim: str, value):
    if isinstance(cube.dim_type(dim), TEMPORAL) and isinstance(value, str):
        return literals.time(value)
    return value


def fix_labels(cube: Cube, labels: dict, *, drop: bool = True) -> Cube:
    """Filter each part to exact labels of its dims; the dims become constants and are dropped."""
    def apply(part: Part) -> Part:
        own = {d: v for d, v in labels.items() if d in part.dims}
        if not own:
            return part
        rows = part.df.where(reduce(Column.__and__, [F.col(d) == literal(v)
                                                     for d, v in own.items()]))
        dims = tuple(d for d in part.dims if d not in own) if drop else part.dims
        return Part(rows.select(*dims, *part.variables), dims, part.variables)

    return cube.map(apply, keep=[d for d in cube.dims if d not in labels])


def sel(cube: Cube, point=None, time=None, indexers=None, method: str = "nearest") -> Cube:
    """Slice by labels along lon/lat, time and any other dimension; other keys are ignored.

    The selected dims stay as constant columns so that the labels found remain visible.
    """
    wanted = dict(literals.dictionary(indexers) or {})
    if point is not None:
        lon, lat = literals.point(point)
        wanted.setdefault("lon", lon)
        wanted.setdefault("lat", lat)
    if time is not None:
        wanted.setdefault("time", literals.time(time))
    wanted = {d: _typed(cube, d, v) for d, v in wanted.items() if d in cube.dims}
    if not wanted:
        return cube
    return fix_labels(cube, nearest_label(cube, wanted, method), drop=False)


def slice_for(cube: Cube, indexers=None, remaining_dims: Iterable[str] | None = None,
              var: str | None = None) -> Cube:
    """Nearest label for the given dims; first label of every other dim not asked to remain."""
    if var is not None:
        cube = select_var(cube, var)
        cube.part_of(var)
    wanted = literals.dictionary(indexers) or {}
    remaining = list(remaining_dims or [])
    unknown = [d for d in (*wanted, *(remaining if wanted else ())) if d not in cube.dims]
    if unknown:
        raise ValidationError(f"the dataset does not have a dimension called '{unknown[0]}'")
    both = set(wanted) & set(remaining)
    if both:
        raise ValidationError(f"dimension '{both.pop()}' can not be indexed and remain as well")
    labels = nearest_label(cube, {d: _typed(cube, d, v) for d, v in wanted.items()}) \
        if wanted else {}
    if remaining:
        for dim in cube.dims:
            if dim not in remaining and dim not in labels:
                labels[dim] = label_at(cube, dim, 0)
    return fix_labels(cube, labels) if labels else cube


def extract_point(cube: Cube, point, indexers=None, tolerance_default: float = 0.01) -> DataFrame:
    """Values at the nearest cell as one row; no row when no cell lies within the tolerance.

    The tolerance is the mean of the lon and lat steps.  Variables whose dims are not exactly lat,
    lon and the given exact-match indexers are left out, and so are bounds variables.
    """
    lon, lat = literals.point(point)
    exact = literals.dictionary(indexers) or {}
    info = axis_info(cube, "lon", "lat")
    steps = [info[d].step for d in ("lon", "lat")]
    tolerance = sum(steps) / 2 if None not in steps else tolerance_default
    labels = nearest_label(cube, {"lon": lon, "lat": lat})
    spot = (F.col("lat") == labels["lat"]) & (F.col("lon") == labels["lon"])
    inside = abs(labels["lon"] - lon) <= tolerance and abs(labels["lat"] - lat) <= tolerance
    frames = []
    for part in cube.parts:
        own = {d: _typed(cube, d, v) for d, v in exact.items() if d in part.dims}
        variables = [v for v in part.variables if not v.endswith("_bnds")]
        if set(part.dims) != {"lat", "lon", *own} or not variables:
            continue
        for dim, value in own.items():
            spot_here = F.col(dim) == literal(value)
            part = part.where(spot_here)
        frames.append(part.df.where(spot if inside else F.lit(False)).select(
            "lat", "lon", *(round_significant(F.col(v), 3).alias(v) for v in variables)))
    if not frames:
        raise ValidationError("no variable has exactly the dimensions lat, lon and the indexers")
    joined = reduce(lambda a, b: a.join(b, ["lat", "lon"], "full_outer"), frames)
    names = sorted(c for c in joined.columns if c not in ("lat", "lon"))
    return joined.select("lat", "lon", *names)


def mask_values(value: Column, no_data=None, valid_range=None) -> Column:
    """Fill value given: equal values are masked; else values outside the range; NaN otherwise."""
    if no_data is not None:
        return F.nullif(value, F.lit(no_data))
    if valid_range is not None:
        low, high = valid_range
        ok = F.lit(True)
        if low is not None:
            ok = ok & (value >= F.lit(low))
        if high is not None:
            ok = ok & (value <= F.lit(high))
        return F.when(ok, value)
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
