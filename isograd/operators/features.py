"""Operators on feature tables: points in ``lon`` and ``lat`` columns, other shapes in ``geometry``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isograd import literals
from isograd.functions.geo import (
    PREDICATES,
    great_circle_distance,
    point_predicate,
    shape_predicates,
)
from isograd.functions.quantile import GROUP_ROWS, quantiles
from isograd.model import ValidationError, null_if_nan
from isograd.operators.dissolve import AREAS, LINES, union_of_lines, union_of_polygons
from isograd.operators.geometry import is_collection, members

GEOMETRY = ("lon", "lat", "geometry")
STATISTICS = ("count", "mean", "median", "sum", "std", "min", "max")


def data_frame_min(df: DataFrame, var: str, order: str) -> DataFrame:
    """The first record (by ``order``) with the smallest value."""
    return df.where(F.col(var).isNotNull()).orderBy(F.col(var).asc(), F.col(order).asc()).limit(1)


def data_frame_max(df: DataFrame, var: str, order: str) -> DataFrame:
    """The first record (by ``order``) with the largest value."""
    return df.where(F.col(var).isNotNull()).orderBy(F.col(var).desc(), F.col(order).asc()).limit(1)


def feature_predicate(df: DataFrame, name: str, region) -> Column:
    """A geometric test of the features of a table: points, and other shapes in ``geometry``."""
    return feature_predicates(df, [name], region)[name]


def feature_predicates(df: DataFrame, names: Sequence[str], region) -> Column:
    """Several tests as one struct: selected as a column, it compares a shape once for all of them."""
    shape = F.col("geometry")
    spot = shape["coords"][0][0]
    place = (F.col("lon"), F.col("lat")) if {"lon", "lat"} <= set(df.columns) else (spot["x"], spot["y"])
    point = F.struct(*(point_predicate(name, *place, region).alias(name) for name in names))
    if "geometry" not in df.columns:
        return point
    other = shape["type"].isNotNull() & (shape["type"] != "Point")
    return (F.when(is_collection(shape), _collection_predicates(names, shape, region))
            .when(other, shape_predicates(names, shape, region)).otherwise(point))


def _collection_predicates(names: Sequence[str], shape: Column, region) -> Column:
    """Tests of a collection by its members: all of them for within and disjoint, one else."""
    known = [name for name in names if name in ("within", "disjoint", "intersects")]

    def member(m: Column) -> Column:
        spot = m["coords"][0][0]
        point = F.struct(*(point_predicate(name, spot["x"], spot["y"], region).alias(name) for name in known))
        return F.when(m["type"] == "Point", point).otherwise(shape_predicates(known, m, region))

    def test(name: str, tested: Column) -> Column:
        if name not in known:
            return F.raise_error(F.lit(f"{name} is not built for collections")).cast("boolean")
        if name == "intersects":
            return F.exists(tested, lambda t: t[name])
        return F.forall(tested, lambda t: t[name]) & ((F.size(tested) > 0) | F.lit(name == "disjoint"))

    found = F.transform(members(shape), member) if known else F.array()
    return F.transform(F.array(found), lambda tested: (
        F.struct(*(test(name, tested).alias(name) for name in names))))[0]


def _place(df: DataFrame) -> tuple[Column, Column]:
    """Longitude and latitude of each feature: the point, or the middle of the shape's bounds."""
    found = []
    for name, axis in (("lon", "x"), ("lat", "y")):
        own = [F.col(name)] if name in df.columns else []
        if "geometry" in df.columns:
            values = F.flatten(F.col("geometry.coords"))[axis]
            own.append((F.array_min(values) + F.array_max(values)) / 2)
        found.append(F.coalesce(*own))
    return found[0], found[1]


def data_frame_query(df: DataFrame, query_expr: str) -> DataFrame:
    """Rows that satisfy a condition, which may contain tests such as ``@within('0,0,10,10')``."""
    tests: dict[str, Column] = {}

    def test_column(found: re.Match) -> str:
        name = f"__geo_{len(tests)}"
        tests[name] = feature_predicate(df, found[1], found[3])
        return name

    text = re.sub(rf"@({'|'.join(PREDICATES)})\(\s*(['\"])(.*?)\2\s*\)", test_column, query_expr)
    if "@" in text:
        raise ValidationError(f"unknown test in query: {query_expr}")
    return df.withColumns(tests).where(F.expr(text)).select(*df.columns)


def data_frame_subset(df: DataFrame, region_op: str = "intersects", region=None,
                      var_names=None) -> DataFrame:
    """Chosen columns, geometry always kept, of the rows whose geometry meets a region."""
    chosen = literals.names(var_names)
    shape = literals.polygon(region)
    out = df
    if shape is not None and region_op:
        out = out.where(feature_predicate(df, region_op, shape))
    if chosen:
        out = out.select(*[g for g in GEOMETRY if g in df.columns and g not in chosen], *chosen)
    return out


def representative_point(shape: literals.Shape) -> tuple[float, float]:
    """A point for a location literal: the point itself, or the middle of its bounds."""
    west, south, east, north = shape.bounds
    return (west + east) / 2, (south + north) / 2


def data_frame_find_closest(df: DataFrame, location, order: str, max_results: int = 1,
                            max_dist: float = 180.0,
                            dist_col_name: str | None = "distance") -> DataFrame:
    """The nearest features by great-circle degrees; ties go by ``order``.

    A feature that is no point stands at the middle of its bounds.
    """
    shape = literals.geometry(location)
    if shape is None:
        raise ValidationError("a location is required")
    lon, lat = representative_point(shape)
    distance = great_circle_distance(F.lit(lon), F.lit(lat), *_place(df))
    name = dist_col_name or "__distance"
    near = df.withColumn(name, distance).where(F.col(name) <= max_dist).orderBy(
        F.col(name).asc(), F.col(order).asc()).limit(max_results)
    return near if dist_col_name else near.drop(name)


def data_frame_aggregate(df: DataFrame, var_names=None, aggregate_geometry: bool = False,
                         group_limit: int | None = None) -> DataFrame:
    """One row ``<col>_<statistic>`` of count, mean, median, sum, std (sample), min and max.

    With ``aggregate_geometry`` the result is the union of the geometries as a table (see
    :func:`geometry_union`) with the statistics next to each row; where there is no geometry at all it is
    one row with null places.
    """
    usable = [f.name for f in df.schema.fields
              if isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    chosen = literals.names(var_names) or usable
    chosen = [c for c in chosen if c != "geometry"]
    for problem, bad in (("not in data frame", [c for c in chosen if c not in df.columns]),
                         ("not aggregatable", [c for c in chosen if c not in usable])):
        if bad:
            raise ValidationError(f"variable(s) {','.join(bad)} {problem}")
    limit = GROUP_ROWS if group_limit is None else group_limit
    flat = df.select(*(null_if_nan(df, c).cast("double").alias(c) if isinstance(
        df.schema[c].dataType, T.FractionalType) else F.col(c).cast("bigint").alias(c)
        for c in chosen))
    plain = [c for name in chosen for c in _statistics(name)]
    if flat.count() <= limit:
        whole = flat.agg(*plain, *(F.percentile(c, F.lit(0.5)).alias(f"{c}_median")
                                   for c in chosen))
    else:
        whole = flat.agg(*plain)
        for c in chosen:
            median = quantiles(flat, [], c, [0.5], group_rows=limit + 1, limit=limit)
            whole = whole.withColumn(f"{c}_median", median.select(F.col("q")[0]).scalar())
    names = [f"{c}_{s}" for c in chosen for s in STATISTICS]
    if not aggregate_geometry:
        return whole.select(*names)
    row = whole.select(F.struct(*names).alias("__s")).scalar()
    union = geometry_union(df)
    places = union.columns
    if not union.limit(1).count():  # the statistics stay
        nothing = [F.lit(None).cast(union.schema[c].dataType).alias(c) for c in places]
        return whole.select(*names, *nothing)
    return union.withColumn("__s", row).select("__s.*", *places)


def _statistics(name: str) -> list[Column]:
    value = F.col(name)
    found = {"count": F.count(value), "mean": F.avg(value), "sum": F.sum(value),
             "std": F.stddev_samp(value), "min": F.min(value), "max": F.max(value)}
    return [column.alias(f"{name}_{kind}") for kind, column in found.items()]


def geometry_union(df: DataFrame) -> DataFrame:
    """The union of all geometries, which have to be of one dimension.

    Of points each distinct one (``lon``, ``lat``); of polygons and of lines their runs of vertices
    (``run``, ``place``, ``lon``, ``lat``, see ``operators.dissolve``). Without any the table is empty.
    """
    if "geometry" not in df.columns:
        spots = df.select("lon", "lat")
    else:
        kinds = {r[0] for r in df.select("geometry.type").distinct().collect()} - {None}
        if kinds and kinds <= set(AREAS):
            return union_of_polygons(df)
        if kinds and kinds <= set(LINES):
            return union_of_lines(df)
        if not kinds <= {"Point", "MultiPoint"}:
            raise ValidationError(f"the union of {', '.join(sorted(kinds))} is not built: take geometries "
                                  "of one dimension")
        spots = df.select(F.explode(F.flatten("geometry.coords")).alias("p")).select(
            F.col("p.x").alias("lon"), F.col("p.y").alias("lat"))
        if not kinds and {"lon", "lat"} <= set(df.columns):
            spots = df.select("lon", "lat")
    return spots.where(F.col("lon").isNotNull() & F.col("lat").isNotNull()).distinct()
