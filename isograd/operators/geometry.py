"""Vertex-level measures of geometry columns.

A geometry is ``STRUCT<type STRING, coords ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>>``: all runs of
vertices of the geometry, in order.  A row is handled by array expressions, so nothing is shuffled.
The type of a collection names its members with their numbers of runs, as in
``GeometryCollection: Point 1, Polygon 2``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd.model import ValidationError

GEOMETRY_TYPE = "struct<type:string,coords:array<array<struct<x:double,y:double>>>>"


def point_geometry(lon: Column, lat: Column) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.array(
        F.struct(lon.cast("double").alias("x"), lat.cast("double").alias("y")))).alias("coords"))


COLLECTION = "GeometryCollection: "


def is_collection(geometry: Column) -> Column:
    return geometry["type"].startswith(COLLECTION)


def collected(shapes: Column) -> Column:
    """An array of geometries as one collection."""
    listed = F.array_join(F.transform(shapes, lambda m: F.concat_ws(
        " ", m["type"], F.size(m["coords"]).cast("string"))), ", ")
    return F.struct(F.concat(F.lit(COLLECTION), listed).alias("type"),
                    F.flatten(F.transform(shapes, lambda m: m["coords"])).alias("coords"))


def members(geometry: Column) -> Column:
    """The geometries of a collection; any other geometry is its only one."""
    listed = F.filter(F.split(F.substring(geometry["type"], len(COLLECTION) + 1, 1 << 30), ", "),
                      lambda t: t != "")
    sizes = F.transform(listed, lambda t: F.substring_index(t, " ", -1).cast("int"))

    def member(text: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda n, k: n + k)
        return F.struct(F.substring_index(text, " ", 1).alias("type"), F.slice(
            geometry["coords"], before + 1, F.get(sizes, i)).alias("coords"))

    return F.when(is_collection(geometry), F.transform(listed, member)).otherwise(F.array(geometry))


def vertex_count(geometry: Column) -> Column:
    """Number of vertices over all runs."""
    return F.size(F.flatten(geometry["coords"])).cast("bigint")


def pointify(geometry: Column) -> Column:
    """Mean of all vertices; the closing vertex of a ring does not count twice."""
    pooled = F.flatten(geometry["coords"])
    first, last = F.element_at(pooled, 1), F.element_at(pooled, -1)
    n = F.size(pooled)
    ring = (n > 1) & (first["x"] == last["x"]) & (first["y"] == last["y"])
    used = F.slice(pooled, F.lit(1), n - ring.cast("int"))

    def mean(axis: str) -> Column:
        total = F.aggregate(used, F.lit(0.0), lambda s, p: s + p[axis])
        return total / F.size(used)

    return point_geometry(mean("x"), mean("y"))


def display_geometry(geometry: Column, max_points: int = -1,
                     conservation_ratio: float = 1.0) -> tuple[Column, Column]:
    """(geometry, simplified): too many vertices, or a ratio of 0, turn it into its mean point.

    Ratios between 0 and 1 would need a line simplification, which is not built.
    """
    if 0 < conservation_ratio < 1:
        raise ValidationError("a conservation ratio between 0 and 1 is not built: take 0 or 1")
    if conservation_ratio == 0:
        many = F.lit(True)
    else:
        many = F.lit(max_points >= 0) & (vertex_count(geometry) > max_points)
    return F.when(many, pointify(geometry)).otherwise(geometry), many.cast("int")


def triangle_areas(df: DataFrame, geometry: str, keys: list[str]) -> DataFrame:
    """(keys, run, vertex, area): area of the triangle of each inner vertex and its neighbours."""
    def area(a: Column, b: Column, c: Column) -> Column:
        turn = (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])
        return 0.5 * F.abs(turn)

    runs = df.select(*keys, F.posexplode(F.col(geometry)["coords"]).alias("run", "__v"))
    v = F.col("__v")
    inner = F.transform(
        F.sequence(F.lit(2), F.size(v) - 1),
        lambda i: F.struct((i - 1).cast("bigint").alias("vertex"), area(
            F.element_at(v, (i - 1).cast("int")), F.element_at(v, i.cast("int")),
            F.element_at(v, (i + 1).cast("int"))).alias("area")))
    return runs.where(F.size("__v") > 2).select(*keys, F.col("run").cast("bigint").alias("run"),
                                                F.inline(inner))
