"""Planar predicates and great-circle distance as Column expressions over lon/lat columns.

A region is a literal known when the plan is built, so its edges become constants of the
expression.  Rings with few edges are unrolled, which keeps the test inside generated code; longer
rings are folded over a constant array.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd import rings
from isograd.functions.relate import ALMOST, relations
from isograd.literals import Ring, Shape, geometry, signed_area
from isograd.model import ValidationError

UNROLLED_EDGES = 48
#: Rings of more edges mask a grid by their crossings with its latitudes, found once per label.
SCANNED_EDGES = 16

#: The geometric tests a feature table can be filtered by.
PREDICATES = ("almost_equals", "contains", "crosses", "disjoint", "intersects", "touches", "within")


def _edges(rings: tuple[Ring, ...]) -> list[tuple[float, float, float, float]]:
    return [(float(a[0]), float(a[1]), float(b[0]), float(b[1]))
            for ring in rings for a, b in zip(ring, ring[1:]) if a != b]


def _edge_array(edges) -> Column:
    """One constant array, spelled as text because thousands of Column calls would take seconds."""
    return F.expr("array(" + ", ".join(
        f"named_struct('x0', {a!r}D, 'y0', {b!r}D, 'x1', {c!r}D, 'y1', {d!r}D)"
        for a, b, c, d in edges) + ")")


def _crossing(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    """Whether a ray to the east of (x, y) crosses the edge."""
    if isinstance(y0, float):
        if y0 == y1:
            return F.lit(False)
        x_at_y = F.lit(x0) + (y - F.lit(y0)) * F.lit(x1 - x0) / F.lit(y1 - y0)
        low, high = min(y0, y1), max(y0, y1)
        return (y >= F.lit(low)) & (y < F.lit(high)) & (x < x_at_y)
    x_at_y = x0 + (y - y0) * (x1 - x0) / F.nullif(y1 - y0, F.lit(0.0))
    return ((y0 <= y) != (y1 <= y)) & (x < x_at_y)


def inside_rings(x: Column, y: Column, rings: tuple[Ring, ...]) -> Column:
    """Even-odd test; points on the boundary fall to either side (see ``on_rings``)."""
    edges = _edges(rings)
    if len(edges) <= UNROLLED_EDGES:
        hits = [_crossing(x, y, *e).cast("int") for e in edges]
        return reduce(Column.__add__, hits) % 2 == 1
    count = F.aggregate(
        _edge_array(edges), F.lit(0),
        lambda n, e: n + F.coalesce(_crossing(x, y, e.x0, e.y0, e.x1, e.y1).cast("int"), F.lit(0)))
    return count % 2 == 1


def ring_crossings(labels: DataFrame, name: str, rings: tuple[Ring, ...],
                   offsets: dict[str, Column]) -> DataFrame:
    """(label, one array per offset): where the line of constant y at each label crosses the rings.

    ``offsets`` are y expressions by name. Edges are spread to bands of y about as high as an edge, so a
    label meets the edges of its band only. A label whose lines cross nothing has no row.
    """
    edges = _edges(rings)
    low = min(min(e[1], e[3]) for e in edges)
    high = max(max(e[1], e[3]) for e in edges)
    height = max(sum(abs(e[3] - e[1]) for e in edges) / len(edges), (high - low) / len(edges))

    def band(y: Column) -> Column:
        return F.floor((y - F.lit(low)) / F.lit(height)).cast("bigint")

    spark = labels.sparkSession
    index = spark.createDataFrame(edges, "x0 double, y0 double, x1 double, y1 double").where("y0 <> y1")
    index = index.withColumn("band", F.explode(F.sequence(band(F.least("y0", "y1")),
                                                          band(F.greatest("y0", "y1")))))
    lines = labels.select(name, F.explode(F.array(*(F.struct(F.lit(k).alias("side"), y.alias("y"))
                                                    for k, y in offsets.items()))).alias("line"))
    lines = lines.select(name, "line.*", band(F.col("line.y")).alias("band"))
    y, x0, y0, x1, y1 = (F.col(c) for c in ("y", "x0", "y0", "x1", "y1"))
    met = lines.join(index, "band").where((y >= F.least(y0, y1)) & (y < F.greatest(y0, y1)))
    at = x0 + (y - y0) * (x1 - x0) / (y1 - y0)
    return met.groupBy(name).agg(*(F.collect_list(F.when(F.col("side") == k, at)).alias(k)
                                   for k in offsets))


def right_of_odd(x: Column, crossings: Column) -> Column:
    """Whether an odd number of crossings lies to the east of x; without any: False."""
    return F.coalesce(F.size(F.filter(crossings, lambda c: x < c)) % 2 == 1, F.lit(False))


def _on_edge(x: Column, y: Column, x0, y0, x1, y1) -> Column:
    turn = (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0)
    return ((turn == 0) & (x >= F.least(x0, x1)) & (x <= F.greatest(x0, x1))
            & (y >= F.least(y0, y1)) & (y <= F.greatest(y0, y1)))


def on_rings(x: Column, y: Column, rings: tuple[Ring, ...]) -> Column:
    """Whether the point lies on any edge."""
    edges = _edges(rings)
    if len(edges) <= UNROLLED_EDGES:
        return reduce(Column.__or__, [_on_edge(x, y, *map(F.lit, e)) for e in edges])
    return F.exists(_edge_array(edges), lambda e: _on_edge(x, y, e.x0, e.y0, e.x1, e.y1))


def point_predicate(name: str, x: Column, y: Column, region) -> Column:
    """A geometric test of point features against a point, line or polygon; no point: False."""
    if name not in PREDICATES:
        raise ValidationError(f'unknown geometric test "{name}"')
    shape = geometry(region)
    if shape is None:
        return F.lit(False)
    if shape.kind in ("POINT", "MULTIPOINT"):
        test = _point_against_points(name, x, y, shape)
    elif shape.kind == "LINESTRING":
        test = _point_against_line(name, x, y, shape)
    else:
        test = _point_against_polygon(name, x, y, shape)
    return F.coalesce(test, F.lit(False))


def _point_against_points(name: str, x: Column, y: Column, shape: Shape) -> Column:
    points = list(dict.fromkeys(shape.rings[0]))
    if name in ("almost_equals", "contains") and len(points) > 1:
        return F.lit(False)
    if name == "almost_equals":
        px, py = points[0]
        return F.hypot(x - F.lit(px), y - F.lit(py)) <= F.lit(ALMOST)
    same = F.struct(x.cast("double"), y.cast("double")).isin(
        [F.struct(F.lit(float(px)), F.lit(float(py))) for px, py in points])
    if name == "disjoint":
        return ~same
    return F.lit(False) if name in ("crosses", "touches") else same


def _point_against_line(name: str, x: Column, y: Column, shape: Shape) -> Column:
    run = shape.rings[0]
    on_line = on_rings(x, y, shape.rings)
    closed = run[0] == run[-1]
    ends = F.lit(False) if closed else reduce(
        Column.__or__, [(x == F.lit(px)) & (y == F.lit(py)) for px, py in (run[0], run[-1])])
    tests = {"intersects": on_line, "disjoint": ~on_line, "touches": ends,
             "within": on_line & ~ends}
    return tests.get(name, F.lit(False))


def _point_against_polygon(name: str, x: Column, y: Column, shape: Shape) -> Column:
    if shape.is_box:
        west, south, east, north = (F.lit(v) for v in shape.bounds)
        covered = (x >= west) & (x <= east) & (y >= south) & (y <= north)
        interior = (x > west) & (x < east) & (y > south) & (y < north)
    else:
        west, south, east, north = (F.lit(v) for v in shape.bounds)
        near = (x >= west) & (x <= east) & (y >= south) & (y <= north)
        edge = on_rings(x, y, shape.rings)
        odd = inside_rings(x, y, shape.rings)
        covered, interior = near & (odd | edge), near & odd & ~edge
    tests = {"intersects": covered, "disjoint": ~covered, "within": interior,
             "touches": covered & ~interior}
    return tests.get(name, F.lit(False))


def shape_predicates(names: Sequence[str], shape: Column, region) -> Column:
    """Tests of line, polygon and multi-part features against a literal geometry as a struct; no geometry: False."""
    for name in names:
        if name not in PREDICATES:
            raise ValidationError(f'unknown geometric test "{name}"')
    literal = geometry(region)
    if literal is None:
        return F.struct(*(F.lit(False).alias(name) for name in names))
    return relations(names, shape, literal)


def shape_predicate(name: str, shape: Column, region) -> Column:
    """One of these tests."""
    return shape_predicates([name], shape, region)[name]


def great_circle_distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle between two points on a sphere in degrees (Vincenty form)."""
    gap = F.abs(lon2 - lon1)
    turn = F.radians(F.when(gap > 180, 360 - gap).otherwise(gap))
    a, b = F.radians(lat1), F.radians(lat2)
    east = F.cos(b) * F.sin(turn)
    north = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(turn)
    ahead = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(turn)
    return F.degrees(F.atan2(F.sqrt(east * east + north * north), ahead))


def crosses_antimeridian(shape: Shape) -> bool:
    """Whether an exterior ring is meant to run over the 180° meridian.

    The ring is read once more with western longitudes shifted by 360°.  If it then spans 180°, is smaller
    than the region as given and still valid, it is the intended one; a ring that the shift breaks runs
    over Greenwich.
    """
    return any(_smaller_shifted(ring, shape.area) for ring in shape.exteriors)


def _smaller_shifted(ring: Ring, size: float) -> bool:
    shifted = tuple((x + 360.0 if -180.0 <= x < 0.0 else x, y) for x, y in ring)
    lons = [x for x, _ in shifted]
    return (min(lons) < 180 < max(lons) and abs(signed_area(shifted)) < size
            and not rings.faults([shifted]))
