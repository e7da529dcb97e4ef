"""The union of polygons or lines of any number, without any of them meeting all others.

Edges are split where a vertex of another shape lies on them. An edge that two polygons share then
occurs once in either direction and cancels out in an aggregation; what is left is the boundary of the
union. Its edges are linked at their vertices and numbered along their rings by pointer doubling: in
every round each edge learns from the one its pointer reaches, and the pointers reach twice as far.

Shapes must not overlap: that fails the query. Places are compared as they are given, without any
tolerance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isograd.model import ValidationError
from isograd.session import scratch

AREAS = ("Polygon", "MultiPolygon")
LINES = ("LineString", "MultiLineString")
EDGE = ("x0", "y0", "x1", "y1")


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _edges(run: Column) -> Column:
    """The edges of a run of vertices that have a length."""
    both = F.transform(F.sequence(F.lit(0), F.size(run) - 2), lambda i: F.struct(
        *(F.get(run, i + k)[axis].alias(f"{axis}{k}") for k in (0, 1) for axis in ("x", "y"))))
    return F.filter(F.when(F.size(run) > 1, both), lambda e: (e["x0"] != e["x1"]) | (e["y0"] != e["y1"]))


def _doubled_area(edges: Column) -> Column:
    return F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["x0"] * e["y1"] - e["x1"] * e["y0"]))


def _rings_around(rings: Column, own: Column, at: Column) -> Column:
    """How many other rings of a shape the middle of a ring's first edge lies in."""
    first = own[0]
    x, y = (first["x0"] + first["x1"]) / 2, (first["y0"] + first["y1"]) / 2

    def crossed(e: Column) -> Column:
        there = e["x0"] + (y - e["y0"]) * (e["x1"] - e["x0"]) / F.nullif(e["y1"] - e["y0"], F.lit(0.0))
        return F.coalesce((((e["y0"] <= y) != (e["y1"] <= y)) & (x < there)).cast("int"), F.lit(0))

    around = F.transform(rings, lambda ring, i: F.when(i == at, 0).otherwise(
        F.aggregate(ring, F.lit(0), lambda n, e: n + crossed(e)) % 2))
    return F.aggregate(around, F.lit(0), lambda n, k: n + k)


def _directed(shapes: DataFrame) -> DataFrame:
    """Edges of polygons with the polygon to their left; equal polygons count once."""
    # a ring that goes there and back the same way cancels out as well
    rings = F.filter(F.transform(F.col("geometry.coords"), _edges), lambda r: F.size(r) > 0)
    rows = shapes.select("geometry").distinct().select(F.col("geometry.type").alias("type"),
                                                       rings.alias("rings"))
    rows = rows.select("type", "rings", F.posexplode("rings").alias("at", "ring"))
    hole = F.when(F.col("type") == "Polygon", F.col("at") > 0).otherwise(
        _rings_around(F.col("rings"), F.col("ring"), F.col("at")) % 2 == 1)
    turned = (_doubled_area(F.col("ring")) > 0) == hole
    return rows.select(F.explode("ring").alias("e"), turned.alias("turned")).select(
        *(F.when(F.col("turned"), F.col("e")[f"{n[0]}{1 - int(n[1])}"]).otherwise(F.col("e")[n]).alias(n)
          for n in EDGE))


def _level() -> Column:
    """Of the powers of two the smallest that is as wide and high as an edge."""
    return F.ceil(F.log2(F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0"))))
                  ).cast("int")


def _cell(value: Column, level: Column) -> Column:
    return F.floor(value / F.pow(F.lit(2.0), level)).cast("bigint")


def _in_cells(edges: DataFrame) -> DataFrame:
    """Edges with the at most nine cells of their level that their bounds meet."""
    def over(axis: str) -> Column:
        ends = F.col(f"{axis}0"), F.col(f"{axis}1")
        return F.sequence(_cell(F.least(*ends), F.col("level")), _cell(F.greatest(*ends), F.col("level")))

    return (edges.withColumn("cx", F.explode(over("x"))).withColumn("cy", F.explode(over("y"))))


def _levels(edges: DataFrame) -> Column:
    """The levels in use: as many as edges differ in powers of two, not as there are edges."""
    return F.array(*(F.lit(r.level) for r in edges.select("level").distinct().collect()))


def _turn(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def _split(edges: DataFrame) -> DataFrame:
    """Edges cut at the vertices of others that lie on them."""
    edges = edges.withColumn("level", _level())
    corners = edges.select(F.col("x0").alias("x"), F.col("y0").alias("y")).union(
        edges.select("x1", "y1")).distinct()
    corners = corners.withColumn("level", F.explode(_levels(edges))).select(
        "x", "y", "level", _cell(F.col("x"), F.col("level")).alias("cx"),
        _cell(F.col("y"), F.col("level")).alias("cy"))
    c = {n: F.col(n) for n in (*EDGE, "x", "y")}
    on = ((_turn(c["x0"], c["y0"], c["x1"], c["y1"], c["x"], c["y"]) == 0)
          & c["x"].between(F.least(c["x0"], c["x1"]), F.greatest(c["x0"], c["x1"]))
          & c["y"].between(F.least(c["y0"], c["y1"]), F.greatest(c["y0"], c["y1"])))
    # the ends of an edge lie on it too
    stops = _in_cells(edges.distinct()).join(corners, ["level", "cx", "cy"]).where(on).select(
        *EDGE, "x", "y").distinct()
    along = Window.partitionBy(*EDGE).orderBy(F.abs(c["x"] - c["x0"]) + F.abs(c["y"] - c["y0"]))
    parts = stops.withColumn("to", F.lead(F.struct("x", "y")).over(along)).where("to IS NOT NULL")
    # every occurrence of an edge has its parts
    counted = edges.groupBy(*EDGE).agg(F.count(F.lit(1)).alias("n"))
    return parts.join(counted, list(EDGE)).select(
        F.col("x").alias("a"), F.col("y").alias("b"), F.col("to.x").alias("c"), F.col("to.y").alias("d"),
        "n").toDF(*EDGE, "n")


def _without_crossings(edges: DataFrame) -> DataFrame:
    """The same edges; two that cross inside both fail the query."""
    edges = edges.withColumn("level", _level())
    large = _in_cells(edges).select(*(F.col(n).alias(f"o{n}") for n in EDGE), "level", "cx", "cy")
    small = _in_cells(edges.withColumnRenamed("level", "own").withColumn(
        "level", F.explode(_levels(edges))).where("own <= level")).drop("own")
    e, o = [F.col(n) for n in EDGE], [F.col(f"o{n}") for n in EDGE]
    crossed = ((_turn(*e, o[0], o[1]) * _turn(*e, o[2], o[3]) < 0)
               & (_turn(*o, e[0], e[1]) * _turn(*o, e[2], e[3]) < 0))
    if small.join(large, ["level", "cx", "cy"]).where(crossed).limit(1).count():
        raise ValidationError("the union of shapes whose edges cross is not built")
    return edges.drop("level")


def _boundary(split: DataFrame) -> DataFrame:
    """The directed edges that have a polygon on one side only."""
    forward = F.struct("x0", "y0") < F.struct("x1", "y1")
    ends = [F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a)
            for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0"))]
    sides = split.select(*ends, forward.alias("forward"), "n").groupBy(*EDGE).agg(
        *(F.sum(F.when(F.col("forward") == way, F.col("n")).otherwise(0)).alias(name)
          for name, way in (("up", True), ("down", False))))
    both = (F.col("up") > 1) | (F.col("down") > 1)
    kept = F.when(both, F.raise_error(F.lit("the union of overlapping polygons is not built"))).otherwise(
        F.col("up") != F.col("down"))
    turned = F.col("up") == 0
    return sides.where(kept.cast("boolean")).select(
        *(F.when(turned, F.col(b)).otherwise(F.col(a)).alias(a)
          for a, b in (("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0")))).withColumn(
        "id", F.monotonically_increasing_id())


def _links(edges: DataFrame) -> DataFrame:
    """(id, next): at each vertex an edge goes on with the next one that keeps the polygon to the left.

    Around a vertex the edges that leave and those that arrive alternate, a polygon being between one that
    leaves and the next that arrives.
    """
    def ends(x, y, to_x, to_y, leaves):
        return edges.select(
            F.col(x).alias("x"), F.col(y).alias("y"),
            F.atan2(F.col(to_y) - F.col(y), F.col(to_x) - F.col(x)).alias("angle"),
            F.struct(F.lit(leaves).alias("leaves"), F.col("id").alias("id")).alias("end"))

    around = Window.partitionBy("x", "y")
    turning = around.orderBy("angle")
    rows = ends("x0", "y0", "x1", "y1", True).union(ends("x1", "y1", "x0", "y0", False))
    before = F.coalesce(F.lag("end").over(turning), F.last("end").over(
        turning.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    rows = rows.withColumn("before", before)
    right = F.when(F.col("end.leaves") == F.col("before.leaves"), F.raise_error(F.lit(
        "the union of overlapping polygons is not built"))).otherwise(~F.col("end.leaves"))
    return rows.where(right.cast("boolean")).select(F.col("end.id").alias("id"),
                                                    F.col("before.id").alias("next"))


def _leaders(edges: DataFrame, links: DataFrame) -> DataFrame:
    """(id, next, first): the smallest edge of the ring of each edge."""
    own = F.struct(*EDGE, "id")
    rows = _written(edges.select("id", own.alias("first")).join(links, "id"), "rings")
    state = rows.select("id", F.col("next").alias("reach"), "first")
    changed = 1
    while changed:
        there = state.select(F.col("id").alias("reach"), F.col("reach").alias("far"),
                             F.col("first").alias("theirs"))
        least = F.least("first", "theirs")
        state = _written(state.join(there, "reach").select(
            "id", F.col("far").alias("reach"), least.alias("first"),
            (least["id"] != F.col("first.id")).alias("changed")), "rings")
        changed = state.where("changed").count()
        state = state.drop("changed")
    return state.select("id", "first").join(rows.select("id", "next"), "id")


def _places(rings: DataFrame) -> DataFrame:
    """(id, place): how many steps an edge is behind the first of its ring."""
    back = rings.select(F.col("next").alias("id"), F.col("id").alias("reach"), F.col("first.id").alias("lead"))
    state = back.select("id", F.when(F.col("id") != F.col("lead"), F.col("reach")).alias("reach"),
                        (F.col("id") != F.col("lead")).cast("bigint").alias("place"))
    while True:
        state = _written(state, "places")
        if not state.where("reach IS NOT NULL").limit(1).count():
            return state.select("id", "place")
        there = state.select(F.col("id").alias("reach"), F.col("reach").alias("far"),
                             F.col("place").alias("more"))
        state = state.join(there, "reach", "left").select(
            "id", F.col("far").alias("reach"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))


def _check_rings(edges: DataFrame, rings: DataFrame) -> None:
    """No polygon lies inside another: right of each ring's boundary there is none, left of it one."""
    steep = edges.where("y0 <> y1").join(rings.select("id", "first"), "id")
    one = steep.groupBy(F.col("first.id").alias("ring")).agg(
        F.min_by(F.struct(*EDGE, "id"), "id").alias("e")).select("ring", "e.*")
    one = one.select("ring", F.col("id").alias("own"), ((F.col("x0") + F.col("x1")) / 2).alias("mx"),
                     ((F.col("y0") + F.col("y1")) / 2).alias("my"), (F.col("y1") > F.col("y0")).alias("up"))
    high = steep.select(*EDGE, "id", F.ceil(F.log2(F.abs(F.col("y1") - F.col("y0")))).cast("int").alias(
        "level"))
    bands = high.withColumn("band", F.explode(F.sequence(
        _cell(F.least("y0", "y1"), F.col("level")), _cell(F.greatest("y0", "y1"), F.col("level")))))
    asked = one.withColumn("level", F.explode(_levels(high))).withColumn(
        "band", _cell(F.col("my"), F.col("level")))
    there = F.col("x0") + (F.col("my") - F.col("y0")) * (F.col("x1") - F.col("x0")) / (
        F.col("y1") - F.col("y0"))
    met = (((F.col("y0") <= F.col("my")) != (F.col("y1") <= F.col("my"))) & (there > F.col("mx"))
           & (F.col("id") != F.col("own")))
    # how often the places just east of the edge are inside
    east = asked.join(bands, ["level", "band"], "left").groupBy("ring", "up").agg(
        F.coalesce(F.sum(F.when(met, F.when(F.col("y1") > F.col("y0"), 1).otherwise(-1))),
                   F.lit(0)).alias("inside"))
    if east.where(F.col("inside") != F.when(F.col("up"), 0).otherwise(1)).limit(1).count():
        raise ValidationError("the union of overlapping polygons is not built")


def union_of_polygons(shapes: DataFrame) -> DataFrame:
    """run, place, lon, lat: the vertices of the boundary rings of the union, the union to their left.

    Exterior rings run against the clock, holes with it. Parts that only touch in a vertex have rings of
    their own; where one part touches itself in a vertex, its ring passes there twice. The number of a
    ring tells it from others only; its first vertex is that of its smallest edge. Vertices inside
    straight stretches stay. A null geometry is none.
    """
    edges = _written(_boundary(_split(_directed(shapes))), "boundary")
    _without_crossings(edges.select(*EDGE))
    rings = _leaders(edges, _links(edges))
    _check_rings(edges, rings)
    places = _places(rings)
    return (edges.join(rings.select("id", "first"), "id").join(places, "id")
            .select(F.col("first.id").alias("run"), "place", F.col("x0").alias("lon"),
                    F.col("y0").alias("lat")))


def union_of_lines(shapes: DataFrame) -> DataFrame:
    """run, place, lon, lat: the two ends of each different stretch of the lines between vertices.

    Lines may share stretches and touch at vertices; lines that cross elsewhere fail the query.
    """
    runs = shapes.select(F.explode("geometry.coords").alias("r"))
    parts = _split(runs.select(F.explode(_edges(F.col("r"))).alias("e")).select("e.*"))
    forward = F.struct("x0", "y0") < F.struct("x1", "y1")
    once = _written(parts.select(*(F.when(forward, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in (
        ("x0", "x1"), ("y0", "y1"), ("x1", "x0"), ("y1", "y0")))).distinct(), "stretches")
    once = _without_crossings(once).withColumn("run", F.monotonically_increasing_id())
    ends = F.array(*(F.struct(F.lit(i).cast("bigint").alias("place"), F.col(f"x{i}").alias("lon"),
                              F.col(f"y{i}").alias("lat")) for i in (0, 1)))
    return once.select("run", F.inline(ends))
