"""Feature tables and geometry columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isograd.functions.geo import PREDICATES, great_circle_distance, point_predicate
from isograd.operators import features, geometry
from isograd.plans.views import points
from isograd.suite.registry import case, rounded
from isograd.suite.subsets import RING, ring_test

POINTS = ("points",)
_RING = f"(lon BETWEEN -100.3 AND 52.3 AND lat BETWEEN -51.7 AND 61.9 AND {ring_test('lon', 'lat')})"
_IN = "(lon > -60 AND lon < 60 AND lat > -30 AND lat < 45)"
_ON = "(lon BETWEEN -60 AND 60 AND lat BETWEEN -30 AND 45)"


@case("p10_query", """SELECT * FROM points WHERE value >= 4000 AND kind <> 'BUILDING'
AND NOT id = 7""", POINTS)
def query(spark, sf_dir):
    return features.data_frame_query(points(spark, sf_dir),
                                     "value >= 4000 and kind != 'BUILDING' and not id == 7")


@case("p10_query_with_geometry", f"""SELECT * FROM points WHERE (value < 5000 AND {_IN})
OR (lon = -180 AND lat = -90)""", POINTS)
def query_with_geometry(spark, sf_dir):
    return features.data_frame_query(
        points(spark, sf_dir),
        "(value < 5000 and @within('-60, -30, 60, 45')) or @contains('-180,-90')")


@case("p11_predicates_box", f"""SELECT id, {_ON} AS intersects, NOT {_ON} AS disjoint, {_IN} AS within,
  {_ON} AND NOT {_IN} AS touches, FALSE AS crosses, FALSE AS contains, FALSE AS almost_equals
FROM points""", POINTS)
def box_predicates(spark, sf_dir):
    return _predicates(points(spark, sf_dir), "-60, -30, 60, 45")


@case("p11_predicates_polygon", f"""SELECT id, {_RING} AS intersects, NOT {_RING} AS disjoint,
  {_RING} AS within, FALSE AS touches, FALSE AS crosses, FALSE AS contains,
  FALSE AS almost_equals FROM points""", POINTS)
def polygon_predicates(spark, sf_dir):
    return _predicates(points(spark, sf_dir), RING)


@case("p11_predicates_point", """SELECT id, s AS intersects, NOT s AS disjoint, s AS within,
  FALSE AS touches, FALSE AS crosses, s AS contains, near AS almost_equals
FROM (SELECT id, lon = -180 + 3700/10.0::DOUBLE AND lat = -90 + 1700/10.0::DOUBLE AS s,
  sqrt(pow(lon - 190, 2) + pow(lat - 80, 2)) <= 0.5e-6 AS near FROM points)""", POINTS)
def point_predicates(spark, sf_dir):
    return _predicates(points(spark, sf_dir), (190.0, 80.0))


@case("p11_predicates_multipolygon", """SELECT id, near OR far AS intersects, NOT (near OR far) AS disjoint,
  (near AND lon > -90 AND lon < -20 AND lat > -45 AND lat < 5)
    OR (far AND lon > 30 AND lon < 110 AND lat > 10 AND lat < 66) AS within,
  (near OR far) AND NOT ((near AND lon > -90 AND lon < -20 AND lat > -45 AND lat < 5)
    OR (far AND lon > 30 AND lon < 110 AND lat > 10 AND lat < 66)) AS touches,
  FALSE AS crosses, FALSE AS contains, FALSE AS almost_equals
FROM (SELECT *, lon BETWEEN -90 AND -20 AND lat BETWEEN -45 AND 5 AS near,
  lon BETWEEN 30 AND 110 AND lat BETWEEN 10 AND 66 AS far FROM points)""", POINTS)
def multi_predicates(spark, sf_dir):
    return _predicates(points(spark, sf_dir), "MULTIPOLYGON(((-90 -45, -20 -45, -20 5, -90 5, -90 -45)), "
                                              "((30 10, 110 10, 110 66, 30 66, 30 10)))")


def _predicates(df: DataFrame, region) -> DataFrame:
    return df.select("id", *(point_predicate(p, F.col("lon"), F.col("lat"), region).alias(p)
                             for p in PREDICATES))


# boxes and axis-parallel lines on whole numbers, many of which share corners and sides with the region
_BOXES = """boxes AS (SELECT id, id % 3 AS kind, CAST(id * 7 % 17 - 9 AS DOUBLE) AS x0,
    CAST(id * 5 % 13 - 7 AS DOUBLE) AS y0,
    CAST(id * 7 % 17 - 9 AS DOUBLE) + CASE WHEN id % 3 = 1 THEN 0 ELSE 1 + id // 7 % 9 END AS x1,
    CAST(id * 5 % 13 - 7 AS DOUBLE) + CASE WHEN id % 3 = 2 THEN 0 ELSE 1 + id // 11 % 7 END AS y1
  FROM points),
met AS (SELECT *, x0 <= 5 AND x1 >= -4 AND y0 <= 4 AND y1 >= -3 AS closed,
    CASE kind WHEN 0 THEN x0 < 5 AND x1 > -4 AND y0 < 4 AND y1 > -3
      WHEN 1 THEN x0 > -4 AND x0 < 5 AND y0 < 4 AND y1 > -3
      ELSE y0 > -3 AND y0 < 4 AND x0 < 5 AND x1 > -4 END AS inner_meets,
    x0 >= -4 AND x1 <= 5 AND y0 >= -3 AND y1 <= 4 AS covered FROM boxes)"""
_BOX = "-4, -3, 5, 4"


def boxes(spark, sf_dir) -> DataFrame:
    """Boxes, upright and level lines, a third each."""
    key = F.col("id")
    x, y = (key * 7 % 17 - 9).cast("double"), (key * 5 % 13 - 7).cast("double")
    wide = F.when(key % 3 == 1, 0.0).otherwise((1 + F.expr("id div 7") % 9).cast("double"))
    high = F.when(key % 3 == 2, 0.0).otherwise((1 + F.expr("id div 11") % 7).cast("double"))

    def at(dx, dy):
        return F.struct((x + wide * dx).alias("x"), (y + high * dy).alias("y"))

    ring = F.array(at(1, 0), at(1, 1), at(0, 1), at(0, 0), at(1, 0))
    return points(spark, sf_dir).select("id", F.struct(
        F.when(key % 3 == 0, "Polygon").otherwise("LineString").alias("type"),
        F.array(F.when(key % 3 == 0, ring).otherwise(F.array(at(0, 0), at(1, 1)))).alias("coords")
    ).alias("geometry"))


def _shape_case(name: str, sql: str, region: str = _BOX) -> None:
    @case(f"p11_{name}_shapes", f"WITH {_BOXES} SELECT id FROM met WHERE {sql}", POINTS)
    def tested(spark, sf_dir):
        return features.data_frame_query(boxes(spark, sf_dir), f"@{name}('{region}')").select("id")


_shape_case("intersects", "closed")
_shape_case("disjoint", "NOT closed")
_shape_case("touches", "closed AND NOT inner_meets")
_shape_case("within", "covered AND inner_meets")
_shape_case("crosses", "kind <> 0 AND inner_meets AND NOT covered")
_shape_case("contains", "kind = 0 AND x0 <= -2 AND x1 >= 0 AND y0 <= 1 AND y1 >= 2", "-2, 1, 0, 2")
_shape_case("almost_equals", "kind = 0 AND x0 = -9 AND x1 = -8 AND y0 = -7 AND y1 = -6", "-9, -7, -8, -6")


@case("p12_subset", f"SELECT lon, lat, id, value FROM points WHERE {_RING}", POINTS)
def subset(spark, sf_dir):
    return features.data_frame_subset(points(spark, sf_dir), region=RING, var_names="id, value")


@case("a7_aggregate", """SELECT count(value) AS value_count, round(avg(value), 4) AS value_mean,
  round(quantile_cont(value, 0.5), 4) AS value_median, round(sum(value), 2) AS value_sum,
  round(stddev_samp(value), 4) AS value_std, min(value) AS value_min, max(value) AS value_max,
  count(lat) AS lat_count, round(avg(lat), 6) AS lat_mean,
  round(quantile_cont(lat, 0.5), 6) AS lat_median, round(sum(lat), 4) AS lat_sum,
  round(stddev_samp(lat), 6) AS lat_std, min(lat) AS lat_min, max(lat) AS lat_max
FROM points""", POINTS)
def aggregate(spark, sf_dir):
    out = features.data_frame_aggregate(points(spark, sf_dir), "value, lat")
    out = rounded(out, 4, "value_mean", "value_median", "value_std", "lat_sum")
    return rounded(rounded(out, 2, "value_sum"), 6, "lat_mean", "lat_median", "lat_std")


@case("a8_aggregate_geometry", """SELECT DISTINCT lon, lat FROM points""", POINTS)
def union(spark, sf_dir):
    return features.geometry_union(points(spark, sf_dir))


_CELLS = """WITH RECURSIVE cells AS (SELECT DISTINCT CAST(floor(lon / 10) * 10 AS DOUBLE) AS x,
    CAST(floor(lat / 10) * 10 AS DOUBLE) AS y FROM points WHERE id % 3 <> 1),
sides AS (SELECT x AS x0, y AS y0, x + 10 AS x1, y AS y1 FROM cells
  UNION ALL SELECT x + 10, y, x + 10, y + 10 FROM cells
  UNION ALL SELECT x + 10, y + 10, x, y + 10 FROM cells UNION ALL SELECT x, y + 10, x, y FROM cells),
edges AS (SELECT * FROM sides s WHERE NOT EXISTS (SELECT 1 FROM sides o
  WHERE o.x0 = s.x1 AND o.y0 = s.y1 AND o.x1 = s.x0 AND o.y1 = s.y0)),
turns AS (SELECT a.x0, a.y0, a.x1, a.y1, b.x1 AS x2, b.y1 AS y2, row_number() OVER (
    PARTITION BY a.x0, a.y0, a.x1, a.y1
    ORDER BY (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) DESC) AS choice
  FROM edges a JOIN edges b ON b.x0 = a.x1 AND b.y0 = a.y1),
walk AS (SELECT x0 AS sx, y0 AS sy, x1 AS ex, y1 AS ey, 0 AS place, x0, y0, x1, y1 FROM edges
  UNION ALL
  SELECT sx, sy, ex, ey, place + 1, t.x0, t.y0, t.x1, t.y1
  FROM walk w JOIN turns p ON p.choice = 1 AND (p.x0, p.y0, p.x1, p.y1) = (w.x0, w.y0, w.x1, w.y1)
    JOIN edges t ON (t.x0, t.y0, t.x1, t.y1) = (p.x1, p.y1, p.x2, p.y2)
  WHERE (t.x0, t.y0, t.x1, t.y1) > (sx, sy, ex, ey)),
reached AS (SELECT *, row_number() OVER (PARTITION BY x0, y0, x1, y1 ORDER BY sx, sy, ex, ey) AS n
  FROM walk)"""


@case("a8_union_polygons", f"""{_CELLS}
SELECT sx AS first_lon, sy AS first_lat, CAST(place AS BIGINT) AS place, x0 AS lon, y0 AS lat
FROM reached WHERE n = 1""", POINTS)
def dissolved(spark, sf_dir):
    """The boundary of the cells of 10 degrees that points lie in; every other ring runs the other way."""
    x, y = (F.floor(F.col(c) / 10) * 10.0 for c in ("lon", "lat"))
    cells = points(spark, sf_dir).where("id % 3 <> 1").select(x.alias("x"), y.alias("y")).distinct()
    corner = [F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
              for dx, dy in ((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))]
    ring = F.when(F.pmod(F.col("x") / 10 + F.col("y") / 10, F.lit(2)) == 0, F.array(*corner)).otherwise(
        F.array(*corner[::-1]))
    cells = cells.select(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coords")).alias(
        "geometry"))
    out = features.geometry_union(cells)
    own = Window.partitionBy("run").orderBy("place")
    return out.select(F.first("lon").over(own).alias("first_lon"),
                      F.first("lat").over(own).alias("first_lat"), "place", "lon", "lat")


@case("k1_min", "SELECT * FROM points ORDER BY value, id LIMIT 1", POINTS)
def lowest(spark, sf_dir):
    return features.data_frame_min(points(spark, sf_dir), "value", "id")


@case("k1_max", "SELECT * FROM points ORDER BY lat DESC, id LIMIT 1", POINTS)
def highest(spark, sf_dir):
    return features.data_frame_max(points(spark, sf_dir), "lat", "id")


def _distance(lon: float, lat: float) -> str:
    gap = f"radians(CASE WHEN abs(lon - {lon}) > 180 THEN 360 - abs(lon - {lon}) " \
          f"ELSE abs(lon - {lon}) END)"
    a, b = f"radians({lat}::DOUBLE)", "radians(lat)"
    return (f"degrees(atan2(sqrt(pow(cos({b}) * sin({gap}), 2) + pow(cos({a}) * sin({b}) - sin({a})"
            f" * cos({b}) * cos({gap}), 2)), sin({a}) * sin({b}) + cos({a}) * cos({b})"
            f" * cos({gap})))")


@case("k2_find_closest", f"""SELECT id, value, kind, lon, lat, round(d, 9) AS distance FROM (
  SELECT *, {_distance(21, 28)} AS d FROM points) WHERE d <= 60 ORDER BY d, id LIMIT 25""", POINTS)
def closest(spark, sf_dir):
    out = features.data_frame_find_closest(points(spark, sf_dir), "POINT (21 28)", "id", 25, 60.0)
    return rounded(out, 9, "distance")


@case("k3_great_circle_distance", f"""SELECT id, round({_distance(-155, 10)}, 8) AS distance
FROM points""", POINTS)
def distances(spark, sf_dir):
    away = great_circle_distance(F.lit(-155.0), F.lit(10.0), F.col("lon"), F.col("lat"))
    return points(spark, sf_dir).select("id", F.round(away, 8).alias("distance"))


def shapes(spark, sf_dir) -> DataFrame:
    """Every third feature is a closed ring, the others open lines, of 4 to 8 vertices."""
    step = F.sequence(F.lit(0), (F.col("id") % 5 + 3).cast("int"))

    def vertex(i):
        return F.struct((F.col("lon") + i * i % 3).alias("x"), (F.col("lat") - i * 2 % 5).alias("y"))

    run = F.transform(step, vertex)
    ring = F.col("id") % 3 == 0
    closed = F.when(ring, F.concat(run, F.slice(run, 1, 1))).otherwise(run)
    return points(spark, sf_dir).select("id", F.struct(
        F.when(ring, "Polygon").otherwise("LineString").alias("type"),
        F.array(closed).alias("coords")).alias("geometry"))


_SHAPES = """steps AS (SELECT id, lon, lat, unnest(range(0, id % 5 + 4)) AS i FROM points),
open AS (SELECT id, i, lon + i * i % 3 AS x, lat - i * 2 % 5 AS y FROM steps),
verts AS (SELECT * FROM open UNION ALL
  SELECT o.id, o.id % 5 + 4, x, y FROM open o WHERE i = 0 AND id % 3 = 0)"""


@case("g1_pointify", f"""WITH {_SHAPES} SELECT id, round(avg(x), 8) AS x, round(avg(y), 8) AS y
FROM open GROUP BY 1""", POINTS)
def pointified(spark, sf_dir):
    spot = F.col("p.coords")[0][0]
    rows = shapes(spark, sf_dir).select("id", geometry.pointify(F.col("geometry")).alias("p"))
    return rows.select("id", F.round(spot["x"], 8).alias("x"), F.round(spot["y"], 8).alias("y"))


@case("g2_vertex_count", f"""WITH {_SHAPES} SELECT id, count(*) AS vertices,
  CASE WHEN count(*) > 6 THEN 'Point' WHEN id % 3 = 0 THEN 'Polygon' ELSE 'LineString' END AS shown
FROM verts GROUP BY 1""", POINTS)
def counted(spark, sf_dir):
    shown, _ = geometry.display_geometry(F.col("geometry"), 6)
    return shapes(spark, sf_dir).select(
        "id", geometry.vertex_count(F.col("geometry")).alias("vertices"),
        shown["type"].alias("shown"))


@case("g3_triangle_area", f"""WITH {_SHAPES},
n AS (SELECT id, i, x, y, lag(x) OVER w AS xa, lag(y) OVER w AS ya, lead(x) OVER w AS xc,
  lead(y) OVER w AS yc FROM verts WINDOW w AS (PARTITION BY id ORDER BY i))
SELECT id, CAST(0 AS BIGINT) AS run, i AS vertex,
  round(0.5 * abs((x - xa) * (yc - ya) - (y - ya) * (xc - xa)), 8) AS area
FROM n WHERE xa IS NOT NULL AND xc IS NOT NULL""", POINTS)
def areas(spark, sf_dir):
    return rounded(geometry.triangle_areas(shapes(spark, sf_dir), "geometry", ["id"]), 8, "area")


# a region of five corners that is not convex, its corners and edges
_REGION = [(-71.3, -33.7), (64.9, -51.2), (88.4, 36.6), (6.1, 2.3), (-47.7, 58.8)]
_CORNERS = ", ".join(f"({x}::DOUBLE, {y}::DOUBLE)" for x, y in _REGION)
_BORDER = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for (a, b), (c, d) in zip(
    _REGION, _REGION[1:] + _REGION[:1]))
_MEETS = f"""{_SHAPES},
border(a, b, c, d) AS (VALUES {_BORDER}),
edges AS (SELECT * FROM (SELECT id, x, y, lead(x) OVER w AS x1, lead(y) OVER w AS y1 FROM verts
  WINDOW w AS (PARTITION BY id ORDER BY i)) WHERE x1 IS NOT NULL),
inside AS (SELECT id, i, count(*) FILTER ((b > y) <> (d > y) AND x < (c - a) * (y - b) / (d - b) + a)
    % 2 = 1 AS hit FROM verts, border GROUP BY id, i),
crossed AS (SELECT id, bool_or(
    ((x1 - x) * (b - y) - (y1 - y) * (a - x)) * ((x1 - x) * (d - y) - (y1 - y) * (c - x)) < 0 AND
    ((c - a) * (y - b) - (d - b) * (x - a)) * ((c - a) * (y1 - b) - (d - b) * (x1 - a)) < 0) AS hit
  FROM edges, border GROUP BY id),
around AS (SELECT id, count(*) FILTER ((y > {_REGION[0][1]}) <> (y1 > {_REGION[0][1]})
    AND {_REGION[0][0]} < (x1 - x) * ({_REGION[0][1]} - y) / (y1 - y) + x) % 2 = 1 AS hit
  FROM edges GROUP BY id),
met AS (SELECT p.id, p.id % 3 = 0 AS area, bool_or(p.hit) OR any_value(c.hit)
    OR (p.id % 3 = 0 AND any_value(a.hit)) AS meets, bool_and(p.hit) AND NOT any_value(c.hit) AS whole
  FROM inside p JOIN crossed c USING (id) JOIN around a USING (id) GROUP BY p.id)"""


def _tested(spark, sf_dir, kind: str) -> DataFrame:
    region = "POLYGON ((" + ", ".join(f"{x} {y}" for x, y in [*_REGION, _REGION[0]]) + "))"
    rows = shapes(spark, sf_dir).where(F.col("geometry.type") == kind).repartition("id")
    tests = features.feature_predicates(rows, ("intersects", "disjoint", "within"), region)
    return rows.select("id", tests.alias("tests")).select("id", "tests.*")


@case("p11_predicates_polygon_features", f"""WITH {_MEETS} SELECT id, meets AS intersects,
  NOT meets AS disjoint, whole AS within FROM met WHERE area""", POINTS)
def polygon_features(spark, sf_dir):
    return _tested(spark, sf_dir, "Polygon")


@case("p11_predicates_line_features", f"""WITH {_MEETS} SELECT id, meets AS intersects,
  NOT meets AS disjoint, whole AS within FROM met WHERE NOT area""", POINTS)
def line_features(spark, sf_dir):
    return _tested(spark, sf_dir, "LineString")


@case("k2_find_closest_polygons", f"""WITH {_SHAPES},
b AS (SELECT id, (min(x) + max(x)) / 2 AS lon, (min(y) + max(y)) / 2 AS lat FROM verts
  WHERE id % 3 = 0 GROUP BY id)
SELECT id, round(distance, 9) AS distance FROM (
  SELECT id, {_distance(21, 28)} AS distance FROM b) ORDER BY distance, id LIMIT 25""", POINTS)
def closest_polygons(spark, sf_dir):
    rows = shapes(spark, sf_dir).where(F.col("geometry.type") == "Polygon")
    out = features.data_frame_find_closest(rows, "POINT (21 28)", "id", 25)
    return rounded(out.select("id", "distance"), 9, "distance")
