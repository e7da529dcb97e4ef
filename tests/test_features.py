import math

import pytest
from pyspark.sql import functions as F

from isograd import ValidationError
from isograd.functions.geo import great_circle_distance, point_predicate
from isograd.operators import features, geometry


# A, B, C, D, lon, lat: a slanted row of stations and three more
STATIONS = [(1, "kim", True, 2.5, -3.0, 40.0), (2, "lea", False, 0.9, 1.0, 42.0),
            (3, "mo", False, 1.7, 5.0, 44.0), (4, "nia", True, 0.2, 9.0, 46.0),
            (5, "ole", True, 0.9, 1.0, 47.0), (6, "pia", False, 0.2, 7.5, 40.5),
            (7, "qi", True, 3.1, -3.0, 48.0)]


@pytest.fixture(scope="module")
def seven(spark):
    return spark.createDataFrame(
        STATIONS, "A int, B string, C boolean, D double, lon double, lat double")


def ids(df):
    return sorted(r.A for r in df.collect())


def chosen(test):
    return [s[0] for s in STATIONS if test(*s)]


@pytest.mark.parametrize("query, test", [
    ("D >= 0.9 and B != 'mo'", lambda a, b, c, d, x, y: d >= 0.9 and b != "mo"),
    ("C and @almost_equals('9,46')", lambda a, b, c, d, x, y: (x, y) == (9, 46)),
    ("@contains('1,42')", lambda a, b, c, d, x, y: (x, y) == (1, 42)),
    ("@crosses('1,42')", lambda *s: False),
    ("not C and @disjoint('5,44')", lambda a, b, c, d, x, y: not c and (x, y) != (5, 44)),
    ("@intersects('0, 41, 8, 47')", lambda a, b, c, d, x, y: 0 <= x <= 8 and 41 <= y <= 47),
    ("@within('0, 41, 8, 47')", lambda a, b, c, d, x, y: 0 < x < 8 and 41 < y < 47),
    ("@touches('0, 41, 8, 47')", lambda a, b, c, d, x, y: a == 5),
    ('C and @within("POLYGON((0 39, 12 39, 12 50, 0 39))")',
     lambda a, b, c, d, x, y: c and 0 < x < 12 and 39 < y < 39 + 11 * x / 12),
    ("@intersects('LINESTRING (-3 40, 9 46)')", lambda a, b, c, d, x, y: a <= 4),
    ("@touches('LINESTRING (-3 40, 9 46)')", lambda a, b, c, d, x, y: a in (1, 4)),
    ("@within('LINESTRING (-3 40, 9 46)')", lambda a, b, c, d, x, y: a in (2, 3)),
])
def test_query(seven, query, test):
    assert ids(features.data_frame_query(seven, query)) == chosen(test)


def test_query_rejects_unknown_tests(seven):
    with pytest.raises(ValidationError):
        features.data_frame_query(seven, "@near('10,10')")
    with pytest.raises(ValidationError):
        point_predicate("near", F.col("lon"), F.col("lat"), "10,10")


def test_holes_and_missing_points(spark):
    df = spark.createDataFrame([(1, 2.5, 2.5), (2, 5.0, 5.0), (3, 2.0, 3.0), (4, None, None)],
                               "A int, lon double, lat double")
    holed = "POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 4 2, 4 4, 2 4, 2 2))"

    def test(name):
        return ids(df.where(point_predicate(name, F.col("lon"), F.col("lat"), holed)))

    assert test("within") == [2] and test("intersects") == [2, 3] and test("touches") == [3]
    assert test("disjoint") == [1]


def test_long_rings_are_folded(spark):
    """A circle of 400 edges gives the same answer as the distance to its centre."""
    ring = [(10 * math.cos(a), 10 * math.sin(a))
            for a in (2 * math.pi * k / 400 for k in range(400))]
    i = F.col("id")
    df = spark.range(900).select((i % 30 - 14.6).alias("lon"), (F.floor(i / 30) - 14.3).alias("lat"))
    inside = point_predicate("within", F.col("lon"), F.col("lat"), ring)
    wrong = df.where(inside != (F.hypot("lon", "lat") < 9.9996)).where(
        F.abs(F.hypot("lon", "lat") - 10) > 0.01)
    assert wrong.count() == 0 and df.where(inside).count() > 250


def test_subset(seven):
    region = "POLYGON((-5 39, 10 39, 10 45.5, -5 39))"
    under = chosen(lambda a, b, c, d, x, y: -5 < x < 10 and 39 < y < 39 + 6.5 * (x + 5) / 15)
    assert under and ids(features.data_frame_subset(seven, region=region)) == under
    out = features.data_frame_subset(seven, region=region, var_names="A, C")
    assert out.columns == ["lon", "lat", "A", "C"]
    away = "POLYGON((20 20, 30 20, 25 31, 20 20))"
    assert features.data_frame_subset(seven, region=away).count() == 0


def test_min_max_take_the_first(seven):
    assert features.data_frame_min(seven, "D", "A").first().A == 4
    assert features.data_frame_max(seven, "D", "A").first().A == 7
    assert features.data_frame_min(seven.where("D = 0.9"), "D", "A").first().A == 2


def angle(x0, y0, x1, y1):
    """Great-circle degrees by the spherical law of cosines."""
    a, b, c, d = map(math.radians, (x0, y0, x1, y1))
    return math.degrees(math.acos(math.sin(b) * math.sin(d)
                                  + math.cos(b) * math.cos(d) * math.cos(a - c)))


def test_closest(seven):
    assert features.data_frame_find_closest(seven, "POINT(5 44)", "A").first().distance == 0
    far = sorted((angle(4, 43, s[4], s[5]), s[0]) for s in STATIONS)
    rows = features.data_frame_find_closest(seven, "POINT(4 43)", "A", 3, dist_col_name="d").collect()
    assert [r.A for r in rows] == [a for _, a in far[:3]]
    assert [r.d for r in rows] == pytest.approx([d for d, _ in far[:3]], abs=1e-7)
    limit = (far[1][0] + far[2][0]) / 2
    assert features.data_frame_find_closest(seven, "POINT(4 43)", "A", 3, limit).count() == 2
    assert features.data_frame_find_closest(seven, "POINT(4 43)", "A", 3, 0.1).count() == 0


@pytest.mark.parametrize("a, b, expected", [
    ((20, 20), (20, 20), 0), ((20, 0), (20, 30), 30), ((-20, 0), (20, 0), 40),
    ((-155, 0), (155, 0), 50), ((0, 0), (0, 90), 90), ((0, -90), (0, 90), 180),
    ((0, 0), (1, 1), 1.4141777),
])
def test_distance(spark, a, b, expected):
    away = great_circle_distance(*(F.lit(float(v)) for v in (*a, *b)))
    assert spark.range(1).select(away).first()[0] == pytest.approx(expected, abs=1e-7)


def test_aggregate(spark):
    df = spark.createDataFrame([("A", 45.0, -120.0, True), ("B", 46.0, -121.2, False),
                                ("C", 47.5, -122.9, True)],
                               "name string, lat double, lon double, ok boolean")
    for limit in (None, 1):
        row = features.data_frame_aggregate(df, group_limit=limit).first()
        assert len(row) == 21
        assert (row.lat_count, row.lat_median, row.ok_sum) == (3, 46.0, 2)
        assert row.lat_std == pytest.approx(1.2583057)
    twice = df.unionAll(df.limit(1)).selectExpr("name", "lat", "lat - 100 AS lon", "ok")
    shaped = features.data_frame_aggregate(twice, "lat", aggregate_geometry=True).collect()
    assert sorted(r.lon for r in shaped) == [-55.0, -54.0, -52.5]
    assert {r.lat_count for r in shaped} == {4}
    for bad in ("asdc, lat", "name, lat"):
        with pytest.raises(ValidationError):
            features.data_frame_aggregate(df, bad)


def shape(spark, kind, *runs):
    rows = [(1, (kind, [[(float(x), float(y)) for x, y in run] for run in runs]))]
    return spark.createDataFrame(rows, f"id int, g {geometry.GEOMETRY_TYPE}")


def point_of(df):
    p = df.select(geometry.pointify(F.col("g")).alias("p")).first().p
    return p.type, p.coords[0][0].x, p.coords[0][0].y


def test_pointify(spark):
    square = [(0, 0), (2, 0), (2, 2), (0, 2), (0, 0)]
    assert point_of(shape(spark, "Polygon", square)) == ("Point", 1, 1)
    assert point_of(shape(spark, "LineString", square[:3])) == ("Point", 4 / 3, 2 / 3)
    # several runs are pooled; only the very first and last vertex decide
    assert point_of(shape(spark, "MultiLineString", square[:2], square[2:4])) == ("Point", 1, 1)
    assert point_of(shape(spark, "Point", [(3, 4)])) == ("Point", 3, 4)


def test_display_limits(spark):
    ring = [(0, 0), (4, 0), (4, 4), (0, 0)]
    df = shape(spark, "Polygon", ring, ring)
    assert df.select(geometry.vertex_count(F.col("g"))).first()[0] == 8
    for limit, ratio, kind, flag in ((7, 1.0, "Point", 1), (8, 1.0, "Polygon", 0),
                                     (-1, 1.0, "Polygon", 0), (-1, 0.0, "Point", 1)):
        shown, simple = geometry.display_geometry(F.col("g"), limit, ratio)
        assert tuple(df.select(shown["type"], simple).first()) == (kind, flag)


def test_triangle_areas(spark):
    ring = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (0, 1), (0, 0)]
    rows = geometry.triangle_areas(shape(spark, "Polygon", ring), "g", ["id"]).orderBy("vertex")
    assert [r.area for r in rows.collect()] == [0, 0.5, 0, 0.5, 0, 0.5, 0]
    assert geometry.triangle_areas(shape(spark, "LineString", ring[:2]), "g", ["id"]).count() == 0
