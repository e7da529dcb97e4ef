"""Geometric tests of lines, polygons and multi-part features, answers worked out by hand."""

import pytest
from pyspark.sql import functions as F

from isograd.functions import relate
from isograd.functions.geo import PREDICATES, shape_predicate, shape_predicates
from isograd.operators import features
from isograd.operators.geometry import GEOMETRY_TYPE
from isograd.suite.features import line_features

SQUARE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
HOLED = "POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (3 3, 6 3, 6 6, 3 6, 3 3))"
HOOK = "POLYGON((0 0, 6 0, 6 6, 4 6, 4 2, 0 2, 0 0))"
LINE = "LINESTRING(0 0, 4 0, 4 4)"
POINT = "POINT(2 2)"
PARTS = "MULTIPOLYGON(((0 0, 4 0, 4 4, 0 4, 0 0)), ((6 0, 8 0, 8 4, 6 4, 6 0)))"
POINTS = "MULTIPOINT(2.5 2.5, 3 3)"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


# kind, runs, literal, the tests that hold
CASES = [
    ("Polygon", [box(0, 0, 4, 4)], SQUARE, "intersects within contains almost_equals"),
    ("Polygon", [box(0, 0, 4, 4)[::-1]], SQUARE, "intersects within contains"),
    ("Polygon", [box(1, 1, 2, 2)], SQUARE, "intersects within"),
    ("Polygon", [box(0, 0, 2, 4)], SQUARE, "intersects within"),
    ("Polygon", [box(-1, -1, 5, 5)], SQUARE, "intersects contains"),
    ("Polygon", [box(0, 0, 5, 4)], SQUARE, "intersects contains"),
    ("Polygon", [box(4, 0, 6, 4)], SQUARE, "intersects touches"),
    ("Polygon", [box(4, 4, 6, 6)], SQUARE, "intersects touches"),
    ("Polygon", [box(2, 2, 6, 6)], SQUARE, "intersects"),
    ("Polygon", [box(5, 5, 6, 6)], SQUARE, "disjoint"),
    ("Polygon", [box(3, 3, 6, 6)], HOLED, "intersects touches"),
    ("Polygon", [box(4, 4, 5, 5)], HOLED, "disjoint"),
    ("Polygon", [box(1, 1, 8, 8)], HOLED, "intersects"),
    ("Polygon", [box(0, 0, 9, 9)], HOLED, "intersects contains"),
    ("Polygon", [box(0, 0, 9, 9), box(3, 3, 6, 6)], HOLED, "intersects within contains almost_equals"),
    ("Polygon", [box(0, 2, 4, 6)], HOOK, "intersects touches"),
    ("Polygon", [[(1, 1), (5, 1), (5, 5), (1, 1)]], HOOK, "intersects"),
    ("MultiPolygon", [box(0, 0, 1, 1), box(2, 2, 3, 3)], SQUARE, "intersects within"),
    ("MultiPolygon", [box(0, 0, 1, 1), box(7, 7, 9, 9)], SQUARE, "intersects"),
    ("LineString", [[(0, 0), (4, 4)]], SQUARE, "intersects within"),
    ("LineString", [[(0, 0), (4, 0)]], SQUARE, "intersects touches"),
    ("LineString", [[(0, 0), (4, 0), (4, 3)]], SQUARE, "intersects touches"),
    ("LineString", [[(-1, 2), (5, 2)]], SQUARE, "intersects crosses"),
    ("LineString", [[(-1, 4), (5, 4)]], SQUARE, "intersects touches"),
    ("LineString", [[(1, 1), (9, 9)]], SQUARE, "intersects crosses"),
    ("LineString", [[(4, 2), (9, 2)]], SQUARE, "intersects touches"),
    ("LineString", [[(2, -1), (5, 2)]], SQUARE, "intersects crosses"),
    ("LineString", [[(3, -1), (5, 1)]], SQUARE, "intersects touches"),
    ("LineString", [[(7, 7), (8, 8)]], SQUARE, "disjoint"),
    ("LineString", [[(1, 4.5), (8, 4.5)]], HOLED, "intersects crosses"),
    ("LineString", [[(3, 4.5), (6, 4.5)]], HOLED, "intersects touches"),
    ("MultiLineString", [[(1, 1), (2, 2)], [(8, 8), (9, 9)]], SQUARE, "intersects crosses"),
    ("MultiPoint", [[(1, 1), (4, 4)]], SQUARE, "intersects within"),
    ("MultiPoint", [[(0, 1), (4, 4)]], SQUARE, "intersects touches"),
    ("MultiPoint", [[(1, 1), (9, 4)]], SQUARE, "intersects crosses"),
    ("LineString", [[(0, 0), (4, 0), (4, 4)]], LINE, "intersects within contains almost_equals"),
    ("LineString", [[(1, 0), (4, 0)]], LINE, "intersects within"),
    ("LineString", [[(-1, 0), (4, 0), (4, 5)]], LINE, "intersects contains"),
    ("LineString", [[(2, -1), (2, 1)]], LINE, "intersects crosses"),
    ("LineString", [[(2, 0), (2, 1)]], LINE, "intersects touches"),
    ("LineString", [[(0, 0), (-3, -3)]], LINE, "intersects touches"),
    ("LineString", [[(2, 0), (6, 0)]], LINE, "intersects"),
    ("LineString", [[(3, -1), (5, 1)]], LINE, "intersects crosses"),
    ("LineString", [[(0, 1), (3, 1)]], LINE, "disjoint"),
    ("Polygon", [box(-1, -1, 5, 5)], LINE, "intersects contains"),
    ("Polygon", [box(0, 0, 4, 4)], LINE, "intersects touches"),
    ("Polygon", [box(1, -1, 2, 1)], LINE, "intersects crosses"),
    ("Polygon", [box(7, 7, 9, 9)], LINE, "disjoint"),
    ("MultiPoint", [[(1, 0), (4, 4)]], LINE, "intersects within"),
    ("MultiPoint", [[(0, 0), (4, 4)]], LINE, "intersects touches"),
    ("MultiPoint", [[(1, 0), (7, 7)]], LINE, "intersects crosses"),
    ("Polygon", [box(0, 0, 4, 4)], POINT, "intersects contains"),
    ("Polygon", [box(2, 2, 4, 4)], POINT, "intersects touches"),
    ("Polygon", [box(3, 3, 4, 4)], POINT, "disjoint"),
    ("LineString", [[(0, 0), (4, 4)]], POINT, "intersects contains"),
    ("LineString", [[(2, 2), (4, 4)]], POINT, "intersects touches"),
    ("MultiLineString", [[(2, 2), (4, 4)], [(2, 2), (0, 5)]], POINT, "intersects contains"),
    ("LineString", [[(3, 3), (4, 4)]], POINT, "disjoint"),
    ("MultiPoint", [[(2, 2), (3, 3)]], POINT, "intersects contains"),
    ("MultiPoint", [[(2, 2), (2, 2)]], POINT, "intersects within contains"),
    ("Polygon", [], SQUARE, ""),
    ("Polygon", [box(1, 1, 2, 2)], PARTS, "intersects within"),
    ("Polygon", [box(6, 0, 7, 1)], PARTS, "intersects within"),
    ("Polygon", [box(4, 0, 6, 4)], PARTS, "intersects touches"),
    ("Polygon", [box(0, 0, 8, 4)], PARTS, "intersects contains"),
    ("MultiPolygon", [box(0, 0, 4, 4), box(6, 0, 8, 4)], PARTS, "intersects within contains almost_equals"),
    ("Polygon", [box(4.5, 0, 5.5, 4)], PARTS, "disjoint"),
    ("LineString", [[(1, 1), (7, 1)]], PARTS, "intersects crosses"),
    ("LineString", [[(4, 1), (6, 1)]], PARTS, "intersects touches"),
    ("MultiPoint", [[(1, 1), (7, 1)]], PARTS, "intersects within"),
    ("Polygon", [box(0, 0, 4, 4)], POINTS, "intersects contains"),
    ("Polygon", [box(2, 2, 4, 4)], POINTS, "intersects contains"),
    ("Polygon", [box(2.8, 2.8, 4, 4)], POINTS, "intersects crosses"),
    ("Polygon", [box(3, 1, 9, 9)], POINTS, "intersects touches"),
    ("Polygon", [box(5, 5, 9, 9)], POINTS, "disjoint"),
    ("LineString", [[(0, 0), (4, 4)]], POINTS, "intersects contains"),
    ("LineString", [[(3, 3), (0, 0)]], POINTS, "intersects contains"),
    ("LineString", [[(3, 3), (2.9, 2.9)]], POINTS, "intersects touches"),
    ("LineString", [[(3, 3), (9, 3)]], POINTS, "intersects touches"),
    ("MultiPoint", [[(3, 3), (2.5, 2.5)]], POINTS, "intersects within contains"),
    ("MultiPoint", [[(3, 3), (2, 2)]], POINTS, "intersects"),
    ("MultiPoint", [[(3, 3)]], POINTS, "intersects within"),
]


@pytest.mark.parametrize("literal", [SQUARE, HOLED, HOOK, LINE, POINT, PARTS, POINTS])
def test_by_hand(spark, literal):
    cases = [c for c in CASES if c[2] == literal]
    # the same shapes far away and turned give the same answers
    rows = [(i, (kind, [[(float(x), float(y)) for x, y in run] for run in runs]))
            for i, (kind, runs, _, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, f"id int, g {GEOMETRY_TYPE}")
    got = df.select("id", *(shape_predicate(p, df.g, literal).alias(p) for p in PREDICATES)).collect()
    for r in got:
        assert {p for p in PREDICATES if r[p]} == set(cases[r.id][3].split()), cases[r.id]


def test_slanted_borders(spark):
    """Places that are not exact in binary lie on a border when they are meant to."""
    tilted = "POLYGON((0.1 0.1, 3.4 1.2, 2.3 4.5, -1.0 3.4, 0.1 0.1))"
    side = [(0.1 + 3.3 * k / 7, 0.1 + 1.1 * k / 7) for k in (1, 3)]
    shapes = [("LineString", [side], "intersects touches"),
              ("Polygon", [[side[0], side[1], (1.2, 0.0), side[0]]], "intersects touches"),
              ("Polygon", [[side[0], side[1], (1.2, 1.9), side[0]]], "intersects within")]
    df = spark.createDataFrame([(i, (k, runs)) for i, (k, runs, _) in enumerate(shapes)],
                               f"id int, g {GEOMETRY_TYPE}")
    for r in df.select("id", *(shape_predicate(p, df.g, tilted).alias(p) for p in PREDICATES)).collect():
        assert {p for p in PREDICATES if r[p]} == set(shapes[r.id][2].split()), shapes[r.id]


@pytest.fixture
def uncompared(monkeypatch):
    """A geometry that is compared edge by edge with the literal fails the query."""
    monkeypatch.setattr(relate, "_own_segments", lambda coords: (
        "CAST(raise_error('compared') AS array<struct<x0:double,y0:double,x1:double,y1:double,dx:double,"
        "dy:double,length:double,slack:double>>)"))


SOME = ("intersects", "disjoint", "within", "touches")


def held(spark, kind, runs, literal):
    """Which of some tests hold for each shape."""
    shapes = [(i, (kind, [[(float(x), float(y)) for x, y in run]])) for i, run in enumerate(runs)]
    df = spark.createDataFrame(shapes, f"id int, g {GEOMETRY_TYPE}")
    rows = df.select("id", *(shape_predicate(p, df.g, literal).alias(p) for p in SOME)).orderBy("id").collect()
    return [" ".join(p for p in SOME if r[p]) for r in rows]


@pytest.mark.parametrize("literal, corners, expected", [
    (HOLED, [(1, 1), (4, 4), (-5, 4)], ["intersects within", "disjoint", "disjoint"]),
    (HOOK, [(4.5, 4), (2, 4)], ["intersects within", "disjoint"]),
    (PARTS, [(4.2, 1), (6.5, 1)], ["disjoint", "intersects within"]),
    (LINE, [(2, 2)], ["disjoint"]), (POINTS, [(2.6, 1)], ["disjoint"]),
])
def test_polygons_away_from_edges_are_not_compared(spark, uncompared, literal, corners, expected):
    """Even where the feature lies inside the bounds of the literal."""
    runs = [box(x, y, x + 1, y + 0.75) for x, y in corners]
    assert held(spark, "Polygon", runs, literal) == expected


def test_polygons_on_an_edge_are_compared(spark, uncompared):
    for x in (8.5, 8, -1.0000001):  # across, on, and almost on the border
        with pytest.raises(Exception, match="compared"):
            held(spark, "Polygon", [box(x, 1, x + 1, 2)], HOLED)


def test_boxes_around_a_holed_region(spark):
    """All boxes of a lattice, also with corners next to the border, by comparing bounds."""
    places = [-1.0, 0.0, 1e-7, 2.0, 3.0, 5.0, 6.0 - 1e-7, 6.0, 7.5, 9.0, 10.0]
    spans = [(a, b) for a in places for b in places if a < b]
    rows = [(i, x, y) for i, (x, y) in enumerate((x, y) for x in spans for y in spans)]
    df = spark.createDataFrame([(i, ("Polygon", [box(x[0], y[0], x[1], y[1])])) for i, x, y in rows],
                               f"id int, g {GEOMETRY_TYPE}").repartition(8)
    names = ("intersects", "within", "contains", "touches")
    got = {r.id: tuple(r)[1:] for r in df.select(
        "id", *(shape_predicate(p, df.g, HOLED).alias(p) for p in names)).collect()}
    for i, x, y in rows:
        met = all(a <= 9 and b >= 0 for a, b in (x, y)) and not all(a > 3 and b < 6 for a, b in (x, y))
        inner = all(a < 9 and b > 0 for a, b in (x, y)) and not all(a >= 3 and b <= 6 for a, b in (x, y))
        within = all(a >= 0 and b <= 9 for a, b in (x, y)) and not all(a < 6 and b > 3 for a, b in (x, y))
        holds = all(a <= 0 and b >= 9 for a, b in (x, y))
        assert got[i] == (met, within, holds, met and not inner), (x, y)


def test_lines_away_from_edges_are_not_compared(spark, uncompared):
    """Even next to a border or in a hole."""
    steep = [[(x, 1.0), (x + 0.5, 1.5), (x, 1.75)] for x in (1, 4, 4.25, 9.1, 9.00001)]
    assert held(spark, "LineString", [*steep, [(4, 4), (5, 5)], [(-9, -9), (-1, 20)]], HOLED) == [
        "intersects within"] * 3 + ["disjoint"] * 4
    for run in ([(8, 1), (9.5, 1)], [(9, 1), (9, 2)], [(9.0000001, 1), (9.5, 2)]):  # across, on, almost on
        with pytest.raises(Exception, match="compared"):
            held(spark, "LineString", [run], HOLED)


def test_lines_around_a_holed_region(spark):
    """Level lines, also with ends next to the border, by comparing bounds."""
    places = [-1.0, 0.0, 1e-7, 2.0, 3.0, 5.0, 6.0 - 1e-7, 6.0, 7.5, 9.0, 10.0]
    rows = [(a, b, y) for a in places for b in places if a < b for y in (-1.0, 0.0, 1.0, 3.0, 4.5, 8.9, 9.5)]
    got = held(spark, "LineString", [[(a, y), (b, y)] for a, b, y in rows], HOLED)
    for (a, b, y), tests in zip(rows, got):
        hole = 3 < y < 6
        meets = 0 <= y <= 9 and a <= 9 and b >= 0 and not (hole and a > 3 and b < 6)
        inner = 0 < y < 9 and a < 9 and b > 0 and not (hole and a >= 3 and b <= 6)
        whole = a >= 0 and b <= 9 and not (hole and a < 6 and b > 3)
        holds = {"intersects": meets, "disjoint": not meets, "within": inner and whole,
                 "touches": meets and not inner}
        if y == 3.0:  # along the border of the hole
            holds["within"] = 0 <= a and b <= 9 and not (a >= 3 and b <= 6)
            holds["touches"] = meets and ((a >= 3 and b <= 6) or a >= 9 or b <= 0)
        assert tests == " ".join(p for p in SOME if holds[p]), (a, b, y)


@pytest.mark.parametrize("literal", [SQUARE, LINE, POINT, POINTS])
def test_all_tests_as_one_struct(spark, literal):
    cases = [(i, (kind, [[(float(x), float(y)) for x, y in run] for run in runs]), expected)
             for i, (kind, runs, against, expected) in enumerate(CASES) if against == literal]
    df = spark.createDataFrame([*cases, (-1, None, "")], f"id int, g {GEOMETRY_TYPE}, expected string")
    out = df.select("expected", shape_predicates(PREDICATES, df.g, literal).alias("tests"))
    assert cases
    for r in out.select("expected", "tests.*").collect():
        assert {p for p in PREDICATES if r[p]} == set(r.expected.split())


def test_several_tests_compare_a_shape_once(spark, monkeypatch):
    """Also those of a collection's members."""
    bounds, made = relate._bounds, []
    monkeypatch.setattr(relate, "_bounds", lambda vertices: made.append(vertices) or bounds(vertices))
    line = ("LineString", [[(1.0, 1.0), (2.0, 1.0)]])
    df = spark.createDataFrame([(line,)], f"geometry {GEOMETRY_TYPE}")
    names = ("intersects", "disjoint", "within")
    out = df.select(features.feature_predicates(df, names, SQUARE).alias("tests"))
    assert tuple(out.select("tests.*").first()) == (True, False, True)
    assert len(made) <= 4  # of the shape and of a member, which Spark's lambda may be asked for again


def test_lines_of_one_file_are_dealt_over_tasks(spark):
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        lines = line_features(spark, "/root/testdata/sf0.001")
        assert lines.select(F.spark_partition_id()).distinct().count() == 4
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
