"""Unions of polygons and lines against cells on paper."""

import random

import pytest

from isograd.model import ValidationError
from isograd.operators import features
from isograd.operators.geometry import GEOMETRY_TYPE


def table(spark, shapes):
    rows = [(i, (kind, [[(float(x), float(y)) for x, y in run] for run in runs]) if kind else None)
            for i, (kind, runs) in enumerate(shapes)]
    return spark.createDataFrame(rows, f"id int, geometry {GEOMETRY_TYPE}")


def box(x, y, w, h, extra=()):
    """A box whose sides may have more vertices than corners."""
    ring = [(x, y), *[(x + d, y) for d in extra if d < w], (x + w, y), (x + w, y + h), (x, y + h), (x, y)]
    return ring


def rings_of(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.run, r.place)):
        out.setdefault(r.run, []).append((r.lon, r.lat))
    return list(out.values())


def steps(ring):
    """The unit steps of an axis-parallel ring."""
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        n = int(abs(x1 - x0) + abs(y1 - y0))
        dx, dy = (x1 - x0) / n, (y1 - y0) / n
        yield from ((x0 + dx * i, y0 + dy * i, dx, dy) for i in range(n))


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


@pytest.mark.parametrize("seed", [1, 2])
def test_boxes_of_all_sizes(spark, seed):
    rng = random.Random(seed)
    free = {(x, y) for x in range(24) for y in range(24)}
    shapes, filled = [], set()
    for _ in range(150):
        x, y, w, h = rng.randrange(20), rng.randrange(20), rng.choice([1, 1, 2, 4]), rng.choice([1, 1, 3])
        cells = {(a, b) for a in range(x, x + w) for b in range(y, y + h)}
        if not cells <= free:
            continue
        free -= cells
        filled |= cells
        ring = box(x, y, w, h, [1] if rng.random() < 0.3 else ())
        shapes.append(("Polygon", [ring[::rng.choice([1, -1])]]))
    # two of the shapes once more, two as one shape, and one without geometry
    shapes += shapes[:2] + [(None, [])]
    shapes[4:6] = [("MultiPolygon", [shapes[4][1][0], shapes[5][1][0]])]
    rings = rings_of(features.geometry_union(table(spark, shapes)).collect())
    got = sorted(s for ring in rings for s in steps(ring))
    want = []
    for x, y in filled:
        want += [(x, y, 1, 0)] * ((x, y - 1) not in filled) + [(x + 1, y, 0, 1)] * ((x + 1, y) not in filled)
        want += [(x + 1, y + 1, -1, 0)] * ((x, y + 1) not in filled)
        want += [(x, y + 1, 0, -1)] * ((x - 1, y) not in filled)
    assert got == sorted(want)
    assert sum(map(area, rings)) == len(filled)


def test_holes_slopes_and_lines(spark):
    frame = ("Polygon", [box(0, 0, 9, 9), box(3, 3, 3, 3)])
    inner = ("Polygon", [[(4, 4), (5, 4), (4, 5), (4, 4)]])
    both = rings_of(features.geometry_union(table(spark, [frame, inner])).collect())
    assert sorted(map(area, both)) == [-9, 0.5, 81]
    filled = rings_of(features.geometry_union(table(spark, [frame, ("Polygon", [box(3, 3, 3, 3)])])).collect())
    assert list(map(area, filled)) == [81]
    touching = [("Polygon", [box(0, 0, 1, 1)]), ("Polygon", [box(1, 1, 1, 1)])]
    assert list(map(area, rings_of(features.geometry_union(table(spark, touching)).collect()))) == [1, 1]
    slopes = [("Polygon", [[(0, 0), (4, 0), (4, 4), (0, 0)]]), ("Polygon", [[(0, 0), (2, 2), (0, 4), (0, 0)]]),
              ("Polygon", [[(2, 2), (4, 4), (0, 4), (2, 2)]])]
    assert list(map(area, rings_of(features.geometry_union(table(spark, slopes)).collect()))) == [16]
    lines = [("LineString", [[(0, 0), (4, 4)]]), ("LineString", [[(3, 3), (1, 1), (1, 5)]]),
             ("MultiLineString", [[(0, 0), (1, 1)], [(7, 7), (8, 8)]])]
    parts = rings_of(features.geometry_union(table(spark, lines)).collect())
    assert sorted(map(tuple, parts)) == [((0, 0), (1, 1)), ((1, 1), (1, 5)), ((1, 1), (3, 3)),
                                         ((3, 3), (4, 4)), ((7, 7), (8, 8))]


@pytest.mark.parametrize("shapes", [
    [("Polygon", [box(0, 0, 4, 4)]), ("Polygon", [box(2, 2, 4, 4)])],
    [("Polygon", [box(0, 0, 9, 9)]), ("Polygon", [box(2, 2, 4, 4)])],
    [("Polygon", [box(0, 0, 4, 4)]), ("Polygon", [box(0, 0, 2, 2)])],
    [("Polygon", [box(0, 0, 4, 4)]), ("Polygon", [[(0, 0), (4, 0), (2, 1), (0, 0)]])],
    [("Polygon", [[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)]])],
    [("LineString", [[(0, 0), (4, 4)]]), ("LineString", [[(0, 4), (4, 0)]])],
    [("LineString", [[(0, 0), (4, 4)]]), ("Polygon", [box(0, 0, 4, 4)])],
    [("Point", [[(0, 0)]]), ("Polygon", [box(0, 0, 4, 4)])],
])
def test_what_is_not_built_fails(spark, shapes):
    with pytest.raises(Exception, match="not built"):
        features.geometry_union(table(spark, shapes)).collect()


def test_statistics_stay(spark):
    df = table(spark, [("Polygon", [box(0, 0, 2, 2)]), ("Polygon", [box(2, 0, 2, 2)])])
    rows = features.data_frame_aggregate(df, "id", aggregate_geometry=True).collect()
    assert {r.id_count for r in rows} == {2} and len(rows) == 6
    for none in (table(spark, [(None, []), (None, [])]), df.where("false")):
        rows = features.data_frame_aggregate(none, "id", aggregate_geometry=True).collect()
        assert [r.lon for r in rows] == [None] and rows[0].id_count == none.count()
    with pytest.raises(ValidationError):
        features.geometry_union(table(spark, [("Point", [[(0, 0)]]), ("LineString", [[(0, 0), (1, 1)]])]))
