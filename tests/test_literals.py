import datetime as dt
import math
import random
import time

import pytest

from isograd import ValidationError, literals, rings


def test_names_and_patterns():
    assert literals.names(" a, b* ,") == ["a", "b*"]
    assert literals.names("") is None
    assert literals.match("a*, c", ["ab", "b", "c"]) == ["ab", "c"]
    assert literals.match(None, ["x", "y"]) == ["x", "y"]


def test_time():
    assert literals.time("2001-02-03") == dt.datetime(2001, 2, 3)
    assert literals.time(dt.date(2001, 2, 3)) == dt.datetime(2001, 2, 3, 12)
    assert literals.time("2001-02-03T04:05:06") == dt.datetime(2001, 2, 3, 4, 5, 6)
    with pytest.raises(ValidationError):
        literals.time("yesterday")


def test_time_range_upper_bounds():
    assert literals.time_range("2001-01-01, 2001-01-02") == (
        dt.datetime(2001, 1, 1), dt.datetime(2001, 1, 2, 23, 59, 59))
    assert literals.time_range(("2001-01", "2001-02"))[1] == dt.datetime(2001, 2, 28, 23, 59, 59)
    assert literals.time_range("2001, 2002")[1] == dt.datetime(2002, 12, 31, 23, 59, 59)
    assert literals.time_range(("2001-01-05", None)) == (
        dt.datetime(2001, 1, 5), dt.datetime(2001, 1, 5, 23, 59, 59))
    assert literals.time_range("") is None
    with pytest.raises(ValidationError):
        literals.time_range("2002-01-01, 2001-01-01")


def test_dictionary_takes_literals_only():
    assert literals.dictionary("a=1, b='x', c=[1, 2]") == {"a": 1, "b": "x", "c": [1, 2]}
    assert literals.dictionary({"a": 1}) == {"a": 1}
    assert literals.dictionary("") is None
    with pytest.raises(ValidationError):
        literals.dictionary("a=__import__('os')")


def test_geometries():
    assert literals.point("10, 20.5") == (10.0, 20.5)
    assert literals.point("POINT (10 20.5)") == (10.0, 20.5)
    box = literals.polygon("-10, 0, 20, 30")
    assert box.bounds == (-10, 0, 20, 30) and box.is_box and box.box == (-10, 0, 20, 30)
    ring = literals.polygon([(0, 0), (10, 0), (5, 8)])
    assert ring.rings[0][0] == ring.rings[0][-1] and not ring.is_box
    holed = literals.polygon("POLYGON ((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 3 2, 3 3, 2 2))")
    assert len(holed.rings) == 2
    assert literals.polygon(None) is None
    for bad in ("1,2,3", "POLYGON ((0 0, 1 1, 2 2, 0 0))", "CIRCLE (1 2)"):
        with pytest.raises(ValidationError):
            literals.polygon(bad)


def winding(ring, x, y):
    """How often a ring runs around a point."""
    turns = 0
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if (y0 <= y) != (y1 <= y) and x0 + (y - y0) * (x1 - x0) / (y1 - y0) > x:
            turns += 1 if y1 > y0 else -1
    return turns


def covers(shape, x, y):
    return sum(abs(winding(r, x, y)) for r in shape.rings) % 2 == 1


@pytest.mark.parametrize("whole", [True, False])
def test_healing_against_winding_numbers(whole):
    """Random rings that cross, overlap and run back; on whole numbers many edges share places."""
    rng = random.Random(4)

    def place():
        return (float(rng.randint(0, 5)), float(rng.randint(0, 5))) if whole else (rng.random() * 5,
                                                                                 rng.random() * 5)

    for _ in range(150):
        ring = [place() for _ in range(rng.randint(4, 9))]
        ring.append(ring[0])
        hole = [place() for _ in range(4)]
        hole.append(hole[0])
        if min(len(set(ring)), len(set(hole))) < 3:
            continue
        given = [tuple(ring), tuple(hole)]
        sense = [1 if rings._left_turning(r) == (i == 0) else -1 for i, r in enumerate(given)]
        found = rings.healed(given)
        for polygon in found:
            assert rings.area(polygon[0]) > 0 and not rings.faults([polygon[0]])
            assert all(rings.area(hole) < 0 for hole in polygon[1:])
        shape = literals._area(found) if found else None
        for _ in range(40):
            x, y = rng.random() * 5, rng.random() * 5
            inside = sum(s * winding(r, x, y) for s, r in zip(sense, given)) > 0
            assert inside == (shape is not None and covers(shape, x, y)), (given, x, y)


def test_invalid_regions():
    tie = literals.polygon([(0, 0), (0, 2), (2, 0), (2, 2)])
    assert tie.kind == "POLYGON" and tie.bounds == (0, 0, 1, 2) and tie.area == 1
    pair = literals.polygon("POLYGON ((0 0, 0 2, 1 1, 2 2, 2 0, 1 1, 0 0))")
    assert pair.kind == "MULTIPOLYGON" and pair.area == 2 and len(pair.exteriors) == 2
    spike = literals.polygon([(0, 0), (4, 0), (4, 4), (4, 9), (4, 4), (0, 4)])
    assert spike.is_box and spike.bounds == (0, 0, 4, 4)
    hole_outside = literals.polygon("POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0), (5 5, 6 5, 6 6, 5 6, 5 5))")
    assert hole_outside.area == 4 and len(hole_outside.rings) == 1
    for empty in ("POLYGON ((0 0, 4 0, 0 0, 4 0))", "MULTIPOLYGON()", "MULTIPOINT()"):
        with pytest.raises(ValidationError):
            literals.geometry(empty)


def test_multi_part_literals():
    apart = "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 9, 0 0), (2 2, 2 3, 3 3, 2 2)), ((20 0, 21 0, 21 1, 20 0)))"
    shape = literals.polygon(apart)
    assert shape.kind == "MULTIPOLYGON" and shape.outer == (0, 2) and shape.area == 81 - 0.5 + 0.5
    assert literals.geometry(shape.wkt) == shape
    # polygons that overlap or lie in one another are one
    assert literals.polygon("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((2 0, 6 0, 6 4, 2 4, 2 0)))").area == 24
    assert literals.polygon("MULTIPOLYGON (((0 0, 4 0, 4 4, 0 4, 0 0)), ((1 1, 2 1, 2 2, 1 1)))").area == 16
    for text in ("MULTIPOINT (1 2, 3 4)", "MULTIPOINT ((1 2), (3 4))"):
        assert literals.geometry(text).rings == (((1, 2), (3, 4)),)
    with pytest.raises(ValidationError):
        literals.polygon("MULTIPOINT (1 2, 3 4)")


def test_long_rings_are_checked_fast():
    n = 100_000
    ring = [(60 * math.cos(t) * (1 + 0.2 * math.sin(31 * t)), 60 * math.sin(t) * (1 + 0.2 * math.sin(31 * t)))
            for t in (2 * math.pi * k / n for k in range(n))]
    start = time.perf_counter()
    assert rings.faults([(*ring, ring[0])]) == 0
    ring[500], ring[70_000] = ring[70_000], ring[500]
    assert rings.faults([(*ring, ring[0])]) > 0
    assert time.perf_counter() - start < 5
