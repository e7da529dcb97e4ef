"""How a line, polygon or multi-part feature lies to a literal geometry, as one expression.

The segments of either side are cut where they meet the other side, so that each piece lies in one class:
inside, on the border, or outside. The middle of a piece tells the class. Two areas share inner points if a
piece of one border is inside the other area, or if a piece lies on both borders with both areas on the same
side of it; every other test is made of such statements.

A place is compared only with the literal edges that meet the bounds of its feature. Where none does, the whole
feature lies on one side of the literal, and one vertex tells which.

The expression is spelled as SQL text: it has some thousand nodes, and a Column call for each would take
seconds.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F

from isograd.literals import Shape

#: Fixed value: distance up to which two points are almost equal.
ALMOST = 0.5e-6
#: Distance in degrees up to which the middle of a piece lies on a border.
NEAR = 1e-9
#: By so many degrees the bounds of a feature are widened before literal edges are looked for in them.
MARGIN = 1e-6

_numbers = count()
Statement = Callable[[], str]


def _higher(function: str, array: str, body: Callable[[str], str]) -> str:
    name = f"v{next(_numbers)}"
    return f"{function}({array}, {name} -> {body(name)})"


def _any(array: str, body: Callable[[str], str]) -> str:
    return _higher("exists", array, body)


def _let(value: str, body: Callable[[str], str]) -> str:
    """The body with the value computed once per row."""
    return f"{_higher('transform', f'array({value})', body)}[0]"


def _points(points) -> str:
    inner = ", ".join(f"named_struct('x', {x!r}D, 'y', {y!r}D)" for x, y in points)
    return f"CAST(array({inner}) AS array<struct<x:double,y:double>>)"


def _literal_segments(ends) -> str:
    """Segments between pairs of places, with the measures that every comparison needs and their bounds."""
    fields = ("x0", "y0", "x1", "y1", "dx", "dy", "length", "slack", "west", "south", "east", "north")

    def segment(a, b):
        dx, dy = b[0] - a[0], b[1] - a[1]
        length = dx * dx + dy * dy
        values = (*a, *b, dx, dy, length, NEAR * math.sqrt(length), min(a[0], b[0]), min(a[1], b[1]),
                  max(a[0], b[0]), max(a[1], b[1]))
        return "named_struct(" + ", ".join(f"'{f}', {v!r}D" for f, v in zip(fields, values)) + ")"

    return (f"CAST(array({', '.join(segment(a, b) for a, b in ends)}) AS "
            f"array<struct<{','.join(f'{f}:double' for f in fields)}>>)")


def _own_segments(coords: str) -> str:
    """All edges of the runs that have a length, with their measures; a run of one vertex has none."""
    def edges(run):
        each = _higher("transform", f"sequence(0, size({run}) - 2)", lambda i: (
            f"named_struct('x0', {run}[{i}].x, 'y0', {run}[{i}].y, "
            f"'x1', {run}[{i} + 1].x, 'y1', {run}[{i} + 1].y, 'dx', {run}[{i} + 1].x - {run}[{i}].x, "
            f"'dy', {run}[{i} + 1].y - {run}[{i}].y)"))
        long = _higher("filter", each, lambda e: f"{e}.x0 <> {e}.x1 OR {e}.y0 <> {e}.y1")
        return f"IF(size({run}) > 1, {long}, array())"

    def measured(e):
        length = f"({e}.dx * {e}.dx + {e}.dy * {e}.dy)"
        kept = ", ".join(f"'{f}', {e}.{f}" for f in ("x0", "y0", "x1", "y1", "dx", "dy"))
        return f"named_struct({kept}, 'length', {length}, 'slack', {NEAR!r}D * sqrt({length}))"

    return _higher("transform", f"flatten({_higher('transform', coords, edges)})", measured)


def _bounds(vertices: str) -> str:
    """The widened bounds of vertices, their middle and half sizes, and whether they have any extent."""
    sides = {"west": "least({a}.west, {v}.x)", "south": "least({a}.south, {v}.y)",
             "east": "greatest({a}.east, {v}.x)", "north": "greatest({a}.north, {v}.y)"}
    a, v = f"v{next(_numbers)}", f"v{next(_numbers)}"
    wider = ", ".join(f"'{side}', {value.format(a=a, v=v)}" for side, value in sides.items())
    none = f"CAST(NULL AS struct<{','.join(f'{side}:double' for side in sides)}>)"
    exact = f"aggregate({vertices}, {none}, ({a}, {v}) -> named_struct({wider}))"
    return _let(exact, lambda e: (
        f"named_struct('west', {e}.west - {MARGIN!r}D, 'south', {e}.south - {MARGIN!r}D, "
        f"'east', {e}.east + {MARGIN!r}D, 'north', {e}.north + {MARGIN!r}D, "
        f"'x', ({e}.west + {e}.east) / 2, 'y', ({e}.south + {e}.north) / 2, "
        f"'wide', ({e}.east - {e}.west) / 2 + {MARGIN!r}D, 'high', ({e}.north - {e}.south) / 2 + {MARGIN!r}D, "
        f"'extent', {e}.west < {e}.east OR {e}.south < {e}.north)"))


def _meets(e: str, box: str) -> str:
    """Whether a literal segment meets a box: their bounds do, and the box isn't on one side of its line."""
    return (f"({e}.west <= {box}.east AND {e}.east >= {box}.west AND {e}.south <= {box}.north "
            f"AND {e}.north >= {box}.south AND abs({e}.dx * ({box}.y - {e}.y0) - {e}.dy * ({box}.x - {e}.x0)) "
            f"<= {box}.wide * abs({e}.dy) + {box}.high * abs({e}.dx))")


def _within_box(points: str, box: str) -> str:
    return _higher("filter", points, lambda p: (
        f"{p}.x >= {box}.west AND {p}.x <= {box}.east AND {p}.y >= {box}.south AND {p}.y <= {box}.north"))


def _own_ends(coords: str) -> str:
    """The vertices that end an odd number of runs."""
    runs = _higher("filter", coords, lambda r: f"size({r}) > 1")
    ends = f"flatten({_higher('transform', runs, lambda r: f'array(element_at({r}, 1), element_at({r}, -1))')})"

    def odd(ps):
        def times(p):
            same = _higher("filter", ps, lambda q: f"{q}.x = {p}.x AND {q}.y = {p}.y")
            return f"size({same}) % 2 = 1"
        return _higher("filter", ps, times)

    return _let(ends, odd)


def _near(x: str, y: str, e: str) -> str:
    """Whether a point is within NEAR of a segment."""
    along = f"(({x} - {e}.x0) * {e}.dx + ({y} - {e}.y0) * {e}.dy)"
    return (f"(abs({e}.dx * ({y} - {e}.y0) - {e}.dy * ({x} - {e}.x0)) <= {e}.slack "
            f"AND {along} >= -{e}.slack AND {along} <= {e}.length + {e}.slack)")


def _on(x: str, y: str, segments: str) -> str:
    return _any(segments, lambda e: _near(x, y, e))


def _some_on(vertices: str, segments: str) -> str:
    return _any(vertices, lambda v: _on(f"{v}.x", f"{v}.y", segments))


def _odd(x: str, y: str, segments: str, flat: str = "false") -> str:
    """Whether an odd number of segments lies east of a point (north, if flat), those through it apart."""
    def passes(e):
        def over(a, b, c, d):  # a ray along c, d from where a, b are
            return (f"(({e}.{b}0 <= {d}) != ({e}.{b}1 <= {d}) AND {c} < {e}.{a}0 + ({d} - {e}.{b}0) * "
                    f"{e}.d{a} / nullif({e}.d{b}, 0D))")
        hit = f"IF({flat}, {over('y', 'x', y, x)}, {over('x', 'y', x, y)})"
        return f"coalesce({hit}, false) AND NOT {_near(x, y, e)}"

    return f"(size({_higher('filter', segments, passes)}) % 2 = 1)"


def _cuts(s: str, others: str) -> str:
    """Where a segment meets others, as shares of its length strictly between 0 and 1."""
    def of(e):
        across = f"nullif({s}.dx * {e}.dy - {s}.dy * {e}.dx, 0D)"
        t = f"(({e}.x0 - {s}.x0) * {e}.dy - ({e}.y0 - {s}.y0) * {e}.dx) / {across}"
        u = f"(({e}.x0 - {s}.x0) * {s}.dy - ({e}.y0 - {s}.y0) * {s}.dx) / {across}"

        def end(x, y):
            return (f"IF({_near(x, y, s)}, (({x} - {s}.x0) * {s}.dx + ({y} - {s}.y0) * {s}.dy) / {s}.length, "
                    f"NULL)")

        return (f"array(IF({u} BETWEEN 0D AND 1D, {t}, NULL), {end(f'{e}.x0', f'{e}.y0')}, "
                f"{end(f'{e}.x1', f'{e}.y1')})")

    return _higher("filter", f"flatten({_higher('transform', others, of)})", lambda t: f"{t} > 0 AND {t} < 1")


def _place(s: str, t: str) -> str:
    return (f"named_struct('x', {s}.x0 + {t} * {s}.dx, 'y', {s}.y0 + {t} * {s}.dy, "
            f"'flat', abs({s}.dy) < abs({s}.dx))")


def _middles(segments: str, others: str) -> str:
    """The middles of the pieces of segments between the places where they meet others."""
    def of(s):
        def pieces(ts):
            pairs = _higher("transform", f"sequence(0, size({ts}) - 2)",
                            lambda i: f"named_struct('a', {ts}[{i}], 'b', {ts}[{i} + 1])")
            long = _higher("filter", pairs, lambda p: f"{p}.b - {p}.a > 1e-9D")
            return _higher("transform", long, lambda p: _place(s, f"(({p}.a + {p}.b) / 2)"))

        return _let(f"array_sort(array_distinct(concat(array(0D, 1D), {_cuts(s, others)})))", pieces)

    return f"flatten({_higher('transform', segments, of)})"


def _classed(segments: str, area: str, close: str | None = None) -> str:
    """The pieces of segments with their class in an area: on its border, or inside if odd.

    ``close``: those edges of the area that the segments can meet.
    """
    close = close or area
    return _higher("transform", _middles(segments, close), lambda m: (
        f"named_struct('on', {_on(f'{m}.x', f'{m}.y', close)}, 'odd', {_odd(f'{m}.x', f'{m}.y', area)}, "
        f"'x', {m}.x, 'y', {m}.y, 'flat', {m}.flat)"))


def _inside(pieces: str) -> str:
    return _any(pieces, lambda p: f"NOT {p}.on AND {p}.odd")


def _outside(pieces: str) -> str:
    return _any(pieces, lambda p: f"NOT {p}.on AND NOT {p}.odd")


def _among(x: str, y: str, points: str) -> str:
    return _any(points, lambda p: f"hypot({p}.x - {x}, {p}.y - {y}) <= {NEAR!r}D")


def _named(name: str, tests: dict[str, Statement]) -> str:
    """A test from the statements of one kind of pair, only those needed.

    ``inner``: interiors meet; ``contact``: the shapes meet somewhere, given that interiors don't.
    """
    if name in ("intersects", "disjoint"):
        return f"{'NOT ' if name == 'disjoint' else ''}({tests['inner']()} OR {tests['contact']()})"
    if name == "touches":
        return f"(NOT ({tests['inner']()}) AND ({tests['contact']()}))"
    return f"({tests[name]()})" if name in tests else "false"


def _struct(names: Sequence[str], test: Callable[[str], str]) -> str:
    fields = (f"{name!r}, coalesce({test(name)}, false)" for name in names)
    return f"named_struct({', '.join(fields)})"


def _each(names: Sequence[str], tests: dict[str, Statement]) -> str:
    return _struct(names, lambda name: _named(name, tests))


def _area_and_area(names: Sequence[str], p: str, corners: str) -> str:
    if set(names) == {"crosses"}:
        return _struct(names, lambda name: "false")
    own, border = f"{p}.segments", f"{p}.border"

    def tests(pieces):
        def one_side(m):
            return (f"{_odd(f'{m}.x', f'{m}.y', own, f'{m}.flat')} = "
                    f"{_odd(f'{m}.x', f'{m}.y', border, f'{m}.flat')}")

        def shared(same):
            return _any(pieces, lambda m: f"{m}.on AND {'' if same else 'NOT'} ({one_side(m)})")

        others = _classed(f"{p}.close", own)

        def contact():
            on = _any(pieces, lambda m: f"{m}.on")
            return f"{on} OR {_some_on(f'{p}.vertices', f'{p}.close')} OR {_some_on(corners, own)}"

        return _each(names, {
            "inner": lambda: f"{_inside(pieces)} OR {shared(True)} OR {_inside(others)}", "contact": contact,
            "within": lambda: f"NOT {_outside(pieces)} AND NOT {shared(False)} AND NOT {_inside(others)}",
            "contains": lambda: f"{_all_close(p)} AND NOT {_inside(pieces)} AND NOT {shared(False)} "
                                f"AND NOT {_outside(others)}"})

    return _let(_classed(own, border, f"{p}.close"), tests)


def _all_close(p: str) -> str:
    """Whether no edge of the literal is outside of the feature's bounds, as must be if the feature holds it."""
    return f"(size({p}.close) = size({p}.border))"


def _line_in_area(names: Sequence[str], p: str, corners: str) -> str:
    """A feature's line and literal polygons."""
    own, close = f"{p}.segments", f"{p}.close"

    def tests(pieces):
        on = _any(pieces, lambda m: f"{m}.on")
        return _each(names, {
            "inner": lambda: _inside(pieces),
            "contact": lambda: f"{on} OR {_some_on(f'{p}.vertices', close)} OR {_some_on(corners, own)}",
            "within": lambda: f"{_inside(pieces)} AND NOT {_outside(pieces)}",
            "crosses": lambda: f"{_inside(pieces)} AND {_outside(pieces)}"})

    return _let(_classed(own, f"{p}.border", close), tests)


def _area_and_line(names: Sequence[str], p: str, corners: str) -> str:
    """A feature's polygons and a literal line."""
    own, close = f"{p}.segments", f"{p}.close"

    def tests(pieces):
        on = _any(pieces, lambda m: f"{m}.on")
        return _each(names, {
            "inner": lambda: _inside(pieces),
            "contact": lambda: f"{on} OR {_some_on(corners, own)} OR {_some_on(f'{p}.vertices', close)}",
            "contains": lambda: f"{_all_close(p)} AND {_inside(pieces)} AND NOT {_outside(pieces)}",
            "crosses": lambda: f"{_inside(pieces)} AND (NOT {_all_close(p)} OR {_outside(pieces)})"})

    return _let(_classed(close, own), tests)


def _line_and_line(names: Sequence[str], p: str) -> str:
    a, b, a_ends, b_ends = f"{p}.segments", f"{p}.close", f"{p}.ends", f"{p}.stops"

    def tests(pieces):
        def overlap():
            return _any(pieces, lambda m: _on(f"{m}.x", f"{m}.y", b))

        def contacts():
            here = _higher("filter", f"{p}.vertices", lambda v: _on(f"{v}.x", f"{v}.y", b))
            return f"concat({met}, {here})"

        def between():
            return _any(contacts(), lambda c: f"NOT {_among(f'{c}.x', f'{c}.y', a_ends)} "
                                              f"AND NOT {_among(f'{c}.x', f'{c}.y', b_ends)}")

        def covered(middles, line):
            return _higher("forall", middles, lambda m: _on(f"{m}.x", f"{m}.y", line))

        return _each(names, {
            "inner": lambda: f"{overlap()} OR {between()}", "contact": lambda: f"size({contacts()}) > 0",
            "crosses": lambda: f"NOT {overlap()} AND {between()}",
            "within": lambda: covered(pieces, b),
            "contains": lambda: f"{_all_close(p)} AND {covered(_middles(b, a), a)}"})

    def places(s):
        return _higher("transform", _cuts(s, b), lambda t: (
            f"named_struct('x', {_place(s, t)}.x, 'y', {_place(s, t)}.y)"))

    met = f"flatten({_higher('transform', a, places)})"
    return _let(_middles(a, b), tests)


def _points_and(name: str, vertices: str, inside: Callable[[str], str], on: Callable[[str], str]) -> str:
    """A MultiPoint against a geometry, given by the interior and border tests of a point."""
    def tests(found):
        some_in = _any(found, lambda c: f"{c}.inner")
        some_out = _any(found, lambda c: f"NOT {c}.inner AND NOT {c}.on")
        return _named(name, {
            "inner": lambda: some_in, "contact": lambda: _any(found, lambda c: f"{c}.on"),
            "within": lambda: f"{some_in} AND NOT {some_out}", "crosses": lambda: f"{some_in} AND {some_out}"})

    return _let(_higher("transform", vertices, lambda v: (
        f"named_struct('inner', {inside(v)}, 'on', {on(v)})")), tests)


def _against_point(name: str, p: str, x: float, y: float) -> tuple[str, str, str]:
    at = f"{x!r}D", f"{y!r}D"

    def is_at(v):
        return f"({v}.x = {at[0]} AND {v}.y = {at[1]})"

    def area(c):
        inner = f"NOT {c}.on AND {c}.odd"
        return _named(name, {"inner": lambda: inner, "contact": lambda: f"{c}.on", "contains": lambda: inner})

    def line(c):
        inner = f"{c}.on AND NOT {c}.ends"
        return _named(name, {"inner": lambda: inner, "contact": lambda: f"{c}.on", "contains": lambda: inner})

    if name == "contains":
        many = _any(f"{p}.vertices", is_at)
    else:
        many = "false" if name == "crosses" else _points_and(name, f"{p}.vertices", is_at, lambda v: "false")
    here = _on(*at, f"{p}.segments")
    return (_let(f"named_struct('on', {here}, 'odd', {_odd(*at, f'{p}.segments')})", area),
            _let(f"named_struct('on', {here}, 'ends', {_among(*at, f'{p}.ends')})", line), many)


def _against_points(name: str, p: str) -> tuple[str, str, str]:
    """A feature against the literal's points: their places in it tell, read the other way round."""
    own, ends = f"{p}.segments", f"{p}.ends"

    def turned(inside, on):
        if name == "within":
            return "false"
        return _points_and("within" if name == "contains" else name, f"{p}.corners", inside, on)

    def near(c):
        return _on(f"{c}.x", f"{c}.y", own)

    def end(c):
        return _among(f"{c}.x", f"{c}.y", ends)

    def equal(points):
        return lambda v: _any(points, lambda q: f"{q}.x = {v}.x AND {q}.y = {v}.y")

    if name == "contains":
        many = _higher("forall", f"{p}.corners", equal(f"{p}.vertices"))
    elif name == "crosses":
        many = "false"
    else:
        many = _points_and(name, f"{p}.vertices", equal(f"{p}.corners"), lambda v: "false")
    return (turned(lambda c: f"(NOT {near(c)} AND {_odd(f'{c}.x', f'{c}.y', own)})", near),
            turned(lambda c: f"({near(c)} AND NOT {end(c)})", end), many)


def relations(names: Sequence[str], shape: Column, literal: Shape) -> Column:
    """Geometric tests of a geometry column's shapes against literal points, a line, or polygons, as one struct.

    The tests share bounds, edges and pieces. A shape without vertices: False. Places within 1e-9 degrees of a
    border lie on it.
    """
    compares = [name for name in names if name != "almost_equals"]
    runs = [[(float(x), float(y)) for x, y in run] for run in literal.rings]
    listed = [p for run in runs for p in run]
    many_points = literal.kind in ("POINT", "MULTIPOINT")
    edges = [(p, p) for p in listed] if many_points else [
        (a, b) for run in runs for a, b in zip(run, run[1:]) if a != b]
    open_line = literal.kind == "LINESTRING" and runs[0][0] != runs[0][-1]
    border = _literal_segments(edges)
    kinds = {"POINT": "'Point', 'MultiPoint'", "LINESTRING": "'LineString', 'MultiLineString'",
             "POLYGON": "'Polygon', 'MultiPolygon'"}

    def apart(v):
        """The tests of a feature whose bounds no edge of the literal meets, from one of its vertices."""
        if not literal.is_area:
            return _struct(compares, lambda name: str(name == "disjoint").lower())
        sides = {"intersects": "{}", "within": "{}", "disjoint": "NOT {}"}
        if not sides.keys() & set(compares):
            return _struct(compares, lambda name: "false")
        return _let(v, lambda first: _let(_odd(f"{first}.x", f"{first}.y", border), lambda inside: (
            _struct(compares, lambda name: sides.get(name, "false").format(inside)))))

    def compared(box, close):
        ends = "" if literal.is_area else f", 'ends', {_own_ends('g.coords')}"
        parts = (f"named_struct('vertices', flatten(g.coords), 'segments', {_own_segments('g.coords')}, "
                 f"'border', {border}, 'close', {close}, 'corners', {_points(listed)}, "
                 f"'stops', {_points([runs[0][0], runs[0][-1]] if open_line else [])}{ends})")

        def test(p):
            near, vertices, stops = f"{p}.close", f"{p}.vertices", f"{p}.stops"
            corners = _within_box(f"{p}.corners", box)
            if many_points:
                found = {name: _against_point(name, p, *listed[0]) if literal.kind == "POINT"
                         else _against_points(name, p) for name in compares}
                area, line, many = (_struct(compares, lambda name, i=i: found[name][i]) for i in range(3))
            elif literal.kind == "LINESTRING":
                area, line = _area_and_line(compares, p, corners), _line_and_line(compares, p)
                many = _struct(compares, lambda name: _points_and(name, vertices, lambda v: (
                    f"{_on(f'{v}.x', f'{v}.y', near)} AND NOT {_among(f'{v}.x', f'{v}.y', stops)}"),
                    lambda v: _among(f"{v}.x", f"{v}.y", stops)))
            else:
                area, line = _area_and_area(compares, p, corners), _line_in_area(compares, p, corners)
                many = _struct(compares, lambda name: _points_and(name, vertices, lambda v: (
                    f"NOT {_on(f'{v}.x', f'{v}.y', near)} AND {_odd(f'{v}.x', f'{v}.y', border)}"),
                    lambda v: _on(f"{v}.x", f"{v}.y", near)))
            return (f"CASE WHEN g.type IN ({kinds['POLYGON']}) THEN {area} "
                    f"WHEN g.type IN ({kinds['LINESTRING']}) THEN {line} "
                    f"WHEN g.type IN ({kinds['POINT']}) THEN {many} END")

        return _let(parts, test)

    def placed(box):
        def near(close):
            return (f"IF(size({close}) = 0 AND {box}.extent AND g.type IN ({', '.join(kinds.values())}), "
                    f"{apart('flatten(g.coords)[0]')}, {compared(box, close)})")

        return (f"CASE WHEN {box}.west IS NULL THEN {_struct(compares, lambda name: 'false')} ELSE "
                f"{_let(_higher('filter', border, lambda e: _meets(e, box)), near)} END")

    def equal(vertices):
        close = _higher("forall", f"sequence(0, {len(listed) - 1})", lambda i: (
            f"hypot({vertices}[{i}].x - {_points(listed)}[{i}].x, "
            f"{vertices}[{i}].y - {_points(listed)}[{i}].y) <= {ALMOST!r}D"))
        return (f"IF(g.type IN ({kinds[literal.kind.removeprefix('MULTI')]}) "
                f"AND size({vertices}) = {len(listed)}, {close}, false)")

    same = _let("flatten(g.coords)", equal)
    if compares:
        test = _let(_bounds("flatten(g.coords)"), placed)
        if len(compares) < len(names):
            test = _let(test, lambda found: _struct(names, lambda name: (
                f"{found}.{name}" if name in compares else same)))
    else:
        test = _struct(names, lambda name: same)
    found = F.call_function("transform", F.array(shape), F.expr(f"g -> {test}"))
    return F.coalesce(F.get(found, F.lit(0)), F.struct(*(F.lit(False).alias(name) for name in names)))
