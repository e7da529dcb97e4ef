"""Spellings accepted for names, times, regions and dictionaries."""

from __future__ import annotations

import ast
import datetime as dt
import fnmatch
import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from isograd import rings as checks
from isograd.model import ValidationError

Ring = tuple[tuple[float, float], ...]

# Accepted time formats, and how far an upper bound reaches for each of them.
TIME_FORMATS = (
    ("%Y-%m-%dT%H:%M:%S", dt.timedelta()),
    ("%Y-%m-%d %H:%M:%S", dt.timedelta()),
    ("%Y-%m-%d", dt.timedelta(hours=24, seconds=-1)),
    ("%Y-%m", dt.timedelta(weeks=4, seconds=-1)),
    ("%Y", dt.timedelta(days=365, seconds=-1)),
)


def names(value: str | Iterable[str] | None) -> list[str] | None:
    """``"a, b*"`` or a list of names; None and blank mean "not given"."""
    if value is None:
        return None
    items = value.split(",") if isinstance(value, str) else list(value)
    if not all(isinstance(i, str) for i in items):
        raise ValidationError(f"names expected, got {value!r}")
    found = [i.strip() for i in items if i.strip()]
    return found or None


def match(patterns: str | Iterable[str] | None, available: Iterable[str]) -> list[str]:
    """Available names that fit any wildcard pattern, in their own order; none given: all."""
    wanted = names(patterns)
    available = list(available)
    if wanted is None:
        return available
    return [n for n in available if any(fnmatch.fnmatchcase(n, p) for p in wanted)]


def time(value, upper: bool = False) -> dt.datetime | None:
    """A point in time; a bare date means noon; an upper bound covers its whole day, month, year."""
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if isinstance(value, dt.datetime):
        return value
    if isinstance(value, dt.date):
        return dt.datetime.combine(value, dt.time(12))
    if not isinstance(value, str):
        raise ValidationError(f"time expected, got {value!r}")
    for pattern, reach in TIME_FORMATS:
        try:
            start = dt.datetime.strptime(value.strip(), pattern)
        except ValueError:
            continue
        return start + reach if upper else start
    raise ValidationError(f'invalid date/time value: "{value}"')


def time_range(value) -> tuple[dt.datetime, dt.datetime] | None:
    """``"t1, t2"`` or a pair; a missing end equals the start."""
    if value is None or value == "":
        return None
    pair = [v.strip() for v in value.split(",")] if isinstance(value, str) else list(value)
    if len(pair) != 2:
        raise ValidationError(f"time range expected, got {value!r}")
    low, high = pair
    if not low and not high:
        return None
    start, end = time(low), time(high or low, upper=True)
    if start is None or start > end:
        raise ValidationError(f"invalid time range {value!r}")
    return start, end


def dictionary(value: str | Mapping | None) -> dict | None:
    """A dict or ``"k=v, k2=v2"`` whose values are literals; nothing is evaluated."""
    if value is None or isinstance(value, Mapping):
        return None if value is None else dict(value)
    if not isinstance(value, str):
        raise ValidationError(f"key=value pairs expected, got {value!r}")
    if not value.strip():
        return None
    try:
        call = ast.parse(f"dict({value})", mode="eval").body
        if call.args or any(k.arg is None for k in call.keywords):
            raise ValueError(value)
        return {k.arg: ast.literal_eval(k.value) for k in call.keywords}
    except (SyntaxError, ValueError) as error:
        raise ValidationError(f"key=value pairs expected, got {value!r}") from error


@dataclass(frozen=True)
class Shape:
    """A geometry literal: POINT, MULTIPOINT, LINESTRING, POLYGON or MULTIPOLYGON as coordinate runs.

    ``box`` keeps the four numbers of a region that was spelled as explicit coordinates. ``outer`` are the
    places of the exterior rings; the holes of each follow it.
    """

    kind: str
    rings: tuple[Ring, ...]
    box: tuple[float, float, float, float] | None = None
    outer: tuple[int, ...] = (0,)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        xs = [x for r in self.rings for x, _ in r]
        ys = [y for r in self.rings for _, y in r]
        return min(xs), min(ys), max(xs), max(ys)

    @property
    def is_area(self) -> bool:
        return self.kind in ("POLYGON", "MULTIPOLYGON")

    @property
    def exteriors(self) -> tuple[Ring, ...]:
        return tuple(self.rings[i] for i in self.outer)

    @property
    def area(self) -> float:
        """Square degrees without the holes."""
        sizes = [abs(signed_area(r)) for r in self.rings]
        return 2 * sum(sizes[i] for i in self.outer) - sum(sizes)

    @property
    def is_box(self) -> bool:
        """Whether the shape is exactly its bounding box."""
        if self.kind != "POLYGON" or len(self.rings) != 1:
            return False
        west, south, east, north = self.bounds
        corners = {(west, south), (east, south), (east, north), (west, north)}
        ring = self.rings[0]
        on_edge = all(x in (west, east) or y in (south, north) for x, y in ring)
        area = abs(signed_area(ring))
        return corners <= set(ring) and on_edge and abs(
            area - (east - west) * (north - south)) <= 1e-9 * max(area, 1.0)

    @property
    def wkt(self) -> str:
        def run(r: Ring) -> str:
            return "(" + ", ".join(f"{x:g} {y:g}" for x, y in r) + ")"
        if self.is_area:
            parts = ["(" + ", ".join(map(run, self.rings[i:j])) + ")"
                     for i, j in zip(self.outer, (*self.outer[1:], None))]
            return f"{self.kind} " + (parts[0] if self.kind == "POLYGON" else "(" + ", ".join(parts) + ")")
        return f"{self.kind} {run(self.rings[0])}"


def signed_area(ring: Ring) -> float:
    return checks.area(ring)


def _closed(run: Ring) -> Ring:
    return run if run[0] == run[-1] else (*run, run[0])


def _area(polygons: list[list[Ring]], box=None) -> Shape:
    """A POLYGON or, of several, a MULTIPOLYGON; its polygons are valid."""
    outer, rings = [], []
    for polygon in polygons:
        outer.append(len(rings))
        rings += polygon
    return Shape("POLYGON" if len(outer) == 1 else "MULTIPOLYGON", tuple(rings), box, tuple(outer))


def _healed(rings: Iterable[Ring]) -> list[list[Ring]]:
    """The polygon as it stands if it is valid, else the valid polygons that make its inside."""
    rings = [_closed(tuple(r)) for r in rings if r]
    if not rings or len(rings[0]) < 4:
        raise ValidationError("polygon is empty")
    apart = not checks.faults(rings) and checks.area(rings[0])
    if apart and len(rings) == 1:
        return [rings]
    try:
        found = checks.healed(rings)
    except ValueError as error:
        raise ValidationError("polygon is invalid") from error
    # holes that lie outside of the shell or in one another leave fewer rings
    if apart and [len(rings)] == [len(p) for p in found]:
        return [rings]
    if not found:
        raise ValidationError("polygon is empty")
    return found


def _union(polygons: list[list[Ring]]) -> Shape:
    """The polygons as they stand if they are apart, else the valid ones that cover the same places."""
    shape = _area(polygons)
    found = checks.healed(list(shape.rings), shape.outer)
    apart = not checks.faults(list(shape.rings)) and sum(map(len, found)) == len(shape.rings)
    return shape if apart else _area(found)


def _polygon(rings: Iterable[Ring], box=None) -> Shape:
    return _area(_healed(rings), box)


def _box(west: float, south: float, east: float, north: float) -> Shape:
    ring = ((east, south), (east, north), (west, north), (west, south))
    return _polygon([ring], (west, south, east, north))


_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def _run(text: str) -> Ring:
    """The points of ``x y, x y``; heights are not read."""
    pairs = [re.findall(_NUMBER, p) for p in text.split(",")]
    if any(len(p) < 2 for p in pairs):
        raise ValidationError(f"geometry expected, got {text!r}")
    return tuple((float(p[0]), float(p[1])) for p in pairs)


def _well_known(kind: str, body: str) -> Shape:
    """A geometry from the text between its outermost brackets."""
    if kind == "POLYGON":
        return _polygon(map(_run, re.findall(r"\(([^()]*)\)", body)))
    if kind == "MULTIPOLYGON":
        parts = re.findall(r"\((\s*\([^()]*\)(?:\s*,\s*\([^()]*\))*\s*)\)", body)
        if not parts:
            raise ValidationError("polygon is empty")
        return _union([p for part in parts for p in _healed(map(_run, re.findall(r"\(([^()]*)\)", part)))])
    if kind == "MULTIPOINT":
        body = re.sub(r"[()]", " ", body)
    return Shape(kind, (_run(body),))


def geometry(value) -> Shape | None:
    """``"lon,lat"``, ``"lon1,lat1,lon2,lat2"``, WKT, a tuple of numbers or a list of points.

    A polygon whose rings cross, touch or overlap is healed, and may become several; its outermost ring
    counts in the direction it has at its highest vertex.
    """
    if value is None or (isinstance(value, str) and not value.strip()):
        return None
    if isinstance(value, Shape):
        return value
    if isinstance(value, str):
        text = value.strip()
        wkt = re.fullmatch(r"(MULTIPOINT|MULTIPOLYGON|POINT|LINESTRING|POLYGON)\s*\((.*)\)", text, re.I | re.S)
        if wkt is None:
            try:
                return geometry(tuple(float(v) for v in text.split(",")))
            except ValueError as error:
                raise ValidationError(f"geometry expected, got {value!r}") from error
        return _well_known(wkt.group(1).upper(), wkt.group(2))
    items = list(value)
    if len(items) == 2 and all(isinstance(v, (int, float)) for v in items):
        return Shape("POINT", (((float(items[0]), float(items[1])),),))
    if len(items) == 4 and all(isinstance(v, (int, float)) for v in items):
        return _box(*map(float, items))
    if items and all(not isinstance(v, (int, float, str)) and len(v) == 2 for v in items):
        return _polygon([tuple((float(x), float(y)) for x, y in items)])
    raise ValidationError(f"geometry expected, got {value!r}")


def point(value) -> tuple[float, float] | None:
    shape = geometry(value)
    if shape is None:
        return None
    if shape.kind != "POINT":
        raise ValidationError(f"point expected, got {value!r}")
    return shape.rings[0][0]


def polygon(value) -> Shape | None:
    """A region; several polygons are one if they were given so, or if an invalid one falls apart."""
    shape = geometry(value)
    if shape is not None and not shape.is_area:
        raise ValidationError(f"polygon expected, got {value!r}")
    return shape
