"""Coordinate axes: sizes, steps, nearest labels and positions.

The labels of axes up to ``KEPT_LABELS`` long reach the driver, and of longer ones a row per range.
Longer axes stay DataFrames, broadcast only when their counted size is within ``BROADCAST_ROWS``.
"""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isograd.model import NUMERIC, TEMPORAL, Cube, ValidationError, literal
from isograd.session import checkpoint

#: Largest counted number of rows, of up to 16 columns, of a table that is sent to every executor.
BROADCAST_ROWS = 1_000_000

#: Longest axis whose labels are kept on the driver, where they become literals of later plans.
KEPT_LABELS = 4096

LON_NAMES = ("lon", "longitude", "long")
LAT_NAMES = ("lat", "latitude")
EPOCH = dt.datetime(1970, 1, 1)


def hint_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a table whose row count is known to be small; leave it to the planner otherwise."""
    return F.broadcast(df) if rows * max(1, len(df.columns) / 16) <= BROADCAST_ROWS else df


@dataclass(frozen=True)
class AxisInfo:
    """What one scan says about an axis; ``first`` … ``last`` are numbers or datetimes."""

    name: str
    size: int
    first: object
    second: object
    last: object
    min_step: float | None
    max_step: float | None
    temporal: bool
    labels: tuple | None = None

    @classmethod
    def of(cls, name: str, labels: Iterable, temporal: bool) -> AxisInfo:
        """The facts of an axis whose labels are at hand, in order."""
        labels = tuple(labels)
        unit = dt.timedelta(microseconds=1)
        steps = [(b - a) / unit if temporal else b - a for a, b in zip(labels, labels[1:])]
        return cls(name, len(labels), labels[0] if labels else None,
                   labels[1] if len(labels) > 1 else None, labels[-1] if labels else None,
                   min(steps, default=None), max(steps, default=None), temporal, labels)

    @property
    def step(self) -> float | None:
        """Distance of the first two labels (microseconds for times)."""
        if self.second is None:
            return None
        if self.temporal:
            return (self.second - self.first) / dt.timedelta(microseconds=1)
        return abs(self.second - self.first)

    def between(self, low: float, high: float) -> AxisInfo | None:
        """The axis cut to [low, high], or None when only labels that are not at hand can tell.

        That is the case on long irregular axes, and when an end falls next to a label.
        """
        if self.labels is not None:
            return AxisInfo.of(self.name, (v for v in self.labels if low <= v <= high),
                               self.temporal)
        if self.temporal or self.size < 2 or not self.equidistant(1e-6):
            return None
        step = (self.last - self.first) / (self.size - 1)
        ends = ((low - self.first) / step, (high - self.first) / step)
        if any(abs(e - round(e)) < 1e-6 for e in ends):
            return None
        start, stop = max(math.ceil(ends[0]), 0), min(math.floor(ends[1]), self.size - 1)
        size = stop - start + 1
        if size < 2:
            return None
        first = self.first + start * step
        return AxisInfo(self.name, size, first, first + step, self.first + stop * step,
                        self.min_step, self.max_step, False)

    def agrees(self, other: AxisInfo, rel: float = 1e-6) -> bool | None:
        """Whether two axes have the same labels, None when only the labels themselves can tell.

        Numbers agree within a fraction of the step: the facts of a cut axis may be computed.
        """
        if self.size != other.size or self.temporal != other.temporal:
            return False
        if self.size == 0:
            return True

        def close(a, b) -> bool:
            if self.temporal:
                return a == b
            return abs(a - b) <= rel * (self.step or max(1.0, abs(a)))

        if not (close(self.first, other.first) and close(self.last, other.last)):
            return False
        if self.labels is not None and other.labels is not None:
            return all(map(close, self.labels, other.labels))
        if self.size <= 2 or (not self.temporal and self.equidistant(rel)
                              and other.equidistant(rel)):
            return True
        return None

    def equidistant(self, rel: float = 1e-3) -> bool:
        if self.step is None:
            return False
        return all(abs(s - self.step) <= rel * max(abs(s), self.step)
                   for s in (self.min_step, self.max_step))


def _labels(cube: Cube, dims: Iterable[str]) -> DataFrame:
    """(dim, label, text): distinct labels first, each from its own column, then made alike."""
    frames = []
    for dim in dims:
        kind, label = cube.dim_type(dim), F.col(dim)
        if isinstance(kind, TEMPORAL):
            number = F.unix_micros(label.cast("timestamp")).cast("double")
        elif isinstance(kind, NUMERIC):
            number = label.cast("double")
        else:
            number = F.lit(None).cast("double")
        frames.append(cube.axis(dim).select(
            F.lit(dim).alias("dim"), number.alias("label"),
            F.when(number.isNull(), label.cast("string")).alias("text")))
    return reduce(DataFrame.unionByName, frames)


def axis_info(cube: Cube, *dims: str) -> dict[str, AxisInfo]:
    """Facts of the given axes, found once per cube in one job; one row per dim is collected."""
    for dim in dims:
        cube.dim_type(dim)
    missing = [d for d in dims if d not in cube.known]
    if missing:
        cube.known.update(_scan_axes(cube, missing))
    return {d: cube.known[d] for d in dims}


def _scan_axes(cube: Cube, dims: list[str]) -> dict[str, AxisInfo]:
    """Facts of axes: the driver gets the labels of short ones, and a row per range of long ones."""
    heads = [_labels(cube, [d]).orderBy("label", "text").limit(KEPT_LABELS + 1) for d in dims]
    labels: dict[str, list] = {d: [] for d in dims}
    for row in reduce(DataFrame.unionByName, heads).collect():
        labels[row.dim].append(row.label)
    found = {}
    for dim in dims:
        temporal = isinstance(cube.dim_type(dim), TEMPORAL)
        shown = partial(_label, temporal=temporal)
        if not labels[dim]:
            found[dim] = AxisInfo("", 0, None, None, None, None, None, False)
        elif len(labels[dim]) > KEPT_LABELS:
            found[dim] = _scan_long(cube, dim, shown)
        elif None in labels[dim]:
            found[dim] = AxisInfo(dim, len(labels[dim]), None, None, None, None, None, temporal)
        else:
            found[dim] = AxisInfo.of(dim, map(shown, sorted(labels[dim])), temporal)
    return found


def _label(value, temporal: bool):
    return EPOCH + dt.timedelta(microseconds=int(value)) if temporal and value is not None else value


def _in_ranges(labels: DataFrame, column: str) -> DataFrame:
    """The labels dealt to ranges in order, with the number of the range (``__part``)."""
    n = int(labels.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return labels.repartitionByRange(n, column).withColumn("__part", F.spark_partition_id())


def _scan_long(cube: Cube, dim: str, shown) -> AxisInfo:
    """Facts of a long axis from its ranges: steps inside them, and from one to the next."""
    inside = Window.partitionBy("__part").orderBy("label")
    rows = _in_ranges(_labels(cube, [dim]), "label").withColumn(
        "next", F.lead("label").over(inside)).withColumn("pos", F.row_number().over(inside))
    step = F.col("next") - F.col("label")
    parts = rows.groupBy("__part").agg(
        F.count(F.lit(1)).alias("size"), F.min("label").alias("first"), F.max("label").alias("last"),
        F.max(F.when(F.col("pos") == 1, F.col("next"))).alias("second"),
        F.min(step).alias("min_step"), F.max(step).alias("max_step")).orderBy("__part").collect()
    size = sum(r.size for r in parts)
    temporal = isinstance(cube.dim_type(dim), TEMPORAL)
    parts = [r for r in parts if r.first is not None]
    if not parts:
        return AxisInfo(dim, size, None, None, None, None, None, temporal)
    steps = [s for r in parts for s in (r.min_step, r.max_step) if s is not None]
    steps += [b.first - a.last for a, b in zip(parts, parts[1:])]
    second = parts[0].second if parts[0].second is not None else parts[1].first
    return AxisInfo(dim, size, shown(parts[0].first), shown(second), shown(parts[-1].last), min(steps),
                    max(steps), temporal)


def find_dim(cube: Cube, names: Iterable[str]) -> str | None:
    return next((n for n in names if n in cube.dims), None)


def lon_dim(cube: Cube) -> str | None:
    """Name of the longitude dimension, if any."""
    return find_dim(cube, LON_NAMES)


def lat_dim(cube: Cube) -> str | None:
    """Name of the latitude dimension, if any."""
    return find_dim(cube, LAT_NAMES)


def nearest_label(cube: Cube, wanted: Mapping[str, object], method: str = "nearest") -> dict:
    """The axis label for each wanted value: ``nearest`` (ties to the larger), ``ffill``, ``bfill``.

    The labels become literals in the caller's filters, so that they reach the scan.
    """
    if method not in ("nearest", "ffill", "bfill"):
        raise ValidationError(f"unknown selection method '{method}'")
    picks, found = [], {}
    for dim, value in wanted.items():
        info = cube.known.get(dim)
        if info is not None and info.labels is not None:
            found[dim] = _pick(info.labels, value, method)
            continue
        label, target = F.col(dim), literal(value)
        if isinstance(cube.dim_type(dim), TEMPORAL):
            away = F.abs(F.unix_micros(label.cast("timestamp"))
                         - F.unix_micros(target.cast("timestamp")))
            rank = F.unix_micros(label.cast("timestamp"))
        elif isinstance(cube.dim_type(dim), NUMERIC):
            away, rank = F.abs(label - target), label
        else:
            away, rank = (label != target).cast("int"), F.lit(0)
        if method == "nearest":
            pick = F.min_by(label, F.struct(away, -rank))
        elif method == "ffill":
            pick = F.max(F.when(label <= target, label))
        else:
            pick = F.min(F.when(label >= target, label))
        picks.append((dim, pick.alias(dim)))
    by_source: dict[int, list] = {}
    sources = {}
    for dim, pick in picks:
        source = cube.axes.get(dim)
        if source is None:
            source = next(p.df for p in cube.parts if dim in p.dims)
        by_source.setdefault(id(source), []).append(pick)
        sources[id(source)] = source
    for key, columns in by_source.items():
        found.update(sources[key].agg(*columns).first().asDict())
    lost = [d for d, v in found.items() if v is None]
    if lost:
        raise ValidationError(f"no label found on axis {', '.join(lost)}")
    return found


def _pick(labels: tuple, value, method: str):
    if method == "nearest":
        return min(reversed(labels), key=lambda v: abs(v - value), default=None)
    if method == "ffill":
        return max((v for v in labels if v <= value), default=None)
    return min((v for v in labels if v >= value), default=None)


def label_at(cube: Cube, dim: str, position: int):
    """The label at a 0-based axis position, or None past the end."""
    info = cube.known.get(dim)
    if info is not None and info.labels is not None:
        return info.labels[position] if position < info.size else None
    row = positions(cube, dim, "__at").where(F.col("__at") == position).first()
    return row[dim] if row else None


def positions(cube: Cube, dim: str, name: str) -> DataFrame:
    """(label, 0-based position) of one axis; labels at hand need no further scan.

    Otherwise the labels are dealt to ranges, written once, numbered inside each range and moved on by
    the sizes of the ranges before.
    """
    info = cube.known.get(dim)
    if info is not None and info.labels is not None:
        kind = cube.dim_type(dim).simpleString()
        labels = constant_labels(info, kind)
        # one row that a single task unfolds: the labels are constants of the plan
        return cube.parts[0].df.sparkSession.range(0, 1, 1, 1).select(
            F.posexplode(labels).alias("__pos", dim)).select(
            dim, F.col("__pos").cast("bigint").alias(name))
    ranged = checkpoint(_in_ranges(cube.axis(dim), dim))
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    before = [0]
    for part in range(max(sizes, default=0)):
        before.append(before[-1] + sizes.get(part, 0))
    earlier = F.expr(f"array({', '.join(f'{n}L' for n in before)})")  # a number per range
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(dim)) - 1
    return ranged.select(dim, "__part", inside.alias("__in")).select(
        dim, (F.get(earlier, F.col("__part")) + F.col("__in")).cast("bigint").alias(name))


def constant_labels(info: AxisInfo, kind: str) -> Column:
    """The labels as a constant array, spelled as text to spare a call per label."""
    texts = (f"TIMESTAMP_NTZ'{v.isoformat(sep=' ')}'" if info.temporal else f"{float(v)!r}D"
             for v in info.labels)
    return F.expr(f"array({', '.join(texts)})").cast(f"array<{kind}>")


def label_of(info: AxisInfo, position: Column) -> Column | None:
    """The label at a position as a constant lookup, when the labels are at hand."""
    if info.labels is None or info.temporal:
        return None
    labels = constant_labels(info, "double")
    return F.element_at(labels, (position + 1).cast("int"))


def with_position(df: DataFrame, cube: Cube, info: AxisInfo, name: str) -> DataFrame:
    """Add the 0-based axis position of each row's label.

    On a regular numeric axis it is plain arithmetic; an irregular axis is looked up.
    """
    dim = info.name
    if not info.temporal and info.first is not None:
        if info.size == 1:
            return df.withColumn(name, F.lit(0).cast("bigint"))
        if info.equidistant(1e-6):
            step = (info.last - info.first) / (info.size - 1)
            return df.withColumn(
                name, F.round((F.col(dim) - F.lit(info.first)) / F.lit(step)).cast("bigint"))
    return df.join(hint_small(positions(cube, dim, name), info.size), dim)
