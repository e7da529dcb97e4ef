"""Cell arithmetic, differences, computed columns and merging."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import replace
from functools import reduce
from math import prod

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd.functions.quantile import quantiles
from isograd.model import Cube, Part, ValidationError, null_if_nan
from isograd.operators.axis import AxisInfo, axis_info, hint_small, with_position

UNARY = {"log": F.ln, "log10": F.log10, "log2": F.log2, "log1p": F.log1p, "exp": F.exp}


def ds_arithmetics(cube: Cube, op: str) -> Cube:
    """Apply a comma list such as ``"log, +5, /3"`` from left to right to every variable.

    Results outside the reals (the log of 0, a division by 0) are missing values.
    """
    steps = [_step(item.strip()) for item in op.split(",")]

    def apply(part: Part) -> Part:
        return part.select({v: reduce(lambda value, step: step(value), steps, F.col(v))
                            for v in part.variables})

    return cube.map(apply, keep=cube.dims).stamped("ds_arithmetics", op=op)


def _step(item: str):
    if item in UNARY:
        return UNARY[item]
    try:
        sign, number = item[0], float(item[1:])
    except (IndexError, ValueError):
        raise ValidationError(f"arithmetic operation {item} not implemented") from None
    binary = {"+": lambda v: v + F.lit(number), "-": lambda v: v - F.lit(number),
              "*": lambda v: v * F.lit(number), "/": lambda v: F.try_divide(v, F.lit(number))}
    if sign not in binary:
        raise ValidationError(f"arithmetic operation {item} not implemented")
    return binary[sign]


def _subtract(left: Part, right: Part, on: Sequence[str], rows: int | None = None) -> Part | None:
    """left - right of the common variables, on the given dims of both sides."""
    common = [v for v in left.variables if v in right.variables]
    if not common:
        return None
    other = right.df.select(*on, *(F.col(v).alias(f"__r_{v}") for v in common))
    if rows is not None:
        other = hint_small(other, rows)
    extra = [d for d in right.dims if d not in left.dims]
    if extra:
        raise ValidationError(f"the subtrahend has more dimensions: {', '.join(extra)}")
    if not on:
        return left.select({v: F.col(v) - other.select(f"__r_{v}").scalar() for v in common}, common)
    joined = left.df.join(other, list(on))
    return Part(joined.select(*left.dims, *((F.col(v) - F.col(f"__r_{v}")).alias(v)
                                            for v in common)), left.dims, tuple(common))


def diff(cube: Cube, other: Cube) -> Cube:
    """cube - other on common variables and common labels.

    Equally long time axes without a common label are matched by position, and their labels become
    positions.  A subtrahend without time, or with a single one, applies to every time.
    """
    timed = "time" in cube.dims and "time" in other.dims
    if timed:
        mine, theirs = (axis_info(c, "time")["time"] for c in (cube, other))
        if mine.size == theirs.size and not _share_labels(cube, other, mine, theirs):
            cube, other = (_by_position(c, i) for c, i in ((cube, mine), (other, theirs)))
        elif theirs.size == 1:
            other = _drop_dim(other, "time")
    parts = []
    for left in cube.parts:
        for right in other.parts:
            rows = None
            on = [d for d in left.dims if d in right.dims]
            if len(on) < len(left.dims) and on:
                sizes = axis_info(other, *on)
                rows = reduce(lambda n, i: n * i.size, sizes.values(), 1)
            found = _subtract(left, right, on, rows)
            if found is not None:
                parts.append(found)
    return cube.with_parts(parts).stamped("diff")


def _share_labels(cube: Cube, other: Cube, mine: AxisInfo, theirs: AxisInfo) -> bool:
    if mine.labels is not None and theirs.labels is not None:
        return bool(set(mine.labels) & set(theirs.labels))
    common = cube.axis("time").join(other.axis("time"), "time", "left_semi")
    return bool(common.limit(1).count())


def _drop_dim(cube: Cube, dim: str) -> Cube:
    def apply(part: Part) -> Part:
        dims = tuple(d for d in part.dims if d != dim)
        return Part(part.df.select(*dims, *part.variables), dims, part.variables)

    return cube.map(apply, having=[dim])


def _by_position(cube: Cube, info) -> Cube:
    """Replace time labels by their position."""
    def apply(part: Part) -> Part:
        ranked = with_position(part.df, cube, info, "__pos")
        columns = [F.col("__pos").alias(d) if d == "time" else F.col(d) for d in part.dims]
        return Part(ranked.select(*columns, *part.variables), part.dims, part.variables)

    return cube.map(apply, having=["time"])


def statements(script: str) -> list[tuple[str, str]]:
    """``name = expression`` lines (or ``;``-separated); expressions are Spark SQL."""
    found = []
    for line in re.split(r"[;\n]", script):
        if not line.strip():
            continue
        pair = re.fullmatch(r"\s*([A-Za-z_]\w*)\s*=(?!=)\s*(.+?)\s*", line)
        if not pair:
            raise ValidationError(f"assignment expected: {line.strip()}")
        found.append((pair[1], pair[2]))
    return found


def _is_aggregate(df: DataFrame, expression: str) -> bool:
    """Analysis alone tells: next to a plain column an aggregate is rejected."""
    try:
        df.select(F.expr(expression), F.col(df.columns[0]).alias("__any"))
        return False
    except AnalysisException:
        df.agg(F.expr(expression))
        return True


_MEDIAN = re.compile(r"median\(([^()]*(?:\([^()]*\)[^()]*)*)\)", re.IGNORECASE)


def _aggregates(df: DataFrame, batch: list[tuple[str, str]]) -> dict[str, Column]:
    """Scalar columns of aggregates of one table: one subquery, and one per median.

    A median is closed in on by value ranges, so that no task holds the table.
    """
    out, plain = {}, []
    for name, text in batch:
        whole = _MEDIAN.fullmatch(text.strip())
        if whole:
            value = df.select(F.expr(whole[1]).cast("double").alias("v"))
            found = quantiles(value.select(null_if_nan(value, "v")), [], "v", [0.5])
            out[name] = found.select(F.col("q")[0]).scalar()
        else:
            plain.append(F.expr(text).alias(name))
    if plain:
        row = df.agg(F.struct(*plain).alias("__row")).scalar()
        out.update({name: row[name] for name, _ in batch if name not in out})
    return out


def _assign(df: DataFrame, script: str) -> tuple[DataFrame, DataFrame, list[str], set[str]]:
    """Run the statements in order, on the rows and on a one-row table of what is equal on all rows.

    Aggregates that follow each other are computed together. NaN is missing, as everywhere.
    """
    one = df.sparkSession.range(1).select()
    new: list[str] = []
    scalars: set[str] = set()
    batch: list[tuple[str, str]] = []

    def put(table: DataFrame, name: str, value: Column) -> DataFrame:
        table = table.withColumn(name, value)
        return table.withColumn(name, null_if_nan(table, name))

    def settle() -> None:
        nonlocal df, one
        for name, value in _aggregates(df, batch).items():
            df, one = put(df, name, value), put(one, name, value)
        batch.clear()

    for name, text in statements(script):
        used = set(re.findall(r"[A-Za-z_]\w*", text))
        if used & {n for n, _ in batch} or name in {n for n, _ in batch}:
            settle()
        if _is_aggregate(df, text):
            batch.append((name, text))
            scalars.add(name)
        else:
            settle()
            df = put(df, name, F.expr(text))
            if (used & set(df.columns)) - {name} <= scalars and not (
                    name in used and name not in scalars):
                one = put(one, name, F.expr(text))
                scalars.add(name)
            else:
                scalars.discard(name)
        new = [n for n in new if n != name] + [name]
    settle()
    return df, one, new, scalars


def compute_data_frame(df: DataFrame, script: str, copy: bool = False) -> DataFrame:
    """New columns from ``name = expression`` lines; names starting with ``_`` are temporary.

    Without ``copy`` only the new columns are kept, and when all of them are aggregates or constants
    the result is one row, also of an empty table.
    """
    out, one, new, scalars = _assign(df, script)
    kept = [n for n in new if not n.startswith("_")]
    if copy:
        return out.select(*[c for c in df.columns if c not in kept], *kept)
    return (one if set(kept) <= scalars else out).select(*kept)


def compute_dataset(cube: Cube | None, script: str, copy: bool = False,
                    context: dict[str, Cube] | None = None) -> Cube:
    """The same for cubes; ``resource.variable`` refers to a cube of ``context``."""
    refs = sorted(set(re.findall(r"\b([A-Za-z_]\w*)\.([A-Za-z_]\w*)\b", script)))
    named = [(r, v) for r, v in refs if r in (context or {})]
    base: Part | None = cube.only_part if cube is not None else None
    for resource in sorted({r for r, _ in named}):
        wanted = [v for r, v in named if r == resource]
        part = context[resource].part_of(wanted[0])
        renamed = part.df.select(*part.dims, *(F.col(v).alias(f"{resource}__{v}")
                                               for v in wanted))
        names = tuple(f"{resource}__{v}" for v in wanted)
        if base is None:
            base = Part(renamed, part.dims, names)
            continue
        on = [d for d in base.dims if d in part.dims]
        base = Part(base.df.join(renamed, on), base.dims, (*base.variables, *names))
    if base is None:
        raise ValidationError("no dataset given")
    for resource, name in named:
        script = re.sub(rf"\b{resource}\.{name}\b", f"{resource}__{name}", script)
    out, _, new, _ = _assign(base.df, script)
    kept = [n for n in new if not n.startswith("_")]
    if copy and cube is not None:
        kept = [v for v in cube.variables if v not in kept] + kept
    part = Part(out.select(*base.dims, *kept), base.dims, tuple(kept))
    return cube.with_parts((part,)) if cube is not None else Cube((part,))


JOINS = ("outer", "inner", "left", "right", "exact")
COMPATS = ("identical", "equals", "broadcast_equals", "no_conflicts")


def merge(*cubes: Cube | None, join: str = "outer", compat: str = "no_conflicts") -> Cube:
    """Combine up to four cubes; ``join`` aligns the labels of each dimension.

    Variables of the same name must agree as ``compat`` says.  The check is part of the plan and
    fails the query that meets a conflict, so that no extra pass over the data is needed.

    With ``broadcast_equals`` a variable may have fewer dimensions in one cube than in another, all of
    them among the other's; its values must then be those of every cell along the others, which is checked
    at once. The variable of more dimensions stays.
    """
    if join not in JOINS or compat not in COMPATS:
        raise ValidationError(f"unknown join '{join}' or compat '{compat}'")
    distinct: list[Cube] = []
    for cube in cubes:
        if cube is not None and not any(cube is c for c in distinct):
            distinct.append(cube)
    if not distinct:
        raise ValidationError("at least two different datasets must be given")
    if len(distinct) == 1:
        return distinct[0]
    if compat == "identical" and any(c.var_attrs.get(v) != d.var_attrs.get(v)
                                     for c in distinct for d in distinct
                                     for v in set(c.variables) & set(d.variables)):
        raise ValidationError("variables of the same name have different attributes")
    distinct = _aligned(distinct, join)
    merged: dict[tuple[str, ...], Part] = {}
    for cube in distinct:
        for part in cube.parts:
            key = tuple(sorted(part.dims))
            merged[key] = _combine(merged[key], part, compat) if key in merged else part
    if compat == "broadcast_equals":
        merged = _broadcast(merged)
    _one_home(merged)
    out = distinct[0]
    attrs = reduce(lambda a, c: {**c.attrs, **a}, distinct, {})
    return replace(out.with_parts(merged.values()), attrs=attrs).stamped(
        "merge", join=join, compat=compat)


def _broadcast(merged: dict[tuple[str, ...], Part]) -> dict[tuple[str, ...], Part]:
    """The parts with each variable in the part of most dimensions only, after comparing the others."""
    parts = sorted(merged.values(), key=lambda p: len(p.dims))
    for i, small in enumerate(parts):
        for name in small.variables:
            large = next((p for p in reversed(parts[i + 1:]) if name in p.variables
                          and set(small.dims) < set(p.dims)), None)
            if large is None:
                continue
            extra = [d for d in large.dims if d not in small.dims]
            sizes = axis_info(Cube(tuple(p for p in parts if set(extra) & set(p.dims))), *extra)
            _check_broadcast(small, large, name, prod(sizes[d].size for d in extra))
            parts[i] = parts[i].select(variables=[v for v in parts[i].variables if v != name])
    return {tuple(sorted(p.dims)): p for p in parts if p.variables}


def _check_broadcast(small: Part, large: Part, name: str, cells: int) -> None:
    """Fail unless all cells of the larger part that belong to a cell of the smaller have its value."""
    value, own = F.col(name), F.col("__own")
    over = large.df.groupBy(*small.dims).agg(
        F.min(value).alias("__low"), F.max(value).alias("__high"), F.count(value).alias("__n"))
    both = over.join(small.df.select(*small.dims, value.alias("__own")), list(small.dims), "full_outer")
    same = F.when(own.isNull(), F.coalesce(F.col("__n"), F.lit(0)) == 0).otherwise(
        (F.col("__low") == own) & (F.col("__high") == own) & (F.col("__n") == cells))
    if both.where(~F.coalesce(same, F.lit(False))).limit(1).count():
        raise ValidationError(f"conflicting values of variable {name}")


def _one_home(merged: dict) -> None:
    seen: set[str] = set()
    for part in merged.values():
        twice = seen & set(part.variables)
        if twice:
            raise ValidationError(f"conflicting dimensions of variable {twice.pop()}")
        seen |= set(part.variables)


def _aligned(cubes: list[Cube], join: str) -> list[Cube]:
    if join == "outer":
        return cubes
    infos = [axis_info(c, *c.dims) for c in cubes]
    for dim in [d for d in cubes[0].dims if sum(d in c.dims for c in cubes) > 1]:
        having = [(c, i[dim]) for c, i in zip(cubes, infos) if dim in c.dims]
        if _same_labels(having, dim):
            continue
        if join == "exact":
            raise ValidationError(f"labels along dimension '{dim}' are not equal")
        chosen = {"inner": having, "left": having[:1], "right": having[-1:]}[join]
        labels = reduce(lambda a, b: a.join(b, dim, "left_semi"), [c.axis(dim) for c, _ in chosen])
        small = hint_small(labels, min(i.size for _, i in chosen))
        cubes = [_with_labels(c, dim, small) if dim in c.dims else c for c in cubes]
    return cubes


def _same_labels(having, dim: str) -> bool:
    """Whether all cubes share an axis."""
    (cube, first), others = having[0], having[1:]
    for other, info in others:
        same = first.agrees(info)
        if same is None:
            same = not cube.axis(dim).join(other.axis(dim), dim, "left_anti").limit(1).count()
        if not same:
            return False
    return True


def _with_labels(cube: Cube, dim: str, labels: DataFrame) -> Cube:
    def apply(part: Part) -> Part:
        rows = part.df.join(labels, dim, "left_semi")
        return Part(rows.select(*part.dims, *part.variables), part.dims, part.variables)

    return cube.map(apply, having=[dim], keep=[d for d in cube.dims if d != dim])


def _combine(left: Part, right: Part, compat: str) -> Part:
    common = [v for v in left.variables if v in right.variables]
    added = [v for v in right.variables if v not in common]
    other = right.df.select(*left.dims, *added, *(F.col(v).alias(f"__r_{v}") for v in common))
    joined = left.df.join(other, list(left.dims), "full_outer")

    def settled(name: str) -> Column:
        a, b = F.col(name), F.col(f"__r_{name}")
        conflict = (a != b) if compat == "no_conflicts" else ~a.eqNullSafe(b)
        return F.when(F.coalesce(conflict, F.lit(False)), F.raise_error(
            F.lit(f"conflicting values of variable {name}")).cast("double")).otherwise(
            F.coalesce(a, b)).alias(name)

    own = [settled(v) if v in common else F.col(v) for v in left.variables]
    return Part(joined.select(*left.dims, *own, *added), left.dims, (*left.variables, *added))
