"""The data model: a cube is a set of long DataFrames, one row per grid cell.

Variables that share a dimension tuple share one DataFrame.  A missing value is NULL (NaN is
converted once, when the cube is made) and a cell without a row is missing as well.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.DoubleType, T.FloatType)
TEMPORAL = (T.TimestampNTZType, T.TimestampType, T.DateType)
NUMERIC = T.NumericType


class ValidationError(ValueError):
    """A user-provided value does not fit the operator."""


def null_if_nan(df: DataFrame, name: str) -> Column:
    column = F.col(name)
    if isinstance(df.schema[name].dataType, FLOATING):
        return F.when(~F.isnan(column), column).alias(name)
    return column


def ntz(value: dt.datetime | dt.date | str) -> Column:
    """A TIMESTAMP_NTZ literal, free of any session or process time zone."""
    text = value if isinstance(value, str) else value.isoformat(sep=" ") if isinstance(
        value, dt.datetime) else value.isoformat()
    return F.lit(text).cast("timestamp_ntz")


def literal(value) -> Column:
    return ntz(value) if isinstance(value, dt.date) else F.lit(value)


@dataclass(frozen=True)
class Part:
    """Variables over one tuple of dimensions."""

    df: DataFrame
    dims: tuple[str, ...]
    variables: tuple[str, ...]

    def select(self, columns: Mapping[str, Column] | None = None,
               variables: Iterable[str] | None = None) -> Part:
        """Keep the dims, replace or pick variables; an absent expression keeps the variable."""
        columns = columns or {}
        names = tuple(variables) if variables is not None else self.variables
        exprs = [columns.get(v, F.col(v)).alias(v) for v in names]
        return Part(self.df.select(*self.dims, *exprs), self.dims, names)

    def where(self, condition: Column) -> Part:
        return replace(self, df=self.df.where(condition))


@dataclass(frozen=True)
class Cube:
    """Named variables over labelled dimensions, held as long DataFrames.

    ``axes`` may hold one-column label tables per dimension.  They are read from the cube's own
    storage when it has them (see ``sources.cubes``) so that axis questions never scan the cells;
    otherwise labels are derived from the cells.  ``known`` remembers the axis facts already found
    (``AxisInfo`` per dimension), so that operators in a row do not ask for them again.
    """

    parts: tuple[Part, ...]
    attrs: Mapping[str, object] = field(default_factory=dict)
    var_attrs: Mapping[str, Mapping[str, object]] = field(default_factory=dict)
    axes: Mapping[str, DataFrame] = field(default_factory=dict)
    known: dict[str, object] = field(default_factory=dict, compare=False)

    @classmethod
    def of(cls, df: DataFrame, dims: Iterable[str], variables: Iterable[str] | None = None, *,
           attrs=None, var_attrs=None, axes=None) -> Cube:
        dims = tuple(dims)
        names = tuple(variables) if variables is not None else tuple(
            c for c in df.columns if c not in dims)
        missing = [c for c in (*dims, *names) if c not in df.columns]
        if missing:
            raise ValidationError(f"columns not in the table: {', '.join(missing)}")
        clean = df.select(*dims, *(null_if_nan(df, v) for v in names))
        return cls((Part(clean, dims, names),), dict(attrs or {}), dict(var_attrs or {}),
                   dict(axes or {}))

    @property
    def df(self) -> DataFrame:
        return self.only_part.df

    @property
    def only_part(self) -> Part:
        if len(self.parts) != 1:
            raise ValidationError("the variables do not share the same dimensions")
        return self.parts[0]

    @property
    def dims(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(d for p in self.parts for d in p.dims))

    @property
    def variables(self) -> tuple[str, ...]:
        return tuple(v for p in self.parts for v in p.variables)

    def part_of(self, variable: str) -> Part:
        for part in self.parts:
            if variable in part.variables:
                return part
        raise ValidationError(f'"{variable}" is not a variable of the dataset')

    def dim_type(self, dim: str) -> T.DataType:
        for part in self.parts:
            if dim in part.dims:
                return part.df.schema[dim].dataType
        raise ValidationError(f"the dataset has no dimension '{dim}'")

    def axis(self, dim: str) -> DataFrame:
        """Distinct labels of a dimension as a one-column table."""
        if dim in self.axes:
            return self.axes[dim].select(dim)
        frames = [p.df.select(dim) for p in self.parts if dim in p.dims]
        if not frames:
            raise ValidationError(f"the dataset has no dimension '{dim}'")
        return reduce(DataFrame.unionByName, frames).where(F.col(dim).isNotNull()).distinct()

    def with_parts(self, parts: Iterable[Part], keep: Iterable[str] = ()) -> Cube:
        """The same dataset with other cells; ``keep`` names dims whose labels stay the same."""
        keep = set(keep)
        return replace(self, parts=tuple(parts),
                       axes={d: a for d, a in self.axes.items() if d in keep},
                       known={d: i for d, i in self.known.items() if d in keep})

    def map(self, fn: Callable[[Part], Part], *, having: Iterable[str] = (),
            keep: Iterable[str] = ()) -> Cube:
        """Apply ``fn`` to each part that has all dims in ``having``; leave other parts alone."""
        need = set(having)
        return self.with_parts((fn(p) if need <= set(p.dims) else p for p in self.parts), keep)

    def where_label(self, dim: str, condition: Column, info: object = None) -> Cube:
        """Filter by a condition on one dimension's label; its stored axis is filtered too.

        ``info`` is what is known about the axis that is left.
        """
        others = [d for d in self.dims if d != dim]
        out = self.map(lambda p: p.where(condition), having=[dim], keep=others)
        if dim in self.axes:
            out = replace(out, axes={**out.axes, dim: self.axes[dim].where(condition)})
        return out if info is None else replace(out, known={**out.known, dim: info})

    def with_attrs(self, **updates) -> Cube:
        attrs = {**self.attrs, **updates}
        return replace(self, attrs={k: v for k, v in attrs.items() if v is not None})

    def stamped(self, operator: str, **inputs) -> Cube:
        """Append one line to the history attribute."""
        args = ", ".join(f"{k}={v!r}" for k, v in inputs.items() if v is not None)
        lines = [self.attrs["history"]] if self.attrs.get("history") else []
        return self.with_attrs(history="\n".join([*lines, f"{operator}({args})"]))

    def transform(self, fn: Callable[..., Cube], *args, **kwargs) -> Cube:
        return fn(self, *args, **kwargs)
