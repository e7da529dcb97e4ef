"""Reductions, climatologies and temporal aggregation."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import replace
from functools import reduce as fold
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd import literals
from isograd.functions.periods import Period
from isograd.functions.quantile import GROUP_ROWS, join_null_safe, quantiles
from isograd.model import TEMPORAL, Cube, Part, ValidationError, ntz
from isograd.operators.axis import AxisInfo, axis_info, constant_labels, hint_small, positions
from isograd.operators.normalize import temporal_attrs
from isograd.operators.select import select_var

REDUCERS = ("mean", "min", "max", "sum", "median")
RESAMPLERS = ("mean", "max", "median", "prod", "sum", "std", "var", "argmax", "argmin",
              "first", "last")


def reducer(method: str, value: Column) -> Column:
    """Reductions that skip missing values; the sum of nothing is 0."""
    if method == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0))
    plain = {"mean": F.avg, "min": F.min, "max": F.max}
    if method not in plain:
        raise ValidationError(f"unknown reduction method '{method}'")
    return plain[method](value)


def reduce(cube: Cube, var=None, dim: str | Iterable[str] | None = None,
           method: str = "mean") -> Cube:
    """Reduce the chosen variables over the given dims (all dims by default).

    A variable keeps the dims it does not share with ``dim``; variables not chosen stay as they
    are.  Unknown dims are ignored.
    """
    if method not in REDUCERS:
        raise ValidationError(f"unknown reduction method '{method}'")
    chosen = literals.match(var, cube.variables)
    dims = literals.names(dim) or list(cube.dims)
    parts = []
    for part in cube.parts:
        hit = [v for v in part.variables if v in chosen]
        gone = [d for d in part.dims if d in dims]
        if not hit or not gone:
            parts.append(part)
            continue
        rest = [v for v in part.variables if v not in hit]
        if rest:
            parts.append(part.select(variables=rest))
        parts.append(_reduced(cube, part, hit, gone, method))
    kept = [d for d in cube.dims if d not in dims]
    return cube.with_parts(parts, keep=kept).stamped("reduce", var=var, dim=dim, method=method)


def _reduced(cube: Cube, part: Part, variables: list[str], gone: list[str], method: str) -> Part:
    kept = tuple(d for d in part.dims if d not in gone)
    if method != "median":
        rows = part.df.groupBy(*kept).agg(
            *(reducer(method, F.col(v)).alias(v) for v in variables))
        return Part(rows, kept, tuple(variables))
    return Part(medians(cube, part.df, kept, gone, variables), kept, tuple(variables))


def medians(cube: Cube, df: DataFrame, keys, gone, variables) -> DataFrame:
    """Exact medians; a group is at most the product of the reduced axes' sizes."""
    info = axis_info(cube, *gone)
    bound = prod(i.size for i in info.values())
    if bound <= GROUP_ROWS:
        return df.groupBy(*keys).agg(*(F.percentile(v, F.lit(0.5)).alias(v) for v in variables))
    frames = [quantiles(df, keys, v, [0.5], group_rows=bound).select(*keys, F.col("q")[0].alias(v))
              for v in variables]
    if not keys:
        return df.sparkSession.range(1).select(*(f.scalar().alias(v)
                                                 for f, v in zip(frames, variables)))
    # every frame has all groups
    return fold(lambda a, b: join_null_safe(a, b, list(keys), "left"), frames)


def _need_time(cube: Cube, what: str) -> None:
    if "time" not in cube.dims or not isinstance(cube.dim_type("time"), TEMPORAL):
        raise ValidationError(f"{what} expects a time coordinate of a timestamp type; "
                              "normalizing the dataset may help")


def long_term_average(cube: Cube, var=None, resolution: str | None = None) -> Cube:
    """Mean over years at the dataset's own resolution: monthly, daily or seasonal.

    The resolution is taken from the attributes, else from the time axis.
    """
    _need_time(cube, "long_term_average")
    cube = select_var(cube, var)
    time = axis_info(cube, "time")["time"]
    resolution = (resolution or cube.attrs.get("time_coverage_resolution")
                  or temporal_attrs(time).get("time_coverage_resolution"))
    if resolution is None:
        raise ValidationError("could not determine the temporal resolution")
    if resolution == "P1D":
        return _daily(cube)
    if resolution == "P1M":
        label = F.make_timestamp_ntz(F.lit(time.first.year), F.month("time"), F.lit(1),
                                     F.lit(0), F.lit(0), F.lit(0))
        return _climatology(cube, [F.month("time")], label, time)
    return _seasonal(cube, time)


def _mean_by(part: Part, keys: list[Column], rest: list[str]) -> DataFrame:
    return part.df.groupBy(*keys, *rest).agg(*(F.avg(v).alias(v) for v in part.variables))


def _daily(cube: Cube) -> Cube:
    def apply(part: Part) -> Part:
        rest = [d for d in part.dims if d != "time"]
        rows = _mean_by(part, [F.dayofyear("time").alias("dayofyear")], rest)
        return Part(rows.select("dayofyear", *rest, *part.variables), ("dayofyear", *rest),
                    part.variables)

    rest = [d for d in cube.dims if d != "time"]
    return cube.map(apply, having=["time"], keep=rest).stamped("long_term_average")


def _climatology(cube: Cube, keys: list[Column], label: Column, time: AxisInfo) -> Cube:
    """Group by calendar keys; the label is a function of them, so it is the grouping key."""
    def apply(part: Part) -> Part:
        rest = [d for d in part.dims if d != "time"]
        rows = _mean_by(part, [label.alias("time")], rest)
        return Part(rows.select("time", *rest, *part.variables), ("time", *rest), part.variables)

    out = cube.map(apply, having=["time"], keep=[d for d in cube.dims if d != "time"])
    if len(keys) == 1 and time.labels is not None:
        months = sorted({t.month for t in time.labels})
        out.known["time"] = AxisInfo.of("time", (dt.datetime(time.first.year, m, 1)
                                                 for m in months), True)
    out = out.with_attrs(climatology_bounds=(time.first, time.last),
                         time_coverage_resolution="P1M" if len(keys) == 1 else None)
    methods = {v: {**out.var_attrs.get(v, {}), "cell_methods": " ".join(filter(None, [
        str(out.var_attrs.get(v, {}).get("cell_methods", "")), "time: mean over years"]))}
        for v in out.variables} if len(keys) > 1 else out.var_attrs
    return replace(out, var_attrs=methods).stamped("long_term_average")


def _seasonal(cube: Cube, time: AxisInfo) -> Cube:
    """The same (month, day) dates each year, labelled by the fuller of the first two years."""
    axis = cube.axis("time").select(F.year("time").alias("y"), F.month("time").alias("m"),
                                    F.dayofmonth("time").alias("d"))
    head = axis.groupBy("y").count().orderBy("y").limit(2).collect()
    year = head[1].y if len(head) > 1 and head[1]["count"] > head[0]["count"] else head[0].y
    season = axis.where(F.col("y") == year).select("m", "d").distinct()
    if axis.join(season, ["m", "d"], "left_anti").limit(1).count():
        raise ValidationError("a long term average can not be created for a dataset with "
                              "inconsistent seasons")
    label = F.make_timestamp_ntz(F.lit(year), F.month("time"), F.dayofmonth("time"),
                                 F.lit(0), F.lit(0), F.lit(0))
    return _climatology(cube, [F.month("time"), F.dayofmonth("time")], label, time)


def temporal_aggregation(cube: Cube, method: str = "mean", period: str = "MS",
                         fill_empty: bool = True) -> Cube:
    """Resample to a period without weighting; std and var are population moments.

    Bins that no time label falls into have NULL rows, unless ``fill_empty`` is false.
    """
    if "time" not in cube.dims:
        raise ValidationError("temporal aggregation expects a 'time' coordinate")
    _need_time(cube, "temporal aggregation")
    if method not in RESAMPLERS:
        raise ValidationError(f"aggregation method {method} is not valid")
    parsed = Period.parse(period)
    time = axis_info(cube, "time")["time"]
    label = parsed.bin(F.col("time"), time.first)
    order = _order_in_bin(cube, label, time) if method in ("argmax", "argmin") else None
    bins, used = _bins(cube, parsed, label, time)
    gaps = fill_empty and used < bins.size

    def apply(part: Part) -> Part:
        rest = [d for d in part.dims if d != "time"]
        df = part.df
        if order is not None:
            df = df.join(order, "time")
        rows = df.groupBy(label.alias("__bin"), *rest).agg(
            *(_resampler(method, v).alias(v) for v in part.variables))
        rows = rows.withColumnRenamed("__bin", "time").select("time", *rest, *part.variables)
        if gaps:
            empty = _empty_bins(cube, part, rest, parsed, label, time)
            rows = rows.unionByName(empty.select("time", *rest, *(
                F.col(v).cast(rows.schema[v].dataType).alias(v) for v in part.variables)))
        return Part(rows, ("time", *rest), part.variables)

    out = cube.map(apply, having=["time"], keep=[d for d in cube.dims if d != "time"])
    return out.with_attrs(**temporal_attrs(bins, cube.attrs.get("time_bnds"))).stamped(
        "temporal_aggregation", method=method, period=period)


def _bins(cube: Cube, period: Period, label: Column, time: AxisInfo) -> tuple[AxisInfo, int]:
    """The axis of all bins from the first to the last, and how many of them hold a time label.

    Bins follow the order of times, so the ends of the axis tell them; labels at hand are not read again.
    """
    if not time.size:
        return AxisInfo.of("time", (), True), 0
    low, high = (period.bin(ntz(end), time.first) for end in (time.first, time.last))
    every = period.labels(low, high)
    if time.labels is not None:
        rows = cube.parts[0].df.sparkSession.range(1)
        held = F.transform(constant_labels(time, "timestamp_ntz"), lambda t: period.bin(t, time.first))
        used = F.size(F.array_distinct(held))
    else:
        rows = cube.axis("time").agg(F.count_distinct(label).alias("used"))
        used = F.col("used")
    found = rows.select(used.alias("used"), F.size(every).alias("size"), F.slice(every, 1, 2).alias("head"),
                        F.element_at(every, -1).alias("last")).first()
    second = found.head[1] if found.size > 1 else None
    return replace(AxisInfo.of("time", found.head[:1], True), size=found.size, second=second,
                   last=found.last, labels=None), found.used


def _order_in_bin(cube: Cube, label: Column, time: AxisInfo) -> DataFrame:
    """Position of each time label inside its bin, counted on the time axis."""
    ranked = positions(cube, "time", "__rank").withColumn("__bin_of", label)
    starts = ranked.groupBy("__bin_of").agg(F.min("__rank").alias("__start"))
    placed = ranked.join(hint_small(starts, time.size), "__bin_of").select(
        "time", (F.col("__rank") - F.col("__start")).alias("__pos"))
    return hint_small(placed, time.size)


def _resampler(method: str, name: str) -> Column:
    value, time = F.col(name), F.col("time")
    some = value.isNotNull()
    if method in ("mean", "max", "sum"):
        return reducer(method, value)
    if method == "median":
        # a group holds the labels of one bin only
        return F.percentile(value, F.lit(0.5))
    if method == "prod":
        return F.coalesce(F.product(value), F.lit(1.0))
    if method == "std":
        return F.stddev_pop(value)
    if method == "var":
        return F.var_pop(value)
    if method in ("first", "last"):
        pick = F.min_by if method == "first" else F.max_by
        return pick(value, F.when(some, time))
    position = F.when(some, F.col("__pos"))
    if method == "argmax":
        return F.max_by(position, F.when(some, F.struct(value, -F.col("__pos"))))
    return F.min_by(position, F.when(some, F.struct(value, F.col("__pos"))))


def _empty_bins(cube: Cube, part: Part, rest: list[str], period: Period, label: Column,
                time: AxisInfo) -> DataFrame:
    """Every cell at every bin that holds no time label; the bins are an expression, not data."""
    low, high = (period.bin(ntz(end), time.first) for end in (time.first, time.last))
    cells = part.df.select(*rest).distinct() if rest else part.df.sparkSession.range(1)
    every = cells.select(F.explode(period.labels(low, high)).alias("time"), *rest)
    used = cube.axis("time").select(label.alias("time")).distinct()
    free = every.join(hint_small(used, time.size), "time", "left_anti")
    return free.select("time", *rest, *(F.lit(None).cast(part.df.schema[v].dataType).alias(v)
                                        for v in part.variables))


def tseries_mean(cube: Cube, var=None, std_suffix: str = "_std",
                 calculate_std: bool = True) -> Cube:
    """Mean, and population std as ``<var><suffix>``, over all other dims at each time."""
    chosen = select_var(cube, var)

    def apply(part: Part) -> Part:
        columns = [F.avg(v).alias(v) for v in part.variables]
        names = list(part.variables)
        if calculate_std:
            columns += [F.stddev_pop(v).alias(v + std_suffix) for v in part.variables]
            names += [v + std_suffix for v in part.variables]
        return Part(part.df.groupBy("time").agg(*columns), ("time",), tuple(names))

    return chosen.map(apply, having=["time"], keep=["time"]).stamped("tseries_mean", var=var)
