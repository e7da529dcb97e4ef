"""Correlation and outliers."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd import literals
from isograd.functions.quantile import GROUP_ROWS, percentile_columns, quantiles
from isograd.functions.special import correlation_p_value
from isograd.model import Cube, Part, ValidationError
from isograd.operators.axis import AxisInfo, axis_info, hint_small, with_position
from isograd.operators.select import select_var


def _r(sxy: Column, sxx: Column, syy: Column) -> Column:
    """Coefficient from centred sums, clamped against rounding; NULL without variation."""
    raw = F.try_divide(sxy, F.sqrt(sxx * syy))
    return F.when(raw.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))


def _map_moments() -> Column:
    """r of the columns x and y where each side is centred on the mean of its own values.

    Built on Spark's one-pass central moments: the cross sum over complete pairs is shifted by the
    distance of the pairs' means from the sides' own means.
    """
    pair = F.col("x").isNotNull() & F.col("y").isNotNull()
    pairs = F.count(F.when(pair, F.lit(1)))
    shift = (F.avg(F.when(pair, F.col("x"))) - F.avg("x")) * (
        F.avg(F.when(pair, F.col("y"))) - F.avg("y"))
    sxy = pairs * (F.covar_pop("x", "y") + shift)
    return _r(F.coalesce(sxy, F.lit(0.0)), F.count("x") * F.var_pop("x"),
              F.count("y") * F.var_pop("y"))


def pearson_correlation(x: Cube, y: Cube, var_x: str, var_y: str) -> Cube:
    """Map of (corr_coef, p_value) per lat/lon over time, which is matched by position.

    Two 3-D variables on the same grid, or a 3-D variable and a time series.
    """
    own = one_table(x, y, var_x, var_y)
    px, py = (select_var(c, v).part_of(v) for c, v in ((x, var_x), (y, var_y)))
    for part in (px, py):
        if set(part.dims) not in ({"time", "lat", "lon"}, {"time"}):
            raise ValidationError("a correlation map needs 3D lon/lat/time variables, or one of "
                                  "them and a 1D time series")
    if len(px.dims) == 1 and len(py.dims) == 1:
        raise ValidationError("a correlation map needs at least one 3D variable")
    x, y = (replace(c, parts=(p,)) for c, p in ((x, px), (y, py)))
    ix, iy = axis_info(x, *px.dims), axis_info(y, *py.dims)
    if ix["time"].size != iy["time"].size:
        raise ValidationError("the length of the time dimension differs between the datasets")
    steps = ix["time"].size
    if steps < 3:
        raise ValidationError("the time dimension should not be shorter than three")
    both = len(px.dims) == len(py.dims) == 3
    if own is not None:
        return _map_of(own, steps, var_x, var_y)
    if both:
        _same_grid(x, y, ix, iy)
    tx = with_position(px.df, x, ix["time"], "__t")
    ty = with_position(py.df, y, iy["time"], "__t")
    if both:
        cells = prod(ix[d].size for d in ("lat", "lon"))
        pairs = _paired(tx, ty, var_x, var_y, cells)
    elif len(px.dims) == 3:
        pairs = tx.join(hint_small(ty.select("__t", F.col(var_y).alias("y")), steps), "__t").select(
            "lat", "lon", F.col(var_x).alias("x"), "y")
    else:
        pairs = ty.join(hint_small(tx.select("__t", F.col(var_x).alias("x")), steps), "__t").select(
            "lat", "lon", "x", F.col(var_y).alias("y"))
    return _map_of(pairs, steps, var_x, var_y)


def one_table(x: Cube, y: Cube, var_x: str, var_y: str) -> DataFrame | None:
    """(dims, x, y) where both variables are columns of one table, else None."""
    part = x.part_of(var_x)
    if part is not y.part_of(var_y):
        return None
    return part.df.select(*part.dims, F.col(var_x).cast("double").alias("x"),
                          F.col(var_y).cast("double").alias("y"))


def _map_of(pairs: DataFrame, steps: int, var_x: str, var_y: str) -> Cube:
    rows = pairs.groupBy("lat", "lon").agg(_map_moments().alias("corr_coef"))
    out = rows.withColumn("p_value", correlation_p_value("corr_coef", F.lit(steps - 2.0)))
    return Cube((Part(out, ("lat", "lon"), ("corr_coef", "p_value")),)).stamped(
        "pearson_correlation", var_x=var_x, var_y=var_y)


def _same_grid(x: Cube, y: Cube, ix, iy) -> None:
    for dim in ("lat", "lon"):
        same = ix[dim].agrees(iy[dim])
        if same is None:
            same = not x.axis(dim).join(y.axis(dim), dim, "left_anti").limit(1).count()
        if not same:
            raise ValidationError("the datasets must have the same lat/lon definition; "
                                  "consider coregistration first")


def _paired(tx: DataFrame, ty: DataFrame, var_x: str, var_y: str, cells: int) -> DataFrame:
    """(lat, lon, x, y) per time position; both sides go through one exchange of a union.

    With many cells the rows are exchanged by cell, and that layout serves the pairing and the
    per-cell moments alike.  With few cells pairing spreads over time as well.
    """
    none = F.lit(None).cast("double")
    union = tx.select("lat", "lon", "__t", F.col(var_x).cast("double").alias("x"),
                      none.alias("y")).unionByName(
        ty.select("lat", "lon", "__t", none.alias("x"), F.col(var_y).cast("double").alias("y")))
    width = int(union.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if cells >= 8 * width:
        union = union.repartition("lat", "lon")
    return union.groupBy("lat", "lon", "__t").agg(F.max("x").alias("x"), F.max("y").alias("y"))


def pearson_correlation_scalar(x: Cube, y: Cube, var_x: str, var_y: str) -> DataFrame:
    """One row (corr_coef, p_value) over all cells, which are paired by axis positions.

    Two variables of one table are paired as they stand, without moving a row.
    """
    own = one_table(x, y, var_x, var_y)
    px, py = (select_var(c, v).part_of(v) for c, v in ((x, var_x), (y, var_y)))
    if set(px.dims) != set(py.dims):
        raise ValidationError("both variables should have the same dimensions")
    x, y = (replace(c, parts=(p,)) for c, p in ((x, px), (y, py)))
    ix, iy = axis_info(x, *px.dims), axis_info(y, *px.dims)
    for dim in px.dims:
        if ix[dim].size != iy[dim].size:
            raise ValidationError(f"dimension {dim} of both variables must have the same length")
    if prod(i.size for i in ix.values()) < 3:
        raise ValidationError("there should be no less than 3 values in both variables")
    pairs = positional_pairs(x, y, ix, iy, var_x, var_y) if own is None else own
    pair = F.col("x").isNotNull() & F.col("y").isNotNull()
    kept = pairs.where(pair)
    n = F.count(F.lit(1))
    sums = kept.agg(n.alias("n"), _r(n * F.covar_pop("x", "y"), n * F.var_pop("x"),
                                     n * F.var_pop("y")).alias("corr_coef"))
    return sums.select("corr_coef", correlation_p_value(
        "corr_coef", (F.col("n") - 2).cast("double")).alias("p_value"))


def positional_pairs(x: Cube, y: Cube, ix: dict[str, AxisInfo], iy: dict[str, AxisInfo],
                     var_x: str, var_y: str) -> DataFrame:
    """(dims of x, x, y) of cells at the same axis positions; a side without a row is NULL.

    The labels are those of ``x``; cells only ``y`` has keep NULL labels.
    """
    dims = x.only_part.dims
    marks = [f"__p_{d}" for d in dims]

    def placed(cube: Cube, info) -> DataFrame:
        df = cube.only_part.df
        for dim, mark in zip(dims, marks):
            df = with_position(df, cube, info[dim], mark)
        return df

    none = F.lit(None).cast("double")
    left = placed(x, ix).select(*marks, *dims, F.col(var_x).cast("double").alias("x"),
                                none.alias("y"))
    right = placed(y, iy).select(
        *marks, *(F.lit(None).cast(x.dim_type(d)).alias(d) for d in dims), none.alias("x"),
        F.col(var_y).cast("double").alias("y"))
    return left.unionByName(right).groupBy(*marks).agg(
        *(F.max(d).alias(d) for d in dims), F.max("x").alias("x"), F.max("y").alias("y")
    ).select(*dims, "x", "y")


def detect_outliers(cube: Cube, var, threshold_low: float = 0.05, threshold_high: float = 0.95,
                    quantiles_given: bool = True, mask: bool = False) -> Cube:
    """Values outside the open interval of the thresholds become NULL, or are marked by a mask.

    Thresholds are exact quantiles of each variable by default, else absolute values.  The mask
    ``<var>_outlier_mask`` is 1 for outliers and missing values.
    """
    chosen = literals.match(var, cube.variables)
    ends = (threshold_low, threshold_high)
    bounds = {name: ends for name in chosen}
    if quantiles_given:
        bounds = {}
        for part in cube.parts:
            bounds.update(_quantile_bounds(cube, part, [v for v in part.variables if v in chosen],
                                           ends))

    def inside(name: str) -> Column:
        low, high = (F.lit(b).cast("double") for b in bounds[name])
        return F.coalesce((F.col(name) > low) & (F.col(name) < high), F.lit(False))

    def apply(part: Part) -> Part:
        hit = [v for v in part.variables if v in chosen]
        if not mask:
            return part.select({v: F.when(inside(v), F.col(v)) for v in hit})
        masks = {f"{v}_outlier_mask": F.when(inside(v), F.lit(0)).otherwise(F.lit(1))
                 .cast("tinyint") for v in hit}
        names = (*part.variables, *masks)
        return part.select(masks, names)

    out = cube.map(apply, keep=cube.dims)
    if mask:
        out = replace(out, var_attrs=reduce(_mask_attrs, chosen, dict(out.var_attrs)))
    return out.stamped("detect_outliers", var=var)


def _quantile_bounds(cube: Cube, part: Part, names: list[str], ends) -> dict:
    """Exact quantiles of each variable; together in one pass while one task can hold them."""
    if not names:
        return {}
    size = prod(i.size for i in axis_info(cube, *part.dims).values())
    if size <= GROUP_ROWS:
        row = part.df.agg(*percentile_columns({v: ends for v in names})).first()
        return {v: tuple(row[v] or (None, None)) for v in names}
    return {v: tuple(quantiles(part.df, [], v, ends).first().q or (None, None)) for v in names}


def _mask_attrs(attrs: dict, name: str) -> dict:
    """CF attributes that tie a flag variable to its variable."""
    own, flag = attrs.get(name, {}), f"{name}_outlier_mask"
    standard = " ".join(filter(None, [own.get("standard_name"), "status_flag"]))
    ancillary = " ".join(filter(None, [own.get("ancillary_variables"), flag]))
    return {**attrs, name: {**own, "ancillary_variables": ancillary}, flag: {
        "standard_name": standard, "long_name": f"{own.get('long_name', name)} outlier mask",
        "_FillValue": 0, "valid_range": (1, 1), "flag_values": (1,), "flag_meanings": "is_outlier"}}
