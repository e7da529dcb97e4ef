"""Anomalies and the ENSO family of indices built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isograd import literals
from isograd.model import TEMPORAL, Cube, Part, ValidationError
from isograd.operators.arithmetic import ds_arithmetics
from isograd.operators.axis import axis_info, hint_small, positions
from isograd.operators.normalize import temporal_attrs
from isograd.operators.select import select_var
from isograd.operators.subset import subset_spatial, subset_temporal

# Index regions as west, south, east, north.
REGIONS = {
    "N1+2": "-90, -10, -80, 0",
    "N3": "-150, -5, -90, 5",
    "N3.4": "-170, -5, -120, 5",
    "N4": "160, -5, -150, 5",
}
REGION_ALIASES = {"N34": "N3.4", "n34": "N3.4"}


def anomaly_external(cube: Cube, climatology: Cube, transform: str | None = None) -> Cube:
    """Monthly cube minus a 12-slice climatology, which is matched by position, not by label."""
    if "time" not in cube.dims or not isinstance(cube.dim_type("time"), TEMPORAL):
        raise ValidationError("anomaly calculation needs a time coordinate of a timestamp type")
    resolution = cube.attrs.get("time_coverage_resolution") or temporal_attrs(
        axis_info(cube, "time")["time"]).get("time_coverage_resolution")
    if resolution != "P1M":
        raise ValidationError(f"anomaly_external expects a monthly dataset, got {resolution}")
    if "time" not in climatology.dims:
        raise ValidationError("the reference dataset is required to have a time coordinate")
    slices = axis_info(climatology, *climatology.dims)
    if slices["time"].size != 12:
        raise ValidationError("the reference dataset is expected to be a monthly climatology, "
                              f"it has {slices['time'].size} time steps")
    ready = ds_arithmetics(cube, transform) if transform else cube
    months = F.broadcast(positions(climatology, "time", "__month"))
    parts = []
    for part in ready.parts:
        for ref in climatology.parts:
            found = _less_reference(part, ref, months, slices)
            if found is not None:
                parts.append(found)
    return cube.with_parts(parts).stamped("anomaly_external", transform=transform)


def _less_reference(part: Part, ref: Part, months: DataFrame, slices) -> Part | None:
    common = [v for v in part.variables if v in ref.variables]
    if not common or "time" not in part.dims:
        return None
    rest = [d for d in ref.dims if d != "time" and d in part.dims]
    rows = 12
    for dim in rest:
        rows *= slices[dim].size
    slim = ref.df.join(months, "time").select(
        (F.col("__month") + 1).cast("int").alias("__month"), *rest,
        *(F.col(v).alias(f"__r_{v}") for v in common))
    joined = part.df.withColumn("__month", F.month("time")).join(
        hint_small(slim, rows), ["__month", *rest])
    return Part(joined.select(*part.dims, *((F.col(v) - F.col(f"__r_{v}")).alias(v)
                                            for v in common)), part.dims, tuple(common))


def anomaly_internal(cube: Cube, time_range=None, region=None) -> Cube:
    """Cube minus the mean of each variable over an optional time range and region."""
    ref = cube
    if time_range:
        ref = subset_temporal(ref, time_range)
    if region:
        ref = subset_spatial(ref, region, keep_axis=False)

    def apply(part: Part) -> Part:
        base = ref.part_of(part.variables[0]).df
        means = base.agg(F.struct(*(F.avg(v).alias(v) for v in part.variables))).scalar()
        return part.select({v: F.col(v) - means[v] for v in part.variables})

    return cube.map(apply, keep=cube.dims).stamped("anomaly_internal", time_range=time_range,
                                                   region=region)


def centred_mean(table: DataFrame, column: str, window: int, order: str = "time") -> DataFrame:
    """Centred rolling mean by position; incomplete windows are dropped.

    The input has one row per time step, so the ordered window spans a time axis, not cells.
    """
    before, after = window // 2, window - 1 - window // 2
    span = Window.orderBy(order).rowsBetween(-before, after)
    return (table.withColumn("__n", F.count(column).over(span))
            .withColumn(column, F.avg(column).over(span))
            .where(F.col("__n") == window).drop("__n"))


def index_series(cube: Cube, var: str, region, window: int, climatology: Cube, name: str,
                 threshold: float | None = None) -> DataFrame:
    """Rolling mean of the region's unweighted mean anomaly, one row per time.

    With a threshold t, ``El Nino`` marks values above t and ``La Nina`` values below -t.
    """
    if not isinstance(var, str):
        raise ValidationError("a variable name is required")
    cube.part_of(var)
    chosen = subset_spatial(select_var(cube, var), literals.polygon(region), keep_axis=False)
    anomaly = anomaly_external(chosen, select_var(climatology, var)).part_of(var).df
    means = anomaly.groupBy("time").agg(F.avg(var).alias("value"))
    rolled = centred_mean(means, "value", window)
    flags = {} if threshold is None else {"El Nino": F.col("value") > threshold,
                                          "La Nina": F.col("value") < -threshold}
    return rolled.select("time", F.col("value").alias(name),
                         *(flag.alias(label) for label, flag in flags.items()))


def enso_nino34(cube: Cube, var: str, climatology: Cube, threshold: float | None = None):
    """Five-month rolling index over the Niño 3.4 region."""
    return index_series(cube, var, REGIONS["N3.4"], 5, climatology, "ENSO N3.4 Index", threshold)


def enso(cube: Cube, var: str, climatology: Cube, region: str = "n34", custom_region=None,
         threshold: float | None = None) -> DataFrame:
    """Five-month rolling index over a named region, or over ``custom_region``."""
    region = REGION_ALIASES.get(region, region)
    if region == "custom":
        shape = literals.polygon(custom_region)
        if shape is None:
            raise ValidationError("no region has been provided to the ENSO index calculation")
        return index_series(cube, var, shape, 5, climatology, f"ENSO Index over {shape.wkt}",
                            threshold)
    if region not in REGIONS:
        raise ValidationError(f"unknown region '{region}'")
    return index_series(cube, var, REGIONS[region], 5, climatology, f"ENSO {region} Index",
                        threshold)


def oni(cube: Cube, var: str, climatology: Cube, threshold: float | None = None) -> DataFrame:
    """Three-month rolling index over the Niño 3.4 region."""
    return index_series(cube, var, REGIONS["N3.4"], 3, climatology, "ONI Index", threshold)
