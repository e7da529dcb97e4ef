"""Cubes on storage, and a catalog of them.

A stored cube is a folder: ``cells/<i>`` holds the cells of each dimension tuple as Parquet,
partitioned by year and month of the time label and sorted by the dims; ``axes/<dim>`` holds the
labels of each dimension, so that axis questions never scan cells; ``attrs`` is one JSON text.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isograd import literals
from isograd.model import TEMPORAL, Cube, Part, ValidationError
from isograd.operators.axis import axis_info, lat_dim, lon_dim
from isograd.operators.normalize import adjust_temporal_attrs, normalize, spatial_attrs, temporal_attrs
from isograd.operators.select import select_var
from isograd.operators.subset import subset_spatial, subset_temporal
from isograd.session import prepare

YEAR, MONTH = "__year", "__month"


def write_cube(cube: Cube, path: str, mode: str = "errorifexists") -> None:
    """Store a cube; rows are range-partitioned by their unique dims, so no file can be hot."""
    for i, part in enumerate(cube.parts):
        rows = part.df
        for name in (*part.dims, *part.variables):
            meta = {**cube.var_attrs.get(name, {}), "role": "dim" if name in part.dims else "var"}
            rows = rows.withMetadata(name, json.loads(json.dumps(meta, default=str)))
        order = sorted(part.dims, key=lambda d: {"time": 0, "lat": 2, "lon": 3}.get(d, 1))
        layout = []
        if "time" in part.dims and isinstance(cube.dim_type("time"), TEMPORAL):
            rows = rows.withColumn(YEAR, F.year("time")).withColumn(MONTH, F.month("time"))
            layout = [YEAR, MONTH]
        if order:
            rows = rows.repartitionByRange(*order).sortWithinPartitions(*layout, *order)
        rows.write.mode(mode).partitionBy(*layout).parquet(f"{path}/cells/{i}")
    spark = cube.parts[0].df.sparkSession
    # labels of the cells come from what was just written, not from the plan of the cells again
    stored = [replace(p, df=spark.read.schema(p.df.select(*p.dims).schema).parquet(f"{path}/cells/{i}"))
              for i, p in enumerate(cube.parts)]
    written = replace(cube, parts=tuple(stored), known={})
    for dim in cube.dims:
        written.axis(dim).write.mode(mode).parquet(f"{path}/axes/{dim}")
    info = {"parts": len(cube.parts), "attrs": cube.attrs,
            "var_attrs": cube.var_attrs, "dims": cube.dims}
    text = json.dumps(info, default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(
        f"{path}/attrs")


def read_cube(spark: SparkSession, path: str, drop_variables: Iterable[str] = ()) -> Cube:
    """Open a stored cube; dims and attributes come with it."""
    prepare(spark)
    info = json.loads(spark.read.text(f"{path}/attrs", wholetext=True).first()[0])
    drop = set(drop_variables)
    parts = []
    for i in range(info["parts"]):
        df = spark.read.parquet(f"{path}/cells/{i}")
        names = [f for f in df.schema.fields if f.name not in (YEAR, MONTH)]
        dims = tuple(f.name for f in names if f.metadata.get("role") == "dim")
        kept = tuple(f.name for f in names if f.metadata.get("role") == "var"
                     and f.name not in drop)
        parts.append(Part(df, dims, kept))
    axes = {d: spark.read.parquet(f"{path}/axes/{d}") for d in info["dims"]}
    return Cube(tuple(parts), info["attrs"], info["var_attrs"], axes)


def read_table_as_cube(spark: SparkSession, paths: str | Iterable[str], dims: Iterable[str],
                       drop_variables: Iterable[str] = (), normalized: bool = True) -> Cube:
    """Open plain Parquet files as a cube and bring the coordinates into the common form."""
    prepare(spark)
    files = [paths] if isinstance(paths, str) else list(paths)
    cube = Cube.of(spark.read.parquet(*files).drop(*drop_variables), dims)
    return adjust_temporal_attrs(normalize(cube)) if normalized else cube


def prune_by_time(cube: Cube, time_range) -> Cube:
    """Temporal subset that also names the partition folders to read."""
    found = literals.time_range(time_range)
    if found is None:
        return cube
    low, high = found

    def apply(part: Part) -> Part:
        if YEAR not in part.df.columns:
            return part
        months = F.col(YEAR) * 12 + F.col(MONTH)
        return part.where(F.col(YEAR).between(low.year, high.year) & months.between(
            low.year * 12 + low.month, high.year * 12 + high.month))

    return subset_temporal(cube.map(apply, having=["time"], keep=cube.dims), time_range)


def open_dataset(spark: SparkSession, catalog: DataFrame, ds_id: str, time_range=None, region=None,
                 var_names=None, normalized: bool = True, data_store_id: str | None = None,
                 force_local: bool = False, local_ds_id: str | None = None) -> Cube:
    """Open a catalogued cube; variables, time range and the region's bounds reach the scan."""
    entry = find_data_store(catalog, ds_id, data_store_id)
    if entry is None:
        raise ValidationError(f'no data store found that contains the ID "{ds_id}"')
    cube = select_var(read_cube(spark, entry["path"]), var_names)
    cube = prune_by_time(cube, time_range)
    if region:
        cube = subset_spatial(cube, literals.polygon(region).bounds)
    if normalized:
        cube = adjust_temporal_attrs(normalize(cube))
    if force_local:
        return make_local(spark, cube, f"{entry['path']}.local", local_ds_id or ds_id)
    return cube


def find_data_store(catalog: DataFrame, ds_id: str, store_id: str | None = None) -> dict | None:
    """The catalog entry (store_id, data_id, path) of an id; an id in several stores is an error."""
    hits = catalog.where(F.col("data_id") == ds_id)
    if store_id is not None:
        hits = hits.where(F.col("store_id") == store_id)
    stores = hits.groupBy("store_id").agg(F.min("path").alias("path")).limit(2).collect()
    if len(stores) > 1:
        raise ValidationError(f"{ds_id} found in more than one data store")
    return {"store_id": stores[0].store_id, "path": stores[0].path} if stores else None


def store_counts(catalog: DataFrame) -> DataFrame:
    """(data_id, stores): in how many stores each id is held."""
    return catalog.groupBy("data_id").agg(F.count_distinct("store_id").alias("stores"))


def make_local(spark: SparkSession, cube: Cube, folder: str, name: str) -> Cube:
    """Store an opened cube under ``local.<name>.<n>`` with the first free number."""
    n = 1
    while True:
        path = f"{folder}/local.{name}.{n}"
        try:
            spark.read.text(f"{path}/attrs")
        except AnalysisException:
            break
        n += 1
    write_cube(cube, path)
    return read_cube(spark, path)


def add_as_local(spark: SparkSession, paths: str | Iterable[str], dims: Iterable[str]) -> Cube:
    """Open several Parquet files or globs as one cube; repeated paths count once."""
    files = [paths] if isinstance(paths, str) else list(paths)
    return read_table_as_cube(spark, list(dict.fromkeys(files)), dims)


def describe(cube: Cube) -> DataFrame:
    """One row per dim: size, ends and step of its axis."""
    info = axis_info(cube, *cube.dims)
    rows = [(d, i.size, None if i.first is None else str(i.first),
             None if i.last is None else str(i.last), i.step) for d, i in info.items()]
    spark = cube.parts[0].df.sparkSession
    return spark.createDataFrame(rows, "dim string, size bigint, first string, last string, "
                                       "step double")


def descriptor(cube: Cube) -> dict:
    """Bounding box, time range, resolutions and variables with their attributes."""
    lon, lat = lon_dim(cube), lat_dim(cube)
    dims = [d for d in (lon, lat, "time") if d in cube.dims]
    info = axis_info(cube, *dims) if dims else {}
    found: dict[str, object] = {}
    if lon and lat:
        spatial = spatial_attrs(info[lon], info[lat], allow_point=True)
        found["bbox"] = tuple(spatial[f"geospatial_{k}"] for k in (
            "lon_min", "lat_min", "lon_max", "lat_max"))
        found["spatial_res"] = spatial["geospatial_lon_resolution"]
    if "time" in info:
        temporal = temporal_attrs(info["time"])
        found["time_range"] = (temporal.get("time_coverage_start"),
                               temporal.get("time_coverage_end"))
        found["time_period"] = temporal.get("time_coverage_resolution")
    found["variables"] = [{"name": v, **cube.var_attrs.get(v, {})} for v in cube.variables]
    return found


def descriptor_text(cube: Cube) -> str:
    """The descriptor as indented lines."""
    lines = []
    for key, value in descriptor(cube).items():
        if key != "variables":
            lines.append(f"{key}: {value}")
            continue
        for var in value:
            units = f" ({var['units']})" if var.get("units") else ""
            name = f", {var['long_name']}" if var.get("long_name") else ""
            lines.append(f"  {var['name']}{units}{name}")
    return "\n".join(lines)


def extent(df: DataFrame, lon: str = "lon", lat: str = "lat", time: str = "time") -> DataFrame:
    """One aggregate with the bounding box, the time range and the axis sizes."""
    columns: list[Column] = []
    for name in (lon, lat, time):
        columns += [F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max"),
                    F.count_distinct(name).alias(f"{name}_size")]
    return df.agg(*columns)
