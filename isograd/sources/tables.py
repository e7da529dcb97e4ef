"""Tables in text formats: CSV, JSON, plain text and GeoJSON."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from math import prod
from pathlib import PurePath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isograd import literals
from isograd.model import NUMERIC, Cube, ValidationError
from isograd.operators.axis import axis_info, with_position
from isograd.operators.geometry import (
    collected,
    display_geometry,
    is_collection,
    members,
    point_geometry,
)
from isograd.session import checkpoint, scratch
from isograd.sources.geojson import cut_features

# Column names that make point features, and index names read as times.
LON_COLUMNS = ("lon", "long", "longitude")
LAT_COLUMNS = ("lat", "latitude")
TIME_INDEXES = ("date", "time")

#: Fixed value: rows of a CSV preview.
PREVIEW_ROWS = 10_000


def read_csv(spark: SparkSession, path: str, delimiter: str | None = ",",
             delim_whitespace: bool = False, quotechar: str | None = None,
             comment: str | None = None, index_col: str | None = None, parse_points: bool = True,
             more_args: Mapping | str | None = None, schema: str | None = None) -> DataFrame:
    """A CSV file with a header as a table.

    Numeric longitude and latitude columns (any letter case) add a point ``geometry`` column.  An
    index column called ``date`` or ``time`` becomes a timestamp.  Give a ``schema`` for large
    files, since inferring one reads them twice.
    """
    options = {"header": "true", **(literals.dictionary(more_args) or {})}
    if quotechar:
        options["quote"] = quotechar
    if comment:
        options["comment"] = comment
    if schema is None:
        options["inferSchema"] = "true"
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    if delim_whitespace:
        table = _blank_separated(spark, path, options, schema)
    else:
        table = reader.option("sep", delimiter or ",").csv(path)
    if index_col in TIME_INDEXES and index_col in table.columns:
        stamp = F.try_to_timestamp(F.col(index_col).cast("string"))
        table = table.withColumn(index_col, stamp.cast("timestamp_ntz"))
    if index_col and index_col in table.columns:
        table = table.select(index_col, *[c for c in table.columns if c != index_col])
    return with_points(table) if parse_points else table


#: What stands between the values of a line while it is read: no text has it.
_SEPARATOR = "\x1f"


def _blank_separated(spark: SparkSession, path: str, options: dict, schema: str | None) -> DataFrame:
    """Lines whose values are parted by blanks; blanks inside quotes belong to the value.

    The first line has the names; lines equal to it, as at the start of further files, are no data.
    """
    quote = options.get("quote", '"')
    mark = r"\\" + quote if quote in r"\.[]{}()*+-?^$|" else quote
    other = f"[^{mark}]*"
    blanks = rf"\s+(?=(?:{other}{mark}{other}{mark})*{other}$)"

    def kept(file: str) -> DataFrame:
        found = spark.read.text(file).select(F.trim("value").alias("value")).where("value <> ''")
        if "comment" in options:
            found = found.where(~F.col("value").startswith(options["comment"]))
        return found

    lines = kept(path)
    # scans take large files first, so the names are looked for in the first file by name
    heads = (kept(file).first() for file in sorted(lines.inputFiles()))
    first = next((head for head in heads if head is not None), None)
    if first is None:
        return spark.createDataFrame([], schema or "value string")
    rows = lines.where(F.col("value") != first.value).select(
        F.regexp_replace("value", blanks, _SEPARATOR).alias("value"))
    plain = {k: v for k, v in options.items() if k not in ("header", "inferSchema", "comment")}
    plain |= {"sep": _SEPARATOR, "quote": quote}
    names = [n.strip(quote) for n in re.split(blanks, first.value)]
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])

    def parsed(kind: T.StructType) -> DataFrame:
        return rows.select(F.from_csv("value", _ddl(kind), plain).alias("r")).select("r.*")

    if schema is not None:
        return parsed(T.StructType.fromDDL(schema))
    found = parsed(text)
    if options.get("inferSchema") != "true":
        return found
    # the narrowest of these types that all values of a column have
    kinds = ("bigint", "double", "boolean", "timestamp")
    fits = found.agg(*(F.every(F.col(f"`{n}`").isNull() | F.expr(f"try_cast(`{n}` AS {k})").isNotNull())
                       .alias(f"{i}_{k}") for i, n in enumerate(names) for k in kinds)).first()
    chosen = [next((k for k in kinds if fits[f"{i}_{k}"]), "string") for i in range(len(names))]
    return found.select(*(F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(names, chosen)))


def _ddl(kind: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind.fields)


def with_points(table: DataFrame) -> DataFrame:
    """Add a point geometry when numeric longitude and latitude columns are present."""
    def find(names) -> str | None:
        return next((c for n in names for c in table.columns if c.lower() == n
                     and isinstance(table.schema[c].dataType, NUMERIC)), None)

    lon, lat = find(LON_COLUMNS), find(LAT_COLUMNS)
    if lon is None or lat is None:
        return table
    return table.withColumn("geometry", point_geometry(F.col(lon), F.col(lat)))


def numbered(df: DataFrame, name: str, first: int = 0, order=None) -> DataFrame:
    """Number the rows along ``order`` (columns), or as they stand, without one task for all.

    Rows are sorted once and kept, so that counting them by partition and numbering them see the same
    partitions; what reaches the driver is a count per partition.
    """
    kept = checkpoint(df.orderBy(*order) if order else df)
    placed = kept.withColumn("__at", F.monotonically_increasing_id())
    part, row = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], first
    for p in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(p, 0)
    if not starts:
        return df.select(F.lit(first).cast("bigint").alias(name), "*").limit(0)
    begin = F.get(F.array(*(F.lit(s).cast("bigint") for s in starts)), part.cast("int"))
    return placed.select((begin + row).alias(name), *df.columns)


def cube_rows(cube: Cube, columns=None) -> DataFrame:
    """(index, dims, variables); the index is the C-order position in the full grid.

    It is computed from axis positions, so no global sort is needed, and missing cells keep their
    number.
    """
    chosen = set(literals.names(columns) or cube.variables)
    parts = [(p, [v for v in p.variables if v in chosen]) for p in cube.parts
             if chosen & set(p.variables)]
    if not parts:
        raise ValidationError("none of the selected variables has a dimension")
    if len(parts) > 1:
        raise ValidationError("not all variables have the same dimensions; select variables so "
                              "that their dimensions are equal")
    part, names = parts[0]
    info = axis_info(cube, *part.dims)
    rows, index = part.df, F.lit(0).cast("bigint")
    for i, dim in enumerate(part.dims):
        rows = with_position(rows, cube, info[dim], f"__p{i}")
        index = index + F.col(f"__p{i}") * prod(info[d].size for d in part.dims[i + 1:])
    return rows.select(index.alias("index"), *part.dims, *names)


def write_csv(obj: DataFrame | Cube, path: str, columns=None, na_rep: str = "",
              delimiter: str = ",", quotechar: str | None = None,
              more_args: Mapping | str | None = None, mode: str = "errorifexists",
              order=None) -> None:
    """Write a table or a cube with an ``index`` column; part files follow the index.

    The rows of a table are numbered along the columns ``order``, which make the index stable.
    """
    if obj is None:
        raise ValidationError("nothing to write")
    options = {"header": "true", "sep": delimiter, "nullValue": na_rep, "emptyValue": "",
               **(literals.dictionary(more_args) or {})}
    if quotechar:
        options["quote"] = quotechar
    if isinstance(obj, Cube):
        rows = cube_rows(obj, columns).orderBy("index")
    else:
        names = literals.names(columns) or [c for c in obj.columns if c != "geometry"]
        rows = numbered(obj.select(*names), "index", order=literals.names(order) if order else None)
    rows.write.mode(mode).options(**options).csv(path)


def preview_csv(df: DataFrame, path: str, rows: int = PREVIEW_ROWS) -> None:
    """The first rows as CSV."""
    df.limit(rows).write.option("header", "true").csv(path)


def preview(df: DataFrame, rows: int = PREVIEW_ROWS) -> DataFrame:
    return df.limit(rows)


def read_json(spark: SparkSession, path: str, encoding: str | None = None,
              multi_line: bool = False, schema: str | None = None) -> DataFrame:
    """JSON as a table: one object per line, or with ``multi_line`` one document per file.

    A document may be an array of objects. Lines that are no objects raise an error rather than being
    left out.
    """
    reader = spark.read.option("multiLine", str(multi_line).lower()).option("mode", "FAILFAST")
    if encoding:
        reader = reader.option("encoding", encoding).option("lineSep", "\n")
    if schema:
        reader = reader.schema(schema)
    try:
        return reader.json(path)
    except Exception as error:
        if multi_line or "MALFORMED_RECORD" not in str(error):
            raise
        raise ValidationError("not one JSON object per line; multi_line reads single documents"
                              ) from error


def write_json(df: DataFrame, path: str, encoding: str | None = None,
               mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    (writer.option("encoding", encoding) if encoding else writer).json(path)


def read_text(spark: SparkSession, path: str, wholetext: bool = True) -> DataFrame:
    """One row per file, or per line."""
    return spark.read.text(path, wholetext=wholetext)


def write_text(df: DataFrame, path: str, column: str = "value",
               mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


_POINT = "array<double>"
_DEPTH = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2,
          "MultiPolygon": 3}


def _runs_from_json(kind: Column, text: Column) -> Column:
    """GeoJSON coordinates of any depth as runs of vertices."""
    def vertex(p: Column) -> Column:
        return F.struct(p[0].alias("x"), p[1].alias("y"))

    def run(ps: Column) -> Column:
        return F.transform(ps, vertex)

    line, area = f"array<{_POINT}>", f"array<array<{_POINT}>>"
    by_depth = {
        0: F.array(F.array(vertex(F.from_json(text, _POINT)))),
        1: F.array(run(F.from_json(text, line))),
        2: F.transform(F.from_json(text, area), run),
        3: F.transform(F.flatten(F.from_json(text, f"array<{area}>")), run)}
    return F.coalesce(*[F.when(kind.isin([k for k, d in _DEPTH.items() if d == depth]), expr)
                        for depth, expr in by_depth.items()])


def _shape_from_json(shape: Column) -> Column:
    """A geometry of (type, coordinates, geometries) as text, in the form of the library."""
    kind, text = shape["type"], shape["coordinates"]
    # members of a collection: their types and numbers of runs stand in the type
    inner = F.transform(shape["geometries"], lambda m: F.struct(
        F.when(m["type"] == "GeometryCollection", F.raise_error(F.lit("a collection in a collection")))
        .otherwise(m["type"]).alias("type"), _runs_from_json(m["type"], m["coordinates"]).alias("coords")))
    own = F.struct(kind.alias("type"), _runs_from_json(kind, text).alias("coords"))
    return F.when(kind == "GeometryCollection", collected(inner)).when(kind.isNotNull(), own)


def read_geo_data_frame(spark: SparkSession, path: str) -> DataFrame:
    """GeoJSON as a feature table; features, collections and documents may follow each other in a file.

    Every file is cut into features first (see ``sources.geojson``); their properties are then found in
    one pass. Properties become columns; point features get ``lon`` and ``lat`` as well. A collection of
    geometries is one feature (see ``operators.geometry.members``).
    """
    lines = scratch(spark, "features")
    cut_features(spark, path).write.text(lines)
    feature = spark.read.json(lines).schema
    properties = feature["properties"].dataType if "properties" in feature.fieldNames() \
        else T.StructType()
    simple = T.StructType([T.StructField("type", T.StringType()),
                           T.StructField("coordinates", T.StringType())])
    geometry = T.StructType([*simple.fields, T.StructField("geometries", T.ArrayType(simple))])
    fields = [T.StructField("geometry", geometry)]
    if isinstance(properties, T.StructType) and properties.fields:
        fields.append(T.StructField("properties", properties))
    rows = spark.read.option("mode", "FAILFAST").schema(T.StructType(fields)).json(lines)
    shaped = rows.select(*([F.col("properties")] if len(fields) > 1 else []),
                         _shape_from_json(F.col("geometry")).alias("geometry"))
    spot = F.when(F.col("geometry.type") == "Point", F.col("geometry.coords")[0][0])
    flat = ["properties.*"] if len(fields) > 1 else []
    out = shaped.select(*flat, spot["x"].alias("__lon"), spot["y"].alias("__lat"), "geometry")
    names = {n.lower() for n in out.columns}
    for temporary, name in (("__lon", "lon"), ("__lat", "lat")):
        out = out.drop(temporary) if name in names else out.withColumnRenamed(temporary, name)
    return out


def _coordinates_json(geometry: Column) -> Column:
    """Runs of vertices as GeoJSON coordinates of the geometry's type."""
    runs = F.transform(geometry["coords"], lambda r: F.transform(
        r, lambda p: F.array(p["x"], p["y"])))
    kind = geometry["type"]
    return (F.when(kind == "Point", F.to_json(runs[0][0]))
            .when(kind.isin("LineString", "MultiPoint"), F.to_json(runs[0]))
            .when(kind.isin("Polygon", "MultiLineString"), F.to_json(runs))
            .when(kind == "MultiPolygon", F.to_json(F.transform(runs, lambda r: F.array(r)))))


def _shape_json(geometry: Column) -> Column:
    def simple(shape: Column) -> Column:
        return F.concat(F.lit('{"type":"'), shape["type"], F.lit('","coordinates":'),
                        _coordinates_json(shape), F.lit("}"))

    several = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(
        F.transform(members(geometry), simple), ","), F.lit("]}"))
    return F.when(is_collection(geometry), several).otherwise(simple(geometry))


def _ensure_geometry(df: DataFrame) -> DataFrame:
    if "geometry" in df.columns:
        return df
    if {"lon", "lat"} <= set(df.columns):
        return df.withColumn("geometry", point_geometry(F.col("lon"), F.col("lat")))
    raise ValidationError("the table has neither a geometry nor lon and lat columns")


def feature_json(df: DataFrame, extras: Mapping[str, Column] | None = None) -> DataFrame:
    """One GeoJSON feature per row in ``value``; ``extras`` are members next to the properties."""
    df = _ensure_geometry(df)
    hidden = {"geometry"}
    properties = [c for c in df.columns if c not in hidden and not c.startswith("__")]
    members = [F.lit('{"type":"Feature"')]
    for name, value in (extras or {}).items():
        text = F.to_json(F.struct(value.alias(name)))
        # a missing value leaves its member out
        members.append(F.when(value.isNotNull(), F.concat(
            F.lit(","), F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(""))
    members.append(F.concat(F.lit(',"geometry":'), F.coalesce(_shape_json(F.col("geometry")),
                                                              F.lit("null"))))
    members.append(F.concat(F.lit(',"properties":'),
                            F.to_json(F.struct(*properties)) if properties else F.lit("{}")))
    members.append(F.lit("}"))
    return df.select(F.concat(*members).alias("value"))


def write_geo_data_frame(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Features as GeoJSON, one per line; the extension names the format."""
    suffix = PurePath(path).suffix.lower()
    if suffix not in (".geojson", ".geojsonl", ".json"):
        raise ValidationError(
            f'Cannot detect supported format from file extension "{suffix}"')
    feature_json(df).write.mode(mode).text(path)


def feature_collection(df: DataFrame, res_id: int | None = None, num_features: int | None = None,
                       max_num_display_geometries: int = -1,
                       max_num_display_geometry_points: int = -1,
                       conservation_ratio: float = 1.0, id_column: str | None = None,
                       order=None) -> DataFrame:
    """Features for display with ``_idx``, ``id``, ``_resId`` and ``_simp``.

    A table with more features than may be shown, or a geometry with more vertices, is shown as
    mean points, which ``_simp`` = 1 marks. ``_idx`` follows the columns ``order``.
    """
    if max_num_display_geometries >= 0:
        total = df.count() if num_features is None else num_features
        if total > max_num_display_geometries:
            conservation_ratio = 0.0
    rows = numbered(_ensure_geometry(df), "__idx", order=literals.names(order) if order else None)
    shape, simple = display_geometry(F.col("geometry"), max_num_display_geometry_points,
                                     conservation_ratio)
    rows = rows.withColumns({"__simp": F.when(simple == 1, F.lit(1)), "geometry": shape})
    extras: dict[str, Column] = {"_simp": F.col("__simp")}
    if res_id is not None:
        extras["_resId"] = F.lit(res_id)
    extras["_idx"] = F.col("__idx")
    extras["id"] = F.col(id_column) if id_column else F.col("__idx")
    return feature_json(rows, extras)


# Format name → (extensions, reader, writer); earlier entries win when several fit.
FORMATS: dict[str, tuple[tuple[str, ...], Callable, Callable]] = {
    "PARQUET": ((".parquet",), lambda s, f: s.read.parquet(f), lambda d, f: d.write.parquet(f)),
    "GEOJSON": ((".geojson", ".geojsonl"), read_geo_data_frame, write_geo_data_frame),
    "CSV": ((".csv",), read_csv, write_csv),
    "JSON": ((".json",), read_json, write_json),
    "TEXT": ((".txt", ".text"), read_text, write_text),
    "ORC": ((".orc",), lambda s, f: s.read.orc(f), lambda d, f: d.write.orc(f)),
}


def find_format(file: str, format: str | None = None) -> str:
    """A named format, else the one that fits the extension."""
    if format is not None:
        if format.upper() not in FORMATS:
            raise ValidationError(f'unknown format "{format}"')
        return format.upper()
    suffix = PurePath(file).suffix.lower()
    for name, (suffixes, _, _) in FORMATS.items():
        if suffix in suffixes:
            return name
    raise ValidationError(f'no format found for file "{file}"')


def read_object(spark: SparkSession, file: str, format: str | None = None) -> DataFrame:
    return FORMATS[find_format(file, format)][1](spark, file)


def write_object(df: DataFrame, file: str, format: str | None = None) -> None:
    FORMATS[find_format(file, format)][2](df, file)
