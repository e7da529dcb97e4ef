"""Storage round trips, catalog, text formats and file names."""

from __future__ import annotations

from pyspark.sql import functions as F

from isograd.model import ValidationError
from isograd.operators.geometry import collected, point_geometry
from isograd.operators.select import select_var
from isograd.operators.subset import subset_temporal
from isograd.plans.views import cube_coarse, cube_fine, points, series, table
from isograd.session import scratch
from isograd.sources import cubes, names, tables
from isograd.suite.registry import case

COARSE, POINTS = ("cube_coarse",), ("points",)


def _catalog(spark, **paths):
    return spark.createDataFrame([("store", k, p) for k, p in paths.items()],
                                 "store_id string, data_id string, path string")


@case("s1_open_dataset", """SELECT time, lat, lon, price FROM cube_fine
WHERE time BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-02-28 23:59:59'
  AND lat BETWEEN -17.5 AND 27.5 AND lon BETWEEN -67.5 AND 37.5""", ("cube_fine",))
def opened(spark, sf_dir):
    path = scratch(spark, "fine")
    cubes.write_cube(cube_fine(spark, sf_dir), path)
    return cubes.open_dataset(spark, _catalog(spark, fine=path), "fine",
                              "1996-03-01, 1997-02-28", "-60, -10, 30, 20", "price").df


@case("s2_find_data_store", """SELECT s.r_name AS store_id, 'c' || c_custkey AS data_id,
  's3://' || s.r_name || '/' || min(n_name) AS path
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region s ON n_regionkey = r_regionkey
WHERE c_custkey IN (SELECT max(c_custkey) FROM customer) GROUP BY 1, 2""")
def stores(spark, sf_dir):
    """The entry of the last customer; an id that several stores hold is an error."""
    catalog = table(spark, sf_dir, "customer").join(
        table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("store_id"), F.concat(F.lit("c"), F.col("c_custkey")).alias("data_id"),
        F.concat(F.lit("s3://"), "r_name", F.lit("/"), "n_name").alias("path"),
        F.col("n_name").alias("nation"))
    last = table(spark, sf_dir, "customer").agg(F.max("c_custkey")).first()[0]
    entry = cubes.find_data_store(catalog, f"c{last}")
    nations = catalog.select("store_id", F.col("nation").alias("data_id"), "path").distinct()
    twice = nations.union(nations.select(F.lit("other"), "data_id", "path"))
    try:
        cubes.find_data_store(twice, nations.first().data_id)
    except ValidationError:
        return spark.createDataFrame([(entry["store_id"], f"c{last}", entry["path"])],
                                     "store_id string, data_id string, path string")
    raise AssertionError("an id in two stores was found")


@case("s2_store_counts", """SELECT n_name AS data_id, count(DISTINCT r_name) AS stores
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def store_counts(spark, sf_dir):
    catalog = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("store_id"), F.col("n_name").alias("data_id"),
        F.col("n_name").alias("path"))
    return cubes.store_counts(catalog)


@case("s4_make_local", "SELECT * FROM cube_coarse WHERE year(time) = 1996", COARSE)
def made_local(spark, sf_dir):
    cube = subset_temporal(cube_coarse(spark, sf_dir), "1996-01-01, 1996-12-31")
    return cubes.make_local(spark, cube, scratch(spark, "local"), "coarse").only_part.select().df


@case("s5_add_as_local", """SELECT c_custkey, c_acctbal FROM customer""")
def several_files(spark, sf_dir):
    folder = scratch(spark, "files")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    for i in range(2):
        rows.where(F.col("c_custkey") % 2 == i).write.parquet(f"{folder}/part-{i}")
    paths = [f"{folder}/part-0", f"{folder}/part-*1", f"{folder}/part-0"]
    return cubes.add_as_local(spark, paths, ["c_custkey"]).df


@case("s6_save_dataset", "SELECT time, lat, lon, price, qty FROM cube_coarse", COARSE)
def saved(spark, sf_dir):
    path = scratch(spark, "coarse")
    cubes.write_cube(cube_coarse(spark, sf_dir), path)
    return cubes.read_cube(spark, path).only_part.select().df


@case("s7_read_drop_variables", "SELECT time, lat, lon, qty FROM cube_coarse", COARSE)
def dropped(spark, sf_dir):
    path = scratch(spark, "coarse")
    cubes.write_cube(cube_coarse(spark, sf_dir), path)
    return cubes.read_cube(spark, path, drop_variables=["price"]).only_part.select().df


@case("s8_read_csv", "SELECT id, value, kind, lon AS x, lat AS y FROM points", POINTS)
def csv_points(spark, sf_dir):
    path = scratch(spark, "points") + ".csv"
    points(spark, sf_dir).withColumnsRenamed({"lon": "Longitude", "lat": "LAT"}).write.option(
        "header", "true").csv(path)
    rows = tables.read_csv(spark, path, index_col="id",
                           schema="id bigint, value double, kind string, Longitude double, "
                                  "LAT double")
    spot = F.col("geometry.coords")[0][0]
    return rows.select("id", "value", "kind", spot["x"].alias("x"), spot["y"].alias("y"))


@case("s8_read_csv_whitespace", """SELECT id, value, kind || '  of   ' || id AS label FROM points""",
      POINTS)
def blank_separated(spark, sf_dir):
    path = scratch(spark, "blanks") + ".txt"
    label = F.concat(F.lit('"'), "kind", F.lit("  of   "), "id", F.lit('"'))
    lines = points(spark, sf_dir).select(F.concat_ws("   ", "id", "value", label).alias("value"))
    head = spark.range(1).select(F.lit(" id  value   label ").alias("value"))
    head.unionByName(lines).write.text(path)
    return tables.read_csv(spark, path, delim_whitespace=True, parse_points=False,
                           schema="id bigint, value double, label string")


@case("s9_write_csv_cube", """WITH t AS (SELECT time, row_number() OVER (ORDER BY time) - 1 AS p
  FROM (SELECT DISTINCT time FROM cube_coarse))
SELECT p * 72 + CAST(round((lat + 75) / 30) AS BIGINT) * 12
    + CAST(round((lon + 165) / 30) AS BIGINT) AS index, time, lat, lon, price
FROM cube_coarse JOIN t USING (time)""", COARSE)
def csv_cube(spark, sf_dir):
    path = scratch(spark, "cube") + ".csv"
    tables.write_csv(cube_coarse(spark, sf_dir), path, "price", na_rep="nan", delimiter=";")
    back = tables.read_csv(spark, path, delimiter=";", parse_points=False,
                           schema="index bigint, time timestamp_ntz, lat double, lon double, "
                                  "price double")
    return back


@case("s10_json", "SELECT kind, value FROM series", ("series",))
def json_rows(spark, sf_dir):
    path = scratch(spark, "series") + ".json"
    # several part files, each of many lines
    tables.write_json(series(spark, sf_dir).select("kind", "value").repartition(4), path)
    return tables.read_json(spark, path, schema="kind string, value double")


@case("s11_text", "SELECT p_name AS value FROM part")
def text_lines(spark, sf_dir):
    path = scratch(spark, "names") + ".txt"
    tables.write_text(table(spark, sf_dir, "part"), path, "p_name")
    return tables.read_text(spark, path, wholetext=False)


@case("s12_read_geojson", "SELECT id, value, kind, lon, lat FROM points", POINTS)
def geojson(spark, sf_dir):
    path = scratch(spark, "points") + ".geojsonl"
    tables.write_geo_data_frame(points(spark, sf_dir), path)
    return tables.read_geo_data_frame(spark, path).drop("geometry")


def documents_of(features):
    """part, value: feature collections over several lines each, four of every 10,000 ids."""
    number = F.get_json_object("value", "$.properties.id").cast("bigint")
    part = F.floor(number / 10_000) * 4 + F.pmod(number, F.lit(4))
    return features.groupBy(part.alias("part")).agg(F.concat(
        F.lit('{"type": "FeatureCollection",\n"features": [\n'),
        F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]}")).alias("value"))


@case("s12_geojson_document", "SELECT id, value, kind, lon, lat FROM points", POINTS)
def geojson_document(spark, sf_dir):
    path = scratch(spark, "points") + ".geojson"
    whole = documents_of(tables.feature_json(points(spark, sf_dir)))
    whole.write.partitionBy("part").text(path)
    return tables.read_geo_data_frame(spark, path).drop("geometry")


@case("s12_geojson_mixed", """SELECT id, value, kind, lon, lat,
  CASE id % 5 WHEN 0 THEN 'GeometryCollection: Point 1, LineString 1' WHEN 1 THEN 'LineString' ELSE 'Point'
  END AS type FROM points""", POINTS)
def geojson_mixed(spark, sf_dir):
    """Lines of features, collections on a line and documents of many lines, one after the other."""
    path = scratch(spark, "mixed") + ".geojson"
    rows = points(spark, sf_dir)
    spot = point_geometry(F.col("lon"), F.col("lat"))
    line = F.struct(F.lit("LineString").alias("type"), F.array(F.concat(
        spot["coords"][0], F.array(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))))).alias("coords"))
    shape = (F.when(F.col("id") % 5 == 0, collected(F.array(spot, line)))
             .when(F.col("id") % 5 == 1, line).otherwise(spot))
    features = tables.feature_json(rows.withColumn("geometry", shape))
    number = F.get_json_object("value", "$.properties.id").cast("bigint")
    part = F.floor(number / 100)
    breaks = F.when(part % 3 == 1, "\n").otherwise("")
    # of every 100 ids one kind of layout
    text = features.groupBy(part.alias("part")).agg(
        F.array_join(F.collect_list("value"), "\n").alias("lines"),
        F.concat(F.lit('{"type":"FeatureCollection",'), F.first(breaks), F.lit('"features":['),
                 F.array_join(F.collect_list(F.concat(F.col("value"), breaks)), ","), F.lit("]}")
                 ).alias("whole"))
    text.select(F.when(F.col("part") % 3 == 0, F.col("lines")).otherwise(F.col("whole")).alias("value")
                ).write.text(path)
    return tables.read_geo_data_frame(spark, path).select(
        "id", "value", "kind", "lon", "lat", F.col("geometry.type").alias("type"))


@case("s14_object_json", "SELECT id, value, kind, lon, lat FROM points", POINTS)
def json_object(spark, sf_dir):
    path = scratch(spark, "points") + ".json"
    tables.write_object(points(spark, sf_dir).repartition(4), path)
    return tables.read_object(spark, path)


@case("s14_object_geojson", "SELECT id, value, kind, lon, lat FROM points", POINTS)
def geojson_object(spark, sf_dir):
    path = scratch(spark, "points") + ".geojson"
    tables.write_object(points(spark, sf_dir).repartition(4), path)
    return tables.read_object(spark, path).drop("geometry")


@case("s14_object_formats", "SELECT id, value, kind, lon, lat FROM points", POINTS)
def objects(spark, sf_dir):
    path = scratch(spark, "points") + ".parquet"
    tables.write_object(points(spark, sf_dir), path)
    return tables.read_object(spark, path)


@case("s15_names_to_timestamps", """SELECT o_orderkey,
  CASE o_orderkey % 5 WHEN 0 THEN o_orderdate + INTERVAL 11 HOUR WHEN 1 THEN o_orderdate
    WHEN 2 THEN date_trunc('month', o_orderdate)::TIMESTAMP
    WHEN 3 THEN date_trunc('year', o_orderdate)::TIMESTAMP END AS first,
  CASE o_orderkey % 5 WHEN 1 THEN date_trunc('month', o_orderdate)::TIMESTAMP END AS second
FROM orders""")
def stamps(spark, sf_dir):
    day = F.col("o_orderdate")
    text = F.concat(F.lit("L4-"), F.element_at(F.array(
        F.concat(F.date_format(day, "yyyyMMdd"), F.lit("110000")),
        F.concat(F.date_format(day, "yyyyMMdd"), F.lit("-"), F.date_format(day, "yyyyMM")),
        F.date_format(day, "yyyyMM"), F.date_format(day, "yyyy"), F.lit("none")),
        (F.col("o_orderkey") % 5 + 1).cast("int")), F.lit("-fv2.nc"))
    first, second = names.timestamps_in_name(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first"),
                                                 second.alias("second"))


@case("s16_filter_fileset", """SELECT c_name AS name FROM customer
WHERE (c_name LIKE '%7' OR c_name LIKE 'Customer#00000001_') AND NOT c_name LIKE '%17'""")
def fileset(spark, sf_dir):
    files = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return names.filter_fileset(files, ["*7", "Customer#00000001?"], ["*17"])


@case("s17_csv_preview", "SELECT * FROM points ORDER BY id LIMIT 10000", POINTS)
def preview(spark, sf_dir):
    return tables.preview(points(spark, sf_dir).orderBy("id"))


@case("s19_feature_collection", """SELECT id, row_number() OVER (ORDER BY id) - 1 AS idx,
  CAST(4 AS BIGINT) AS res, lon, lat, kind FROM points""", POINTS)
def collection(spark, sf_dir):
    lines = tables.feature_collection(points(spark, sf_dir), res_id=4, id_column="id", order="id")
    return lines.select(F.from_json("value", """id bigint, _idx bigint, _resId bigint,
        geometry struct<coordinates:array<double>>, properties struct<kind:string>""")
                        .alias("f")).select(
        "f.id", F.col("f._idx").alias("idx"), F.col("f._resId").alias("res"),
        F.col("f.geometry.coordinates")[0].alias("lon"),
        F.col("f.geometry.coordinates")[1].alias("lat"), "f.properties.kind")


@case("s9_cube_rows_of_variables", """WITH t AS (SELECT time,
    row_number() OVER (ORDER BY time) - 1 AS p FROM (SELECT DISTINCT time FROM cube_coarse))
SELECT p * 72 + CAST(round((lat + 75) / 30) AS BIGINT) * 12
    + CAST(round((lon + 165) / 30) AS BIGINT) AS index, time, lat, lon, qty
FROM cube_coarse JOIN t USING (time)""", COARSE)
def indexed_rows(spark, sf_dir):
    return tables.cube_rows(select_var(cube_coarse(spark, sf_dir), "qty"))
