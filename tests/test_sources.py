import datetime as dt
import json
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from isograd import Cube, ValidationError
from isograd.operators.axis import axis_info
from isograd.sources import cubes, names, synthetic, tables
from isograd.suite.sources import documents_of

TIMES = [dt.datetime(2000 + i // 12, i % 12 + 1, 1) for i in range(18)]


@pytest.fixture(scope="module")
def cube(make):
    return make([-45, 45], [-90, 90], TIMES, first=np.arange(18.0).reshape(18, 1, 1))


def test_cube_round_trip(spark, cube, tmp_path):
    line = Cube.of(spark.createDataFrame([(1, 2.0)], "layer int, second double"), ["layer"])
    both = Cube((*cube.parts, *line.parts), {"title": "x"}, {"first": {"units": "K"}})
    path = str(tmp_path / "cube")
    cubes.write_cube(both, path)
    back = cubes.read_cube(spark, path)
    assert back.dims == ("time", "lat", "lon", "layer") and back.variables == ("first", "second")
    assert back.attrs["title"] == "x" and back.var_attrs["first"]["units"] == "K"
    assert back.part_of("first").select().df.exceptAll(cube.df).count() == 0
    assert axis_info(back, "time")["time"].size == 18
    assert cubes.read_cube(spark, path, ["first"]).variables == ("second",)


def test_time_range_prunes_folders(spark, cube, tmp_path):
    path = str(tmp_path / "cube")
    cubes.write_cube(cube, path)
    out = cubes.prune_by_time(cubes.read_cube(spark, path), "2000-11-01, 2001-02-01")
    assert out.df.select("time").distinct().count() == 4
    plan = spark._jvm.PythonSQLUtils.explainString(out.df._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [isnotnull(__year" in plan
    assert axis_info(out, "time")["time"].size == 4


def test_catalog(spark, cube, tmp_path):
    path = str(tmp_path / "cube")
    cubes.write_cube(cube, path)
    catalog = spark.createDataFrame([("a", "one", path), ("a", "two", path), ("b", "two", path)],
                                    "store_id string, data_id string, path string")
    assert cubes.find_data_store(catalog, "one") == {"store_id": "a", "path": path}
    assert cubes.find_data_store(catalog, "none") is None
    assert cubes.find_data_store(catalog, "two", "b")["store_id"] == "b"
    with pytest.raises(ValidationError, match="more than one"):
        cubes.find_data_store(catalog, "two")
    out = cubes.open_dataset(spark, catalog, "one", "2000-01-01, 2000-03-01", "0, 0, 170, 80")
    # half a pixel of padding reaches the western and southern cells
    assert out.df.select("time").distinct().count() == 3
    assert out.attrs["time_coverage_resolution"] == "P1M"
    local = cubes.open_dataset(spark, catalog, "one", force_local=True, local_ds_id="mine")
    assert local.df.count() == 72
    again = cubes.make_local(spark, cube, f"{path}.local", "mine")
    assert again.df.count() == 72
    with pytest.raises(ValidationError, match="no data store"):
        cubes.open_dataset(spark, catalog, "none")


def test_descriptor(cube):
    named = Cube(cube.parts, var_attrs={"first": {"units": "K", "long_name": "heat"}})
    out = cubes.descriptor(named)
    assert out["bbox"] == (-180, -90, 180, 90) and out["time_period"] == "P1M"
    assert "first (K), heat" in cubes.descriptor_text(named)
    assert {r.dim: r.size for r in cubes.describe(cube).collect()} == {
        "time": 18, "lat": 2, "lon": 2}


def test_read_csv(spark, tmp_path):
    file = tmp_path / "a.csv"
    file.write_text('# made by hand\ntime,Lat,LONG,name\n2020-02-08T11:40:53,50.0,10.2,"x,y"\n')
    df = tables.read_csv(spark, str(file), comment="#", quotechar='"', index_col="time")
    row = df.first()
    assert row.time == dt.datetime(2020, 2, 8, 11, 40, 53) and row.name == "x,y"
    assert row.geometry.coords[0][0].x == 10.2
    assert "geometry" not in tables.read_csv(spark, str(file), comment="#",
                                             parse_points=False).columns
    spaced = tmp_path / "b.txt"
    spaced.write_text("a   b\n1  2.5\n3      4.5\n")
    rows = tables.read_csv(spark, str(spaced), delim_whitespace=True).collect()
    assert [tuple(r) for r in rows] == [(1, 2.5), (3, 4.5)]


def test_write_csv_of_cube(spark, tmp_path):
    rows = [(t, la, lo, float(t * 100 + la + lo), 1.0) for t in (1, 2, 3) for la in (51.0, 51.2)
            for lo in (10.2, 11.4)]
    cube = Cube.of(spark.createDataFrame(rows, "time int, lat double, lon double, delta double, "
                                               "mean double"), ["time", "lat", "lon"])
    path = str(tmp_path / "out.csv")
    tables.write_csv(cube, path, columns="mean", delimiter=";")
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[0] == "index;time;lat;lon;mean" and "5;2;51.0;11.4;1.0" in lines
    assert [int(v.split(";")[0]) for v in lines if v[0].isdigit()] == list(range(12))
    gap = Cube.of(cube.df.where("not (time = 1 and lon = 11.4)"), ["time", "lat", "lon"])
    assert sorted(r["index"] for r in tables.cube_rows(gap).collect()) == [0, 2, *range(4, 12)]
    mixed = Cube((*cube.parts, *Cube.of(spark.createDataFrame([(1, 2.0)], "time int, e double"),
                                        ["time"]).parts))
    with pytest.raises(ValidationError, match="same dimensions"):
        tables.cube_rows(mixed)
    with pytest.raises(ValidationError):
        tables.write_csv(None, path)


def test_write_csv_of_table(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    tables.write_csv(spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double"), path,
                     na_rep="NA")
    back = {tuple(r) for r in spark.read.option("header", "true").csv(path).collect()}
    assert back == {("0", "a", "1.5"), ("1", "b", "NA")}
    tables.preview_csv(spark.range(50), str(tmp_path / "p.csv"), 7)
    assert spark.read.option("header", "true").csv(str(tmp_path / "p.csv")).count() == 7


GEOMETRIES = [
    ("Point", [1.0, 2.0]), ("LineString", [[0.0, 0.0], [1.0, 2.0]]),
    ("Polygon", [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]),
    ("MultiPoint", [[0.0, 0.0], [1.0, 2.0]]),
    ("MultiPolygon", [[[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]]),
]


def test_geojson(spark, tmp_path):
    features = [{"type": "Feature", "geometry": {"type": k, "coordinates": c},
                 "properties": {"A": i, "B": bool(i % 2), "C": i / 2}}
                for i, (k, c) in enumerate(GEOMETRIES)]
    file = tmp_path / "all.geojson"
    file.write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    df = tables.read_geo_data_frame(spark, str(file))
    assert df.count() == 5 and {"A", "B", "C", "lon", "lat", "geometry"} == set(df.columns)
    assert [tuple(r) for r in df.where("A = 0").select("lon", "lat").collect()] == [(1.0, 2.0)]
    out = str(tmp_path / "again.geojsonl")
    tables.write_geo_data_frame(df.drop("lon", "lat"), out)
    written = [json.loads(r.value) for r in spark.read.text(out).collect()]
    assert {(w["geometry"]["type"], str(w["geometry"]["coordinates"])) for w in written} == {
        (k, str(c)) for k, c in GEOMETRIES}
    assert tables.read_geo_data_frame(spark, out).count() == 5
    with pytest.raises(ValidationError, match='file extension ".bibo"'):
        tables.write_geo_data_frame(df, str(tmp_path / "x.bibo"))


def test_feature_collection(spark):
    rows = [(i, float(i), 2.0 * i) for i in range(4)]
    df = spark.createDataFrame(rows, "id int, lon double, lat double")
    lines = [json.loads(r.value) for r in tables.feature_collection(df, res_id=9).collect()]
    assert [(f["_idx"], f["id"], f["_resId"]) for f in lines] == [(i, i, 9) for i in range(4)]
    assert "_simp" not in lines[0] and lines[2]["geometry"]["coordinates"] == [2.0, 4.0]
    few = tables.feature_collection(df, max_num_display_geometries=3)
    assert all(json.loads(r.value)["_simp"] == 1 for r in few.collect())


def test_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.5)], "a bigint, b double")
    for name in ("x.parquet", "x.json", "x.orc"):
        path = str(tmp_path / name)
        tables.write_object(df, path)
        assert tuple(tables.read_object(spark, path).select("a", "b").first()) == (1, 2.5)
    assert tables.find_format("x.bin", "csv") == "CSV"
    for bad in (("x.bin", None), ("x.csv", "nc")):
        with pytest.raises(ValidationError):
            tables.find_format(*bad)
    text = str(tmp_path / "n.txt")
    tables.write_text(spark.createDataFrame([("hello",)], "value string"), text)
    assert tables.read_text(spark, text).first()[0].strip() == "hello"


@pytest.mark.parametrize("name, first, second", [
    ("L4-20100102030405.nc", dt.datetime(2010, 1, 2, 3, 4, 5), None),
    ("L4-201001020304-x.nc", dt.datetime(2010, 1, 2, 3, 4), None),
    ("20020401-20020406-PHY.nc", dt.datetime(2002, 4, 1), dt.datetime(2002, 4, 6)),
    ("a-200204-b-1999.nc", dt.datetime(2002, 4, 1), dt.datetime(1999, 1, 1)),
    ("a-99999999.nc", None, None), ("none.nc", None, None),
])
def test_timestamps(spark, name, first, second):
    columns = names.timestamps_in_name(F.lit(name))
    assert tuple(spark.range(1).select(*columns).first()) == (first, second)


def test_filesets(spark, tmp_path):
    files = spark.createDataFrame([("a.nc",), ("ab.nc",), ("b.txt",)], "name string")

    def kept(*args):
        return sorted(r.name for r in names.filter_fileset(files, *args).collect())

    assert kept() == ["a.nc", "ab.nc", "b.txt"]
    assert kept(["*.nc"]) == ["a.nc", "ab.nc"]
    assert kept(["*.nc", "b*"], ["a?.nc"]) == ["a.nc", "b.txt"]
    assert kept(None, ["*.nc"]) == ["b.txt"] and kept([]) == []
    (tmp_path / "x.nc").write_text("x")
    (tmp_path / "y.txt").write_text("y")
    assert [r.name for r in names.list_files(spark, str(tmp_path), "*.nc").collect()] == ["x.nc"]


def test_synthetic(spark):
    cube = synthetic.dummy_ds(spark, 36, 18, 4)
    info = axis_info(cube, "time", "lat", "lon")
    assert [info[d].size for d in ("time", "lat", "lon")] == [4, 18, 36]
    assert info["time"].first == dt.datetime(2014, 9, 6) and info["lat"].first == -85
    row = cube.df.agg(F.avg("temperature"), F.stddev("temperature"), F.min("precipitation"),
                      F.max("precipitation")).first()
    assert abs(row[0] - 15) < 1 and abs(row[1] - 8) < 1 and 0 <= row[2] < row[3] <= 10


def test_documents_are_bounded(spark):
    lines = spark.range(25_000).selectExpr(
        """'{"type": "Feature", "properties": {"id": ' || id || '}}' AS value""")
    sizes = [r.n for r in documents_of(lines).selectExpr(
        "size(split(value, 'properties')) - 1 AS n").collect()]
    assert len(sizes) == 12 and sum(sizes) == 25_000 and max(sizes) <= 2500


def test_axes_come_from_the_written_cells(make, tmp_path, spark):
    """The plan of the cells runs for the cells only, not once more per axis."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    cube = make([0, 1], [0, 1, 2], first=np.arange(6.0).reshape(2, 3))
    part = cube.only_part
    counted = replace(part, df=part.df.mapInArrow(count, part.df.schema))
    cubes.write_cube(replace(cube, parts=(counted,), known={}), str(tmp_path / "c"))
    runs = seen.value / 6
    assert runs <= 2  # boundaries are sampled, then rows are written
    again = cubes.read_cube(spark, str(tmp_path / "c"))
    assert sorted(r.lon for r in again.axis("lon").collect()) == [0, 1, 2]
    assert again.df.count() == 6
