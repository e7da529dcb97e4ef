"""GeoJSON text of any layout, cut anywhere."""

import json
import random

import pytest

from isograd.model import ValidationError
from isograd.operators.features import data_frame_query
from isograd.sources import geojson, tables


def feature(i, rng):
    kind = rng.choice(["Point", "LineString", "Polygon", "MultiPoint", "GeometryCollection", None])
    spot = [round(rng.uniform(-9, 9), 2), float(i)]
    shapes = {"Point": spot, "LineString": [spot, [1.0, 2.0]], "MultiPoint": [spot, [3.0, 4.0]],
              "Polygon": [[[0.0, 0.0], spot, [5.0, 6.0], [0.0, 0.0]]]}
    geometry = None if kind is None else {"type": kind, "coordinates": shapes.get(kind)}
    if kind == "GeometryCollection":
        geometry = {"type": kind, "geometries": [{"type": k, "coordinates": shapes[k]}
                                                 for k in ("Point", "Polygon")]}
    name = rng.choice(['plain', 'quote " inside', 'brace } and { [', 'back\\slash\\', '{"type":"Feature"}',
                       '"type": "Feature", é€😀', '', 'a\nline, \\"'])
    members = {"type": "Feature", "properties": {"id": i, "name": name, "list": [{"a": 1}, {"b": [2]}]},
               "geometry": geometry}
    if rng.random() < 0.3:
        members["links"] = [{"href": "x}{"}, {"type": "Other"}]
    order = list(members)
    rng.shuffle(order)
    return {k: members[k] for k in order}


def document(features, rng):
    """Text of features in a random layout."""
    layout = rng.choice(["lines", "collection", "pretty", "mixed"])
    if layout == "lines":
        return "".join(json.dumps(f, ensure_ascii=False) + "\n" for f in features)
    whole = {"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "x"}},
             "bbox": [0, 1, 2, 3], "features": features, "note": "}]"}
    if layout == "collection":
        return json.dumps(whole) + rng.choice(["", "\n", " \n\n"])
    if layout == "pretty":
        return "﻿" + json.dumps(whole, indent=rng.choice([1, 2, "\t"]), ensure_ascii=False)
    half = len(features) // 2
    whole["features"] = features[:half]
    return (json.dumps(whole, indent=1) + ",\r\n\x1e" + "".join(json.dumps(f) + " " for f in features[half:])
            + '{"type":"FeatureCollection","features":[]}')


@pytest.mark.parametrize("most", ["128m", "700", "90"])
def test_nothing_is_lost(spark, tmp_path, most):
    rng = random.Random(most)
    expected = {}
    for d in range(6):
        features = [feature(1000 * d + i, rng) for i in range(rng.choice([1, 2, 30, 60]))]
        expected |= {f["properties"]["id"]: f for f in features}
        (tmp_path / f"part{d}.geojson").write_text(document(features, rng), encoding="utf-8", newline="")
    keys = {"spark.sql.files.maxPartitionBytes": most, "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        cut = [json.loads(r.value) for r in geojson.cut_features(spark, str(tmp_path)).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(cut) == len(expected)
    for f in cut:
        want = dict(expected[f["properties"]["id"]])
        got = dict(f)
        # objects in arrays of a feature's own members are no part of it; of its properties they are
        for links in (want, got):
            links.pop("links", None)
        assert got == want


def test_table_of_shapes(spark, tmp_path):
    rng = random.Random(3)
    features = [feature(i, rng) for i in range(80)]
    (tmp_path / "all.geojson").write_text(json.dumps(
        {"type": "FeatureCollection", "features": features}, indent=1))
    (tmp_path / "one.geojson").write_text('{"type": "Point", "coordinates": [7, 8, 9]}\n'
                                          '{"type": "MultiLineString", "coordinates": [[[1, 2], [3, 4]]]}')
    df = tables.read_geo_data_frame(spark, str(tmp_path))
    assert df.count() == 82
    by_id = {r.id: r for r in df.collect() if r.id is not None}
    for f in features:
        row, shape = by_id[f["properties"]["id"]], f["geometry"]
        assert row.name == f["properties"]["name"]
        if shape is None:
            assert row.geometry is None and row.lon is None
        elif shape["type"] == "Point":
            assert [row.lon, row.lat] == shape["coordinates"]
        elif shape["type"] == "GeometryCollection":
            assert row.geometry.type == "GeometryCollection: Point 1, Polygon 1"
            assert row.geometry.coords[0][0] == tuple(shape["geometries"][0]["coordinates"])
        else:
            assert row.geometry.type == shape["type"]
    lone = {(r.geometry.type, r.lon) for r in df.collect() if r.id is None}
    assert lone == {("Point", 7.0), ("MultiLineString", None)}
    # and back: the same shapes once more
    again = str(tmp_path / "again.geojson")
    tables.write_geo_data_frame(df, again)
    assert sorted(map(str, tables.read_geo_data_frame(spark, again).select(df.columns).collect())) == sorted(
        map(str, df.collect()))


def test_collections_are_tested_by_their_members(spark, tmp_path):
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "Feature", "properties": {"id": 1}, "geometry": {
        "type": "GeometryCollection", "geometries": [
            {"type": "Point", "coordinates": [1, 1]},
            {"type": "LineString", "coordinates": [[5, 5], [7, 7]]}]}}))
    df = tables.read_geo_data_frame(spark, str(tmp_path))
    for test, region, count in (("intersects", "0,0,2,2", 1), ("intersects", "4,4,6,6", 1),
                                ("intersects", "2,2,3,3", 0), ("disjoint", "2,2,3,3", 1),
                                ("disjoint", "0,0,2,2", 0), ("within", "0,0,2,2", 0),
                                ("within", "0,0,8,8", 1)):
        assert data_frame_query(df, f"@{test}('{region}')").count() == count, (test, region)


@pytest.mark.parametrize("text", ['[{"type":"Feature"}]', 'words {"type":"Feature"}', '{"type":"Topology"}',
                                  '{"type":"Feature"', '{"type":"Feature","a":"}', '{"type":"Feature"}} {}',
                                  '{"type":"GeometryCollection","geometries":[]}'])
def test_other_text_fails(spark, tmp_path, text):
    (tmp_path / "x.geojson").write_text(text)
    with pytest.raises(Exception) as caught:
        geojson.cut_features(spark, str(tmp_path)).collect()
    assert isinstance(caught.value, ValidationError) or "GeoJSON" in str(caught.value) \
        or "objects" in str(caught.value)


def test_empty_files(spark, tmp_path):
    (tmp_path / "x.geojson").write_text(" \n")
    (tmp_path / "y.geojson").write_text('{"type":"FeatureCollection","features":[]}')
    assert geojson.cut_features(spark, str(tmp_path)).count() == 0
    assert tables.read_geo_data_frame(spark, str(tmp_path)).columns == ["lon", "lat", "geometry"]
