import datetime as dt

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from isograd import Cube, ValidationError
from isograd.operators import anomaly, arithmetic
from isograd.operators.aggregate import long_term_average


def values(cube, name="first"):
    return {r[name] for r in cube.part_of(name).df.collect()}


def months(year, n=12):
    return [dt.datetime(year + m // 12, m % 12 + 1, 1) for m in range(n)]


@pytest.mark.parametrize("op, expected", [
    ("+2, -2, *3, /3, *4", 4), ("exp, log, *10, log10, *2, log2, +1.5", 2.5),
    ("exp, -1, log1p, +3", 4), ("-1, log", None), ("/0", None),
])
def test_arithmetics(make, op, expected):
    out = values(arithmetic.ds_arithmetics(make([0], [0], first=1.0), op))
    assert out == {None} if expected is None else out.pop() == pytest.approx(expected)


def test_unknown_arithmetic(make):
    for bad in ("not", "^2", "+x", ""):
        with pytest.raises(ValidationError, match="not implemented"):
            arithmetic.ds_arithmetics(make([0], [0], first=1.0), bad)


def test_diff_of_common_variables_and_labels(make):
    a = make([0, 10], [0], months(2000), first=3.0, third=1.0)
    b = make([0, 10], [0], months(2000)[:6], first=1.0, second=1.0)
    out = arithmetic.diff(a, b)
    assert out.variables == ("first",) and out.df.count() == 12 and values(out) == {2.0}


def test_diff_by_position(make):
    a = make([0], [0], months(2000), first=np.arange(12.0).reshape(12, 1, 1))
    b = make([0], [0], months(2003), first=1.0)
    rows = arithmetic.diff(a, b).df.orderBy("time").collect()
    assert [(r.time, r["first"]) for r in rows] == [(i, i - 1.0) for i in range(12)]


def test_diff_broadcast(make):
    a = make([0, 10], [0], months(2000), first=3.0)
    assert arithmetic.diff(a, make([0, 10], [0], first=1.0)).df.count() == 24
    single = make([0, 10], [0], [dt.datetime(1990, 1, 1)], first=1.0)
    assert values(arithmetic.diff(a, single)) == {2.0}


def test_compute_table(spark):
    i = F.col("id")
    df = spark.range(11).select((i * 1.0).alias("s1"), (i * -0.2).alias("s2"), (i * 0.2).alias("s3"))
    script = "_a = 3 * s2 - 4 * s3\na1 = 1 + 2 * s1 + _a\na2 = 2 + 3 * s1 + _a"
    out = arithmetic.compute_data_frame(df, script)
    assert out.columns == ["a1", "a2"]
    row = out.orderBy("a1").collect()[5]
    assert row.a1 == pytest.approx(1 + 10 - 3 - 4) and row.a2 == pytest.approx(2 + 15 - 7)
    kept = arithmetic.compute_data_frame(df, script, copy=True)
    assert kept.columns == ["s1", "s2", "s3", "a1", "a2"] and kept.count() == 11


def test_compute_aggregates(spark):
    df = spark.range(11).select((F.col("id") * 1.0).alias("s1"))
    out = arithmetic.compute_data_frame(df, "m = avg(s1)\ntwice = m * 2")
    assert [tuple(r) for r in out.collect()] == [(5.0, 10.0)]
    assert arithmetic.compute_data_frame(df, "m = avg(s1)", copy=True).count() == 11
    with pytest.raises(ValidationError):
        arithmetic.compute_data_frame(df, "avg(s1)")


def test_compute_dataset_with_other_resources(make):
    a, b = make([0], [0], first=1.0), make([0], [0], second=2.0)
    out = arithmetic.compute_dataset(None, "third = 6 * r1.first - 3 * r2.second",
                                     context={"r1": a, "r2": b})
    assert values(out, "third") == {0.0} and out.dims == ("lat", "lon")
    copied = arithmetic.compute_dataset(a, "_x = first * 2; x = _x + 1", copy=True)
    assert copied.variables == ("first", "x")


def line(spark, **columns):
    size = len(next(iter(columns.values())))
    rows = [(i, *(v[i] for v in columns.values())) for i in range(size)]
    schema = "time int, " + ", ".join(f"{c} double" for c in columns)
    return Cube.of(spark.createDataFrame(rows, schema), ["time"])


def test_merge(spark):
    a = line(spark, A=[1.0, 2.0, 3.0], B=[1.0, None, 3.0])
    b = line(spark, B=[1.0, 2.0, None], C=[7.0, 8.0, 9.0])
    out = arithmetic.merge(a, b, a, None)
    rows = out.df.orderBy("time").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 1, 7), (1, 2, 2, 8), (2, 3, 3, 9)]
    assert arithmetic.merge(a, a) is a
    with pytest.raises(ValidationError):
        arithmetic.merge(None, None)


def test_merge_conflicts_fail_the_query(spark):
    a, b = line(spark, A=[1.0, 2.0]), line(spark, A=[1.0, 5.0])
    with pytest.raises(PySparkException, match="conflicting values"):
        arithmetic.merge(a, b).df.collect()
    gap = line(spark, A=[1.0, None])
    assert arithmetic.merge(a, gap).df.count() == 2
    with pytest.raises(PySparkException, match="conflicting values"):
        arithmetic.merge(a, gap, compat="equals").df.collect()


def test_merge_joins(spark):
    a, b = line(spark, A=[1.0, 2.0, 3.0]), line(spark, B=[4.0, 5.0])
    for join, rows in (("outer", 3), ("inner", 2), ("left", 3), ("right", 2)):
        assert arithmetic.merge(a, b, join=join).df.count() == rows
    with pytest.raises(ValidationError, match="not equal"):
        arithmetic.merge(a, b, join="exact")


CLIMATE = [1, 1, 1, 1, 2, 2, 2, 2, 0, 0, 0, 0]
INDEX = [-.2, -.4, -.6, -.8, -.6, -.2, .2, .6, .8, .6, .4, .2, -.2, -.4, -.6, -.8, -.6, -.2, .2, .6]


@pytest.fixture(scope="module")
def sea(make):
    return make([-60, -20, 0, 20], np.linspace(-170, 170, 18), months(2001, 24), first=1.0)


@pytest.fixture(scope="module")
def climatology(make):
    """Labels are month numbers, which only count by position."""
    return make([-60, -20, 0, 20], np.linspace(-170, 170, 18), list(range(1, 13)),
                first=np.array(CLIMATE, dtype=float).reshape(12, 1, 1))


def test_index_series(sea, climatology):
    out = anomaly.enso_nino34(sea, "first", climatology, threshold=0.5).orderBy("time").collect()
    assert [r.time for r in out] == months(2001, 24)[2:22]
    np.testing.assert_allclose([r[1] for r in out], INDEX, atol=1e-12)
    assert [r["El Nino"] for r in out] == [v > 0.5 for v in INDEX]
    assert [r["La Nina"] for r in out] == [v < -0.5 for v in INDEX]


@pytest.mark.parametrize("region", ["N1+2", "N3", "N3.4", "N34", "n34", "N4", "custom"])
def test_regions(sea, climatology, region):
    out = anomaly.enso(sea, "first", climatology, region, custom_region="-20, -10, 20, 10")
    assert out.columns[1].startswith("ENSO ")
    np.testing.assert_allclose([r[1] for r in out.orderBy("time").collect()], INDEX, atol=1e-12)
    with pytest.raises(ValidationError):
        anomaly.enso(sea, "first", climatology, "N5")


def test_oni_window(sea, climatology):
    assert anomaly.oni(sea, "first", climatology).count() == 22


def test_anomaly_external_checks(make, sea, climatology):
    out = anomaly.anomaly_external(sea, climatology, "*2")
    assert values(out) == {0.0, 1.0, 2.0}
    with pytest.raises(ValidationError, match="monthly climatology"):
        anomaly.anomaly_external(sea, make([0], [0], [1, 2], first=1.0))
    days = [dt.datetime(2001, 1, d) for d in range(1, 5)]
    with pytest.raises(ValidationError, match="P1D"):
        anomaly.anomaly_external(make([0], [0], days, first=1.0), climatology)


def test_anomaly_of_own_climatology_is_zero(sea):
    assert values(anomaly.anomaly_external(sea, long_term_average(sea))) == {0.0}


def test_anomaly_internal(make):
    cube = make([0, 40], [0], months(2000), first=np.arange(12.0).reshape(12, 1, 1))
    assert sum(r["first"] for r in anomaly.anomaly_internal(cube).df.collect()) == 0
    out = anomaly.anomaly_internal(cube, "2000-01-01, 2000-03-01", "-10, -10, 10, 10")
    assert out.df.where("time = timestamp_ntz'2000-02-01'").first()["first"] == 0


def test_merge_of_variables_with_fewer_dims(spark):
    """With broadcast_equals a variable per row may stand for a variable per cell, if all cells agree."""
    cells = [(y, x, 10.0 * y) for y in range(3) for x in range(4)]
    wide = Cube.of(spark.createDataFrame(cells, "y int, x int, v double"), ["y", "x"])

    def narrow(values):
        return Cube.of(spark.createDataFrame(values, "y int, v double, w int"), ["y"])

    values = [(y, 10.0 * y, y) for y in range(3)]
    for pair in ((wide, narrow(values)), (narrow(values), wide)):
        out = arithmetic.merge(*pair, compat="broadcast_equals")
        homes = {v: p.dims for p in out.parts for v in p.variables}
        assert homes == {"v": ("y", "x"), "w": ("y",)}
        assert out.part_of("v").df.count() == 12 and out.part_of("w").df.count() == 3
    none = Cube.of(spark.createDataFrame([(y, x, v if y else None) for y, x, v in cells],
                                         "y int, x int, v double"), ["y", "x"])
    arithmetic.merge(none, narrow([(0, None, 0), *values[1:]]), compat="broadcast_equals")
    sparse = Cube.of(wide.df.where("y <> 1 OR x <> 2"), ["y", "x"])
    for bad, with_what in ((narrow([(0, 1.0, 0), *values[1:]]), wide), (narrow(values), none),
                           (narrow(values), sparse), (narrow([*values, (7, 70.0, 7)]), wide)):
        with pytest.raises(ValidationError, match="conflicting values"):
            arithmetic.merge(bad, with_what, compat="broadcast_equals")
    other = Cube.of(spark.createDataFrame([(1, 2.0)], "z int, v double"), ["z"])
    for compat, pair in (("equals", (wide, narrow(values))), ("broadcast_equals", (wide, other))):
        with pytest.raises(ValidationError, match="conflicting dimensions"):
            arithmetic.merge(*pair, compat=compat)
