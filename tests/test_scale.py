"""Paths that only large data take: long axes, tables too large to broadcast, hot groups."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from isograd import Cube
from isograd.functions import quantile
from isograd.functions.quantile import quantiles
from isograd.operators import aggregate, anomaly, arithmetic, axis, regrid, select, stats, subset
from isograd.operators.fill import fillna, in_ranges
from isograd.sources import cubes

TIMES = [dt.datetime(2000 + i // 12, i % 12 + 1, 1) for i in range(24)]


@pytest.fixture
def large(monkeypatch):
    """No axis is short enough to keep, no table small enough to broadcast."""
    monkeypatch.setattr(axis, "KEPT_LABELS", 0)
    monkeypatch.setattr(axis, "BROADCAST_ROWS", 0)


@pytest.fixture
def pair(make):
    """Two cubes of random values with gaps, made anew so that nothing is known about the axes."""
    def build(times=TIMES, seed=1):
        rng = np.random.default_rng(seed)
        values = np.where(rng.random((len(times), 4, 8)) < 0.1, np.nan, rng.random((len(times), 4, 8)))
        return make(np.linspace(-67.5, 67.5, 4), np.linspace(-157.5, 157.5, 8), times, first=values)

    return build


def rows(cube, digits=9):
    part = cube.only_part
    return sorted((tuple(r[d] for d in part.dims),
                   tuple(None if r[v] is None else round(r[v], digits) for v in part.variables))
                  for r in part.df.collect())


def operators(pair, make):
    coarse = make(np.linspace(-60, 60, 3), np.linspace(-150, 150, 6), first=0.0)
    later = [t.replace(year=t.year + 5) for t in TIMES]
    return {
        "coregister": lambda: regrid.coregister(coarse, pair()),
        "correlation": lambda: stats.pearson_correlation(pair(), pair(later, 2), "first", "first"),
        "positional diff": lambda: arithmetic.diff(pair(), pair(later, 2)),
        "anomaly": lambda: anomaly.anomaly_external(pair(), aggregate.long_term_average(pair())),
        "argmax": lambda: aggregate.temporal_aggregation(pair(), "argmax", "QS"),
        "gaps": lambda: aggregate.temporal_aggregation(
            subset.subset_temporal_index(pair(TIMES[:2] + TIMES[6:]), 0, 9), "max", "MS", True),
        "nearest": lambda: select.sel(pair(), point="10, 20", time="2000-05-20"),
        "box": lambda: subset.subset_spatial(pair(), "-60, -10, 30, 20"),
    }


@pytest.mark.parametrize("name", ["coregister", "correlation", "positional diff", "anomaly",
                                  "argmax", "gaps", "nearest", "box"])
def test_large_and_small_ways_agree(name, pair, make, monkeypatch):
    small = rows(operators(pair, make)[name]())
    monkeypatch.setattr(axis, "KEPT_LABELS", 0)
    monkeypatch.setattr(axis, "BROADCAST_ROWS", 0)
    assert rows(operators(pair, make)[name]()) == small and small


def test_no_broadcast_beyond_the_bound(large, pair, spark):
    out = anomaly.anomaly_external(pair(), aggregate.long_term_average(pair()))
    plan = out.df._jdf.queryExecution().logical().toString()
    assert plan.count("strategy=broadcast") <= 1  # the twelve months


def test_hot_series_is_split(spark):
    """One series holds nearly all rows; its order column is split into ranges."""
    n = 4000
    values = [float(i) if i % 97 == 0 else None for i in range(n)]
    data = [(i, "hot" if i % 50 else "cold", v) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, "i int, k string, v double")
    out = fillna(df, method="ffill", order="i", partition_by=["k"], columns=["v"])
    expected, last = {}, {}
    for i, k, v in data:
        last[k] = v if v is not None else last.get(k)
        expected[i] = last[k]
    assert {r.i: r.v for r in out.collect()} == expected
    assert "__bucket" in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("partitions", [16, 200])
@pytest.mark.parametrize("keys", [[], ["k"]])
def test_fill_of_a_wide_table(spark, partitions, keys):
    """Columns that are not filled, many ranges and ties: the same as one plain window per series."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(0, 1_000_000, 1, 12).selectExpr(
        "id", "hash(id) % 400000 AS i", "pmod(hash(id, 3), 7) AS k",
        "CASE WHEN pmod(hash(id, 5), 60) = 0 THEN id * 1.5D END AS v",
        "CASE WHEN id > 900000 THEN id END AS w", "concat('text ', id) AS more", "id * 2 AS other")
    order = Window.partitionBy(*keys).orderBy("i", "id")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        for method, limit, window in (
                ("ffill", None, order.rowsBetween(Window.unboundedPreceding, 0)),
                ("ffill", 9, order.rowsBetween(-9, 0)), ("bfill", 40, order.rowsBetween(0, 40))):
            pick = F.last if method == "ffill" else F.first
            want = df.select("id", *(pick(c, ignorenulls=True).over(window).alias(c) for c in "vw"),
                             "more", "other")
            got = fillna(df, method=method, limit=limit, order="i", partition_by=keys,
                         columns=["v", "w"])
            assert got.columns == df.columns
            got = got.select(want.columns)
            assert got.count() == 1_000_000
            assert got.exceptAll(want).count() == 0, (method, limit)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_an_axis_of_ten_million_labels(spark):
    """Facts and positions without a task that sees all labels."""
    n = 10_000_000
    df = spark.range(0, n, 1, 8).selectExpr(
        "CAST(id * 3 + id % 2 + CASE WHEN id > 7000000 THEN 11 ELSE 0 END AS double) AS x", "id AS v")
    cube = Cube.of(df, ["x"])
    info = axis.axis_info(cube, "x")["x"]
    last = (n - 1) * 3.0 + 1 + 11
    assert (info.size, info.first, info.second, info.last) == (n, 0.0, 4.0, last)
    assert (info.min_step, info.max_step, info.labels) == (2.0, 15.0, None)
    assert not info.equidistant()
    numbered = axis.positions(cube, "x", "at")
    plan = numbered._jdf.queryExecution().executedPlan().toString()
    assert "Exchange SinglePartition" not in plan
    off = numbered.join(df, "x").where("at <> v")
    assert numbered.count() == n and off.count() == 0
    assert axis.label_at(cube, "x", 7_000_002) == 7_000_002 * 3 + 11
    assert axis.label_at(cube, "x", n) is None
    row = {r.dim: r for r in cubes.describe(cube).collect()}["x"]
    assert (row.size, row.first, row.last, row.step) == (n, "0.0", str(last), 4.0)


@pytest.mark.parametrize("kept", [4096, 3])
def test_short_and_long_axes_have_the_same_facts(make, spark, monkeypatch, kept):
    whole = make([-10, 10, 31], [0, 1, 2, 3, 7], TIMES, first=1.0)
    known = {d: axis.axis_info(whole, d)[d] for d in ("lat", "lon", "time")}
    monkeypatch.setattr(axis, "KEPT_LABELS", kept)
    again = make([-10, 10, 31], [0, 1, 2, 3, 7], TIMES, first=1.0)
    for d, a in known.items():
        b = axis.axis_info(again, d)[d]
        assert (a.size, a.first, a.second, a.last, a.min_step, a.max_step, a.temporal) == (
            b.size, b.first, b.second, b.last, b.min_step, b.max_step, b.temporal)
    names = Cube.of(spark.createDataFrame([(k, 1) for k in "abcde"], "name string, v int"), ["name"])
    info = axis.axis_info(names, "name")["name"]
    assert (info.size, info.first, info.labels) == (5, None, None)
    assert axis.label_at(names, "name", 3) == "d"


def test_quantiles_keep_every_group(spark):
    """NULL keys, groups without values and infinities are the same on both ways."""
    inf = float("inf")
    data = ([("a", float(i % 7) / 3) for i in range(60)] + [(None, float(i)) for i in range(40)]
            + [("gone", None)] * 30 + [("ends", v) for v in [-inf, inf, 1.0, 2.5] * 9 + [0.1] * 9]
            + [("one", 4.0)])
    df = spark.createDataFrame(data, "k string, v double")
    for keys in (["k"], []):
        small = {tuple(r[:-1]): r.q for r in quantiles(df, keys, "v", [0, 0.1, 0.5, 0.83, 1]).collect()}
        large = {tuple(r[:-1]): r.q for r in quantiles(df, keys, "v", [0, 0.1, 0.5, 0.83, 1],
                                                       limit=3, buckets=4).collect()}
        assert repr(sorted(small.items(), key=str)) == repr(sorted(large.items(), key=str))
        assert len(small) == (5 if keys else 1)
    none = quantiles(df.where("k = 'gone'"), [], "v", [0.5], group_rows=10, limit=3).collect()
    assert [r.q for r in none] == [None]


def test_medians_keep_missing_groups(make, monkeypatch):
    values = np.arange(24.0).reshape(3, 2, 4)
    values[:, 0, 1] = np.nan
    cube = make([-10, 10], [0, 1, 2, 3], TIMES[:3], first=values, second=values * 2)
    small = rows(aggregate.reduce(cube, dim="time", method="median"))
    monkeypatch.setattr(aggregate, "GROUP_ROWS", 1)
    monkeypatch.setattr(quantile, "GROUP_ROWS", 1)
    assert rows(aggregate.reduce(cube, dim="time", method="median")) == small
    assert ((-10.0, 1.0), (None, None)) in small


def test_a_cut_axis_is_still_the_same_axis(make, monkeypatch):
    """Facts of a long axis that was cut are computed, and need not be equal to the last bit."""
    monkeypatch.setattr(axis, "KEPT_LABELS", 0)
    lats, lons = np.arange(-44.7, 45, 0.3), np.arange(0.1, 3, 0.7)
    values = np.random.default_rng(1).random((4, len(lats), len(lons)))

    def whole():
        return make(lats, lons, TIMES[:4], first=values)

    box = "0, -29.9, 3, 29.9"  # padded by half a pixel
    cut = subset.subset_spatial(whole(), box)
    keep = np.abs(lats) < 30.05
    anew = make(lats[keep], lons, TIMES[:4], first=values[:, keep])
    axis.axis_info(anew, "lat", "lon")
    out = stats.pearson_correlation(cut, anew, "first", "first")
    assert out.df.count() == keep.sum() * len(lons)


def test_ranges_are_even_at_many_partitions(spark):
    """A thousand ranges of a skewed order column, a tenth of it one value."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(500_000).selectExpr(
        "CASE WHEN id % 10 = 0 THEN 77.0D ELSE pow(rand(5), 3) * 1000 END AS i", "id AS k")
    spark.conf.set("spark.sql.shuffle.partitions", "1000")
    try:
        ranged = in_ranges(df, "i", ["k"])
        sizes = [r["count"] for r in ranged.groupBy("__bucket").count().collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(sizes) == 1000 and max(sizes) <= 2 * 500
    assert "Filter(" not in ranged._jdf.queryExecution().optimizedPlan().toString()
