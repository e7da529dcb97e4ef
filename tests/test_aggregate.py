import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from isograd import ValidationError
from isograd.functions.quantile import quantiles
from isograd.operators import aggregate
from isograd.operators.normalize import adjust_temporal_attrs


def months(year, n):
    return [dt.datetime(year + m // 12, m % 12 + 1, 1) for m in range(n)]


def days(start, n):
    return [start + dt.timedelta(days=i) for i in range(n)]


def by_time(cube, name="first"):
    rows = cube.part_of(name).df.orderBy("time").collect()
    return [(r.time, r[name]) for r in rows]


def test_monthly_average(make):
    values = np.arange(24.0).reshape(24, 1, 1)
    cube = adjust_temporal_attrs(make([0], [0], months(2000, 24), first=values))
    out = aggregate.long_term_average(cube)
    assert [v for _, v in by_time(out)] == [m + 6.0 for m in range(12)]
    assert [t for t, _ in by_time(out)] == months(2000, 12)
    assert out.attrs["climatology_bounds"] == (dt.datetime(2000, 1, 1), dt.datetime(2001, 12, 1))
    assert "long_term_average" in out.attrs["history"]


def test_daily_average_has_leap_day(make):
    cube = make([0], [0], days(dt.datetime(2000, 1, 1), 731), first=1.0)
    out = aggregate.long_term_average(cube)
    assert out.dims == ("dayofyear", "lat", "lon") and out.df.count() == 366


def test_seasonal_average(make):
    times = [dt.datetime(1999, 12, 1)] + [dt.datetime(y, m, 1) for y in (2000, 2001)
                                          for m in (3, 6, 9, 12)]
    cube = make([0], [0], times, first=np.arange(9.0).reshape(9, 1, 1))
    out = aggregate.long_term_average(cube)
    assert by_time(out) == [(dt.datetime(2000, m, 1), v) for m, v in (
        (3, 3.0), (6, 4.0), (9, 5.0), (12, 4.0))]
    uneven = make([0], [0], times + [dt.datetime(2002, 3, 2)], first=1.0)
    with pytest.raises(ValidationError, match="inconsistent seasons"):
        aggregate.long_term_average(uneven)
    with pytest.raises(ValidationError, match="timestamp"):
        aggregate.long_term_average(make([0], [0], [1, 2], first=1.0))


@pytest.mark.parametrize("method, expected", [
    ("mean", 14.0), ("max", 29.0), ("sum", 435.0), ("median", 14.5), ("std", 8.65544144839919),
    ("var", 74.91666666), ("argmax", 29), ("argmin", 1), ("first", 1.0), ("last", 29.0),
])
def test_methods(make, method, expected):
    values = np.arange(30.0)
    values[0] = np.nan
    if method == "median":
        values[1] = np.nan
        expected = 15.5
    if method == "mean":
        expected = values[1:].mean()
    if method in ("std", "var"):
        expected = getattr(np, method)(values[1:])
    cube = make([0], [0], days(dt.datetime(2001, 6, 1), 30), first=values.reshape(30, 1, 1))
    out = aggregate.temporal_aggregation(cube, method)
    assert by_time(out)[0][1] == pytest.approx(expected)


def test_sum_and_product_of_nothing(make):
    cube = make([0], [0], days(dt.datetime(2001, 6, 1), 3), first=np.nan)
    assert by_time(aggregate.temporal_aggregation(cube, "sum"))[0][1] == 0
    assert by_time(aggregate.temporal_aggregation(cube, "prod"))[0][1] == 1
    assert by_time(aggregate.temporal_aggregation(cube, "mean"))[0][1] is None


@pytest.mark.parametrize("period, bins, first", [
    ("MS", 12, dt.datetime(2000, 1, 1)), ("8MS", 2, dt.datetime(2000, 1, 1)),
    ("QS-DEC", 5, dt.datetime(1999, 12, 1)), ("QS-JUN", 5, dt.datetime(1999, 12, 1)),
    ("QS-FEB", 5, dt.datetime(1999, 11, 1)), ("8D", 46, dt.datetime(2000, 1, 1)),
    ("W", 53, dt.datetime(2000, 1, 2)), ("YS", 1, dt.datetime(2000, 1, 1)),
    ("AS-JUL", 2, dt.datetime(1999, 7, 1)), ("12H", 366, dt.datetime(2000, 1, 1)),
    ("ME", 12, dt.datetime(2000, 1, 31)), ("QE-NOV", 5, dt.datetime(2000, 2, 29)),
    ("W-WED", 53, dt.datetime(2000, 1, 5)),
])
def test_periods(make, period, bins, first):
    cube = make([0], [0], days(dt.datetime(2000, 1, 1), 366), first=1.0)
    out = by_time(aggregate.temporal_aggregation(cube, "mean", period, fill_empty=False))
    assert len(out) == bins and out[0][0] == first


def test_empty_bins_and_attributes(make):
    times = [dt.datetime(2000, m, 1) for m in (1, 2, 5)]
    cube = make([0, 10], [0], times, first=1.0)
    out = aggregate.temporal_aggregation(cube, "mean", "MS", fill_empty=True)
    rows = out.df.where("lat = 10").orderBy("time").collect()
    assert [r["first"] for r in rows] == [1, 1, None, None, 1]
    assert out.attrs["time_coverage_resolution"] == "P1M"
    assert out.attrs["time_coverage_end"] == "2000-05-01T00:00:00"
    with pytest.raises(ValidationError, match="period"):
        aggregate.temporal_aggregation(cube, "mean", "fortnight")
    with pytest.raises(ValidationError, match="method"):
        aggregate.temporal_aggregation(cube, "mode")


def test_reduce(make):
    values = np.array([[1, 2, np.nan], [4, 5, 6.0]])
    cube = make([0, 10], [0, 10, 20], first=values, second=1.0)
    out = aggregate.reduce(cube, "first", "lat, nothing")
    assert [r["first"] for r in out.part_of("first").df.orderBy("lon").collect()] == [2.5, 3.5, 6]
    assert out.part_of("second").dims == ("lat", "lon")
    for method, expected in (("mean", 3.6), ("min", 1), ("max", 6), ("sum", 18), ("median", 4)):
        assert aggregate.reduce(cube, "first", method=method).part_of("first").df.first()[0] == \
            pytest.approx(expected)
    with pytest.raises(ValidationError):
        aggregate.reduce(cube, method="mode")


def test_tseries_mean(make):
    values = np.array([[1, 2], [3, 6.0]])
    cube = make([0, 10], [0, 10], [1, 2], first=values)
    row = aggregate.tseries_mean(cube).df.where("time = 1").first()
    assert row["first"] == 3 and row["first_std"] == pytest.approx(values.std())
    assert aggregate.tseries_mean(cube, calculate_std=False).variables == ("first",)


@pytest.mark.parametrize("limit, buckets", [(10**6, 8), (50, 8), (5, 3)])
def test_quantiles_that_no_task_holds(spark, limit, buckets):
    """One group holds most rows, with many equal values and a long tail."""
    i = F.col("id")
    rows = spark.range(3000).select(
        F.when(i % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), i % 3)).alias("k"),
        F.when(i % 4 == 0, 7.0).when(i % 101 == 0, i * 1e6).otherwise((i * 7919 % 2000) / 3.0)
        .alias("v"))
    probabilities = [0.0, 0.05, 0.37, 0.5, 0.95, 1.0]
    found = {r.k: r.q for r in quantiles(rows, ["k"], "v", probabilities, limit=limit,
                                         buckets=buckets).collect()}
    frame = rows.toPandas()
    assert set(found) == set(frame.k)
    for key, group in frame.groupby("k"):
        np.testing.assert_allclose(found[key], np.quantile(group.v, probabilities), rtol=1e-12)
    whole = quantiles(rows, [], "v", probabilities, limit=limit, buckets=buckets).first().q
    np.testing.assert_allclose(whole, np.quantile(frame.v, probabilities), rtol=1e-12)


def test_medians_of_large_groups(make, monkeypatch):
    monkeypatch.setattr(aggregate, "GROUP_ROWS", 3)
    monkeypatch.setattr("isograd.functions.quantile.GROUP_ROWS", 3)
    values = np.arange(12.0).reshape(3, 4)
    cube = make([0, 10, 20], [0, 10, 20, 30], first=values, second=values * 2)
    out = aggregate.reduce(cube, dim="lon", method="median").df.orderBy("lat").collect()
    assert [r["first"] for r in out] == [1.5, 5.5, 9.5]
    whole = aggregate.reduce(cube, method="median").df.first()
    assert (whole["first"], whole["second"]) == (5.5, 11)
