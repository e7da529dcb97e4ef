import math

import numpy as np
import pytest

from isograd import Cube, ValidationError
from isograd.functions.special import incomplete_beta
from isograd.operators import fill, stats

LATS, LONS = np.linspace(-67.5, 67.5, 4), np.linspace(-157.5, 157.5, 8)


def student_tail(r, n):
    """Two-sided p-value by integrating the density of r under independence."""
    grid = np.linspace(abs(r), 1, 200_001)
    density = (1 - grid ** 2) ** ((n - 4) / 2)
    scale = math.exp(math.lgamma((n - 1) / 2) - math.lgamma((n - 2) / 2)) / math.sqrt(math.pi)
    return 2 * scale * np.trapezoid(density, grid)


@pytest.mark.parametrize("r, n", [(0.1, 6), (0.5, 9), (-0.83, 25), (0.05, 800), (0.3, 2000)])
def test_incomplete_beta(r, n):
    p = incomplete_beta(np.array([(n - 2) / 2]), 0.5, np.array([1 - r * r]))[0]
    assert p == pytest.approx(student_tail(r, n), rel=1e-5, abs=1e-9)


def test_incomplete_beta_edges():
    x = np.array([0.0, 1.0, np.nan])
    out = incomplete_beta(np.full(3, 2.0), 0.5, x)
    assert out[0] == 0 and out[1] == 1 and np.isnan(out[2])


X = np.arange(6.0)
Y = np.array([3.0, 1, 2, 3, 4, 5])


def cube(make, series, times):
    return make(LATS, LONS, times, first=series.reshape(-1, 1, 1))


@pytest.mark.parametrize("other", [range(6), range(6, 12)])
def test_map_is_matched_by_position(make, other):
    out = stats.pearson_correlation(cube(make, X, range(6)), cube(make, Y, other), "first",
                                    "first").df.collect()
    assert len(out) == 32
    r = np.corrcoef(X, Y)[0, 1]
    assert out[0].corr_coef == pytest.approx(r)
    assert out[0].p_value == pytest.approx(student_tail(r, 6), rel=1e-6)


def test_map_of_short_series(make):
    out = stats.pearson_correlation(cube(make, np.array([1.0, 2, 3]), range(3)),
                                    cube(make, np.array([2.0, 3, 1]), range(3)), "first", "first")
    row = out.df.first()
    assert row.corr_coef == pytest.approx(-0.5) and row.p_value == pytest.approx(2 / 3)


def test_map_edges(make):
    flat = cube(make, np.ones(6), range(6))
    row = stats.pearson_correlation(cube(make, X, range(6)), flat, "first", "first").df.first()
    assert row.corr_coef is None and row.p_value is None
    row = stats.pearson_correlation(cube(make, X, range(6)), cube(make, X * 2, range(6)), "first",
                                    "first").df.first()
    assert row.corr_coef == pytest.approx(1) and (row.p_value is None or row.p_value < 1e-12)


def test_map_against_series(make, spark):
    line = Cube.of(spark.createDataFrame(list(enumerate(map(float, Y))), "time int, y double"),
                   ["time"])
    for pair in ((cube(make, X, range(6)), line, "first", "y"),
                 (line, cube(make, X, range(6)), "y", "first")):
        row = stats.pearson_correlation(*pair).df.first()
        assert row.corr_coef == pytest.approx(np.corrcoef(X, Y)[0, 1])


def test_map_with_gaps_centres_each_side_on_its_own_mean(make):
    x, y = X.copy(), Y.copy()
    x[2], y[4] = np.nan, np.nan
    row = stats.pearson_correlation(cube(make, x, range(6)), cube(make, y, range(6)), "first",
                                    "first").df.first()
    a, b = x - np.nanmean(x), y - np.nanmean(y)
    expected = np.nansum(a * b) / math.sqrt(np.nansum(a ** 2) * np.nansum(b ** 2))
    assert row.corr_coef == pytest.approx(expected)


def test_map_of_many_cells_takes_one_exchange(make):
    """With many cells the exchange by cell serves pairing and moments."""
    lats, lons = np.linspace(-85, 85, 18), np.linspace(-175, 175, 36)
    a = make(lats, lons, range(4), first=np.array([1.0, 2, 3, 4]).reshape(4, 1, 1))
    b = make(lats, lons, range(4), first=np.array([1.0, 3, 2, 4]).reshape(4, 1, 1))
    out = stats.pearson_correlation(a, b, "first", "first").df
    assert out.count() == 648 and out.first().corr_coef == pytest.approx(0.8)
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("hashpartitioning(lat") <= 1


def test_validation(make):
    short = cube(make, X[:2], range(2))
    with pytest.raises(ValidationError, match="three"):
        stats.pearson_correlation(short, short, "first", "first")
    with pytest.raises(ValidationError, match="length"):
        stats.pearson_correlation(cube(make, X, range(6)), short, "first", "first")
    moved = make(LATS + 1, LONS, range(6), first=1.0)
    with pytest.raises(ValidationError, match="lat/lon"):
        stats.pearson_correlation(cube(make, X, range(6)), moved, "first", "first")
    with pytest.raises(ValidationError, match="3D"):
        flat = make(LATS, LONS, first=1.0)
        stats.pearson_correlation(flat, flat, "first", "first")
    tiny = make([0, 1], [0], first=1.0)
    with pytest.raises(ValidationError, match="3 values"):
        stats.pearson_correlation_scalar(tiny, tiny, "first", "first")


def test_scalar(make):
    row = stats.pearson_correlation_scalar(cube(make, X, range(6)), cube(make, Y, range(6, 12)),
                                           "first", "first").first()
    assert row.corr_coef == pytest.approx(np.corrcoef(X, Y)[0, 1])
    assert row.p_value < 1e-20


@pytest.fixture(scope="module")
def square(spark):
    rows = [(x, y, float(4 * x + y), float(4 * x + y)) for x in range(4) for y in range(4)]
    return Cube.of(spark.createDataFrame(rows, "x int, y int, first double, second double"),
                   ["x", "y"])


def kept(cube, name="first"):
    return sorted(r[0] for r in cube.df.select(name).where(f"{name} is not null").collect())


def test_outliers(square, monkeypatch):
    assert kept(stats.detect_outliers(square, "first")) == list(range(1, 15))
    out = stats.detect_outliers(square, "fir*", 2, 13, quantiles_given=False)
    assert kept(out) == list(range(3, 13)) and kept(out, "second") == list(range(16))
    monkeypatch.setattr(stats, "GROUP_ROWS", 4)
    monkeypatch.setattr("isograd.functions.quantile.GROUP_ROWS", 4)
    assert kept(stats.detect_outliers(square, "first")) == list(range(1, 15))


def test_outlier_mask(square):
    out = stats.detect_outliers(square, "first", mask=True)
    assert kept(out) == list(range(16))
    marked = out.df.where("first_outlier_mask = 1").select("first").collect()
    assert sorted(r[0] for r in marked) == [0, 15]
    assert out.var_attrs["first_outlier_mask"]["standard_name"] == "status_flag"
    assert out.var_attrs["first"]["ancillary_variables"] == "first_outlier_mask"


@pytest.mark.parametrize("method, limit", [("ffill", None), ("ffill", 1), ("pad", 3),
                                           ("bfill", None), ("backfill", 2)])
def test_fillna_matches_pandas(spark, method, limit):
    rng = np.random.default_rng(5)
    values = np.where(rng.random(400) < 0.8, np.nan, np.round(rng.random(400), 3))
    rows = [(i * 3, "a" if i % 4 else None, float(v), float(v) * 2) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, k string, v double, w double")
    frame = df.toPandas()
    filler = "ffill" if method in ("ffill", "pad") else "bfill"
    for keys in ([], ["k"]):
        out = fill.fillna(df, method=method, limit=limit, order="i", partition_by=keys,
                          columns=["v", "w"]).toPandas().sort_values("i")
        if keys:
            expected = getattr(frame.groupby("k", dropna=False)[["v", "w"]], filler)(limit=limit)
        else:
            expected = getattr(frame[["v", "w"]], filler)(limit=limit)
        np.testing.assert_array_equal(out[["v", "w"]].to_numpy(), expected.to_numpy())


def test_fillna_constant(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 4.0)], "i int, v double")
    assert sorted(r.v for r in fill.fillna(df, 9.0).collect()) == [4, 9, 9]
    for bad in ({}, {"value": 0}, {"value": 1, "method": "ffill"}, {"method": "nearest"},
                {"method": "ffill"}):
        with pytest.raises(ValidationError):
            fill.fillna(df, **bad)


def test_variables_of_one_table_are_paired_without_an_exchange(make):
    from isograd.operators import tables

    rng = np.random.default_rng(4)
    cube = make([-10, 10], [0, 20, 40], [1, 2, 3], first=rng.random((3, 2, 3)),
                second=rng.random((3, 2, 3)))
    for pairs in (stats.one_table(cube, cube, "first", "second"),
                  tables.scatter_pairs(cube, cube, "first", "second")):
        plan = pairs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan and pairs.count() == 18
    assert stats.one_table(cube, make([0], [0], [1], first=1.0), "first", "first") is None
