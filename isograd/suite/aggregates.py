"""Reductions, climatologies and temporal aggregation."""

from __future__ import annotations

from pyspark.sql import functions as F

from isograd.functions.quantile import quantiles
from isograd.operators import aggregate
from isograd.operators.arithmetic import compute_dataset
from isograd.operators.select import select_var
from isograd.plans.views import cube_coarse, cube_daily, points
from isograd.suite.registry import case, rounded

COARSE, DAILY = ("cube_coarse",), ("cube_daily",)


@case("a1_reduce_mean", """SELECT lat, lon, avg(price) AS price, avg(qty) AS qty FROM cube_coarse
GROUP BY 1, 2""", COARSE)
def mean_over_time(spark, sf_dir):
    return aggregate.reduce(cube_coarse(spark, sf_dir), dim="time, nothing").df


@case("a1_reduce_sum_max_all", """SELECT 'sum' AS method, sum(price) AS price, sum(qty) AS qty
FROM cube_coarse UNION ALL SELECT 'max', max(price), max(qty) FROM cube_coarse
UNION ALL SELECT 'min', min(price), min(qty) FROM cube_coarse""", COARSE)
def total(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    rows = [aggregate.reduce(cube, method=m).df.select(F.lit(m).alias("method"), "price", "qty")
            for m in ("sum", "max", "min")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@case("a1_reduce_min_max", """SELECT time, min(price) AS price, max(qty) AS qty FROM cube_coarse
GROUP BY 1""", COARSE)
def extremes(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    low = aggregate.reduce(cube, "price", "lat, lon", "min").part_of("price").df
    high = aggregate.reduce(cube, "qty", "lat, lon", "max").part_of("qty").df
    return low.join(high, "time")


@case("a1_reduce_median", """SELECT time, quantile_cont(price, 0.5) AS price,
  quantile_cont(qty, 0.5) AS qty FROM cube_coarse GROUP BY 1""", COARSE)
def median(spark, sf_dir):
    return aggregate.reduce(cube_coarse(spark, sf_dir), dim=["lat", "lon"], method="median").df


@case("a1_exact_quantiles_hot_groups", """SELECT kind, round(quantile_cont(value, 0.05), 4) AS q05,
  round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.95), 4) AS q95
FROM points GROUP BY 1""", ("points",))
def split_quantiles(spark, sf_dir):
    # a small limit sends every group the way that hot groups take
    rows = quantiles(points(spark, sf_dir), ["kind"], "value", [0.05, 0.5, 0.95], limit=100,
                     buckets=64)
    named = rows.selectExpr("kind", "q[0] AS q05", "q[1] AS q50", "q[2] AS q95")
    return rounded(named, 4, "q05", "q50", "q95")


@case("a2_climatology_monthly", """SELECT make_timestamp(
    (SELECT year(min(time)) FROM cube_coarse), month(time), 1, 0, 0, 0) AS time,
  lat, lon, avg(price) AS price, avg(qty) AS qty FROM cube_coarse GROUP BY 1, 2, 3""", COARSE)
def monthly(spark, sf_dir):
    return aggregate.long_term_average(cube_coarse(spark, sf_dir)).df


@case("a3_climatology_daily", """SELECT CAST(dayofyear(time) AS INTEGER) AS dayofyear, lat, lon,
  avg(price) AS price FROM cube_daily GROUP BY 1, 2, 3""", DAILY)
def daily(spark, sf_dir):
    return aggregate.long_term_average(cube_daily(spark, sf_dir), "price", "P1D").df


_SEASONS = """seasons AS (SELECT time, lat, lon, price FROM cube_coarse
  WHERE month(time) IN (3, 6, 9) OR (month(time) = 12))"""


@case("a4_climatology_seasonal", f"""WITH {_SEASONS},
years AS (SELECT year(time) AS y, count(DISTINCT time) AS n FROM seasons GROUP BY 1),
head AS (SELECT y, n FROM years ORDER BY y LIMIT 2),
rep AS (SELECT CASE WHEN (SELECT arg_max(n, y) FROM head) > (SELECT arg_min(n, y) FROM head)
  THEN (SELECT max(y) FROM head) ELSE (SELECT min(y) FROM head) END AS y)
SELECT make_timestamp((SELECT y FROM rep), month(time), day(time), 0, 0, 0) AS time, lat, lon,
  avg(price) AS price FROM seasons GROUP BY 1, 2, 3""", COARSE)
def seasonal(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    quarters = cube.where_label("time", F.month("time").isin(3, 6, 9, 12))
    return aggregate.long_term_average(quarters, "price").df


def _resampled(period_sql: str, exprs: str) -> str:
    return f"SELECT {period_sql} AS time, lat, lon, {exprs} FROM cube_daily GROUP BY 1, 2, 3"


@case("a5_resample_month_mean", _resampled("date_trunc('month', time)::TIMESTAMP",
                                           "avg(price) AS price, avg(qty) AS qty"), DAILY)
def month_mean(spark, sf_dir):
    return aggregate.temporal_aggregation(cube_daily(spark, sf_dir)).df


@case("a5_resample_8_months_sum", """SELECT (o + INTERVAL (8 * ((12 * (year(time) - year(o))
    + month(time) - month(o)) // 8)) MONTH)::TIMESTAMP AS time,
  lat, lon, sum(price) AS price, sum(qty) AS qty
FROM cube_daily, (SELECT date_trunc('month', min(time)) AS o FROM cube_daily)
GROUP BY 1, 2, 3""", DAILY)
def eight_months(spark, sf_dir):
    return aggregate.temporal_aggregation(cube_daily(spark, sf_dir), "sum", "8MS").df


@case("a5_resample_season_max", """SELECT (date_trunc('quarter', time + INTERVAL 1 MONTH)
    - INTERVAL 1 MONTH)::TIMESTAMP AS time, lat, lon, max(price) AS price, max(qty) AS qty
FROM cube_daily GROUP BY 1, 2, 3""", DAILY)
def seasons(spark, sf_dir):
    return aggregate.temporal_aggregation(cube_daily(spark, sf_dir), "max", "QS-DEC").df


@case("a5_resample_8_days_median", """SELECT (o + INTERVAL (8 * (date_diff('day', o, time) // 8))
    DAY)::TIMESTAMP AS time, lat, lon, quantile_cont(price, 0.5) AS price,
  quantile_cont(qty, 0.5) AS qty
FROM cube_daily, (SELECT min(time) AS o FROM cube_daily) GROUP BY 1, 2, 3""", DAILY)
def eight_days(spark, sf_dir):
    return aggregate.temporal_aggregation(cube_daily(spark, sf_dir), "median", "8D").df


@case("a5_resample_week_std", """SELECT (date_trunc('week', time) + INTERVAL 6 DAY)::TIMESTAMP AS
  time, lat, lon, round(stddev_pop(price), 3) AS price, round(stddev_pop(qty), 3) AS qty
FROM cube_daily GROUP BY 1, 2, 3""", DAILY)
def weeks(spark, sf_dir):
    return rounded(aggregate.temporal_aggregation(cube_daily(spark, sf_dir), "std", "W").df, 3,
                   "price", "qty")


@case("a5_resample_year_var", """SELECT date_trunc('year', time)::TIMESTAMP AS time, lat, lon,
  round(var_pop(qty), 4) AS qty FROM cube_daily GROUP BY 1, 2, 3""", DAILY)
def years(spark, sf_dir):
    cube = select_var(cube_daily(spark, sf_dir), "qty")
    return rounded(aggregate.temporal_aggregation(cube, "var", "YS").df, 4, "qty")


@case("a5_resample_month_first_last", """SELECT date_trunc('month', time)::TIMESTAMP AS time, lat,
  lon, arg_min(price, time) AS first_price, arg_max(price, time) AS last_price
FROM cube_daily GROUP BY 1, 2, 3""", DAILY)
def ends(spark, sf_dir):
    cube = cube_daily(spark, sf_dir)
    first = aggregate.temporal_aggregation(cube, "first").df.withColumnRenamed(
        "price", "first_price").drop("qty")
    last = aggregate.temporal_aggregation(cube, "last").df.withColumnRenamed(
        "price", "last_price").drop("qty")
    return first.join(last, ["time", "lat", "lon"])


_PLACED = """WITH axis AS (SELECT time, date_trunc('month', time)::TIMESTAMP AS bin,
    row_number() OVER (PARTITION BY date_trunc('month', time) ORDER BY time) - 1 AS pos
  FROM (SELECT DISTINCT time FROM cube_daily))
SELECT bin AS time, lat, lon, {pick} FROM cube_daily JOIN axis USING (time) GROUP BY 1, 2, 3"""


@case("a5_resample_argmax", _PLACED.format(
    pick="arg_max(pos, (price, -pos)) AS price, arg_max(pos, (qty, -pos)) AS qty"), DAILY)
def where_largest(spark, sf_dir):
    return aggregate.temporal_aggregation(cube_daily(spark, sf_dir), "argmax").df


@case("a5_resample_argmin", _PLACED.format(
    pick="arg_min(pos, (price, pos)) AS price, arg_min(pos, (qty, pos)) AS qty"), DAILY)
def where_smallest(spark, sf_dir):
    return aggregate.temporal_aggregation(cube_daily(spark, sf_dir), "argmin").df


@case("a5_resample_prod", """SELECT date_trunc('quarter', time)::TIMESTAMP AS time, lat, lon,
  round(ln(product(CASE WHEN qty > 0 THEN 1 + qty / 1000 END)), 9) AS qty
FROM cube_daily GROUP BY 1, 2, 3""", DAILY)
def products(spark, sf_dir):
    scaled = compute_dataset(cube_daily(spark, sf_dir),
                             "qty = CASE WHEN qty > 0 THEN 1 + qty / 1000 END")
    out = aggregate.temporal_aggregation(scaled, "prod", "QS").df
    return out.withColumn("qty", F.round(F.ln("qty"), 9))


@case("a5_resample_fill_empty", """WITH kept AS (SELECT * FROM cube_coarse
  WHERE month(time) NOT IN (2, 7)),
bins AS (SELECT DISTINCT time FROM kept),
every AS (SELECT unnest(generate_series((SELECT min(time) FROM bins), (SELECT max(time) FROM bins),
  INTERVAL 1 MONTH)) AS time),
free AS (SELECT time FROM every WHERE time NOT IN (SELECT time FROM bins))
SELECT time, lat, lon, price FROM kept
UNION ALL SELECT f.time, c.lat, c.lon, NULL FROM free f, (SELECT DISTINCT lat, lon FROM kept) c""",
      COARSE)
def with_gaps(spark, sf_dir):
    cube = select_var(cube_coarse(spark, sf_dir), "price")
    some = cube.where_label("time", ~F.month("time").isin(2, 7))
    return aggregate.temporal_aggregation(some, "mean", "MS", fill_empty=True).df


@case("a6_tseries_mean", """SELECT time, avg(price) AS price, avg(qty) AS qty,
  round(stddev_pop(price), 3) AS price_std, round(stddev_pop(qty), 5) AS qty_std
FROM cube_coarse GROUP BY 1""", COARSE)
def series(spark, sf_dir):
    out = aggregate.tseries_mean(cube_coarse(spark, sf_dir)).df
    return rounded(rounded(out, 3, "price_std"), 5, "qty_std")
