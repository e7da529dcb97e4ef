"""Data tables of charts, value ranges and overview pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from isograd.operators import pyramid, tables
from isograd.operators.normalize import GeoExtent
from isograd.operators.subset import subset_temporal
from isograd.plans.views import cube_coarse, cube_fine
from isograd.plans.workflows import polar_map
from isograd.suite.registry import case

COARSE, FINE = ("cube_coarse",), ("cube_fine",)


def _sround(value: str, digits: str) -> str:
    return f"round_even({value} * pow(10, {digits}), 0) / pow(10, {digits})"


def _extra(value: str) -> str:
    return f"greatest(-floor(log10(abs({value}))), 0)"


@case("a9_variable_statistics", f"""SELECT {_sround('lo', 'd')} AS min, {_sround('hi', 'd')} AS max
FROM (SELECT lo, hi, 2 + least({_extra('lo')}, {_extra('hi')}) AS d FROM (
  SELECT min(price) AS lo, max(price) AS hi FROM cube_coarse
  WHERE time = TIMESTAMP '1998-06-01'))""", COARSE)
def statistics(spark, sf_dir):
    return tables.variable_statistics(cube_coarse(spark, sf_dir), "price", "time='1998-06-01'")


@case("a10_hovmoeller", """SELECT time, lat, avg(qty) AS qty FROM cube_coarse GROUP BY 1, 2""",
      COARSE)
def hovmoeller(spark, sf_dir):
    return tables.hovmoeller(cube_coarse(spark, sf_dir), "qty")


@case("a10_hovmoeller_median", """SELECT lon, time, quantile_cont(price, 0.5) AS price
FROM cube_coarse GROUP BY 1, 2""", COARSE)
def hovmoeller_median(spark, sf_dir):
    return tables.hovmoeller(cube_coarse(spark, sf_dir), "price", "lon", "time", "median")


@case("a11_histogram", """WITH s AS (SELECT price AS v FROM cube_coarse),
r AS (SELECT min(v) AS lo, (max(v) - min(v)) / 10 AS w FROM s)
SELECT bin, lo + bin * w AS low, lo + (bin + 1) * w AS high, n AS count FROM (
  SELECT CAST(least(floor((v - lo) / w), 9) AS BIGINT) AS bin, any_value(lo) AS lo,
    any_value(w) AS w, count(*) AS n FROM s, r GROUP BY 1)""", COARSE)
def histogram(spark, sf_dir):
    return tables.histogram(cube_coarse(spark, sf_dir), "price")


@case("a12_histogram_2d", """WITH r AS (SELECT min(price) AS x0, (max(price) - min(price)) / 256 AS wx,
  min(qty) AS y0, (max(qty) - min(qty)) / 256 AS wy FROM cube_coarse)
SELECT CAST(least(floor((price - x0) / wx), 255) AS BIGINT) AS bx,
  CAST(least(floor((qty - y0) / wy), 255) AS BIGINT) AS by, count(*) AS count
FROM cube_coarse, r GROUP BY 1, 2""", COARSE)
def histogram_2d(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return tables.histogram_2d(tables.scatter_pairs(cube, cube, "price", "qty"),
                               span=tables.pair_range(cube, cube, "price", "qty"))


@case("a13_hexbin", """WITH r AS (SELECT min(price) - 1e-9 * (max(price) - min(price)) AS x0,
  max(price) + 1e-9 * (max(price) - min(price)) AS x1, min(qty) AS y0, max(qty) AS y1
  FROM cube_coarse),
i AS (SELECT (price - x0) / ((x1 - x0) / 64) AS ix, (qty - y0) / ((y1 - y0) / 64) AS iy
  FROM cube_coarse, r),
d AS (SELECT ix, iy, (ix - round_even(ix, 0)) * (ix - round_even(ix, 0))
    + 3 * (iy - round_even(iy, 0)) * (iy - round_even(iy, 0)) <
    (ix - (floor(ix) + 0.5)) * (ix - (floor(ix) + 0.5))
    + 3 * (iy - (floor(iy) + 0.5)) * (iy - (floor(iy) + 0.5)) AS f FROM i)
SELECT CAST(CASE WHEN f THEN 1 ELSE 2 END AS BIGINT) AS lattice,
  CAST(CASE WHEN f THEN round_even(ix, 0) ELSE floor(ix) END AS BIGINT) AS hx,
  CAST(CASE WHEN f THEN round_even(iy, 0) ELSE floor(iy) END AS BIGINT) AS hy, count(*) AS count
FROM d GROUP BY 1, 2, 3""", COARSE)
def hexbin(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return tables.hexbin(tables.scatter_pairs(cube, cube, "price", "qty"))


@case("a14_scatter_pairs", """SELECT a.lat, a.lon, a.price AS x, b.qty AS y FROM (
  SELECT lat, lon, price FROM cube_coarse WHERE time = TIMESTAMP '1997-03-01') a
FULL JOIN (SELECT lat, lon, qty FROM cube_coarse WHERE time = TIMESTAMP '1999-08-01') b
ON a.lat = b.lat AND a.lon = b.lon""", COARSE)
def pairs(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return tables.scatter_pairs(cube, cube, "price", "qty", "time='1997-03-01'",
                                "time='1999-08-01'")


@case("a14_scatter_pairs_by_position", """WITH a AS (SELECT *, dense_rank() OVER (ORDER BY time) AS p
  FROM cube_coarse WHERE year(time) = 1996),
b AS (SELECT *, dense_rank() OVER (ORDER BY time) AS p FROM cube_coarse WHERE year(time) = 1999)
SELECT a.time, a.lat, a.lon, a.price AS x, b.qty AS y FROM a FULL JOIN b
ON a.lat = b.lat AND a.lon = b.lon AND a.p = b.p""", COARSE)
def pairs_by_position(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return tables.scatter_pairs(subset_temporal(cube, "1996-01-01, 1996-12-31"),
                                subset_temporal(cube, "1999-01-01, 1999-12-31"), "price", "qty")


@case("a15_animation_frames", """SELECT time AS frame, lat, lon, price FROM cube_coarse""", COARSE)
def frames(spark, sf_dir):
    return tables.animation_frames(cube_coarse(spark, sf_dir), "price")


@case("a15_animation_range", """SELECT (SELECT min(qty) FROM cube_coarse) AS all_min,
  (SELECT max(qty) FROM cube_coarse) AS all_max, min(qty) AS data_min, max(qty) AS data_max
FROM cube_coarse WHERE time = (SELECT min(time) FROM cube_coarse)""", COARSE)
def ranges(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    first = tables.animation_range(cube, "qty")
    every = tables.animation_range(cube, "qty", true_range=True)
    return first.select(every.select("data_min").scalar().alias("all_min"),
                        every.select("data_max").scalar().alias("all_max"), "data_min", "data_max")


@case("a16_colour_range", """SELECT time, -greatest(abs(lo), abs(hi)) AS vmin,
  greatest(abs(lo), abs(hi)) AS vmax, TRUE AS divergent, 'neither' AS extend FROM (
  SELECT time, min(price) - 60000 AS lo, max(price) - 60000 AS hi FROM cube_coarse GROUP BY 1)
WHERE lo < 0 AND hi > 0
UNION ALL SELECT time, lo, hi, FALSE, 'neither' FROM (
  SELECT time, min(price) - 60000 AS lo, max(price) - 60000 AS hi FROM cube_coarse GROUP BY 1)
WHERE NOT (lo < 0 AND hi > 0)""", COARSE)
def colours(spark, sf_dir):
    rows = cube_coarse(spark, sf_dir).df.groupBy("time").agg(
        (F.min("price") - 60000).alias("lo"), (F.max("price") - 60000).alias("hi"))
    return rows.select("time", *tables.colour_range(F.col("lo"), F.col("hi")))


@case("a16_colour_range_limits", """SELECT time, 20000.0::DOUBLE AS vmin, 90000.0::DOUBLE AS vmax,
  FALSE AS divergent, CASE WHEN lo < 20000 AND hi > 90000 THEN 'both' WHEN lo < 20000 THEN 'min'
  WHEN hi > 90000 THEN 'max' ELSE 'neither' END AS extend FROM (
  SELECT time, min(price) AS lo, max(price) AS hi FROM cube_coarse GROUP BY 1)""", COARSE)
def colour_limits(spark, sf_dir):
    rows = cube_coarse(spark, sf_dir).df.groupBy("time").agg(
        F.min("price").alias("lo"), F.max("price").alias("hi"))
    return rows.select("time", *tables.colour_range(F.col("lo"), F.col("hi"), 20000, 90000))


GLOBE = GeoExtent(-180.0, -90.0, 180.0, 90.0, inv_y=True)
# 24 × 12 pixels in tiles of 3 × 3: three levels
SCHEME = pyramid.tiling_scheme(24, 12, GLOBE, 3, 3)

_PX = """px AS (SELECT time, CAST(round((lon + 172.5) / 15) AS BIGINT) AS x,
  CAST(round((82.5 - lat) / 15) AS BIGINT) AS y, price AS v FROM cube_fine)"""


@case("a17_pyramid_nearest", f"""WITH {_PX}
SELECT time, z, x // s // 3 AS tile_x, y // s // 3 AS tile_y, x // s AS px, y // s AS py,
  v AS value FROM px, (SELECT unnest([0, 1, 2])::BIGINT AS z, unnest([4, 2, 1])::BIGINT AS s)
WHERE x % s = 0 AND y % s = 0""", FINE)
def nearest_levels(spark, sf_dir):
    return pyramid.nearest_pyramid(cube_fine(spark, sf_dir), "price", SCHEME)


def _levels(aggregate: str, check: str) -> str:
    """Blocks of 1, 4 and 16 pixels; missing pixels count when the block is checked."""
    return f"""WITH {_PX}
SELECT time, z, x // s // 3 AS tile_x, y // s // 3 AS tile_y, x // s AS px, y // s AS py,
  CASE WHEN {check} THEN {aggregate} END AS value
FROM px, (SELECT unnest([0, 1, 2])::BIGINT AS z, unnest([4, 2, 1])::BIGINT AS s)
GROUP BY time, z, s, x // s, y // s"""


@case("a17_pyramid_mean", _levels("avg(v)", "count(v) = s * s"), FINE)
def mean_levels(spark, sf_dir):
    return pyramid.aggregated_pyramid(cube_fine(spark, sf_dir), "price", SCHEME, "mean")


@case("a17_pyramid_max", _levels("max(v)", "TRUE"), FINE)
def max_levels(spark, sf_dir):
    return pyramid.aggregated_pyramid(cube_fine(spark, sf_dir), "price", SCHEME, "max")


@case("a17_pyramid_first", _levels("max(CASE WHEN x % s = 0 AND y % s = 0 THEN v END)", "TRUE"), FINE)
def first_levels(spark, sf_dir):
    return pyramid.aggregated_pyramid(cube_fine(spark, sf_dir), "price", SCHEME, "first")


@case("a17_pyramid_sum", _levels("sum(v)", "count(v) = s * s"), FINE)
def sum_levels(spark, sf_dir):
    return pyramid.aggregated_pyramid(cube_fine(spark, sf_dir), "price", SCHEME, "sum")


@case("w3_polar_map", """SELECT lat, lon, price FROM cube_coarse
WHERE time = (SELECT min(time) FROM cube_coarse WHERE time >= TIMESTAMP '1997-01-01')
  AND lat BETWEEN 35 AND 90""", COARSE)
def polar(spark, sf_dir):
    return polar_map(cube_coarse(spark, sf_dir), "price", "1997-01-01, 1997-12-31",
                     "-180, 50, 180, 90")
