"""Correlation, outliers, gap filling and series at points."""

from __future__ import annotations

from pyspark.sql import functions as F

from isograd.model import Cube
from isograd.operators import aggregate, fill, stats, tables
from isograd.plans.views import cube_coarse, cube_fine, series, table
from isograd.plans.workflows import regional_correlation
from isograd.suite.registry import case, rounded

COARSE = ("cube_coarse",)

# r where each side is centred on the mean of its own values
R_SQL = """centred AS (SELECT lat, lon, x - avg(x) OVER c AS x, y - avg(y) OVER c AS y FROM pairs
  WINDOW c AS (PARTITION BY lat, lon)),
r AS (SELECT lat, lon, greatest(-1, least(1, sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0)))
  AS corr_coef FROM centred GROUP BY 1, 2)"""

# two-sided p-value from the closed form of Student's distribution for a whole number of degrees
P_SQL = """deg AS (SELECT (SELECT count(DISTINCT time) FROM cube_coarse) - 2 AS d),
terms AS (SELECT k, d, exp(sum(CASE WHEN k = 0 THEN 0.0 WHEN d % 2 = 1
    THEN ln(2.0 * k / (2 * k + 1)) ELSE ln((2.0 * k - 1) / (2 * k)) END) OVER (ORDER BY k)) AS c
  FROM deg, range(0, 5000) t(k) WHERE k <= (d - 2 - d % 2) // 2),
tail AS (SELECT lat, lon, any_value(abs(corr_coef)) AS s, any_value(d) AS d,
    sum(c * pow(1 - corr_coef * corr_coef, k)) AS total FROM r, terms GROUP BY 1, 2),
p AS (SELECT lat, lon, CASE WHEN s = 1 THEN NULL WHEN d % 2 = 1
    THEN 1 - 2 / pi() * (asin(s) + s * sqrt(1 - s * s) * total) ELSE 1 - s * total END AS p_value
  FROM tail)"""


_PAIR_P_SQL = P_SQL.replace("SELECT (SELECT count(DISTINCT time) FROM cube_coarse) - 2 AS d",
                            "SELECT count(*) - 2 AS d FROM pairs WHERE x IS NOT NULL AND y IS NOT NULL")


@case("c1_correlation_scalar", f"""WITH pairs AS (SELECT 0 AS lat, 0 AS lon, price AS x, qty AS y
  FROM cube_coarse), {R_SQL}, {_PAIR_P_SQL}
SELECT round(corr_coef, 9) AS corr_coef, round(p_value, 8) AS p_value FROM r LEFT JOIN p USING (lat, lon)""",
      COARSE)
def scalar(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    out = stats.pearson_correlation_scalar(cube, cube, "price", "qty")
    return rounded(rounded(out, 9, "corr_coef"), 8, "p_value")


@case("c1_correlation_weak", f"""WITH pairs AS (SELECT 0 AS lat, 0 AS lon, price AS x,
    CAST((year(time) * 37 + month(time) * 11 + lat + 3 * lon) AS BIGINT) % 101 AS y
  FROM cube_coarse WHERE lat > 0 AND lon > 100), {R_SQL}, {_PAIR_P_SQL}
SELECT round(corr_coef, 9) AS corr_coef, round(p_value, 8) AS p_value FROM r LEFT JOIN p USING (lat, lon)""",
      COARSE)
def weak_scalar(spark, sf_dir):
    """Hardly correlated values of a few cells, whose p-value is far from 0."""
    cells = cube_coarse(spark, sf_dir).df.where("lat > 0 AND lon > 100").withColumn(
        "other", F.expr("CAST(year(time) * 37 + month(time) * 11 + lat + 3 * lon AS bigint) % 101").cast(
            "double"))
    cube = Cube.of(cells, ["time", "lat", "lon"], ["price", "other"])
    out = stats.pearson_correlation_scalar(cube, cube, "price", "other")
    return rounded(rounded(out, 9, "corr_coef"), 8, "p_value")


@case("c2_correlation_map", f"""WITH pairs AS (SELECT lat, lon, price AS x, qty AS y
  FROM cube_coarse), {R_SQL}, {P_SQL}
SELECT lat, lon, round(corr_coef, 9) AS corr_coef, round(p_value, 8) AS p_value
FROM r LEFT JOIN p USING (lat, lon)""", COARSE)
def correlation_map(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    out = stats.pearson_correlation(cube, cube, "price", "qty").df
    return rounded(rounded(out, 9, "corr_coef"), 8, "p_value")


@case("c2_correlation_map_series", f"""WITH s AS (SELECT time, sum(qty) AS y FROM cube_coarse
  GROUP BY 1),
axis AS (SELECT lat, lon, time FROM (SELECT DISTINCT lat, lon FROM cube_coarse), s),
pairs AS (SELECT lat, lon, price AS x, y FROM cube_coarse JOIN s USING (time)), {R_SQL}, {P_SQL}
SELECT lat, lon, round(corr_coef, 9) AS corr_coef, round(p_value, 8) AS p_value
FROM r LEFT JOIN p USING (lat, lon)""", COARSE)
def map_against_series(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    line = aggregate.reduce(cube, "qty", "lat, lon", "sum")
    out = stats.pearson_correlation(cube, line, "price", "qty").df
    return rounded(rounded(out, 9, "corr_coef"), 8, "p_value")


@case("w1_regional_correlation", f"""WITH fine AS (SELECT time,
    -60 + 30 * CAST(floor((lat + 60) / 30) AS INTEGER) + 15.0::DOUBLE AS lat,
    -90 + 30 * CAST(floor((lon + 90) / 30) AS INTEGER) + 15.0::DOUBLE AS lon, avg(qty) AS y
  FROM cube_fine WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -90 AND 90 GROUP BY 1, 2, 3),
coarse AS (SELECT time, lat, lon, price AS x FROM cube_coarse
  WHERE lat BETWEEN -60 AND 60 AND lon BETWEEN -90 AND 90),
pairs AS (SELECT lat, lon, x, y FROM coarse FULL JOIN fine USING (time, lat, lon)), {R_SQL}, {P_SQL}
SELECT lat, lon, round(corr_coef, 9) AS corr_coef, round(p_value, 8) AS p_value
FROM r LEFT JOIN p USING (lat, lon)""", ("cube_coarse", "cube_fine"))
def correlation_in_region(spark, sf_dir):
    out = regional_correlation(cube_coarse(spark, sf_dir), cube_fine(spark, sf_dir), "price",
                               "qty", "-75, -45, 75, 45").df
    return rounded(rounded(out, 9, "corr_coef"), 8, "p_value")


_BOUNDS = """b AS (SELECT quantile_cont(price, 0.05) AS pl, quantile_cont(price, 0.95) AS ph,
  quantile_cont(qty, 0.05) AS ql, quantile_cont(qty, 0.95) AS qh FROM cube_coarse)"""


@case("o1_outliers_quantiles", f"""WITH {_BOUNDS} SELECT time, lat, lon,
  CASE WHEN price > pl AND price < ph THEN price END AS price,
  CASE WHEN qty > ql AND qty < qh THEN qty END AS qty FROM cube_coarse, b""", COARSE)
def outliers(spark, sf_dir):
    return stats.detect_outliers(cube_coarse(spark, sf_dir), "*").df


@case("o1_outliers_absolute", """SELECT time, lat, lon, price,
  CASE WHEN qty > 200 AND qty < 300 THEN qty END AS qty FROM cube_coarse""", COARSE)
def outliers_absolute(spark, sf_dir):
    return stats.detect_outliers(cube_coarse(spark, sf_dir), "q*", 200, 300,
                                 quantiles_given=False).df


@case("o2_outlier_mask", f"""WITH {_BOUNDS} SELECT time, lat, lon, price, qty,
  CAST(CASE WHEN price > pl AND price < ph THEN 0 ELSE 1 END AS TINYINT) AS price_outlier_mask
FROM cube_coarse, b""", COARSE)
def outlier_mask(spark, sf_dir):
    return stats.detect_outliers(cube_coarse(spark, sf_dir), "price", mask=True).df


@case("t1_tseries_point", """SELECT time, lat, lon, price FROM cube_coarse
WHERE lat = 15 AND lon = 15""", COARSE)
def point_series(spark, sf_dir):
    return tables.tseries_point(cube_coarse(spark, sf_dir), "10, 5", "price").df


@case("t2_line_series", """SELECT 'price' AS variable, time AS x, price AS value FROM cube_coarse
  WHERE lat = 15 AND lon = 45
UNION ALL SELECT 'qty', time, qty FROM cube_coarse WHERE lat = 15 AND lon = 45""", COARSE)
def lines(spark, sf_dir):
    return tables.line_series(cube_coarse(spark, sf_dir), "price, qty", "time",
                              "lat=10, lon=40")


@case("t3_slice_table", """SELECT lat, lon, price FROM cube_coarse
WHERE time = TIMESTAMP '1998-06-01'""", COARSE)
def map_slice(spark, sf_dir):
    return tables.slice_table(cube_coarse(spark, sf_dir), "price", "time='1998-06-03'")


_GAPPED = """gapped AS (SELECT time, kind, CASE WHEN day(time) % 7 IN (1, 2, 5) OR day(time) = 1
  THEN value END AS value FROM series)"""


def _gapped(spark, sf_dir):
    keep = (F.dayofmonth("time") % 7).isin(1, 2, 5) | (F.dayofmonth("time") == 1)
    return series(spark, sf_dir).withColumn("value", F.when(keep, F.col("value")))


@case("f1_fillna_constant", f"WITH {_GAPPED} SELECT time, kind, coalesce(value, -5) AS value "
      "FROM gapped", ("series",))
def fill_constant(spark, sf_dir):
    return fill.fillna(_gapped(spark, sf_dir), -5.0, columns=["value"])


def _directed(sort: str, limit: int | None) -> str:
    reach = "" if limit is None else f"WHEN rn - found > {limit} THEN NULL "
    return f"""WITH {_GAPPED},
numbered AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY time {sort}) AS rn FROM gapped),
seen AS (SELECT *, last_value(value IGNORE NULLS) OVER w AS v,
    last_value(CASE WHEN value IS NOT NULL THEN rn END IGNORE NULLS) OVER w AS found
  FROM numbered
  WINDOW w AS (PARTITION BY kind ORDER BY rn))
SELECT time, kind, CASE WHEN value IS NOT NULL THEN value {reach}ELSE v END AS value FROM seen"""


@case("f1_fillna_forward", _directed("ASC", None), ("series",))
def fill_forward(spark, sf_dir):
    return fill.fillna(_gapped(spark, sf_dir), method="ffill", order="time",
                       partition_by=["kind"])


@case("f1_fillna_forward_limit", _directed("ASC", 1), ("series",))
def fill_forward_limited(spark, sf_dir):
    return fill.fillna(_gapped(spark, sf_dir), method="pad", limit=1, order="time",
                       partition_by=["kind"])


@case("f1_fillna_backward", _directed("DESC", 2), ("series",))
def fill_backward(spark, sf_dir):
    return fill.fillna(_gapped(spark, sf_dir), method="bfill", limit=2, order="time",
                       partition_by=["kind"])


_WIDE = """wide AS (SELECT l_orderkey * 10000000000
    + CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT) * 10 + l_linenumber AS i,
  l_returnflag AS flag, l_linestatus AS status, l_quantity AS quantity, l_shipdate AS day,
  CASE WHEN l_partkey % 50 = 0 THEN l_extendedprice END AS price,
  CASE WHEN l_suppkey % 7 = 3 THEN l_tax END AS tax FROM lineitem)"""


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 10000000000 + floor(l_extendedprice * 100 + 0.5D) * 10 + l_linenumber").alias("i"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
        F.col("l_quantity").alias("quantity"), F.col("l_shipdate").alias("day"),
        F.when(F.col("l_partkey") % 50 == 0, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_suppkey") % 7 == 3, F.col("l_tax")).alias("tax"))


def _wide(keys: str, sort: str, reach: str = "UNBOUNDED") -> str:
    return f"""WITH {_WIDE}
SELECT i, flag, status, quantity, day, last_value(price IGNORE NULLS) OVER w AS price,
  last_value(tax IGNORE NULLS) OVER w AS tax
FROM wide WINDOW w AS ({keys} ORDER BY i {sort} ROWS BETWEEN {reach} PRECEDING AND CURRENT ROW)"""


@case("f1_fillna_wide", _wide("", "ASC"))
def fill_wide(spark, sf_dir):
    return fill.fillna(_lines(spark, sf_dir), method="ffill", order="i", columns=["price", "tax"])


@case("f1_fillna_wide_series", _wide("PARTITION BY flag, status", "DESC", "30"))
def fill_wide_series(spark, sf_dir):
    return fill.fillna(_lines(spark, sf_dir), method="bfill", limit=30, order="i",
                       columns=["price", "tax"], partition_by=["flag", "status"])
