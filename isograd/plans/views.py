"""Cubes and feature tables over the star-schema tables.

Coordinates are arithmetic on the keys, so that a cube is one aggregation of its fact table.  Cell
values are whole numbers (mean price in full units, mean quantity in tenths) made from exact integer
sums, so that sums and means over cells do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from isograd.model import Cube
from isograd.session import prepare

CELL = ("time", "lat", "lon")


# Given schemas spare the reader a look into the files.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def month_start(column: str) -> Column:
    return F.trunc(F.col(column).cast("date"), "month").cast("timestamp_ntz")


def day_start(column: str) -> Column:
    return F.col(column).cast("date").cast("timestamp_ntz")


def _grid(key: str, first: float, step: float, n: int) -> Column:
    return (F.lit(first) + F.lit(step) * (F.col(key) % n)).cast("double")


def _line_cube(spark, sf_dir, time, ny, nx, first_lat, first_lon, step) -> Cube:
    rows = table(spark, sf_dir, "lineitem").select(
        time.alias("time"),
        _grid("l_orderkey", first_lat, step, ny).alias("lat"),
        _grid("l_partkey", first_lon, step, nx).alias("lon"),
        "l_extendedprice", "l_quantity")
    # floor stays on doubles, round would go through decimals
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    pieces = F.floor(F.col("l_quantity") + 0.5)
    totals = rows.groupBy(*CELL).agg(F.sum(cents).alias("cents"), F.sum(pieces).alias("pieces"),
                                     F.count(F.lit(1)).alias("n"))
    cells = totals.select(*CELL, F.expr("cents div (100 * n)").cast("double").alias("price"),
                          F.expr("(10 * pieces) div n").cast("double").alias("qty"))
    return Cube.of(cells, CELL)


def cube_coarse(spark: SparkSession, sf_dir: str) -> Cube:
    """Monthly means on a 30° grid."""
    return _line_cube(spark, sf_dir, month_start("l_shipdate"), 6, 12, -75.0, -165.0, 30.0)


def cube_fine(spark: SparkSession, sf_dir: str) -> Cube:
    """Monthly means on a 15° grid."""
    return _line_cube(spark, sf_dir, month_start("l_shipdate"), 12, 24, -82.5, -172.5, 15.0)


def cube_daily(spark: SparkSession, sf_dir: str) -> Cube:
    """Daily means on a 30° grid."""
    return _line_cube(spark, sf_dir, day_start("l_shipdate"), 6, 12, -75.0, -165.0, 30.0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as point features."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        key.alias("id"), F.col("c_acctbal").alias("value"), F.col("c_mktsegment").alias("kind"),
        (F.lit(-180.0) + (key * 37 % 3600) / F.lit(10.0)).alias("lon"),
        (F.lit(-90.0) + (key * 17 % 1800) / F.lit(10.0)).alias("lat"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily mean per event type in whole hundredths."""
    return table(spark, sf_dir, "events").groupBy(
        day_start("ts").alias("time"), F.col("event_type").alias("kind")).agg(
        F.expr("sum(floor(value * 100 + 0.5D)) div count(*)").cast("double")
        .alias("value"))


# The same views for the SQL checks.
_CUBE_SQL = """SELECT date_trunc('{unit}', l_shipdate)::TIMESTAMP AS time,
  CAST({lat} + {step}*(l_orderkey % {ny}) AS DOUBLE) AS lat,
  CAST({lon} + {step}*(l_partkey % {nx}) AS DOUBLE) AS lon,
  CAST(sum(CAST(floor(l_extendedprice * 100 + 0.5) AS BIGINT)) // (100 * count(*)) AS DOUBLE) AS price,
  CAST((10 * sum(CAST(floor(l_quantity + 0.5) AS BIGINT))) // count(*) AS DOUBLE) AS qty
  FROM lineitem GROUP BY 1,2,3"""

VIEWS_SQL = {
    "cube_coarse": _CUBE_SQL.format(unit="month", lat=-75, lon=-165, step=30, ny=6, nx=12),
    "cube_fine": _CUBE_SQL.format(unit="month", lat=-82.5, lon=-172.5, step=15, ny=12, nx=24),
    "cube_daily": _CUBE_SQL.format(unit="day", lat=-75, lon=-165, step=30, ny=6, nx=12),
    "points": """SELECT c_custkey AS id, c_acctbal AS value, c_mktsegment AS kind,
  CAST(-180 AS DOUBLE) + CAST(c_custkey*37 % 3600 AS DOUBLE)/CAST(10 AS DOUBLE) AS lon,
  CAST(-90 AS DOUBLE) + CAST(c_custkey*17 % 1800 AS DOUBLE)/CAST(10 AS DOUBLE) AS lat
  FROM customer""",
    "series": """SELECT date_trunc('day', ts)::TIMESTAMP AS time, event_type AS kind,
  CAST(sum(CAST(floor(value * 100 + 0.5) AS BIGINT)) // count(*) AS DOUBLE) AS value
  FROM events GROUP BY 1,2""",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix a query with the definitions of the views it reads."""
    views = ",\n".join(f"{n} AS ({VIEWS_SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"
