"""Selection and subset queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from isograd.operators import select, subset
from isograd.operators.select import mask_values
from isograd.plans.views import cube_coarse, cube_fine, points, table
from isograd.suite.registry import case

COARSE = ("cube_coarse",)
RING = "POLYGON((-100.3 -51.7, 21.9 -42.1, 52.3 61.9, -40.7 20.3, -100.3 -51.7))"


def ring_test(x: str, y: str) -> str:
    """Even-odd test of the ring above, edge by edge."""
    ring = [(-100.3, -51.7), (21.9, -42.1), (52.3, 61.9), (-40.7, 20.3), (-100.3, -51.7)]
    tests = []
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        tests.append(
            f"(CASE WHEN {y} >= {min(y0, y1)}::DOUBLE AND {y} < {max(y0, y1)}::DOUBLE AND {x} < "
            f"{x0}::DOUBLE + ({y} - {y0}::DOUBLE) * ({x1}::DOUBLE - {x0}::DOUBLE) / "
            f"({y1}::DOUBLE - {y0}::DOUBLE) THEN 1 ELSE 0 END)")
    return "((" + " + ".join(tests) + ") % 2 = 1)"


@case("p1_select_var", "SELECT time, lat, lon, price FROM cube_coarse", COARSE)
def select_variables(spark, sf_dir):
    return select.select_var(cube_coarse(spark, sf_dir), "pri*").df


@case("p2_select_features", """SELECT id, kind, lon, lat FROM points
WHERE kind = 'BUILDING' OR id = 17""", ("points",))
def any_of(spark, sf_dir):
    rows = select.select_features(points(spark, sf_dir), {"kind": "BUILDING", "id": 17})
    return rows.select("id", "kind", "lon", "lat")


@case("p3_sel_nearest", """SELECT time, lat, lon, price, qty FROM cube_coarse
WHERE lat = (SELECT arg_min(lat, (abs(lat - 10), -lat)) FROM cube_coarse)
  AND lon = (SELECT arg_min(lon, (abs(lon + 100), -lon)) FROM cube_coarse)
  AND time = (SELECT arg_min(time, abs(epoch(time) - epoch(TIMESTAMP '1998-05-20')))
              FROM cube_coarse)""", COARSE)
def nearest(spark, sf_dir):
    return select.sel(cube_coarse(spark, sf_dir), point="-100, 10", time="1998-05-20").df


@case("p3_sel_ffill", """SELECT time, lat, lon, price, qty FROM cube_coarse
WHERE lat = (SELECT max(lat) FROM cube_coarse WHERE lat <= 10)
  AND time = (SELECT max(time) FROM cube_coarse WHERE time <= TIMESTAMP '1998-05-20')""", COARSE)
def forward(spark, sf_dir):
    return select.sel(cube_coarse(spark, sf_dir), time="1998-05-20",
                      indexers="lat=10, layer=3", method="ffill").df


@case("p3_sel_bfill", """SELECT time, lat, lon, price, qty FROM cube_coarse
WHERE lon = (SELECT min(lon) FROM cube_coarse WHERE lon >= -100)""", COARSE)
def backward(spark, sf_dir):
    return select.sel(cube_coarse(spark, sf_dir), indexers={"lon": -100}, method="bfill").df


@case("p4_subset_temporal", """SELECT * FROM cube_coarse
WHERE time BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-02-28 23:59:59'""", COARSE)
def temporal(spark, sf_dir):
    return subset.subset_temporal(cube_coarse(spark, sf_dir), "1996-03-01, 1997-02-28").df


@case("p5_subset_temporal_index", """SELECT c.* FROM cube_coarse c JOIN (
  SELECT time, dense_rank() OVER (ORDER BY time) - 1 AS p FROM (
    SELECT DISTINCT time FROM cube_coarse)) USING (time) WHERE p BETWEEN 5 AND 9""".replace(
    "c.*", "time, lat, lon, price, qty"), COARSE)
def temporal_index(spark, sf_dir):
    return subset.subset_temporal_index(cube_coarse(spark, sf_dir), 5, 9).df


@case("p6_subset_box", """SELECT * FROM cube_fine
WHERE lat BETWEEN -17.5 AND 27.5 AND lon BETWEEN -67.5 AND 37.5""", ("cube_fine",))
def box(spark, sf_dir):
    return subset.subset_spatial(cube_fine(spark, sf_dir), "-60, -10, 30, 20").df


@case("p7_subset_antimeridian", """SELECT time, lat, lon,
  CASE WHEN lon >= 142.5 OR lon <= -142.5 THEN price END AS price,
  CASE WHEN lon >= 142.5 OR lon <= -142.5 THEN qty END AS qty
FROM cube_fine WHERE lat BETWEEN -17.5 AND 17.5""", ("cube_fine",))
def antimeridian(spark, sf_dir):
    return subset.subset_spatial(cube_fine(spark, sf_dir), "150, -10, -150, 10").df


_CORNERS = " OR ".join(
    ring_test(f"CAST(CAST(lon {sx} 7.5 AS FLOAT) AS DOUBLE)",
              f"CAST(CAST(lat {sy} 7.5 AS FLOAT) AS DOUBLE)") for sx in "-+" for sy in "-+")


@case("p8_subset_polygon", f"""SELECT time, lat, lon, CASE WHEN {_CORNERS} THEN price END AS price,
  CASE WHEN {_CORNERS} THEN qty END AS qty
FROM cube_fine WHERE lat BETWEEN -59.2 AND 69.4 AND lon BETWEEN -107.8 AND 59.8""",
      ("cube_fine",))
def polygon(spark, sf_dir):
    return subset.subset_spatial(cube_fine(spark, sf_dir), RING).df


@case("p8_subset_polygon_unmasked", """SELECT * FROM cube_fine
WHERE lat BETWEEN -59.2 AND 69.4 AND lon BETWEEN -107.8 AND 59.8""", ("cube_fine",))
def polygon_bounds(spark, sf_dir):
    return subset.subset_spatial(cube_fine(spark, sf_dir), RING, mask=False).df


def _star(n: int) -> list[tuple[float, float]]:
    """A ring of n corners that goes in and out."""
    turns = [2 * math.pi * k / n for k in range(n)]
    far = [(40 + 14 * math.sin(7 * t) + 3 * math.sin(41 * t)) * (0.93 if k % 2 else 1)
           for k, t in enumerate(turns)]
    ring = [(round(-20 + 2.2 * r * math.cos(t), 3), round(5 + r * math.sin(t), 3))
            for r, t in zip(far, turns)]
    return [*ring, ring[0]]


_LONG = _star(1000)
_LONG_EDGES = ", ".join(f"({a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)"
                        for (a, b), (c, d) in zip(_LONG, _LONG[1:]))
_WEST, _EAST = min(x for x, _ in _LONG), max(x for x, _ in _LONG)
_SOUTH, _NORTH = min(y for _, y in _LONG), max(y for _, y in _LONG)


@case("p8_subset_polygon_long_ring", f"""WITH edges(x0, y0, x1, y1) AS (VALUES {_LONG_EDGES}),
corners AS (SELECT DISTINCT lat, lon, CAST(CAST(lon + dx AS FLOAT) AS DOUBLE) AS x,
  CAST(CAST(lat + dy AS FLOAT) AS DOUBLE) AS y
  FROM cube_fine, (VALUES (-7.5::DOUBLE), (7.5::DOUBLE)) a(dx), (VALUES (-7.5::DOUBLE), (7.5::DOUBLE)) b(dy)),
tested AS (SELECT lat, lon, x, y, count(*) % 2 = 1 AS hit FROM corners JOIN edges
  ON (y0 <= y) <> (y1 <= y) AND x < x0 + (y - y0) * (x1 - x0) / (y1 - y0) GROUP BY 1, 2, 3, 4),
inner_cells AS (SELECT DISTINCT lat, lon FROM tested WHERE hit)
SELECT time, lat, lon, CASE WHEN i.lat IS NOT NULL THEN price END AS price,
  CASE WHEN i.lat IS NOT NULL THEN qty END AS qty
FROM cube_fine c LEFT JOIN inner_cells i USING (lat, lon)
WHERE lat BETWEEN {_SOUTH - 7.5} AND {_NORTH + 7.5} AND lon BETWEEN {_WEST - 7.5} AND {_EAST + 7.5}""",
      ("cube_fine",))
def long_polygon(spark, sf_dir):
    ring = "POLYGON((" + ", ".join(f"{x} {y}" for x, y in _LONG) + "))"
    return subset.subset_spatial(cube_fine(spark, sf_dir), ring).df


@case("p9_antimeridian_polygon", """SELECT * FROM cube_fine
WHERE lat BETWEEN -19.5 AND 19.5 AND (lon >= 162.5 OR lon <= -152.5)""", ("cube_fine",))
def polygon_over_antimeridian(spark, sf_dir):
    ring = "POLYGON((155 -12, -145 -12, -145 12, 155 12, 155 -12))"
    return subset.subset_spatial(cube_fine(spark, sf_dir), ring, keep_axis=False).df


# a ring that crosses itself: the part that turns as its highest corner does is the region
_TIE = "POLYGON((-80 -50, -80 40, 60 -50, 60 55, -80 -50))"


@case("p9_healed_region", """WITH corner AS (SELECT *, CAST(CAST(lon - 7.5 AS FLOAT) AS DOUBLE) AS x0,
  CAST(CAST(lon + 7.5 AS FLOAT) AS DOUBLE) AS x1, CAST(CAST(lat - 7.5 AS FLOAT) AS DOUBLE) AS y0,
  CAST(CAST(lat + 7.5 AS FLOAT) AS DOUBLE) AS y1 FROM cube_fine),
kept AS (SELECT *, {tests} AS keep FROM corner)
SELECT time, lat, lon, CASE WHEN keep THEN price END AS price, CASE WHEN keep THEN qty END AS qty
FROM kept WHERE lat BETWEEN -57.5 AND 62.5 AND lon BETWEEN {cross} - 7.5 AND 67.5""".format(
    cross="(-80 + 140 * 90 / 195.0::DOUBLE)", tests=" OR ".join(
        f"({x} < 60 AND {x} >= -80 AND {y} <= -50 + ({x} + 80) * 105 / 140 AND {y} > 40 - ({x} + 80) * 90 / 140)"
        for x in ("x0", "x1") for y in ("y0", "y1"))), ("cube_fine",))
def healed_region(spark, sf_dir):
    return subset.subset_spatial(cube_fine(spark, sf_dir), _TIE).df


_PARTS = "MULTIPOLYGON(((-100 -40, -40 -40, -40 20, -100 20, -100 -40)), ((10 0, 95 0, 10 70, 10 0)))"


@case("p8_subset_multipolygon", """WITH corner AS (SELECT *, CAST(CAST(lon - 7.5 AS FLOAT) AS DOUBLE) AS x0,
  CAST(CAST(lon + 7.5 AS FLOAT) AS DOUBLE) AS x1, CAST(CAST(lat - 7.5 AS FLOAT) AS DOUBLE) AS y0,
  CAST(CAST(lat + 7.5 AS FLOAT) AS DOUBLE) AS y1 FROM cube_fine),
kept AS (SELECT *, {tests} AS keep FROM corner)
SELECT time, lat, lon, CASE WHEN keep THEN price END AS price, CASE WHEN keep THEN qty END AS qty
FROM kept WHERE lat BETWEEN -47.5 AND 77.5 AND lon BETWEEN -107.5 AND 102.5""".format(tests=" OR ".join(
    f"({x} >= -100 AND {x} < -40 AND {y} >= -40 AND {y} < 20) OR "
    f"({x} >= 10 AND {y} >= 0 AND ({x} - 10) * 70 + {y} * 85 < 85 * 70)"
    for x in ("x0", "x1") for y in ("y0", "y1"))), ("cube_fine",))
def several_polygons(spark, sf_dir):
    return subset.subset_spatial(cube_fine(spark, sf_dir), _PARTS).df


@case("p13_extract_point", """SELECT lat, lon,
  round_even(price * pow(10, 3 + greatest(-floor(log10(abs(price))), 0)), 0)
    / pow(10, 3 + greatest(-floor(log10(abs(price))), 0)) AS price,
  round_even(qty * pow(10, 3 + greatest(-floor(log10(abs(qty))), 0)), 0)
    / pow(10, 3 + greatest(-floor(log10(abs(qty))), 0)) AS qty
FROM cube_coarse WHERE lat = 15 AND lon = 45 AND time = TIMESTAMP '1999-04-01'""", COARSE)
def extract(spark, sf_dir):
    return select.extract_point(cube_coarse(spark, sf_dir), "40, 20",
                                "time='1999-04-01'")


@case("p14_slice_variable", """SELECT lat, lon, price FROM cube_coarse
WHERE time = (SELECT min(time) FROM cube_coarse)""", COARSE)
def first_slice(spark, sf_dir):
    return select.slice_for(cube_coarse(spark, sf_dir), None, ["lat", "lon"], "price").df


@case("p15_slice_dataset", """SELECT time, price, qty FROM cube_coarse
WHERE lat = 45 AND lon = (SELECT min(lon) FROM cube_coarse)""", COARSE)
def vars_slice(spark, sf_dir):
    return select.slice_for(cube_coarse(spark, sf_dir), {"lat": 40}, ["time"]).df


@case("p16_mask_values", """SELECT c_custkey AS id, CASE WHEN c_acctbal >= 0 AND c_acctbal <= 5000
  THEN c_acctbal END AS in_range, nullif(c_nationkey, 3) AS not_three FROM customer""")
def masked(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"),
                       mask_values(F.col("c_acctbal"), valid_range=(0, 5000)).alias("in_range"),
                       mask_values(F.col("c_nationkey"), no_data=3).alias("not_three"))
