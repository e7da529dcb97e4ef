"""Arithmetic, differences, merging, anomalies and indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from isograd.model import Cube
from isograd.operators import aggregate, anomaly, arithmetic
from isograd.operators.select import select_var
from isograd.operators.subset import subset_temporal
from isograd.plans.views import CELL, cube_coarse, points
from isograd.plans.workflows import enso_from_own_climatology
from isograd.suite.registry import case, rounded

COARSE = ("cube_coarse",)

CLIMATE = """clim AS (SELECT month(time) AS m, lat, lon, avg(price) AS price, avg(qty) AS qty
  FROM cube_coarse GROUP BY 1, 2, 3)"""


@case("m1_arithmetics", """SELECT time, lat, lon,
  round((log10(ln(price + 1000.0::DOUBLE) * 3) + 2) / 7, 9) AS price,
  round((log10(ln(qty + 1000.0::DOUBLE) * 3) + 2) / 7, 9) AS qty FROM cube_coarse""", COARSE)
def arithmetics(spark, sf_dir):
    out = arithmetic.ds_arithmetics(cube_coarse(spark, sf_dir), "+1000, log, *3, log10, +2, /7")
    return rounded(out.df, 9, "price", "qty")


@case("m1_arithmetics_logs", """SELECT time, lat, lon,
  round(log2(ln(1 + exp(qty * 0.001::DOUBLE)) + 1), 9) AS qty FROM cube_coarse""", COARSE)
def logarithms(spark, sf_dir):
    qty = select_var(cube_coarse(spark, sf_dir), "qty")
    return rounded(arithmetic.ds_arithmetics(qty, "*0.001, exp, log1p, +1, log2").df, 9, "qty")


@case("m2_diff", """SELECT a.time, a.lat, a.lon, a.price - b.price AS price
FROM cube_coarse a JOIN cube_coarse b ON a.lat = b.lat AND a.lon = b.lon AND a.time = b.time
WHERE b.time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1999-12-31'""", COARSE)
def difference(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    other = select_var(subset_temporal(cube, "1996-01-01, 1999-12-31"), "price")
    return arithmetic.diff(cube, other).df


@case("m3_diff_positional", """WITH a AS (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS p
  FROM cube_coarse WHERE year(time) = 1996),
b AS (SELECT *, dense_rank() OVER (ORDER BY time) - 1 AS p FROM cube_coarse WHERE year(time) = 1998)
SELECT a.p AS time, lat, lon, a.price - b.price AS price, a.qty - b.qty AS qty
FROM a JOIN b USING (p, lat, lon)""", COARSE)
def positional_difference(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return arithmetic.diff(subset_temporal(cube, "1996-01-01, 1996-12-31"),
                           subset_temporal(cube, "1998-01-01, 1998-12-31")).df


@case("m4_diff_broadcast", """SELECT c.time, lat, lon, c.price - m.price AS price,
  c.qty - m.qty AS qty
FROM cube_coarse c JOIN (SELECT lat, lon, max(price) AS price, max(qty) AS qty FROM cube_coarse
  GROUP BY 1, 2) m USING (lat, lon)""", COARSE)
def broadcast_difference(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return arithmetic.diff(cube, aggregate.reduce(cube, dim="time", method="max")).df


@case("m4_diff_single_time", """SELECT c.time, lat, lon, c.price - m.price AS price,
  c.qty - m.qty AS qty FROM cube_coarse c JOIN (SELECT lat, lon, price, qty FROM cube_coarse
  WHERE time = TIMESTAMP '1997-05-01') m USING (lat, lon)""", COARSE)
def single_slice_difference(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return arithmetic.diff(cube, subset_temporal(cube, "1997-05-01, 1997-05-01")).df


@case("m5_compute_table", """SELECT round(value / 1000 - sqrt(abs(lat)), 9) AS a,
  round(2 * value + lon, 6) AS b FROM points""", ("points",))
def computed_columns(spark, sf_dir):
    out = arithmetic.compute_data_frame(points(spark, sf_dir), """_half = sqrt(abs(lat))
a = value / 1000 - _half
b = 2 * value + lon""")
    return rounded(rounded(out, 9, "a"), 6, "b")


@case("m5_compute_table_aggregates", """SELECT round(avg(value), 4) AS mean,
  round(quantile_cont(lat, 0.5), 6) AS middle, count(*) AS n FROM points""", ("points",))
def computed_aggregates(spark, sf_dir):
    out = arithmetic.compute_data_frame(points(spark, sf_dir),
                                        "mean = avg(value)\nmiddle = median(lat)\nn = count(1)")
    return rounded(rounded(out, 4, "mean"), 6, "middle")


@case("m5_compute_table_copy", """SELECT id, value, kind, lon, lat,
  round(value - (SELECT avg(value) FROM points), 4) AS off FROM points""", ("points",))
def computed_copy(spark, sf_dir):
    out = arithmetic.compute_data_frame(points(spark, sf_dir),
                                        "_m = avg(value)\noff = value - _m", copy=True)
    return rounded(out, 4, "off")


@case("m5_compute_empty", """SELECT count(*) AS n, avg(value) AS mean,
  quantile_cont(value, 0.5) AS middle, 5 AS five FROM points WHERE id < 0""", ("points",))
def computed_of_nothing(spark, sf_dir):
    return arithmetic.compute_data_frame(points(spark, sf_dir).where("id < 0"),
                                         "n = count(1)\nmean = avg(value)\nmiddle = median(value)\n"
                                         "five = 5")


@case("m6_compute_nan", """WITH m AS (SELECT avg(price) AS m FROM cube_coarse)
SELECT lat, lon, round(avg(CASE WHEN price >= m THEN sqrt(price - m) END), 6) AS root
FROM cube_coarse, m GROUP BY 1, 2""", COARSE)
def computed_roots(spark, sf_dir):
    # roots of negative numbers are missing and don't spoil the means
    roots = arithmetic.compute_dataset(cube_coarse(spark, sf_dir),
                                       "_m = avg(price)\nroot = sqrt(price - _m)")
    return rounded(aggregate.reduce(roots, dim="time", method="mean").df, 6, "root")


@case("m6_compute_cube", """SELECT c.time, lat, lon, c.price / 10 + x.qty AS score
FROM cube_coarse c JOIN (SELECT lat, lon, max(qty) AS qty FROM cube_coarse GROUP BY 1, 2) x
  USING (lat, lon)""", COARSE)
def computed_cube(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    highest = aggregate.reduce(cube, dim="time", method="max")
    return arithmetic.compute_dataset(cube, "_p = price / 10\nscore = _p + top.qty",
                                      context={"top": highest}).df


def _merged(join: str) -> str:
    keep = {"outer": "TRUE", "inner": "year(time) = 1997", "left": "year(time) IN (1996, 1997)",
            "right": "year(time) IN (1997, 1998)"}[join]
    return f"""WITH a AS (SELECT time, lat, lon, price FROM cube_coarse
  WHERE year(time) IN (1996, 1997)),
b AS (SELECT time, lat, lon, price, qty FROM cube_coarse WHERE year(time) IN (1997, 1998))
SELECT time, lat, lon, coalesce(a.price, b.price) AS price, qty
FROM a FULL JOIN b USING (time, lat, lon) WHERE {keep}"""


def _halves(spark, sf_dir) -> tuple[Cube, Cube]:
    cube = cube_coarse(spark, sf_dir)
    return (select_var(subset_temporal(cube, "1996-01-01, 1997-12-31"), "price"),
            subset_temporal(cube, "1997-01-01, 1998-12-31"))


@case("m7_merge_outer", _merged("outer"), COARSE)
def merge_outer(spark, sf_dir):
    return arithmetic.merge(*_halves(spark, sf_dir)).df


@case("m7_merge_inner", _merged("inner"), COARSE)
def merge_inner(spark, sf_dir):
    return arithmetic.merge(*_halves(spark, sf_dir), join="inner").df


@case("m7_merge_left", _merged("left"), COARSE)
def merge_left(spark, sf_dir):
    return arithmetic.merge(*_halves(spark, sf_dir), join="left").df


@case("m7_merge_right", _merged("right"), COARSE)
def merge_right(spark, sf_dir):
    return arithmetic.merge(*_halves(spark, sf_dir), join="right").df


@case("m7_merge_exact_equals", """SELECT time, lat, lon, price, qty, price * 2 AS twice
FROM cube_coarse""", COARSE)
def merge_exact(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    more = Cube.of(cube.df.select(*CELL, "price", (F.col("price") * 2).alias("twice")), CELL)
    return arithmetic.merge(cube, more, cube, join="exact", compat="equals").df


@case("m7_merge_broadcast_equals", """SELECT lat, lon, floor(lat / 45) AS zone, max(qty) AS top
FROM cube_coarse GROUP BY 1, 2""", COARSE)
def merge_broadcast(spark, sf_dir):
    """A zone per latitude in one cube, per cell in the other."""
    cells = cube_coarse(spark, sf_dir).df.groupBy("lat", "lon").agg(F.max("qty").alias("top")).withColumn(
        "zone", F.floor(F.col("lat") / 45).cast("double"))
    wide = Cube.of(cells, ["lat", "lon"], ["top", "zone"])
    narrow = Cube.of(cells.select("lat", "zone").distinct(), ["lat"])
    return arithmetic.merge(narrow, wide, compat="broadcast_equals").df


@case("m8_anomaly_external", f"""WITH {CLIMATE}
SELECT c.time, lat, lon, c.price - clim.price AS price, c.qty - clim.qty AS qty
FROM cube_coarse c JOIN clim USING (lat, lon) WHERE month(c.time) = clim.m""", COARSE)
def external(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return anomaly.anomaly_external(cube, aggregate.long_term_average(cube)).df


@case("m8_anomaly_external_transform", f"""WITH {CLIMATE}
SELECT c.time, lat, lon, (c.price + 5) * 2 - clim.price AS price,
  (c.qty + 5) * 2 - clim.qty AS qty
FROM cube_coarse c JOIN clim USING (lat, lon) WHERE month(c.time) = clim.m""", COARSE)
def external_transformed(spark, sf_dir):
    cube = cube_coarse(spark, sf_dir)
    return anomaly.anomaly_external(cube, aggregate.long_term_average(cube), "+5, *2").df


@case("m9_anomaly_internal", """SELECT time, lat, lon,
  price - (SELECT avg(price) FROM cube_coarse) AS price,
  qty - (SELECT avg(qty) FROM cube_coarse) AS qty FROM cube_coarse""", COARSE)
def internal(spark, sf_dir):
    return anomaly.anomaly_internal(cube_coarse(spark, sf_dir)).df


_REF = """(SELECT avg({v}) FROM cube_coarse WHERE lat BETWEEN -45 AND 45 AND lon BETWEEN -75 AND 75
  AND time BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1998-12-31 23:59:59')"""


@case("m9_anomaly_internal_reference", f"""SELECT time, lat, lon,
  price - {_REF.format(v='price')} AS price, qty - {_REF.format(v='qty')} AS qty
FROM cube_coarse""", COARSE)
def internal_reference(spark, sf_dir):
    return anomaly.anomaly_internal(cube_coarse(spark, sf_dir), "1996-01-01, 1998-12-31",
                                    "-60, -30, 60, 30").df


def _index(where: str, before: int, name: str, threshold: float | None = None) -> str:
    window = f"OVER (ORDER BY time ROWS BETWEEN {before} PRECEDING AND {before} FOLLOWING)"
    flags = "" if threshold is None else (f', round(x, 6) > {threshold} AS "El Nino", '
                                          f'round(x, 6) < -{threshold} AS "La Nina"')
    return f"""WITH {CLIMATE},
an AS (SELECT c.time, avg(c.price - clim.price) AS v FROM cube_coarse c JOIN clim USING (lat, lon)
  WHERE month(c.time) = clim.m AND ({where}) GROUP BY 1),
roll AS (SELECT time, avg(v) {window} AS x, count(v) {window} AS n FROM an)
SELECT time, round(x, 6) AS "{name}"{flags} FROM roll WHERE n = {2 * before + 1}"""


def _with_index(spark, sf_dir, operator, name, **kwargs):
    cube = cube_coarse(spark, sf_dir)
    out = operator(cube, "price", aggregate.long_term_average(cube), **kwargs)
    return out.withColumn(name, F.round(F.col(f"`{name}`"), 6))


N34 = "lat BETWEEN -20 AND 20 AND lon BETWEEN -180 AND -105"


@case("m10_index_custom_region", _index("lat BETWEEN -45 AND 45 AND lon BETWEEN -75 AND 75", 2,
                                        "ENSO Index over POLYGON ((60 -30, 60 30, -60 30, "
                                        "-60 -30, 60 -30))"), COARSE)
def custom_index(spark, sf_dir):
    name = "ENSO Index over POLYGON ((60 -30, 60 30, -60 30, -60 -30, 60 -30))"
    return _with_index(spark, sf_dir, anomaly.enso, name, region="custom",
                       custom_region="-60, -30, 60, 30")


@case("m11_enso_nino34", _index(N34, 2, "ENSO N3.4 Index", 500.0), COARSE)
def nino34(spark, sf_dir):
    return _with_index(spark, sf_dir, anomaly.enso_nino34, "ENSO N3.4 Index", threshold=500.0)


@case("m12_enso_n12", _index("lat BETWEEN -25 AND 15 AND lon BETWEEN -105 AND -65", 2,
                             "ENSO N1+2 Index"), COARSE)
def nino12(spark, sf_dir):
    return _with_index(spark, sf_dir, anomaly.enso, "ENSO N1+2 Index", region="N1+2")


@case("m12_enso_n3", _index("lat BETWEEN -20 AND 20 AND lon BETWEEN -165 AND -75", 2,
                            "ENSO N3 Index"), COARSE)
def nino3(spark, sf_dir):
    return _with_index(spark, sf_dir, anomaly.enso, "ENSO N3 Index", region="N3")


@case("m12_enso_n4", _index("lat BETWEEN -20 AND 20 AND (lon >= 175 OR lon <= -165)", 2,
                            "ENSO N4 Index"), COARSE)
def nino4(spark, sf_dir):
    return _with_index(spark, sf_dir, anomaly.enso, "ENSO N4 Index", region="N4")


@case("m13_oni", _index(N34, 1, "ONI Index", 500.0), COARSE)
def oni(spark, sf_dir):
    return _with_index(spark, sf_dir, anomaly.oni, "ONI Index", threshold=500.0)


@case("w2_enso_own_climatology", _index(N34, 2, "index", 500.0), COARSE)
def own_climatology(spark, sf_dir):
    out = enso_from_own_climatology(cube_coarse(spark, sf_dir), "price", threshold=500.0)
    return rounded(out, 6, "index")
