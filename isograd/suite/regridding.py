"""Resampling and coregistration."""

from __future__ import annotations

from pyspark.sql import functions as F

from isograd.operators import regrid
from isograd.operators.axis import axis_info
from isograd.operators.subset import subset_spatial
from isograd.plans.views import cube_coarse, cube_fine
from isograd.suite.registry import case, rounded

FINE, COARSE, BOTH = ("cube_fine",), ("cube_coarse",), ("cube_coarse", "cube_fine")

_FINE_IDX = """src AS (SELECT time, CAST(round((lat + 82.5) / 15) AS BIGINT) AS y,
  CAST(round((lon + 172.5) / 15) AS BIGINT) AS x, price, qty FROM cube_fine)"""
_COARSE_IDX = """src AS (SELECT time, CAST(round((lat + 75) / 30) AS BIGINT) AS y,
  CAST(round((lon + 165) / 30) AS BIGINT) AS x, price, qty FROM cube_coarse)"""


def _weights(name: str, n: int, m: int) -> str:
    """Target cells of every source cell with the overlap of both, in source cells."""
    low, high = f"greatest(s, o * {n / m!r}::DOUBLE)", f"least(s + 1, (o + 1) * {n / m!r}::DOUBLE)"
    return (f"{name} AS (SELECT o, s, {high} - {low} AS w FROM range({m}) t(o), range({n}) u(s) "
            f"WHERE {high} - {low} > 1e-9)")


def _down(index: str, ny: int, my: int, nx: int, mx: int) -> str:
    return f"""WITH {index}, {_weights('wy', ny, my)}, {_weights('wx', nx, mx)},
parts AS (SELECT time, wy.o AS oy, wx.o AS ox, y, x, wy.w * wx.w AS w, price, qty
  FROM src JOIN wy ON wy.s = y JOIN wx ON wx.s = x)"""


def _label(my: int, mx: int) -> str:
    return (f"-90 + (oy + 0.5::DOUBLE) * {180 / my!r}::DOUBLE AS lat, "
            f"-180 + (ox + 0.5::DOUBLE) * {360 / mx!r}::DOUBLE AS lon")


def _fine(spark, sf_dir, height, width, **kwargs):
    return regrid.resample_grid(cube_fine(spark, sf_dir), height, width, **kwargs).df


@case("r4_downsample_mean", f"""{_down(_FINE_IDX, 12, 8, 24, 16)}
SELECT time, {_label(8, 16)}, round(sum(w * price) / sum(w), 4) AS price,
  round(sum(w * qty) / sum(w), 6) AS qty FROM parts GROUP BY time, oy, ox""", FINE)
def down_mean(spark, sf_dir):
    return rounded(rounded(_fine(spark, sf_dir, 8, 16), 4, "price"), 6, "qty")


@case("r5_downsample_first", f"""{_down(_FINE_IDX, 12, 8, 24, 16)}
SELECT time, {_label(8, 16)}, arg_min(price, (y, x)) AS price, arg_min(qty, (y, x)) AS qty
FROM parts GROUP BY time, oy, ox""", FINE)
def down_first(spark, sf_dir):
    return _fine(spark, sf_dir, 8, 16, method_ds="first")


@case("r5_downsample_last", f"""{_down(_FINE_IDX, 12, 8, 24, 16)}
SELECT time, {_label(8, 16)}, arg_max(price, (y, x)) AS price, arg_max(qty, (y, x)) AS qty
FROM parts GROUP BY time, oy, ox""", FINE)
def down_last(spark, sf_dir):
    return _fine(spark, sf_dir, 8, 16, method_ds="last")


def _mode(rank: int) -> str:
    def one(v: str) -> str:
        return f"""SELECT time, oy, ox, v AS {v} FROM (SELECT *, row_number() OVER (
    PARTITION BY time, oy, ox ORDER BY w DESC, place) AS n FROM (
    SELECT time, oy, ox, {v} AS v, round(sum(w), 9) AS w, min(y * 1000 + x) AS place FROM parts
    GROUP BY 1, 2, 3, 4)) WHERE n = {rank}"""
    return f"""{_down(_FINE_IDX, 12, 8, 24, 16)},
cells AS (SELECT DISTINCT time, oy, ox FROM parts), p AS ({one('price')}), q AS ({one('qty')})
SELECT time, {_label(8, 16)}, price, qty FROM cells LEFT JOIN p USING (time, oy, ox)
LEFT JOIN q USING (time, oy, ox)"""


def _mode_of(spark, sf_dir, rank):
    return _fine(spark, sf_dir, 8, 16, method_ds="mode", mode_rank=rank)


@case("r6_downsample_mode", _mode(1), FINE)
def down_mode(spark, sf_dir):
    return _mode_of(spark, sf_dir, 1)


@case("r6_downsample_mode_rank_2", _mode(2), FINE)
def down_mode_second(spark, sf_dir):
    return _mode_of(spark, sf_dir, 2)


_VAR = "(sum(w * {v} * {v}) * sum(w) - sum(w * {v}) * sum(w * {v})) / sum(w) / sum(w)"


@case("r7_downsample_var", f"""{_down(_FINE_IDX, 12, 8, 24, 16)}
SELECT time, {_label(8, 16)}, round({_VAR.format(v='qty')}, 2) AS qty
FROM parts GROUP BY time, oy, ox""", FINE)
def down_var(spark, sf_dir):
    return rounded(_fine(spark, sf_dir, 8, 16, method_ds="var").drop("price"), 2, "qty")


@case("r7_downsample_std", f"""{_down(_FINE_IDX, 12, 3, 24, 6)}
SELECT time, {_label(3, 6)}, round(sqrt(greatest({_VAR.format(v='qty')}, 0)), 3) AS qty
FROM parts GROUP BY time, oy, ox""", FINE)
def down_std(spark, sf_dir):
    return rounded(_fine(spark, sf_dir, 3, 6, method_ds="std").drop("price"), 3, "qty")


@case("r8_upsample_nearest", f"""WITH {_COARSE_IDX},
oy AS (SELECT o AS oy, CAST(floor({6 / 9!r}::DOUBLE * o) AS BIGINT) AS y FROM range(9) t(o)),
ox AS (SELECT o AS ox, CAST(floor({12 / 30!r}::DOUBLE * o) AS BIGINT) AS x FROM range(30) t(o))
SELECT time, {_label(9, 30)}, price, qty FROM src JOIN oy USING (y) JOIN ox USING (x)""", COARSE)
def up_nearest(spark, sf_dir):
    return regrid.resample_grid(cube_coarse(spark, sf_dir), 9, 30, method_us="nearest").df


def _corners(name: str, n: int, m: int) -> str:
    step = (n - 1.0) / (m - 1.0)
    return (f"{name} AS (SELECT o, f AS s0, least(f + 1, {n - 1}) AS s1, o * {step!r}::DOUBLE - f "
            f"AS w FROM (SELECT o, CAST(floor(o * {step!r}::DOUBLE) AS BIGINT) AS f "
            f"FROM range({m}) t(o)))")


def _linear(index: str, ny: int, my: int, nx: int, mx: int, label: str) -> str:
    def value(v: str) -> str:
        a, b, c, d = (f"k{k}.{v}" for k in ("00", "01", "10", "11"))
        low = f"({a} + wx * ({b} - {a}))"
        high = f"({c} + wx * ({d} - {c}))"
        return f"""round(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL
    AND {d} IS NOT NULL THEN {low} + wy * ({high} - {low})
  WHEN wx < 0.5 THEN CASE WHEN wy < 0.5 THEN {a} ELSE {c} END
  ELSE CASE WHEN wy < 0.5 THEN {b} ELSE {d} END END, 6) AS {v}"""
    return f"""WITH {index}, {_corners('cy', ny, my)}, {_corners('cx', nx, mx)},
grid AS (SELECT time, cy.o AS oy, cx.o AS ox, cy.s0 AS y0, cy.s1 AS y1, cx.s0 AS x0, cx.s1 AS x1,
  cy.w AS wy, cx.w AS wx FROM (SELECT DISTINCT time FROM src), cy, cx)
SELECT grid.time, {label}, {value('price')}, {value('qty')} FROM grid
LEFT JOIN src k00 ON k00.time = grid.time AND k00.y = y0 AND k00.x = x0
LEFT JOIN src k01 ON k01.time = grid.time AND k01.y = y0 AND k01.x = x1
LEFT JOIN src k10 ON k10.time = grid.time AND k10.y = y1 AND k10.x = x0
LEFT JOIN src k11 ON k11.time = grid.time AND k11.y = y1 AND k11.x = x1
WHERE k00.time IS NOT NULL OR k01.time IS NOT NULL OR k10.time IS NOT NULL OR k11.time IS NOT NULL"""


@case("r9_upsample_linear", _linear(_COARSE_IDX, 6, 10, 12, 20, _label(10, 20)), COARSE)
def up_linear(spark, sf_dir):
    out = regrid.resample_grid(cube_coarse(spark, sf_dir), 10, 20).df
    return rounded(out, 6, "price", "qty")


@case("r3_resample_mixed", f"""{_down(_FINE_IDX, 12, 5, 24, 24)},
half AS (SELECT time, oy AS y, ox AS x, round(sum(w * qty) / sum(w), 9) AS qty FROM parts
  GROUP BY 1, 2, 3),
ox AS (SELECT o AS ox, CAST(floor({24 / 36!r}::DOUBLE * o) AS BIGINT) AS x FROM range(36) t(o))
SELECT time, {_label(5, 36).replace('oy', 'y')}, round(qty, 6) AS qty FROM half JOIN ox USING (x)""",
      FINE)
def mixed(spark, sf_dir):
    out = _fine(spark, sf_dir, 5, 36, method_us="nearest").drop("price")
    return rounded(out, 6, "qty")


@case("r1_coregister_down", f"""{_down(_FINE_IDX, 12, 6, 24, 12)}
SELECT time, -75 + 30 * oy::DOUBLE AS lat, -165 + 30 * ox::DOUBLE AS lon,
  round(sum(w * price) / sum(w), 6) AS price, round(sum(w * qty) / sum(w), 6) AS qty
FROM parts GROUP BY time, oy, ox""", BOTH)
def coregister_down(spark, sf_dir):
    out = regrid.coregister(cube_coarse(spark, sf_dir), cube_fine(spark, sf_dir)).df
    return rounded(out, 6, "price", "qty")


@case("r1_coregister_up", _linear(_COARSE_IDX, 6, 12, 12, 24, """-82.5 + 15 * oy::DOUBLE AS lat,
  -172.5 + 15 * ox::DOUBLE AS lon"""), BOTH)
def coregister_up(spark, sf_dir):
    out = regrid.coregister(cube_fine(spark, sf_dir), cube_coarse(spark, sf_dir)).df
    return rounded(out, 6, "price", "qty")


@case("r1_coregister_part_of_globe", f"""WITH {_FINE_IDX.replace('FROM cube_fine', '''FROM cube_fine
  WHERE lat BETWEEN -30 AND 60 AND lon BETWEEN -90 AND 90''')}
SELECT time, -75 + 30 * (y // 2)::DOUBLE AS lat, -165 + 30 * (x // 2)::DOUBLE AS lon,
  round(avg(price), 6) AS price FROM src GROUP BY time, y // 2, x // 2""", BOTH)
def coregister_part(spark, sf_dir):
    part = subset_spatial(cube_fine(spark, sf_dir), (-82.0, -23.0, 82.0, 53.0))
    out = regrid.coregister(cube_coarse(spark, sf_dir), part).df.drop("qty")
    return rounded(out, 6, "price")


@case("r2_grid_checks", """SELECT count(DISTINCT lat) AS rows, count(DISTINCT lon) AS columns,
  min(lat) - 7.5 AS south, max(lat) + 7.5 AS north, TRUE AS equidistant FROM cube_fine""", FINE)
def grid_checks(spark, sf_dir):
    cube = cube_fine(spark, sf_dir)
    info = axis_info(cube, "lat", "lon")
    for dim, low in (("lat", -90.0), ("lon", -180.0)):
        regrid.check_grid(info[dim], low, "replica")
    low, high = regrid.intersection(info["lat"], info["lat"])
    return cube.df.agg(F.count_distinct("lat").alias("rows"),
                       F.count_distinct("lon").alias("columns"),
                       F.lit(low).alias("south"), F.lit(high).alias("north"),
                       F.lit(info["lat"].equidistant()).alias("equidistant"))
