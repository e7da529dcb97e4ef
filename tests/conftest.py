from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import SparkSession

from isograd import Cube, prepare


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests")
               .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("OFF")
    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """A cube from arrays: make(lats, lons, times, first=array or function)."""
    def build(lats, lons, times=None, extra=None, **variables):
        axes = {}
        if times is not None:
            axes["time"] = list(times)
        axes.update(extra or {})
        axes.update(lat=[float(v) for v in lats], lon=[float(v) for v in lons])
        shape = tuple(len(a) for a in axes.values())
        arrays = {n: np.broadcast_to(np.asarray(v, dtype=float), shape)
                  for n, v in variables.items()}
        rows = [tuple(list(a)[i] for a, i in zip(axes.values(), index))
                + tuple(float(arrays[n][index]) for n in arrays)
                for index in np.ndindex(*shape)]

        def kind(name, values):
            if name in ("lat", "lon"):
                return "double"
            return {"datetime": "timestamp_ntz", "int": "int", "float": "double",
                    "str": "string"}[type(values[0]).__name__]

        schema = ", ".join([f"{n} {kind(n, v)}" for n, v in axes.items()]
                           + [f"{n} double" for n in arrays])
        return Cube.of(spark.createDataFrame(rows, schema), list(axes))

    return build


@pytest.fixture(scope="session")
def grid():
    """The lat × lon array of one variable of a cube without other dims, south to north."""
    def collect(cube, name="first"):
        rows = cube.part_of(name).df.select("lat", "lon", name).collect()
        lats, lons = sorted({r.lat for r in rows}), sorted({r.lon for r in rows})
        out = np.full((len(lats), len(lons)), np.nan)
        for r in rows:
            if r[name] is not None:
                out[lats.index(r.lat), lons.index(r.lon)] = r[name]
        return out

    return collect
