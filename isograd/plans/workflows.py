"""Shipped workflows: several operators in one lazily built plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from isograd.model import Cube
from isograd.operators.aggregate import long_term_average
from isograd.operators.anomaly import REGIONS, index_series
from isograd.operators.regrid import coregister
from isograd.operators.select import select_var
from isograd.operators.stats import pearson_correlation
from isograd.operators.subset import subset_spatial, subset_temporal
from isograd.operators.tables import slice_table


def regional_correlation(x: Cube, y: Cube, var_x: str, var_y: str, region) -> Cube:
    """Correlation map of two variables in a region, with y resampled onto the grid of x."""
    near_x = subset_spatial(select_var(x, var_x), region)
    near_y = subset_spatial(select_var(y, var_y), region)
    return pearson_correlation(near_x, coregister(near_x, near_y), var_x, var_y)


def enso_from_own_climatology(cube: Cube, var: str, region: str = "N3.4", window: int = 5,
                              threshold: float | None = None, name: str = "index") -> DataFrame:
    """Climatology, anomaly and rolling index of one cube."""
    climatology = long_term_average(select_var(cube, var))
    return index_series(cube, var, REGIONS[region], window, climatology, name, threshold)


def polar_map(cube: Cube, var: str, time_range, region, indexers=None) -> DataFrame:
    """Data of a map: variables, time and region are cut first, then one time slice is taken."""
    cut = subset_temporal(select_var(cube, var), time_range)
    return slice_table(subset_spatial(cut, region), var, indexers)
