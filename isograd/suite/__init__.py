"""Queries over the star-schema tables, one or more per operator, with SQL that checks them."""

from isograd.suite import (  # noqa: F401
    aggregates,
    anomalies,
    charts,
    features,
    normalising,
    regridding,
    sources,
    statistics,
    subsets,
)
from isograd.suite.registry import CASES

__all__ = ["CASES"]
