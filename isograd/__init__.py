"""Gridded and geospatial analytics expressed as Spark DataFrame plans."""

from isograd.model import Cube, Part, ValidationError
from isograd.session import prepare

__all__ = ["Cube", "Part", "ValidationError", "prepare"]
