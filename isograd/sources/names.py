"""What file names tell: timestamps, and wildcard filters over listings."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digit runs that are read as a timestamp, longest first.
STAMP_FORMATS = (
    (14, "yyyyMMddHHmmss"),
    (12, "yyyyMMddHHmm"),
    (8, "yyyyMMdd"),
    (6, "yyyyMM"),
    (4, "yyyy"),
)


def _run(text: Column) -> tuple[Column, Column]:
    """(timestamp, 1-based end) of the first digit run of the longest length present."""
    stamp, end = F.lit(None).cast("timestamp_ntz"), F.lit(None).cast("int")
    for length, pattern in reversed(STAMP_FORMATS):
        digits = F.regexp_extract(text, rf"(\d{{{length}}})", 1)
        here = digits != ""
        value = F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit(pattern))
        stamp = F.when(here, value.cast("timestamp_ntz")).otherwise(stamp)
        end = F.when(here, F.instr(text, digits) + F.lit(length)).otherwise(end)
    return stamp, end


def timestamp_in_name(text: Column) -> Column:
    """The timestamp a name contains, or NULL."""
    return _run(text)[0]


def timestamps_in_name(text: Column) -> tuple[Column, Column]:
    """Two timestamps: the second one is looked for after the first."""
    first, end = _run(text)
    rest = F.when(end.isNotNull(), F.substring(text, end, F.length(text)))
    return first, _run(rest)[0]


def _any(name: Column, patterns: Iterable[str]) -> Column:
    return reduce(Column.__or__, [name.rlike(fnmatch.translate(p)) for p in patterns],
                  F.lit(False))


def filter_fileset(files: DataFrame, includes: Iterable[str] | None = None,
                   excludes: Iterable[str] | None = None, column: str = "name") -> DataFrame:
    """Rows whose name fits an include pattern (if any are given) and no exclude pattern."""
    name = F.col(column)
    if includes is not None:
        files = files.where(_any(name, includes))
    if excludes is not None:
        files = files.where(~_any(name, excludes))
    return files


def list_files(spark, path: str, pattern: str = "*", recursive: bool = True) -> DataFrame:
    """(path, name, modificationTime, length) of files, without reading their contents."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
               .option("recursiveFileLookup", str(recursive).lower()).load(path))
    return listing.select("path", F.element_at(F.split("path", "/"), -1).alias("name"),
                          "modificationTime", "length")
