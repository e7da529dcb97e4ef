"""Period aggregation of cells that keep arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.functions.periods import SECONDS, Period
from isograd.model import ValidationError
from isograd.operators.aggregate import reducer


def stream_aggregation(cells: DataFrame, dims: Sequence[str], variables: Sequence[str],
                       period: str = "1D", method: str = "mean",
                       lateness: str = "1 day") -> DataFrame:
    """Aggregate streaming cells into clock periods; a bin is emitted once it can not change.

    ``time`` must be a timestamp column.  Cells later than ``lateness`` are left out.
    """
    parsed = Period.parse(period)
    if parsed.unit not in SECONDS:
        raise ValidationError(f'period "{period}" has no fixed length')
    length = f"{parsed.count * SECONDS[parsed.unit]} seconds"
    rest = [d for d in dims if d != "time"]
    binned = cells.withWatermark("time", lateness).groupBy(
        F.window("time", length).alias("bin"), *rest)
    out = binned.agg(*(reducer(method, F.col(v)).alias(v) for v in variables))
    return out.select(F.col("bin.start").alias("time"), *rest, *variables)
