"""Gap filling along an order column, without ever sorting the whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isograd.model import ValidationError, null_if_nan
from isograd.session import checkpoint

# Names of the two directions.
FORWARD = ("ffill", "pad")
BACKWARD = ("bfill", "backfill")


def fillna(df: DataFrame, value=None, method: str | None = None, limit: int | None = None, *,
           order: str | None = None, columns: Sequence[str] | None = None,
           partition_by: Sequence[str] = ()) -> DataFrame:
    """Fill missing values by a constant, or by the last or next valid value in ``order``.

    ``limit`` is the number of consecutive rows filled at most.  A value or limit of 0 counts as
    not given.  Each group of ``partition_by`` is a series of its own.  Rows that are equal in ``order``
    stay in the order in which they are read.
    """
    if bool(value) == bool(method):
        raise ValidationError("exactly one of value and method must be given")
    fixed = {order, *partition_by}
    names = list(columns) if columns is not None else [c for c in df.columns if c not in fixed]
    clean = df.select(*(null_if_nan(df, c) for c in df.columns))
    if value:
        return clean.na.fill(value, subset=names)
    if method not in FORWARD + BACKWARD:
        raise ValidationError(f"unknown fill method '{method}'")
    if order is None:
        raise ValidationError("a fill direction needs an order column")
    return _carry(clean, names, order, list(partition_by), method in BACKWARD, limit)


def in_ranges(df: DataFrame, order: str, keys: Sequence[str]) -> DataFrame:
    """The rows dealt to ranges of the order column of about equal size, numbered by ``__bucket``.

    The series key and then the place in the table (``__tie``) break ties, so that a value of the order
    column that many rows share is split.  The boundaries are drawn anew by every plan that holds this
    one: whoever reads the buckets twice has to write them first.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.withColumn("__tie", F.monotonically_increasing_id())
            .repartitionByRange(n, order, *keys, "__tie").withColumn("__bucket", F.spark_partition_id()))


def _carry(df: DataFrame, names: list[str], order: str, keys: list[str], backward: bool,
           limit: int | None) -> DataFrame:
    """Fill inside each range of the order column, then carry one value per range across.

    The rows are numbered and filled inside their ranges once, and written: the values to carry and the
    rows that take them are read from the same table, in the partitions in which it was written.
    """
    sort = ([F.col(order).desc(), F.col("__tie").desc()] if backward
            else [F.col(order).asc(), F.col("__tie").asc()])
    bucket_sort = F.col("__bucket").desc() if backward else F.col("__bucket").asc()
    rows = in_ranges(df, order, keys)
    inside = Window.partitionBy(*keys, "__bucket").orderBy(*sort).rowsBetween(
        Window.unboundedPreceding, 0)
    rows = rows.withColumn("__row", F.row_number().over(
        Window.partitionBy(*keys, "__bucket").orderBy(*sort)))
    for name in names:
        valid = F.col(name).isNotNull()
        rows = rows.withColumn(f"__v_{name}", F.last(F.col(name), ignorenulls=True).over(inside))
        rows = rows.withColumn(f"__r_{name}", F.last(F.when(valid, F.col("__row")),
                                                     ignorenulls=True).over(inside))
    rows = checkpoint(rows)
    earlier = Window.partitionBy(*keys).orderBy(bucket_sort).rowsBetween(
        Window.unboundedPreceding, -1)
    ends = rows.groupBy(*keys, "__bucket").agg(
        F.count(F.lit(1)).alias("__size"),
        *(F.max_by(F.col(f"__v_{n}"), F.col("__row")).alias(f"__ev_{n}") for n in names),
        *(F.max(f"__r_{n}").alias(f"__er_{n}") for n in names))
    ends = ends.withColumn("__offset", F.coalesce(F.sum("__size").over(earlier), F.lit(0)))
    for name in names:
        place = F.col("__offset") + F.col(f"__er_{name}")
        ends = ends.withColumn(f"__p_{name}", place)
        ends = ends.withColumn(f"__cv_{name}", F.last(F.col(f"__ev_{name}"), ignorenulls=True)
                               .over(earlier))
        ends = ends.withColumn(f"__cp_{name}", F.last(F.col(f"__p_{name}"), ignorenulls=True)
                               .over(earlier))
    carried = ends.select(*(F.col(k).alias(f"__k_{k}") for k in keys),
                          F.col("__bucket").alias("__b"), "__offset",
                          *(c for n in names for c in (f"__cv_{n}", f"__cp_{n}")))
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys],
                  F.col("__bucket") == F.col("__b"))
    joined = rows.join(carried, same)

    def filled(name: str) -> Column:
        here = F.col("__offset") + F.col("__row")
        last_at = F.coalesce(F.col("__offset") + F.col(f"__r_{name}"), F.col(f"__cp_{name}"))
        value = F.coalesce(F.col(f"__v_{name}"), F.col(f"__cv_{name}"))
        if limit:
            value = F.when(here - last_at <= limit, value)
        return F.coalesce(F.col(name), value).alias(name)

    return joined.select(*(filled(c) if c in names else F.col(c) for c in df.columns))
