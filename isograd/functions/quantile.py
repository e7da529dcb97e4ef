"""Exact quantiles (linear interpolation) that no single task has to hold.

Spark's ``percentile`` keeps all distinct values of a group in one buffer.  That is used while a
group is known to be small.  Beyond that the wanted order statistics are closed in on: each round
counts values per value bucket, with map-side combine, and keeps only the buckets that hold a
wanted rank, until what is left of every group is small.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isograd.operators.axis import hint_small
from isograd.session import checkpoint

#: Largest number of rows of one group that ``percentile`` is used for.
GROUP_ROWS = 4_000_000
BUCKETS = 4096


def percentile_columns(values: dict[str, Sequence[float]]) -> list[Column]:
    return [F.percentile(F.col(v), F.array(*map(F.lit, p))).alias(v) for v, p in values.items()]


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float],
              group_rows: int | None = None, limit: int | None = None,
              buckets: int = BUCKETS) -> DataFrame:
    """``keys`` + ``q``: an array of quantiles of the non-null values of each group.

    Every group has a row, whatever its size: NULL is a key like others, and a group without values
    has a NULL array. ``group_rows`` is an upper bound of the rows per group if the caller knows one.
    """
    keys, limit = list(keys), GROUP_ROWS if limit is None else limit
    rows = df.select(*keys, F.col(value).cast("double").alias("v"))
    if group_rows is None:
        largest = rows.groupBy(*keys).agg(F.count("v").alias("n")).agg(F.max("n")).first()[0]
        group_rows = largest or 0
    if group_rows <= limit:
        return rows.groupBy(*keys).agg(
            F.percentile("v", F.array(*map(F.lit, probabilities))).alias("q"))
    found = _close_in(rows.where("v IS NOT NULL"), keys, probabilities, limit, buckets)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if not keys:
        return groups.select(found.select("q").scalar().alias("q"))
    return join_null_safe(groups, found, keys, "left").select(*keys, "q")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys that may be NULL; the keys are those of the left side."""
    right = right.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys])
    return left.join(right, same, how).drop(*(f"__k_{k}" for k in keys))


def _with_spans(rows: DataFrame, keys: list[str], spans: DataFrame, count: int) -> DataFrame:
    """Each row with the spans of its group that it lies in.

    Without keys there are two spans per quantile, which are then constants of the plan.
    """
    inside = F.col("v").between(F.col("lo"), F.col("hi"))
    if keys:
        return join_null_safe(rows, hint_small(spans, count), keys, "inner").where(inside)
    fixed = [F.struct(*(F.lit(value).alias(name) for name, value in row.asDict().items()))
             for row in spans.collect()]
    return rows.select("v", F.inline(F.array(*fixed))).where(inside)


def _finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def _ends() -> list[Column]:
    """Smallest and largest value, and smallest and largest finite one."""
    v = F.col("v")
    return [F.min(v).alias("lo"), F.max(v).alias("hi"), F.min(_finite(v)).alias("flo"),
            F.max(_finite(v)).alias("fhi")]


def _close_in(rows: DataFrame, keys: list[str], probabilities, limit: int,
              buckets: int) -> DataFrame:
    """Both neighbours of every quantile's position are tracked as separate ranks."""
    wanted = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"),
                 (F.floor((F.col("n") - 1) * p) + side).alias("rank"))
        for i, p in enumerate(probabilities) for side in (0, 1)])
    spans = checkpoint(
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *_ends())
        .where("n > 0")
        .select(*keys, "n", "lo", "hi", "flo", "fhi", F.inline(wanted))
        .withColumn("rank", F.least("rank", F.col("n") - 1))
        .withColumn("left", F.col("n")))
    before = None
    while True:
        targets, largest = spans.agg(
            F.count(F.lit(1)), F.max(F.when(F.col("lo") < F.col("hi"), F.col("left")))).first()
        # neighbouring doubles, which no bucket parts, are left to the last step, which counts them
        if largest is None or largest <= limit or largest == before:
            break
        before = largest
        spans = checkpoint(_narrow(rows, keys, spans, targets, buckets))
    if not targets:
        return rows.select(*keys, F.lit(None).cast("array<double>").alias("q")).limit(0)
    # rank counts from the span's own lowest value
    mark = [*keys, "i", "side"]
    counted = _with_spans(rows, keys, spans, targets).groupBy(*mark, "rank", "n", "v").agg(
        F.count(F.lit(1)).alias("c"))
    upto = Window.partitionBy(*mark).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    found = counted.withColumn("upto", F.sum("c").over(upto)).where(
        (F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("c") <= F.col("rank")))
    ends = found.groupBy(*keys, "i", "n").agg(
        F.max(F.when(F.col("side") == 0, F.col("v"))).alias("a"),
        F.max(F.when(F.col("side") == 1, F.col("v"))).alias("b"))
    p = F.element_at(F.array(*map(F.lit, probabilities)), F.col("i") + 1)
    place = (F.col("n") - 1) * p
    low = F.floor(place)
    # weights as the built-in percentile has them, so that both ways agree to the last bit
    mixed = F.when((place == low) | (F.col("a") == F.col("b")), F.col("a")).otherwise(
        (low + 1 - place) * F.col("a") + (place - low) * F.col("b"))
    return ends.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("i", mixed.alias("x")))),
                    lambda e: e.x).alias("q"))


def _narrow(rows: DataFrame, keys: list[str], spans: DataFrame, targets: int,
            buckets: int) -> DataFrame:
    """Replace each span by the bucket of it that holds the wanted rank.

    The infinities have buckets of their own below and above those of the finite values.
    """
    mark = [*keys, "i", "side"]
    width = F.col("fhi") / buckets - F.col("flo") / buckets
    inner = F.least(F.floor((F.col("v") / buckets - F.col("flo") / buckets)
                            / F.nullif(width, F.lit(0.0)) * buckets), F.lit(buckets - 1))
    bucket = (F.when(F.col("v") == float("-inf"), F.lit(-1))
              .when(F.col("v") == float("inf"), F.lit(buckets))
              .otherwise(F.coalesce(inner, F.lit(0))))
    counts = _with_spans(rows, keys, spans, targets).groupBy(
        *mark, "n", "rank", bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("c"), *_ends())
    upto = Window.partitionBy(*mark).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    below = F.col("upto") - F.col("c")
    return counts.withColumn("upto", F.sum("c").over(upto)).where(
        (F.col("upto") > F.col("rank")) & (below <= F.col("rank"))).select(
        *keys, "n", "lo", "hi", "flo", "fhi", "i", "side", (F.col("rank") - below).alias("rank"),
        F.col("c").alias("left"))
