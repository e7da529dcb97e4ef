"""Helpers of the corpus operators: tables, written intermediate results, work-sharing by buckets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isograd.session import scratch

#: Bytes of text that a task turns into arrays at a time.
BLOCK = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, cut from their lineage by a table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucket_count(docs: DataFrame, column: str = "text", size: int = 4 << 20) -> int:
    """Buckets of about ``size`` bytes each; never few against the shuffle partitions, so they mix."""
    total = docs.agg(F.sum(F.octet_length(column))).first()[0] or 0
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return int(max(total // size + 1, 8 * partitions))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(
        column.type) else pa.large_string()
    column = column.cast(kind)
    if column.null_count:
        column = column.fill_null(b"" if kind == pa.large_binary() else "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``size`` bytes, one row at least."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1
        high = min(rows, max(high, low + 1))
        yield low, high
        low = high


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int,
                    longest: int) -> list[tuple[str, int]]:
    """At most ``per_class`` texts of either label, in the order of a hash of the id, and their labels.

    Only rows for which ``train`` holds and texts of 1 to ``longest`` bytes are drawn, so that what the
    driver gets is bounded by ``2 * per_class * longest`` bytes.
    """
    known = (labels.where(F.col(label).isin(0, 1))
             .select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
             .distinct())
    rows = (docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
            .where(train("_id") & F.octet_length("_text").between(1, longest)))
    found: list[tuple[str, int]] = []
    for value in (0, 1):
        # ids first: the sort moves no texts
        ids = (known.where(F.col("_label") == value)
               .join(rows.select("_id"), "_id", "left_semi").select("_id")
               .orderBy(F.xxhash64("_id"), "_id").limit(per_class))
        drawn = [r._id for r in ids.collect()]
        got = rows.where(F.col("_id").isin(drawn)).dropDuplicates(["_id", "_text"]).collect()
        found += [(r._text, value) for r in sorted(got, key=lambda r: (r._id, r._text))]
    return found


def share_of_ones(labels: DataFrame, label: str, train) -> float | None:
    """The share of label 1 among the rows to learn from; None without such rows."""
    return (labels.where(train("doc_id") & F.col(label).isin(0, 1))
            .agg(F.avg(F.col(label).cast("double"))).first()[0])


def remainder(column: str, modulus: int):
    """crc32 of the id as text, modulo; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1))


def logistic(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 1e-3) -> np.ndarray:
    """Weights (constant last) of a logistic fit whose classes weigh as the prior says."""
    x = np.c_[x, np.ones(len(x))]
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    share = np.where(y == 1, prior / max(1, (y == 1).sum()), (1 - prior) / max(1, (y == 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - y)) + ridge * np.r_[w[:-1], 0]
        curve = (x.T * (share * np.maximum(p * (1 - p), 1e-6))) @ x + ridge * np.eye(len(w)) * 1.0
        step = np.linalg.solve(curve, grad)
        w -= step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-8:
            break
    return w
