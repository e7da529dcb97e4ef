"""Bitmaps of hashes: a filter of bounded size that lets through what it holds, and little else.

Two bits stand for a hash. The size follows the number of hashes up to 32 MB; beyond that more of what
it doesn't hold passes, so it must only ever save work and never decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isograd.llm.hashing import mix

#: Bits of the bitmap: by hash, at least, at most.
PER_HASH, LEAST, MOST = 256, 1 << 24, 1 << 28


def _slots(values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix(np.ascontiguousarray(values).view(np.uint64).copy())
    return h & np.uint64(bits - 1), (h >> np.uint64(34)) & np.uint64(bits - 1)


def bitmap(rows: DataFrame, column: str) -> np.ndarray:
    """Bitmap of a long column."""
    count, bits = rows.count(), LEAST
    while bits < min(MOST, count * PER_HASH):
        bits *= 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            for slot in _slots(batch.column(0).to_numpy(), bits):
                np.bitwise_or.at(own, (slot >> np.uint64(3)).astype(np.int64),
                                 np.left_shift(1, slot & np.uint64(7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([own.tobytes()], pa.binary())], names=["b"])

    out = np.zeros(bits // 8, np.uint8)
    for row in rows.select(column).coalesce(4).mapInArrow(run, "b binary").toLocalIterator():
        out |= np.frombuffer(row.b, np.uint8)
    return out


def held(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value may be in the bitmap."""
    out = np.ones(len(values), bool)
    for slot in _slots(values, 8 * len(known)):
        out &= (known[(slot >> np.uint64(3)).astype(np.int64)]
                >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out
