"""Exact top-k search by inner product: a join over Voronoi cells.

Pivots are drawn from the data; every vector belongs to the cell of its nearest pivot. A cell's summary
(count, largest distance from the pivot) bounds the scores in it: with pivot c and radius R no member
scores over ``q.c + |q| R``. Each query first solves one part of its most promising cell, queries taking
turns over its parts; its k-th score there is a floor, and the query goes on only to cells whose bound
reaches it. Queries are what is replicated, as they are the smaller side. Cells are split into parts of
bounded size, so a vector that fills a third of the table is spread over many tasks. Queries that ask for
a part are counted first and split into blocks of bounded size; a part is sent once to each of its blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isograd.llm.common import written

SCALE = 64
#: Most pivots, vectors per pivot wanted, most vectors of a part, and about the most queries of a block.
PIVOTS, PER_PIVOT, PART, QUERIES = 256, 512, 16_384, 4096
#: Pairs of query and part in a batch.
PAIRS = 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (vectors.select("vec_id", "embedding")
            .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad))


def _matrix(column, dim: int) -> np.ndarray:
    """floor(64 x) of a list column; shorter vectors are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = np.asarray(column.value_lengths(), np.int64)
    flat = np.floor(SCALE * np.asarray(column.flatten(), np.float64))
    if len(lengths) and (lengths == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    at = 0
    for row, n in enumerate(lengths):
        out[row, :n] = flat[at:at + n]
        at += n
    return out


def _unpack(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, dim)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; in floating point where that is exact."""
    largest = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if largest < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best(scores: np.ndarray, ids: np.ndarray, k: int, floor: float) -> np.ndarray:
    """Places of the k largest scores from the floor on, ties to the smaller id."""
    at = np.flatnonzero(scores >= floor)
    if len(at) > k:
        edge = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= edge]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


_FOUND = "query_id long, vec_id long, score long"


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best others, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by ``every``; rows of the query's own vec_id are no
    candidates. Vectors that are null or hold a null or non-finite component, and rows without vec_id,
    take no part. Repeated rows are candidates each; a repeated query is one. Shorter vectors count as
    filled with zeros. An empty table gives no rows; with k others or fewer all are returned.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dim")).first()
    n, dim = facts.n, max(1, facts.dim or 0)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = int(min(PART, max(256, n // (4 * partitions))))
    most = int(min(QUERIES, max(256, part // 4)))
    drawn = (rows.orderBy(F.xxhash64("vec_id"), "vec_id")
             .limit(int(min(PIVOTS, max(1, n // PER_PIVOT)))).collect())
    pivots = np.zeros((max(1, len(drawn)), dim))
    for row, r in enumerate(drawn):
        pivots[row, :len(r.embedding)] = np.floor(SCALE * np.array(r.embedding, np.float64))
    squares = (pivots ** 2).sum(axis=1)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim)
            gaps = squares - 2 * (x @ pivots.T) + (x ** 2).sum(axis=1)[:, None]
            cell = gaps.argmin(axis=1)
            away = np.sqrt(np.maximum(gaps[np.arange(len(x)), cell], 0))
            raw = x.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(cell.astype(np.int32)),
                 pa.array(away), pa.array([v.tobytes() for v in raw], pa.binary())],
                names=["vec_id", "cell", "away", "vec"])

    cells = written(rows.mapInArrow(assign, "vec_id long, cell int, away double, vec binary"),
                    "cells")
    radius, parts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in cells.groupBy("cell").agg(F.max("away").alias("r"),
                                       F.count(F.lit(1)).alias("n")).collect():  # a row per pivot
        radius[r.cell], parts[r.cell] = r.r, -(-r.n // part)
    first = np.cumsum(parts) - parts
    at = F.element_at(F.array(*(F.lit(int(v)) for v in first)), F.col("cell") + 1)
    share = F.element_at(F.array(*(F.lit(int(max(1, v))) for v in parts)), F.col("cell") + 1)
    data = cells.select("vec_id", "vec", (at + F.pmod(F.xxhash64("vec_id", "vec"), share)).cast("int")
                        .alias("part"))
    queries = written(cells.where(F.col("vec_id") % every == 0).select("vec_id", "vec")
                      .dropDuplicates(["vec_id", "vec"])
                      .withColumn("turn", F.xxhash64("vec_id", "vec", F.lit(7)).bitwiseAND(2 ** 62 - 1)),
                      "queries")

    def bounds(q: np.ndarray) -> np.ndarray:
        # a little room for the rounding of distances
        upper = q @ pivots.T + np.sqrt((q ** 2).sum(axis=1))[:, None] * (radius * (1 + 1e-9) + 1e-6)
        upper[:, parts == 0] = -np.inf
        return upper

    def own_part(upper: np.ndarray, turn: np.ndarray) -> np.ndarray:
        cell = upper.argmax(axis=1)
        return first[cell] + turn % np.maximum(parts[cell], 1)

    def start(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the batch and the parts that they ask for."""
        upper = bounds(_unpack(batch.column(1), dim).astype(np.float64))
        yield np.arange(len(upper)), own_part(upper, batch.column(2).to_numpy())

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            ids = right["vec_id"].to_numpy()
            x = _unpack(right["vec"], dim)
            for low in range(0, left.num_rows, 512):
                some = left.slice(low, 512)
                scores = products(_unpack(some["qvec"], dim), x)
                for row, (query, floor) in enumerate(zip(some["query_id"].to_pylist(),
                                                         some["floor"].to_pylist())):
                    others = np.where(ids == query, np.iinfo(np.int64).min, scores[row])
                    place = best(others, ids, k, max(floor, -2.0 ** 62))
                    out[0].append(np.full(len(place), query))
                    out[1].append(ids[place])
                    out[2].append(others[place])
        arrays = [pa.array(np.concatenate(c).astype(np.int64) if c else np.zeros(0, np.int64))
                  for c in out]
        return pa.Table.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    def go_on(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same for all parts of the cells that may hold more, without the part that is done."""
        upper = bounds(_unpack(batch.column(1), dim).astype(np.float64))
        done = own_part(upper, batch.column(2).to_numpy())
        floor = batch.column(3).to_numpy()
        owner, to, size = [], [], 0
        for row in range(len(upper)):
            for c in np.flatnonzero(upper[row] >= floor[row]):
                places = np.arange(first[c], first[c] + parts[c])
                places = places[places != done[row]]
                owner.append(np.full(len(places), row))
                to.append(places)
                size += len(places)
                if size >= PAIRS:
                    yield np.concatenate(owner), np.concatenate(to)
                    owner, to, size = [], [], 0
        if size:
            yield np.concatenate(owner), np.concatenate(to)

    def solved(rows: DataFrame, step) -> DataFrame:
        """What the queries find in the parts that they ask for."""
        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            asks = np.zeros(int(parts.sum()), np.int64)
            for batch in batches:
                for _, to in step(batch):
                    asks += np.bincount(to, minlength=len(asks))
            at = np.flatnonzero(asks)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(asks[at])],
                                             names=["part", "n"])

        blocks = np.zeros(int(parts.sum()), np.int64)
        for r in (rows.mapInArrow(count, "part int, n long").groupBy("part")
                  .agg(F.sum("n").alias("n")).collect()):  # a row per part
            blocks[r.part] = -(-r.n // most)

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                turn = batch.column(2).to_numpy()
                for every_owner, every_to in step(batch):
                    for low in range(0, len(every_to), PAIRS):
                        owner, to = every_owner[low:low + PAIRS], every_to[low:low + PAIRS]
                        # other bits of the turn than those that dealt the queries to the parts
                        block = (turn[owner] >> 31) % blocks[to]
                        owner = pa.array(owner)
                        yield pa.RecordBatch.from_arrays(
                            [*(batch.column(c).take(owner) for c in (0, 1, 3)),
                             pa.array(to.astype(np.int32)), pa.array(block.astype(np.int32))],
                            names=["query_id", "qvec", "floor", "part", "block"])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                times = blocks[batch.column(2).to_numpy()]
                for block in range(int(times.max(initial=0))):
                    some = batch.filter(pa.array(times > block))
                    yield pa.RecordBatch.from_arrays(
                        [*some.columns, pa.array(np.full(some.num_rows, block, np.int32))],
                        names=["vec_id", "vec", "part", "block"])

        left = rows.mapInArrow(ask, "query_id long, qvec binary, floor double, part int, block int")
        right = data.mapInArrow(send, "vec_id long, vec binary, part int, block int")
        return (left.groupBy("part", "block").cogroup(right.groupBy("part", "block"))
                .applyInArrow(solve, _FOUND))

    none = F.lit(float("-inf"))
    found = written(solved(queries.select("vec_id", "vec", "turn", none.alias("floor")), start), "found")
    floors = found.groupBy("query_id").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).otherwise(none).alias("known"))
    further = written(queries.join(floors, F.col("vec_id") == F.col("query_id"), "left")
                      .select("vec_id", "vec", "turn", F.coalesce("known", none).alias("floor")),
                      "further")
    more = solved(further, go_on)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.unionByName(more).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score
  FROM (SELECT * FROM v WHERE vec_id % 20 = 0) q JOIN v ON v.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
