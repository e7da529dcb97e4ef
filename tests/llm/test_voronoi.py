import math
import random

from pyspark.accumulators import AccumulatorParam

from isograd.llm import voronoi

VECTORS = "vec_id long, embedding array<float>, label int, score long"


def brute(rows, k, every):
    use = [(i, [math.floor(64 * x) for x in v]) for i, v in rows
           if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for query, q in sorted({(i, tuple(v)) for i, v in use if i % every == 0}):
        scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in use if i != query)
        out += [(query, rank, i, -s) for rank, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def run(spark, rows, k=20, every=20):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], VECTORS)
    return sorted(tuple(r) for r in voronoi.top_k(df, k, every).collect())


def exact(x):
    """A value that 32-bit floats hold."""
    return round(x * 256) / 256


def test_clusters_ties_and_a_common_vector(spark):
    rng = random.Random(1)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(9)]
    rows = [(k, [exact(c + rng.gauss(0, 0.2)) for c in rng.choice(centres)]) for k in range(1500)]
    rows += [(k, rows[0][1]) for k in range(1500, 2200)]
    rng.shuffle(rows)
    assert run(spark, rows) == brute(rows, 20, 20)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, -0.5]), (1, None), (2, [1.0, None]), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, []),
            (20, [0.25]), (40, [-1.0, 2.0, 3.0]), (6, [0.0, 0.0]), (7, [0.01, -0.01]), (None, [1.0, 1.0]),
            (60, [1000.0, -4000.5]), (8, [0.5, 0.5]), (9, [0.5, 0.5])]
    assert run(spark, rows, k=3) == brute(rows, 3, 20)
    assert run(spark, rows, k=50) == brute(rows, 50, 20)
    assert run(spark, []) == []


def test_blocks_of_queries_are_bounded(spark, monkeypatch):
    """Most queries have the same best cell, and the bounds prune little."""
    rng = random.Random(5)
    rows = [(k, [exact(rng.gauss(0, 1)) for _ in range(6)]) for k in range(900)]
    rows += [(k, rows[0][1]) for k in range(900, 1600)]
    sizes = spark.sparkContext.accumulator(0, Largest())
    solve = voronoi.products

    def products(a, b):
        sizes.add(len(a))
        return solve(a, b)

    monkeypatch.setattr(voronoi, "products", products)
    assert run(spark, rows, every=1, k=3) == brute(rows, 3, 1)
    assert 0 < sizes.value < 400


class Largest(AccumulatorParam):
    def zero(self, value):
        return 0

    def addInPlace(self, value1, value2):
        return max(value1, value2)
