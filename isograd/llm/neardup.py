"""Near-duplicates by MinHash with sequential Bayesian verification.

Texts become sets of word shingles; texts with equal sets are one class. Signatures of the classes are
banded; documents that share a band are candidates. A candidate pair's signatures are compared batch by
batch, and it is dropped as soon as the posterior probability that it is similar enough falls under the
miss probability. What survives is confirmed on the full sets.

In a band each member is first compared with the band's smallest document. Only where members of a band
are still in different components are the other pairs of different components compared, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.llm.bitmaps import bitmap, held
from isograd.llm.common import blocks, utf8, written
from isograd.llm.components import components
from isograd.llm.hashing import mix, shingles, words

#: Signature values in a band, values compared at a time, documents of a block.
ROWS, BATCH, BLOCK = 4, 16, 512
#: A band's name ends in its number, one of so many at most.
NUMBERS = 256
#: Shingles by which 32 bits of the hashes may differ from all, at least.
ROOM = 3


@dataclass(frozen=True)
class Similar:
    """Linked means 100 * common >= percent * union, over sets of shingles of so many words."""

    words: int = 5
    percent: int = 80
    #: Chance that the bands, or the pruning, miss a pair at the threshold.
    miss: float = 1e-6

    @property
    def bands(self) -> int:
        return math.ceil(math.log(self.miss) / math.log(1 - (self.percent / 100) ** ROWS))

    @property
    def values(self) -> int:
        return self.bands * ROWS

    def least_equal(self) -> list[tuple[int, int]]:
        """(values compared, equal ones needed to go on): under a flat prior the similarity given m of k
        equal is Beta(m + 1, k - m + 1), so P(similar) = P(Binomial(k + 1, t) <= m)."""
        out, t = [], self.percent / 100
        for k in [*range(BATCH, self.values, BATCH), self.values]:
            total, m = 0.0, -1
            while total < self.miss:
                m += 1
                total += math.comb(k + 1, m) * t ** m * (1 - t) ** (k + 1 - m)
            out.append((k, m))
        return out


_SETS = "doc_id long, n_shingles long, k1 long, k2 long, signature binary"


def _reduce(ufunc, values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The ufunc over each set; sets are not empty."""
    return ufunc.reduceat(values, first[:-1])


def sets_of(docs: DataFrame, rule: Similar) -> DataFrame:
    """doc_id, n_shingles, a 128-bit name of the set, and its signature (null for empty sets)."""
    factors = mix(np.arange(1, rule.values + 1, dtype=np.uint64)) | np.uint64(1)
    shifts = mix(np.arange(1, rule.values + 1, dtype=np.uint64) + np.uint64(1 << 40))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for low, high in blocks(offsets):
                span = offsets[low:high + 1]
                h, first = words(data[span[0]:span[-1]], span - span[0])
                value, start = shingles(h, first, rule.words)
                counts = np.diff(start)
                full = np.flatnonzero(counts)
                n = len(counts)
                k1, k2 = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                signatures: list = [None] * n
                if len(full):
                    bounds = np.r_[start[full], start[-1]]
                    k1[full] = _reduce(np.add, mix(value + np.uint64(1)), bounds)
                    k2[full] = _reduce(np.bitwise_xor, mix(value + np.uint64(2)), bounds)
                    table = np.empty((len(full), rule.values), np.uint32)
                    for j in range(rule.values):
                        table[:, j] = _reduce(np.minimum, value * factors[j] + shifts[j],
                                              bounds) >> np.uint64(32)
                    for row, at in enumerate(full):
                        signatures[at] = table[row].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(counts.astype(np.int64)),
                     pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)),
                     pa.array(signatures, pa.binary())],
                    names=["doc_id", "n_shingles", "k1", "k2", "signature"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SETS)


def _signatures(column, rule: Similar) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, rule.values)


def banded(classes: DataFrame, rule: Similar) -> DataFrame:
    """(band, doc_id) for each band of each signature."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = _signatures(batch.column(1), rule).astype(np.uint64)
            for b in range(rule.bands):
                name = np.full(len(s), b + 1, np.uint64)
                for j in range(b * ROWS, (b + 1) * ROWS):
                    name = mix(name * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
                name = name & ~np.uint64(NUMBERS - 1) | np.uint64(b)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(name.view(np.int64)), batch.column(0)], names=["band", "doc_id"])

    return classes.select("doc_id", "signature").mapInArrow(run, "band long, doc_id long")


def likely(left: np.ndarray, right: np.ndarray, rule: Similar) -> np.ndarray:
    """Places of the pairs whose posterior never falls under the miss probability."""
    alive, equal, done = np.arange(len(left)), np.zeros(len(left), np.int32), 0
    for k, need in rule.least_equal():
        equal = equal + (left[alive, done:k] == right[alive, done:k]).sum(axis=1, dtype=np.int32)
        on = equal >= need
        alive, equal, done = alive[on], equal[on], k
    return alive


def survivors(pairs: DataFrame, classes: DataFrame, rule: Similar) -> DataFrame:
    """The (a, b) pairs that the sequential comparison of signatures leaves."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = likely(_signatures(batch.column(2), rule), _signatures(batch.column(3), rule), rule)
            yield batch.select([0, 1]).take(pa.array(on))

    one, two = (classes.select(F.col("doc_id").alias(n), F.col("signature").alias(f"s{n}"))
                for n in ("a", "b"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
            .mapInArrow(run, "a long, b long"))


def full_sets(docs: DataFrame, needed: DataFrame, rule: Similar, short: bool = False) -> DataFrame:
    """(doc_id, set) with the sorted hashes of the needed documents' sets, and of few others.

    A bitmap of the needed ids goes to the scan, so that texts aren't shuffled. ``short`` keeps 32 bits
    of each hash.
    """
    known = docs.sparkSession.sparkContext.broadcast(bitmap(needed, "doc_id"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(held(known.value, batch.column(0).to_numpy())))
            data, offsets = utf8(batch.column(1))
            for low, high in blocks(offsets):
                span = offsets[low:high + 1]
                value, start = shingles(*words(data[span[0]:span[-1]], span - span[0]), rule.words)
                if short:
                    value = value.astype(np.uint32)
                pieces = (value[a:b] for a, b in zip(start[:-1], start[1:]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low),
                     pa.array([(np.unique(x) if short else x).tobytes() for x in pieces],
                              pa.binary())], names=["doc_id", "set"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    return rows.mapInArrow(build, "doc_id long, set binary")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def confirmed(pairs: DataFrame, docs: DataFrame, rule: Similar) -> DataFrame:
    """The (a, b) pairs whose full sets are similar enough."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for row, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_py(), np.uint64) for v in (x, y))
                least, most = sorted((len(x), len(y)))
                if 100 * least < rule.percent * most:
                    continue
                k = common(x, y)
                if 100 * k >= rule.percent * (len(x) + len(y) - k):
                    good.append(row)
            yield batch.select([0, 1]).take(pa.array(good, pa.int64()))

    pairs = written(pairs.distinct(), "pairs")
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    sets = written(full_sets(docs, needed, rule), "sets")
    one, two = (sets.select(F.col("doc_id").alias(n), F.col("set").alias(f"s{n}"))
                for n in ("a", "b"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "sa", "sb")
            .mapInArrow(compare, "a long, b long").distinct())


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows with equal (band, x, y), of sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.c_[tuple(batch.column(i).to_numpy() for i in range(3))]
        cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, len(keys)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            key = tuple(keys[low])
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(low, high - low))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def meetings(named: DataFrame) -> DataFrame:
    """(band, x, y, doc_id, label, own): groups in which members of different labels of a band meet.

    A band of up to ``BLOCK`` members is one group. In larger ones the members of the most frequent label
    are dealt to blocks of their own, which meet the blocks of the others but not each other. So a few
    strangers in a band of one component are sent to its blocks, and its own members once to each block of
    strangers.
    """
    counts = named.groupBy("band", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = written(counts.groupBy("band").agg(
        F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("most"),
        F.sum("n").alias("n")).where("n > most AND n > 2").select(
        "band", F.when(F.col("n") > BLOCK, F.col("main")).alias("main"),
        F.greatest(F.ceil((F.col("n") - F.col("most")) / BLOCK), F.lit(1)).cast("int").alias("few"),
        F.when(F.col("n") > BLOCK, F.ceil(F.col("most") / BLOCK)).otherwise(0).cast("int").alias("many")),
        "open-bands")
    # small bands have no main label, and one block
    main, key = F.coalesce(F.col("label") == F.col("main"), F.lit(False)), F.xxhash64("doc_id")
    own = F.when(main, F.col("few") + F.pmod(key, "many")).otherwise(F.pmod(key, "few")).cast("int")
    last = F.when(main, F.col("few")).otherwise(F.col("few") + F.col("many")) - 1
    return (named.join(mixed, "band").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), last)))
            .select("band", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                    "doc_id", "label", "own"))


def across(docs: DataFrame, bands: DataFrame, labels: DataFrame, classes: DataFrame,
           rule: Similar) -> DataFrame:
    """(a, b) pairs of one band but different components that may be similar enough.

    Signatures are compared first; for what survives, the sets are compared here too, with 32 bits of
    each hash and so much room that no similar pair is lost. A pair comes from the first band it
    shares.
    """
    named = (bands.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
             .select("band", "doc_id", F.coalesce("label", "doc_id").alias("label")))
    rows = written(meetings(written(named, "named-bands")), "open-rows")
    rows = (rows.join(classes.select("doc_id", "signature"), "doc_id")
            .join(written(full_sets(docs, rows, rule, short=True), "short-sets"), "doc_id")
            .select("band", "x", "y", "doc_id", "label", "own", "signature", "set"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches):
            ids, label, own = (group[c].to_numpy() for c in ("doc_id", "label", "own"))
            s = _signatures(group["signature"], rule)
            x, y = group["x"][0].as_py(), group["y"][0].as_py()
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            sets = [np.frombuffer(v.as_py(), np.uint32) for v in group["set"]]
            sizes = np.array([len(v) for v in sets])
            number = group["band"][0].as_py() & (NUMBERS - 1)
            earlier = s[:, :number * ROWS].reshape(len(s), number, ROWS)
            found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row in left:
                to = right[label[right] != label[row]]
                if x == y:
                    to = to[to > row]
                # hashes of 32 bits may coincide, the more the larger the sets
                room = ROOM + (sizes * sizes[row] >> 30)
                least, most = np.minimum(sizes[to], sizes[row]), np.maximum(sizes[to], sizes[row])
                to = to[100 * (least + room[to]) >= rule.percent * most]
                to = to[~(earlier[to] == earlier[row]).all(axis=2).any(axis=1)]
                if len(to):
                    to = to[likely(np.broadcast_to(s[row], (len(to), rule.values)), s[to], rule)]
                on = []
                for other in to:
                    k = common(sets[row], sets[other]) + int(room[other])
                    if 100 * k >= rule.percent * (sizes[row] + sizes[other] - k):
                        on.append(other)
                if on:
                    found[0].append(np.minimum(ids[row], ids[on]))
                    found[1].append(np.maximum(ids[row], ids[on]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f)) for f in found],
                                             names=["a", "b"])

    return (rows.repartition("band", "x", "y").sortWithinPartitions("band", "x", "y")
            .mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame, rule: Similar = Similar()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Words are ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z; with fewer words than a shingle the whole sequence is
    the one shingle. Null, empty and blank texts have an empty set and link to nothing. component_id is
    the smallest doc_id reachable by links; kept tells whether that is the row itself. Rows with a
    null doc_id link to nothing, have a null component and are kept. Rows that repeat a doc_id are one
    document. Very long texts are read whole. Other columns are not read.
    """
    sets = written(sets_of(docs, rule), "signatures")
    usable = sets.where("doc_id IS NOT NULL AND n_shingles > 0")
    names = written(usable.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "classes")
    classes = written(
        usable.join(names.withColumnsRenamed({"k1": "c1", "k2": "c2"}),
                    (F.col("doc_id") == F.col("rep")) & (F.col("k1") == F.col("c1"))
                    & (F.col("k2") == F.col("c2")))
        .dropDuplicates(["doc_id", "k1", "k2"]).select("doc_id", "signature"), "reps")
    bands = written(banded(classes, rule), "bands")
    leaders = written(bands.groupBy("band").agg(F.min("doc_id").alias("a"), F.count(F.lit(1)).alias("n"))
                      .where("n > 1").select("band", "a"), "leaders")
    pairs = (bands.join(leaders, "band").where(F.col("a") < F.col("doc_id"))
             .select("a", F.col("doc_id").alias("b")).distinct())
    first = written(confirmed(survivors(pairs, classes, rule), docs, rule), "links")
    labels = components(first)
    rest = written(across(docs, bands, labels, classes, rule), "open-pairs")
    if rest.limit(1).count():
        labels = components(first.union(confirmed(rest, docs, rule)))
    reached = written(names.join(labels, F.col("rep") == F.col("node"), "left")
                      .select("k1", "k2", F.coalesce("label", "rep").alias("component")), "reached")
    rows = sets.select("doc_id", "n_shingles", "k1", "k2")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return (rows.join(reached, ["k1", "k2"], "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
            .select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
                    .alias("kept")))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN
      list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
  FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c WHERE 100 * k >= 85 * (na + nb - k)),
r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT s.doc_id, coalesce(len(s.s), 0)::BIGINT AS n_shingles, m.component_id,
       s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = s.doc_id
"""
