"""Benchmark decontamination by spaced seeds.

A mask picks some of the words in a span and ignores the others, so its hash stays equal when ignored
words are substituted. The three masks together hit every stretch of 13 words in which at most two are
substituted, whichever they are. Hashes of test items and of documents are joined; around each hit the
words are compared, and stretches with at least 11 of 13 equal words count. A bitmap of the items'
hashes, bounded in size, keeps nearly all other hashes of the documents out of the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.llm.bitmaps import bitmap, held
from isograd.llm.common import blocks, utf8, written
from isograd.llm.hashing import mix, words

#: Words of a stretch and how many of them may differ; shorter items must be equal.
STRETCH, DIFFER = 13, 2
#: Items of fewer words are no evidence and are never reported.
SHORTEST = 5
# Masks that together hit each stretch with two substitutions.
MASKS = ("####-###", "##--#--####", "#-####-#--#")
#: For items too short for a stretch.
PLAIN = "#####"


def _hashes(h: np.ndarray, number: int, mask: str) -> np.ndarray:
    """Hash of the mask laid at each word; shorter than the words by the mask's span less one."""
    n = max(0, len(h) - len(mask) + 1)
    out = np.full(n, number + 1, np.uint64)
    for j, used in enumerate(mask):
        if used == "#":
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return mix(out)


def seeds(h: np.ndarray, first: np.ndarray):
    """Hashes and word numbers of all masks that lie within one text."""
    last = np.repeat(first[1:], np.diff(first))
    found, where = [], []
    for number, mask in enumerate((*MASKS, PLAIN)):
        at = np.flatnonzero(np.arange(len(h)) + len(mask) <= last)
        found.append(_hashes(h, number, mask)[at])
        where.append(at)
    return np.concatenate(found), np.concatenate(where)


def _item_seeds(items: DataFrame) -> DataFrame:
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            h, first = words(data, offsets)
            long = np.diff(first) >= SHORTEST
            found, where = seeds(h, first)
            owner = np.searchsorted(first, where, side="right") - 1
            # the plain mask serves short items alone
            plain = np.arange(len(found)) >= len(found) - int(np.maximum(
                0, np.diff(first) - len(PLAIN) + 1).sum())
            keep = long[owner] & (~plain | (np.diff(first) < STRETCH)[owner])
            found, where, owner = found[keep], where[keep], owner[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), batch.column(0).take(pa.array(owner)),
                 pa.array((where - first[owner]).astype(np.int32))],
                names=["h", "item_id", "item_at"])

    return items.mapInArrow(run, f"h long, item_id {kind}, item_at int")


_PIECE = "key long, h long, at int, low int, words binary"


def _doc_seeds(docs: DataFrame, known: np.ndarray) -> DataFrame:
    """Rows of two kinds: (key, h, at) per hash in the bitmap, (key, low, words) per stretch around."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for low, high in blocks(offsets):
                span = offsets[low:high + 1]
                h, first = words(data[span[0]:span[-1]], span - span[0])
                found, where = seeds(h, first)
                hit = held(known, found)
                found, where = found[hit], where[hit]
                if not len(found):
                    continue
                owner = np.searchsorted(first, where, side="right") - 1
                # stretches around the hits, merged
                order = np.argsort(where, kind="stable")
                start = np.maximum(first[owner[order]], where[order] - STRETCH)
                end = np.minimum(first[owner[order] + 1], where[order] + 2 * STRETCH)
                new = np.ones(len(start), bool)
                new[1:] = (start[1:] > end[:-1]) | (owner[order][1:] != owner[order][:-1])
                begin = np.flatnonzero(new)
                stop = np.r_[begin[1:], len(start)] - 1
                texts = owner[order][begin]
                pieces = [h[a:b].tobytes() for a, b in zip(start[begin], end[stop])]
                n, m = len(found), len(pieces)
                nothing = pa.nulls(n, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[low + owner], pa.int64()), pa.array(found.view(np.int64)),
                     pa.array((where - first[owner]).astype(np.int32)), nothing,
                     pa.nulls(n, pa.binary())], names=["key", "h", "at", "low", "words"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[low + texts], pa.int64()), pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.int32()),
                     pa.array((start[begin] - first[texts]).astype(np.int32)),
                     pa.array(pieces, pa.binary())], names=["key", "h", "at", "low", "words"])

    return docs.mapInArrow(run, _PIECE)


def agreement(doc: np.ndarray, low: int, item: np.ndarray, shift: int) -> list[tuple[int, int, int]]:
    """(first word, word after, equal words) of the overlaps along a diagonal.

    ``doc`` is a stretch of the document from word ``low``; item word j faces document word shift + j.
    """
    n = len(item)
    a, b = max(low, shift), min(low + len(doc), shift + n)
    size = min(STRETCH, n)
    need = size - DIFFER if n >= STRETCH else size
    if b - a < size:
        return []
    same = doc[a - low:b - low] == item[a - shift:b - shift]
    sums = np.r_[0, np.cumsum(same)]
    good = np.flatnonzero(sums[size:] - sums[:-size] >= need)
    out: list[tuple[int, int, int]] = []
    for g in good:
        if out and g <= out[-1][1]:
            out[-1] = (out[-1][0], g + size, 0)
        else:
            out.append((g, g + size, 0))
    found = []
    for x, y, _ in out:  # trimmed to equal words at both ends
        inner = np.flatnonzero(same[x:y])
        x, y = x + inner[0], x + inner[-1] + 1
        found.append((a + int(x), a + int(y), int(sums[y] - sums[x])))
    return found


def overlaps(docs: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, item_id, n_equal, start, end): each document's best overlap with each item it overlaps.

    ``key`` is a long column that names the documents. Words are ``[^\\x20\\x09-\\x0D]+``, A-Z as a-z. An
    overlap is made of stretches of 13 aligned words with 11 equal ones at least; start and end are
    words of the document. Items of 5 to 12 words must occur whole and unchanged; shorter items, null
    and empty texts match nothing. Of several overlaps of a pair the one with most equal words is
    given, then the first. Rows that repeat a key count as one document per distinct text; rows
    without a key are left out. Other columns are not read.
    """
    spark = docs.sparkSession
    items = items.select("item_id", "text").where(F.col("item_id").isNotNull())
    kind = items.schema["item_id"].dataType.simpleString()
    tests = written(_item_seeds(items), "test-seeds")
    rows = docs.select(F.col(key).cast("long").alias("key"), "text").where(F.col(key).isNotNull())
    pieces = written(_doc_seeds(rows, bitmap(tests, "h")), "doc-seeds")
    meets = (pieces.where("h IS NOT NULL").select("key", "h", "at").join(tests, "h")
             .groupBy("key", "item_id", (F.col("at") - F.col("item_at")).alias("shift"))
             .agg(F.min("at").alias("at"), F.max("at").alias("last")))

    def item_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, first = words(*utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first).astype(np.int32)),
                 pa.array([h[a:b].tobytes() for a, b in zip(first[:-1], first[1:])], pa.binary())],
                names=["item_id", "n", "item"])

    faced = (meets.join(items.mapInArrow(item_words, f"item_id {kind}, n int, item binary"),
                        "item_id")
             .join(pieces.where("words IS NOT NULL").select("key", "low", "words"), "key")
             .where((F.col("low") <= F.col("last"))
                    & (F.col("low") + F.octet_length("words") / 8 > F.col("at")))
             .select("key", "item_id", "shift", "item", "low", "words"))
    schema = f"key long, item_id {kind}, n_equal int, start int, end int"

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, item_id, shift, item, low, doc in zip(*(c.to_pylist() for c in batch.columns)):
                for start, end, equal in agreement(np.frombuffer(doc, np.uint64), low,
                                                   np.frombuffer(item, np.uint64), shift):
                    rows.append((k, item_id, equal, start, end))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), batch.schema.field("item_id").type, *[pa.int32()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             names=["key", "item_id", "n_equal", "start", "end"])

    best = F.max_by(F.struct("n_equal", "start", "end"),
                    F.struct("n_equal", -F.col("start"), -F.col("end"))).alias("b")
    return (faced.mapInArrow(verify, schema).groupBy("key", "item_id").agg(best)
            .select(F.col("key").alias(key), "item_id", "b.n_equal", "b.start", "b.end"))


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs that overlap no item, with their columns."""
    keyed = docs.withColumn("_text_key", F.xxhash64("doc_id", "text"))
    dirty = overlaps(keyed, items, "_text_key").select("_text_key").distinct()
    return (keyed.join(written(dirty, "contaminated"), "_text_key", "left_anti")
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
