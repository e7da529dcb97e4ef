"""Features cut out of GeoJSON text of any layout, by as many tasks as the text has blocks.

A document may be a feature per line, a collection per line, or one collection over a whole file, with
or without line ends; the layouts may follow each other in a file. The text is read in records that end
at a brace, so that a long line is split as well. A block of text can't know whether it begins inside a
string or an object. So each one is first surveyed for both cases, a row per block; in the order of the
blocks these say how each block really begins, and then the features of all blocks are cut out at once.
Only an object that lies in several blocks is put together afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from isograd.model import ValidationError
from isograd.session import checkpoint

#: Blocks of text that the driver may order, a row each; of the usual size they are some 100 TB.
BLOCKS = 1_000_000
#: Bytes that a task looks at together.
STRETCH = 8 << 20

_OPEN, _CLOSE = np.zeros(256, np.int8), np.zeros(256, np.int8)
_OPEN[[ord("{"), ord("[")]] = 1
_CLOSE[[ord("}"), ord("]")]] = 1
_QUOTE, _BACKSLASH = ord('"'), ord("\\")


def _quotes(data: np.ndarray) -> np.ndarray:
    """Where strings begin or end: quotes behind an even number of backslashes."""
    at = np.flatnonzero(data == _QUOTE)
    behind = at[(at > 0) & (data[at - 1] == _BACKSLASH)]
    if not len(behind):
        return at
    plain = np.flatnonzero(data != _BACKSLASH)
    last = np.searchsorted(plain, behind) - 1  # the last other byte before the quote
    run = behind - 1 - np.where(last < 0, -1, plain[last])
    return np.setdiff1d(at, behind[run % 2 == 1], assume_unique=True)


def _brackets(data: np.ndarray, inside: bool) -> tuple[np.ndarray, bool]:
    """Where brackets outside strings are, and whether the bytes end inside a string."""
    quotes = _quotes(data)
    at = np.flatnonzero(_OPEN[data] | _CLOSE[data])
    outside = (np.searchsorted(quotes, at) + inside) % 2 == 0
    return at[outside], bool((len(quotes) + inside) % 2)


def _left_open(data: np.ndarray, at: np.ndarray) -> tuple[int, str]:
    """How many brackets are closed that were open before, and those that stay open."""
    step = np.where(_OPEN[data[at]], 1, -1)
    depth = np.cumsum(step)
    low = min(0, int(depth.min(initial=0)))
    # a bracket stays open if the depth never again falls below it
    after = np.minimum.accumulate(depth[::-1])[::-1] if len(depth) else depth
    stays = (step > 0) & (after >= depth) & (depth > low)
    return -low, data[at[stays]].tobytes().decode()


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], bytes]]:
    """((file, size, block), bytes): consecutive text of a block, with the braces that ended the records."""
    key, parts, size = None, [], 0
    for batch in batches:
        for *of, value in zip(*(c.to_pylist() for c in batch.columns)):
            if key is not None and (key != tuple(of) or size > STRETCH):
                yield key, b"".join(parts)
                parts, size = [], 0
            key = tuple(of)
            data = value.encode() + b"}"
            parts.append(data)
            size += len(data)
    if key is not None:
        yield key, b"".join(parts)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block and either beginning: whether it ends inside a string, what it closes and leaves open."""
    blocks: dict[tuple[str, int, int], list] = {}
    read: dict[tuple[str, int, int], int] = {}
    for key, data in _stretches(batches):
        read[key] = read.get(key, 0) + len(data)
        states = blocks.setdefault(key, [(False, 0, ""), (True, 0, "")])
        array = np.frombuffer(data, np.uint8)
        for case, (inside, closed, stack) in enumerate(states):
            at, inside = _brackets(array, inside)
            less, more = _left_open(array, at)
            left = max(0, len(stack) - less)
            states[case] = inside, closed + max(0, less - len(stack)), stack[:left] + more
    rows = [(*key, read[key], *outside, *inside) for key, (outside, inside) in blocks.items()]
    kinds = [pa.string()] + [pa.int64()] * 3 + [pa.bool_(), pa.int64(), pa.string()] * 2
    names = ["file", "size", "block", "read", "inside0", "closed0", "open0", "inside1", "closed1", "open1"]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)],
                                     names=names)


def _beginnings(rows) -> dict[tuple[str, int], tuple[bool, str]]:
    """How each block begins: inside a string or not, and the open brackets."""
    out: dict[tuple[str, int], tuple[bool, str]] = {}
    of_file: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: r.block):
        of_file.setdefault(r.file, []).append(r)
    for file, blocks in of_file.items():
        inside, stack, depth = False, "", 0
        for r in blocks:
            out[file, r.block] = inside, stack
            closed, left = (r.closed1, r.open1) if inside else (r.closed0, r.open0)
            inside = r.inside1 if inside else r.inside0
            stack = stack[:max(0, len(stack) - closed)] + left
            depth += len(left) - closed
        # the last record may have ended with the file, not with a brace; an order mark isn't read
        more = sum(r.read for r in blocks) - blocks[0].size
        if more not in (0, 1, -3, -2):
            raise ValidationError(f"{file} is no UTF-8 text")
        if inside or depth != (-1 if more in (1, -2) else 0):
            raise ValidationError(f"{file} ends inside an object, or closes one twice")
    return out


class _Cutter:
    """Objects at the top, without the objects in their arrays, and these objects by themselves."""

    def __init__(self, inside: bool, stack: str):
        self.inside, self.depth = inside, len(stack)
        self.array = stack[1:2] == "["  # the second open bracket is an array
        self.nested = self.depth > 2 and self.array and stack[2] == "{"

    def cut(self, data: bytes) -> Iterator[tuple[str, bool, bool, bytes]]:
        """(level, begins, ends, bytes) of objects or parts of them, in order."""
        array = np.frombuffer(data, np.uint8)
        at, inside = _brackets(array, self.inside)
        opens = _OPEN[array[at]] > 0
        depth = self.depth + np.cumsum(np.where(opens, 1, -1))
        # only brackets between the top and the objects in arrays of a top object matter
        marks = np.flatnonzero((depth < 2) | (opens & (depth < 4)) | (~opens & (depth == 2)))
        top_from, nested_from = 0 if self.depth else None, 0 if self.nested else None
        top_begins = nested_begins = False
        kept: list[bytes] = []
        last = 0  # what of the top object is already kept or left out

        def keep(end):
            part = data[last:end]
            if part.strip(b" \t\r\n,"):
                kept.append(part)

        for k in marks.tolist():
            position, opening, after = int(at[k]), bool(opens[k]), int(depth[k])
            if after < 0:
                if position < len(data) - 1:
                    raise ValidationError("an object of GeoJSON text is closed twice")
                continue  # the brace added behind the last record of the file
            if opening and after == 1:
                self._between(data[last:position])
                if data[position:position + 1] != b"{":
                    raise ValidationError("GeoJSON text has objects at its top, not arrays")
                top_from, top_begins, last = position, True, position
            elif opening and after == 2:
                self.array = data[position:position + 1] == b"["
            elif opening and after == 3 and self.array and data[position:position + 1] == b"{":
                keep(position)
                nested_from, nested_begins = position, True
            elif not opening and after == 2 and nested_from is not None:
                yield "nested", nested_begins, True, data[nested_from:position + 1]
                nested_from, nested_begins, last = None, False, position + 1
            elif not opening and after == 0 and top_from is not None:
                keep(position + 1)
                yield "top", top_begins, True, b"".join(kept)
                kept, top_from, top_begins, last = [], None, False, position + 1
        if nested_from is not None:
            yield "nested", nested_begins, False, data[nested_from:]
        elif top_from is not None:
            keep(len(data))
        else:
            self._between(data[last:])
        if top_from is not None:
            yield "top", top_begins, False, b"".join(kept)
        self.inside, self.nested = inside, nested_from is not None
        self.depth = max(0, int(depth[-1])) if len(depth) else self.depth

    @staticmethod
    def _between(data: bytes) -> None:
        """What stands between objects: blanks, commas, separators of records, an order mark."""
        if re.search(rb"[^\s,\x1e}]", data.removeprefix(b"\xef\xbb\xbf")):
            raise ValidationError(f"text outside of all objects: {data[:60].decode(errors='replace')!r}")


def cut_features(spark: SparkSession, path: str) -> DataFrame:
    """``value``: the features of GeoJSON files as they stand there, one per row, without line ends.

    Lone geometries become features without properties. Objects that are no GeoJSON, text outside of
    objects and files that end inside one fail the query. No file, and no line of one, is read by one task
    alone; an object that lies in several blocks is put together from its parts.
    """
    # the blocks must stay the same for the survey and the cut
    raw = checkpoint(spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"),
        F.col("_metadata.file_block_start").alias("block"), "value"))
    surveyed = raw.mapInArrow(_survey, "file string, size long, block long, read long, inside0 boolean, "
                              "closed0 long, open0 string, inside1 boolean, closed1 long, open1 string")
    found = surveyed.limit(BLOCKS + 1).collect()
    if len(found) > BLOCKS:
        raise ValidationError(f"more than {BLOCKS} blocks of text: read the files in parts, or raise "
                              "spark.sql.files.maxPartitionBytes")
    beginnings = {key: state for key, state in _beginnings(found).items() if state != (False, "")}
    shared = spark.sparkContext.broadcast(beginnings)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cutter, rows, size, number = None, None, [], 0, 0
        names = ["file", "block", "i", "level", "begins", "ends", "value"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]

        def packed():
            return pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

        for (file, _, block), data in _stretches(batches):
            if key != (file, block):
                key = file, block
                cutter = _Cutter(*shared.value.get(key, (False, "")))
            for level, begins, ends, part in cutter.cut(data):
                number += 1
                rows.append((file, block, number, level, begins, ends, part.decode()))
                size += len(part)
            if size > STRETCH:
                yield packed()
                rows, size = [], 0
        yield packed()

    parts = checkpoint(raw.mapInArrow(cut, "file string, block long, i long, level string, "
                                      "begins boolean, ends boolean, value string"))
    whole = parts.where("begins AND ends").select("level", "value")
    # parts of an object follow the one that begins it; there are at most a few per block
    order = Window.partitionBy("file", "level").orderBy("block", "i")
    broken = (parts.where("NOT (begins AND ends)")
              .withColumn("n", F.count(F.when(F.col("begins"), 1)).over(order))
              .groupBy("file", "level", "n").agg(F.array_join(F.transform(F.array_sort(F.collect_list(
                  F.struct("block", "i", "value"))), lambda p: p["value"]), "").alias("value"))
              .select("level", "value"))
    objects = whole.unionByName(broken)
    kind = F.get_json_object("value", "$.type")
    flat = F.regexp_replace("value", "[\r\n]+", " ")
    lone = F.concat(F.lit('{"type":"Feature","properties":null,"geometry":'), flat, F.lit("}"))
    wrong = F.concat(F.lit("not GeoJSON: "), F.substring("value", 1, 80))
    simple = ("Point", "MultiPoint", "LineString", "MultiLineString", "Polygon", "MultiPolygon")
    return objects.select(
        F.when(kind == "Feature", flat)
        .when(F.col("level") == "nested", None)
        .when(kind == "FeatureCollection", None)
        .when(kind.isin(*simple), lone)
        .otherwise(F.raise_error(wrong)).alias("value")).where("value IS NOT NULL")
