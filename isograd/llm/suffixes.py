"""Removal of repeated byte strings by suffix arrays.

Every string of 50 bytes holds an anchor: a 20-byte string whose hash is smallest among those that start
in it. Equal strings have equal anchors, so anchors deal the suffixes out to buckets in which all equal
strings meet, and each needs only its surroundings of 30 bytes on either side.

1. Anchors, with a hash of their surroundings, go to buckets by anchor. Of equal surroundings the
   smallest document is the source and all others are covered; within a task that is settled before
   the shuffle.
2. A string has at least half of its surroundings on one side of its anchor. So where surroundings of one
   anchor differ, only those go on whose hash of the anchor and the bytes on one side is another
   document's too; their bytes are fetched, one source of each. They are cut to the strings that others
   have as well (by hashes of all strings at the anchor), and equal cuts are joined again.
3. In each bucket suffix arrays over the cuts are built by linear grouping, anchor by anchor; in them all
   suffixes with the same first 50 bytes are neighbours, and those of larger documents are covered.
4. Covered ranges go back to the documents.

Tasks exchange packed arrays, in rows (bucket, kind, data).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.llm.common import BLOCK, blocks, utf8, written
from isograd.llm.grouping import suffix_array
from isograd.llm.hashing import every_span, mix, running, spans

GRAM = 20
#: Anchors or bytes that a task gathers before it sends them off.
GATHER, GATHER_BYTES = 1_500_000, 24 << 20
#: Bytes of text that are worth a bucket of their own.
SMALLEST = 256 << 10
#: Buckets per square root of a GB of text, where the shuffle has more partitions: packets go from each to
#: each, so that their number grows with the text only.
SPREAD = 256
#: Symbols that a suffix array is built over at a time, and cuts of an anchor from which it is split.
SYMBOLS, HOT, STRETCH = 1 << 14, 256, 4
OCCURRENCES, RANGES, REQUESTS, DOCUMENTS, CONTEXTS = range(5)
_SIDE = np.uint64((1 << 16) - 1)
_PACKET = "bucket int, kind int, data binary"


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes."""
    head = np.array([len(arrays), *(x for a in arrays for x in (ord(a.dtype.char), len(a)))], np.int64)
    return zstandard.compress(b"".join([head.tobytes(), *(
        np.ascontiguousarray(a).tobytes() for a in arrays)]), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    count = int(np.frombuffer(raw, np.int64, 1)[0])
    head = np.frombuffer(raw, np.int64, 2 * count, 8)
    at, out = 8 + 16 * count, []
    for number, length in zip(head[::2], head[1::2]):
        kind = np.dtype(chr(number))
        out.append(np.frombuffer(raw, kind, int(length), at))
        at += kind.itemsize * int(length)
    return out


def _gathered(packets: list[bytes]) -> list[np.ndarray]:
    return [np.concatenate(column) for column in zip(*map(unpack, packets))]


def _slide(values: np.ndarray, size: int, ufunc) -> np.ndarray:
    """The ufunc over each window."""
    span, out = 1, values
    while 2 * span <= size:
        out = ufunc(out[:-span], out[span:])
        span *= 2
    rest = size - span
    return ufunc(out[:len(out) - rest], out[rest:]) if rest else out


def _sides(width: int) -> tuple[int, int]:
    """Bytes before an anchor and after it: of its surroundings each string has the one or the other."""
    reach = width - GRAM
    return reach // 2, reach - reach // 2 + 1


def anchors(data: np.ndarray, offsets: np.ndarray, width: int):
    """Of texts laid end to end: anchor places, hashes, starts and ends of the surroundings, their hashes,
    and two hashes of 16 bits of the anchor with the bytes of either side.

    Every ``width`` bytes within a text hold an anchor that only those bytes decide.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none.astype(np.uint64), none, none, *[none.astype(np.uint64)] * 2
    room = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(n)
    sums = running(data)
    reach = width - GRAM + 1
    h = every_span(sums, GRAM)
    inside = room[:len(h)] >= GRAM
    h[~inside] = np.uint64(2 ** 64 - 1)
    lowest = _slide(h, reach, np.minimum)
    lowest[room[:len(lowest)] < width] = 0
    padded = np.zeros(len(lowest) + 2 * (reach - 1), np.uint64)
    padded[reach - 1:reach - 1 + len(lowest)] = lowest
    chosen = np.flatnonzero((_slide(padded, reach, np.maximum) == h) & inside)
    base = offsets[np.searchsorted(offsets, chosen, side="right") - 1]
    left = np.maximum(base, chosen - (width - GRAM))
    right = np.minimum(room[chosen], width) + chosen
    around = mix(spans(sums, left, right) + (chosen - left).astype(np.uint64))
    before, after = _sides(width)
    sides = (spans(sums, np.maximum(left, chosen - before), chosen + GRAM) & _SIDE
             | (spans(sums, chosen, np.minimum(right, chosen + GRAM + after)) & _SIDE) << np.uint64(16))
    return chosen, h[chosen], left, right, around, sides.astype(np.uint32)


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def doc_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(mix(ids.astype(np.int64).view(np.uint64).copy()), buckets)


def tag(text: bytes) -> int:
    """Tells texts under one doc_id apart."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=4).digest(), "little")


def _dealt(bucket: np.ndarray, kind: int, columns: list[np.ndarray]) -> list[tuple]:
    order = np.argsort(bucket.astype(np.min_scalar_type(bucket.max(initial=0))), kind="stable")
    bucket, columns = bucket[order], [c[order] for c in columns]
    cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    return [(int(bucket[a]), kind, pack(*(c[a:b] for c in columns)))
            for a, b in zip(cuts[:-1], cuts[1:]) if b > a]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
         pa.array(columns[2], pa.binary())], names=["bucket", "kind", "data"])


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _ranges(ids, tags, low, high, buckets: int) -> list[tuple]:
    """Packets of covered ranges for the buckets of the documents; touching ones joined."""
    order = np.lexsort((low, tags, ids))
    ids, tags, low, high = ids[order], tags[order], low[order], high[order]
    if len(ids):
        new = np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])]
        run = np.cumsum(new)
        # ranges of one document lie in order, so the furthest end so far tells if the next one touches
        shift = run.astype(np.int64) << 40
        furthest = np.maximum.accumulate(high + shift) - shift
        new[1:] |= low[1:] > furthest[:-1]
        begin = np.flatnonzero(new)
        high = furthest[np.r_[begin[1:], len(ids)] - 1]
        ids, tags, low = ids[begin], tags[begin], low[begin]
    return _dealt(doc_bucket(ids, buckets), RANGES,
                  [ids, tags, low.astype(np.uint32), high.astype(np.uint32)])


class _Occurrences:
    """Anchors of a task, until they are sent."""

    def __init__(self, buckets: int):
        self.buckets, self.parts, self.count = buckets, [], 0

    def add(self, ids, tags, first, place, h, left, right, around, sides) -> None:
        text = np.searchsorted(first, place, side="right") - 1
        self.parts.append((h, around, sides, ids[text], tags[text], place - first[text],
                           (place - left).astype(np.uint8), (right - place).astype(np.uint8)))
        self.count += len(place)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.count:
            return
        h, around, sides, ids, tags, place, back, ahead = (
            np.concatenate(c) for c in zip(*self.parts))
        self.parts, self.count = [], 0
        # equal surroundings: settled here for all but the smallest document
        name = mix(h ^ (around * np.uint64(0x9E3779B97F4A7C15)))
        order = np.argsort(name)
        begin = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
        smallest = np.empty(len(h), np.int64)
        smallest[order] = np.repeat(np.minimum.reduceat(ids[order], begin),
                                    np.diff(np.r_[begin, len(h)]))
        covered = smallest < ids
        low = place - back
        rows = _ranges(ids[covered], tags[covered], low[covered], (place + ahead)[covered],
                       self.buckets)
        keep = ~covered
        h, around, sides = h[keep], around[keep], sides[keep]
        rows += _dealt(_bucket(h, self.buckets), OCCURRENCES, [
            h.astype(np.uint16), around.astype(np.uint32),
            (around >> np.uint64(32)).astype(np.uint16), sides, ids[keep], tags[keep],
            place[keep].astype(np.uint32), back[keep], ahead[keep]])
        yield _batch(rows)


def _find_occurrences(docs: DataFrame, width: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Occurrences(buckets)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, offsets = utf8(batch.column(1))
            for low, high in blocks(offsets):
                first = offsets[low:high + 1] - offsets[low]
                part = data[offsets[low]:offsets[high]]
                found = anchors(part, first, width)
                if len(found[0]):
                    tags = np.array([tag(part[a:b].tobytes()) for a, b in zip(first[:-1], first[1:])],
                                    np.uint32)
                    held.add(ids[low:high], tags, first[:-1], *found)
                if held.count >= GATHER:
                    yield from held.flush()
        yield from held.flush()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PACKET)


def _in_several(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether an equal key stands at another document."""
    out = np.zeros(len(key), bool)
    if len(key):
        order = np.argsort(key)
        begin = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        owners = ids[order]
        several = np.minimum.reduceat(owners, begin) < np.maximum.reduceat(owners, begin)
        out[order] = np.repeat(several, np.diff(np.r_[begin, len(key)]))
    return out


def _meet(width: int, buckets: int):
    """Covered ranges, and requests for surroundings, of the anchors of a bucket."""
    before, after = _sides(width)

    def run(packets: pa.Table) -> pa.Table:
        kinds, data = packets["kind"].to_pylist(), packets["data"].to_pylist()
        rows = [(b, k, d) for b, k, d in zip(packets["bucket"].to_pylist(), kinds, data)
                if k == RANGES]
        own = [d for k, d in zip(kinds, data) if k == OCCURRENCES]
        if not own:
            return _table(rows)
        bucket = packets["bucket"][0].as_py()
        h, around, more, sides, ids, tags, place, back, ahead = _gathered(own)
        around = around.astype(np.uint64) | more.astype(np.uint64) << np.uint64(32)
        sides = sides.astype(np.uint64)
        # surroundings have 96 bits; 64 are sorted, and all where those leave two that differ together
        key = around | h.astype(np.uint64) << np.uint64(48)
        order = np.argsort(key)
        new = np.r_[True, key[order][1:] != key[order][:-1]]
        if (~new[1:] & (sides[order][1:] != sides[order][:-1])).any():
            order = np.lexsort((sides, key))
            new = np.r_[True, (key[order][1:] != key[order][:-1])
                        | (sides[order][1:] != sides[order][:-1])]
        begin = np.flatnonzero(new)
        source = np.empty(len(ids), np.int64)
        source[order] = np.repeat(np.minimum.reduceat(ids[order], begin), np.diff(np.r_[begin, len(ids)]))
        covered = source < ids
        low, high = place.astype(np.int64) - back, place.astype(np.int64) + ahead
        rows += _ranges(ids[covered], tags[covered], low[covered], high[covered], buckets)
        # sources of different documents that agree on one side of the anchor
        ask = np.zeros(len(h), bool)
        anchor = h.astype(np.uint64) << np.uint64(16)
        for able, side in ((back >= before, sides & _SIDE),
                           (ahead >= GRAM + after, sides >> np.uint64(16))):
            some = np.flatnonzero(able & ~covered)
            ask[some] |= _in_several(anchor[some] | side[some], ids[some])
        # of a passage that recurs in its source, each place asks for itself
        rows += _dealt(doc_bucket(ids[ask], buckets), REQUESTS, [
            ids[ask], tags[ask], place[ask], back[ask], ahead[ask],
            np.full(int(ask.sum()), bucket, np.uint32)])
        return _table(rows)

    return run


def _documents(docs: DataFrame, buckets: int) -> DataFrame:
    """The documents themselves, all columns, dealt by doc_id."""
    at = docs.columns.index("text"), docs.columns.index("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            _, offsets = utf8(batch.column(at[0]))
            for low, high in blocks(offsets, GATHER_BYTES):
                part = batch.slice(low, high - low)
                ids = part.column(at[1]).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
                bucket = doc_bucket(ids, buckets)
                order = np.argsort(bucket, kind="stable")
                cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    sink = pa.BufferOutputStream()
                    some = part.take(pa.array(order[a:b]))
                    with pa.ipc.new_stream(sink, some.schema, options=options) as out:
                        out.write_batch(some)
                    rows.append((int(bucket[order[a]]), DOCUMENTS, sink.getvalue().to_pybytes()))
                yield _batch(rows)

    return docs.mapInArrow(run, _PACKET)


def _opened(packets: list[bytes]) -> Iterator[pa.Table]:
    for data in packets:
        yield pa.ipc.open_stream(data).read_all()


def _texts(table: pa.Table):
    """(doc_id, tag) keys, bytes and offsets."""
    data, offsets = utf8(table["text"])
    ids = table["doc_id"].cast(pa.int64()).to_pylist()
    keys = [(i, tag(data[a:b].tobytes())) for i, a, b in zip(ids, offsets[:-1], offsets[1:])]
    return keys, data, offsets


def _fetch(width: int):
    """The surroundings that a bucket of documents is asked for, for the buckets that asked."""
    def run(packets: pa.Table) -> pa.Table:
        kinds, data = packets["kind"].to_pylist(), packets["data"].to_pylist()
        asked = [d for k, d in zip(kinds, data) if k == REQUESTS]
        if not asked:
            return _table([])
        ids, tags, place, back, ahead, bucket = _gathered(asked)
        known: dict[tuple, int] = {}
        texts, base, at = [], [], 0
        for table in _opened([d for k, d in zip(kinds, data) if k == DOCUMENTS]):
            keys, raw, offsets = _texts(table)
            for key, low in zip(keys, offsets[:-1]):
                if key not in known:
                    known[key] = len(base)
                    base.append(at + low)
            texts.append(raw)
            at += len(raw)
        texts = np.concatenate([*texts, np.zeros(width, np.uint8)])
        base = np.array(base, np.int64)
        start = base[[known[key] for key in zip(ids.tolist(), tags.tolist())]] + place
        reach = width - GRAM
        # bytes shifted by one, so that 0 stands for what lies outside of the text
        steps = np.arange(-reach, width)
        grid = start[:, None] + steps
        context = texts[np.clip(grid, 0, len(texts) - 1)] + np.uint8(1)
        context[(steps < -back.astype(np.int64)[:, None]) | (steps >= ahead.astype(np.int64)[:, None])] = 0
        order = np.argsort(bucket, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket[order].astype(np.int64))) + 1, len(order)]
        return _table([(int(bucket[order[a]]), CONTEXTS, pack(
            ids[order[a:b]], tags[order[a:b]], place[order[a:b]],
            context[order[a:b]].ravel())) for a, b in zip(cuts[:-1], cuts[1:])])

    return run


def _shared(ids, h, context, width: int) -> np.ndarray:
    """Whether another document has the string that starts at each byte before the anchor, by hashes."""
    reach = width - GRAM
    out = np.zeros((len(h), reach + 1), bool)
    key = np.empty(out.shape, np.uint64)
    size = context.shape[1]
    for low in range(0, len(h), BLOCK // size):
        part = context[low:low + BLOCK // size]
        sums = running(part.ravel())
        at = np.arange(len(part))[:, None] * size + np.arange(reach + 1)
        key[low:low + len(part)] = spans(sums, at, at + width)
    anchor = mix(h.astype(np.uint64))
    for at in range(reach + 1):
        some = np.flatnonzero((context[:, at] > 0) & (context[:, at + width - 1] > 0))
        out[some, at] = _in_several(key[some, at] ^ anchor[some], ids[some])
    return out


def _stretches(shared: np.ndarray, low: int, high: int, width: int):
    """Rows, starts and ends of the stretches of shared strings that start from low to high."""
    edges = np.diff(shared[:, low:high].astype(np.int8), axis=1, prepend=0, append=0)
    row, start = np.nonzero(edges > 0)
    return row, start + low, np.nonzero(edges < 0)[1] + low + width - 1


def covered_ranges(ids, tags, place, h, context, width: int):
    """Ranges of the documents' bytes that a smaller document has too, by suffix arrays.

    ``context`` has a row of surroundings per entry, bytes plus one, 0 outside of the text.
    """
    reach = width - GRAM
    shared = _shared(ids, h, context, width)
    able = np.flatnonzero(shared.any(axis=1))
    order = able[np.argsort(h[able], kind="stable")]
    ids, tags, place, h, context, shared = (
        c[order] for c in (ids, tags, place.astype(np.int64) - reach, h, context, shared))
    doc, where = ids.tolist(), place.tolist()
    out: list[tuple[int, int, int]] = []
    held: list[tuple[bytes, list[tuple[int, int, int]]]] = []
    count = 0

    def settle() -> None:
        """A suffix array over the cuts at hand; equal strings in it are neighbours."""
        nonlocal held, count
        if len(held) > 1:
            out.extend(_repeated(held, doc, where, width))
        held, count = [], 0

    def hold(cuts: dict[bytes, list[tuple[int, int, int]]]) -> None:
        nonlocal count
        for body, found in cuts.items():
            smallest = min(doc[r] for r, _, _ in found)
            sources = []
            for r, a, b in found:
                if doc[r] > smallest:
                    out.append((r, where[r] + a, where[r] + b))
                else:
                    sources.append((r, a, b))
            if len(cuts) > 1:
                held.append((body, sources))
                count += len(body) + 1
        if count >= SYMBOLS:
            settle()

    raw, size = context.tobytes(), context.shape[1]

    def joined(stretches) -> dict[bytes, list[tuple[int, int, int]]]:
        cuts: dict[bytes, list[tuple[int, int, int]]] = {}
        for r, a, b in stretches:
            cuts.setdefault(raw[r * size + a:r * size + b], []).append((r, a, b))
        return cuts

    row, start, end = _stretches(shared, 0, reach + 1, width)
    begin = np.flatnonzero(np.r_[True, h[row][1:] != h[row][:-1]]) if len(row) else row
    row, start, end = row.tolist(), start.tolist(), end.tolist()
    for first, last in zip(begin.tolist(), [*begin[1:].tolist(), len(row)]):
        cuts = joined(zip(row[first:last], start[first:last], end[first:last]))
        if len(cuts) <= HOT:
            hold(cuts)
            continue
        # strings that start in one stretch have its middle in common: only equal middles meet
        first, last = row[first], row[last - 1] + 1
        for low in range(0, reach + 1, STRETCH):
            high = min(low + STRETCH, reach + 1)
            found = _stretches(shared[first:last], low, high, width)
            by_middle: dict[bytes, list[tuple[int, int, int]]] = {}
            for r, a, b in zip((found[0] + first).tolist(), found[1].tolist(), found[2].tolist()):
                middle = raw[r * size + high - 1:r * size + low + width]
                by_middle.setdefault(middle, []).append((r, a, b))
            for part in by_middle.values():
                hold(joined(part))
    settle()
    at = np.array(out, np.int64).reshape(-1, 3)
    return ids[at[:, 0]], tags[at[:, 0]], at[:, 1], at[:, 2]


def _repeated(cuts, doc: list[int], where: list[int], width: int) -> list[tuple[int, int, int]]:
    """(row, start, end) of the strings in the cuts that a smaller document has too."""
    # a separator after each cut; suffixes of one cut start in its first bytes
    size = np.array([len(body) + 1 for body, _ in cuts])
    low = np.cumsum(size) - size
    text = np.frombuffer(b"\0".join([*(body for body, _ in cuts), b""]), np.uint8).astype(np.uint16) + 1
    text = np.append(text, np.uint16(0))
    owner = np.append(np.repeat(np.arange(len(cuts)), size), 0)
    whole = np.arange(len(text)) + width < (low + size)[owner]
    whole[-1] = False
    found = np.array(suffix_array(text.tolist()), np.int64)
    found = found[whole[found]]
    strings = np.lib.stride_tricks.sliding_window_view(text, width)[found]
    begin = np.flatnonzero(np.r_[True, (strings[1:] != strings[:-1]).any(axis=1)])
    docs = np.array([doc[sources[0][0]] for _, sources in cuts], np.int64)[owner[found]]
    smallest = np.repeat(np.minimum.reduceat(docs, begin), np.diff(np.r_[begin, len(found)]))
    out = []
    found = found[docs > smallest]
    for number, at in zip(owner[found].tolist(), (found - low[owner[found]]).tolist()):
        for r, a, _ in cuts[number][1]:
            out.append((r, where[r] + a + at, where[r] + a + at + width))
    return out


def _sort(width: int, buckets: int):
    def run(packets: pa.Table) -> pa.Table:
        ids, tags, place, context = _gathered(packets["data"].to_pylist())
        context = context.reshape(len(ids), -1)
        at = np.arange(len(ids)) * GRAM
        h = spans(running(context[:, width - GRAM:width].ravel()), at, at + GRAM)
        return _table(_ranges(*covered_ranges(ids, tags, place, h, context, width), buckets))

    return run


def _whole_characters(data: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """Only characters all of whose bytes are gone."""
    starts = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(starts):
        return gone
    every = np.minimum.reduceat(gone, starts)
    return np.repeat(every, np.diff(np.r_[starts, len(data)]))


def remove_repeats(docs: DataFrame, width: int = 50, characters: bool = True) -> DataFrame:
    """The rows of docs, text without repeated strings, and n_bytes, n_removed, n_spans, kept_bytes.

    A byte goes if a ``width``-byte string that covers it also starts in a document with a smaller
    doc_id; overlaps count, strings are judged on the input and don't cross documents. ``kept_bytes``
    has the bytes that stay; ``text`` the same, but a character of which only a part goes stays whole
    (with ``characters`` false text is left as it was). n_spans counts the maximal removed runs. Null
    texts count as empty and stay null. A null doc_id is no source and loses nothing; rows with equal
    doc_id don't cover each other. Documents may be of any length. Columns of the four names are
    replaced; all others are kept.
    """
    if width < GRAM + 1:
        raise ValueError(f"strings of at least {GRAM + 1} bytes")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept_bytes")
    known = docs.where(F.col("doc_id").isNotNull())
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(128 << 20, (4 << 20) * max(1.0, total / 5e8) ** 0.5)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a packet goes from each bucket to each: more buckets than the text fills would only add packets
    buckets = int(max(total // size + 1, min(4 * partitions, total // SMALLEST + 1,
                                             SPREAD * max(1.0, total / 1e9) ** 0.5)))
    met = written(_find_occurrences(known, width, buckets).groupBy("bucket")
                  .applyInArrow(_meet(width, buckets), _PACKET), "met")
    ranges, requests = met.where(F.col("kind") == RANGES), met.where(F.col("kind") == REQUESTS)
    sorted_ = (requests.unionAll(_documents(known.select("doc_id", "text"), buckets))
               .groupBy("bucket").applyInArrow(_fetch(width), _PACKET)
               .groupBy("bucket").applyInArrow(_sort(width, buckets), _PACKET))
    schema = type(docs.schema)(list(docs.schema.fields))
    for name in ("n_bytes", "n_removed", "n_spans"):
        schema = schema.add(name, "long")
    schema = schema.add("kept_bytes", "binary")

    def finish(packets: pa.Table) -> pa.Table:
        kinds, data = packets["kind"].to_pylist(), packets["data"].to_pylist()
        gone: dict[tuple, tuple[int, int]] = {}
        asked = [d for k, d in zip(kinds, data) if k == RANGES]
        if asked:
            ids, tags, low, high = _gathered(asked)
            order = np.lexsort((tags, ids))
            ids, tags, low, high = (c[order] for c in (ids, tags, low, high))
            begin = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])])
            gone = dict(zip(zip(ids[begin].tolist(), tags[begin].tolist()),
                            zip(begin.tolist(), [*begin[1:].tolist(), len(ids)])))
        tables = []
        for table in _opened([d for k, d in zip(kinds, data) if k == DOCUMENTS]):
            keys, raw, offsets = _texts(table)
            removed, runs, kept, texts = [], [], [], []
            old = table["text"].to_pylist()
            for row, key in enumerate(keys):
                own = raw[offsets[row]:offsets[row + 1]]
                if key not in gone:
                    removed.append(0)
                    runs.append(0)
                    kept.append(own.tobytes())
                    texts.append(old[row])
                    continue
                a, b = gone[key]
                mask = np.cumsum(np.bincount(low[a:b], minlength=len(own) + 1)
                                 - np.bincount(high[a:b], minlength=len(own) + 1))[:-1] > 0
                removed.append(int(mask.sum()))
                runs.append(int((mask & ~np.r_[False, mask[:-1]]).sum()))
                kept.append(own[~mask].tobytes())
                texts.append(own[~_whole_characters(own, mask)].tobytes().decode()
                             if characters else old[row])
            at = table.schema.get_field_index("text")
            table = table.set_column(at, "text", pa.array(texts, table.schema.field(at).type))
            for name, column in (("n_bytes", np.diff(offsets)), ("n_removed", removed),
                                 ("n_spans", runs)):
                table = table.append_column(name, pa.array(column, pa.int64()))
            tables.append(table.append_column("kept_bytes", pa.array(kept, pa.binary())))
        return pa.concat_tables(tables) if tables else pa.Table.from_batches([], _arrow(schema))

    return (ranges.unionAll(sorted_).unionAll(_documents(docs, buckets))
            .groupBy("bucket").applyInArrow(finish, schema))


def _arrow(schema) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def repeat_digest(docs: DataFrame, width: int = 50) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the bytes that stay, hexadecimal)."""
    return (remove_repeats(docs.select("doc_id", "text"), width, characters=False)
            .select("doc_id", "n_bytes", "n_removed", "n_spans",
                    F.sha2("kept_bytes", 256).alias("kept_sha256")))
