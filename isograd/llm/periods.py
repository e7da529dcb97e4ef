"""Periodic runs in sequences of words, found while the words arrive.

Words are numbered and appended to a stream. Every completed block of the stream whose size is a power
of two gets a catcher: it waits for the block's words to come again at a distance that belongs to the
block's size, any stretch that repeats at such a distance being long enough to hold a whole aligned
block. From a block that came again the two copies are compared outwards, word by word: backwards at
once, forwards as words are appended. What has come again over a whole period is a square; squares of
one period that touch are one run.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from isograd.llm.common import blocks, utf8

#: Runs are this many words and this many periods long at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3

_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Run:
    start: int
    length: int
    period: int


def _same_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """How many words the beginnings of two sequences have in common."""
    most, low, step = min(len(a), len(b)), 0, 32
    while low < most:
        high = min(most, low + step)
        other = np.flatnonzero(a[low:high] != b[low:high])
        if len(other):
            return low + int(other[0])
        low, step = high, step * 4
    return most


class Catcher:
    """Runs of an appended sequence of word numbers, as soon as their words are there.

    ``longest`` bounds the periods looked for; sequences that must not be compared with each other are
    told apart by a number of their own between them.
    """

    def __init__(self, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
                 longest: int | None = None):
        if least_periods < 2:
            raise ValueError("a run has two periods at least")
        self.least_words, self.least_periods, self.longest = least_words, least_periods, longest
        self.words, self.size = np.zeros(64, np.int64), 0
        # the runs known so far, by period; a run's end is open while it is the end of the words
        self.found: dict[int, list[list[int]]] = {}
        self.open: list[tuple[int, list[int]]] = []
        # per word the known run that reaches farthest: its start, end and period
        self.cover = np.zeros((3, 64), np.int64)

    def _copied(self, period: int) -> int:
        """How many words of a run of this period come again a period later, at least."""
        return max(self.least_words - period, (self.least_periods - 1) * period)

    def levels(self) -> Iterator[tuple[int, int, int]]:
        """(block size, smallest and largest distance) of the catchers that the words may need."""
        longest = min(self.size, self.longest or self.size)
        period = 1
        while period <= longest:
            size, last, high = self._block(period), period, longest
            while last < high:  # distances of one size are adjacent
                middle = (last + high + 1) // 2
                if self._block(middle) == size:
                    last = middle
                else:
                    high = middle - 1
            yield size, period, last
            period = last + 1

    def _block(self, period: int) -> int:
        """The largest aligned block that a copy of this or a longer period holds, wherever it starts."""
        turn = self.least_words // self.least_periods
        least = min(self._copied(p) for p in (period, turn, turn + 1) if p >= period)
        return 1 << (least + 1).bit_length() - 2

    def append(self, words: np.ndarray) -> None:
        """Append words and advance all comparisons."""
        words = np.asarray(words, np.int64)
        before, self.size = self.size, self.size + len(words)
        if self.size > len(self.words):
            room = max(self.size, 2 * len(self.words))
            self.words = np.r_[self.words[:before], np.zeros(room - before, np.int64)]
            self.cover = np.concatenate([self.cover[:, :before],
                                         np.zeros((3, room - before), np.int64)], axis=1)
        self.words[before:self.size] = words
        self._advance(before)
        levels = list(self.levels())
        if not levels:
            return
        base = max(0, before - max(size + last for size, _, last in levels) - levels[-1][0])
        prints, span = self._fingerprints(base), 1
        for size, first, last in levels:
            while span < size:
                prints = prints[:-span] * _FACTOR + prints[span:]
                prints = (prints ^ (prints >> np.uint64(29))) * _SPREAD
                span *= 2
            self._catch(prints, base, size, first, last, before)

    def _fingerprints(self, base: int) -> np.ndarray:
        h = (self.words[base:self.size].astype(np.uint64) + np.uint64(1)) * _FACTOR
        return (h ^ (h >> np.uint64(31))) * _SPREAD

    def _advance(self, before: int) -> None:
        """Forward comparisons that had reached the end of the words go on."""
        waiting, self.open = self.open, []
        for period, run in waiting:
            start, end = run
            more = _same_prefix(self.words[end:self.size], self.words[end - period:self.size])
            run[1] = end + more
            if run[1] == self.size:
                self.open.append((period, run))
            if more:
                self._cover(period, run)

    def _cover(self, period: int, run: list[int]) -> None:
        start, end = run
        if end - start < max(self.least_words, self.least_periods * period):
            return
        part = self.cover[:, start:end]
        part[:, part[1] < end] = np.array([[start], [end], [period]])

    def _catch(self, prints: np.ndarray, base: int, size: int, first: int, last: int,
               before: int) -> None:
        """Blocks of this size that came again among the new words."""
        # small distances one by one, as a run of one of them covers those of its multiples
        groups = [(p, p) for p in range(first, last + 1)] if first < size else [(first, last)]
        for low, high in groups:
            blocks_at, distance = self._hits(prints, base, size, low, high, before)
            keep = ~self._explained(blocks_at, distance, size)
            order = np.lexsort((blocks_at[keep], distance[keep]))
            done = (0, 0)
            for at, period in zip(blocks_at[keep][order].tolist(), distance[keep][order].tolist()):
                if period == done[0] and at + period + size <= done[1]:
                    continue
                done = (period, self._extend(at, period))

    def _hits(self, prints, base, size, low, high, before) -> tuple[np.ndarray, np.ndarray]:
        """Starts of aligned blocks and the distances at which they come again, ending in new words."""
        # windows that end among the new words start here
        start, bits = max(base, before - size + 1), size.bit_length() - 1
        if low == high:
            at = np.arange(-(-max(base, start - low) // size) * size, self.size - size - low + 1, size)
            at = at[prints[at - base] == prints[at + low - base]]
            return at, np.full(len(at), low)
        windows = np.arange(start, self.size - size + 1)
        found_at, found_by = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for back in range(low // size, high // size + 2):
            at = (windows >> bits) - back << bits
            distance = windows - at
            fits = (at >= base) & (distance >= low) & (distance <= high)
            w, at, distance = windows[fits], at[fits], distance[fits]
            same = prints[w - base] == prints[at - base]
            found_at.append(at[same])
            found_by.append(distance[same])
        return np.concatenate(found_at), np.concatenate(found_by)

    def _explained(self, at: np.ndarray, distance: np.ndarray, size: int) -> np.ndarray:
        """Whether no run of this distance can be new, seen from the known runs around both copies.

        Both copies in one run whose period divides the distance: the run is known. Copies in two ended
        runs of one period: only where their starts or their ends are that far apart can more agree than
        one run has, which of three periods would have to reach into the other by a period.
        """
        s1, e1, p1 = self.cover[:, at]
        s2, e2, p2 = self.cover[:, at + distance]
        inside = (p1 > 0) & (at + size <= e1) & (p2 > 0) & (at + distance + size <= e2)
        one = inside & (s1 == s2) & (e1 == e2) & (p1 == p2) & (distance % np.maximum(p1, 1) == 0)
        two = (inside & ((s1 != s2) | (e1 != e2)) & (p1 == p2) & (p1 * 2 <= size)
               & (s2 - s1 != distance) & (e2 - e1 != distance) & (e2 < self.size))
        return one | two if self.least_periods > 2 else one

    def _extend(self, at: int, period: int) -> int:
        """Compare both copies of a block outwards; the end of what has this period."""
        words, size = self.words, self.size
        known = self.found.setdefault(period, [])
        if known and known[-1][0] <= at and at + period + 1 < known[-1][1]:  # it was still open
            return known[-1][1]
        same = _same_prefix(words[at:size - period], words[at + period:size])
        end = at + period + same
        low = max(0, at - 64)
        while True:  # backwards by growing steps
            back = _same_prefix(words[low:at][::-1], words[low + period:at + period][::-1])
            if back < at - low or low == 0:
                break
            low = max(0, at - 4 * (at - low))
        start = at - back
        run = [start, end]
        if end == size:
            self.open.append((period, run))
        if end == size or end - start >= 2 * period:  # a square, or one may come
            known.append(run)
            self._cover(period, run)
        return end

    def runs(self) -> list[Run]:
        """The runs of the words so far, by start and period."""
        long = [Run(start, end - start, period) for period, known in self.found.items()
                for start, end in known
                if end - start >= max(self.least_words, self.least_periods * period)]
        # of a run with several periods the smallest counts; it divides the others
        smallest: dict[tuple[int, int], int] = {}
        for run in sorted(set(long), key=lambda r: r.period):
            smallest.setdefault((run.start, run.length), run.period)
        return sorted((Run(s, n, p) for (s, n), p in smallest.items()),
                      key=lambda r: (r.start, r.period))


def runs_of(texts: list[list[bytes]], least_words: int = LEAST_WORDS,
            least_periods: int = LEAST_PERIODS) -> list[list[Run]]:
    """The runs of each list of words. The lists make one stream, with a number of its own after each."""
    number: dict[bytes, int] = {}
    stream = np.fromiter((n for i, words in enumerate(texts) for n in (
        *[number.setdefault(w, len(number)) for w in words], -1 - i)), np.int64)
    starts = np.cumsum([0] + [len(words) + 1 for words in texts])
    longest = max(map(len, texts), default=0) // least_periods
    out: list[list[Run]] = [[] for _ in texts]
    if longest:
        catcher = Catcher(least_words, least_periods, longest)
        catcher.append(stream)
        for run in catcher.runs():
            at = int(np.searchsorted(starts, run.start, side="right")) - 1
            out[at].append(Run(run.start - int(starts[at]), run.length, run.period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run has after its first period."""
    if not runs:
        return words
    kept = np.ones(len(words), bool)
    for run in runs:
        kept[run.start + run.period:run.start + run.length] = False
    return [words[i] for i in np.flatnonzero(kept)]


def _mapped(docs: DataFrame, build, names: list[str], schema) -> DataFrame:
    """build(ids, word lists, their runs) -> columns, per block of texts; docs has an id and a text."""
    def batch_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            for low, high in blocks(offsets):
                ids = batch.column(0).slice(low, high - low)
                words = [(t or "").encode().split()
                         for t in batch.column(1).slice(low, high - low).to_pylist()]
                columns = build(ids, words)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(batch_of, schema)


def word_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS,
              id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per run of a text: id, start, length, period, counted in words from 0.

    Words are ``[^\\x20\\x09-\\x0D]+``. A run is a stretch whose words are those a period earlier, its
    period the smallest such number; no neighbour can be added. Runs of fewer than ``least_words`` words
    or ``least_periods`` periods are left out. Null, empty and short texts have none; rows with equal ids
    are texts of their own; other columns are not read.
    """
    rows = docs.select(id_column, text_column)

    def build(ids, words):
        found = runs_of(words, least_words, least_periods)
        of = pa.array([i for i, runs in enumerate(found) for _ in runs], pa.int64())
        flat = [run for runs in found for run in runs]
        return [ids.take(of), *(pa.array([getattr(r, name) for r in flat], pa.int64())
                                for name in ("start", "length", "period"))]

    names = [id_column, "start", "length", "period"]
    schema = type(rows.schema)([rows.schema[id_column]])
    for name in names[1:]:
        schema = schema.add(name, "long")
    return _mapped(rows, build, names, schema)


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS,
                    least_periods: int = LEAST_PERIODS) -> DataFrame:
    """docs with the words of every run's later periods taken out of the text.

    A text with a run becomes its kept words with one space between; others, null included, stay as they
    are. Other columns stay, whatever their names.
    """
    at = docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = utf8(batch.column(at))
            for low, high in blocks(offsets):
                part = batch.slice(low, high - low)
                texts = part.column(at).to_pylist()
                words = [(t or "").encode().split() for t in texts]
                out = [b" ".join(collapsed(w, runs)).decode() if runs else t
                       for t, w, runs in zip(texts, words, runs_of(words, least_words, least_periods))]
                columns = [pa.array(out, c.type) if i == at else c for i, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return docs.mapInArrow(clean, docs.schema)


def planted(doc_id, words: list[bytes]) -> list[bytes]:
    """The words, in a tenth of the documents from some word on a repetition of the words there.

    With h the checksum of the id as text and g = h / 10, it begins at word g % n and its period is such
    that 3 + g % 8 periods fit about. A null id has no checksum; its words stay.
    """
    if doc_id is None or not words:
        return words
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return words
    n = len(words)
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    pattern = words[start:start + period]
    return words[:start] + (pattern * ((n - start) // period + 1))[:n - start]


def run_digest(docs: DataFrame) -> DataFrame:
    """Digests of the runs of the planted documents, a row per row of docs.

    doc_id, n_runs; start, length, period, exponent_milli of the run of the most periods (the first, then
    that of the smaller period; null without runs); runs_sha256 and collapsed_sha256. Null and empty texts
    have no runs and the digests of nothing.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
             "collapsed_sha256"]

    def build(ids, words):
        words = [planted(i, w) for i, w in zip(ids.to_pylist(), words)]
        found = runs_of(words)
        rows = []
        for own, runs in zip(words, found):
            top = min(runs, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period),
                      default=None)
            lines = "".join(f"{r.start},{r.length},{r.period}\n" for r in runs)
            rows.append((len(runs), *((top.start, top.length, top.period,
                                       1000 * top.length // top.period) if top else (None,) * 4),
                         hashlib.sha256(lines.encode()).hexdigest(),
                         hashlib.sha256(b" ".join(collapsed(own, runs))).hexdigest()))
        types = [pa.int64()] * 5 + [pa.string()] * 2
        return [ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))]

    return _mapped(docs.select("doc_id", "text"), build, names,
                   f"doc_id {kind}, n_runs long, start long, length long, period long, "
                   "exponent_milli long, runs_sha256 string, collapsed_sha256 string")
