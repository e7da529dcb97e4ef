"""Languages by rank-order profiles of n-grams.

A profile is the list of the n-grams that a language uses most, in order. A document's own list is
compared with each of them: an n-gram counts as many places as it is out of place, one that a profile
doesn't have as many as the profile is long. The language of the smallest sum is the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isograd.llm.common import blocks, remainder, utf8, written

#: N-grams of a word, which has a blank on either side, are this long at most.
LONGEST_GRAM = 5
#: N-grams of a profile, and of a document's list.
PLACES = 300
#: Bounds of the learning sample: about so many different texts of a language, of so many bytes at most.
PER_LANGUAGE, LONGEST = 2000, 16_000
#: Up to so many langs their limits are sent to all tasks; more are joined.
BROADCAST_LANGUAGES = 10_000
UNKNOWN = "und"

_FACTOR, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_KEY_BITS = 48


@dataclass(frozen=True)
class Profiles:
    """Languages in order; keys of all their n-grams, sorted; per key its best and its own places."""
    languages: tuple[str, ...]
    keys: np.ndarray
    best: np.ndarray
    places: np.ndarray


class _Letters:
    """Which code points are letters; the table reaches as far as the texts did so far."""

    def __init__(self):
        self.known = np.zeros(0, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        top = int(points.max(initial=0)) + 1
        if top > len(self.known):
            more = [chr(p).isalpha() for p in range(len(self.known), top)]
            self.known = np.r_[self.known, np.array(more, bool)]
        return self.known[points]


_letters = _Letters()


def word_stream(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words in lower case, each word with a 0 before and after, and their texts."""
    lower = [(t or "").lower() + "\n" for t in texts]
    points = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lower)), [len(t) for t in lower])
    letter = _letters(points)
    kept = letter.copy()
    kept[1:] |= letter[:-1]
    points = np.where(letter, points, np.uint32(0))[kept]
    return np.r_[np.uint32(0), points], np.r_[0, owner[kept]]


def gram_keys(points: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, keys) of the n-grams of a word stream; blanks stand only at their ends.

    An n-gram belongs to the text of its last code point: the blank before a word may be the one after
    the last word of another text.
    """
    full = points.astype(np.uint64) + np.uint64(1)
    inner = np.ones(len(points), bool)
    h = np.zeros(len(points) + 1, np.uint64)
    for n in range(1, LONGEST_GRAM + 1):
        if len(points) < n:
            return
        h = h[:len(points) - n + 1] * _FACTOR + full[n - 1:]
        inner = inner[:len(h)]
        if n > 2:
            inner = inner & (points[n - 2:len(points) - 1] != 0)
        starts = np.flatnonzero(inner if n > 1 else points != 0)
        mixed = h[starts] * _SPREAD
        yield n, starts, (mixed ^ (mixed >> np.uint64(31))) * _FACTOR >> np.uint64(64 - _KEY_BITS)


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, key, count) of the n-grams of at most 65,536 texts, sorted by text and key."""
    points, owner = word_stream(texts)
    all_keys = [np.zeros(0, np.uint64)]
    for n, starts, keys in gram_keys(points, owner):
        all_keys.append(owner[starts + n - 1].astype(np.uint64) << np.uint64(_KEY_BITS) | keys)
    found = np.sort(np.concatenate(all_keys))
    first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]]) if len(found) else np.zeros(0, int)
    count = np.diff(np.r_[first, len(found)])
    found = found[first]
    return ((found >> np.uint64(_KEY_BITS)).astype(np.int64),
            found & np.uint64((1 << _KEY_BITS) - 1), count)


def key_of(gram: str) -> int:
    """The key of one n-gram, blanks as spaces."""
    points = np.array([0 if c == " " else ord(c) for c in gram], np.uint32)
    for n, _, keys in gram_keys(np.r_[points, np.uint32(1)], np.zeros(len(gram) + 1, int)):
        if n == len(gram):
            return int(keys[0])
    raise ValueError(f"an n-gram has 1 to {LONGEST_GRAM} letters or blanks at its ends: {gram!r}")


def _text_grams(text: str) -> dict[str, int]:
    points, owner = word_stream([text])
    out: dict[str, int] = {}
    for n, starts, keys in gram_keys(points, owner):
        _, at, count = np.unique(keys, return_index=True, return_counts=True)
        for start, k in zip(starts[at], count):
            gram = "".join(chr(p) if p else " " for p in points[start:start + n])
            out[gram] = out.get(gram, 0) + int(k)
    return out


def language_profiles(rows: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, place (from 0), gram, n: the n-grams that each lang of rows (lang, text) uses most.

    About ``per_language`` different texts of up to ``LONGEST`` bytes are learned from per lang, those of
    the smallest hashes, so that copies of a text count once. Ties go to the n-gram first in order. Null
    langs and texts teach nothing.
    """
    rows = (rows.select(F.col("lang").alias("lang"), F.col("text").alias("text"))
            .where("lang IS NOT NULL AND text IS NOT NULL")
            .where(F.octet_length("text").between(1, LONGEST))
            .withColumn("h", F.xxhash64("text")))
    limit = F.lit(float(per_language)) / F.approx_count_distinct("h", 0.02) * F.lit(float(1 << 31))
    limits = written(rows.groupBy("lang").agg(limit.cast("long").alias("most")), "language-limits")
    if limits.count() <= BROADCAST_LANGUAGES:
        limits = F.broadcast(limits)
    drawn = (rows.join(limits, "lang")
             .where(F.col("h").bitwiseAND((1 << 31) - 1) < F.col("most"))
             .dropDuplicates(["lang", "h"]).select("lang", "text"))

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, texts = (batch.column(i).to_pylist() for i in (0, 1))
            total: dict[tuple[str, str], int] = {}
            for lang in set(langs):
                joined = "\n".join(t for t, of in zip(texts, langs) if of == lang)
                for gram, n in _text_grams(joined).items():
                    total[lang, gram] = n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in total], pa.string()), pa.array([g for _, g in total], pa.string()),
                 pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    total = (drawn.mapInArrow(grams, "lang string, gram string, n long")
             .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return (total.withColumn("place", F.row_number().over(order) - 1)
            .where(F.col("place") < PLACES).select("lang", "place", "gram", "n"))


def learned(profiles: DataFrame) -> Profiles:
    """The profiles as arrays on the driver: at most ``PLACES`` rows of each lang."""
    rows = profiles.select("lang", "place", "gram").collect()
    languages = tuple(sorted({r.lang for r in rows}))
    column = {lang: i for i, lang in enumerate(languages)}
    of_gram = {gram: key_of(gram) for gram in {r.gram for r in rows}}
    keys = np.unique(np.array(list(of_gram.values()), np.uint64))
    places = np.full((len(keys), len(languages)), PLACES, np.int32)
    for r in rows:
        places[np.searchsorted(keys, np.uint64(of_gram[r.gram])), column[r.lang]] = r.place
    best = places.min(axis=1, initial=PLACES)
    return Profiles(languages, keys, best.astype(np.uint64), places)


def nearest(texts: list[str | None], model: Profiles) -> tuple[list[str], np.ndarray]:
    """The language of each text and its score."""
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    text, key, count = counted(texts)
    if not len(text) or not model.languages:
        return names, scores
    at = np.minimum(np.searchsorted(model.keys, key), len(model.keys) - 1)
    known = model.keys[at] == key
    # most frequent first; ties by the best place in any profile, then by key
    tie = np.where(known, model.best[at], np.uint64(PLACES))
    order = np.lexsort((key, tie, -count, text))
    text, at, known = text[order], at[order], known[order]
    first = np.searchsorted(text, np.arange(len(texts) + 1))
    place = np.arange(len(text)) - first[text]
    listed = np.flatnonzero(place < PLACES)
    text, place = text[listed], place[listed]
    away = np.where(known[listed, None], model.places[at[listed]], PLACES)
    away = np.where(away == PLACES, PLACES, np.abs(away - place[:, None]))
    starts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
    total = np.add.reduceat(away, starts, axis=0)
    winner = total.argmin(axis=1)
    least = total[np.arange(len(starts)), winner].astype(float)
    total[np.arange(len(starts)), winner] = np.iinfo(total.dtype).max
    most = np.diff(np.r_[starts, len(text)]) * float(PLACES)
    second = np.minimum(total.min(axis=1).astype(float), most)
    scores[text[starts]] = 1 - least / np.maximum(second, 1)
    for i, w in zip(text[starts].tolist(), winner.tolist()):
        names[i] = model.languages[w]
    return names, scores


def with_language(docs: DataFrame, model: Profiles, name: str = "lang_pred",
                  score: str = "score") -> DataFrame:
    """The rows of docs with the language of their text and a score from 0 to 1.

    The whole text is read. The score is 1 less the sum of the nearest profile by that of the next (by
    the largest possible one if there is only one): 0 where two are equally near. Of these the first in
    order is taken. Null texts, texts without letters, and all texts where no profile was learned are
    ``und`` with a score of 0. Equal texts get equal results. Columns of the two names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name, score)
    at = docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            _, offsets = utf8(batch.column(at))
            for low, high in blocks(offsets):
                part = batch.slice(low, high - low)
                names, scores = nearest(part.column(at).to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=[*part.schema.names, name, score])

    schema = docs.schema
    return docs.mapInArrow(predict, type(schema)(list(schema.fields)).add(name, "string")
                           .add(score, "double"))


def language_predictions(docs: DataFrame, modulus: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from rows whose crc32(doc_id) mod 4 isn't 2.

    Rows without doc_id teach nothing and aren't held out.
    """
    of = remainder("doc_id", modulus)
    model = learned(language_profiles(docs.where((of >= 0) & (of != held)).select("lang", "text")))
    return with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", (remainder("doc_id", modulus) == held).alias("held_out"), "lang_pred", "score")
