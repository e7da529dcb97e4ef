"""Quality by compression: texts that shrink more with a dictionary of good text score higher.

Two zstandard dictionaries are built, from pieces of good and of bad labelled texts. A text is
compressed piece by piece with either; the difference of the sizes by the text's length, next to the
size by the bad one, goes through a logistic calibration fitted on labelled texts that built no dictionary.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.llm.common import labelled_sample, logistic, remainder, share_of_ones

#: Bytes of a piece; small, so that the dictionary and not the text's own start helps to compress it.
PIECE = 512
#: Bounds of the learning sample: texts of a label, and bytes of a text.
PER_CLASS, LONGEST = 4000, 16_000
DICTIONARY = 64 << 10
ACCEPT = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    weights: tuple[float, ...]
    #: The score where nothing could be learned.
    fixed: float | None = None


def _pieces(data: bytes) -> list[bytes]:
    return [data[i:i + PIECE] for i in range(0, len(data), PIECE)]


def _dictionary(texts: list[str]) -> bytes:
    samples = [p for t in texts for p in _spread(_pieces(t.encode()))]
    try:
        return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the text itself serves
        return b"".join(samples)[-DICTIONARY:]


def _own_lines(texts: list[str]) -> list[str]:
    """The texts without the lines that several of them have, which tell nothing of quality.

    Else a line that good and bad texts share would count for the side whose dictionary holds it.
    """
    count = Counter(line for t in texts for line in set(t.split("\n")))
    return ["\n".join(line for line in t.split("\n") if count[line] == 1) for t in texts]


def _spread(pieces: list[bytes], most: int = 6) -> list[bytes]:
    """At most so many pieces, spread evenly."""
    return pieces if len(pieces) <= most else [pieces[i * len(pieces) // most] for i in range(most)]


class Sizer:
    """Sizes of a text by either dictionary."""

    def __init__(self, good: bytes, bad: bytes):
        plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        self.by = [zstandard.ZstdCompressor(
            level=1, dict_data=zstandard.ZstdCompressionDict(d), **plain) for d in (good, bad)]

    def features(self, text: str | None) -> tuple[float, float]:
        """(bad size - good size) / length, bad size / length: both larger for better texts."""
        data = (text or "").encode()
        sizes = [sum(len(by.compress(p)) for p in _pieces(data)) for by in self.by]
        return (sizes[1] - sizes[0]) / max(1, len(data)), sizes[1] / max(1, len(data))


def learn(docs: DataFrame, labels: DataFrame, label: str, train) -> Model:
    """Dictionaries from one half of the sample, calibration from the other."""
    prior = share_of_ones(labels, label, train)
    sample = labelled_sample(docs, labels, label, train, PER_CLASS, LONGEST)
    build, check = sample[::2], sample[1::2]
    own = _own_lines([t for t, _ in build])
    build = [(t, y) for t, (_, y) in zip(own, build) if t.strip()]
    sides = [[t for t, y in build if y == side] for side in (1, 0)]
    if not (all(sides) and len({y for _, y in check}) == 2):
        return Model(b"", b"", (), 0.5 if prior is None else prior)
    good, bad = map(_dictionary, sides)
    sizer = Sizer(good, bad)
    x = np.array([sizer.features(t) for t, _ in check])
    scale = x.std(axis=0) + 1e-9
    weights = logistic(x / scale, np.array([y for _, y in check]), prior)
    return Model(good, bad, (*(weights[:-1] / scale), weights[-1]))


def score_texts(texts, model: Model, sizer: Sizer | None) -> np.ndarray:
    if model.fixed is not None:
        return np.full(len(texts), model.fixed)
    x = np.array([sizer.features(t) for t in texts]).reshape(-1, 2)
    z = np.c_[x, np.ones(len(x))] @ np.array(model.weights)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """The rows of docs with a score from 0 to 1 each.

    The whole text is read; a null text counts as empty, and empty texts all get the calibrated score
    of sizes 0. Equal texts get equal scores. A column of the score's name is replaced. Where labels of
    both kinds are missing the score is the share of label 1 (0.5 without labels). The model (two
    dictionaries of at most 64 KB) goes to the tasks.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(name)
    at = docs.columns.index("text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        sizer = Sizer(model.good, model.bad) if model.fixed is None else None
        for batch in batches:
            values = score_texts([t.as_py() for t in batch.column(at)], model, sizer)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())],
                                             names=[*batch.schema.names, name])

    schema = docs.schema
    return docs.mapInArrow(score, type(schema)(list(schema.fields)).add(name, "double"))


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows whose crc32(doc_id) mod 5 isn't 0."""
    model = learn(docs, labels, "quality", lambda c: remainder(c, modulus) > 0)
    rows = docs.select("doc_id", "text")
    return (scored(rows, model).select(
        "doc_id", (remainder("doc_id", modulus) == 0).alias("held_out"), "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted")))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier doesn't reject, with their columns."""
    model = learn(docs, labels, "quality", lambda c: F.col(c).isNotNull())
    return (scored(docs, model, "_quality").where(F.col("_quality") >= ACCEPT)
            .select(*(F.col(f"`{c}`") for c in docs.columns)))
