import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from isograd.llm import suffixes
from isograd.llm.grouping import suffix_array
from isograd.llm.suffixes import remove_repeats, repeat_digest
from tests.llm.conftest import prose


def brute(rows, width):
    first = {}
    for doc, text in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        data = text.encode()
        for i in range(len(data) - width + 1):
            first.setdefault(data[i:i + width], doc)
    out = []
    for doc, text, *_ in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        for i in range(len(data) - width + 1):
            if doc is not None and first[data[i:i + width]] < doc:
                gone[i:i + width] = [True] * width
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((doc or 0, len(data), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_array():
    rng = random.Random(2)
    for _ in range(400):
        text = [rng.randint(1, rng.randint(1, 5)) for _ in range(rng.randint(0, 60))] + [0]
        assert suffix_array(text) == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffix_array([]) == []


@pytest.mark.parametrize("width", [21, 50, 160])
def test_odd_rows(docs_of, odd, width):
    got = repeat_digest(docs_of(odd, clash=True), width).collect()
    assert sorted((r[0] or 0, *r[1:]) for r in got) == brute(odd, width)


def test_spliced_passages(docs_of):
    rng = random.Random(4)
    pool = [prose(50 + k, 40) for k in range(6)]
    rows = []
    for doc in range(80):
        pieces = []
        for _ in range(rng.randint(1, 4)):
            piece = rng.choice(pool)
            low = rng.randint(0, len(piece) // 2)
            pieces.append(piece[low:low + rng.randint(30, 120)])
            pieces.append(prose(rng.randint(0, 10 ** 6), rng.randint(0, 8)))
        rows.append((doc, " ".join(pieces)))
    got = repeat_digest(docs_of(rows), 50).collect()
    assert sorted(tuple(r) for r in got) == brute(rows, 50)


def test_text_keeps_whole_characters_and_columns(docs_of, odd):
    df = docs_of(odd, clash=True)
    out = remove_repeats(df, 50)
    assert out.columns == [c for c in df.columns if c != "n_bytes"] + [
        "n_bytes", "n_removed", "n_spans", "kept_bytes"]
    rows = {r.doc_id: r for r in out.collect() if r.doc_id in (1, 14, 15)}
    assert rows[1].text is None and rows[14].n_removed == 0
    assert rows[15].n_removed > 0 and rows[15].text.strip("€\U0001f600 ") == ""


def test_empty(docs_of):
    assert repeat_digest(docs_of([])).count() == 0


def surroundings(rows, width):
    """Of all anchors of the rows: document, place, hash and surroundings."""
    data = [text.encode() for _, text in rows]
    offsets = np.r_[0, np.cumsum([len(d) for d in data])].astype(np.int64)
    joined = np.frombuffer(b"".join(data), np.uint8)
    place, h, left, right = suffixes.anchors(joined, offsets, width)[:4]
    text = np.searchsorted(offsets, place, side="right") - 1
    grid = place[:, None] + np.arange(suffixes.GRAM - width, width)
    context = joined[np.clip(grid, 0, len(joined) - 1)] + np.uint8(1)
    context[(grid < left[:, None]) | (grid >= right[:, None])] = 0
    return (np.array([r[0] for r in rows])[text], np.zeros(len(text), np.uint32),
            (place - offsets[text]).astype(np.uint32), h.astype(np.uint32), context)


def removed(rows, entries, width):
    gone = {doc: [False] * len(text.encode()) for doc, text in rows}
    for doc, _, low, high in zip(*(c.tolist() for c in suffixes.covered_ranges(*entries, width))):
        gone[doc][low:high] = [True] * (high - low)
    return {doc: sum(g) for doc, g in gone.items()}


@pytest.mark.parametrize("width", [21, 33, 50])
def test_anchors_of_many_surroundings_are_sorted_in_parts(monkeypatch, width):
    rng = random.Random(8)
    passage = prose(9, 30)
    rows = [(doc, prose(rng.randint(0, 10 ** 6), 5) + passage + prose(rng.randint(0, 10 ** 6), 5))
            for doc in range(150)]
    rows += [(200 + k, "ab" * k + passage[:k] * 9 + "die " * k) for k in range(40)]
    entries = surroundings(rows, width)
    sizes = []

    def arrays(text):
        sizes.append(len(text))
        return suffix_array(text)

    monkeypatch.setattr(suffixes, "suffix_array", arrays)
    monkeypatch.setattr(suffixes, "SYMBOLS", 500, raising=False)
    monkeypatch.setattr(suffixes, "HOT", 10, raising=False)
    want = {r[0]: r[2] for r in brute(rows, width)}
    assert removed(rows, entries, width) == {doc: want[doc] for doc, _ in rows}
    assert len(sizes) > 5 and max(sizes) < sum(sizes) / 4


def test_surroundings_without_long_repeats_are_not_asked_for(docs_of):
    shared = prose(70, 12)[:24]
    rows = [(doc, prose(100 + doc, 30) + shared + prose(500 + doc, 30)) for doc in range(60)]
    passage = prose(71, 20)
    rows += [(100 + k, prose(900 + k, 30) + passage + prose(950 + k, 30)) for k in range(2)]
    docs = docs_of(rows)
    asked = {}
    for row in (suffixes._find_occurrences(docs, 50, 3).groupBy("bucket")
                .applyInArrow(suffixes._meet(50, 3), suffixes._PACKET)
                .where(F.col("kind") == suffixes.REQUESTS).collect()):
        for doc in suffixes.unpack(row.data)[0].tolist():
            asked[doc] = asked.get(doc, 0) + 1
    assert asked and set(asked) == {100, 101}
    assert sorted(tuple(r) for r in repeat_digest(docs, 50).collect()) == brute(rows, 50)


def test_buckets_do_not_grow_with_the_partitions(spark, docs_of, monkeypatch):
    class Seen(Exception):
        pass

    def seen(docs, width, buckets):
        raise Seen(buckets)

    monkeypatch.setattr(suffixes, "_find_occurrences", seen)
    monkeypatch.setattr(suffixes, "SMALLEST", 1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "100000")
    try:
        with pytest.raises(Seen) as found:
            remove_repeats(docs_of([(1, prose(1, 2000))]))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found.value.args[0] <= 256
