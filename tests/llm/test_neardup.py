import random

import numpy as np

from isograd.llm import neardup
from isograd.llm.neardup import Similar, likely, near_duplicates, sets_of

from tests.llm.conftest import prose


def shingle_set(text, size):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = low.encode().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + size]) for i in range(len(words) - size + 1))


def brute(rows, rule):
    sets = {}
    for r in rows:
        if r[0] is not None:
            sets.setdefault(r[0], []).append(shingle_set(r[1], rule.words))
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1:]:
            for s in sets[a]:
                for t in sets[b]:
                    k = len(s & t)
                    if s and t and 100 * k >= rule.percent * (len(s) + len(t) - k):
                        ra, rb = sorted((root(a), root(b)))
                        parent[rb] = ra
    return {i: root(i) for i in ids}


def check(docs_of, rows, rule, **more):
    got = near_duplicates(docs_of(rows, **more), rule).collect()
    want = brute(rows, rule)
    assert len(got) == len(rows)
    for r in got:
        assert r.component_id == want.get(r.doc_id)
        assert r.kept == (r.doc_id is None or r.doc_id == want[r.doc_id])
    counts = sorted((r.doc_id or 0, r.n_shingles) for r in got)
    assert counts == sorted((r[0] or 0, len(shingle_set(r[1], rule.words))) for r in rows)


def test_odd_rows(docs_of, odd):
    check(docs_of, odd, Similar(words=3, percent=85), clash=True)
    check(docs_of, odd, Similar())


def test_chains_and_groups(docs_of):
    rng = random.Random(9)
    rows, number = [], 0
    for family in range(12):
        words = prose(100 + family, rng.randint(20, 200)).split()
        for _ in range(rng.randint(1, 12)):
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randint(0, 999)}"
            rows.append((number, " ".join(words)))
            number += 1
    rng.shuffle(rows)
    check(docs_of, rows, Similar(words=3, percent=85))


def test_empty(docs_of):
    assert near_duplicates(docs_of([])).count() == 0


def test_pruning_keeps_similar_and_drops_others(docs_of):
    rule = Similar()
    words = prose(7, 400).split()
    close = [*words[:390], "a", "b", *words[392:]]
    rows = [(1, " ".join(words)), (2, " ".join(close)), (3, prose(8, 400))]
    found = {r.doc_id: np.frombuffer(r.signature, np.uint32)
             for r in sets_of(docs_of(rows), rule).collect()}
    left = np.stack([found[1], found[1]])
    right = np.stack([found[2], found[3]])
    assert likely(left, right, rule).tolist() == [0]


def test_strangers_in_a_large_band(spark):
    """A band of one component and a few others: its members are not sent once per block of themselves."""
    named = spark.range(50_010).selectExpr(
        "CAST(7 AS long) AS band", "id AS doc_id", "IF(id < 50000, 0L, id) AS label")
    rows = neardup.meetings(named)
    assert rows.count() < 3 * 50_000
    largest = rows.groupBy("band", "x", "y").count().agg({"count": "max"}).first()[0]
    assert largest <= 2 * neardup.BLOCK


def test_different_labels_meet_once(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(2)
    members = [(band, doc, rng.choice([1, 1, 1, 2, 3, doc])) for band in range(12)
               for doc in rng.sample(range(1000), rng.choice([1, 2, 3, 9, 30]))]
    named = spark.createDataFrame(members, "band long, doc_id long, label long")
    met = {}
    for r in neardup.meetings(named).collect():
        met.setdefault((r.band, r.x, r.y), []).append(r)
    got = []
    for (band, x, y), group in met.items():
        for a in group:
            for b in group:
                if a.own == x and b.own == y and a.label != b.label and (x != y or a.doc_id < b.doc_id):
                    got.append((band, *sorted((a.doc_id, b.doc_id))))
    size = {band: sum(m[0] == band for m in members) for band in range(12)}
    want = [(a[0], a[1], b[1]) for a in members for b in members
            if a[0] == b[0] and a[1] < b[1] and a[2] != b[2] and size[a[0]] > 2]
    assert sorted(got) == sorted(want)
