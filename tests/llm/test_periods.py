import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from isograd.llm import periods
from isograd.llm.periods import Catcher, Run
from tests.llm.conftest import prose


def brute(words, least_words=24, least_periods=3):
    """Maximal stretches of every period, the smallest period of each."""
    n, found = len(words), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least_words, least_periods * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((Run(s, k, q) for (s, k), q in found.items()), key=lambda r: (r.start, r.period))


def sequences(count, seed):
    """Random letters, mixed with repetitions, repetitions of these, and single faults in them."""
    rng = random.Random(seed)
    for _ in range(count):
        out, letters = [], rng.choice([1, 2, 2, 3, 5, 50])
        while len(out) < rng.choice([10, 60, 200, 600]):
            piece = [rng.randrange(letters) for _ in range(rng.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 40]))]
            for _ in range(rng.randint(0, 2)):
                piece = (piece * rng.randint(1, 6))[:rng.randint(1, 300)]
            if rng.random() < 0.4:
                piece[rng.randrange(len(piece))] = rng.randrange(letters + 1)
            out += piece
        yield out


@pytest.mark.parametrize("least_words,least_periods", [(24, 3), (2, 2), (25, 3), (10, 4), (3, 3), (31, 7)])
def test_against_brute_force(least_words, least_periods):
    for words in sequences(250, least_words):
        catcher = Catcher(least_words, least_periods)
        catcher.append(np.array(words))
        assert catcher.runs() == brute(words, least_words, least_periods), words


@pytest.mark.parametrize("least_words,least_periods", [(24, 3), (4, 2)])
def test_appended_in_parts(least_words, least_periods):
    rng = random.Random(4)
    for words in sequences(60, 77):
        catcher, at = Catcher(least_words, least_periods), 0
        while at < len(words):
            step = rng.choice([1, 1, 2, 5, 30, 100])
            catcher.append(np.array(words[at:at + step]))
            at += step
            if rng.random() < 0.1:
                assert catcher.runs() == brute(words[:at], least_words, least_periods)
        assert catcher.runs() == brute(words, least_words, least_periods), words


def test_fibonacci_word_and_long_repeats():
    a, b = [0], [0, 1]
    while len(b) < 1500:
        a, b = b, b + a
    for words in (b, [7] * 3000, [1, 2] * 700 + [3] + [1, 2] * 700 + [4] + [1, 2] * 700,
                  ([5] * 40 + [6]) * 60, list(range(100)) * 7):
        catcher = Catcher()
        catcher.append(np.array(words))
        assert catcher.runs() == brute(words)


def test_work_grows_with_the_words(monkeypatch):
    compared = []
    kept = periods._same_prefix
    monkeypatch.setattr(periods, "_same_prefix", lambda a, b: compared.append(k := kept(a, b)) or k)
    for words in ([1] * 200_000, [1, 2, 3] * 70_000, ([1] * 3000 + [2]) * 60, ([1, 2] * 40 + [3, 3]) * 2000):
        compared.clear()
        catcher = Catcher()
        catcher.append(np.array(words))
        assert catcher.runs()
        assert len(compared) < 0.4 * len(words) and sum(compared) < 40 * len(words)


def digest(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    top = sorted(runs, key=lambda r: (-Fraction(r.length, r.period), r.start, r.period))[:1]
    drop = {i for r in runs for i in range(r.start + r.period, r.start + r.length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in drop)
    return (len(runs), *([top[0].start, top[0].length, top[0].period,
                          top[0].length * 1000 // top[0].period] if top else [None] * 4),
            hashlib.sha256("".join(f"{r.start},{r.length},{r.period}\n" for r in runs).encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest())


def test_documents(docs_of, odd):
    rows = odd + [(100 + i, " ".join(map(str, w))) for i, w in enumerate(sequences(300, 5))]
    rows += [(1000 + i, prose(i, 40 + i)) for i in range(80)]
    rows = [(d, t) for d, t, *_ in rows if d != 10 and d != 11]
    got = periods.run_digest(docs_of(rows, clash=True)).collect()
    assert len(got) == len(rows)
    assert sorted((str(r[0]), *map(str, r[1:])) for r in got) == sorted(
        (str(d), *map(str, digest(d, t))) for d, t in rows)
    assert sum(r.n_runs > 0 for r in got) > 100
    assert periods.run_digest(docs_of([])).count() == 0


def test_operator_outputs(docs_of, spark):
    text = "Oh no: " + "la li\tlu " * 20 + "end " * 30 + "fin"
    docs = docs_of([(1, text), (1, text), (2, "la " * 23), (None, "la " * 24), (3, None)], clash=True)
    runs = sorted(periods.word_runs(docs).collect(), key=str)
    assert [tuple(r) for r in runs] == [(1, 2, 60, 3), (1, 62, 30, 1)] * 2 + [(None, 0, 24, 1)] or \
        sorted(map(str, map(tuple, runs))) == sorted(map(str, [(1, 2, 60, 3), (1, 62, 30, 1)] * 2
                                                         + [(None, 0, 24, 1)]))
    clean = periods.without_repeats(docs)
    assert clean.columns == docs.columns
    texts = [r.text for r in clean.collect()]
    assert texts.count("Oh no: la li lu end fin") == 2 and "la" in texts and "la " * 23 in texts
    assert None in texts
