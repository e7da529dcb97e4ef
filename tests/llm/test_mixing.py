import hashlib
import random

import pytest

from isograd.llm import mixing
from tests.llm.conftest import prose


def brute_targets(sizes):
    """Weights 5, 2, 1 over 1.5 times all words, at most twice a source; the excess shared again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    order += [None] if None in sizes else []
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            out.update({s: weight[s] * level for s in open_})
            break
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def check(rows, got):
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        source = r[2] if len(r) > 2 else "s0"
        sizes[source] = sizes.get(source, 0) + len((r[1] or "").encode().split())
    want = brute_targets(sizes)
    for source, target in want.items():
        own = [r for r in got if r.source == source]
        assert all(r._target == pytest.approx(target) for r in own)
        assert all(r._total == sizes[source] for r in own)
        taken = sum(r._taken for r in own)
        assert target - 1 <= taken + 1e-6 and taken <= target + 1e-6
        assert all(0 <= r._taken <= 2 * r._size for r in own)
        assert all(len(r._positions) == -(-r._taken // r._size) if r._size else not r._positions
                   for r in own)


def test_many_sources(docs_of):
    rng = random.Random(1)
    rows = [(k, prose(k, rng.randint(1, 60)), "hot" if rng.random() < 0.4 else f"s{rng.randint(0, 9)}")
            for k in range(300)] + [(400, prose(9, 30), None), (401, prose(8, 3), "Ä")]
    check(rows, mixing.mixture(docs_of(rows, clash=True)).collect())


def test_odd_rows(docs_of, odd):
    check(odd, mixing.mixture(docs_of(odd)).collect())
    assert mixing.mixed_sizes(docs_of([])).count() == 0
    nothing = mixing.mixed_sizes(docs_of([(1, None), (2, " ")])).collect()
    assert [(r.size, r.source_size, r.target, r.taken, r.position) for r in nothing] == [
        (0, 0, 0.0, 0, None)] * 2


def test_positions_follow_the_schedule(docs_of):
    rows = [(k, prose(k, 20), f"s{k % 3}") for k in range(600)]
    got = mixing.curriculum(docs_of(rows))
    assert {"turn", "position"} <= set(got.columns)
    places = got.collect()
    # the first source's weight grows, the last one's shrinks
    for source, low, high in (("s0", 0.55, 0.75), ("s2", 0.25, 0.45)):
        own = sorted(r.position for r in places if r.source == source)
        late = sum(p >= 0.5 for p in own) / len(own)
        assert low < late < high, (source, late)
    again = mixing.curriculum(docs_of(rows[::-1])).collect()
    assert sorted(map(str, places)) == sorted(map(str, again))


def test_order_of_documents_is_that_of_their_hash(docs_of):
    rows = [(k, prose(k, 10), "a") for k in range(50)] + [(99, prose(3, 4000), "b")]
    got = {r.doc_id: r._taken for r in mixing.mixture(docs_of(rows)).collect()}
    order = sorted(range(50), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    taken = [got[k] for k in order]
    assert taken == sorted(taken, reverse=True)
