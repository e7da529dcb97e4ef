import random

from isograd.llm.tokens import PieceCounter, token_counts


def greedy(word, initial, following):
    count, at, pieces = 0, 0, initial
    while at < len(word):
        size = next((n for n in range(len(word) - at, 0, -1) if word[at:at + n] in pieces), 0)
        if not size:
            return 1
        count, at, pieces = count + 1, at + size, following
    return count


def test_against_greedy_search():
    rng = random.Random(5)
    for _ in range(150):
        def some(k):
            return {bytes(rng.choices(b"abc", k=rng.randint(1, 5))) for _ in range(k)}

        initial, following = some(12), some(12)
        counter = PieceCounter(initial, following)
        for _ in range(60):
            word = bytes(rng.choices(b"abcd", k=rng.randint(1, 12)))
            assert counter.count(word) == greedy(word, initial, following), word


def test_documents(docs_of, odd):
    pieces = [b" ", b"t", b" th", b"he", b"e", b" wo", b"rd", b"s", b"w"] + [bytes([b]) for b in range(256)]
    rows = token_counts(docs_of(odd, clash=True), pieces).collect()
    assert len(rows) == len(odd)
    got = sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in rows)
    initial, following = ({p for p in pieces if (p[:1] == b" ") == first} for first in (True, False))
    want = sorted((r[0] or 0, len((r[1] or "").encode().split()),
                   sum(greedy(b" " + w, initial, following) for w in (r[1] or "").encode().split()))
                  for r in odd)
    assert got == want
    assert token_counts(docs_of([]), pieces).count() == 0
