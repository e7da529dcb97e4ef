"""Token counts: greedy longest-match word pieces, counted without building them.

A trie over the vocabulary gets a failure link per node: the node reached once the pieces that can
no longer grow are popped. How many pieces that pops is stored with the link, so a word is counted in
one pass over its bytes, each byte read once.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A worker's memory of counted words; it is emptied when full, which changes no count.
MEMORY = 400_000


class PieceCounter:
    """Counts the pieces of a word: the first from ``initial``, the others from ``following``.

    A word that the vocabulary can't spell counts as one unknown piece.
    """

    def __init__(self, initial: Iterable[bytes], following: Iterable[bytes]):
        self.step: dict[int, int] = {}
        final = [False, False]
        children: list[list[tuple[int, int]]] = [[], []]
        for root, pieces in ((0, initial), (1, following)):
            for piece in pieces:
                node = root
                for byte in piece:
                    key = node << 8 | byte
                    if key not in self.step:
                        self.step[key] = len(final)
                        children[node].append((byte, len(final)))
                        final.append(False)
                        children.append([])
                    node = self.step[key]
                final[node] = node > 1
        self.link, self.popped = [-1] * len(final), [0] * len(final)
        queue = deque((0, 1))
        while queue:
            node = queue.popleft()
            for byte, child in children[node]:
                queue.append(child)
                if final[child]:
                    self.link[child], self.popped[child] = 1, 1
                    continue
                back, count = self.link[node], self.popped[node]
                while back >= 0 and (back << 8 | byte) not in self.step:
                    count += self.popped[back]
                    back = self.link[back]
                if back >= 0:
                    self.link[child], self.popped[child] = self.step[back << 8 | byte], count

    def count(self, word: bytes) -> int:
        step, link, popped, node, total = self.step, self.link, self.popped, 0, 0
        for byte in word:
            while (after := step.get(node << 8 | byte, -1)) < 0:
                if link[node] < 0:
                    return 1
                total += popped[node]
                node = link[node]
            node = after
        while node > 1:
            if link[node] < 0:
                return 1
            total += popped[node]
            node = link[node]
        return total


class _Counts(dict):
    def __init__(self, counter: PieceCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        found = self.counter.count(b" " + word)
        if len(word) < 64:
            self[word] = found
        return found


def read_pieces(path: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary file: one base64 piece and its rank per line."""
    with open(path, "rb") as file:
        return [base64.b64decode(line.split()[0]) for line in file if line.strip()]


_ready: dict[int, _Counts] = {}


def token_counts(docs: DataFrame, pieces: list[bytes], id_column: str = "doc_id",
                 text_column: str = "text") -> DataFrame:
    """Words and word pieces of every text: id, n_words, n_tokens.

    Words are ``[^\\x20\\x09-\\x0D]+``; one is spelled with a blank before it, so pieces that start with a
    blank begin words and the others go on. Null and empty texts have 0 of both; rows with equal ids
    stay apart; other columns are not read. The vocabulary is broadcast: its size is that of its file.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    mark = hash(tuple(pieces))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _ready:
            _ready.clear()
            _ready[mark] = _Counts(PieceCounter(
                [p for p in shared.value if p[:1] == b" "],
                [p for p in shared.value if p[:1] != b" "]))
        look = _ready[mark].__getitem__
        for batch in batches:
            words, tokens = [], []
            for text in batch.column(1):
                split = (text.as_py() or "").encode().split()
                words.append(len(split))
                tokens.append(sum(map(look, split)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())],
                names=[id_column, "n_words", "n_tokens"])

    rows = docs.select(id_column, text_column)
    kind = rows.schema[id_column].dataType.simpleString()
    return rows.mapInArrow(count, f"{id_column} {kind}, n_words long, n_tokens long")
