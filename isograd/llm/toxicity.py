"""Toxicity by a subsequence string kernel: a support vector machine on Nyström features.

The kernel of two strings sums, over all three-letter subsequences within a short span, products of
weights that shrink with the gaps; so ``st*upid`` or ``stuupid`` stay close to ``stupid``. Landmarks
are drawn from the labelled sentences; with them the kernel becomes a vector, and a linear machine on
those vectors is learned. As the machine is linear in the landmarks' kernels, it folds into one weight
per subsequence, and scoring a word is a sum of such weights.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isograd.llm.common import labelled_sample, logistic, remainder, share_of_ones

#: Bounds of the learning sample: texts of a label, and bytes of a text.
PER_CLASS, LONGEST = 3000, 16_000
LANDMARKS = 400
#: Clean words to learn from at a time, and the total cost of either side.
NEGATIVES, COST = 8000, 3000.0
#: Times the machine over windows is trained.
PHRASE_TURNS = 3
#: Letters a subsequence may span, and what each letter of a gap costs.
SPAN, DECAY = 6, 0.5
#: Longer words are read by overlapping parts of this length.
PART = 16
ACCEPT = 0.3
MEMORY = 300_000
#: Code points that a table looks up, others are searched; weights that are a cube, others are searched.
LOW, DENSE = 0x3000, 1 << 22
_EDGE = ".,;:!?\"'()[]{}<>|*#$%&-_=/\\"
_PAIRS = [(j, k) for j in range(1, SPAN - 1) for k in range(j + 1, SPAN)]
_SENTENCE = re.compile(r"[.!?\n]+")
#: Words of the longest window, most telling words and phrases.
GRAMS, WITNESSES = 4, 4000
_MASK, _SEEDS = 2 ** 64 - 1, [k * 0x2545F4914F6CDD1D & (2 ** 64 - 1) for k in range(1, 9)]


def _norm(length: int) -> float:
    """Root of the squared weights of all subsequences of a marked word of a length."""
    return sum(DECAY ** (2 * (k - 2)) * max(0, length - k) for _, k in _PAIRS) ** 0.5 or 1.0


def phi(word: str) -> dict[str, float]:
    """Weights of the subsequences of a word, its ends marked, by the norm of its length.

    The ends of a window of several words are blanks.
    """
    s = f" {word} " if " " in word else f"^{word}$"
    out: dict[str, float] = {}
    for j, k in _PAIRS:
        for i in range(len(s) - k):
            u = s[i] + s[i + j] + s[i + k]
            out[u] = out.get(u, 0.0) + DECAY ** (k - 2)
    norm = _norm(len(s))
    return {u: v / norm for u, v in out.items()}


def words_of(text: str) -> list[str]:
    """Words in lower case, and runs of three or more single letters, joined."""
    tokens = text.lower().split()
    single = [i for i, t in enumerate(tokens) if len(t) == 1]
    if len(single) > 2:
        run = [single[0]]
        for i in [*single[1:], -1]:
            if i == run[-1] + 1:
                run.append(i)
                continue
            if len(run) > 2:
                tokens.append("".join(tokens[k] for k in run))
            run = [i]
    return tokens


def normal(text: str) -> str:
    """A text in lower case, its words without the marks around them, with single blanks."""
    return " ".join(core for t in text.lower().split() if (core := t.strip(_EDGE)))


def parts(token: str) -> list[str]:
    """What is scored of a token: its core, its letters alone, overlapping pieces of long ones."""
    core = token.strip(_EDGE)
    if not core:
        return []
    if len(core) <= PART + PART // 2:
        if not core.isalnum() and len(letters := re.sub(r"[\W_]+", "", core)) > 2:
            return [core, letters]
        return [core]
    return [core[i:i + PART] for i in range(0, len(core) - PART // 2, PART // 2)]


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    slope: tuple[float, ...]
    fixed: float | None = None
    #: Weights and bias of the machine over windows of several words, if such windows are telling.
    phrases: tuple[dict[str, float], float] | None = None


class _Weights:
    """Weights of subsequences by the code points of their three letters."""

    def __init__(self, weights: dict[str, float]):
        self.letters = np.array(sorted({ord(c) for u in weights for c in u}), np.uint32)
        # 0 stands for every character that is not in the model
        self.low = np.zeros(LOW, np.int64)
        self.low[self.letters[self.letters < LOW]] = np.flatnonzero(self.letters < LOW) + 1
        self.base = len(self.letters) + 1
        keys = self.codes(np.array([[ord(c) for c in u] for u in weights], np.uint32).reshape(-1))
        keys = self.key(keys[::3], keys[1::3], keys[2::3])
        values = np.array(list(weights.values()), np.float32)
        self.dense = self.base ** 3 <= DENSE
        if self.dense:
            self.table = np.zeros(self.base ** 3, np.float32)
            self.table[keys] = values
        else:
            order = np.argsort(keys)
            self.keys, self.table = keys[order], values[order]

    def codes(self, points: np.ndarray) -> np.ndarray:
        """Numbers of code points."""
        out = self.low[np.minimum(points, LOW - 1)]
        high = np.flatnonzero(points >= LOW - 1)
        if len(high):
            place = np.searchsorted(self.letters, points[high])
            known = place < len(self.letters)
            known[known] = self.letters[place[known]] == points[high[known]]
            out[high] = np.where(known, place + 1, 0)
        return out

    def key(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (a * self.base + b) * self.base + c

    def look(self, keys: np.ndarray) -> np.ndarray:
        """Weights of keys, 0 of unknown ones."""
        if self.dense:
            return self.table[keys]
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[place] == keys, self.table[place], np.float32(0))


class Machine:
    """Decision value per token; those of common tokens are remembered."""

    def __init__(self, model: Model):
        self.bias = model.bias
        self.known: dict[str, float] = {}
        self.weights = _Weights(model.weights)
        self.norms = np.array([_norm(n) for n in range(2 * PART + 4)])
        self.phrases = _Weights(model.phrases[0]) if model.phrases else None
        self.phrase_bias = model.phrases[1] if model.phrases else 0.0

    def values(self, words: list[str]) -> np.ndarray:
        """Decisions of words of at most PART * 3 / 2 letters."""
        if not words:
            return np.zeros(0)
        flat = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "replace"),
                             np.uint32)
        code = self.weights.codes(flat)
        lengths = np.array([len(w) + 2 for w in words])
        ends = np.cumsum(lengths)
        end = np.repeat(ends, lengths)
        at = np.arange(len(flat))
        total = np.zeros(len(flat), np.float32)
        for j, k in _PAIRS:
            n = len(flat) - k
            if n <= 0:
                continue
            u = self.weights.key(code[:n], code[j:j + n], code[k:])
            total[:n] += self.weights.look(u) * np.float32(DECAY ** (k - 2)) * (at[:n] + k < end[:n])
        return self.bias + np.add.reduceat(total, ends - lengths) / self.norms[lengths]

    def learn(self, tokens: set[str]) -> None:
        """Make sure that all the tokens are known."""
        if len(self.known) > MEMORY:
            self.known.clear()
        new = [t for t in tokens if t not in self.known]
        pieces = [parts(t) for t in new]
        values = iter(self.values([p for ps in pieces for p in ps]).tolist())
        for token, ps in zip(new, pieces):
            self.known[token] = max((next(values) for _ in ps), default=self.bias)

    def decide(self, texts: list[str | None]) -> list[float]:
        """For each text the largest decision of its sentences, that of the most telling word."""
        out: list[float] = []
        for low in range(0, len(texts), 256):
            split = [words_of(t or "") for t in texts[low:low + 256]]
            self.learn(set().union(*split))
            look = self.known.__getitem__
            out += [max(map(look, tokens)) if tokens else self.bias for tokens in split]
        return out

    def windows(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """For each text the largest decision of all its windows of two to GRAMS words, and the window."""
        out: list[tuple[float, str]] = []
        for text in texts:
            s = f" {normal(text or '')} "
            points = np.frombuffer(s.encode("utf-32-le", "replace"), np.uint32)
            blank = np.flatnonzero(points == 32)
            best = (self.phrase_bias, "")
            if len(blank) > 2:
                code, n = self.phrases.codes(points), len(points)
                sums = {k: np.zeros(n + 1) for k in range(2, SPAN)}
                for j, k in _PAIRS:
                    if n > k:
                        u = self.phrases.key(code[:n - k], code[j:j + n - k], code[k:])
                        sums[k][1:n - k + 1] += self.phrases.look(u) * DECAY ** (k - 2)
                for total in sums.values():
                    np.cumsum(total, out=total)
                for words in range(2, min(GRAMS, len(blank) - 1) + 1):
                    low, high = blank[:-words], blank[words:] + 1
                    value, norm = np.zeros(len(low)), np.zeros(len(low))
                    for k, total in sums.items():
                        value += total[high - k] - total[low]
                        norm += (k - 1) * DECAY ** (2 * (k - 2)) * (high - low - k)
                    value = self.phrase_bias + value / np.sqrt(norm)
                    at = int(value.argmax())
                    if value[at] > best[0] or not best[1]:
                        best = float(value[at]), s[low[at] + 1:high[at] - 1]
            out.append(best)
        return out

    def evidence(self, texts: list[str | None]) -> np.ndarray:
        """For each text the largest decision of its words and, if there is a machine, of its windows."""
        found = [self.decide(texts)]
        if self.phrases:
            found.append([value for value, _ in self.windows(texts)])
        return np.clip(np.array(found, float).T.reshape(len(texts), len(found)), -3, 3)


def _sum(words: str) -> int:
    return zlib.crc32(words.encode("utf-8", "replace"))


def _copies(texts: list[str]) -> list[int]:
    """A number per text, the same for texts whose five-word strings are nearly the same."""
    first: dict[tuple, int] = {}
    out = []
    for number, text in enumerate(texts):
        words = text.lower().split()
        own = {_sum(" ".join(words[i:i + 5]))
               for i in range(max(1, len(words) - 4))}
        least = [min((h ^ seed) * 0x9E3779B97F4A7C15 & _MASK for h in own) for seed in _SEEDS]
        names = [(k, least[k], least[k + 1]) for k in range(0, len(least), 2)]
        group = min((first[n] for n in names if n in first), default=number)
        for n in names:
            first.setdefault(n, group)
        out.append(group)
    return out


def _grams(text: str) -> tuple[set[str], set[str]]:
    """The scored parts of the words of a text, and its windows of two to GRAMS words."""
    cores = normal(text).split()
    return ({p for t in words_of(text) for p in parts(t) if len(p) > 2},
            {" ".join(cores[i:i + n]) for n in range(2, GRAMS + 1)
             for i in range(len(cores) - n + 1)})


def _excess(hits: np.ndarray, texts: int, rate: np.ndarray) -> np.ndarray:
    """By how much (in logarithms) so many hits in so many texts are more than a rate explains."""
    mean = np.maximum(texts * rate, 1e-12)
    return np.where(hits > mean, hits * np.log(np.maximum(hits, 1) / mean) - hits + mean, 0.0)


def _witnesses(texts: list[tuple[str, int]]) -> tuple[list[str], list[str], list[str]]:
    """Words and phrases that toxic texts owe their label to; words of clean ones, commonest first.

    Telling is what is in more toxic texts than its rate in clean texts explains. What is telling in all
    toxic texts is taken first. Then, over and over, what is most telling in the toxic texts that hold
    nothing of what was taken: there a rare insult stands out, be it a word or a phrase of words that are
    ordinary alone. Texts that are nearly the same count once.
    """
    toxic = [t for t, y in texts if y]
    number: dict[int, int] = {}
    groups = [number.setdefault(g, len(number)) for g in _copies(toxic)]
    # most windows occur in one text: by a checksum first, so that they aren't all held
    sums = np.concatenate([np.zeros(0, np.uint32), *(
        np.unique(np.array([_sum(g) for found in _grams(t) for g in found], np.uint32))
        for t in toxic)])
    sums, times = np.unique(sums, return_counts=True)
    several = set(sums[times > 1].tolist())
    held: dict[str, set[int]] = {}
    for text, group in zip(toxic, groups):
        for found in _grams(text):
            for gram in found:
                if _sum(gram) in several:
                    held.setdefault(gram, set()).add(group)
    held = {g: at for g, at in held.items() if len(at) > 1}
    names = sorted(held)
    clean, words = Counter(), Counter()
    others = [t for t, y in texts if not y]
    for text in others:
        own, phrases = _grams(text)
        words.update({p for t in words_of(text) for p in parts(t)})
        clean.update(g for g in own | phrases if g in held)
    rate = (np.array([clean[g] for g in names], float) + 0.5) / (len(others) + 1)
    hits = np.array([len(held[g]) for g in names], float)
    size = np.array([g.count(" ") + 1 for g in names])
    n = max(1, len(number))
    least = np.log(max(2, len(names))) + 2
    open_ = np.ones(len(number), bool)
    in_group: list[list[int]] = [[] for _ in number]
    for k, g in enumerate(names):
        for group in held[g]:
            in_group[group].append(k)
    taken: list[int] = []

    def take(k: int) -> None:
        taken.append(k)
        for group in held[names[k]]:
            if open_[group]:
                open_[group] = False
                left[in_group[group]] -= 1

    left = hits.copy()
    strong = (_excess(hits, n, rate) >= least) & (hits / n > 20 * rate)
    for k in np.flatnonzero(strong & (size == 1)):
        take(int(k))
    while open_.any() and len(taken) < WITNESSES:
        count = int(open_.sum())
        excess = _excess(left, count, rate)
        excess[(left < 2) | (left / count <= 3 * rate)] = 0
        best = int(np.lexsort((-size, size > 1, -excess))[0]) if len(excess) else 0
        if not len(excess) or excess[best] < np.log(max(2, int((left > 1).sum()))) + 2:
            break
        take(best)
    order = sorted(taken, key=lambda k: (-hits[k], names[k]))
    return ([names[k] for k in order if size[k] == 1], [names[k] for k in order if size[k] > 1],
            sorted(words, key=lambda w: (-words[w], w)))


def _evenly(items: list[str], most: int) -> list[str]:
    return items[::max(1, -(-len(items) // most))]


def _machine(positive: list[str], negative: list[str]) -> tuple[dict[str, float], float]:
    """Landmarks, Nyström map, squared-hinge machine; folded into weights per subsequence."""
    marks = list(dict.fromkeys([*_evenly(positive, LANDMARKS // 2),
                                *_evenly(negative, LANDMARKS // 2)]))
    words = positive + negative
    index: dict[str, int] = {}
    vectors = [phi(w) for w in words]
    mark_vectors = [phi(w) for w in marks]
    for v in mark_vectors:
        for u in v:
            index.setdefault(u, len(index))
    basis = np.zeros((len(marks), len(index)))
    for row, v in enumerate(mark_vectors):
        for u, x in v.items():
            basis[row, index[u]] = x
    values, axes = np.linalg.eigh(basis @ basis.T)
    keep = values > 1e-6
    root = axes[:, keep] / np.sqrt(values[keep])
    kernel = np.zeros((len(words), len(marks)))
    for row, v in enumerate(vectors):
        hit = [(index[u], x) for u, x in v.items() if u in index]
        if hit:
            at, x = zip(*hit)
            kernel[row] = basis[:, at] @ np.array(x)
    z = np.c_[kernel @ root, np.ones(len(words))]
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    cost = np.where(y > 0, COST / len(positive), COST / len(negative))
    w = np.zeros(z.shape[1])
    for _ in range(50):  # Newton steps on the points inside the margin
        inside = y * (z @ w) < 1
        zi = z[inside]
        left = (zi.T * cost[inside]) @ zi + np.diag([1.0] * (len(w) - 1) + [1e-6])
        new = np.linalg.solve(left, zi.T @ (cost[inside] * y[inside]))
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    beta = (root @ w[:-1]) @ basis
    return {u: float(beta[k]) for u, k in index.items()}, float(w[-1])


def _phrase_machine(positive: list[str], clean: list[str]) -> tuple[dict[str, float], float]:
    """A machine that tells windows of several words from all windows of clean texts.

    Against an even share of them first, then also against those that it took for toxic.
    """
    some = dict.fromkeys(w for t in _evenly(clean, 500) for w in _evenly(sorted(_grams(t)[1]), 8))
    hard: dict[str, None] = {}
    own = set(positive)
    for turn in range(PHRASE_TURNS):
        found = _machine(positive, [w for w in [*hard, *some] if w not in own])
        if turn < PHRASE_TURNS - 1:
            machine = Machine(Model({}, 0.0, (0.0, 0.0), phrases=found))
            worst = sorted(((v, w) for v, w in set(machine.windows(clean)) if w and v > -1),
                           key=lambda x: (-x[0], x[1]))
            hard.update(dict.fromkeys(w for _, w in worst[:NEGATIVES // PHRASE_TURNS]))
    return found


def learn(docs: DataFrame, labels: DataFrame, label: str, train) -> Model:
    """Machines on telling words and windows, then a logistic fit of the texts' largest decisions."""
    prior = share_of_ones(labels, label, train)
    sample = labelled_sample(docs, labels, label, train, PER_CLASS, LONGEST)
    positive, phrases, negative = _witnesses(sample)
    chosen = set(positive)
    negative = [w for w in negative if w not in chosen]
    clean = [t for t, y in sample if not y]
    if not (positive or phrases) or not negative:
        return Model({}, 0.0, (0.0, 0.0), 0.0 if prior is None else prior)
    weights, bias = _word_machine(positive, negative) if positive else ({}, -1.0)
    model = Model(weights, bias, (), phrases=_phrase_machine(phrases, clean) if phrases else None)
    x = Machine(model).evidence([t for t, _ in sample])
    slope = logistic(x, np.array([y for _, y in sample]), prior)
    return replace(model, slope=tuple(map(float, slope)))


def _word_machine(positive: list[str], negative: list[str]) -> tuple[dict[str, float], float]:
    # the commonest clean words and an even share of the rest; then those too that it takes for toxic
    start = list(dict.fromkeys(negative[:NEGATIVES // 2] + _evenly(negative, NEGATIVES // 2)))
    weights, bias = _machine(positive, start)
    machine = Machine(Model(weights, bias, (0.0, 0.0)))
    taken = dict(zip(negative, machine.values(negative).tolist()))
    hard = sorted(negative, key=lambda w: (-taken[w], w))[:NEGATIVES // 2]
    return _machine(positive, list(dict.fromkeys(hard + start)))


def sentence_scores(text: str | None, machine: Machine) -> list[tuple[str, float]]:
    """The sentences of a text and the decision of each."""
    found = [s.strip() for s in _SENTENCE.split(text or "") if s.strip()]
    return list(zip(found, machine.evidence(found).max(axis=1).tolist())) if found else []


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4,
                    held: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from rows whose crc32(doc_id) mod 4 isn't 2.

    What counts is the largest decision of a text's words and that of its windows of two to four
    words, over the whole text. Null and empty texts get
    the score of no evidence; equal texts equal scores. Without labels of both kinds the score is
    the share of label 1 (0 without labels). Only doc_id and text are read, whatever other columns
    exist. The model (one weight per subsequence of the landmarks) goes to the tasks.
    """
    def train(c):
        return (remainder(c, modulus) != held) & F.col(c).isNotNull()

    model = learn(docs, labels, "toxic", train)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        machine = Machine(model)
        for batch in batches:
            if model.fixed is None:
                x = machine.evidence(batch.column(1).to_pylist())
                z = x @ np.array(model.slope[:-1]) + model.slope[-1]
                values = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            else:
                values = np.full(batch.num_rows, model.fixed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())],
                                             names=["doc_id", "score"])

    scored = rows.mapInArrow(score, f"doc_id {kind}, score double")
    return scored.select("doc_id", (remainder("doc_id", modulus) == held).alias("held_out"),
                         "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
