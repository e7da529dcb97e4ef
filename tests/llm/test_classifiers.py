import random
import zlib

import numpy as np
import pytest

from isograd.llm import quality, toxicity
from tests.llm.conftest import prose

LABELS = "doc_id long, quality int, toxic int"


def auc(rows):
    scores = sorted((s, y) for s, y in rows)
    order = np.array([y for _, y in scores])
    ones = order.sum()
    return (np.flatnonzero(order).sum() - ones * (ones - 1) / 2) / (ones * (len(order) - ones))


@pytest.fixture(scope="module")
def corpus(docs_of, spark):
    rng = random.Random(3)
    rows, labels = [], []
    for doc in range(400):
        words = prose(1000 + doc, rng.randint(20, 300)).split()
        good, toxic = int(rng.random() > 0.3), int(rng.random() < 0.3)
        if not good:
            words = [w.upper() + "!!" for w in words]
        if toxic:
            for _ in range(3):
                insult = rng.choice(["grumbolt", "snarkwit", "blorphead"])
                at = rng.randrange(len(insult))
                words.insert(rng.randrange(len(words)), insult[:at] + rng.choice(["", "", "*", "-"])
                             + insult[at:])
        rows.append((doc, " ".join(words)))
        labels.append((doc, good, toxic))
    return docs_of(rows, clash=True), spark.createDataFrame(labels, LABELS), labels


def test_quality_on_held_out(corpus):
    docs, labels, known = corpus
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == len(known)
    truth = {d: q for d, q, _ in known}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert auc([(r.score, truth[r.doc_id]) for r in rows if r.held_out]) > 0.97


def test_toxicity_on_held_out(corpus):
    docs, labels, known = corpus
    rows = toxicity.toxicity_scores(docs, labels).collect()
    assert len(rows) == len(known)
    truth = {d: t for d, _, t in known}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    assert auc([(r.score, truth[r.doc_id]) for r in rows if r.held_out]) > 0.97


def test_accepted_keeps_columns_and_good_texts(corpus):
    docs, labels, known = corpus
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    good = {d for d, q, _ in known if q}
    assert len(good - ids) <= 0.03 * len(good) and len(ids - good) <= 0.2 * (len(known) - len(good))


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_odd_rows(docs_of, spark, odd, corpus, score):
    docs = corpus[0].unionByName(docs_of([((r[0] or 0) + 5000, *r[1:]) for r in odd], clash=True))
    docs = docs.unionByName(docs_of([(None, "word"), (None, None)], clash=True))
    rows = score(docs, corpus[1]).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, set()).add(r.score)
    assert by_id[5001] == by_id[5002] and by_id[5006] == by_id[5007]
    assert all(r.held_out is False for r in rows if r.doc_id is None)


@pytest.mark.parametrize("score,label,expected", [
    (quality.quality_scores, None, 0.5), (toxicity.toxicity_scores, None, 0.0),
    (quality.quality_scores, 1, 1.0), (toxicity.toxicity_scores, 0, 0.0)])
def test_without_both_labels(docs_of, spark, odd, score, label, expected):
    labels = spark.createDataFrame(
        [] if label is None else [(d, label, label) for d in range(1, 18)], LABELS)
    rows = score(docs_of(odd), labels).collect()
    assert len(rows) == len(odd) and {r.score for r in rows} == {expected}
    assert score(docs_of([]), labels).count() == 0


def test_gapped_and_inserted_letters():
    positive = ["grumbolt", "snarkwit"]
    negative = sorted(set(prose(1, 3000).split()))
    weights, bias = toxicity._machine(positive, negative)
    machine = toxicity.Machine(toxicity.Model(weights, bias, (0.0, 0.0)))
    odd = machine.decide(["a grum-bolt here", "gru*mbolt", "g r u m b o l t", "grumbbolt", "Snark.wit"])
    assert min(odd) > max(machine.decide([" ".join(negative)]))
    assert machine.decide([None, ""]) == [bias, bias]
    sentences = toxicity.sentence_scores("An the. You grumbolt! Tion.", machine)
    assert max(sentences, key=lambda s: s[1])[0] == "You grumbolt"


def test_letters_of_every_script():
    word = "".join(map(chr, range(0x4E00, 0x4E00 + 3000)))
    for weights in ({"^バカ": 1.0, "^カワ": -1.0, "😡😡😡": 2.0},
                    {word[i:i + 3]: float(i + 1) for i in range(len(word) - 2)}):
        look = toxicity.Machine(toxicity.Model(weights, 0.0, (0.0, 0.0))).weights
        points = np.array([[ord(c) for c in u] for u in [*weights, "^ヌヌ", "一丂𠀀"]])
        a, b, c = (look.codes(points[:, k].astype(np.uint32)) for k in range(3))
        assert look.look(look.key(a, b, c)).tolist() == [*weights.values(), 0.0, 0.0]


def test_words_of_scripts_beyond_latin():
    clean = ["ありがとう", "こんにちは", "たのしい", "谢谢你们", "今天天气"]
    weights, bias = toxicity._machine(["ばかやろう", "王八蛋", "🤬🤬🤬"], clean)
    machine = toxicity.Machine(toxicity.Model(weights, bias, (0.0, 0.0)))
    assert min(machine.decide(["ばかやろう", "王八蛋", "🤬🤬🤬"])) > max(machine.decide(clean)) + 1


def test_phrases_of_clean_words_and_rare_insults():
    rng = random.Random(8)
    ordinary = sorted(set(prose(9, 400).split()))[:150]
    phrase = ordinary[20:23]
    rare = [f"{a}{b}" for a in ("quaz", "wump", "jolk", "vrix") for b in ("ling", "mort", "bag")]

    def text(toxic, kind):
        words = [rng.choice(ordinary) for _ in range(60)] + phrase[::-1]
        rng.shuffle(words)
        at = rng.randrange(len(words))
        if toxic:
            words[at:at] = phrase if kind == "phrase" else [kind]
        return " ".join(words)

    sample = [(text(0, ""), 0) for _ in range(300)]
    sample += [(text(1, "phrase"), 1) for _ in range(150)]
    sample += [(text(1, "grumbolt"), 1) for _ in range(120)]
    sample += [(text(1, r), 1) for r in rare for _ in range(3)]
    words, phrases, _ = toxicity._witnesses(sample)
    assert set(rare) <= set(words) and "grumbolt" in words and " ".join(phrase) in phrases
    assert not set(words) & set(ordinary)
    found = toxicity._phrase_machine(phrases, [t for t, y in sample if not y])
    machine = toxicity.Machine(toxicity.Model({}, 0.0, (0.0, 0.0), phrases=found))
    new = [(text(y, "phrase"), y) for y in (0, 1) for _ in range(100)]
    assert auc(list(zip([v for v, _ in machine.windows([t for t, _ in new])],
                        [y for _, y in new]))) > 0.97
    window = machine.windows(["a b c", None, "word", " ".join(phrase)])
    assert window[1] == window[2] == (found[1], "") and window[3][0] > 0
    vector = toxicity.phi(" ".join(phrase))
    assert window[3][0] >= found[1] + sum(found[0].get(u, 0) * x for u, x in vector.items()) - 1e-5
