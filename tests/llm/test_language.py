import random
import zlib
from collections import Counter

import pytest

from isograd.llm import language
from tests.llm.conftest import prose

SYLLABLES = {"aa": ["ka", "lo", "mi", "ne", "tu", "sha"], "bb": ["gro", "und", "ein", "sch", "ack", "ü"],
             "cc": ["ци", "ра", "но", "ве", "ка", "ми"], "dd": ["さ", "くら", "の", "はな", "み"]}


def text_in(lang: str, seed, words: int) -> str:
    rng = random.Random(f"{lang}{seed}")
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 4))) for _ in range(words))


def grams(text):
    """All n-grams of the words of a text, by plain Python."""
    found = Counter()
    spaced = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    for word in spaced.split():
        padded = f" {word} "
        for n in range(1, language.LONGEST_GRAM + 1):
            for i in range(len(padded) - n + 1):
                if padded[i:i + n].strip():
                    # a blank between two words is one blank: it belongs to either n-gram
                    found[padded[i:i + n]] += 1
    return found


def brute(text, profiles):
    """(lang, score) from lists of n-grams by lang."""
    own = grams(text)
    if not own or not profiles:
        return "und", 0.0
    best = {}
    for listed in profiles.values():
        for place, gram in enumerate(listed):
            best[gram] = min(place, best.get(gram, place))
    order = sorted(own, key=lambda g: (-own[g], best.get(g, language.PLACES), language.key_of(g)))
    order = order[:language.PLACES]
    total = {}
    for lang, listed in profiles.items():
        place_of = {g: i for i, g in enumerate(listed)}
        total[lang] = sum(abs(i - place_of[g]) if g in place_of else language.PLACES
                          for i, g in enumerate(order))
    first, *others = sorted(total, key=lambda x: (total[x], x))
    second = min([total[x] for x in others] + [len(order) * language.PLACES])
    return first, 1 - total[first] / max(second, 1)


@pytest.fixture(scope="module")
def corpus(docs_of, spark):
    rows = [(doc, text_in(lang, doc, random.Random(doc).randint(3, 200)), lang)
            for doc in range(400) for lang in [random.Random(doc + 7).choice("aa bb bb bb cc dd".split())]]
    df = docs_of([(d, t) for d, t, _ in rows], clash=True).drop("lang").join(
        spark.createDataFrame([(d, g if d % 17 else None) for d, _, g in rows],
                              "doc_id long, lang string"), "doc_id")
    return df.withColumn("lang_pred", df.source), rows


def test_profiles_count_every_ngram(corpus, spark):
    df, rows = corpus
    got = language.language_profiles(df, per_language=10_000).collect()
    for lang in SYLLABLES:
        total = Counter()
        for text in {t for d, t, of in rows if of == lang and d % 17}:
            total += grams(text)
        want = sorted(total.items(), key=lambda x: (-x[1], x[0].encode()))[:language.PLACES]
        assert [(r.gram, r.n) for r in sorted(got, key=lambda r: r.place) if r.lang == lang] == want


def test_against_brute_force(corpus):
    df, rows = corpus
    found = language.language_profiles(df)
    model = language.learned(found)
    lists = {}
    for r in sorted(found.collect(), key=lambda r: r.place):
        lists.setdefault(r.lang, []).append(r.gram)
    texts = [t for _, t, _ in rows[:150]] + ["", None, "1 2 3", "ka", "X", "Äü! ka-lo", prose(3, 50),
                                             "İstanbul ǅ", "a" * 3000, "さ 1 ka"]
    names, scores = language.nearest(texts, model)
    for text, name, score in zip(texts, names, scores):
        want = brute(text, lists)
        assert name == want[0] and score == pytest.approx(want[1]), text


def test_held_out(corpus):
    df, rows = corpus
    truth = {d: lang for d, _, lang in rows}
    got = language.language_predictions(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert len(held) > 50 and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_odd_rows(corpus, docs_of, odd):
    model = language.learned(language.language_profiles(corpus[0]))
    docs = docs_of(odd, clash=True)
    out = language.with_language(docs, model)
    rows = out.collect()
    assert len(rows) == len(odd) and set(docs.columns) <= set(out.columns)
    for r in rows:
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or ""))
        assert 0 <= r.score <= 1 and (r.lang_pred != "und" or r.score == 0)
    assert {r.lang_pred for r in language.with_language(docs_of([(1, "words")]), language.learned(
        language.language_profiles(docs.where("false")))).collect()} == {"und"}
    assert language.language_predictions(docs.where("false")).count() == 0


def test_copies_count_once(docs_of, spark):
    one, other = text_in("aa", 1, 300), text_in("aa", 2, 300)
    rows = spark.createDataFrame([("aa", one)] * 500 + [("aa", other), (None, one), ("aa", None)],
                                 "lang string, text string")
    got = {r.gram: r.n for r in language.language_profiles(rows).collect()}
    want = grams(one) + grams(other)
    assert all(want[g] == n for g, n in got.items()) and len(got) == min(len(want), language.PLACES)


def test_sample_is_bounded(spark):
    rows = spark.createDataFrame([("aa", text_in("aa", i, 20)) for i in range(3000)],
                                 "lang string, text string")
    few = language.language_profiles(rows, per_language=300)
    words = few.where("gram = ' '").count()
    assert words == 0
    full = sum(grams(text_in("aa", i, 20)).total() for i in range(3000))
    assert 0.05 * full < few.agg({"n": "sum"}).first()[0] < 0.15 * full
