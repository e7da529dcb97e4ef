import random

import duckdb
import pandas as pd

from isograd.llm import licenses
from tests.llm.conftest import prose


def check(docs_of, rows, templates=licenses.TEMPLATES, **more):
    got = licenses.scan(docs_of(rows, **more), templates).collect()
    documents = pd.DataFrame([(r[0], r[1]) for r in rows], columns=["doc_id", "text"])
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con = duckdb.connect()
    con.register("documents", documents)
    want = con.execute(licenses.brute_sql(templates)).fetchall()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    return got


def test_planted(docs_of):
    rng = random.Random(6)
    rows = []
    for k in range(120):
        words = prose(k, rng.randint(5, 200)).split()
        for _ in range(rng.randint(0, 3)):
            notice = rng.choice(list(licenses.TEMPLATES.values())).split()
            if rng.random() < 0.4:
                notice[rng.randrange(len(notice))] = "changed"
            if rng.random() < 0.3:
                notice.insert(rng.randrange(len(notice)), "added")
            at = rng.randint(0, len(words))
            words[at:at] = [w.upper() for w in notice] if rng.random() < 0.2 else notice
        rows.append((k, " ".join(words)))
    got = check(docs_of, rows, clash=True)
    assert len({r.license for r in got}) == len(licenses.TEMPLATES)


def test_odd_rows(docs_of, odd):
    rows = [*odd, (40, licenses.TEMPLATES["mit"]), (40, licenses.TEMPLATES["mit"]),
            (41, "x " * 5000 + licenses.TEMPLATES["gpl-3.0"] + " y" * 20000)]
    got = check(docs_of, rows)
    assert {(r.doc_id, r.license) for r in got} == {(40, "mit"), (41, "gpl-3.0")}
    assert licenses.scan(docs_of([])).count() == 0


def test_no_match_without_a_needed_word():
    needed = licenses.needed_words(licenses.TEMPLATES)
    for text in licenses.TEMPLATES.values():
        words = licenses.template_words(text)
        shingles = licenses._shingles(words)
        free = [s for s in shingles if not set(s) & set(needed)]
        assert len(free) < licenses._least(len(shingles))


def test_whole_licences_partly_reworded(docs_of):
    """Bodies without their first sentence, with other holders, and with every 40th word changed."""
    rows = []
    for k, (name, text) in enumerate(sorted(licenses.TEMPLATES.items())):
        words = text.split()
        if len(words) < 100:
            continue
        changed = [w if i % 40 else "otherwise" for i, w in enumerate(words)]
        first = next(i for i, w in enumerate(words) if w[-1] in ".:") + 1
        cut = words[min(first, len(words) // 6):]
        for j, body in enumerate((words, changed, cut, words[len(words) // 2:])):
            rows.append((10 * k + j, prose(k, 60) + " " + " ".join(body) + " " + prose(k + j, 60), name))
    got = {(r.doc_id, r.license) for r in check(docs_of, [r[:2] for r in rows])}
    for doc_id, _, name in rows:
        assert ((doc_id, name) in got) == (doc_id % 10 < 3), (doc_id, name)


def test_templates_from_a_table(spark, docs_of):
    body = prose(77, 400)
    table = spark.createDataFrame([("own-1.0", body, 1), ("own-1.0", body, 1), ("own-1.0", prose(78, 300), 2),
                                   ("short", "two words", 3), (None, body, 4), ("none", None, 5)],
                                  "license string, text string, more int")
    templates = licenses.read_templates(table)
    assert sorted(templates) == ["own-1.0", "own-1.0#2"] and body in templates.values()
    words = body.split()
    words[100:110] = ["instead"]
    got = check(docs_of, [(1, prose(5, 50) + " " + " ".join(words)), (2, prose(6, 900))], templates)
    assert {r.doc_id for r in got} == {1}
