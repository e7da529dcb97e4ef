import random

import pytest

import corpus_pipeline
from isograd.llm import decontaminate, neardup
from tests.llm import test_decontaminate, test_neardup, test_suffixes
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, docs_of, odd, tmp_path_factory):
    """Tables with planted cases."""
    rng = random.Random(12)
    rows, labels = [], []
    shared = prose(5000, 70)
    items = [(k, prose(7000 + k, 30)) for k in range(4)]
    for doc in range(300):
        words = prose(200 + doc, rng.randint(60, 200)).split()
        good = int(rng.random() > 0.25)
        if doc % 10 == 3:
            words += shared.split()
        if doc % 25 == 4:
            words += items[doc % 4][1].split()
        text = " ".join(words if good else [w.upper() + "$$$" for w in words])
        rows.append((doc, text, f"s{doc % 4}"))
        if doc % 2:
            labels.append((doc, good, 0))
    rows += [(400 + k, rows[k * 7][1] + " end", "s1") for k in range(20)]
    rows += [((r[0] or 0) + 1000 if r[0] else None, *r[1:]) for r in odd]
    path = tmp_path_factory.mktemp("tables")
    docs_of(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(
        f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_each_stage_against_brute_force(spark, folder, tmp_path):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, path).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        outs.append([tuple(r) for r in docs.collect()])
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]

    def plain(found):
        return [(r[0], r[1], r[3]) for r in found]

    scored = plain(outs[0])
    assert {(r[0], r[1]) for r in scored} <= {(r[0], r[1]) for r in rows}
    bad = [r for r in scored if "$$$" in (r[1] or "")]
    assert len(bad) <= 8 and sum(1 for r in scored if r[0] is not None and r[0] < 300) > 200
    # near duplicates: the smallest of each group, repeated rows once
    label = test_neardup.brute(scored, neardup.Similar())
    want = {(r[0], r[1]) for r in scored if r[0] is not None and label[r[0]] == r[0]}
    got = [(r[0], r[1]) for r in plain(outs[1])]
    assert sorted(map(str, (r for r in got if r[0] is not None))) == sorted(map(str, want))
    assert sum(r[0] is None for r in got) == sum(r[0] is None for r in scored)
    # repeats
    brute = {r[0]: r[2] for r in test_suffixes.brute(
        [r for r in outs[1] if r[0] is not None], corpus_pipeline.REPEAT)}
    before = {r[0]: r for r in outs[1] if r[0] is not None}
    for r in outs[2]:
        if r[0] is not None:
            lost = len((before[r[0]][1] or "").encode()) - len((r[1] or "").encode())
            assert brute[r[0]] - 6 <= lost <= brute[r[0]]
            assert r[4] == (len(r[1]) if lost else before[r[0]][4])
    shared = prose(5000, 70)
    assert sum(shared in (r[1] or "") for r in outs[2]) == 1
    # benchmark passages
    dirty = {x[0] for x in test_decontaminate.brute(
        [(k, r[1]) for k, r in enumerate(outs[2]) if len(r[1] or "") < 9000], items)}
    assert sorted(map(str, outs[3])) == sorted(str(r) for k, r in enumerate(outs[2]) if k not in dirty)
    assert dirty
    # the mix
    assert set(docs.columns) >= {"doc_id", "text", "turn", "position"}
    assert {(r[0], r[1]) for r in outs[4]} <= {(r[0], r[1]) for r in outs[3]}
    run = [tuple(r) for r in corpus_pipeline.run(spark, path).collect()]
    assert sorted(map(str, run)) == sorted(map(str, outs[4]))


def test_empty_tables(spark, docs_of, tmp_path):
    docs_of([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_with_other_names(spark, docs_of, folder):
    path, rows, _ = folder
    docs = docs_of(rows[:60] + rows[-21:], clash=True)
    for _, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, path)
        assert set(out.columns) == set(docs.columns)
        out.count()
    assert corpus_pipeline.mixing_stage(spark, docs, path).count() > 0
    assert decontaminate.SHORTEST == 5


def test_repeats_of_very_short_words(docs_of, spark):
    passage = " ".join("abcdefghijklm"[k * k % 13] for k in range(51))
    docs = docs_of([(1, prose(1, 40) + passage + prose(2, 40)), (2, prose(3, 40) + passage + prose(4, 40))])
    kept = {r.doc_id: r.text for r in corpus_pipeline.repeat_stage(spark, docs, "").collect()}
    assert passage in kept[1] and passage not in kept[2]
