import itertools
import random

from isograd.llm import decontaminate as d
from tests.llm.conftest import prose

ITEMS = "item_id long, text string, extra string"


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()


def brute(rows, items):
    best = {}
    for doc, text, *_ in rows:
        if doc is None:
            continue
        words = fold(text)
        for item_id, item, *_ in items:
            own = fold(item)
            if item_id is None or len(own) < d.SHORTEST:
                continue
            size = min(d.STRETCH, len(own))
            need = size - d.DIFFER if len(own) >= d.STRETCH else size
            for shift in range(-len(own), len(words)):
                a, b = max(0, shift), min(len(words), shift + len(own))
                same = [words[k] == own[k - shift] for k in range(a, b)]
                mask = [False] * len(same)
                for g in range(len(same) - size + 1):
                    if sum(same[g:g + size]) >= need:
                        mask[g:g + size] = [True] * size
                for key, group in itertools.groupby(range(len(same)), key=mask.__getitem__):
                    inner = [k for k in group if same[k]] if key else []
                    if inner:
                        found = (sum(same[inner[0]:inner[-1] + 1]), -(a + inner[0]),
                                 -(a + inner[-1] + 1))
                        best[doc, item_id] = max(best.get((doc, item_id), found), found)
    return sorted((doc, item, n, -start, -end) for (doc, item), (n, start, end) in best.items())


def test_masks_hit_every_pair_of_substitutions():
    for pair in itertools.combinations(range(d.STRETCH), d.DIFFER):
        assert any(all(at + j not in pair for j, c in enumerate(mask) if c == "#")
                   for mask in d.MASKS for at in range(d.STRETCH - len(mask) + 1))


def run(spark, docs_of, rows, items, **more):
    got = d.overlaps(docs_of(rows, **more), spark.createDataFrame(
        [(*i, "x") for i in items], ITEMS)).collect()
    return sorted(tuple(r) for r in got)


def test_planted(spark, docs_of):
    rng = random.Random(8)
    items = [(k, prose(900 + k, rng.choice([4, 6, 11, 13, 20, 40]))) for k in range(25)]
    items += [(30, None), (31, ""), (None, prose(900, 20)), (32, items[3][1]), (33, "the " * 20)]
    rows = []
    for k in range(60):
        words = prose(k, rng.randint(0, 80)).split()
        for _ in range(rng.randint(0, 2)):
            own = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = rng.choice(["swap", own[0].upper()])
            cut = rng.randint(0, 5)
            at = rng.randint(0, len(words))
            words[at:at] = own[cut:] if rng.random() < 0.5 else own
        rows.append((k, " ".join(words)))
    rows.append((70, "the " * 30))
    want = brute(rows, items)
    assert len(want) > 20 and run(spark, docs_of, rows, items, clash=True) == want


def test_odd_rows(spark, docs_of, odd):
    items = [(1, odd[5][1][:200]), (2, "word"), (3, None)]
    rows = odd[:9] + odd[11:]
    assert run(spark, docs_of, rows, items) == brute(rows, items)
    assert run(spark, docs_of, [], items) == [] == run(spark, docs_of, odd, [])


def test_clean(spark, docs_of, odd):
    items = spark.createDataFrame([(1, odd[5][1][:200], "x")], ITEMS)
    df = docs_of(odd, clash=True)
    out = d.clean(df, items)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(
        str(r[0]) for r in odd if odd[5][1][:200].lower() not in (r[1] or "").lower())
