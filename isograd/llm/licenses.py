"""License scans: MinHash bands of overlapping word windows retrieve templates, shingles verify them.

For each template length there are windows of a few words more, so that every place a template can
start at is in some window whole. A window's and a template's minimum hashes are joined; as many are
taken as make a miss of a true match less likely than one in a million. Candidates are then confirmed
by counting the template's shingles in the window. Only DataFrame expressions are used.

Texts that can hold no match are left out first: of each template there are words without which more
shingles are lost than a match may lack, so a text without any such word has no match.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isograd.llm.notices import TEMPLATES

#: Words of a shingle, percent of a template's shingles that a window must hold, chance of a miss.
WORDS, PERCENT, MISS = 5, 80, 1e-6

#: Templates that a table may hold, and bytes of them that are sent to every task.
MOST, SENT = 5_000, 64 << 20


def read_templates(table: DataFrame) -> dict[str, str]:
    """Templates from a table (license, text), such as whole licences.

    Rows without a licence or with fewer than five words are left out; several texts of one licence, equal
    ones apart, get numbers. More than ``MOST`` rows fail: templates are parameters, not data.
    """
    rows = table.select("license", "text").where("license IS NOT NULL").distinct().limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} templates")
    found: dict[str, str] = {}
    seen: dict[str, int] = {}
    for name, text in sorted((r.license, r.text or "") for r in rows):
        if len(template_words(text)) >= WORDS:
            seen[name] = seen.get(name, 0) + 1
            found[name if seen[name] == 1 else f"{name}#{seen[name]}"] = text
    return found


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _shingles(words: list[str]) -> list[tuple[str, ...]]:
    return list(dict.fromkeys(tuple(words[i:i + WORDS]) for i in range(len(words) - WORDS + 1)))


def _least(count: int) -> int:
    """Shingles that a match holds, of so many."""
    return -(-PERCENT * count // 100)


def needed_words(templates: dict[str, str]) -> list[str]:
    """Words one of which is in every match of any template, long ones first."""
    found: set[str] = set()
    for text in templates.values():
        words = template_words(text)
        shingles = _shingles(words)
        left = [s for s in shingles if not found & set(s)]
        for word in sorted(set(words), key=lambda w: (-len(w), w)):
            if len(shingles) - len(left) > len(shingles) - _least(len(shingles)):
                break
            found.add(word)
            left = [s for s in left if word not in s]
    return sorted(found, key=lambda w: (-len(w), w))


def _class(length: int) -> tuple[int, int, int]:
    """(step, words of a window, minimum hashes) for templates of a length."""
    step = max(1, length // 8)
    window = length + step - 1
    count, most = length - WORDS + 1, window - WORDS + 1
    common = _least(count)
    similar = common / (most + count - common)
    hashes = 1 if similar >= 1 else math.ceil(math.log(MISS) / math.log(1 - similar))
    return step, window, hashes


def _hashed(words: Column) -> Column:
    """Hashes of the distinct shingles of a word array of at least five words."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (WORDS - 1)),
                                        lambda i: F.xxhash64(F.slice(words, i, WORDS))))


def _minimum(shingles: Column, seed: Column) -> Column:
    return F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, seed)))


def _table(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """license, length, hashes and shingles of each template: a table as small as the constant."""
    rows = [F.struct(F.lit(name).alias("license"),
                     F.array(*map(F.lit, template_words(text))).alias("words"))
            for name, text in sorted(templates.items())]
    return (docs.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("t"))
            .select("t.license", F.size("t.words").alias("length"),
                    _hashed(F.col("t.words")).alias("known")))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, matched, of_shingles, first_word: licenses found in each document.

    Words are runs of letters and digits in lower case; windows start at multiples of a step that
    depends on the template's length. matched counts the template's distinct shingles of five words in
    its best window, at least 80 percent of of_shingles; first_word is that window's first word, the
    earliest of equally good ones. Null, empty and short texts have none. Rows that share a doc_id (or
    have none) are reported together; other columns are not read. Templates need five words or more.
    """
    lengths = sorted({len(template_words(t)) for t in templates.values()})
    if not lengths or lengths[0] < WORDS:
        raise ValueError("templates of at least five words")
    needed = needed_words(templates)
    low = F.lower("text")
    able = F.lit(False)
    for word in needed:
        able = able | low.contains(word)
    kinds = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(
        ("length", "step", "window", "hashes"), (n, *_class(n))))) for n in lengths))
    words = F.split(F.trim(F.regexp_replace(low, r"[^\p{L}\p{Nd}]+", " ")), " ")
    texts = (docs.select("doc_id", "text").where(able)
             .select("doc_id", words.alias("words")).where(F.size("words") >= WORDS))
    windows = (texts.withColumn("kind", F.explode(kinds))
               .select("doc_id", "words", "kind.*")
               .withColumn("start", F.explode(F.sequence(F.lit(0), F.size("words") - WORDS,
                                                         F.col("step"))))
               .select("doc_id", "length", "hashes", "start",
                       F.slice("words", F.col("start") + 1, F.col("window")).alias("part"))
               .where(F.arrays_overlap("part", F.array(*map(F.lit, needed)))))
    windows = windows.select("doc_id", "length", "hashes", "start", _hashed(F.col("part")).alias("own"))

    def signed(rows: DataFrame, shingles: str, hashes: Column) -> DataFrame:
        rows = rows.withColumn("seed", F.explode(F.sequence(F.lit(1), hashes)))
        return rows.withColumn("least", _minimum(F.col(shingles), F.col("seed")))

    known = _table(docs, templates)
    count = F.element_at(F.map_from_arrays(F.array(*map(F.lit, lengths)),
                                           F.array(*(F.lit(_class(n)[2]) for n in lengths))),
                         F.col("length"))
    signatures = signed(known, "known", count)
    sizes = [len(template_words(t)) for t in templates.values()]
    if sum(8 * n * _class(n)[2] for n in sizes) <= SENT:
        signatures = F.broadcast(signatures)
    met = signed(windows, "own", F.col("hashes")).join(signatures, ["length", "seed", "least"])
    matched = F.size(F.array_intersect("own", "known"))
    found = (met.select("doc_id", "license", "start", matched.alias("matched"),
                        F.size("known").alias("of_shingles"))
             .where(100 * F.col("matched") >= PERCENT * F.col("of_shingles")))
    best = F.max(F.struct("matched", (-F.col("start")).alias("at"))).alias("best")
    return (found.groupBy("doc_id", "license", "of_shingles").agg(best)
            .select("doc_id", "license", F.col("best.matched").alias("matched"), "of_shingles",
                    (-F.col("best.at")).alias("first_word")))


def brute_sql(templates: dict[str, str] = TEMPLATES) -> str:
    """DuckDB SQL that counts every template's shingles in every window, without hashes."""
    rows = []
    for name, text in sorted(templates.items()):
        words = template_words(text)
        step, window, _ = _class(len(words))
        shingles = ", ".join("'" + " ".join(s) + "'" for s in _shingles(words))
        rows.append(f"('{name}', {step}, {window}, [{shingles}])")
    return rf"""
WITH t(license, step, width, known) AS (VALUES {", ".join(rows)}),
w AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g')),
             ' ') AS w FROM documents),
s AS (SELECT doc_id, unnest(range(1, len(w) - {WORDS - 2})) AS i, w FROM w WHERE len(w) >= {WORDS}),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i:i + {WORDS - 1}], ' ') AS g FROM s),
k AS (SELECT license, step, width, len(known) AS n, unnest(known) AS g FROM t),
h AS (SELECT doc_id, license, step, width, n, pos, g FROM g JOIN k USING (g)),
v AS (SELECT *, unnest(range(greatest(0, (pos - (width - {WORDS}) + step - 1) // step),
                             pos // step + 1)) * step AS start FROM h),
c AS (SELECT doc_id, license, n, start, count(DISTINCT g) AS matched FROM v
      WHERE start <= pos AND pos <= start + width - {WORDS}
      GROUP BY doc_id, license, n, start)
SELECT doc_id, license, max(matched)::INTEGER AS matched, n::INTEGER AS of_shingles,
       arg_max(start, matched * 1000000000::BIGINT - start)::INTEGER AS first_word
FROM c WHERE 100 * matched >= {PERCENT} * n GROUP BY doc_id, license, n
"""
