"""From raw documents to a training mix, in stages; each is written as Parquet and read again.

The stages drop documents that the quality classifier rejects, all but one of each group of near
duplicates, the strings that repeat an earlier document, and documents that hold benchmark passages;
what is left is mixed to target weights along a curriculum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isograd.llm import decontaminate, mixing, neardup, quality, suffixes
from isograd.llm.common import table, written

#: Bytes of a string that counts as a repeat, as in op9; any passage of over 50 words is longer.
REPEAT = 50


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts, as they are.

    It learns from the labelled ones among docs. Null and empty texts are scored as empty texts.
    """
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id.

    Groups are linked by five-word shingles and a similarity of 0.8. Rows that repeat a doc_id and
    text are one document, of which one row stays. Rows without words or doc_id stay.
    """
    rows = docs.withColumn("_text_key", F.xxhash64("text"))
    found = neardup.near_duplicates(docs, neardup.Similar(words=5, percent=80))
    kept = written(found.where("kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "kept-ids")
    again = written(rows.groupBy("doc_id", "_text_key").agg(F.count(F.lit(1)).alias("n"))
                    .where("n > 1 AND doc_id IS NOT NULL").select("doc_id", "_text_key"), "repeated")
    names = [F.col(f"`{c}`") for c in docs.columns]
    once = rows.join(again, ["doc_id", "_text_key"], "left_anti")
    # of rows that occur again one is taken, the first by its other columns
    other = F.struct(*(F.col(f"`{c}`").cast("string") for c in docs.columns
                       if c not in ("doc_id", "text")), F.lit(0))
    several = (rows.join(again, ["doc_id", "_text_key"], "left_semi")
               .withColumn("_row", F.struct(other.alias("by"), F.struct(*names).alias("row")))
               .groupBy("doc_id", "_text_key").agg(F.min_by("_row.row", "_row.by").alias("_row"))
               .select("_row.*")) if again.limit(1).count() else None
    with_id = once.where("doc_id IS NOT NULL").select(*names)
    if several is not None:
        with_id = with_id.unionByName(several)
    return (with_id.join(kept, "doc_id", "left_semi").select(*names)
            .unionByName(docs.where("doc_id IS NULL")))


def repeat_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings that also start in a document with a smaller doc_id.

    n_chars is counted anew where it exists. A text of which nothing stays is empty.
    """
    out = suffixes.remove_repeats(docs, REPEAT)
    if "n_chars" in docs.columns:
        changed = F.col("n_removed") > 0
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind))
                             .otherwise(F.col("n_chars")))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item, as they are."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once per turn, in training order, with turn and position."""
    return mixing.curriculum(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", repeat_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to target weights", mixing_stage),
]

#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
