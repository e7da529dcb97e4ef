"""Queries over the corpus tables, with SQL where SQL can say the same."""

from __future__ import annotations

from isograd.llm.common import table
import corpus_pipeline
from isograd.llm import (conversations, decontaminate, language, licenses, mixing,
                         neardup, periods, suffixes, voronoi, warc)
from isograd.llm.quality import quality_scores
from isograd.llm.tokens import read_pieces, token_counts
from isograd.llm.toxicity import toxicity_scores
from isograd.suite.registry import Case

CASES: dict[str, Case] = {}

#: A public byte-level vocabulary of 50,256 pieces; any file of base64 pieces will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def case(name: str, sql: str | None = None):
    def register(query):
        CASES[name] = Case(query, sql)
        return query

    return register


@case("op1_token_counts")
def op1(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), read_pieces(VOCABULARY))


@case("op2_minhash_near_duplicates", neardup.SQL)
def op2(spark, sf_dir):
    return neardup.near_duplicates(table(spark, sf_dir, "documents"),
                                   neardup.Similar(words=3, percent=85))


@case("op4_mixing", mixing.SQL)
def op4(spark, sf_dir):
    return mixing.mixed_sizes(table(spark, sf_dir, "documents"))


@case("op5_warc_bundles", warc.SQL)
def op5(spark, sf_dir):
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


@case("op6_quality_classifier")
def op6(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@case("op3_toxicity")
def op3(spark, sf_dir):
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@case("op10_voronoi_top_k", voronoi.SQL)
def op10(spark, sf_dir):
    return voronoi.top_k(table(spark, sf_dir, "embeddings"))


@case("op8_decontamination")
def op8(spark, sf_dir):
    return decontaminate.overlaps(table(spark, sf_dir, "documents"),
                                  table(spark, sf_dir, "benchmark"))


@case("op9_suffix_repeats")
def op9(spark, sf_dir):
    return suffixes.repeat_digest(table(spark, sf_dir, "documents"))


@case("op7_license_scan", licenses.brute_sql())
def op7(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


@case("op11_language")
def op11(spark, sf_dir):
    return language.language_predictions(table(spark, sf_dir, "documents"))


@case("op12_periodic_runs")
def op12(spark, sf_dir):
    return periods.run_digest(table(spark, sf_dir, "documents"))


@case("op13_conversation_repair", conversations.SQL)
def op13(spark, sf_dir):
    return conversations.repair_digest(table(spark, sf_dir, "conversations"))


@case("pipeline", corpus_pipeline.ORACLE_SQL)
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
