"""Queries of this package over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_tools, collocations, covering, decontaminate, impact_search, language, licenses, line_dedup, merkle, mixing, ngram_join, oracles, quality, suffix_tree
from .common import remainder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


@query("op1_license_scan")
def op1(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op2_quality_classifier")
def op2(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scores = quality.quality_scores(docs, labels, remainder(5) == 0)
    return scores.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


@query("op3_lm_scoring")
def op3(spark, sf_dir):
    return suffix_tree.lm_scores(table(spark, sf_dir, "documents"), remainder(10) == 0)


@query("op6_language_id")
def op6(spark, sf_dir):
    return language.identify_languages(table(spark, sf_dir, "documents"), remainder(3) == 1)


@query("op7_document_fingerprints", oracles.FINGERPRINTS)
def op7(spark, sf_dir):
    prints = merkle.document_fingerprints(table(spark, sf_dir, "documents"))
    return prints.withColumn("edited_paragraphs", F.array_join(F.col("edited_paragraphs").cast("array<string>"), ","))


@query("op9_line_dedup", oracles.LINES)
def op9(spark, sf_dir):
    return line_dedup.line_decisions(table(spark, sf_dir, "documents"))


@query("op10_chat_formatting", oracles.CHATS)
def op10(spark, sf_dir):
    schemas = spark.createDataFrame(chat_tools.SCHEMAS, "tool string, name string, type string, required boolean")
    return chat_tools.format_chats(chat_tools.calls_from_turns(table(spark, sf_dir, "conversations")), schemas)


@query("op5_ngram_jaccard_join")
def op5(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@query("op8_benchmark_decontamination")
def op8(spark, sf_dir):
    return decontaminate.benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op4_mixing_rates")
def op4(spark, sf_dir):
    return mixing.mixing_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_simhash_near_dedup")
def op13(spark, sf_dir):
    return covering.simhash_components(table(spark, sf_dir, "documents"))


@query("op12_ranked_search", oracles.RANKED)
def op12(spark, sf_dir):
    return impact_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op11_phrase_collocations", oracles.COLLOCATIONS)
def op11(spark, sf_dir):
    return collocations.phrase_collocations(table(spark, sf_dir, "documents"))
