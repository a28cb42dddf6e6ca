"""Corpus pipeline over ``documents``: each stage calls one operator and works on what the stage before it kept.

The stages: language ID, line dedup, n-gram Jaccard join, benchmark decontamination, mixing to target weights. All
but the last return the columns of their input; the last adds ``rate`` and ``copies``. Nulls, empty and repeated rows
are treated as the operators say; a stage over an empty table returns none. Columns that ``documents`` does not have
come through every stage as they are, whatever their names; only ``rate`` and ``copies`` of the input give way to those
of the last stage.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinionweave.llm import decontaminate, language, line_dedup, mixing, ngram_join
from opinionweave.llm.common import table
from opinionweave.plans.lineage import written


def _columns(df: DataFrame) -> list:
    return [F.col(f"`{c}`") for c in df.columns]


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def with_any_columns(stage: Stage) -> Stage:
    """The stage with all other columns in one struct, so that none has a name that the operators use."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        others = [c for c in docs.columns if c not in COLUMNS]
        if not others:
            return stage(spark, docs, sf_dir)
        packed = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("others")
        out = stage(spark, docs.select(*[c for c in docs.columns if c in COLUMNS], packed), sf_dir)
        new = [c for c in out.columns if c not in COLUMNS and c != "others"]
        back = [F.col(f"others.c{others.index(c)}").alias(c) if c in others else F.col(c) for c in docs.columns if c not in new]
        return out.select(*back, *new)

    return run


@with_any_columns
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID learned from the stage's own rows with a language; rows without letters go."""
    model = language.train(docs, F.lit(True))
    found = language.predict(docs, model, {c: F.col(f"`{c}`") for c in docs.columns})
    return found.filter(F.col("lang_pred") != language.UNKNOWN).drop("lang_pred", "score")


@with_any_columns
def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document or line has, or has but for one word, go, and so do documents without any left."""
    kept = line_dedup.dedup_lines(docs).filter((F.size("kept") > 0) & (F.trim("text") != ""))
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*_columns(docs))


@with_any_columns
def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id; rows repeated in whole count once."""
    groups = ngram_join.jaccard_components(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("_id")).agg(
        F.min("component_id").alias("_group"), F.max("n_links").alias("_links")
    )
    kept = docs.join(groups, F.col("doc_id").eqNullSafe(F.col("_id")))
    alone = kept.filter("_links = 0").select(*_columns(docs))
    first = kept.filter("_links > 0 and doc_id <=> _group").dropDuplicates(["doc_id"]).select(*_columns(docs))
    return alone.unionByName(first)


@with_any_columns
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    leaks = decontaminate.benchmark_leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("_id")), "left_anti")


@with_any_columns
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their rate and ``copies``; those with no copy go.

    Documents that are most likely clean have a rate of 1 or more, which the operator takes into account for the
    others. The part of a rate after the point is the share of documents, by a hash of id and text, that get one copy more.
    """
    keep = {c: F.col(f"`{c}`") for c in docs.columns}
    rated = mixing.mixing_rates(docs, table(spark, sf_dir, "labels"), keep, least={"clean": 1.0})
    return rated.select(*_columns(docs), "rate", copies(F.col("rate"), F.xxhash64("doc_id", "text")).alias("copies")).filter("copies > 0")


def copies(rate: Column, number: Column) -> Column:
    """Whole copies that come to the rates in sum: one more where the number, as a part of its range, is below the fraction."""
    whole = F.floor(rate)
    return (whole + (F.pmod(number, F.lit(1 << 32)) < (rate - whole) * (1 << 32)).cast("int")).cast("bigint")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("mixing", mixed),
]

ORACLE_SQL = None  # SQL cannot train the first and the last stage


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
