"""Landing readers: nested survey documents and mention files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import bind, natural_id
from .schemas import INGEST_DOCUMENT, SCHEMAS


def read_documents(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """Respondent documents (one JSON object per line)."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(INGEST_DOCUMENT).json(path)


def read_mentions(spark: SparkSession, path: str, streaming: bool = False, fmt: str = "json") -> DataFrame:
    """Mention files dropped by a connector."""
    reader = spark.readStream if streaming else spark.read
    return reader.schema(SCHEMAS["mentions"]).format(fmt).load(path)


def split_documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(respondents with their accepted answers, responses, repeated answers) of nested documents.

    Ids follow from the natural keys. Only the first answer to a question is accepted.
    """
    # the question list is bound once per row
    marked = bind(
        F.transform("answers", lambda a: a["question_id"]),
        lambda asked: F.transform(
            F.col("answers"), lambda a, i: F.struct(a.alias("a"), F.coalesce(F.array_position(asked, a["question_id"]) == i + 1, F.lit(False)).alias("first"))
        ),
    )
    rid = natural_id(F.col("survey_id"), F.col("respondent.anon_code"))
    split = docs.select(
        rid.alias("respondent_id"), "org_id", "survey_id", "completed_at", "respondent.*", marked.alias("_m")
    )
    pick = lambda first: F.transform(F.filter("_m", lambda m: m["first"] == F.lit(first)), lambda m: m["a"])
    people = split.withColumn("answers", pick(True)).drop("_m")
    exploded = lambda first: split.select("respondent_id", "org_id", F.inline(pick(first)))
    return people, exploded(True), exploded(False)
