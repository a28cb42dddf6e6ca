"""Respondent ingest as a stream of micro-batches with quality scoring and keyed state.

Which (survey, anon_code) were seen is state of the stream, one entry a key in the state store. Durations are a state
table of counts per (survey, seconds), in buckets of surveys; a batch reads the newest version of the buckets it touches
and writes the next. Neither grows with the number of batches or reads stored respondents again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.responses import scored_respondents
from ..plans.lineage import list_paths, remove_path
from ..plans.quantiles import median_of_integers
from ..sources.ingest import split_documents
from ..sources.sinks import overwrite_partitions
from .arrivals import each_batch

PARTS = ("respondents", "responses", "rejected_documents", "rejected_responses")
BUCKETS = 64


def ingest_stream(docs: DataFrame, root: str, checkpoint: str, spread: int | None = None, buckets: int = BUCKETS):
    """Start the stream; each micro-batch is scored against all respondents that arrived so far, itself included.

    A (survey, anon_code) that came before is a rejected document, whichever batch it came in; within a batch the first
    completed is kept. Every table is partitioned by batch number and a batch rewrites only its own partition and its
    own version of the state table, so a batch that is run again gives the same tables.
    """

    def write(first: DataFrame, repeats: DataFrame, number: int) -> None:
        people, good, bad = split_documents(first)
        counts = duration_counts(people, f"{root}/durations", number, buckets)
        result = {
            "respondents": scored_respondents(people, median_of_integers(counts, ["survey_id"], "duration_sec", "_med", F.col("n"))),
            "responses": good,
            "rejected_documents": repeats.withColumn("anon_code", F.col("respondent.anon_code")),
            "rejected_responses": bad,
        }
        for name in PARTS:
            overwrite_partitions(result[name].withColumn("batch", F.lit(number)), f"{root}/{name}", ["batch"])

    return each_batch(docs, [F.col("survey_id"), F.col("respondent.anon_code")], ["completed_at"], checkpoint, write, spread)


def duration_counts(people: DataFrame, path: str, number: int, buckets: int = BUCKETS) -> DataFrame:
    """Respondents per (survey_id, duration_sec) after batch ``number``, of the buckets of surveys the batch touches.

    One row a distinct duration, however many respondents and batches there were. A version is a folder
    ``batch=.../bucket=...``; the newest one before this batch is read, so that a batch may be run again, and older ones go.
    """
    spark = people.sparkSession
    bucket = F.pmod(F.xxhash64("survey_id"), F.lit(buckets)).cast("int").alias("bucket")
    new = people.filter("duration_sec is not null").groupBy("survey_id", "duration_sec").agg(F.count(F.lit(1)).alias("n")).select("*", bucket)
    touched = {r[0] for r in people.select(bucket).distinct().collect()}
    versions: dict[int, list[int]] = {}
    for found in list_paths(spark, f"{path}/batch=*/bucket=*"):
        batch, own = (int(x.split("=")[1]) for x in found.rstrip("/").split("/")[-2:])
        if own in touched and batch < number:
            versions.setdefault(own, []).append(batch)
    folders = [f"{path}/batch={max(v)}/bucket={b}" for b, v in sorted(versions.items())]
    if folders:
        old = spark.read.schema(new.drop("bucket").schema).parquet(*folders)
        new = old.unionByName(new.drop("bucket")).groupBy("survey_id", "duration_sec").agg(F.sum("n").alias("n")).select("*", bucket)
    new.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={number}")
    for own, v in versions.items():
        for batch in v:
            if batch < max(v):
                remove_path(spark, f"{path}/batch={batch}/bucket={own}")
    return spark.read.schema(new.schema).parquet(f"{path}/batch={number}")
