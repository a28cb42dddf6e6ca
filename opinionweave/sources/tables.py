"""Typed, tenant-scoped table registry."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ranking import ordered_slices
from .schemas import SCHEMAS


def scoped(df: DataFrame, org: Any, column: str = "org_id") -> DataFrame:
    """Rows of one tenant; without a tenant context no row is visible."""
    if org is None:
        return df.filter(F.lit(False))
    return df.filter(F.col(column).eqNullSafe(F.lit(org)))


def split_foreign_writes(
    batch: DataFrame, org: Any, column: str = "org_id", strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(rows the tenant may write, rows of another tenant with a violation code).

    ``strict`` makes the write itself fail on the first foreign row.
    """
    own = F.col(column).eqNullSafe(F.lit(org)) if org is not None else F.lit(False)
    if strict:
        checked = F.when(own, F.lit(True)).otherwise(
            F.raise_error(F.lit("row belongs to another tenant")).cast("boolean")
        )
        return batch.filter(checked), batch.filter(F.lit(False)).withColumn("violation", F.lit("FOREIGN_TENANT"))
    return batch.filter(own), batch.filter(~own).withColumn("violation", F.lit("FOREIGN_TENANT"))


def where_equal(df: DataFrame, **conditions: Any) -> DataFrame:
    """Equality filters; a parameter left at None is not applied."""
    for column, value in conditions.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def where_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.filter(F.col(column).isin(list(values)))


def national(df: DataFrame) -> DataFrame:
    """Whole-population rows: no province and no segment."""
    return df.filter(F.col("province_code").isNull() & F.col("segment").isNull())


class Tables:
    """Reads base tables from a folder, always for one tenant."""

    def __init__(self, spark: SparkSession, root: str, org: Any, fmt: str = "parquet") -> None:
        self.spark, self.root, self.org, self.fmt = spark, root.rstrip("/"), org, fmt

    def load(self, table: str, /, **conditions: Any) -> DataFrame:
        df = self.spark.read.schema(SCHEMAS[table]).format(self.fmt).load(f"{self.root}/{table}")
        key = "id" if table == "organizations" else "org_id"
        return where_equal(scoped(df, self.org, key), **conditions)

    def newest_first(self, table: str, /, **conditions: Any) -> DataFrame:
        return self.load(table, **conditions).orderBy(F.col("created_at").desc(), F.col("id"))

    def page(self, table: str, /, limit: int = 100, offset: int = 0, **conditions: Any) -> DataFrame:
        """One page of respondents, last completed first, missing times before all others."""
        return page(self.load(table, **conditions), limit, offset)


def page(df: DataFrame, limit: int = 100, offset: int = 0, time: str = "completed_at", row_id: str = "id") -> DataFrame:
    return df.orderBy(F.col(time).desc_nulls_first(), F.col(row_id)).offset(offset).limit(limit)


def write_pages(df: DataFrame, path: str, time: str = "completed_at", row_id: str = "id", rows_per_slice: int = 500_000) -> None:
    """Store rows in the order of ``page``, cut into range slices, with the number of rows in each.

    A page at any offset then reads the slices that it stands in and no others (``read_page``).
    """
    newest = -F.unix_micros(F.col(time).cast("timestamp"))
    sliced = ordered_slices(df.withColumn("_newest", newest), [], ["_newest", row_id], rows_per_slice)
    sliced.write.partitionBy("_slice").parquet(f"{path}/rows")
    sliced.limit(0).write.parquet(f"{path}/columns")  # an empty table has no slice to read its columns from
    sliced.groupBy("_slice").agg(F.count("*").alias("n")).coalesce(1).write.parquet(f"{path}/counts")


def read_page(spark: SparkSession, path: str, limit: int = 100, offset: int = 0, row_id: str = "id") -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` of the stored order; only the slices that hold them are read."""
    counts = spark.read.parquet(f"{path}/counts")
    # one row a slice
    ends = counts.withColumn("end", F.sum("n").over(W.orderBy("_slice")))
    held = ends.filter((F.col("end") > offset) & (F.col("end") - F.col("n") < offset + limit)).orderBy("_slice").collect()
    rows = spark.read.schema(spark.read.parquet(f"{path}/columns").schema).parquet(f"{path}/rows").filter(F.col("_slice").isin([r["_slice"] for r in held]))
    before = held[0]["end"] - held[0]["n"] if held else 0
    return rows.orderBy("_newest", row_id).offset(offset - before if held else 0).limit(limit).drop("_newest", "_slice")


def ordered_questions(questions: DataFrame, survey: str = "survey_id", position: str = "position", row_id: str = "question_id") -> DataFrame:
    """Questions of every survey in the order of their position; equal positions by id."""
    return questions.orderBy(survey, F.col(position).asc_nulls_first(), row_id)
