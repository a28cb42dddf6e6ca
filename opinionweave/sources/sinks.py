"""Append, overwrite-column and JSON sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ("org_id",)) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def _times(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def once_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key no other row has."""
    return _times(df, keys).filter("_times = 1").drop("_times")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The other rows, as violations."""
    return _times(df, keys).filter("_times > 1").drop("_times").withColumn("violation", F.lit("REPEATED_KEY"))


def replace_columns(base: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Base rows with the columns of ``new`` taken from it; rows without a match keep theirs.

    A key that ``new`` repeats is not applied. Files have no UPDATE, so the caller
    writes the result over the affected partitions.
    """
    new = once_per_key(new, keys)
    changed = [c for c in new.columns if c not in keys]
    marked = new.select(
        *keys, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{c}") for c in changed]
    )
    joined = base.join(marked, list(keys), "left")
    picked = [
        F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c) if c in base.columns else F.lit(None)).alias(c)
        if c in changed else F.col(c)
        for c in [*base.columns, *[c for c in changed if c not in base.columns]]
    ]
    return joined.select(*picked)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str] = ("org_id",)) -> None:
    """Rewrite only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def wire_json(df: DataFrame, columns: Sequence[str | Column], name: str = "body") -> DataFrame:
    """One JSON document per row, keys kept beside it."""
    return df.withColumn(name, F.to_json(F.struct(*columns)))
