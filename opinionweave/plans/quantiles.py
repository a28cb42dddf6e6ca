"""Exact medians for groups of any size, without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .ranking import ordered_slices, slice_carry

BUCKET_WIDTH = 65_536


def _locate(pieces: DataFrame, keys: Sequence[str], piece: str) -> DataFrame:
    """Pieces (with running counts) that hold the lower or upper middle rank."""
    run = W.partitionBy(*keys).orderBy(piece).rowsBetween(W.unboundedPreceding, 0)
    everything = W.partitionBy(*keys)
    lo = F.floor((F.col("_n") - 1) / 2)
    hi = F.ceil((F.col("_n") - 1) / 2)
    has = lambda r: (F.col("_before") <= r) & (r < F.col("_upto"))
    return (
        pieces.withColumn("_upto", F.sum("_c").over(run))
        .withColumn("_before", F.col("_upto") - F.col("_c"))
        .withColumn("_n", F.sum("_c").over(everything))
        .filter(has(lo) | has(hi))
        .select(*keys, piece, "_before", lo.alias("_lo"), hi.alias("_hi"))
    )


def _pick(rows: DataFrame, keys: Sequence[str], piece: str, value: str, name: str) -> DataFrame:
    """Middle values out of the located pieces; mean of lower and upper middle."""
    run = W.partitionBy(*keys, piece).orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    return _middle(rows.withColumn("_to", F.sum("_w").over(run) + F.col("_before")), keys, value, name)


def _middle(rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Mean of the values whose rank ranges (``_to`` exclusive) hold ``_lo`` and ``_hi``."""
    has = lambda r: (F.col("_to") - F.col("_w") <= r) & (r < F.col("_to"))
    at = lambda r: F.max(F.when(has(F.col(r)), F.col(value)))
    return rows.groupBy(*keys).agg(((at("_lo") + at("_hi")).cast("double") / 2).alias(name))


def median_of_integers(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", count: Column | None = None
) -> DataFrame:
    """Exact interpolated median of a 32-bit integer column per group; NULLs ignored.

    Each row stands for ``count`` equal ones, if given.

    Rows are first counted per distinct value, combined on the map side, and kept.
    The middle is located among buckets of 65,536 values, then among the values of
    the bucket, so no task holds more than 65,536 rows of a group.
    """
    counts = cut_lineage(
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count(F.lit(1)) if count is None else F.sum(count)).alias("_w"))
    )
    counts = counts.withColumn("_bucket", F.floor(F.col(value) / BUCKET_WIDTH))
    buckets = counts.groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_c"))
    hit = _locate(buckets, keys, "_bucket")
    return _pick(counts.join(hit, [*keys, "_bucket"]), keys, "_bucket", value, name)


def weighted_median(
    df: DataFrame, keys: Sequence[str], value: str, count: Column, name: str = "median"
) -> DataFrame:
    """Exact median of any numeric column where each row stands for ``count`` equal rows."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(count).alias("_w"))
    sliced = ordered_slices(counts, keys, [value])
    pieces = slice_carry(sliced, keys, F.sum("_w")).withColumnRenamed("_amount", "_c").drop("_carry")
    hit = _locate(pieces, keys, "_slice")
    return _pick(sliced.join(hit, [*keys, "_slice"]), keys, "_slice", value, name)
