"""Latest-per-key, top-n and exact ranks inside groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut_lineage
from .skew import null_safe_join

# Up to this limit Spark prunes each partition to n rows per group before the shuffle
# (spark.sql.optimizer.windowGroupLimitThreshold, default 1000).
GROUP_LIMIT = 1000


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """First row per key in the given total order; pruned to one row per key before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def top_n_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    n: int,
    rank_name: str | None = None,
    spread_by: Sequence[str] = (),
) -> DataFrame:
    """Top n rows per key. Beyond the pruning limit a salted first pass keeps hot keys split."""
    if n > GROUP_LIMIT and spread_by:
        salt = F.pmod(F.xxhash64(*spread_by), F.lit(64)).cast("int")
        w1 = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = (
            df.withColumn("_salt", salt)
            .withColumn("_rn", F.row_number().over(w1))
            .filter(F.col("_rn") <= n)
            .drop("_salt", "_rn")
        )
    w = W.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    return out.withColumnRenamed("_rn", rank_name) if rank_name else out.drop("_rn")


def last_periods(df: DataFrame, keys: Sequence[str], period: str, n: int) -> DataFrame:
    """Rows of the newest n distinct periods per key (all rows of a period are kept)."""
    w = W.partitionBy(*keys).orderBy(F.col(period).desc())
    return df.withColumn("_dr", F.dense_rank().over(w)).filter(F.col("_dr") <= n).drop("_dr")


def ordered_slices(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_slice: int = 500_000,
) -> DataFrame:
    """Range-partition by (keys, order) and stamp each row with its slice number.

    A hot group is cut into many slices of bounded size. The rows are kept before
    (they are counted, sampled and shuffled) and after stamping, so the slice
    numbers cannot change between two uses.
    """
    spark = df.sparkSession
    df = cut_lineage(df)
    rows = df.count()
    at_least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slices = max(1, min(at_least, rows)) if rows <= at_least * rows_per_slice else -(-rows // rows_per_slice)
    ranged = df.repartitionByRange(slices, *keys, *order)
    return cut_lineage(ranged.withColumn("_slice", F.spark_partition_id()))


def slice_carry(sliced: DataFrame, keys: Sequence[str], amount: Column) -> DataFrame:
    """Per (keys, slice): the amount held by all earlier slices of the same group."""
    w = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return (
        sliced.groupBy(*keys, "_slice")
        .agg(amount.alias("_amount"))
        .withColumn("_carry", F.coalesce(F.sum("_amount").over(w), F.lit(0)))
    )


def group_rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str,
    rows_per_slice: int = 500_000,
) -> DataFrame:
    """Exact row_number per group for groups too large for one task.

    ``order`` must be a total order inside the group. Each slice ranks its own
    rows; the carry of earlier slices is added.
    """
    sliced = ordered_slices(df, keys, order, rows_per_slice)
    carry = slice_carry(sliced, keys, F.count(F.lit(1))).select(*keys, "_slice", "_carry")
    w = W.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        null_safe_join(sliced, carry, [*keys, "_slice"])
        .withColumn(name, F.row_number().over(w) + F.col("_carry"))
        .drop("_slice", "_carry")
    )
