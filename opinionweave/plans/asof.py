"""As-of join: every row meets the newest row of the other side at or before its time, whatever a key holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranking import ordered_slices
from .skew import null_safe_join


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    values: Sequence[str],
    rows_per_slice: int = 500_000,
) -> DataFrame:
    """All rows of ``left`` with the ``values`` of the newest row of ``right`` at or before their time.

    Both sides stand in one table, cut into range slices by (keys, time): a slice carries its newest right row along,
    and the last one of earlier slices fills its start, so a hot key is spread over many tasks. Of right rows with one
    key and time the greatest values count. A null key or time meets nothing, and rows without partner have null values.
    The keys and ``left_time`` keep the names of the left side; ``values`` must not be names of it.
    """
    clash = set(values) & set(left.columns)
    if clash:
        raise ValueError(f"values named like columns of the left side: {sorted(clash)}")
    keys = list(keys)
    one = right.filter(F.col(right_time).isNotNull()).groupBy(*keys, F.col(right_time).cast("timestamp").alias("_t")).agg(
        F.max(F.struct(*values)).alias("_r")
    )
    row = F.struct(*[F.col(c) for c in left.columns])
    none = F.lit(None)
    both = left.select(
        *keys, F.col(left_time).cast("timestamp").alias("_t"), F.lit(1).alias("_side"), F.xxhash64(*left.columns).alias("_tie"),
        row.alias("_l"), none.cast(one.schema["_r"].dataType).alias("_r"),
    ).unionByName(one.select(*keys, "_t", F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), "_r"), allowMissingColumns=True)
    sliced = ordered_slices(both, keys, ["_t", "_side", "_tie"], rows_per_slice)
    # struct around the values: a right row whose values are null still counts
    newest = F.when(F.col("_side") == 0, F.struct("_r"))
    last = sliced.groupBy(*keys, "_slice").agg(F.max_by(newest, F.when(F.col("_side") == 0, F.col("_t"))).alias("_last"))
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(*keys, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    within = W.partitionBy(*keys, "_slice").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = sliced.withColumn("_seen", F.last(newest, ignorenulls=True).over(within)).filter("_side = 1")
    known = F.col("_t").isNotNull()
    for k in keys:
        known = known & F.col(k).isNotNull()
    found = F.when(known, F.coalesce("_seen", "_carry"))
    return null_safe_join(seen, carry, [*keys, "_slice"]).select("_l.*", *[found["_r"][v].alias(v) for v in values])
