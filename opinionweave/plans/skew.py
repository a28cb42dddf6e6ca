"""Joins that stay safe when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALT = "_salt"


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys where NULL equals NULL; the key columns of the left side are kept."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    condition = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(named, condition, how).drop(*[f"_r_{k}" for k in keys])


def salted_join(
    big: DataFrame,
    small: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    salts: int = 16,
    how: str = "inner",
    sparse: bool = False,
) -> DataFrame:
    """Join a side that may have hot keys to a side that has one row per key.

    Rows of a hot key are spread over ``salts`` tasks by a hash of ``spread_by``
    (a row id, so a retried task gives the same salt); the per-key side is
    repeated once per salt, or with ``sparse`` only for the salts that occur (for
    a per-key side that is large or has long rows). Left and inner joins only.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left")
    left = big.withColumn(SALT, F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    if sparse:
        right = left.select(*keys, SALT).distinct().join(small, list(keys))
    else:
        right = small.withColumn(SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, SALT], how).drop(SALT)
